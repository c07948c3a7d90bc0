"""Raster files: Parquet with a georeference, Arc/Info ASCII grids, GeoTIFF and E00."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talusgrid.errors import InputError
from talusgrid.grid import Georef, Grid

#: Raster types by name: the Spark type that holds them. Unsigned bytes need a short.
TYPES = {"uint8": "short", "uint16": "int", "int16": "short", "uint32": "long", "int32": "int", "float32": "float", "float64": "double", "complex64": "struct<re:float,im:float>"}
#: EPSG codes of UTM zones on WGS 84 are 326zz and 327zz; these are the other common ones.
PROJECTIONS = {4326: 'GEOGCS["WGS 84",DATUM["WGS_1984",SPHEROID["WGS 84",6378137,298.257223563]],PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433],AUTHORITY["EPSG","4326"]]'}


def projection_of(epsg: int) -> str:
    """Well-known text of an EPSG code: WGS 84 or one of its UTM zones; any other code as EPSG:code."""
    if epsg in PROJECTIONS:
        return PROJECTIONS[epsg]
    north, zone = epsg // 100 == 326, epsg % 100
    if epsg // 100 in (326, 327) and 1 <= zone <= 60:
        return f'PROJCS["WGS 84 / UTM zone {zone}{"N" if north else "S"}",{PROJECTIONS[4326]},PROJECTION["Transverse_Mercator"],PARAMETER["latitude_of_origin",0],PARAMETER["central_meridian",{zone * 6 - 183}],PARAMETER["scale_factor",0.9996],PARAMETER["false_easting",500000],PARAMETER["false_northing",{0 if north else 10000000}],UNIT["metre",1],AUTHORITY["EPSG","{epsg}"]]'
    return f"EPSG:{epsg}"


# -- Parquet --------------------------------------------------------------------------------


def save(grid: Grid, path: str, tile: int = 512) -> None:
    """All bands as Parquet by rows of tiles, so that a box of cells prunes files; the georeference beside it."""
    cells = grid.cells.withColumn("tile_row", F.floor(F.col("row") / tile).cast("int"))
    cells.repartition("tile_row").sortWithinPartitions("tile_row", "row", "col").write.mode("overwrite").partitionBy("tile_row").parquet(f"{path}/cells")
    grid.geo.to_row(grid.spark).coalesce(1).write.mode("overwrite").json(f"{path}/georef")


def load(spark: SparkSession, path: str, bands: list[str] | None = None) -> Grid:
    """A saved grid; only the bands asked for are read."""
    g = spark.read.json(f"{path}/georef").first()
    geo = Georef(g.nx, g.ny, g.dx, g.xllcenter, g.yllcenter, g.projection or "", bool(g.geographic))
    cells = spark.read.parquet(f"{path}/cells").drop("tile_row")
    return Grid(cells.select("row", "col", *bands) if bands else cells, geo)


def window_of(spark: SparkSession, path: str, row0: int, row1: int, tile: int = 512) -> DataFrame:
    """Cells of a saved grid in a range of rows: other tiles' files are not read."""
    return spark.read.parquet(f"{path}/cells").where((F.col("tile_row").between(row0 // tile, row1 // tile)) & F.col("row").between(row0, row1)).drop("tile_row")


# -- Arc/Info ASCII -------------------------------------------------------------------------

_HEADER = {"ncols", "nrows", "cellsize", "xllcorner", "xllcenter", "yllcorner", "yllcenter", "nodata_value"}


def ascii_header(lines: list[str]) -> tuple[Georef, float | None, int]:
    """Georeference, no-data value and number of header lines; keys in any case, the last word of a line is its value."""
    found: dict[str, float] = {}
    n = 0
    for line in lines:
        words = line.split()
        if len(words) < 2 or words[0].lower() not in _HEADER:
            break
        found[words[0].lower()] = float(words[-1])
        n += 1
    for need in (("ncols",), ("nrows",), ("cellsize",), ("xllcorner", "xllcenter"), ("yllcorner", "yllcenter")):
        if not any(k in found for k in need):
            raise InputError("header", f"{' or '.join(need)} is missing")
    dx = found["cellsize"]
    xll = found["xllcenter"] if "xllcenter" in found else found["xllcorner"] + dx / 2
    yll = found["yllcenter"] if "yllcenter" in found else found["yllcorner"] + dx / 2
    return Georef(int(found["ncols"]), int(found["nrows"]), dx, xll, yll), found.get("nodata_value"), n


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): lines with their number from 0, counted by block of the file."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("m"))
    lines = lines.withColumn("n", F.row_number().over(Window.partitionBy("block").orderBy("m")))
    sizes = lines.groupBy("block").agg(F.max("n").alias("size"))
    before = sizes.withColumn("before", F.coalesce(F.sum("size").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return lines.join(F.broadcast(before), "block").select((F.col("before") + F.col("n") - 1).alias("line"), "value")


def read_ascii(spark: SparkSession, path: str, epsg: int | None = None) -> Grid:
    """An ASCII grid with a row of the grid on each line; its no-data value becomes NULL."""
    geo, nodata, skip = ascii_header([r.value for r in spark.read.text(path).limit(6).collect()])
    if epsg is not None:
        geo = Georef(geo.nx, geo.ny, geo.dx, geo.xll, geo.yll, projection_of(epsg), epsg == 4326)
    rows = _numbered(spark, path).where(F.col("line") >= skip).select((F.col("line") - skip).alias("row"), F.posexplode(F.split(F.trim("value"), r"\s+")).alias("col", "v"))
    value = F.expr("try_cast(v as double)")
    empty = F.isnan(value) if nodata is None or nodata != nodata else F.isnan(value) | (value == nodata)
    return Grid(rows.where((F.col("row") < geo.ny) & (F.col("col") < geo.nx)).select("row", F.col("col").cast("long").alias("col"), F.when(~empty, value).alias("value")), geo)


def ascii_lines(grid: Grid) -> DataFrame:
    """(row, line) of the body, each value as %10.2f and no data as nan."""
    text = F.when(F.col("value").isNull(), F.lit("       nan")).otherwise(F.format_string("%10.2f", "value"))
    rows = grid.dense().cells.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("col", text.alias("t")))).alias("v"))
    return rows.select("row", F.array_join(F.transform("v", lambda x: x["t"]), " ").alias("line"))


def _deflated(rows: DataFrame, text: Callable[[pa.RecordBatch], str]) -> Iterator[str]:
    """The text of all batches of rows, by ``row``: made and deflated in Spark, sent a partition at a time."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(text(batch).encode(), 6)], pa.binary())], names=["data"])

    for r in rows.orderBy("row").mapInArrow(pack, "data binary").toLocalIterator():
        yield zlib.decompress(r.data).decode()


def write_ascii(grid: Grid, path: str) -> None:
    """One local text file; lines are made in Spark and come to the driver deflated, a partition at a time."""
    g = grid.geo
    with open(path, "w") as out:
        out.write(f"ncols {g.nx}\nnrows {g.ny}\nxllcenter {g.xll!r}\nyllcenter {g.yll!r}\ncellsize {g.dx!r}\nNODATA_value nan\n")
        for text in _deflated(ascii_lines(grid), lambda batch: "".join(f"{line}\n" for line in batch.column("line").to_pylist())):
            out.write(text)


def write_e00(grid: Grid, path: str, name: str = "GRID") -> None:
    """An uncompressed E00 grid: double precision, five values to a line."""
    g = grid.geo
    x0, y0, nodata = g.xll - g.dx / 2, g.yll - g.dx / 2, -3.40282346638529e38
    number = lambda v: f"{v:21.14E}"
    with open(path, "w") as out:
        out.write(f"EXP  0 {name}.E00\nGRD  3\n{g.nx:10d}{g.ny:10d} 2{number(nodata)}\n{number(g.dx)}{number(g.dx)}\n{number(x0)}{number(y0)}\n{number(x0 + g.nx * g.dx)}{number(y0 + g.ny * g.dx)}\n")
        rows = grid.dense().cells.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("col", "value"))).alias("v"))

        def lines(batch: pa.RecordBatch) -> str:
            made = []
            for v in batch.column("v").to_pylist():
                values = [number(nodata if v is None else v) for v in v]
                made += ["".join(values[i : i + 3]) + "\n" for i in range(0, len(values), 3)]
            return "".join(made)

        for text in _deflated(rows.select("row", F.col("v.value").alias("v")), lines):
            out.write(text)
        out.write("EOG\nEOS\n")


def read_e00(spark: SparkSession, path: str) -> Grid:
    """The first grid of an uncompressed E00 file in double precision, three values to a line; its no-data value becomes NULL."""
    head = [r.value for r in spark.read.text(path).limit(6).collect()]
    nx, ny = int(head[2][:10]), int(head[2][10:20])
    nodata, dx = float(head[2][22:]), float(head[3][:21])
    geo = Georef(nx, ny, dx, float(head[4][:21]) + dx / 2, float(head[4][21:42]) + dx / 2)
    lines = -(-nx // 3)
    rows = _numbered(spark, path).where((F.col("line") >= 6) & (F.col("line") < 6 + ny * lines)).withColumn("at", F.col("line") - 6)
    values = rows.select(F.floor(F.col("at") / lines).alias("row"), (F.col("at") % lines * 3).alias("first"), F.posexplode(F.array(*[F.expr(f"try_cast(trim(substring(value, {21 * k + 1}, 21)) as double)") for k in range(3)])).alias("k", "v"))
    value = F.when(F.col("v") != nodata, F.col("v"))
    return Grid(values.where("v is not null").select("row", (F.col("first") + F.col("k")).alias("col"), value.alias("value")), geo)


# -- GeoTIFF --------------------------------------------------------------------------------

_KINDS = {(1, 8): "u1", (1, 16): "u2", (2, 16): "i2", (1, 32): "u4", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8", (2, 8): "i1"}
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 8: 2, 9: 4, 11: 4, 12: 8, 16: 8}
_FORMATS = {1: "B", 3: "H", 4: "I", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}


def _lzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, high bits first."""
    out, table, width, at = bytearray(), [bytes([i]) for i in range(256)] + [b"", b""], 9, 0
    last = b""
    bits = int.from_bytes(data, "big")
    total = len(data) * 8
    while at + width <= total:
        code = (bits >> (total - at - width)) & ((1 << width) - 1)
        at += width
        if code == 257:
            break
        if code == 256:
            table, width, last = table[:258], 9, b""
            continue
        entry = table[code] if code < len(table) else last + last[:1]
        out += entry
        if last:
            table.append(last + entry[:1])
        last = entry
        width = 12 if len(table) >= 2047 else 11 if len(table) >= 1023 else 10 if len(table) >= 511 else 9
    return bytes(out)


def decode_tiff(data: bytes) -> tuple[np.ndarray, dict]:
    """Bands x rows x columns, and nodata and geotransform, of an uncompressed, deflated or LZW TIFF in strips or tiles."""
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    big = struct.unpack(order + "H", data[2:4])[0] == 43
    at = struct.unpack(order + ("Q" if big else "I"), data[8:16] if big else data[4:8])[0]
    n = struct.unpack(order + ("Q" if big else "H"), data[at : at + (8 if big else 2)])[0]
    at += 8 if big else 2
    tags: dict[int, tuple] = {}
    for _ in range(n):
        size = 20 if big else 12
        tag, kind = struct.unpack(order + "HH", data[at : at + 4])
        count = struct.unpack(order + ("Q" if big else "I"), data[at + 4 : at + (12 if big else 8)])[0]
        room = data[at + (12 if big else 8) : at + size]
        length = count * _SIZES[kind]
        raw = room[:length] if length <= len(room) else data[(p := struct.unpack(order + ("Q" if big else "I"), room)[0]) : p + length]
        tags[tag] = (raw.split(b"\0")[0].decode(),) if kind == 2 else struct.unpack(f"{order}{count}{_FORMATS.get(kind, 'B')}", raw) if kind in _FORMATS else (raw,)
        at += size
    nx, ny, bands = tags[256][0], tags[257][0], tags.get(277, (1,))[0]
    dtype = np.dtype(order + _KINDS[tags.get(339, (1,))[0], tags.get(258, (1,))[0]])
    packing, predictor, planar = tags.get(259, (1,))[0], tags.get(317, (1,))[0], tags.get(284, (1,))[0]
    if 322 in tags:
        w, h = tags[322][0], tags[323][0]
        offsets, sizes = tags[324], tags[325]
    else:
        w, h = nx, min(tags.get(278, (ny,))[0], ny)
        offsets, sizes = tags[273], tags[279]
    across, down = -(-nx // w), -(-ny // h)
    out = np.zeros((bands, ny, nx), dtype.newbyteorder("="))
    for k, (o, s) in enumerate(zip(offsets, sizes, strict=True)):
        raw = data[o : o + s]
        raw = _lzw(raw) if packing == 5 else zlib.decompress(raw) if packing in (8, 32946) else raw
        per = bands if planar == 1 else 1
        block = np.frombuffer(raw, dtype)
        rows = len(block) // (w * per)
        block = block[: rows * w * per].reshape(rows, w, per).astype(dtype.newbyteorder("="))
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=block.dtype)
        band, cell = (None, k) if planar == 1 else divmod(k, across * down)
        i, j = cell // across * h, cell % across * w
        rows, cols = min(rows, ny - i), min(w, nx - j)
        part = block[:rows, :cols].transpose(2, 0, 1)
        out[slice(None) if band is None else slice(band, band + 1), i : i + rows, j : j + cols] = part
    nodata = tags.get(42113)
    scale, tie = tags.get(33550, (1.0, 1.0, 0.0)), tags.get(33922, (0.0,) * 6)
    return out, {"nodata": float(nodata[0]) if nodata else None, "transform": (tie[3] - tie[0] * scale[0], scale[0], 0.0, tie[4] + tie[1] * scale[1], 0.0, -scale[1]), "projection": tags.get(34737, ("",))[0], "geographic": 4326 in tags.get(34735, ())}


def read_tiff(spark: SparkSession, path: str, bands: list[str] | None = None) -> Grid:
    """A GeoTIFF's bands; no data and NaN become NULL, but bytes keep all values. One task decodes a file."""
    names = bands or ["value"]
    files = spark.read.format("binaryFile").load(path)
    # the shape and position, decoded where the file is
    def meta(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for content in batch.column("content"):
                data, info = decode_tiff(content.as_py())
                rows.append(json.dumps(info | {"shape": data.shape, "projection": info["projection"]}))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], names=["info"])

    info = json.loads(files.select("content").mapInArrow(meta, "info string").first().info)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                data, own = decode_tiff(content.as_py())
                rows = max(1, (1 << 18) // data.shape[2])
                for i in range(0, data.shape[1], rows):
                    part = data[:, i : i + rows].astype(np.float64)
                    if data.dtype != np.uint8 and own["nodata"] is not None:
                        part[part == own["nodata"]] = np.nan
                    r, c = np.indices(part.shape[1:])
                    arrays = [pa.array(r.ravel() + i, pa.int64()), pa.array(c.ravel(), pa.int64())]
                    yield pa.RecordBatch.from_arrays(arrays + [pa.array(part[k].ravel(), pa.float64(), from_pandas=True) for k in range(len(names))], names=["row", "col", *names])

    rows = files.select("content").mapInArrow(cells, "row long, col long, " + ", ".join(f"{n} double" for n in names))
    _, ny, nx = info["shape"]
    return Grid(rows, Georef.from_geotransform(nx, ny, info["transform"], info["projection"], info["geographic"]))


def write_tiff(grid: Grid, path: str, dtype: str = "float64", bands: list[str] | None = None) -> None:
    """One local deflated GeoTIFF with NaN as no data. Strips are packed in Spark and written as they arrive."""
    names, g = bands or grid.bands, grid.geo
    kind = np.dtype(dtype).newbyteorder("<")
    rows = max(1, min(g.ny, (1 << 16) // max(g.nx, 1)))

    def strip(key, cells):
        import pandas as pd

        h = min(rows, g.ny - int(key[0]) * rows)
        block = np.full((h, g.nx, len(names)), np.nan if kind.kind == "f" else 0)
        for k, n in enumerate(names):
            v = cells[n].to_numpy(dtype=float)
            block[cells["row"] - int(key[0]) * rows, cells["col"], k] = v if kind.kind == "f" else np.nan_to_num(v)
        return pd.DataFrame({"strip": [key[0]], "data": [zlib.compress(block.astype(kind).tobytes(), 6)]})

    packed = grid.dense().cells.withColumn("strip", F.floor(F.col("row") / rows)).groupBy("strip").applyInPandas(strip, "strip long, data binary")
    sizes = []
    with open(path, "wb") as out:
        out.write(b"II" + struct.pack("<HHHQ", 43, 8, 0, 0))
        for r in packed.orderBy("strip").toLocalIterator():
            sizes.append(len(r.data))
            out.write(r.data)
        starts = (16 + np.concatenate(([0], np.cumsum(sizes)[:-1]))).astype(int).tolist()
        t = g.geotransform
        fmt = {"u": 1, "i": 2, "f": 3}[kind.kind]
        keys = (1, 1, 0, 3, 1024, 0, 1, 2 if g.geographic else 1, 1025, 0, 1, 1, 2048 if g.geographic else 3072, 0, 1, 4326 if g.geographic else 32767)
        entries = [
            (256, 4, (g.nx,)), (257, 4, (g.ny,)), (258, 3, (kind.itemsize * 8,) * len(names)), (259, 3, (8,)), (262, 3, (1,)), (273, 16, tuple(starts)), (277, 3, (len(names),)), (278, 4, (rows,)),
            (279, 16, tuple(sizes)), (284, 3, (1,)), (339, 3, (fmt,) * len(names)), (33550, 12, (t[1], t[1], 0.0)), (33922, 12, (0.0, 0.0, 0.0, t[0], t[3], 0.0)), (34735, 3, keys),
            (34737, 2, g.projection.encode() + b"\0"), (42113, 2, b"nan\0" if fmt == 3 else b"0\0"),
        ]
        where = out.tell()
        table, extra = struct.pack("<Q", len(entries)), b""
        end = where + 8 + 20 * len(entries) + 8
        for tag, ty, v in entries:
            raw = v if ty == 2 else struct.pack(f"<{len(v)}{_FORMATS[ty]}", *v)
            if len(raw) <= 8:
                room = raw.ljust(8, b"\0")
            else:
                room = struct.pack("<Q", end + len(extra))
                extra += raw
            table += struct.pack("<HHQ", tag, ty, len(v)) + room
        out.write(table + struct.pack("<Q", 0) + extra)
        out.seek(8)
        out.write(struct.pack("<Q", where))


def read_scarp_wavelet(spark: SparkSession, path: str, elevation_path: str | None = None) -> Grid:
    """Bands amplitude, kt, orientation and snr of a raster of wavelet fits, with the elevation they were made from if given."""
    fits = read_tiff(spark, path, ["amplitude", "kt", "orientation", "snr"])
    return fits if elevation_path is None else fits.join(read_tiff(spark, elevation_path), "elevation")


def mosaic_folder(spark: SparkSession, pattern: str) -> Grid:
    """The mosaic of all rasters that match a pattern, in the order of their names; .asc files are ASCII grids, others GeoTIFFs."""
    from talusgrid.operators.tiling import mosaic

    # names alone, of files that a mosaic's plan lists one by one anyway
    files = sorted(r.path for r in spark.read.format("binaryFile").load(pattern).select("path").collect())
    if not files:
        raise InputError("pattern", f"no file matches {pattern}")
    return mosaic([read_ascii(spark, f) if f.lower().endswith(".asc") else read_tiff(spark, f) for f in files])

"""Polygons: shapefiles and well-known text in, masks by scanlines, outlines of equal-valued regions out."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talusgrid.grid import Georef, Grid
from talusgrid.operators.regions import regions

RINGS = "shape long, ring int, seq int, x double, y double"


def _shp_records(data: bytes) -> Iterator[tuple[int, int, int, float, float]]:
    at, shape = 100, 0
    while at + 12 <= len(data):
        length = struct.unpack(">i", data[at + 4 : at + 8])[0] * 2
        body = data[at + 8 : at + 8 + length]
        at += 8 + length
        if len(body) >= 44 and struct.unpack("<i", body[:4])[0] in (3, 5, 13, 15, 23, 25):
            parts, points = struct.unpack("<ii", body[36:44])
            first = [*struct.unpack(f"<{parts}i", body[44 : 44 + 4 * parts]), points]
            xy = struct.unpack(f"<{2 * points}d", body[44 + 4 * parts : 44 + 4 * parts + 16 * points])
            for k in range(parts):
                for s, i in enumerate(range(first[k], first[k + 1])):
                    yield shape, k, s, xy[2 * i], xy[2 * i + 1]
        shape += 1


def read_shapefile(spark: SparkSession, path: str) -> DataFrame:
    """Vertices (shape, ring, seq, x, y) of the polygons of a .shp file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = list(_shp_records(content.as_py()))
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64()), strict=True)], names=["shape", "ring", "seq", "x", "y"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RINGS)


def write_shapefile(shapes: Sequence[Sequence[Sequence[tuple[float, float]]]], path: str) -> None:
    """A .shp file of polygons, each a list of closed rings."""

    def box(points: list[tuple[float, float]]) -> tuple[float, ...]:
        xs, ys = zip(*points, strict=True)
        return min(xs), min(ys), max(xs), max(ys)

    records = []
    for n, rings in enumerate(shapes, 1):
        points = [p for ring in rings for p in ring]
        first = [sum(map(len, rings[:k])) for k in range(len(rings))]
        body = struct.pack(f"<i4dii{len(rings)}i", 5, *box(points), len(rings), len(points), *first) + b"".join(struct.pack("<2d", *p) for p in points)
        records.append(struct.pack(">ii", n, len(body) // 2) + body)
    size = (100 + sum(map(len, records))) // 2
    head = struct.pack(">7i", 9994, 0, 0, 0, 0, 0, size) + struct.pack("<ii8d", 1000, 5, *box([p for rings in shapes for ring in rings for p in ring]), 0, 0, 0, 0)
    with open(path, "wb") as out:
        out.write(head + b"".join(records))


def from_wkt(texts: DataFrame, shape: str = "shape", wkt: str = "wkt") -> DataFrame:
    """Vertices of POLYGON and MULTIPOLYGON texts, all in the JVM."""
    rings = F.regexp_extract_all(F.col(wkt), F.lit(r"\(([^()]+)\)"), F.lit(1))
    rows = texts.select(F.col(shape).cast("long").alias("shape"), F.posexplode(rings).alias("ring", "text"))
    rows = rows.select("shape", "ring", F.posexplode(F.split("text", r"\s*,\s*")).alias("seq", "pair")).withColumn("p", F.split(F.trim("pair"), r"\s+"))
    return rows.select("shape", "ring", "seq", F.col("p")[0].cast("double").alias("x"), F.col("p")[1].cast("double").alias("y"))


def rasterize(vertices: DataFrame, geo: Georef) -> Grid:
    """1 where a pixel's centre lies inside a polygon (even-odd over its rings), else 0.

    Scanlines: each edge is sent to the rows it crosses, the crossings of a row are paired in
    order, and each pair becomes a run of cells. No cell is tested against a polygon.
    """
    by_ring = Window.partitionBy("shape", "ring").orderBy("seq")
    nxt = lambda c: F.coalesce(F.lead(c).over(by_ring), F.first(c).over(by_ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    edges = vertices.select("shape", F.col("x").alias("x0"), F.col("y").alias("y0"), nxt("x").alias("x1"), nxt("y").alias("y1")).where("y0 <> y1")
    at = lambda y: F.lit(float(geo.ny - 1)) - (y - F.lit(float(geo.yll))) / F.lit(float(geo.dx))
    # rows whose centre y has low <= y < high
    first, last = F.floor(at(F.greatest("y0", "y1"))) + 1, F.floor(at(F.least("y0", "y1")))
    rows = edges.withColumns({"r0": F.greatest(first, F.lit(0)), "r1": F.least(last, F.lit(geo.ny - 1))}).where("r0 <= r1").withColumn("row", F.explode(F.sequence("r0", "r1")))
    x = F.col("x0") + (geo.y() - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))
    crossings = rows.groupBy("shape", "row").agg(F.array_sort(F.collect_list(x)).alias("xs"))
    pairs = crossings.select("row", F.col("xs"), F.explode(F.sequence(F.lit(0), F.floor(F.size("xs") / 2).cast("int") - 1)).alias("k")).where("size(xs) > 1")
    col = lambda x: (x - F.lit(float(geo.xll))) / F.lit(float(geo.dx))
    run = pairs.select("row", F.greatest(F.ceil(col(F.get("xs", F.col("k") * 2))), F.lit(0)).alias("c0"), F.least(F.ceil(col(F.get("xs", F.col("k") * 2 + 1))) - 1, F.lit(geo.nx - 1)).alias("c1")).where("c0 <= c1")
    inside = run.select("row", F.explode(F.sequence("c0", "c1")).alias("col")).distinct().withColumn("one", F.lit(1.0))
    return Grid(geo.frame(vertices.sparkSession).join(inside, ["row", "col"], "left").select("row", "col", F.coalesce("one", F.lit(0.0)).alias("value")), geo)


def outlines(grid: Grid) -> tuple[DataFrame, DataFrame]:
    """Four-connected regions of equal value: (region, value, cells, box) and their sides (region, x0, y0, x1, y1).

    Each side of a cell that no cell of the same region shares is one side of the outline, with
    the region on its left.
    """
    geo, h = grid.geo, grid.geo.dx / 2
    rows = regions(grid).withColumns({"x": geo.x(), "y": geo.y()})
    table = rows.groupBy("region").agg(F.first("value").alias("value"), F.count("*").alias("cells"), (F.min("x") - h).alias("xmin"), (F.max("x") + h).alias("xmax"), (F.min("y") - h).alias("ymin"), (F.max("y") + h).alias("ymax"))
    # sides as lines between whole corners: two cells of one region share a side and cancel out
    corner = lambda i, j: F.struct((F.col("row") + i).alias("r"), (F.col("col") + j).alias("c"))
    sides = F.array(*[F.struct(corner(*a).alias("a"), corner(*b).alias("b"), F.lit(back).alias("back")) for a, b, back in (((1, 0), (1, 1), False), ((0, 1), (1, 1), True), ((0, 0), (0, 1), True), ((0, 0), (1, 0), False))])
    lines = rows.select("region", F.explode(sides).alias("s")).groupBy("region", "s.a", "s.b").agg(F.count("*").alias("n"), F.first("s.back").alias("back")).where("n = 1")
    p, q = F.when(F.col("back"), F.col("b")).otherwise(F.col("a")), F.when(F.col("back"), F.col("a")).otherwise(F.col("b"))
    x, y = (lambda c: geo.x(c) - h), (lambda r: geo.y(r) + h)
    return table, lines.select("region", x(p["c"]).alias("x0"), y(p["r"]).alias("y0"), x(q["c"]).alias("x1"), y(q["r"]).alias("y1"))


def vectorize(grid: Grid, path: str) -> None:
    """Regions and their outlines as Parquet below a path."""
    table, lines = outlines(grid)
    table.write.mode("overwrite").parquet(f"{path}/regions")
    lines.write.mode("overwrite").parquet(f"{path}/outlines")


def ring_wkt(lines: list[tuple[float, float, float, float]]) -> str:
    """A MULTIPOLYGON-less outline of one region as POLYGON text: its sides chained into rings, outermost first."""
    after: dict[tuple[float, float], list[tuple[float, float]]] = {}
    for x0, y0, x1, y1 in lines:
        after.setdefault((x0, y0), []).append((x1, y1))
    rings = []
    while after:
        start = next(iter(after))
        ring, at = [start], start
        while True:
            to = after[at].pop()
            if not after[at]:
                del after[at]
            ring.append(to)
            at = to
            if at == start:
                break
        rings.append(ring)
    rings.sort(key=lambda r: -abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r[:-1], r[1:], strict=True))))
    return "POLYGON (" + ", ".join("(" + ", ".join(f"{x:g} {y:g}" for x, y in r) + ")" for r in rings) + ")"

"""Registered queries of sources, sinks, points, clips and trees, each beside its SQL.

A sink's query writes the surface below the shared folder and returns what its source reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talusgrid.api import build
from talusgrid.functions import projection
from talusgrid.grid import Georef, Grid
from talusgrid.operators import accumulate, flow, profile, stencil, tiling, windows
from talusgrid.operators.search import nearest_vertex
from talusgrid.plans import pipelines
from talusgrid.plans.raster_queries import AO, THETA, Query, band_mask, drained, micro, micros, out, outlets, surface, table, whole, with_area, with_length
from talusgrid.plans.raster_sql import _BAND, _RING, AREA, D8, LENGTH, NB, ORACLE, OUTLETS, WALK, G, _grad, _kernel, cells, q
from talusgrid.runtime import checkpointed, local_folder
from talusgrid.sources import rasters, vector

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


# -- sources and sinks --------------------------------------------------------------------------


@query(ORACLE["grid_scan"])
def tiff_round_trip(spark, d):
    path = local_folder(spark, "tiff") + "/surface.tif"
    rasters.write_tiff(surface(spark, d), path)
    return out(rasters.read_tiff(spark, path), v=whole("value"))


@query(ORACLE["grid_scan"])
def ascii_round_trip(spark, d):
    path = local_folder(spark, "ascii") + "/surface.asc"
    rasters.write_ascii(surface(spark, d), path)
    return out(rasters.read_ascii(spark, path, 32632), v=whole("value"))


@query(ORACLE["grid_scan"])
def e00_round_trip(spark, d):
    path = local_folder(spark, "e00") + "/surface.e00"
    rasters.write_e00(surface(spark, d), path)
    return out(rasters.read_e00(spark, path), v=whole("value"))


def _ks_like(z: Grid) -> Grid:
    v = F.col("value")
    return z.select(v.alias("value"), F.col("col").cast("int").alias("n"), (v / 2).alias("mse"), (v * 3).alias("ss"), (v / 4096).alias("r2"), (v / 8192).alias("pval"), F.col("row").cast("int").alias("n_regression"))


@query(cells(f"CAST(z AS BIGINT) AS v, CAST(c AS BIGINT) AS n, {q('z / 2')} AS mse, {q('z * 3')} AS ss, {q('z / 4096')} AS r2, {q('z / 8192')} AS pval, CAST(r AS BIGINT) AS n_regression", "g", G))
def fit_bands_saved(spark, d):
    """The seven bands that ks and theta grids are saved with."""
    path = local_folder(spark, "fits") + "/grid"
    rasters.save(_ks_like(surface(spark, d)), path)
    return out(rasters.load(spark, path), v=whole("value"), n=whole("n"), mse=micro("mse"), ss=micro("ss"), r2=micro("r2"), pval=micro("pval"), n_regression=whole("n_regression"))


@query(ORACLE["gradient"])
def gradient_saved(spark, d):
    path = local_folder(spark, "gradient") + "/gradient.tif"
    rasters.write_tiff(stencil.gradient(surface(spark, d)), path, bands=["gx", "gy"])
    return micros(rasters.read_tiff(spark, path, ["gx", "gy"]), "gx", "gy")


@query(cells(f"{q('z / 8')} AS v, {q('z / 64')} AS min_c", "g", G))
def width_bands_saved(spark, d):
    """The two bands of valley widths; of a saved grid only these are read."""
    path = local_folder(spark, "widths") + "/grid"
    rasters.save(surface(spark, d).select((F.col("value") / 8).alias("value"), (F.col("value") / 64).alias("min_c"), F.lit(1.0).alias("other")), path)
    return micros(rasters.load(spark, path, ["value", "min_c"]), "value", "min_c")


@query(ORACLE["flow_length"])
def flow_length_saved(spark, d):
    """Lengths with the cells that they come from, which are a band of their own."""
    path = local_folder(spark, "lengths") + "/grid"
    rasters.save(with_length(spark, d)[2], path)
    return out(rasters.load(spark, path), length=micro("value"), donor=F.col("donor"))


@query(cells(f"{q('z / 2')} AS amplitude, {q('z * 4')} AS kt, CAST(z % 180 AS BIGINT) AS orientation, {q('z / 16')} AS snr, CAST(z AS BIGINT) AS elevation", "g", G))
def scarp_wavelet(spark, d):
    z, v = surface(spark, d), F.col("value")
    folder = local_folder(spark, "scarps")
    bands = z.select((v / 2).alias("amplitude"), (v * 4).alias("kt"), (v % 180).alias("orientation"), (v / 16).alias("snr"))
    rasters.write_tiff(bands, f"{folder}/scarps.tif", bands=["amplitude", "kt", "orientation", "snr"])
    rasters.write_tiff(z, f"{folder}/elevation.tif")
    got = build("ScarpWavelet", spark, wavelet_filename=f"{folder}/scarps.tif", elevation_filename=f"{folder}/elevation.tif")
    return out(got, amplitude=micro("amplitude"), kt=micro("kt"), orientation=whole("orientation"), snr=micro("snr"), elevation=whole("elevation"))


@query(f"WITH {G} SELECT r AS \"row\", c AS col, CAST(CASE WHEN c >= 20 THEN z * 2 ELSE z END AS BIGINT) AS v FROM g")
def folder_mosaic(spark, d):
    """All rasters of a folder; where two overlap the last by name holds."""
    z, folder = surface(spark, d), local_folder(spark, "mosaic")
    rasters.write_tiff(tiling.window(z, 0, 0, z.geo.ny, 30), f"{folder}/a.tif")
    rasters.write_tiff(tiling.window(z, 0, 20, z.geo.ny, z.geo.nx - 20).map(F.col("value") * 2), f"{folder}/b.tif")
    return out(rasters.mosaic_folder(spark, f"{folder}/*.tif"), v=whole("value"))


@query(f"WITH {G} SELECT event_id, CAST(e.value * 10 > 300 AND e.value * 10 < 1200 AND event_id % 2000 > 90 AND event_id % 2000 < 1500 AS BOOLEAN) AS inside FROM events e WHERE value IS NOT NULL AND event_id < 500")
def shapefile_points(spark, d):
    """A polygon written as a shapefile and read again: events by whether its ring holds them."""
    path = local_folder(spark, "shapes") + "/box.shp"
    vector.write_shapefile([[[(90.0, 300.0), (90.0, 1200.0), (1500.0, 1200.0), (1500.0, 300.0), (90.0, 300.0)]]], path)
    box = vector.read_shapefile(spark, path).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    points = table(spark, d, "events").where("value is not null and event_id < 500").select("event_id", (F.col("event_id") % 2000).alias("x"), (F.col("value") * 10).alias("y"))
    return points.join(F.broadcast(box)).select("event_id", ((F.col("x") > F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") > F.col("y0")) & (F.col("y") < F.col("y1"))).alias("inside"))


@query(f"WITH {G} SELECT r AS \"row\", c AS col, CAST(CASE WHEN c * 30 > 90 AND c * 30 < 1500 AND (ny - 1 - r) * 30 > 300 AND (ny - 1 - r) * 30 < 1200 THEN z END AS BIGINT) AS v FROM g, sz")
def shapefile_clip(spark, d):
    path = local_folder(spark, "clips") + "/box.shp"
    vector.write_shapefile([[[(91.0, 301.0), (91.0, 1199.0), (1499.0, 1199.0), (1499.0, 301.0), (91.0, 301.0)]]], path)
    return out(tiling.clip_to_polygons(surface(spark, d), vector.read_shapefile(spark, path)), v=whole("value"))


@query("SELECT n_nationkey AS nation, CAST(n_nationkey * 6 - 177 AS BIGINT) AS meridian, CASE WHEN n_nationkey % 2 = 0 THEN 0 ELSE 10000000 END AS northing FROM nation")
def projection_lookup(spark, d):
    rows = [(r.n_nationkey, rasters.projection_of((32601 if r.n_nationkey % 2 == 0 else 32701) + r.n_nationkey)) for r in table(spark, d, "nation").select("n_nationkey").collect()]
    texts = spark.createDataFrame(rows, "nation int, wkt string")
    number = lambda name: F.regexp_extract("wkt", name + r'",(-?\d+)', 1)
    return texts.select("nation", number("central_meridian").cast("long").alias("meridian"), number("false_northing").cast("int").alias("northing"))


@query("SELECT * FROM (VALUES ('uint8', 'smallint'), ('uint16', 'int'), ('int16', 'smallint'), ('uint32', 'bigint'), ('int32', 'int'), ('float32', 'float'), ('float64', 'double'), ('complex64', 'struct<re:float,im:float>')) t(name, type)")
def type_map(spark, d):
    """The column that each raster type takes."""
    rows = [(name, spark.createDataFrame([], f"v {kind}").schema[0].dataType.simpleString()) for name, kind in rasters.TYPES.items()]
    return spark.createDataFrame(rows, "name string, type string")


@query(f"WITH {G} SELECT nx AS nx, ny AS ny, CAST(30000 AS BIGINT) AS dx, CAST(-15000 AS BIGINT) AS left_edge, CAST((ny - 0.5) * 30000 AS BIGINT) AS top_edge FROM sz")
def dataset_info(spark, d):
    row = surface(spark, d).geo.to_row(spark)
    milli = lambda c: F.round(c * 1000).cast("long")
    return row.select(F.col("nx").cast("long").alias("nx"), F.col("ny").cast("long").alias("ny"), milli(F.col("dx")).alias("dx"), milli(F.col("geo_transform")[0]).alias("left_edge"), milli(F.col("geo_transform")[3]).alias("top_edge"))


@query(f"{ORACLE['filled_elevation'].replace('CAST(level AS BIGINT) AS v', 'CAST(z AS BIGINT) AS z, CAST(level AS BIGINT) AS filled')}")
def pipeline_grids(spark, d):
    """What the batch pipeline keeps: the elevation and its filled form, read from its files."""
    prefix = local_folder(spark, "batch")
    pipelines.process_all(surface(spark, d), prefix, AO, THETA)
    z, filled = rasters.load(spark, f"{prefix}/elevation"), rasters.load(spark, f"{prefix}/filled")
    return z.join(filled, "filled").cells.select("row", "col", whole("value").alias("z"), F.round("filled").cast("long").alias("filled"))


# -- construction, georeferences, points ----------------------------------------------------------


@query(f"WITH slope AS ({ORACLE['max_slope']}), curve AS ({ORACLE['laplacian']}), light AS ({ORACLE['hillshade']}) SELECT 'slope' AS kind, * FROM slope UNION ALL SELECT 'curve', * FROM curve UNION ALL SELECT 'light', * FROM light")
def built_kinds(spark, d):
    """Grids by the names of their kinds and keyword inputs."""
    z = surface(spark, d)
    made = {"slope": build("MaxSlope", spark, elevation=z), "curve": build("Laplacian", spark, elevation=z), "light": build("Hillshade", spark, elevation=z, azimuth=315.0, inclination=45.0)}
    parts = [micros(g).select(F.lit(kind).alias("kind"), "row", "col", "v") for kind, g in made.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_PIXEL = "6371000.0 * 6371000.0 * radians(0.01) * abs(sin(radians((ny - 1 - r) * 0.01 + 0.005)) - sin(radians((ny - 1 - r) * 0.01 - 0.005)))"


@query(
    f"WITH RECURSIVE {D8}{WALK}, px AS MATERIALIZED (SELECT r * nx + c AS id, r, c, {_PIXEL} AS p FROM g, sz), pu AS (SELECT px.id, px.r, px.c, p + coalesce(k, 0) AS a FROM px LEFT JOIN (SELECT b, sum(p) AS k FROM walk JOIN px ON px.id = walk.a GROUP BY b) w ON w.b = px.id) "
    'SELECT pu.r AS "row", pu.c AS col, CAST(round(pu.a + coalesce(x.a, 0)) AS BIGINT) AS area FROM pu LEFT JOIN (SELECT dst, sum(a) AS a FROM ed JOIN pu ON pu.id = ed.src WHERE NOT fwd GROUP BY dst) x ON x.dst = pu.id'
)
def geographic_area(spark, d):
    """Drainage area on a grid in degrees: each row has its pixel area."""
    z = surface(spark, d, dx=0.01, geographic=True)
    return out(build("GeographicArea", spark, flow_direction=Grid(checkpointed(flow.flow_direction(z).cells), z.geo), order=z), area=F.round("value").cast("long"))


@query(f"WITH {G} SELECT 'x' AS axis, c AS \"index\", CAST(round((10 + c * 0.5) * 1000) AS BIGINT) AS coordinate FROM g WHERE r = 0 UNION ALL SELECT 'y', r, CAST(round((-20 + (ny - 1 - r) * 0.5) * 1000) AS BIGINT) FROM g, sz WHERE c = 0")
def lat_long_axes(spark, d):
    g = surface(spark, d, dx=0.5, xll=10.0, yll=-20.0, geographic=True)
    return g.geo.axes(spark).select("axis", "index", F.round(F.col("coordinate") * 1000).cast("long").alias("coordinate"))


@query("SELECT n_nationkey AS nation, CAST(CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE -1 END * (floor((n_nationkey * 14 - 170 + 180) / 6) % 60 + 1) AS INTEGER) AS zone, CAST(55000 AS INTEGER) AS metres FROM nation")
def utm_zones(spark, d):
    """Zones of small grids around the world, and the rough size of their pixels."""
    rows = []
    for r in table(spark, d, "nation").select("n_nationkey").collect():
        geo = Georef(1, 1, 0.5, r.n_nationkey * 14 - 170.0, 10.0 if r.n_nationkey % 2 == 0 else -10.0, geographic=True)
        rows.append((r.n_nationkey, geo.utm_zone(), geo.approximate_dx()))
    return spark.createDataFrame(rows, "nation int, zone int, metres int")


@query("SELECT n_nationkey AS nation, CAST(round((9 + (n_nationkey % 5 - 2) * 1.3) * 1000000) AS BIGINT) AS lon, CAST(round((n_nationkey * 3 - 30.5) * 1000000) AS BIGINT) AS lat FROM nation")
def utm_there_and_back(spark, d):
    """Points to the plane of their zone by the scalar series, and back by the columns' series."""
    parts = None
    for r in table(spark, d, "nation").select("n_nationkey").collect():
        zone = 32 if r.n_nationkey * 3 - 30.5 >= 0 else -32
        east, north = projection.to_utm(9 + (r.n_nationkey % 5 - 2) * 1.3, r.n_nationkey * 3 - 30.5, zone)
        lon, lat = projection._Utm(1, 1, 1.0, east, north, "", False, zone)._lonlat()
        part = spark.range(1).select(F.lit(0).cast("long").alias("row"), F.lit(0).cast("long").alias("col")).select(F.lit(r.n_nationkey).alias("nation"), micro(lon).alias("lon"), micro(lat).alias("lat"))
        parts = part if parts is None else parts.unionByName(part)
    return parts


@query(f"WITH {G} SELECT r AS \"row\", c AS col, CAST(CASE WHEN r % 50 = 25 AND c = 32 THEN -1 ELSE z END AS BIGINT) AS v, CAST(0 AS BIGINT) AS zero FROM g")
def cell_updates(spark, d):
    """Cells set to a constant by points, beside a grid of zeros of the same shape; a point outside does nothing."""
    z = surface(spark, d)
    points = outlets(z).unionByName(spark.createDataFrame([(-1, -1, 5), (-2, 10**6, 3)], "point long, row long, col long"))
    return z.put(points, constant=-1.0).join(z.zero_like(), "zero").cells.select("row", "col", whole("value").alias("v"), whole("zero").alias("zero"))


@query(f"WITH {G}, p AS (SELECT event_id, CAST(ny - 1 - round_even(CAST(value AS DOUBLE) * 10 / 30, 0) AS BIGINT) AS r, CAST(round_even((event_id % 2000) / 30.0, 0) AS BIGINT) AS c FROM events, sz WHERE value IS NOT NULL) SELECT event_id FROM p JOIN g USING (r, c) WHERE z > 1000")
def locations_in_data(spark, d):
    g = surface(spark, d).map(F.when(F.col("value") > 1000, F.col("value")))
    points = table(spark, d, "events").where("value is not null").select("event_id", (F.col("event_id") % 2000).cast("double").alias("x"), (F.col("value") * 10).alias("y"))
    return g.locations_in(points).select("event_id")


# -- clips, windows, aggregates -------------------------------------------------------------------


@query(f"WITH {NB} SELECT r AS \"row\", c AS col, {q('(z + e + s + se) / 4')} AS v FROM nb, sz WHERE r < ny - 1 AND c < nx - 1")
def clip_to_mask(spark, d):
    """Values at the cells of a mask that lies half a cell off."""
    z = surface(spark, d)
    mask = Grid.zeros(spark, Georef(z.geo.nx - 1, z.geo.ny - 1, 30.0, 15.0, 15.0))
    return micros(tiling.clip_to_mask(z, mask))


@query(f"WITH {G}, p AS (SELECT r, c, z, c * 30.0 AS x, (ny - 1 - r) * 30.0 AS y FROM g, sz) SELECT r AS \"row\", c AS col, CAST(CASE WHEN count(x0) % 2 = 1 THEN z END AS BIGINT) AS v FROM p LEFT JOIN {_RING} ON least(y0, y1) <= y AND y < greatest(y0, y1) AND x0 + (y - y0) * CAST(x1 - x0 AS DOUBLE) / (y1 - y0) > x GROUP BY r, c, z")
def clip_to_polygons(spark, d):
    ring = spark.createDataFrame([(1, "POLYGON ((100 400, 1500 700, 1200 9000, 200 8000, 100 400), (400 2000, 800 2000, 800 4000, 400 4000, 400 2000))")], "shape long, wkt string")
    return out(tiling.clip_to_polygons(surface(spark, d), vector.from_wkt(ring)), v=whole("value"))


@query(f"WITH {G} SELECT r - 7 AS \"row\", c - 3 AS col, CAST(z AS BIGINT) AS v FROM g, sz WHERE r BETWEEN 7 AND ny - 8 AND c BETWEEN 3 AND nx - 4")
def padding_removed(spark, d):
    return out(tiling.remove_padding(surface(spark, d), 3, 7), v=whole("value"))


@query(f"WITH {NB}, gr AS (SELECT r, c, {_grad('w', 'e')} AS gx, {_grad('n', 's')} AS gy FROM nb), {_kernel('i * i + j * j <= 4', '-2, 3')} SELECT (r - i + ny) % ny AS \"row\", (c - j + nx) % nx AS col, {q('avg(gx)')} AS gx, {q('avg(gy)')} AS gy FROM gr, sz, o GROUP BY 1, 2")
def average_gradient(spark, d):
    return micros(windows.disc_mean(stencil.gradient(surface(spark, d)), 60.0, ["gx", "gy"]), "gx", "gy")


@query(
    f"WITH {G}, t(a, i, j) AS (SELECT a, CASE a WHEN 0 THEN 0 WHEN 1 THEN k WHEN 2 THEN k WHEN 3 THEN k END, CASE a WHEN 0 THEN k WHEN 1 THEN k WHEN 2 THEN 0 WHEN 3 THEN -k END FROM range(4) x(a), range(-1, 2) y(k)), n AS (SELECT a, (r - i + ny) % ny AS r, (c - j + nx) % nx AS c, sum({_BAND}) AS n FROM g, sz, t GROUP BY 1, 2, 3) "
    'SELECT n.r AS "row", n.c AS col, CAST(min(CASE WHEN ok THEN a * 45 END) AS BIGINT) AS least, CAST(max(CASE WHEN ok THEN a * 45 END) AS BIGINT) AS largest FROM (SELECT n.*, n.n <> 3 AND n.r BETWEEN 1 AND ny - 2 AND n.c BETWEEN 1 AND nx - 2 AS ok FROM n, sz WHERE a BETWEEN 1 AND 2) n GROUP BY 1, 2'
)
def valid_orientations(spark, d):
    """Templates of three cells in four directions; the first and last of these are left out."""
    mask, parts = band_mask(surface(spark, d)), None
    for a, (i, j) in enumerate(((0, 1), (1, 1), (1, 0), (1, -1))):
        template = spark.createDataFrame([(i * k, j * k, 1.0) for k in (-1, 0, 1)], "di int, dj int, weight double")
        part = windows.template_count(mask, template).cells.select("row", "col", F.lit(a * 45).cast("long").alias("orientation"), "value")
        parts = part if parts is None else parts.unionByName(part)
    return windows.valid_orientations(parts, 1, mask.geo)


@query(f"WITH {G} SELECT CAST(r // 10 * 10 AS BIGINT) AS qrow, CAST(c // 8 * 8 AS BIGINT) AS qcol, (r // 10 * 10 + 5) * 1.0::DOUBLE AS center_row, (c // 8 * 8 + 4) * 1.0::DOUBLE AS center_col, CAST(max(z) - min(z) AS BIGINT) AS span FROM g, sz WHERE r // 10 * 10 <= ny - 10 AND c // 8 * 8 <= nx - 8 GROUP BY 1, 2, 3, 4")
def quadrat_centres(spark, d):
    """A Python function of each quadrat, with the centre that a map of quadrats is drawn at."""
    return windows.map_quadrats(surface(spark, d), 8, 10, span=F.max("value") - F.min("value")).select("qrow", "qcol", "center_row", "center_col", whole("span").alias("span"))


# -- flow -----------------------------------------------------------------------------------------


@query(f"WITH RECURSIVE {D8}{LENGTH} SELECT ed.r AS \"row\", ed.c AS col, r2 AS to_row, c2 AS to_col FROM ed JOIN fl ON fl.id = ed.dst AND fl.donor = ed.src")
def along_flow_length(spark, d):
    _, fd, length = with_length(spark, d)
    return accumulate.is_along_flow_length(length, flow.edges(fd).select("row", "col", "to_row", "to_col"))


@query(f"WITH RECURSIVE {D8}{LENGTH} SELECT g.r AS \"row\", g.c AS col, CAST(coalesce(CASE ed.code WHEN 1 THEN 16 WHEN 2 THEN 8 WHEN 4 THEN 4 WHEN 8 THEN 2 WHEN 16 THEN 1 WHEN 32 THEN 128 WHEN 64 THEN 64 WHEN 128 THEN 32 END, 0) AS BIGINT) AS code FROM g CROSS JOIN sz JOIN fl ON fl.id = g.r * nx + g.c LEFT JOIN ed ON ed.src = fl.donor AND ed.dst = fl.id")
def longest_path_code(spark, d):
    """The step to the donor, counted from the east against the clock."""
    return out(accumulate.longest_path_code(with_length(spark, d)[2]), code=whole("value"))


@query(
    f"WITH RECURSIVE {D8}{LENGTH}{OUTLETS}, tr AS (SELECT point, id AS cell, CAST(NULL AS BIGINT) AS parent, CAST(0 AS BIGINT) AS depth, [id] AS seen FROM ol UNION ALL SELECT tr.point, fl.donor, fl.id, tr.depth + 1, list_append(seen, fl.donor) FROM tr JOIN fl ON fl.id = tr.cell WHERE fl.donor IS NOT NULL AND NOT list_contains(seen, fl.donor)) "
    f"SELECT point, cell, parent, depth, CAST(g.z AS BIGINT) AS elevation, {q('fl.l')} AS distance FROM tr CROSS JOIN sz JOIN g ON g.r * nx + g.c = tr.cell JOIN fl ON fl.id = tr.cell"
)
def longest_path_tree(spark, d):
    """The tree of recorded donors above each outlet, with elevations and flow lengths."""
    z, fd, length = with_length(spark, d)
    tree = flow.longest_path_tree(fd, outlets(z), length, {"elevation": z})
    return tree.select("point", "cell", "parent", "depth", whole("elevation").alias("elevation"), micro("distance").alias("distance"))


_SIDES = ", sd AS (SELECT CASE WHEN c = 31 THEN 0 ELSE 1 END AS side, r * nx + c AS id FROM g, sz WHERE r % 10 = 5 AND c IN (31, 33)), us AS (SELECT side, id AS cell FROM sd UNION SELECT us.side, ed.src FROM us JOIN ed ON ed.dst = us.cell), mk AS (SELECT DISTINCT side, cell // nx AS r, cell % nx AS c FROM us, sz), bd AS (SELECT DISTINCT CAST(x.side AS INTEGER) AS side, x.r, x.c FROM mk x CROSS JOIN (VALUES (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)) AS o(i, j) JOIN mk y ON y.side = 1 - x.side AND y.r = x.r + i AND y.c = x.c + j)"


def _sides(z: Grid) -> list[DataFrame]:
    """Outlets on either side of a column, whose basins meet."""
    rows = z.spark.range(z.geo.ny).where("id % 10 = 5")
    return [checkpointed(rows.select(F.col("id").alias("point"), F.col("id").alias("row"), F.lit(c).cast("long").alias("col"))) for c in (31, 33)]


@query(f"WITH RECURSIVE {D8}{_SIDES} SELECT side, r AS \"row\", c AS col FROM bd")
def shared_divide(spark, d):
    z, fd = drained(spark, d)
    return flow.boundary_between(fd, *_sides(z))


@query(f"WITH RECURSIVE {D8}{AREA}{_SIDES}, cr AS MATERIALIZED (SELECT ed.src AS id, ed.dst FROM ed JOIN ar x ON x.id = ed.src JOIN ar y ON y.id = ed.dst WHERE x.a < 5000 AND y.a >= 5000), wk AS (SELECT side, r * nx + c AS id FROM bd, sz UNION SELECT wk.side, ed.dst FROM wk JOIN ed ON ed.src = wk.id WHERE wk.id NOT IN (SELECT id FROM cr)) SELECT DISTINCT side, CAST(cr.dst % nx * 30 AS DOUBLE) AS x, CAST((ny - 1 - cr.dst // nx) * 30 AS DOUBLE) AS y FROM wk JOIN cr USING (id), sz")
def hollows_of_a_divide(spark, d):
    z, fd, a = with_area(spark, d)
    return flow.paired_hollows(fd, a, *_sides(z), 5000.0)


@query(f"WITH RECURSIVE {D8}{OUTLETS}, tr AS (SELECT point, id AS cell, CAST(0 AS BIGINT) AS depth FROM ol UNION ALL SELECT tr.point, ed.src, tr.depth + 1 FROM tr JOIN ed ON ed.dst = tr.cell JOIN ol ON ol.point = tr.point AND ol.id <> ed.src) SELECT point, cell, depth, CAST(g.z AS BIGINT) AS elevation FROM tr CROSS JOIN sz JOIN g ON g.r * nx + g.c = tr.cell")
def profile_items(spark, d):
    """Values of a tree by outlet and depth."""
    z, fd = drained(spark, d)
    got = profile.profile_values(flow.upstream_tree(fd, outlets(z), {"elevation": z}), ["elevation"])
    return got.select("point", "cell", "depth", whole("elevation").alias("elevation"))


@query(f"WITH RECURSIVE {D8}{OUTLETS}, cx AS (SELECT ol.point, ol.id AS cell, CAST(0 AS DOUBLE) AS l, g.z AS z0 FROM ol CROSS JOIN sz JOIN g ON g.r * nx + g.c = ol.id UNION ALL SELECT cx.point, ed.src, cx.l - 30 * CASE WHEN code IN (2, 8, 32, 128) THEN 1.414 ELSE 1 END, cx.z0 FROM cx JOIN ed ON ed.dst = cx.cell JOIN ol ON ol.id <> ed.src AND ol.point = cx.point) SELECT point, cell // nx AS \"row\", cell % nx AS col, {q('l')} AS length, CAST(g.z - z0 AS BIGINT) AS elevation FROM cx CROSS JOIN sz JOIN g ON g.r * nx + g.c = cell")
def upstream_profile(spark, d):
    z, fd, a = with_area(spark, d)
    return profile.upstream_profile(z, fd, a, outlets(z), minimum_area=0.0).select("point", "row", "col", micro("chi").alias("length"), whole("elevation").alias("elevation"))


@query(ORACLE["downstream_path"].split(" SELECT point, seq, id // nx")[0] + ", pq AS (SELECT point, seq, id % nx * 30 AS x, (ny - 1 - id // nx) * 30 AS y FROM dp, sz WHERE point = 25 AND id // nx BETWEEN 1 AND ny - 2 AND id % nx BETWEEN 1 AND nx - 2) SELECT seq, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM pq ORDER BY (x - 900) * (x - 900) + (y - 13000) * (y - 13000), seq LIMIT 1")
def nearest_on_path(spark, d):
    z, fd = drained(spark, d)
    path = flow.downstream_paths(fd, outlets(z).where("point = 25"))
    return nearest_vertex(path.select("seq", z.geo.x().alias("x"), z.geo.y().alias("y")), 900.0, 13000.0)

"""The registered queries of the raster engine over the given tables.

The main raster has a row for each embedding and a column for each of its components, with
whole numbers as elevations (metres) on cells of 30 m. Results are whole numbers: millionths
where they are not whole by nature.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talusgrid.grid import Georef, Grid
from talusgrid.operators import accumulate, fill, flow, morphology, profile, search, spectral, stencil, tiling, windows
from talusgrid.operators.regions import regions
from talusgrid.plans import profile_sql
from talusgrid.plans.raster_sql import ORACLE
from talusgrid.runtime import checkpointed, partitions
from talusgrid.sources import outlets as outlet_tables
from talusgrid.sources import rasters, synthetic, vector

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
THETA, AO = 0.45, 100000.0


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def surface(spark: SparkSession, sf_dir: str, **georef) -> Grid:
    # lines are dealt out before they become cells: one small file would make them all in one task
    lines = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").repartition(partitions(spark), "vec_id")
    rows = lines.select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("col", "e"))
    size = table(spark, sf_dir, "embeddings").agg(F.max("vec_id").alias("r"), F.max(F.size("embedding")).alias("c")).first()
    cells = rows.select("row", F.col("col").cast("long").alias("col"), (F.floor(F.col("e").cast("double") * 1000) + 1000).cast("double").alias("value"))
    return Grid(cells, Georef(size.c, size.r + 1, **({"dx": 30.0} | georef)))


def counts(spark: SparkSession, sf_dir: str, geo: Georef) -> Grid:
    """Lines of orders by part and supplier, folded to 64 x 64 cells."""
    n = table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 64).alias("row"), (F.col("l_suppkey") % 64).alias("col")).agg(F.count("*").cast("double").alias("value"))
    return Grid(n, geo)


def micro(c: Column | str) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c) * 1e6).cast("long")


def whole(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def out(grid: Grid, **columns: Column) -> DataFrame:
    return grid.cells.select("row", "col", *[c.alias(n) for n, c in columns.items()])


def micros(grid: Grid, *bands: str) -> DataFrame:
    return out(grid, **{("v" if b == "value" else b): micro(b) for b in bands or ("value",)})


def outlets(grid: Grid) -> DataFrame:
    rows = grid.spark.range(grid.geo.ny).where("id % 50 = 25")
    return rows.select(F.col("id").alias("point"), F.col("id").alias("row"), F.lit(32).cast("long").alias("col"))


def drained(spark: SparkSession, sf_dir: str) -> tuple[Grid, Grid]:
    """The surface and its flow directions, computed once."""
    z = surface(spark, sf_dir)
    return z, Grid(checkpointed(flow.flow_direction(z).cells), z.geo)


def with_area(spark: SparkSession, sf_dir: str) -> tuple[Grid, Grid, Grid]:
    z, fd = drained(spark, sf_dir)
    return z, fd, Grid(checkpointed(accumulate.area(fd, z).cells), z.geo)


# -- scans, coordinates, points -------------------------------------------------------------


@query
def grid_scan(spark, d):
    return out(surface(spark, d), v=whole("value"))


@query
def xy_coords(spark, d):
    g = surface(spark, d)
    return g.located().select("row", "col", whole("x").alias("x"), whole("y").alias("y"))


@query
def xy_to_cell(spark, d):
    g = surface(spark, d)
    points = table(spark, d, "events").where("value is not null").select("event_id", (F.col("event_id") % 2000).cast("double").alias("x"), (F.col("value") * 10).alias("y"))
    return g.rowcols(points).where("row is not null").select("event_id", "row", "col")


@query
def geo_pixel_area(spark, d):
    g = surface(spark, d, dx=0.01, geographic=True)
    return spark.range(g.geo.ny).select(F.col("id").alias("row"), F.round(g.geo.area("id")).cast("long").alias("area"))


@query
def valid_data(spark, d):
    g = surface(spark, d)
    return out(stencil.valid_data(g.map(F.col("value") - 1000)), v=F.col("value").cast("int"))


@query
def areas_greater_than(spark, d):
    _, _, a = with_area(spark, d)
    return a.cells.join(accumulate.areas_greater_than(a, 9000).select("row", "col"), ["row", "col"]).select("row", "col", whole("value").alias("area"))


@query
def areas_between(spark, d):
    _, fd, a = with_area(spark, d)
    return accumulate.areas_between(a, fd, 9000, 90000).select("row", "col")


@query
def log_area(spark, d):
    return micros(stencil.log_area(surface(spark, d)))


@query
def two_grid_extract(spark, d):
    g = surface(spark, d)
    return windows.pair_values(g, counts(spark, d, g.geo), ignore_zeros=True).select("row", "col", whole("x").alias("x"), whole("y").alias("y"))


@query
def scatter_pairs(spark, d):
    g = surface(spark, d)
    return windows.scatter(g, counts(spark, d, g.geo), every=3).select("row", "col", whole("x").alias("x"), whole("y").alias("y"))


@query
def dem_edge(spark, d):
    """Events by day and hour: hours without events are gaps in the data."""
    n = table(spark, d, "events").groupBy(F.datediff(F.to_date("ts"), F.lit("2000-01-01")).alias("day"), F.hour("ts").cast("long").alias("col")).count()
    span = n.agg(F.min("day").alias("a"), F.max("day").alias("b")).first()
    cells = n.select((F.col("day") - span.a).cast("long").alias("row"), "col", F.col("count").cast("double").alias("value"))
    return out(stencil.edge_of_data(Grid(cells, Georef(24, span.b - span.a + 1))), v=F.col("value").cast("int"))


# -- aggregates -------------------------------------------------------------------------------


@query
def quadrat_stats(spark, d):
    got = windows.map_quadrats(surface(spark, d), 8, 10, total=F.sum("value"), least=F.min("value"), n=F.count("*"))
    return got.select("qrow", "qcol", whole("total").alias("total"), whole("least").alias("least"), "n")


@query
def hist2d(spark, d):
    return windows.histogram_2d(table(spark, d, "lineitem"), [1, 10, 25, 50], [0, 0.03, 0.06, 0.1], "l_quantity", "l_discount")


@query
def data_extent(spark, d):
    g = surface(spark, d)
    box = windows.data_extent(g.map(F.when(F.col("value") > 1200, F.col("value"))))
    return box.select("row0", "row1", "col0", "col1", *[whole(c).alias(c) for c in ("xmin", "xmax", "ymin", "ymax")])


@query
def hypsometric_integral(spark, d):
    z, fd = drained(spark, d)
    return profile.hypsometry_of_outlets(z, fd, outlets(z)).select("point", micro("hi").alias("hi"))


@query
def sum_of_squares(spark, d):
    return windows.sum_of_squares(surface(spark, d).cells, "value", "row").select("row", micro("ss").alias("ss"))


@query
def plane_fit(spark, d):
    return stencil.plane_fit(surface(spark, d)).select(micro("a").alias("a"), micro("b").alias("b"))


@query
def disc_mean(spark, d):
    return micros(windows.disc_mean(surface(spark, d), 90.0))


@query
def moving_circle_max(spark, d):
    return out(windows.moving_window(surface(spark, d), windows.disc(90.0, 30.0), "max"), v=whole("value"))


@query
def moving_rectangle_mean(spark, d):
    return micros(windows.rectangular_mean(surface(spark, d), 60.0))


@query
def moving_median(spark, d):
    """Any Python function of the values under a window."""
    return micros(windows.moving_window(surface(spark, d), windows.rectangle(30.0, 30.0), lambda v: v.median()))


@query
def local_relief(spark, d):
    return out(windows.local_relief(surface(spark, d), 3), v=whole("value"))


def band_mask(g: Grid) -> Grid:
    return g.map(F.col("value").between(950, 1050).cast("double"))


@query
def template_count(spark, d):
    template = spark.createDataFrame([(i, j, 1.0) for i in range(-2, 3) for j in range(-1, 2)], "di int, dj int, weight double")
    return out(windows.template_count(band_mask(surface(spark, d)), template), v=whole("value"))


# -- derivatives ----------------------------------------------------------------------------


@query
def slopes(spark, d):
    return micros(stencil.slopes(surface(spark, d)), "sx", "sy")


@query
def max_slope(spark, d):
    return micros(stencil.max_slope(surface(spark, d)))


@query
def hillshade(spark, d):
    return micros(stencil.hillshade(surface(spark, d), 315.0, 45.0))


@query
def laplacian(spark, d):
    return micros(stencil.laplacian(surface(spark, d)))


@query
def contour_curvature(spark, d):
    return micros(stencil.contour_curvature(surface(spark, d)))


@query
def principal_curvature(spark, d):
    return micros(stencil.principal_curvatures(surface(spark, d)), "k1", "k2")


@query
def gradient(spark, d):
    return micros(stencil.gradient(surface(spark, d)), "gx", "gy")


@query
def gradient_direction(spark, d):
    return micros(stencil.gradient_magnitude_direction(stencil.gradient(surface(spark, d))), "magnitude")


@query
def gradient_scale(spark, d):
    return micros(stencil.gradient_over(surface(spark, d), 80.0), "gx", "gy")


@query
def laplacian_scale(spark, d):
    return micros(stencil.laplacian_over(surface(spark, d), 80.0))


# -- flow -------------------------------------------------------------------------------------


@query
def flow_direction_d8(spark, d):
    return out(flow.flow_direction(surface(spark, d)), code=whole("value"))


@query
def flow_code_downhill(spark, d):
    return out(flow.flow_code_downhill(surface(spark, d)), code=F.col("value").cast("int"))


@query
def rivertools_recode(spark, d):
    return out(flow.rivertools_to_arc(flow.flow_direction(surface(spark, d))), code=whole("value"))


@query
def flow_edges(spark, d):
    z, fd = drained(spark, d)
    return flow.split_edges(fd, z).select("src", "dst", micro("scale").alias("scale"), "forward")


@query
def flow_donors(spark, d):
    _, fd = drained(spark, d)
    got = flow.donors(fd)
    return got.select("dst", F.size("donors").cast("long").alias("n"), F.aggregate("donors", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query
def divides(spark, d):
    _, fd = drained(spark, d)
    return out(flow.divides(fd), v=F.col("value").cast("int"))


@query
def channel_slope(spark, d):
    z, fd = drained(spark, d)
    return micros(flow.channel_slope(fd, z))


@query
def upstream_cells(spark, d):
    z, fd = drained(spark, d)
    return flow.upstream(fd, outlets(z)).select("point", z.geo.cell_id().alias("cell"))


@query
def upstream_mask(spark, d):
    z, fd = drained(spark, d)
    return out(flow.upstream_mask(fd, outlets(z)), v=F.col("value").cast("int"))


@query
def basin_bounds(spark, d):
    z, fd = drained(spark, d)
    return flow.basin_bounds(fd, outlets(z)).select("point", *[whole(c).alias(c) for c in ("xmin", "xmax", "ymin", "ymax")])


@query
def downstream_path(spark, d):
    z, fd = drained(spark, d)
    return flow.downstream_paths(fd, outlets(z)).select("point", "seq", "row", "col", micro("distance").alias("distance"))


@query
def downstream_profile(spark, d):
    z, fd = drained(spark, d)
    return profile.downstream_profile(z, fd, outlets(z)).select("point", "seq", micro("length").alias("length"), whole("elevation").alias("elevation"))


@query
def mask_flood(spark, d):
    z = surface(spark, d)
    return out(flow.flood_mask(z.map((F.col("value") >= 1000).cast("double")), outlets(z)), v=F.col("value").cast("int"))


@query
def paired_divides(spark, d):
    _, fd = drained(spark, d)
    return flow.paired_divides(fd)


@query
def basin_boundary(spark, d):
    z, fd = drained(spark, d)
    both = checkpointed(outlets(z))
    return flow.boundary_between(fd, both.where("point % 100 = 25"), both.where("point % 100 = 75"))


@query
def paired_hollows(spark, d):
    z, fd, a = with_area(spark, d)
    both = checkpointed(outlets(z))
    return flow.paired_hollows(fd, a, both.where("point % 100 = 25"), both.where("point % 100 = 75"), 5000.0)


@query
def upstream_tree(spark, d):
    z, fd = drained(spark, d)
    tree = flow.upstream_tree(fd, outlets(z), {"elevation": z})
    return tree.withColumns({"distance_scale": micro("distance_scale"), "step_scale": micro("step_scale"), "elevation": whole("elevation")})


# -- accumulation -----------------------------------------------------------------------------


@query
def drainage_area(spark, d):
    _, _, a = with_area(spark, d)
    return out(a, area=whole("value"))


@query
def flow_length(spark, d):
    z, fd = drained(spark, d)
    return out(accumulate.flow_length(fd, z), length=micro("value"), donor=F.col("donor"))


def with_length(spark, d):
    z, fd = drained(spark, d)
    return z, fd, Grid(checkpointed(accumulate.flow_length(fd, z).cells), z.geo)


def with_length_and_area(spark, d):
    z, fd, length = with_length(spark, d)
    return z, fd, Grid(checkpointed(accumulate.area(fd, z).cells), z.geo), length


@query
def relief(spark, d):
    z, fd, length = with_length(spark, d)
    return out(accumulate.relief(fd, z, length, z), v=whole("value"))


@query
def scaled_relief(spark, d):
    z, fd, a, length = with_length_and_area(spark, d)
    return micros(accumulate.scaled_relief(fd, z, length, z, 2000.0, THETA, a))


@query
def ksi(spark, d):
    z, fd, a, length = with_length_and_area(spark, d)
    return micros(accumulate.ksi(a, fd, THETA, 2000.0, length, z))


@query
def longest_path(spark, d):
    z, _, length = with_length(spark, d)
    return accumulate.path_from_outlet(length, outlets(z)).select("point", "seq", "row", "col")


@query
def points_with_length(spark, d):
    _, fd, length = with_length(spark, d)
    return accumulate.points_with_length(length, fd, 100.0)


@query
def chi(spark, d):
    z, fd, a = with_area(spark, d)
    return out(accumulate.chi(a, fd, THETA, AO, outlets(z)), chi=micro("value"))


@query
def chi_scaled_relief(spark, d):
    z, fd = drained(spark, d)
    return micros(accumulate.chi_scaled_relief(z, fd, THETA, AO, outlets(z)))


@query
def cross_divide_dchi(spark, d):
    z, fd, a = with_area(spark, d)
    return micros(accumulate.cross_divide_dchi(Grid(checkpointed(accumulate.chi(a, fd, THETA, AO, outlets(z)).cells), z.geo), fd))


@query
def norm_dchi(spark, d):
    z, fd, a = with_area(spark, d)
    return micros(accumulate.cross_divide_dchi(Grid(checkpointed(accumulate.chi(a, fd, THETA, AO, outlets(z)).cells), z.geo), fd, True))


@query
def valley_area(spark, d):
    z, fd, a = with_area(spark, d)
    return out(accumulate.valley_area(fd, z, a, stencil.laplacian(z), 0.02, 5000.0, 1), area=whole("value"))


@query
def mainstem_valley_area(spark, d):
    z, fd, a, length = with_length_and_area(spark, d)
    return out(accumulate.mainstem_valley_area(fd, z, a, stencil.laplacian(z), 0.02, 5000.0, length), area=whole("value"))


@query
def filled_elevation(spark, d):
    return out(fill.fill(surface(spark, d)), v=whole("value"))


@query
def flood_in_order(spark, d):
    return micros(fill.fill_in_order(surface(spark, d), maximum_pit_depth=50.0, epsilon=0.0))


@query
def discrete_flow(spark, d):
    z = surface(spark, d)
    return out(fill.discrete_flow(z, outlets(z)), area=whole("value"))


@query
def downhill_walk(spark, d):
    z = surface(spark, d)
    return fill.downhill_path(z, outlets(z))


# -- profiles ---------------------------------------------------------------------------------


@query
def ks_regression(spark, d):
    z, fd, a = with_area(spark, d)
    tree = profile.chi_map(z, fd, a, outlets(z), minimum_area=0.0, theta=THETA, Ao=AO)
    return profile.ks_fit(tree).select("point", micro("ks").alias("ks"))


@query
def ks_smoothed(spark, d):
    z, fd, a = with_area(spark, d)
    return micros(profile.ks_with_smoothing(z, a, fd, THETA, vertical_interval=100.0), "value", "mse", "r2", "pval")


@query
def theta_smoothed(spark, d):
    z, fd, a = with_area(spark, d)
    return micros(profile.theta_with_smoothing(z, a, fd, 5000.0, horizontal_interval=150.0), "value", "r2")


@query
def channel_slope_smoothed(spark, d):
    z, fd, a = with_area(spark, d)
    return micros(profile.slope_with_smoothing(z, a, fd, vertical_interval=100.0, min_area=1000.0))


@query
def theta_fit(spark, d):
    z, fd, a = with_area(spark, d)
    return profile.ks_theta_fit(z, fd, a, outlets(z), xo=0.0)


@query
def mainstem_profile(spark, d):
    z, fd, a = with_area(spark, d)
    rows = profile.profile_chi(profile.mainstem_and_tributaries(z, fd, a, outlets(z), 900.0), THETA)
    return rows.select("point", "profile", "mainstem", "seq", "cell", whole("area").alias("area"), whole("elevation").alias("elevation"), micro("de").alias("de"), micro("chi").alias("chi"))


@query
def restored_elevation(spark, d):
    z, fd, a = with_area(spark, d)
    return micros(profile.restored_elevation(fd, z, a, THETA, 50.0, outlets(z), 2)[0])


# -- order, tiles, sets -----------------------------------------------------------------------


@query
def sort_rank(spark, d):
    return search.sorted_cells(surface(spark, d)).select("row", "col", "rank")


@query
def nearest_value(spark, d):
    z = surface(spark, d)
    return search.nearest_value(z, outlets(z), 1100.0, 5).select("point", "row", "col")


@query
def nearest_at_least(spark, d):
    z = surface(spark, d)
    return search.nearest_at_least(z, outlets(z), 1100.0, 5).select("point", "row", "col")


@query
def snap_greatest(spark, d):
    z = surface(spark, d)
    points = outlets(z).select("point", z.geo.x().alias("x"), z.geo.y().alias("y"))
    return search.snap_to_greatest(z, points, 5).select("point", whole("x").alias("x"), whole("y").alias("y"))


@query
def tile_halo(spark, d):
    return tiling.tiles(surface(spark, d), 40, 100, 4, 5).select("tile_col", "tile_row", "row", "col", whole("value").alias("v"))


@query
def clip_extent(spark, d):
    z = surface(spark, d)
    return out(tiling.clip_to_extent(z, (300.0, 1530.0, 3000.0, 6030.0)), v=whole("value"))


@query
def mosaic_last_wins(spark, d):
    z = surface(spark, d)
    part = tiling.window(z, 20, 10, 20, 20)
    return out(tiling.mosaic([z, part.map(F.col("value") * 2)]), v=whole("value"))


@query
def resampled(spark, d):
    return micros(tiling.resample(surface(spark, d), 45.0, "cubic"))


@query
def dilate(spark, d):
    return out(morphology.dilate(band_mask(surface(spark, d)), iterations=2), v=F.col("value").cast("int"))


@query
def erode(spark, d):
    return out(morphology.erode(band_mask(surface(spark, d))), v=F.col("value").cast("int"))


@query
def opening(spark, d):
    return out(morphology.opened(band_mask(surface(spark, d))), v=F.col("value").cast("int"))


@query
def coastline_outlets(spark, d):
    return morphology.coastline_outlets(surface(spark, d).map(F.col("value") - 1000))


@query
def equal_regions(spark, d):
    return regions(band_mask(surface(spark, d))).select("row", "col", "region")


@query
def region_outlines(spark, d):
    return vector.outlines(band_mask(surface(spark, d)))[0].select("region", whole("value").alias("value"), "cells")


@query
def polygon_mask(spark, d):
    z = surface(spark, d)
    ring = spark.createDataFrame([(1, "POLYGON ((100 400, 1500 700, 1200 9000, 200 8000, 100 400), (400 2000, 800 2000, 800 4000, 400 4000, 400 2000))")], "shape long, wkt string")
    return out(vector.rasterize(vector.from_wkt(ring), z.geo), v=F.col("value").cast("int"))


@query
def outlet_upsert(spark, d):
    places = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = places.select(F.col("r_name").alias("prefix"), F.col("n_name").alias("name"), F.col("n_nationkey").cast("double").alias("x"), F.lit(0.0).alias("y"), "n_regionkey")
    new = rows.where("n_regionkey = 1").withColumn("x", F.col("x") + 100)
    return outlet_tables.upsert(rows, new).select("prefix", "name", whole("x").alias("x"))


# -- spectral and synthetic -------------------------------------------------------------------


@query
def quadratic_curvature(spark, d):
    return micros(spectral.minimum_curvature(surface(spark, d), 60.0))


@query
def valley_width(spark, d):
    z, _, a = with_area(spark, d)
    return micros(spectral.valley_width(z, a, 1000.0, 160.0, 30.0), "value", "min_c")


@query
def deflection(spark, d):
    # thousandths: the deflections are thousands of metres
    return out(spectral.deflection(surface(spark, d), 1e12, 3300.0, 2700.0, 9.81), v=F.round(F.col("value") * 1e3).cast("long"))


@query
def random_grid(spark, d):
    return Grid.random(spark, surface(spark, d).geo, 7).cells


@query
def sinusoid(spark, d):
    g = surface(spark, d).geo
    return micros(synthetic.sinusoid_grid(spark, g.ny, g.nx, 16.0, amp=5.0))


@query
def ascii_export(spark, d):
    return rasters.ascii_lines(surface(spark, d))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in (ORACLE | profile_sql.ORACLE).items() if k in QUERIES}

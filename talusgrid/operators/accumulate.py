"""What gathers along flow: drainage area, flow length, relief, chi and their kin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talusgrid.grid import Grid
from talusgrid.operators import doubling
from talusgrid.operators.flow import DIAGONAL_PATH, edges, flood_mask, outlet_ids, split_edges
from talusgrid.operators.morphology import closed
from talusgrid.runtime import checkpointed


def _cells(grid: Grid, name: str) -> DataFrame:
    return grid.cells.select(grid.geo.cell_id().alias("id"), F.col("value").alias(name))


def _grid(rows: DataFrame, geo, *bands: Column | str) -> Grid:
    return Grid(rows.select(geo.row_at(F.col("id")).alias("row"), geo.col_at(F.col("id")).alias("col"), *bands), geo)


def area(directions: Grid, order: Grid, evaluate_at: Grid | None = None) -> Grid:
    """Drainage area: cells hand theirs to the receiver once, from high to low ``order``.

    A link to a cell that was processed before adds to that cell but isn't handed on. With
    ``evaluate_at`` cells where it is 0 start empty and only those where it is 1 hand on.
    """
    geo = directions.geo
    cells = directions.cells.select(geo.cell_id().alias("id"), geo.area().alias("area"))
    links = split_edges(directions, order).select("src", "dst", "forward")
    if evaluate_at is not None:
        chosen = _cells(evaluate_at, "on")
        cells = cells.join(chosen, "id", "left").select("id", F.when(F.coalesce(F.col("on"), F.lit(0)) == 0, 0.0).otherwise(F.col("area")).alias("area"))
        links = links.join(chosen.where("on = 1").select(F.col("id").alias("src")), "src", "left_semi")
    links = checkpointed(links)
    pushed = checkpointed(doubling.subtree_sum(cells.join(links.where("forward").select(F.col("src").alias("id"), F.col("dst").alias("j")), "id", "left"), ["area"]))
    back = links.where("not forward").select(F.col("src").alias("id"), "dst").join(pushed, "id").groupBy(F.col("dst").alias("id")).agg(F.sum("area").alias("more"))
    return _grid(pushed.join(back, "id", "left"), geo, (F.col("area") + F.coalesce("more", F.lit(0.0))).alias("value"))


def flow_length(directions: Grid, order: Grid) -> Grid:
    """Longest upstream path (band value) and the cell it comes from (band donor, NULL at heads).

    Steps are pixel dimension times 1 or 1.41421356. Of equal lengths the donor that is
    processed first counts.
    """
    geo = directions.geo
    e = split_edges(directions, order).select("src", "dst", "forward", F.col("z_src").alias("z"), (geo.dimension() * F.col("scale")).alias("step"))
    e = checkpointed(e)
    nodes = directions.cells.select(geo.cell_id().alias("id")).join(e.where("forward").select(F.col("src").alias("id"), F.col("dst").alias("j"), "step"), "id", "left").withColumn("step", F.coalesce("step", F.lit(0.0)))
    reached = checkpointed(doubling.subtree_max(nodes))
    through = e.join(reached.withColumnRenamed("id", "src"), "src").withColumn("l", F.col("m") + F.col("step"))
    best = through.groupBy(F.col("dst").alias("id")).agg(F.max("l").alias("value"), F.max_by("src", F.struct(F.round("l", 6), F.col("z"), -F.col("src"))).alias("donor"))
    rows = reached.select("id").join(best, "id", "left")
    return _grid(rows, geo, F.coalesce("value", F.lit(0.0)).alias("value"), "donor")


def longest_path_code(length: Grid) -> Grid:
    """The step to the donor as a code: 1 E, 2 NE, 4 N, 8 NW, 16 W, 32 SW, 64 S, 128 SE; 0 at heads."""
    geo = length.geo
    di, dj = geo.row_at(F.col("donor")) - F.col("row"), geo.col_at(F.col("donor")) - F.col("col")
    code = F.lit(0)
    for c, i, j in ((1, 0, 1), (2, -1, 1), (4, -1, 0), (8, -1, -1), (16, 0, -1), (32, 1, -1), (64, 1, 0), (128, 1, 1)):
        code = F.when((di == i) & (dj == j), c).otherwise(code)
    return length.map(code)


def is_along_flow_length(length: Grid, pairs: DataFrame) -> DataFrame:
    """Pairs (row, col, to_row, to_col) whose first cell is the recorded donor of the second."""
    geo = length.geo
    heads = length.cells.where("donor is not null").select(F.col("row").alias("to_row"), F.col("col").alias("to_col"), geo.row_at(F.col("donor")).alias("row"), geo.col_at(F.col("donor")).alias("col"))
    return pairs.join(heads, ["row", "col", "to_row", "to_col"], "left_semi")


def donor_links(length: Grid, directions: Grid) -> DataFrame:
    """(src, dst, code, scale) of the edges on longest paths: each cell's link to its recorded donor, turned downstream."""
    geo = length.geo
    heads = length.cells.where("donor is not null").select(geo.cell_id().alias("dst"), F.col("donor").alias("src"))
    return edges(directions).join(heads, ["src", "dst"]).select("src", "dst", "code", "scale")


def path_from_outlet(length: Grid, outlets: DataFrame) -> DataFrame:
    """(point, seq, row, col, x, y) of the longest path from each outlet up to its head."""
    geo = length.geo
    jump = checkpointed(length.cells.where("donor is not null").select(geo.cell_id().alias("id"), F.col("donor").alias("j")))
    paths = checkpointed(outlet_ids(length, outlets).select("point", F.lit(0).cast("long").alias("seq"), "id"))
    for k in range((geo.nx * geo.ny).bit_length() + 1):
        more = paths.join(jump, "id").select("point", (F.col("seq") + (1 << k)).alias("seq"), F.col("j").alias("id"))
        more = checkpointed(more.join(paths.select("point", "id"), ["point", "id"], "left_anti"))
        if more.isEmpty():
            break
        paths = checkpointed(paths.unionByName(more))
        far = jump.select(F.col("id").alias("mid"), F.col("j").alias("end"))
        jump = checkpointed(jump.join(far, jump["j"] == far["mid"]).select("id", F.col("end").alias("j")))
    first = paths.groupBy("point", "id").agg(F.min("seq").alias("seq"))
    rows = first.withColumns({"row": geo.row_at(F.col("id")), "col": geo.col_at(F.col("id"))})
    return rows.select("point", "seq", "row", "col", geo.x().alias("x"), geo.y().alias("y"))


def _forward_donor_links(length: Grid, directions: Grid, order: Grid) -> tuple[DataFrame, DataFrame]:
    """Donor links, each with whether its receiver is processed later."""
    chosen = donor_links(length, directions).select("src", "dst")
    e = checkpointed(split_edges(directions, order).join(chosen, ["src", "dst"]).select("src", "dst", "forward", "scale"))
    return e.where("forward"), e.where("not forward")


def relief(directions: Grid, elevation: Grid, length: Grid, order: Grid, area_grid: Grid | None = None, Ao: float | None = None) -> Grid:
    """Elevation at the head of a cell's longest path minus its own.

    With an area grid and Ao only cells of more than Ao hand the head's elevation on.
    """
    geo = directions.geo
    ahead, back = _forward_donor_links(length, directions, order)
    if area_grid is not None and Ao is not None:
        big = _cells(area_grid, "a").where(F.col("a") > Ao).select(F.col("id").alias("src"))
        ahead, back = ahead.join(big, "src", "left_semi"), back.join(big, "src", "left_semi")
    z = checkpointed(_cells(elevation, "z"))
    # up a path: a cell's link leads to its donor, so that the root is the head
    nodes = z.select("id").join(ahead.select(F.col("dst").alias("id"), F.col("src").alias("j")), "id", "left")
    head = checkpointed(doubling.path_sum(nodes, []).select("id", F.col("root").alias("head")))
    head = head.join(z.select(F.col("id").alias("head"), F.col("z").alias("top")), "head").select("id", "top")
    late = back.select(F.col("src").alias("id"), "dst").join(head, "id").select(F.col("dst").alias("id"), F.col("top").alias("late"))
    rows = z.join(head, "id").join(late, "id", "left")
    return _grid(rows, geo, (F.coalesce("late", "top") - F.col("z")).alias("value"))


def scaled_relief(directions: Grid, elevation: Grid, length: Grid, order: Grid, Ao: float, theta: float, area_grid: Grid | None = None) -> Grid:
    """Relief times Ao ** theta."""
    return relief(directions, elevation, length, order, area_grid, Ao if area_grid is not None else None).map(F.col("value") * F.lit(float(Ao) ** theta))


def ksi(area_grid: Grid, directions: Grid, theta: float, Ao: float, length: Grid, order: Grid) -> Grid:
    """The sum of (Ao / (A - Ao)) ** theta times the step, where A > Ao, over a cell's longest upstream path, itself included."""
    geo = directions.geo
    ahead, back = _forward_donor_links(length, directions, order)
    scale = edges(directions).select(F.col("src").alias("id"), "scale")
    own = area_grid.cells.select(geo.cell_id().alias("id"), "row", F.col("value").alias("a")).join(scale, "id", "left")
    own = own.select("id", F.when(F.col("a") > Ao, F.pow(F.try_divide(F.lit(float(Ao)), F.col("a") - Ao), F.lit(theta)) * geo.dimension() * F.coalesce("scale", F.lit(1.0))).otherwise(0.0).alias("k"))
    nodes = own.join(ahead.select(F.col("dst").alias("id"), F.col("src").alias("j")), "id", "left")
    sums = checkpointed(doubling.path_sum(nodes, ["k"]).select("id", "k"))
    late = back.select(F.col("src").alias("id"), "dst").join(sums, "id").select(F.col("dst").alias("id"), F.col("k").alias("late"))
    return _grid(sums.join(late, "id", "left"), geo, (F.col("k") + F.coalesce("late", F.lit(0.0))).alias("value"))


def chi(area_grid: Grid, directions: Grid, theta: float, Ao: float, outlets: DataFrame, mask: Grid | None = None, maximum_length: float | None = None) -> Grid:
    """The sum of (Ao / A) ** theta times the step from a cell down to its outlet, that of the outlet included; 0 elsewhere.

    Diagonal steps count 1.414 dimensions, the outlet's step one. Growth upstream stops where
    the mask is 0 and the area is above 1e4, and where the length from the outlet, its own
    step included, reaches the maximum. The result is 0 outside the mask.
    """
    geo = directions.geo
    ids = checkpointed(outlet_ids(directions, outlets).select("id").distinct())
    step = geo.dimension() * F.when(F.col("code").isin(2, 8, 32, 128), DIAGONAL_PATH).otherwise(1.0)
    links = edges(directions).select(F.col("src").alias("id"), F.col("dst").alias("j"), step.alias("step"))
    a = area_grid.cells.select("row", geo.cell_id().alias("id"), F.col("value").alias("a"))
    nodes = a.join(links, "id", "left").join(ids.withColumn("end", F.lit(True)), "id", "left")
    if mask is not None:
        nodes = nodes.join(_cells(mask, "m"), "id", "left").where(~((F.coalesce(F.col("m"), F.lit(0)) == 0) & (F.col("a") > 1e4)) | F.col("end"))
    l = F.when(F.col("end"), geo.dimension()).otherwise(F.coalesce("step", F.lit(0.0)))
    nodes = nodes.select("id", F.when(F.col("end").isNull(), F.col("j")).alias("j"), l.alias("l"), (F.pow(F.try_divide(F.lit(float(Ao)), F.col("a")), F.lit(theta)) * l).alias("chi"))
    sums = doubling.path_to(nodes, ["l", "chi"], ids)
    if maximum_length is not None:
        sums = sums.where(F.col("l") < maximum_length)
    rows = a.select("id").join(sums.select("id", "chi"), "id", "left").withColumn("value", F.coalesce("chi", F.lit(0.0)))
    if mask is not None:
        rows = rows.join(_cells(mask, "m"), "id", "left").withColumn("value", F.col("value") * F.coalesce("m", F.lit(0.0)))
    return _grid(rows, geo, "value")


def outlets_at_length(length: Grid, directions: Grid, basin_length: float) -> DataFrame:
    """(point, row, col) of the cells where flow length first reaches the basin length: L <= it <= L of the receiver."""
    geo = length.geo
    l = length.cells.select(geo.cell_id().alias("id"), F.col("value").alias("l"))
    e = edges(directions).join(l.withColumnRenamed("id", "src"), "src").join(l.select(F.col("id").alias("dst"), F.col("l").alias("next")), "dst")
    return e.where((F.col("l") <= basin_length) & (F.col("next") >= basin_length)).select(F.col("src").alias("point"), "row", "col")


def points_with_length(length: Grid, directions: Grid, value: float) -> DataFrame:
    """As ``outlets_at_length``, among cells no more than twice the pixel dimension short of it."""
    near = outlets_at_length(length, directions, value).join(length.cells.select("row", "col", F.col("value").alias("l")), ["row", "col"])
    near = near.where(F.col("l") >= value - 2 * length.geo.dx) if not length.geo.geographic else near
    return near.select("row", "col", length.geo.x().alias("x"), length.geo.y().alias("y"))


def chi_scaled_relief(elevation: Grid, directions: Grid, theta: float, Ao: float, outlets: DataFrame) -> Grid:
    """(z - z of the outlet) times Ao ** theta for all cells upstream of each outlet; of several the last one counts."""
    from talusgrid.operators.flow import upstream

    geo = elevation.geo
    base = outlets if "row" in outlets.columns else elevation.rowcols(outlets)
    base = base.join(elevation.cells, ["row", "col"]).select("point", F.col("value").alias("z0"))
    own = upstream(directions, outlets).join(base, "point").groupBy("row", "col").agg(F.max_by("z0", "point").alias("z0"))
    cells = elevation.cells.join(own, ["row", "col"], "left")
    return Grid(cells.select("row", "col", F.coalesce((F.col("value") - F.col("z0")) * F.lit(float(Ao) ** theta), F.lit(0.0)).alias("value")), geo)


def areas_greater_than(area_grid: Grid, least: float) -> DataFrame:
    return area_grid.located().where(F.col("value") >= least).select("row", "col", "x", "y")


def areas_between(area_grid: Grid, directions: Grid, least: float, most: float) -> DataFrame:
    """Cells of an area in the range whose largest donor has less than its lower end; those without donors too."""
    geo = area_grid.geo
    a = _cells(area_grid, "a")
    donor = edges(directions).select(F.col("src").alias("id"), "dst").join(a, "id").groupBy(F.col("dst").alias("id")).agg(F.max("a").alias("top"))
    rows = area_grid.cells.where((F.col("value") >= least) & (F.col("value") <= most)).withColumn("id", geo.cell_id()).join(donor, "id", "left")
    return rows.where(F.coalesce(F.col("top") < least, F.lit(True))).select("row", "col", geo.x().alias("x"), geo.y().alias("y"))


def _valley(laplace: Grid, area_grid: Grid, valley_laplace: float, least_area: float, iterations: int | None) -> Grid:
    mask = laplace.map((F.col("value") >= valley_laplace).cast("double"))
    outlets = area_grid.cells.where(F.col("value") >= least_area).select(area_grid.geo.cell_id().alias("point"), "row", "col")
    wet = flood_mask(mask, outlets)
    return closed(wet, iterations=iterations) if iterations else wet


def valley_area(directions: Grid, order: Grid, area_grid: Grid, laplace: Grid, valley_laplace: float, least_area: float, iterations: int | None = None) -> Grid:
    """Area gathered over valley cells only: those of a Laplacian of at least the value that connect to a channel."""
    valley = checkpointed(_valley(laplace, area_grid, valley_laplace, least_area, iterations).cells)
    return area(directions, order, Grid(valley, directions.geo))


def mainstem_valley_area(directions: Grid, order: Grid, area_grid: Grid, laplace: Grid, valley_laplace: float, least_area: float, length: Grid, iterations: int | None = None) -> Grid:
    """Valley area along the longest path: each cell adds its donor's on that path and the valley cells of side donors below the least area."""
    geo = directions.geo
    wet = checkpointed(_valley(laplace, area_grid, valley_laplace, least_area, iterations).cells)
    valley = Grid(wet, geo)
    own = directions.cells.select(geo.cell_id().alias("id"), geo.area().alias("area")).join(_cells(valley, "on"), "id", "left").select("id", F.when(F.col("on") == 1, F.col("area")).otherwise(0.0).alias("v"))
    links = split_edges(directions, order).where("forward").select("src", "dst")
    stem = donor_links(length, directions).select("src", "dst", F.lit(True).alias("stem"))
    side = _cells(area_grid, "a").select(F.col("id").alias("src"), "a")
    good = links.join(stem, ["src", "dst"], "left").join(side, "src").where(F.col("stem").isNotNull() | (F.col("a") < least_area))
    sums = doubling.subtree_sum(own.join(good.select(F.col("src").alias("id"), F.col("dst").alias("j")), "id", "left"), ["v"])
    return _grid(sums, geo, F.col("v").alias("value"))


def cross_divide_dchi(chi_grid: Grid, directions: Grid, normalised: bool = False) -> Grid:
    """At each paired divide the larger minus the smaller chi of the two, if the smaller isn't 0; else 0.

    Normalised, only pairs with both above 0 count and the difference is divided by their mean.
    """
    from talusgrid.operators.flow import paired_divides

    geo = chi_grid.geo
    pairs = paired_divides(directions, chi_grid if normalised else None)
    far = chi_grid.cells.select(F.col("row").alias("other_row"), F.col("col").alias("other_col"), F.col("value").alias("q"))
    both = pairs.join(chi_grid.renamed("p"), ["row", "col"]).join(far, ["other_row", "other_col"])
    high, low = F.greatest("p", "q"), F.least("p", "q")
    d = F.when(low != 0, high - low).otherwise(0.0)
    d = F.try_divide(d, (high + low) / 2.0) if normalised else d
    found = both.select("row", "col", d.alias("d")).groupBy("row", "col").agg(F.max("d").alias("d"))
    return Grid(chi_grid.cells.select("row", "col").join(found, ["row", "col"], "left").select("row", "col", F.coalesce("d", F.lit(0.0)).alias("value")), geo)

"""Flow directions, the graph they make, and what is upstream or downstream of a cell."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talusgrid.grid import Grid
from talusgrid.operators import doubling
from talusgrid.operators.morphology import CROSS
from talusgrid.operators.neighbours import EIGHT, eight, shifted
from talusgrid.runtime import checkpointed

# Direction codes as (name, code, row offset, column offset), and lengths of a diagonal step.
DIRECTIONS = (("e", 1, 0, 1), ("se", 2, 1, 1), ("s", 4, 1, 0), ("sw", 8, 1, -1), ("w", 16, 0, -1), ("nw", 32, -1, -1), ("n", 64, -1, 0), ("ne", 128, -1, 1))
DIAGONAL_CHOICE, DIAGONAL_STEP, DIAGONAL_PATH = 1.41, 1.41421356, 1.414
#: Order in which donors are visited around a cell, by their direction code towards it.
DONOR_ORDER = (16, 32, 64, 128, 1, 2, 4, 8)
#: What a direction counts as when the compatible border rule leaves it out.
NEVER = -1e22


def _defined(name: str, nx: int, ny: int) -> Column:
    """Cells that may flow in a direction by the compatible border rule: never into the last row or column from the side."""
    r, c = F.col("row"), F.col("col")
    down, up, right, left = r <= ny - 3, (r >= 1) & (r <= ny - 2), c <= nx - 3, (c >= 1) & (c <= nx - 2)
    rows = down if "s" in name else up if "n" in name else F.lit(True)
    cols = right if "e" in name else left if "w" in name else F.lit(True)
    return rows & cols


def flow_direction(grid: Grid, compat: bool = True) -> Grid:
    """Code of the steepest of the eight neighbours, the largest code of equals; 0 without data.

    Drops to diagonal neighbours are divided by 1.41. ``compat`` keeps the border rule by which
    every cell with data has a direction, uphill in pits; else all neighbours in the grid count
    and cells without a lower or equal neighbour have code 0.
    """
    geo, z = grid.geo, F.col("value")
    choices = []
    for name, code, i, j in DIRECTIONS:
        drop = (z - F.col(name)) / (DIAGONAL_CHOICE if i and j else 1.0)
        if compat:
            drop = F.when(_defined(name, geo.nx, geo.ny), drop).otherwise(NEVER)
        choices.append(F.when(drop.isNotNull() if compat else drop >= 0, F.struct(drop.alias("w"), F.lit(code).alias("code"))))
    best = F.greatest(*choices)
    return Grid(eight(grid).select("row", "col", F.when(z.isNotNull(), F.coalesce(best["code"], F.lit(0))).otherwise(0).cast("short").alias("value")), geo)


def flow_code_downhill(grid: Grid) -> Grid:
    """Code of the largest positive drop, those along the axes divided by 1.41; the first of equals; 0 where nothing is lower."""
    z = F.col("value")
    choices = []
    for k, (name, code, i, j) in enumerate(DIRECTIONS):
        drop = (z - F.col(name)) / (1.0 if i and j else DIAGONAL_CHOICE)
        choices.append(F.when(drop > 0, F.struct(drop.alias("w"), F.lit(-k).alias("k"), F.lit(code).alias("code"))))
    return Grid(eight(grid).select("row", "col", F.coalesce(F.greatest(*choices)["code"], F.lit(0)).cast("short").alias("value")), grid.geo)


def update_codes_in_mask(directions: Grid, elevation: Grid, mask: Grid) -> Grid:
    """The directions with those under the mask replaced by ``flow_code_downhill``."""
    both = directions.join(flow_code_downhill(elevation), "new").join(mask, "m")
    return both.map(F.when(F.col("m") == 1, F.col("new")).otherwise(F.col("value")))


def rivertools_to_arc(directions: Grid) -> Grid:
    """Codes turned by one step: 1 becomes 128, any other half."""
    return directions.map(F.when(F.col("value") == 1, 128).otherwise(F.floor(F.col("value") / 2)).cast("short"))


def pixel_scale(directions: Grid) -> Grid:
    return directions.map(F.when(F.col("value").isin(2, 8, 32, 128), DIAGONAL_STEP).otherwise(1.0))


def _moved(code: Column, axis: int) -> Column:
    moves = {d[1]: d[2 + axis] for d in DIRECTIONS}
    out = F.lit(None).cast("long")
    for step in (-1, 0, 1):
        out = F.when(code.isin(*[c for c, m in moves.items() if m == step]), step).otherwise(out)
    return out


def edges(directions: Grid) -> DataFrame:
    """(src, dst, code, row, col, to_row, to_col, scale) of every cell that flows to a cell of the grid."""
    geo, code = directions.geo, F.col("value")
    rows = directions.cells.select("row", "col", F.col("value").alias("code"), (F.col("row") + _moved(code, 0)).alias("to_row"), (F.col("col") + _moved(code, 1)).alias("to_col"))
    rows = rows.where(geo.inside("to_row", "to_col"))
    return rows.select(geo.cell_id().alias("src"), geo.cell_id("to_row", "to_col").alias("dst"), "code", "row", "col", "to_row", "to_col", F.when(F.col("code").isin(2, 8, 32, 128), DIAGONAL_STEP).otherwise(1.0).alias("scale"))


def receiver(directions: Grid, row: int, col: int) -> DataFrame:
    """The cell that (row, col) flows to; no row where it leaves the grid."""
    return edges(directions).where((F.col("row") == row) & (F.col("col") == col)).select("to_row", "to_col")


def donors(directions: Grid) -> DataFrame:
    """(dst, donors): the cells that flow into each, in the fixed order around it."""
    rank = F.array_position(F.array(*[F.lit(c) for c in DONOR_ORDER]), F.col("code").cast("int"))
    found = edges(directions).groupBy("dst").agg(F.array_sort(F.collect_list(F.struct(rank.alias("k"), F.col("src")))).alias("d"))
    return found.select("dst", F.transform("d", lambda x: x["src"]).alias("donors"))




def divides(directions: Grid, margin: bool = True) -> Grid:
    """1 for cells that nothing flows into, else 0; with ``margin`` only in rows and columns 1 .. n - 3."""
    geo = directions.geo
    fed = edges(directions).select(F.col("to_row").alias("row"), F.col("to_col").alias("col"), F.lit(True).alias("fed")).distinct()
    cells = directions.cells.select("row", "col").join(fed, ["row", "col"], "left")
    inner = (F.col("row").between(1, geo.ny - 3)) & (F.col("col").between(1, geo.nx - 3)) if margin else F.lit(True)
    return Grid(cells.select("row", "col", (F.col("fed").isNull() & inner).cast("double").alias("value")), geo)


def channel_slope(directions: Grid, elevation: Grid) -> Grid:
    """Drop to the receiver over the distance to it; 0 without one."""
    geo = directions.geo
    z = elevation.cells.select(geo.cell_id().alias("id"), F.col("value").alias("z"))
    far = z.select(F.col("id").alias("dst"), F.col("z").alias("z_to"))
    links = edges(directions).join(far, "dst").select(F.col("src").alias("id"), "z_to", F.sqrt(F.pow(F.col("row") - F.col("to_row"), F.lit(2)) + F.pow(F.col("col") - F.col("to_col"), F.lit(2))).alias("length"))
    out = z.join(links, "id", "left").select(geo.row_at(F.col("id")).alias("row"), geo.col_at(F.col("id")).alias("col"), F.coalesce((F.col("z") - F.col("z_to")) / (F.col("length") * geo.dx), F.lit(0.0)).alias("value"))
    return Grid(out, geo)


# -- processing order ---------------------------------------------------------------------


def split_edges(directions: Grid, order: Grid) -> DataFrame:
    """The edges with ``forward``: whether the receiver comes later, from high to low ``order``, ties by cell.

    Forward edges form a forest. The others lead back to cells that were processed before.
    """
    geo = directions.geo
    key = order.cells.select(geo.cell_id().alias("id"), F.col("value").alias("z"))
    e = edges(directions).join(key.select(F.col("id").alias("src"), F.col("z").alias("z_src")), "src").join(key.select(F.col("id").alias("dst"), F.col("z").alias("z_dst")), "dst")
    later = (F.col("z_dst") < F.col("z_src")) | ((F.col("z_dst") == F.col("z_src")) & (F.col("dst") > F.col("src"))) | (F.col("z_dst").isNull() & F.col("z_src").isNotNull())
    return e.withColumn("forward", F.coalesce(later, F.lit(False)))


# -- reachability ---------------------------------------------------------------------------


def outlet_ids(grid: Grid, outlets: DataFrame) -> DataFrame:
    """(point, id) of outlets given as (point, x, y) or (point, row, col), those outside the grid dropped."""
    cells = outlets if "row" in outlets.columns else grid.rowcols(outlets)
    return cells.where(F.col("row").isNotNull() & grid.geo.inside()).select("point", grid.geo.cell_id().alias("id"))


def upstream(directions: Grid, outlets: DataFrame) -> DataFrame:
    """(point, row, col) of every cell that drains to each outlet, itself included.

    Each cell is labelled with the first outlet on its way; outlets that drain to others hand
    their cells on.
    """
    geo = directions.geo
    ids = checkpointed(outlet_ids(directions, outlets))
    links = edges(directions)
    nodes = directions.cells.select(geo.cell_id().alias("id")).join(links.select(F.col("src").alias("id"), F.col("dst").alias("j")), "id", "left")
    label = checkpointed(doubling.reaches(nodes, ids))
    # from outlet to the next outlet downstream, over its own link
    onward = links.join(ids.select(F.col("id").alias("src")).distinct(), "src").select(F.col("src").alias("a"), F.col("dst").alias("id")).join(label, "id").select("a", F.col("target").alias("b")).where("a <> b")
    closure = ids.select(F.col("id").alias("a"), F.col("id").alias("b")).distinct()
    frontier, closure = closure, checkpointed(closure)
    while True:
        frontier = checkpointed(frontier.join(onward.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b")).distinct().join(closure, ["a", "b"], "left_anti"))
        if frontier.isEmpty():
            break
        closure = checkpointed(closure.unionByName(frontier))
    out = label.join(closure.withColumnRenamed("a", "target"), "target").select(F.col("id").alias("cell"), F.col("b").alias("id"))
    return out.join(ids, "id").select("point", geo.row_at(F.col("cell")).alias("row"), geo.col_at(F.col("cell")).alias("col"))


def upstream_mask(directions: Grid, outlets: DataFrame) -> Grid:
    """1 for every cell upstream of any outlet, itself included, else 0."""
    geo = directions.geo
    links = edges(directions).select(F.col("src").alias("id"), F.col("dst").alias("j"))
    nodes = directions.cells.select(geo.cell_id().alias("id")).join(links, "id", "left")
    hit = doubling.reaches(nodes, outlet_ids(directions, outlets))
    cells = directions.cells.select("row", "col", geo.cell_id().alias("id")).join(hit, "id", "left")
    return Grid(cells.select("row", "col", F.when(F.col("target").isNotNull(), 1.0).otherwise(0.0).alias("value")), geo)


def upstream_tree(directions: Grid, outlets: DataFrame, values: dict[str, Grid], receivers: DataFrame | None = None) -> DataFrame:
    """The tree above each outlet: (point, cell, parent, row, col, depth, distance_scale, values...).

    A node's distance_scale is that of the step from its last donor in the fixed order, 1 at
    leaves. ``step_scale`` is that of the node's own step down. Depth counts links to the outlet.
    """
    geo = directions.geo
    links = checkpointed((edges(directions) if receivers is None else receivers).select("src", "dst", "code", "scale"))
    ids = outlet_ids(directions, outlets)
    cells = upstream(directions, outlets).select("point", geo.cell_id().alias("id")) if receivers is None else _above(links, ids)
    inner = cells.join(ids.select("point", F.col("id").alias("outlet")), "point").join(links.select(F.col("src").alias("id"), "dst", F.col("scale").alias("step_scale")), "id", "left")
    inner = inner.withColumn("parent", F.when(F.col("id") != F.col("outlet"), F.col("dst")))
    rank = F.array_position(F.array(*[F.lit(c) for c in DONOR_ORDER]), F.col("code").cast("int"))
    last = links.withColumn("k", rank).groupBy(F.col("dst").alias("id")).agg(F.max_by("scale", "k").alias("distance_scale"))
    # depth by path counts, with a node for each (point, cell)
    keyed = inner.select(F.struct("point", "id").alias("id"), F.when(F.col("parent").isNotNull(), F.struct(F.col("point"), F.col("parent").alias("id"))).alias("j"))
    depth = doubling.path_sum(keyed, []).select(F.col("id.point").alias("point"), F.col("id.id").alias("id"), (F.col("n") - 1).alias("depth"))
    out = inner.join(depth, ["point", "id"]).join(last, "id", "left").withColumn("distance_scale", F.coalesce("distance_scale", F.lit(1.0)))
    out = out.withColumns({"row": geo.row_at(F.col("id")), "col": geo.col_at(F.col("id"))})
    for name, grid in values.items():
        out = out.join(grid.renamed(name), ["row", "col"], "left")
    return out.select("point", F.col("id").alias("cell"), "parent", "row", "col", "depth", "distance_scale", F.coalesce("step_scale", F.lit(1.0)).alias("step_scale"), *values)


def longest_path_tree(directions: Grid, outlets: DataFrame, length: Grid, values: dict[str, Grid]) -> DataFrame:
    """The tree of recorded donors above each outlet, as ``upstream_tree``, with each cell's flow length as ``distance``."""
    from talusgrid.operators.accumulate import donor_links

    return upstream_tree(directions, outlets, values | {"distance": length}, donor_links(length, directions))


def _above(links: DataFrame, ids: DataFrame) -> DataFrame:
    """(point, id) of all that leads to the outlets over given links without cycles."""
    found = checkpointed(ids.select("point", "id"))
    frontier = found
    while True:
        frontier = checkpointed(frontier.join(links.select(F.col("dst").alias("id"), "src"), "id").select("point", F.col("src").alias("id")).join(found, ["point", "id"], "left_anti"))
        if frontier.isEmpty():
            return found
        found = checkpointed(found.unionByName(frontier))


def nested_tree(tree: DataFrame, point: int, values: Sequence[str]) -> dict:
    """The tree of one outlet as nested dictionaries, on the driver: for small basins only."""
    rows = tree.where(F.col("point") == point).orderBy("depth", "cell").collect()
    nodes = {r.cell: {"index": (r.row, r.col), "distance_scale": r.distance_scale, **{v: r[v] for v in values}} for r in rows}
    root = None
    for r in rows:
        if r.parent is None:
            root = nodes[r.cell]
        else:
            nodes[r.parent].setdefault("next", []).append(nodes[r.cell])
    return root or {}


def basin_bounds(directions: Grid, outlets: DataFrame) -> DataFrame:
    """(point, xmin, xmax, ymin, ymax) of what drains to each outlet."""
    geo = directions.geo
    return upstream(directions, outlets).groupBy("point").agg(F.min(geo.x()).alias("xmin"), F.max(geo.x()).alias("xmax"), F.min(geo.y()).alias("ymin"), F.max(geo.y()).alias("ymax"))


def downstream_paths(directions: Grid, starts: DataFrame, length: float = float("inf"), diagonal: float = DIAGONAL_PATH) -> DataFrame:
    """(point, seq, row, col, distance) from each start down to the border, a repeat, or the length.

    The border cell itself is left out, and so is the first cell at or beyond the length.
    Ancestors at distances of powers of two are found by doubling, and paths are put together
    from them, so that the number of joins is logarithmic in the longest path.
    """
    geo = directions.geo
    step = F.when(F.col("code").isin(2, 8, 32, 128), geo.dimension() * diagonal).otherwise(geo.dimension())
    border = (F.col("row") == 0) | (F.col("col") == 0) | (F.col("row") == geo.ny - 1) | (F.col("col") == geo.nx - 1)
    links = checkpointed(edges(directions).where(~border).select(F.col("src").alias("id"), F.col("dst").alias("j"), step.alias("d")))
    first = outlet_ids(directions, starts)
    # paths[k] holds the nodes at positions 0 .. 2^k - 1; the jump table reaches 2^k further
    paths = checkpointed(first.select("point", F.lit(0).cast("long").alias("seq"), "id", F.lit(0.0).alias("distance")))
    jump = links
    for k in range((geo.nx * geo.ny).bit_length() + 1):
        more = paths.join(jump, "id").select("point", (F.col("seq") + (1 << k)).alias("seq"), F.col("j").alias("id"), (F.col("distance") + F.col("d")).alias("distance")).where(F.col("distance") < length)
        more = checkpointed(more.join(paths.select("point", "id"), ["point", "id"], "left_anti"))
        if more.isEmpty():
            break
        paths = checkpointed(paths.unionByName(more))
        far = jump.select(F.col("id").alias("mid"), F.col("j").alias("end"), F.col("d").alias("rest"))
        jump = checkpointed(jump.join(far, jump["j"] == far["mid"]).select("id", F.col("end").alias("j"), (F.col("d") + F.col("rest")).alias("d")))
    # a walk that comes back repeats cells; its first visit counts, and what follows a repeat goes
    order = Window.partitionBy("point", "id").orderBy("seq")
    unique = paths.withColumn("visit", F.row_number().over(order))
    stop = unique.where("visit > 1").groupBy("point").agg(F.min("seq").alias("stop"))
    out = unique.where("visit = 1").join(stop, "point", "left").where("stop is null or seq < stop")
    out = out.withColumns({"row": geo.row_at(F.col("id")), "col": geo.col_at(F.col("id"))})
    return out.where(~border).select("point", "seq", "row", "col", "distance")


def boundary_between(directions: Grid, one: DataFrame, two: DataFrame) -> DataFrame:
    """(side, row, col): cells of either basin with a four-neighbour in (or shared with) the other; each outlet set is one basin."""
    geo = directions.geo
    basins = [upstream_mask(directions, o) for o in (one, two)]
    out = None
    for side, (a, b) in enumerate((basins, basins[::-1])):
        near = shifted(b, [(f"o{k}", i, j) for k, (i, j) in enumerate(CROSS)])
        grown = near.where(F.greatest("value", *[F.coalesce(F.col(f"o{k}"), F.lit(0.0)) for k in range(4)]) == 1).select("row", "col")
        part = a.cells.where("value = 1").select("row", "col").join(grown, ["row", "col"]).select(F.lit(side).alias("side"), "row", "col")
        out = part if out is None else out.unionByName(part)

    return out


def paired_hollows(directions: Grid, area: Grid, one: DataFrame, two: DataFrame, threshold: float = 100000.0) -> DataFrame:
    """(side, x, y): where flow from the common boundary first gets from less to at least the threshold area.

    The cell after the crossing; distinct by side. Crossing cells are targets of one labelling.
    """
    geo = directions.geo
    a = area.cells.select(geo.cell_id().alias("id"), F.col("value").alias("a"))
    links = edges(directions).select(F.col("src").alias("id"), F.col("dst").alias("j"))
    crossing = links.join(a, "id").join(a.select(F.col("id").alias("j"), F.col("a").alias("a_to")), "j").where((F.col("a") < threshold) & (F.col("a_to") >= threshold)).select("id")
    nodes = directions.cells.select(geo.cell_id().alias("id")).join(links, "id", "left")
    met = doubling.reaches(nodes, crossing)
    sides = boundary_between(directions, one, two).select("side", geo.cell_id().alias("id"))
    end = sides.join(met, "id").select("side", F.col("target").alias("id")).join(links, "id").select("side", F.col("j").alias("cell")).distinct()
    return end.select("side", geo.x(geo.col_at(F.col("cell"))).alias("x"), geo.y(geo.row_at(F.col("cell"))).alias("y"))


def paired_divides(directions: Grid, mask: Grid | None = None) -> DataFrame:
    """(row, col, other_row, other_col): each divide and the cell opposite to its receiver, in the grid and, if given, with mask > 0."""
    geo = directions.geo
    ridge = divides(directions).cells.where("value = 1").select("row", "col")
    pairs = edges(directions).join(ridge, ["row", "col"]).select("row", "col", (F.col("row") * 2 - F.col("to_row")).alias("other_row"), (F.col("col") * 2 - F.col("to_col")).alias("other_col"))
    pairs = pairs.where(geo.inside("other_row", "other_col"))
    if mask is not None:
        good = mask.cells.where("value > 0").select("row", "col")
        pairs = pairs.join(good, ["row", "col"], "left_semi").join(good.select(F.col("row").alias("other_row"), F.col("col").alias("other_col")), ["other_row", "other_col"], "left_semi")
    return pairs.select("row", "col", "other_row", "other_col")


def flood_mask(mask: Grid, outlets: DataFrame) -> Grid:
    """1 for the eight-connected cells with mask 1 that the outlets reach (and the outlets), else 0.

    Connected regions are labelled once, in rounds of label hooking, whatever their shape.
    """
    from talusgrid.operators.regions import regions

    geo = mask.geo
    ids = outlet_ids(mask, outlets).select(F.col("id")).distinct()
    seeds = ids.select(geo.row_at(F.col("id")).alias("row"), geo.col_at(F.col("id")).alias("col"), F.lit(1.0).alias("seed"))
    open_ = mask.dense().cells.join(seeds, ["row", "col"], "left").select("row", "col", F.when((F.col("value") == 1) | F.col("seed").isNotNull(), 1.0).alias("value"), "seed")
    labelled = checkpointed(regions(Grid(open_.select("row", "col", "value"), geo), diagonal=True))
    wet = labelled.join(seeds, ["row", "col"]).select("region").distinct()
    hit = labelled.join(wet, "region").select("row", "col", F.lit(1.0).alias("hit"))
    return Grid(geo.frame(mask.spark).join(hit, ["row", "col"], "left").select("row", "col", F.coalesce("hit", F.lit(0.0)).alias("value")), geo)


assert tuple(d[0] for d in DIRECTIONS) == tuple(o[0] for o in EIGHT)

"""River profiles: windows along flow, regressions of elevation on chi, mainstems and tributaries."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talusgrid.functions import numeric
from talusgrid.grid import Grid
from talusgrid.operators import doubling
from talusgrid.operators.accumulate import _cells
from talusgrid.operators.flow import DIAGONAL_PATH, DIRECTIONS, edges, outlet_ids, upstream_tree
from talusgrid.operators.neighbours import tiled
from talusgrid.runtime import checkpointed, partitions


def _graph(area: Grid, directions: Grid) -> tuple[DataFrame, DataFrame]:
    """(id, up): the donor of largest area, the larger id of equals; (id, dn): the receiver."""
    e = edges(directions).select("src", "dst")
    a = _cells(area, "a").select(F.col("id").alias("src"), "a")
    up = e.join(a, "src").groupBy(F.col("dst").alias("id")).agg(F.max_by("src", F.struct("a", "src")).alias("up"))
    return checkpointed(up), checkpointed(e.select(F.col("src").alias("id"), F.col("dst").alias("dn")))


#: Side of the tiles in which windows grow, and cells around them that a path may use before it goes on in rounds of joins.
WINDOW_TILE, WINDOW_HALO = 512, 32

_POINT = (("id", "long"), ("z", "double"), ("a", "double"), ("de", "double"), ("row", "long"), ("col", "long"))


def _grown_in_tiles(elevation: Grid, area: Grid, directions: Grid, vertical: bool, interval: float, area_threshold: float, centers: Column | None, tile: int, halo: int) -> DataFrame:
    """(center, points) of the paths that stay within a tile and its halo; points is NULL for those that leave it.

    All paths of a tile move one step at a time, as arrays. Receivers and largest donors are
    found in the tile; on its outermost cells donors may be missing, so that no path moves up from there.
    """
    geo = elevation.geo
    chosen = F.expr("z is not null and a is not null") if centers is None else F.expr("z is not null and a is not null") & centers
    cells = elevation.cells.select("row", "col", F.col("value").cast("double").alias("z"), geo.dimension().cast("double").alias("de"))
    cells = cells.join(area.cells.select("row", "col", F.col("value").cast("double").alias("a"), F.lit(True).alias("drained")), ["row", "col"], "full")
    cells = cells.join(directions.cells.select("row", "col", F.col("value").cast("int").alias("code")), ["row", "col"], "full")
    cells = cells.select("row", "col", "z", "a", "de", F.coalesce("drained", F.lit(False)).alias("drained"), F.coalesce("code", F.lit(0)).alias("code"), F.coalesce(chosen, F.lit(False)).alias("center"))
    nx, ny = geo.nx, geo.ny
    schema = f"center long, points array<struct<{', '.join(f'{n}: {t}' for n, t in _POINT)}>>"

    def run(table: pa.Table) -> pa.Table:
        def values(name: str) -> tuple[np.ndarray, np.ndarray]:
            column = table.column(name).combine_chunks()
            there = column.is_valid().to_numpy(zero_copy_only=False)
            return (column if there.all() else column.fill_null(0)).to_numpy(zero_copy_only=False), there

        r, c = values("row")[0], values("col")[0]
        (z, has_z), (a, has_a), (de, has_de) = values("z"), values("a"), values("de")
        code, drained = values("code")[0], values("drained")[0]
        there = has_de & drained
        top, left = r.min() - 1, c.min() - 1
        place = np.full((r.max() - top + 2, c.max() - left + 2), -1)
        place[r - top, c - left] = np.arange(len(r))
        # where each cell flows to: a place, -1 for none, -2 for one out of sight
        to_r, to_c = r.copy(), c.copy()
        flows = np.zeros(len(r), bool)
        for _, k, i, j in DIRECTIONS:
            on = code == k
            to_r[on] += i
            to_c[on] += j
            flows |= on
        flows &= (to_r >= 0) & (to_r < ny) & (to_c >= 0) & (to_c < nx)
        dn = np.full(len(r), -1)
        dn[flows] = place[to_r[flows] - top, to_c[flows] - left]
        dn[flows & (dn < 0)] = -2
        # the last donor by area and id
        src = np.flatnonzero((dn >= 0) & drained)
        src = src[np.lexsort((r[src] * nx + c[src], a[src], has_a[src]))]
        up = np.full(len(r), -1)
        up[dn[src]] = src
        low_r, high_r, low_c, high_c = r.min(), r.max(), c.min(), c.max()
        up[((r == low_r) & (r > 0)) | ((r == high_r) & (r < ny - 1)) | ((c == low_c) & (c > 0)) | ((c == high_c) & (c < nx - 1))] = -2

        def leg(p: np.ndarray, q: np.ndarray) -> np.ndarray:
            return np.where((r[p] == r[q]) | (c[p] == c[q]), 1.0, DIAGONAL_PATH)

        def seen(d: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Which of the ends are cells of the grid, and which are out of sight while the other may be a cell."""
            good_d, good_u = (d >= 0) & there[d], (u >= 0) & there[u]
            return good_d & good_u, ((d == -2) & (good_u | (u == -2))) | ((u == -2) & good_d)

        center = np.flatnonzero(values("center")[0] & values("own")[0])
        d, u = dn[center], up[center]
        both, lost = seen(d, u)
        left_out = [center[lost]]
        met = [center[both]]  # the places met so far by those that still grow, a row for each end and round
        center, d, u = center[both], d[both], u[both]
        length = (leg(d, center) + leg(u, center)) * de[center]
        done: list[tuple[np.ndarray, list[np.ndarray]]] = []
        while len(center):
            met = [d, *met, u]
            extent, known = (z[u] - z[d], has_z[u] & has_z[d]) if vertical else (length, np.ones(len(u), bool))
            grows = known & (extent < interval) & has_a[u] & ~(a[u] <= area_threshold)
            done.append((center[~grows], [m[~grows] for m in met]))
            center, d, u, length, met = center[grows], d[grows], u[grows], length[grows], [m[grows] for m in met]
            to_d, to_u = dn[d], up[u]
            both, lost = seen(to_d, to_u)
            left_out.append(center[lost])
            go = both & (to_d != to_u)
            more = leg(to_d[go], d[go]) * de[to_d[go]] + leg(to_u[go], u[go]) * de[to_u[go]]
            length = length[go] + more
            center, d, u, met = center[go], to_d[go], to_u[go], [m[go] for m in met]
        lost = np.concatenate(left_out)
        starts = np.concatenate([lost, *[x for x, _ in done]])
        sizes = np.concatenate([np.zeros(len(lost), np.int64), *[np.full(len(x), len(m)) for x, m in done]])
        flat = np.concatenate([np.zeros(0, np.int64), *[np.stack(m, 1).ravel() for _, m in done]])
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        columns = [pa.array(r[flat] * nx + c[flat]), pa.array(z[flat], mask=~has_z[flat]), pa.array(a[flat], mask=~has_a[flat]), pa.array(de[flat]), pa.array(r[flat]), pa.array(c[flat])]
        points = pa.StructArray.from_arrays(columns, names=[n for n, _ in _POINT])
        return pa.table({"center": r[starts] * nx + c[starts], "points": pa.ListArray.from_arrays(pa.array(ends), points, mask=pa.array(sizes == 0))})

    return tiled(cells, halo, halo, tile).groupBy("tr", "tc").applyInArrow(run, schema)


def window_paths(elevation: Grid, area: Grid, directions: Grid, vertical_interval: float | None = None, horizontal_interval: float | None = None, area_threshold: float = 0.0, centers: Column | None = None, tile: int = WINDOW_TILE, halo: int = WINDOW_HALO) -> DataFrame:
    """(center, points): the path around each cell, from downstream to upstream, as points (id, z, a, de, row, col).

    From the cell's receiver and its largest donor both ends move one step at a time until the
    drop or the length between them reaches the interval, or the area at the upper end is no
    more than the threshold. Cells whose ends run out or meet have no path. Paths grow in tiles
    with a halo, one shuffle; only those that leave it go in rounds of joins.
    """
    vertical = vertical_interval is not None
    interval = vertical_interval if vertical else horizontal_interval
    near = checkpointed(_grown_in_tiles(elevation, area, directions, vertical, interval, area_threshold, centers, tile, halo))
    whole, far = near.where("points is not null"), near.where("points is null").select("center")
    if far.isEmpty():
        return whole
    return whole.unionByName(_grown_by_joins(elevation, area, directions, vertical, interval, area_threshold, far))


def _grown_by_joins(elevation: Grid, area: Grid, directions: Grid, vertical: bool, interval: float, area_threshold: float, centers: DataFrame) -> DataFrame:
    """As ``window_paths`` for the given centers, wherever their paths lead.

    The cells still growing shrink every round; a round is two joins, which carry the two ends
    alone, and the points that the rounds met are put together once, at the end.
    """
    geo = elevation.geo
    info = elevation.cells.select("row", "col", geo.cell_id().alias("id"), F.col("value").alias("z"), geo.dimension().alias("de")).join(_cells(area, "a"), "id")
    info = checkpointed(info)
    up, dn = _graph(area, directions)
    point = F.struct("id", "z", "a", "de", "row", "col")
    node = info.select(F.col("id").alias("key"), point.alias("p"))
    up_p = up.join(node.withColumnsRenamed({"key": "up"}), "up").select(F.col("id").alias("at"), F.col("p").alias("up_p"))
    dn_p = dn.join(node.withColumnsRenamed({"key": "dn"}), "dn").select(F.col("id").alias("at"), F.col("p").alias("dn_p"))
    up_p, dn_p = checkpointed(up_p), checkpointed(dn_p)

    def leg(a: Column, b: Column) -> Column:
        return F.when((a["row"] == b["row"]) | (a["col"] == b["col"]), 1.0).otherwise(DIAGONAL_PATH)

    start = info.join(centers.select(F.col("center").alias("id")), "id", "left_semi").select(F.col("id").alias("center"), point.alias("c"))
    state = start.join(up_p.withColumnRenamed("at", "center"), "center").join(dn_p.withColumnRenamed("at", "center"), "center")
    state = state.select("center", F.col("dn_p").alias("d"), F.col("up_p").alias("u"), ((leg(F.col("dn_p"), F.col("c")) + leg(F.col("up_p"), F.col("c"))) * F.col("c.de")).alias("length"))
    extent = (F.col("u.z") - F.col("d.z")) if vertical else F.col("length")

    def met(at: int, point: str) -> Column:
        return F.struct(F.lit(at).alias("at"), F.col(point).alias("p"))

    k, points = 1, start.select("center", F.array(met(0, "c")).alias("met"), F.lit(False).alias("whole"))
    while True:
        growing = (extent < interval) & (F.col("u.a") > area_threshold)
        state = checkpointed(state.withColumn("grows", F.coalesce(growing, F.lit(False))))
        points = points.unionByName(state.select("center", F.array(met(-k, "d"), met(k, "u")).alias("met"), (~F.col("grows")).alias("whole")))
        state = state.where("grows")
        if state.isEmpty():
            break
        moved = state.withColumns({"uid": F.col("u.id"), "did": F.col("d.id")})
        moved = moved.join(up_p.withColumnRenamed("at", "uid"), "uid").join(dn_p.withColumnRenamed("at", "did"), "did").where(F.col("up_p")["id"] != F.col("dn_p")["id"])
        more = leg(F.col("dn_p"), F.col("d")) * F.col("dn_p")["de"] + leg(F.col("up_p"), F.col("u")) * F.col("up_p")["de"]
        state = moved.select("center", F.col("dn_p").alias("d"), F.col("up_p").alias("u"), (F.col("length") + more).alias("length"))
        k += 1
    paths = points.groupBy("center").agg(F.flatten(F.collect_list("met")).alias("met"), F.max("whole").alias("whole")).where("whole")
    return paths.select("center", F.array_sort("met")["p"].alias("points"))


def _diagonal(a: Column, b: Column) -> Column:
    return (a["row"] != b["row"]) & (a["col"] != b["col"])


def ks_of_paths(paths: DataFrame, theta: float, compat: bool = True) -> DataFrame:
    """(center, ks, mse, ss, r2, pval, n_regression) of z - z0 = ks chi along each path, through the origin.

    ``compat`` applies a segment's diagonal factor to the segment before it. All sums run over
    the arrays in the JVM; only the t distribution is an Arrow function.
    """
    p = F.col("points")
    n = F.size(p)

    def sums(acc: Column, k: Column) -> Column:
        here, last = F.get(p, k), F.get(p, k - 1)
        bent = _diagonal(here, F.get(p, k + 1)) & (k < n - 1) if compat else _diagonal(last, here)
        chi = acc["chi"] + (F.pow(here["a"], F.lit(-theta)) + F.pow(last["a"], F.lit(-theta))) * 0.25 * (here["de"] + last["de"]) * F.when(F.coalesce(bent, F.lit(False)), DIAGONAL_PATH).otherwise(1.0)
        y = here["z"] - F.get(p, F.lit(0))["z"]
        return F.struct(chi.alias("chi"), (acc["xy"] + chi * y).alias("xy"), (acc["xx"] + chi * chi).alias("xx"), (acc["yy"] + y * y).alias("yy"))

    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("chi", "xy", "xx", "yy")])
    rows = paths.select("center", n.alias("n_regression"), F.aggregate(F.sequence(F.lit(1), n - 1), zero, sums).alias("s"))
    ks, ss = F.try_divide("s.xy", "s.xx"), F.greatest(F.col("s.yy") - F.try_divide(F.col("s.xy") * F.col("s.xy"), F.col("s.xx")), F.lit(0.0))
    rows = rows.select("center", "n_regression", ks.alias("ks"), ss.alias("ss"), (1.0 - F.try_divide(ss, F.col("s.yy"))).alias("r2"), F.col("s.xx").alias("xx"))

    @F.pandas_udf("double")
    def p_value(k: pd.Series, ss: pd.Series, xx: pd.Series, n: pd.Series) -> pd.Series:
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.abs(k) / np.sqrt(ss / (n - 1) / xx)
        return pd.Series([numeric.t_two_sided(a, b - 1) for a, b in zip(t, n, strict=True)])

    return rows.select("center", "ks", (F.col("ss") / F.col("n_regression")).alias("mse"), "ss", "r2", p_value("ks", "ss", "xx", "n_regression").alias("pval"), "n_regression")


def ks_with_smoothing(elevation: Grid, area: Grid, directions: Grid, theta: float, vertical_interval: float | None = None, horizontal_interval: float | None = None, area_threshold: float = 0.0, compat: bool = True) -> Grid:
    """Bands value (ks), n (paths that touch a cell), mse, ss, r2, pval, n_regression for cells above the area threshold."""
    paths = window_paths(elevation, area, directions, vertical_interval, horizontal_interval, area_threshold, F.col("a") > area_threshold)
    return _with_visits(elevation, paths, ks_of_paths(paths, theta, compat).withColumnRenamed("ks", "value"))


def _with_visits(elevation: Grid, paths: DataFrame, fits: DataFrame) -> Grid:
    geo = elevation.geo
    visits = paths.select("center", F.explode(F.array_distinct(F.transform("points", lambda x: x["id"]))).alias("id")).groupBy("id").agg(F.count("*").cast("int").alias("n"))
    rows = elevation.cells.select("row", "col", geo.cell_id().alias("id")).join(fits.withColumnRenamed("center", "id"), "id", "left").join(visits, "id", "left")
    return Grid(rows.select("row", "col", "value", F.coalesce("n", F.lit(0)).alias("n"), "mse", "ss", "r2", "pval", F.coalesce("n_regression", F.lit(0)).alias("n_regression")), geo)


def _chi_of(area: np.ndarray, de: np.ndarray, bent: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """chi along paths of one length, a row each, for each path's theta."""
    a = area ** -theta[:, None]
    return np.concatenate((np.zeros((len(a), 1)), np.cumsum(0.25 * (a[:, 1:] + a[:, :-1]) * (de[:, 1:] + de[:, :-1]) * bent[:, 1:], axis=1)), axis=1)


def theta_with_smoothing(elevation: Grid, area: Grid, directions: Grid, min_area: float, vertical_interval: float | None = None, horizontal_interval: float | None = None, compat: bool = True) -> Grid:
    """As ``ks_with_smoothing`` with the concavity theta that leaves the least squares, searched from 0.5 within +-10."""
    paths = window_paths(elevation, area, directions, vertical_interval, horizontal_interval, min_area, F.col("a") > min_area)
    flat = paths.select("center", *[F.col(f"points.{c}").cast("array<double>").alias(c) for c in ("z", "a", "de", "row", "col")])

    def fitted(rows: pa.Table, n: int) -> pa.RecordBatch:
        z, a, de, row, col = (rows.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, n) for c in ("z", "a", "de", "row", "col"))
        y = z - z[:, :1]
        turn = (np.diff(row, axis=1) != 0) & (np.diff(col, axis=1) != 0)
        bent = np.ones(z.shape)
        if compat:
            bent[:, 1:-1][turn[:, 1:]] = DIAGONAL_PATH
        else:
            bent[:, 1:][turn] = DIAGONAL_PATH

        def cost(theta: np.ndarray, at: np.ndarray) -> np.ndarray:
            out = np.full(len(theta), np.inf)
            ok = np.abs(theta) <= 10
            at = at[ok]
            with np.errstate(all="ignore"):
                out[ok] = numeric.through_origin_rows(_chi_of(a[at], de[at], bent[at], theta[ok]), y[at])[1]
            return out

        theta, ss = numeric.nelder_mead_rows(cost, 0.5, len(z))
        with np.errstate(all="ignore"):
            chi = _chi_of(a, de, bent, theta)
            k, yy, xx = numeric.through_origin_rows(chi, y)[0], numeric.dot_rows(y, y), numeric.dot_rows(chi, chi)
            t = np.where((ss > 0) & (xx > 0), np.abs(k) / np.sqrt(ss / (n - 1) / xx), np.inf)
            r2 = np.where(yy != 0, 1 - ss / yy, np.nan)
        pval = np.array([numeric.t_two_sided(x, n - 1) for x in t.tolist()], float)
        return pa.record_batch([rows.column("center").combine_chunks(), *[pa.array(v, from_pandas=True) for v in (theta, ss / n, ss, r2, pval)], pa.array(np.full(len(z), n, np.int32))], names=["center", "value", "mse", "ss", "r2", "pval", "n_regression"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            sizes = pa.compute.list_value_length(rows.column("z")).to_numpy()
            for n in np.unique(sizes):
                yield fitted(rows.take(pa.array(np.flatnonzero(sizes == n))), int(n))

    # searches are dealt out evenly: paths lie together where the channels are
    fits = flat.repartition(partitions(elevation.spark), "center").mapInArrow(run, "center long, value double, mse double, ss double, r2 double, pval double, n_regression int")
    return _with_visits(elevation, paths, fits)


def slope_with_smoothing(elevation: Grid, area: Grid, directions: Grid, vertical_interval: float | None = None, horizontal_interval: float | None = None, min_area: float = 1e6, side: str = "both") -> Grid:
    """Drop between the ends of a cell's path over the steps of all its points.

    ``side`` "down" or "up" doubles the interval and takes only the points below the cell, or
    from the cell up. A point's step is diagonal if the one to the next is; the last counts 1.
    """
    factor = 1 if side == "both" else 2
    paths = window_paths(elevation, area, directions, None if vertical_interval is None else factor * vertical_interval, None if horizontal_interval is None else factor * horizontal_interval, 0.0, F.col("a") > min_area)
    at = F.array_position(F.transform("points", lambda x: x["id"]), F.col("center"))
    points = {"both": F.col("points"), "down": F.slice("points", F.lit(1), at.cast("int") - 1), "up": F.slice("points", at.cast("int"), F.size("points"))}[side]
    rows = paths.select("center", points.alias("points")).where("size(points) > 1")
    p = F.col("points")
    steps = F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), F.lit(0.0), lambda s, k: s + F.get(p, k)["de"] * F.when(F.coalesce(_diagonal(F.get(p, k), F.get(p, k + 1)), F.lit(False)), DIAGONAL_PATH).otherwise(1.0))
    fits = rows.select(F.col("center").alias("id"), ((F.element_at(p, -1)["z"] - F.get(p, F.lit(0))["z"]) / steps).alias("value"))
    geo = elevation.geo
    cells = elevation.cells.select("row", "col", geo.cell_id().alias("id")).join(fits, "id", "left")
    return Grid(cells.select("row", "col", "value"), geo)


# -- profiles above outlets -----------------------------------------------------------------


def chi_tree(elevation: Grid, directions: Grid, area: Grid, outlets: DataFrame, theta: float, xo: float = 500.0, compat: bool = True, chi_o: float = 0.0) -> DataFrame:
    """(point, cell, parent, row, col, depth, area, elevation, chi) above each outlet, while the area is at least xo squared.

    Elevation is relative to the outlet; chi adds (A^-theta + A_parent^-theta) / 2 times a
    cell's distance_scale and dimension (without ``compat`` the scale of its own step).
    """
    geo = elevation.geo
    tree = upstream_tree(directions, outlets, {"area": area, "elevation": elevation}).where(F.col("area") >= xo * xo)
    tree = checkpointed(tree)
    above = tree.select("point", F.col("cell").alias("parent"), F.col("area").alias("parent_area"))
    scale = F.col("distance_scale") if compat else F.col("step_scale")
    own = tree.join(above, ["point", "parent"], "left").withColumn("step", F.coalesce((F.pow("area", F.lit(-theta)) + F.pow("parent_area", F.lit(-theta))) * 0.5 * scale * geo.dimension(), F.lit(0.0)))
    nodes = own.select(F.struct("point", "cell").alias("id"), F.when(F.col("parent").isNotNull(), F.struct(F.col("point"), F.col("parent").alias("cell"))).alias("j"), F.col("step").alias("chi"))
    sums = doubling.path_sum(nodes, ["chi"]).select(F.col("id.point").alias("point"), F.col("id.cell").alias("cell"), (F.col("chi") + chi_o).alias("chi"))
    base = tree.where("parent is null").select("point", F.col("elevation").alias("base"))
    out = own.join(sums, ["point", "cell"]).join(base, "point")
    return out.select("point", "cell", "parent", "row", "col", "depth", "area", (F.col("elevation") - F.col("base")).alias("elevation"), "chi")


def profile_values(tree: DataFrame, items: Sequence[str], xo: float = 500.0) -> DataFrame:
    """Items of the tree's cells of an area of at least xo squared, by outlet and depth (all, if the tree has no area)."""
    rows = tree.where(F.col("area") >= xo * xo) if "area" in tree.columns else tree
    return rows.select("point", "depth", "cell", *items)


def ks_fit(tree: DataFrame) -> DataFrame:
    """(point, ks, wrss, r2) of elevation on chi through the origin, by outlet, all as sums."""
    s = tree.groupBy("point").agg(F.sum(F.col("chi") * F.col("elevation")).alias("xy"), F.sum(F.col("chi") * F.col("chi")).alias("xx"), F.sum(F.col("elevation") * F.col("elevation")).alias("yy"), (F.var_pop("elevation") * F.count("elevation")).alias("ss"))
    ks = F.try_divide("xy", "xx")
    wrss = F.greatest(F.col("yy") - ks * F.col("xy"), F.lit(0.0))
    return s.select("point", ks.alias("ks"), wrss.alias("wrss"), (1.0 - F.try_divide(wrss, F.col("ss"))).alias("r2"))


def ks_theta_fit(elevation: Grid, directions: Grid, area: Grid, outlets: DataFrame, xo: float = 500.0, compat: bool = True) -> DataFrame:
    """(point, ks, theta, r2) with the theta that leaves the least squares, searched from 0.5; r2 is 0 if it doesn't settle.

    A basin's profile is one group: rows of (depth, area, parent, scale, elevation).
    """
    geo = elevation.geo
    tree = upstream_tree(directions, outlets, {"area": area, "elevation": elevation}).where(F.col("area") >= xo * xo)
    rows = tree.withColumn("de", geo.dimension() * (F.col("distance_scale") if compat else F.col("step_scale")))

    def run(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["depth", "cell"]).reset_index(drop=True)
        at = {c: i for i, c in enumerate(t["cell"])}
        up = t["parent"].map(at).fillna(-1).astype(int).to_numpy()
        a, de, e = t["area"].to_numpy(), t["de"].to_numpy(), (t["elevation"] - t["elevation"].iloc[0]).to_numpy()
        # rows come by depth, so that whole levels of the tree are added to those below them at once
        ends = [*(np.flatnonzero(np.diff(t["depth"].to_numpy())) + 1), len(t)]
        levels = list(zip(ends[:-1], ends[1:], strict=True))

        def chi(theta: float) -> np.ndarray:
            w = a**-theta
            step = 0.5 * (w + w[up]) * de
            out = np.zeros(len(a))
            for lo, hi in levels:
                out[lo:hi] = out[up[lo:hi]] + step[lo:hi]
            return out

        theta, ss, settled = numeric.nelder_mead(lambda x: numeric.through_origin(chi(x), e)[1] if abs(x) <= 10 else np.inf, 0.5)
        k = numeric.through_origin(chi(theta), e)[0]
        half = float(((e - e.mean()) ** 2).sum())
        if not chi(theta).any():
            k = theta = r2 = 0.0
        else:
            r2 = 1 - ss / half if settled and half else 0.0
        return pd.DataFrame({"point": [key[0]], "ks": [k], "theta": [theta], "r2": [r2]})

    return rows.select("point", "cell", "parent", "depth", "area", "de", "elevation").groupBy("point").applyInPandas(run, "point long, ks double, theta double, r2 double")


def mainstem_and_tributaries(elevation: Grid, directions: Grid, area: Grid, outlets: DataFrame, minimum_area: float = 1e7) -> DataFrame:
    """(point, profile, mainstem, seq, cell, area, elevation, de) of the channels above each outlet.

    At each cell the child of largest area goes on and the other children above the minimum
    start tributaries. A profile's name is its lowest cell; those of up to four cells are left
    out. Elevation is relative to the profile's lowest cell, de is the length of a cell's step down.
    """
    geo = elevation.geo
    tree = checkpointed(upstream_tree(directions, outlets, {"area": area, "elevation": elevation}).where(F.col("parent").isNull() | (F.col("area") > minimum_area)))
    best = tree.where("parent is not null").groupBy("point", "parent").agg(F.max_by("cell", F.struct(F.col("area"), -F.col("cell"))).alias("cell")).select("point", "parent", "cell", F.lit(True).alias("stem"))
    marked = tree.join(best, ["point", "parent", "cell"], "left").withColumn("de", geo.dimension() * F.when(F.col("step_scale") > 1, DIAGONAL_PATH).otherwise(1.0))
    nodes = marked.select(F.struct("point", "cell").alias("id"), F.when(F.col("stem"), F.struct(F.col("point"), F.col("parent").alias("cell"))).alias("j"))
    chains = doubling.path_sum(nodes, []).select(F.col("id.point").alias("point"), F.col("id.cell").alias("cell"), F.col("root.cell").alias("profile"), (F.col("n") - 1).alias("seq"))
    rows = marked.select("point", "cell", "area", "elevation", "de", "parent").join(chains, ["point", "cell"])
    base = rows.where("seq = 0").select("point", "profile", F.col("elevation").alias("base"), F.col("parent").isNull().alias("mainstem"))
    sizes = rows.groupBy("point", "profile").agg(F.count("*").alias("size")).where("size > 4")
    out = rows.join(sizes, ["point", "profile"]).join(base, ["point", "profile"])
    return out.select("point", "profile", "mainstem", "seq", "cell", "area", (F.col("elevation") - F.col("base")).alias("elevation"), "de")


def profile_chi(profiles: DataFrame, theta: float) -> DataFrame:
    """Profiles with chi: the sum of A ** -theta times de over the cells before."""
    before = Window.partitionBy("point", "profile").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return profiles.withColumn("chi", F.coalesce(F.sum(F.pow("area", F.lit(-theta)) * F.col("de")).over(before), F.lit(0.0)))


def ks_theta_of_profiles(profiles: DataFrame, tributaries: bool = True, seed: int | None = None) -> DataFrame:
    """(point, kind, ks, theta, r2) for the mainstem and, pooled, the tributaries of each outlet; zeros where a fit fails.

    A seed starts the search at random in (0, 1) instead of 0.5.
    """
    rows = profiles if tributaries else profiles.where("mainstem")

    def run(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        parts = [p.sort_values("seq") for _, p in t.groupby("profile")]
        e = np.concatenate([p["elevation"].to_numpy() for p in parts])

        def chi(theta: float) -> np.ndarray:
            return np.concatenate([np.concatenate(([0.0], np.cumsum((p["area"].to_numpy() ** -theta * p["de"].to_numpy())[:-1]))) for p in parts])

        start = 0.5 if seed is None else float(np.random.default_rng([seed, int(key[0])]).random())
        theta, ss, settled = numeric.nelder_mead(lambda x: numeric.through_origin(chi(x), e)[1] if abs(x) <= 10 else np.inf, start)
        total = float(((e - e.mean()) ** 2).sum())
        k = numeric.through_origin(chi(theta), e)[0]
        ok = settled and total > 0
        return pd.DataFrame({"point": [key[0]], "kind": ["mainstem" if key[1] else "tributaries"], "ks": [k if ok else 0.0], "theta": [theta if ok else 0.0], "r2": [1 - ss / total if ok else 0.0]})

    return rows.groupBy("point", "mainstem").applyInPandas(run, "point long, kind string, ks double, theta double, r2 double")


def chi_map(elevation: Grid, directions: Grid, area: Grid, outlet: DataFrame, minimum_area: float = 1e6, theta: float = 0.5, start_at: float = 0.0, downstream: bool = True, Ao: float = 1e6) -> DataFrame:
    """(point, row, col, chi, elevation) above each outlet: a step adds (Ao / A) ** theta times its length, signed."""
    geo = elevation.geo
    tree = checkpointed(upstream_tree(directions, outlet, {"area": area, "elevation": elevation}).where(F.col("parent").isNull() | (F.col("area") >= minimum_area)))
    length = geo.dimension(geo.row_at(F.col("parent"))) * F.when(F.col("step_scale") > 1, DIAGONAL_PATH).otherwise(1.0) * (1.0 if downstream else -1.0)
    step = F.when(F.col("parent").isNull(), 0.0).otherwise(F.pow(F.lit(float(Ao)) / F.col("area"), F.lit(theta)) * length)
    nodes = tree.select(F.struct("point", "cell").alias("id"), F.when(F.col("parent").isNotNull(), F.struct(F.col("point"), F.col("parent").alias("cell"))).alias("j"), step.alias("chi"))
    sums = doubling.path_sum(nodes, ["chi"]).select(F.col("id.point").alias("point"), F.col("id.cell").alias("cell"), (F.col("chi") + start_at).alias("chi"))
    base = tree.where("parent is null").select("point", F.col("elevation").alias("base"))
    return tree.join(sums, ["point", "cell"]).join(base, "point").select("point", "row", "col", "chi", (F.col("elevation") - F.col("base")).alias("elevation"))


def downstream_profile(elevation: Grid, directions: Grid, starts: DataFrame, downstream: bool = True, start_at: float = 0.0) -> DataFrame:
    """(point, seq, row, col, length, elevation) along the way down from each start; upstream, lengths fall from ``start_at``."""
    from talusgrid.operators.flow import downstream_paths

    path = downstream_paths(directions, starts).join(elevation.renamed("elevation"), ["row", "col"], "left")
    return path.select("point", "seq", "row", "col", (F.col("distance") * (1.0 if downstream else -1.0) + start_at).alias("length"), "elevation")


def upstream_profile(elevation: Grid, directions: Grid, area: Grid, outlets: DataFrame, minimum_area: float = 1e6, start_at: float = 0.0, downstream: bool = False) -> DataFrame:
    """(point, row, col, chi, elevation) above each outlet with the length of the way as ``chi``."""
    return chi_map(elevation, directions, area, outlets, minimum_area, 0.0, start_at, downstream, 1.0)


def profile_segments(tree: DataFrame, x: str, y: str) -> DataFrame:
    """(point, cell, x0, y0, x1, y1) from each parent to its child, for drawing."""
    above = tree.select("point", F.col("cell").alias("parent"), F.col(x).alias("x0"), F.col(y).alias("y0"))
    return tree.join(above, ["point", "parent"]).select("point", "cell", "x0", "y0", F.col(x).alias("x1"), F.col(y).alias("y1"))


def hypsometry_of_outlets(elevation: Grid, directions: Grid, outlets: DataFrame) -> DataFrame:
    """(point, hi) of what drains to each outlet."""
    from talusgrid.operators.flow import upstream
    from talusgrid.operators.windows import hypsometric_integral

    return hypsometric_integral(upstream(directions, outlets).join(elevation.cells, ["row", "col"]), "point")


def restored_elevation(directions: Grid, elevation: Grid, area: Grid, theta: float, ks: float, outlets: DataFrame, iterations: int, fix_external: bool = True) -> tuple[Grid, Grid, list[float]]:
    """Elevations that rise from the outlets by ks A ** -theta for each unit of length; divides move between rounds.

    z(up) = z(down) + step ks A(down) ** -theta. After each round a cell that nothing flows into
    captures its higher neighbours, outlets' areas are gathered anew, and the
    mean squared change is noted. Of several leaves the lowest captures. Returns elevation, directions and the changes.
    """
    from talusgrid.operators.accumulate import area as gather
    from talusgrid.operators.flow import DIRECTIONS, divides, upstream_mask
    from talusgrid.operators.neighbours import EIGHT, shifted

    geo = elevation.geo
    ids = checkpointed(outlet_ids(directions, outlets).select("id").distinct())
    external = upstream_mask(directions, outlets)
    rim = shifted(external, EIGHT)
    edge = F.greatest(*[F.when(F.col(n).isNull() | (F.col(n) == 0), 1.0).otherwise(0.0) for n, _, _ in EIGHT])
    outer = Grid(checkpointed(rim.select("row", "col", F.when(F.col("value") == 1, edge).otherwise(1.0).alias("value"))), geo)
    z, codes, drained, changes = elevation, directions, area, []
    for _ in range(iterations):
        step = geo.dimension() * F.when(F.col("code").isin(2, 8, 32, 128), DIAGONAL_PATH).otherwise(1.0)
        links = edges(codes).select(F.col("src").alias("id"), F.col("dst").alias("j"), step.alias("step"))
        below = _cells(drained, "a").select(F.col("id").alias("j"), "a")
        rise = links.join(below, "j").select("id", "j", (F.col("step") * F.lit(float(ks)) * F.pow("a", F.lit(-theta))).alias("dz"))
        cells = z.cells.select(geo.cell_id().alias("id"), F.col("value").alias("z"))
        nodes = cells.join(rise, "id", "left").join(ids.withColumn("end", F.lit(True)), "id", "left").select("id", F.when(F.col("end").isNull(), F.col("j")).alias("j"), F.when(F.col("end"), F.col("z")).otherwise(F.coalesce("dz", F.lit(0.0))).alias("dz"))
        raised = doubling.path_to(nodes, ["dz"], ids).select("id", "dz")
        new = checkpointed(cells.join(raised, "id", "left").select(geo.row_at(F.col("id")).alias("row"), geo.col_at(F.col("id")).alias("col"), F.coalesce("dz", "z").alias("value"), F.col("z").alias("old")))
        changes.append(float(new.agg(F.avg(F.pow(F.col("value") - F.col("old"), F.lit(2)))).first()[0] or 0.0))
        z = Grid(new.select("row", "col", "value"), geo)
        leaf = divides(codes, margin=False).cells.where("value = 1").select("row", "col", F.lit(True).alias("leaf"))
        known = z.cells.join(leaf, ["row", "col"], "left").join(outer.renamed("rim"), ["row", "col"])
        known = known.select("row", "col", F.struct(F.col("value").alias("z"), F.coalesce("leaf", F.lit(False)).alias("leaf"), (F.col("rim") == 0).alias("free")).alias("value"))
        here = F.col("value")
        takes = [F.when(F.col(n)["leaf"] & (F.col(n)["z"] < here["z"]) & (F.lit(not fix_external) | (F.col(n)["free"] & here["free"])), F.struct((here["z"] - F.col(n)["z"]).alias("w"), F.lit(code).alias("code"))) for n, code, _, _ in DIRECTIONS]
        turned = shifted(Grid(known, geo), EIGHT).select("row", "col", F.greatest(*takes)["code"].alias("new")).where("new is not null")
        codes = Grid(checkpointed(codes.cells.join(turned, ["row", "col"], "left").select("row", "col", F.coalesce("new", "value").cast("short").alias("value"))), geo)
        drained = Grid(checkpointed(gather(codes, z).cells), geo)
    return z, codes, changes

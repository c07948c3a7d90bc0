"""Moving windows, discs, local relief, quadrats, histograms and other aggregates over cells."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talusgrid.grid import Grid
from talusgrid.operators.neighbours import kernel_stats, tiled, under_kernel

Offsets = list[tuple[int, int, float]]


def rectangle(radius: float, dx: float) -> Offsets:
    """All offsets of up to round(radius / dx) cells either way."""
    n = round(radius / dx)
    return [(i, j, 1.0) for i in range(-n, n + 1) for j in range(-n, n + 1)]


def disc(radius: float, dx: float, closed: bool = False) -> Offsets:
    """Offsets nearer than the radius (or, closed, as near)."""
    n = math.ceil(radius / dx)
    near = lambda i, j: (d := dx * math.hypot(i, j)) < radius or closed and d <= radius
    return [(i, j, 1.0) for i in range(-n, n + 1) for j in range(-n, n + 1) if near(i, j)]


def moving_window(grid: Grid, offsets: Offsets, function: str | Column | Callable[[pd.Series], float]) -> Grid:
    """A function of the values under the offsets, for every cell that has any; gaps and the outside are left out.

    ``function`` names a built-in aggregate, is an aggregate Column over ``v`` (and the weight
    ``k``), or is a Python function of a pandas Series.
    """
    if callable(function) and not isinstance(function, Column):
        return _python_window(grid, offsets, function)
    if isinstance(function, str) and function in ("avg", "mean", "sum", "min", "max") and dict(grid.cells.dtypes)["value"] == "double":
        mean = function in ("avg", "mean")
        found = kernel_stats(grid, [(i, j, 1.0) for i, j, _ in offsets], ["sum" if mean else function])
        found = found.select("row", "col", (F.col("sum") / F.col("n") if mean else F.col(function)).alias("value"))
        return Grid(grid.cells.select("row", "col").join(found, ["row", "col"], "left"), grid.geo)
    aggregate = function if isinstance(function, Column) else F.expr(f"{function}(v)")
    found = under_kernel(grid, offsets, [aggregate.alias("value")])
    return Grid(grid.cells.select("row", "col").join(found, ["row", "col"], "left"), grid.geo)


def _python_window(grid: Grid, offsets: Offsets, call: Callable[[pd.Series], float]) -> Grid:
    """A Python function of the values around each cell, a tile with its halo at a time."""
    di, dj = (np.asarray([o[k] for o in offsets]) for k in (0, 1))
    pad = int(max(np.abs(di).max(), np.abs(dj).max()))

    def run(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(cells["row"].min()) - pad, int(cells["col"].min()) - pad
        r, c = cells["row"].to_numpy() - r0, cells["col"].to_numpy() - c0
        z = np.full((r.max() + pad + 1, c.max() + pad + 1), np.nan)
        z[r, c] = cells["value"].to_numpy()
        own = cells["own"].to_numpy()
        out = np.full(int(own.sum()), np.nan)
        for n, (i, j) in enumerate(zip(r[own], c[own], strict=True)):
            v = z[i + di, j + dj]
            v = v[~np.isnan(v)]
            if len(v):
                out[n] = call(pd.Series(v))
        return cells.loc[own, ["row", "col"]].assign(value=out)

    dealt = tiled(grid.cells.select("row", "col", "value"), pad, pad).groupBy("tr", "tc").applyInPandas(run, "row long, col long, value double")
    return Grid(dealt.select("row", "col", F.when(~F.isnan("value"), F.col("value")).alias("value")), grid.geo)


def rectangular_mean(grid: Grid, radius: float) -> Grid:
    """The mean over a square window, as two passes of running sums in one tile shuffle."""
    n = round(radius / grid.geo.dx)
    cells = tiled(grid.cells.select("row", "col", "value"), n, n)
    across = Window.partitionBy("tr", "tc", "row").orderBy("col").rangeBetween(-n, n)
    down = Window.partitionBy("tr", "tc", "col").orderBy("row").rangeBetween(-n, n)
    sums = cells.withColumns({"s": F.sum("value").over(across), "c": F.count("value").over(across)})
    sums = sums.withColumns({"s": F.sum("s").over(down), "c": F.sum("c").over(down)}).where("own")
    return Grid(sums.select("row", "col", F.try_divide("s", "c").alias("value")), grid.geo)


def disc_mean(grid: Grid, distance: float, bands: Sequence[str] = ("value",)) -> Grid:
    """The mean within a distance on the periodic grid, of each band.

    The disc is drawn around the grid's middle, (nx / 2, ny / 2) in cells, which lies half a
    cell off the centres of an odd number of cells, and shifted to each cell.
    """
    geo, d = grid.geo, distance / grid.geo.dx
    oi, oj = geo.ny / 2 - geo.ny // 2, geo.nx / 2 - geo.nx // 2
    n = math.ceil(d) + 1
    offsets = [(i, j, 1.0) for i in range(-n, n + 1) for j in range(-n, n + 1) if math.hypot(i - oi, j - oj) <= d]
    out = None
    for band in bands:
        part = kernel_stats(grid, [(-i, -j, k) for i, j, k in offsets], ["sum"], wrap=True, band=band).select("row", "col", (F.col("sum") / F.col("n")).alias(band))
        out = part if out is None else out.join(part, ["row", "col"], "full")
    return Grid(out, geo)


def relief_offsets(radius: int) -> Offsets:
    """Offsets -r .. r - 1 on either axis with di^2 + dj^2 <= r^2: one cell short to the south and east."""
    return [(i, j, 1.0) for i in range(-radius, radius) for j in range(-radius, radius) if i * i + j * j <= radius * radius]


def mirrored(grid: Grid, pad: int) -> Grid:
    """The grid with ``pad`` rows and columns mirrored around it, the edge cells repeated."""
    geo = grid.geo

    def images(c: str, n: int) -> Column:
        here = F.col(c)
        low = F.when(here < pad, -here - 1)
        high = F.when(here >= n - pad, 2 * n - 1 - here)
        return F.array_compact(F.array(here, low, high))

    cells = grid.cells.withColumn("row", F.explode(images("row", geo.ny))).withColumn("col", F.explode(images("col", geo.nx)))
    return Grid(cells, geo)


def local_relief(grid: Grid, radius: int) -> Grid:
    """Largest minus smallest value under the footprint, the grid mirrored at its edges."""
    found = kernel_stats(mirrored(grid, radius), relief_offsets(radius), ["min", "max"])
    return Grid(found.select("row", "col", (F.col("max") - F.col("min")).alias("value")), grid.geo)


def template_count(mask: Grid, template: DataFrame) -> Grid:
    """How many cells of the mask lie under the template (di, dj, weight) on the periodic grid, rounded."""
    offsets = [(r.di, r.dj, r.weight) for r in template.collect()]  # a kernel, small by nature
    return Grid(kernel_stats(mask, offsets, ["sum"], wrap=True).select("row", "col", F.round("sum").alias("value")), mask.geo)


def valid_orientations(counts: DataFrame, margin: int, geo, drop_extremes: bool = True) -> DataFrame:
    """Least and largest orientation by cell whose count under the template differs from the largest of all.

    ``counts`` has (row, col, orientation, value). The first and last orientation are left out
    if asked, and cells within ``margin`` of the border have none.
    """
    top = counts.agg(F.max("value").alias("top"))
    inner = (F.col("row") >= margin) & (F.col("row") < geo.ny - margin) & (F.col("col") >= margin) & (F.col("col") < geo.nx - margin)
    rows = counts.join(F.broadcast(top))
    if drop_extremes:
        ends = counts.agg(F.min("orientation").alias("lo"), F.max("orientation").alias("hi"))
        rows = rows.join(F.broadcast(ends)).where("orientation > lo and orientation < hi")
    good = F.when(inner & (F.col("value") != F.col("top")), F.col("orientation"))
    return rows.groupBy("row", "col").agg(F.min(good).alias("least"), F.max(good).alias("largest"))


# -- aggregates ----------------------------------------------------------------------------


def quadrats(grid: Grid, nx: int, ny: int | None = None) -> DataFrame:
    """The cells of whole ny x nx blocks with their block's first row and column (qrow, qcol)."""
    ny = ny or nx
    blocks = grid.cells.withColumns({"qrow": F.floor(F.col("row") / ny) * ny, "qcol": F.floor(F.col("col") / nx) * nx})
    return blocks.where((F.col("qrow") <= grid.geo.ny - ny) & (F.col("qcol") <= grid.geo.nx - nx))


def map_quadrats(grid: Grid, nx: int, ny: int | None = None, **aggregates: Column) -> DataFrame:
    """Aggregates by quadrat, with the centre of each; built-in aggregates run without leaving the JVM."""
    ny = ny or nx
    out = quadrats(grid, nx, ny).groupBy("qrow", "qcol").agg(*[c.alias(n) for n, c in aggregates.items()])
    return out.withColumns({"center_row": F.col("qrow") + ny / 2, "center_col": F.col("qcol") + nx / 2})


def map_quadrats_python(grid: Grid, function: Callable[[pd.DataFrame], float], nx: int, ny: int | None = None) -> DataFrame:
    """Any Python function of a quadrat's cells (row, col, value)."""

    def run(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"qrow": [key[0]], "qcol": [key[1]], "value": [float(function(cells.sort_values(["row", "col"])))]})

    return quadrats(grid, nx, ny).groupBy("qrow", "qcol").applyInPandas(run, "qrow long, qcol long, value double")


def _bin(x: Column, edges: Sequence[float]) -> Column:
    """Half-open bins, the last one closed; NULL outside."""
    bin_ = F.lit(None).cast("int")
    for i in range(len(edges) - 1):
        upper = x <= edges[i + 1] if i == len(edges) - 2 else x < edges[i + 1]
        bin_ = F.when((x >= edges[i]) & upper, i).otherwise(bin_)
    return bin_


def histogram_2d(pairs: DataFrame, x_edges: Sequence[float], y_edges: Sequence[float], x: str = "x", y: str = "y") -> DataFrame:
    """(bx, by, n) for all bins of the two axes, zeros included."""
    spark = pairs.sparkSession
    counts = pairs.select(_bin(F.col(x), x_edges).alias("bx"), _bin(F.col(y), y_edges).alias("by")).where("bx is not null and by is not null").groupBy("bx", "by").count()
    every = spark.range((len(x_edges) - 1) * (len(y_edges) - 1)).select(F.floor(F.col("id") / (len(y_edges) - 1)).cast("int").alias("bx"), (F.col("id") % (len(y_edges) - 1)).cast("int").alias("by"))
    return every.join(counts, ["bx", "by"], "left").select("bx", "by", F.coalesce("count", F.lit(0)).alias("n"))


def data_extent(grid: Grid) -> DataFrame:
    """One row: rows, columns, x and y of the smallest box with all data."""
    box = grid.cells.where("value is not null").agg(F.min("row").alias("row0"), F.max("row").alias("row1"), F.min("col").alias("col0"), F.max("col").alias("col1"))
    return box.withColumns({"xmin": grid.geo.x("col0"), "xmax": grid.geo.x("col1"), "ymin": grid.geo.y("row1"), "ymax": grid.geo.y("row0")})


def hypsometric_integral(cells: DataFrame, *by: str) -> DataFrame:
    """(mean - min) / (max - min) of ``value`` over all rows, or by group."""
    hi = F.try_divide(F.avg("value") - F.min("value"), F.max("value") - F.min("value")).alias("hi")
    return cells.groupBy(*by).agg(hi)


def sum_of_squares(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """Squared deviations from the mean, by group."""
    return rows.groupBy(*by).agg((F.var_pop(value) * F.count(value)).alias("ss"))


def pair_values(x: Grid, y: Grid, ignore_zeros: bool = False) -> DataFrame:
    """(row, col, x, y) where both grids have data; without zeros if asked, else with y >= 0."""
    both = x.renamed("x").join(y.renamed("y"), ["row", "col"]).where("x is not null and y is not null")
    return both.where("x <> 0 and y <> 0") if ignore_zeros else both.where("y >= 0")


def scatter(x: Grid, y: Grid, every: int = 1, cells: DataFrame | None = None) -> DataFrame:
    """Pairs of data in both grids, of given cells if any; each ``every``-th in row order by position."""
    both = x.renamed("x").join(y.renamed("y"), ["row", "col"]).where("x is not null and y is not null")
    both = both if cells is None else both.join(cells.select("row", "col").distinct(), ["row", "col"], "left_semi")
    # thinning by place needs no global order
    return both if every <= 1 else both.where((F.col("row") * x.geo.nx + F.col("col")) % every == 0)

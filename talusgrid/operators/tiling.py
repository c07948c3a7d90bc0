"""Tiles with halos, clipping, mosaics and resampling."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import replace
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talusgrid.grid import Georef, Grid


def tiles(grid: Grid, xdim: int = 400, ydim: int = 400, xpad: int = 10, ypad: int = 10) -> DataFrame:
    """(tile_col, tile_row, row, col, value) of every tile with its padding; row and col count from its padded corner.

    Padding beyond the grid mirrors it, edge cells repeated: each padded place looks up its
    reflected cell, so that all tiles can be stripped and put together again without gaps.
    """
    geo = grid.geo

    def places(c: str, n: int, dim: int, pad: int) -> Column:
        """Tiles and places of a cell along an axis: its own, in halos, and mirrored ones."""
        here = F.col(c)
        images = F.array_compact(F.array(here, F.when(here < pad, -here - 1), F.when(here >= n - pad, 2 * n - 1 - here)))
        count = math.ceil(n / dim)
        reach = lambda p: F.transform(
            F.sequence(F.greatest(F.floor((p - pad) / dim), F.lit(0)).cast("long"), F.least(F.floor((p + pad) / dim), F.lit(count - 1)).cast("long")), lambda t: F.struct(t.alias("t"), (p - t * dim + pad).alias("p"))
        )
        inside = lambda s: (s["p"] >= 0) & (s["p"] < F.least(F.lit(dim), n - s["t"] * dim) + 2 * pad)
        return F.filter(F.flatten(F.transform(images, reach)), inside)

    rows = grid.cells.withColumn("r", F.explode(places("row", geo.ny, ydim, ypad))).withColumn("c", F.explode(places("col", geo.nx, xdim, xpad)))
    return rows.select(F.col("c.t").alias("tile_col"), F.col("r.t").alias("tile_row"), F.col("r.p").alias("row"), F.col("c.p").alias("col"), "value")


def tile_georef(geo: Georef, tile_row: int, tile_col: int, xdim: int, ydim: int, xpad: int = 0, ypad: int = 0) -> Georef:
    ny, nx = min(ydim, geo.ny - tile_row * ydim), min(xdim, geo.nx - tile_col * xdim)
    return geo.window(tile_row * ydim - ypad, tile_col * xdim - xpad, ny + 2 * ypad, nx + 2 * xpad)


def one_tile(parts: DataFrame, geo: Georef, tile_row: int, tile_col: int, xdim: int, ydim: int, xpad: int, ypad: int) -> Grid:
    cells = parts.where((F.col("tile_row") == tile_row) & (F.col("tile_col") == tile_col))
    return Grid(cells.select("row", "col", "value"), tile_georef(geo, tile_row, tile_col, xdim, ydim, xpad, ypad))


def remove_padding(grid: Grid, xpad: int = 10, ypad: int = 10) -> Grid:
    """Without so many rows and columns on each side; all bands stay."""
    return window(grid, ypad, xpad, grid.geo.ny - 2 * ypad, grid.geo.nx - 2 * xpad)


def window(grid: Grid, row0: int, col0: int, ny: int, nx: int) -> Grid:
    """A block of the grid with its own row and column numbers."""
    inside = (F.col("row") >= row0) & (F.col("row") < row0 + ny) & (F.col("col") >= col0) & (F.col("col") < col0 + nx)
    cells = grid.cells.where(inside).withColumns({"row": F.col("row") - row0, "col": F.col("col") - col0})
    return Grid(cells, grid.geo.window(row0, col0, ny, nx))


def clip_to_extent(grid: Grid, extent: tuple[float, float, float, float]) -> Grid:
    """Within (xmin, xmax, ymin, ymax) after it shrinks by a pixel on each side.

    Of the corners' cells the rows below the upper one, down to the lower one, and the columns
    from the left one up to but without the right one are kept. Bands such as donor ids move
    along unchanged.
    """
    xmin, xmax, ymin, ymax = extent
    dx = grid.geo.dx
    low, high = grid.geo.cell(xmin + dx, ymin + dx), grid.geo.cell(xmax - dx, ymax - dx)
    if low is None or high is None:
        from talusgrid.errors import InputError

        raise InputError("extent", "it must lie within the grid")
    row0, row1, col0, col1 = high[0] + 1, low[0] + 1, low[1], high[1]
    return window(grid, row0, col0, max(row1 - row0, 0), max(col1 - col0, 0))


def clip_to_bounds(grid: Grid, bounds: tuple[tuple[float, float], tuple[float, float]]) -> Grid:
    """Within the box of two corners ((xmin, ymin), (xmax, ymax))."""
    (x0, y0), (x1, y1) = bounds
    return clip_to_extent(grid, (x0, x1, y0, y1))


def clip_to_mask(grid: Grid, mask: Grid) -> Grid:
    """Bilinear values of the grid at the mask's cells, all on one projection; no data where one of the four is missing."""
    return bilinear(grid, mask.geo)


def clip_to_polygons(grid: Grid, polygons: DataFrame) -> Grid:
    """The grid with no data outside polygons (a table of vertices as in ``sources.vector``)."""
    from talusgrid.sources.vector import rasterize

    inside = rasterize(polygons, grid.geo).cells.where("value = 1").select("row", "col", F.lit(True).alias("inside"))
    return Grid(grid.cells.join(inside, ["row", "col"], "left").select("row", "col", F.when(F.col("inside"), F.col("value")).alias("value")), grid.geo)


def mosaic(grids: Sequence[Grid]) -> Grid:
    """The union of the grids' extents; where they overlap the last one holds, with or without data."""
    dx = grids[0].geo.dx
    boxes = [g.geo.bounds for g in grids]
    x0, x1, y0, y1 = min(b[0] for b in boxes), max(b[1] for b in boxes), min(b[2] for b in boxes), max(b[3] for b in boxes)
    geo = replace(grids[0].geo, nx=round((x1 - x0) / dx) + 1, ny=round((y1 - y0) / dx) + 1, xll=x0, yll=y0)
    bands = grids[0].bands
    out = None
    for i, g in enumerate(grids):
        di, dj = round((y1 - g.geo.bounds[3]) / dx), round((g.geo.bounds[0] - x0) / dx)
        part = g.dense().cells.select((F.col("row") + di).alias("row"), (F.col("col") + dj).alias("col"), F.struct(*bands).alias("v"), F.lit(i).alias("i"))
        out = part if out is None else out.unionByName(part)
    last = out.groupBy("row", "col").agg(F.max_by("v", "i").alias("v"))
    return Grid(geo.frame(grids[0].spark).join(last, ["row", "col"], "left").select("row", "col", *[F.col(f"v.{b}").alias(b) for b in bands]), geo)


def merge_tiles(parts: DataFrame, geo: Georef, xdim: int, ydim: int, xpad: int, ypad: int) -> Grid:
    """The grid of all stripped tiles of ``tiles``."""
    row, col = F.col("row") - ypad, F.col("col") - xpad
    own = (row >= 0) & (row < F.least(F.lit(ydim), geo.ny - F.col("tile_row") * ydim)) & (col >= 0) & (col < F.least(F.lit(xdim), geo.nx - F.col("tile_col") * xdim))
    return Grid(parts.where(own).select((F.col("tile_row") * ydim + row).alias("row"), (F.col("tile_col") * xdim + col).alias("col"), "value"), geo)


def _weighted(grid: Grid, target: Georef, taps: int, weight) -> Grid:
    """Values at the target's cells from ``taps`` x ``taps`` cells around each place.

    A source cell is joined to the target cells it weighs in, by an equi-join on the cells
    around a place; where one of them is missing there is no data.
    """
    geo = grid.geo
    frame = target.frame(grid.spark)
    fx, fy = (target.x() - F.lit(geo.xll)) / F.lit(geo.dx), F.lit(geo.ny - 1) - (target.y() - F.lit(geo.yll)) / F.lit(geo.dx)
    frame = frame.withColumns({"fx": F.round(fx, 9), "fy": F.round(fy, 9)}).where(f"fx >= 0 and fx <= {geo.nx - 1} and fy >= 0 and fy <= {geo.ny - 1}")
    first = 1 - taps // 2
    base = {"bx": F.least(F.floor("fx"), F.lit(max(geo.nx - 2, 0))), "by": F.least(F.floor("fy"), F.lit(max(geo.ny - 2, 0)))}
    frame = frame.withColumns(base)
    at = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(first, first + taps) for j in range(first, first + taps)])
    needed = frame.withColumn("o", F.explode(at)).withColumn("w", weight(F.col("fy") - F.col("by"), F.col("o.i")) * weight(F.col("fx") - F.col("bx"), F.col("o.j"))).where("w <> 0")
    clamp = lambda v, n: F.least(F.greatest(v, F.lit(0)), F.lit(n - 1)).cast("long")
    needed = needed.select(F.col("row").alias("trow"), F.col("col").alias("tcol"), clamp(F.col("by") + F.col("o.i"), geo.ny).alias("row"), clamp(F.col("bx") + F.col("o.j"), geo.nx).alias("col"), "w")
    joined = needed.join(grid.cells.select("row", "col", "value"), ["row", "col"], "left")
    value = F.when(F.count("*") == F.count("value"), F.sum(F.col("value") * F.col("w")))
    out = joined.groupBy(F.col("trow").alias("row"), F.col("tcol").alias("col")).agg(value.alias("value"))
    return Grid(target.frame(grid.spark).join(out, ["row", "col"], "left"), target)


def bilinear(grid: Grid, target: Georef) -> Grid:
    return _weighted(grid, target, 2, lambda t, k: F.when(k == 0, 1.0 - t).otherwise(t))


def cubic(grid: Grid, target: Georef) -> Grid:
    """Keys' cubic convolution (a = -1/2), the edge repeated."""

    def weight(t: Column, k: Column) -> Column:
        x = F.abs(t - k)
        return F.when(x <= 1, (x * 1.5 - 2.5) * x * x + 1.0).when(x < 2, ((x * -0.5 + 2.5) * x - 4.0) * x + 2.0).otherwise(0.0)

    return _weighted(grid, target, 4, weight)


#: Cells of a task that resamples whole lines, and lines in it, at most (one line at least).
LINE_CELLS, LINES = 1 << 22, 64


def _basis(x: np.ndarray, knots: np.ndarray, degree: int) -> tuple[np.ndarray, np.ndarray]:
    """The first of the degree + 1 B-splines that aren't zero at each place, and their values."""
    span = np.clip(np.searchsorted(knots, x, side="right") - 1, degree, len(knots) - degree - 2)
    values = np.ones((len(x), 1))
    for d in range(1, degree + 1):
        # knots around the place: d below and d above
        low, high = (knots[span[:, None] + np.arange(1 - d, 1) + k] for k in (0, d))
        share = values / (high - low)
        values = np.zeros((len(x), d + 1))
        values[:, :-1] += (high - x[:, None]) * share
        values[:, 1:] += (x[:, None] - low) * share
    return span - degree, values


@cache
def _spline(n: int, degree: int) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the spline through n values at 0 .. n - 1 (not-a-knot ends), and its banded equations, factored.

    Row i of the band holds the columns i - degree .. i + degree, the lower half as multipliers.
    The equations are totally positive, so no rows change places.
    """
    half = (degree + 1) // 2
    knots = np.concatenate([np.zeros(degree + 1), np.arange(half, n - half, dtype=float), np.full(degree + 1, n - 1.0)])
    first, values = _basis(np.arange(n, dtype=float), knots, degree)
    band = np.zeros((n + degree, 2 * degree + 1))  # rows past the end keep the loop plain
    for k in range(degree + 1):
        band[np.arange(n), first + k - np.arange(n) + degree] = values[:, k]
    for i in range(n):
        right = band[i, degree + 1 :]
        for d in range(1, degree + 1):
            times = band[i + d, degree - d] / band[i, degree]
            if times:
                band[i + d, degree - d] = times
                band[i + d, degree - d + 1 : 2 * degree - d + 1] -= times * right
    return knots, band[:n]


def _along_spline(values: np.ndarray, places: np.ndarray, degree: int) -> np.ndarray:
    """Lines of values (n x lines) at other places, by splines of odd degree, or of the largest that n values allow."""
    n = len(values)
    degree = min(degree, n - 1 - n % 2)
    if degree < 1:
        return np.repeat(values, len(places), axis=0)
    knots, band = _spline(n, degree)
    x = np.concatenate([np.zeros((degree, values.shape[1])), values, np.zeros((degree, values.shape[1]))])
    for i in range(n):
        x[i + degree] -= band[i, :degree] @ x[i : i + degree]
    for i in range(n - 1, -1, -1):
        x[i + degree] = (x[i + degree] - band[i, degree + 1 :] @ x[i + degree + 1 : i + 2 * degree + 1]) / band[i, degree]
    first, weights = _basis(places, knots, degree)
    out = np.zeros((len(places), values.shape[1]))
    for k in range(degree + 1):
        out += weights[:, k, None] * x[first + k + degree]
    out[:, np.isnan(values).any(axis=0)] = np.nan
    return out


def resample(grid: Grid, de: float, interpolation: str = "quintic") -> Grid:
    """The grid at another spacing: round(n dx / de) cells on each axis, by linear, cubic or quintic splines.

    Splines are separable, so rows are resampled apart, then columns; a task holds some whole
    lines. A line with a gap has no data, and so splines of a grid with a gap have none anywhere.
    """
    geo = grid.geo
    nx, ny = round(geo.nx * geo.dx / de), round(geo.ny * geo.dx / de)
    target = replace(geo, nx=nx, ny=ny, dx=de)
    if interpolation == "linear":
        return bilinear(grid, target)
    degree = {"cubic": 3, "quintic": 5}[interpolation]

    def along(line: str, at: str, n: int, places: np.ndarray, flip: bool):
        def run(cells: pd.DataFrame) -> pd.DataFrame:
            lines, own = np.unique(cells[line].to_numpy(), return_inverse=True)
            values = np.full((n, len(lines)), np.nan)
            values[cells[at].to_numpy(), own] = cells["value"].to_numpy()
            out = _along_spline(values[::-1] if flip else values, places, degree)
            out = out[::-1] if flip else out
            return pd.DataFrame({line: np.repeat(lines, len(out)), at: np.tile(np.arange(len(out)), len(lines)), "value": out.T.ravel()})

        return run

    def blocks(line: str, n: int) -> Column:
        return F.floor(F.col(line) / max(1, min(LINES, LINE_CELLS // n)))

    xs, ys = np.minimum(np.arange(nx) * de / geo.dx, geo.nx - 1), np.minimum(np.arange(ny) * de / geo.dx, geo.ny - 1)
    cells = grid.cells.select("row", "col", "value").groupBy(blocks("row", max(geo.nx, nx))).applyInPandas(along("row", "col", geo.nx, xs, False), "row long, col long, value double")
    cells = cells.groupBy(blocks("col", max(geo.ny, ny))).applyInPandas(along("col", "row", geo.ny, ys, True), "col long, row long, value double")
    return Grid(cells.select("row", "col", F.when(~F.isnan("value"), F.col("value")).alias("value")), target)



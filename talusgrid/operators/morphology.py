"""Binary morphology on grids of 0 and 1 (no data counts as 0)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import functions as F

from talusgrid.grid import Grid
from talusgrid.operators.neighbours import shifted

#: Footprints without their middle: the four and the eight neighbours.
CROSS = ((0, 1), (1, 0), (0, -1), (-1, 0))
SQUARE = (*CROSS, (1, 1), (1, -1), (-1, -1), (-1, 1))


def _step(grid: Grid, structure: Sequence[tuple[int, int]], dilate: bool, border: int) -> Grid:
    offsets = [(f"o{k}", i, j) for k, (i, j) in enumerate(structure)]
    geo = grid.geo
    flat = grid.dense().map(F.coalesce((F.col("value") != 0).cast("double"), F.lit(0.0)))
    cells = shifted(flat, offsets)
    values = [F.coalesce(F.col(n), F.lit(float(border))) for n, _, _ in offsets]
    value = F.greatest(F.col("value"), *values) if dilate else F.least(F.col("value"), *values)
    return Grid(cells.select("row", "col", value.alias("value")), geo)


def dilate(grid: Grid, structure: Sequence[tuple[int, int]] = CROSS, iterations: int = 1, border: int = 0) -> Grid:
    """1 where a cell or one of its neighbours is 1; ``border`` is what lies outside."""
    for _ in range(iterations):
        grid = _step(grid, structure, True, border)
    return grid


def erode(grid: Grid, structure: Sequence[tuple[int, int]] = CROSS, iterations: int = 1, border: int = 0) -> Grid:
    """1 where a cell and all its neighbours are 1."""
    for _ in range(iterations):
        grid = _step(grid, structure, False, border)
    return grid


def opened(grid: Grid, structure: Sequence[tuple[int, int]] = CROSS, iterations: int = 1) -> Grid:
    return dilate(erode(grid, structure, iterations), structure, iterations)


def closed(grid: Grid, structure: Sequence[tuple[int, int]] = CROSS, iterations: int = 1) -> Grid:
    return erode(dilate(grid, structure, iterations), structure, iterations)


def coastline_outlets(elevation: Grid) -> "DataFrame":  # noqa: F821
    """x and y of cells on the ring around land: in the threefold dilation of z > 0 or its threefold erosion, but not in both."""
    land = elevation.map((F.coalesce(F.col("value"), F.lit(0.0)) > 0).cast("double"))
    both = dilate(land, iterations=3).join(erode(land, iterations=3), "inner_land")
    ring = both.cells.where("value + inner_land = 1")
    return ring.select("row", "col", elevation.geo.x().alias("x"), elevation.geo.y().alias("y"))

"""Order, nearest values and snapping of points."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talusgrid.grid import Grid
from talusgrid.runtime import checkpointed, partitions


def sorted_cells(grid: Grid, descending: bool = True, mask: Grid | None = None) -> DataFrame:
    """The cells with data first in the order of their values, ties by position; with the mask, only where it is 1.

    ``rank`` is global from 0. Ranges are sorted apart and their counts added up, so that no
    task sees all cells.
    """
    cells = grid.cells.select("row", "col", "value", grid.geo.cell_id().alias("cell_id"))
    if mask is not None:
        cells = cells.join(mask.cells.where("value = 1").select("row", "col"), ["row", "col"], "left_semi")
    keys = [F.col("value").desc_nulls_last() if descending else F.col("value").asc_nulls_last(), F.col("cell_id")]
    dealt = checkpointed(cells.repartitionByRange(partitions(grid.spark), *keys).withColumn("part", F.spark_partition_id()))
    own = dealt.withColumn("n", F.row_number().over(Window.partitionBy("part").orderBy(*keys)))
    sizes = dealt.groupBy("part").count()
    before = sizes.withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return own.join(F.broadcast(before), "part").select("row", "col", "value", (F.col("before") + F.col("n") - 1).alias("rank"))


def _around(grid: Grid, points: DataFrame, radius: int) -> DataFrame:
    """Cells with data at offsets -r .. r - 1 and no farther than r, by point; offsets off the grid are dropped."""
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-radius, radius) for j in range(-radius, radius) if math.hypot(i, j) <= radius])
    reach = points.withColumn("o", F.explode(offsets)).withColumns({"near_row": F.col("row") + F.col("o.i"), "near_col": F.col("col") + F.col("o.j")}).drop("o", "row", "col")
    reach = reach.where(grid.geo.inside("near_row", "near_col")).withColumnsRenamed({"near_row": "row", "near_col": "col"})
    return reach.join(grid.cells.where("value is not null").select("row", "col", "value"), ["row", "col"])


def nearest_value(grid: Grid, points: DataFrame, value: float, radius: int) -> DataFrame:
    """For each point (point, row, col) the cell whose value is closest, the first in row order of equals."""
    best = F.min_by(F.struct("row", "col", "value"), F.struct(F.abs(F.col("value") - value), F.col("row"), F.col("col")))
    return _around(grid, points.select("point", "row", "col"), radius).groupBy("point").agg(best.alias("b")).select("point", "b.row", "b.col", "b.value")


def nearest_at_least(grid: Grid, points: DataFrame, value: float, radius: int) -> DataFrame:
    """The smallest value of at least the target; where there is none, the largest below it."""
    over, place = F.col("value") >= value, F.struct("row", "col", "value")
    up = F.min_by(F.when(over, place), F.when(over, F.struct(F.col("value"), F.col("row"), F.col("col"))))
    down = F.min_by(F.when(~over, place), F.when(~over, F.struct(-F.col("value"), F.col("row"), F.col("col"))))
    return _around(grid, points.select("point", "row", "col"), radius).groupBy("point").agg(F.coalesce(up, down).alias("b")).select("point", "b.row", "b.col", "b.value")


def greatest_value(grid: Grid, points: DataFrame, radius: int = 5) -> DataFrame:
    """The cell with the largest value, the first in row order of equals."""
    best = F.max_by(F.struct("row", "col", "value"), F.struct(F.col("value"), -F.col("row"), -F.col("col")))
    return _around(grid, points.select("point", "row", "col"), radius).groupBy("point").agg(best.alias("b")).select("point", "b.row", "b.col", "b.value")


def _snapped(grid: Grid, points: DataFrame, found: DataFrame) -> DataFrame:
    return found.select("point", grid.geo.x().alias("x"), grid.geo.y().alias("y"))


def snap_to_greatest(grid: Grid, points: DataFrame, radius: int = 5) -> DataFrame:
    """x and y of the largest value around each point (point, x, y)."""
    return _snapped(grid, points, greatest_value(grid, grid.rowcols(points).where("row is not null"), radius))


def snap_to_closest(grid: Grid, points: DataFrame, value: float, radius: int = 5) -> DataFrame:
    return _snapped(grid, points, nearest_value(grid, grid.rowcols(points).where("row is not null"), value, radius))


def nearest_vertex(path: DataFrame, x: float, y: float) -> DataFrame:
    """The row of a path (seq, x, y) nearest to a point, the first of equals."""
    away: Column = F.struct((F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y), F.col("seq"))
    return path.agg(F.min_by(F.struct("seq", "x", "y"), away).alias("b")).select("b.*")

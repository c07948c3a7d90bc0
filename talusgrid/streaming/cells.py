"""Cells that arrive as a stream: running quadrat statistics and a grid that keeps each cell's latest value.

The batch operators need whole neighbourhoods; these need one cell at a time, so that they work
on a stream with bounded state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def quadrat_windows(cells: DataFrame, nx: int, ny: int, window: str, late: str) -> DataFrame:
    """Count, mean and extremes by quadrat and event-time window of a stream (ts, row, col, value); rows later than ``late`` are dropped by the watermark."""
    rows = cells.withWatermark("ts", late).where("value is not null")
    keyed = rows.groupBy(F.window("ts", window), (F.floor(F.col("row") / ny) * ny).alias("qrow"), (F.floor(F.col("col") / nx) * nx).alias("qcol"))
    return keyed.agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("largest"))


def latest(cells: DataFrame) -> DataFrame:
    """The latest value of each cell, for output mode ``update`` or ``complete``."""
    return cells.groupBy("row", "col").agg(F.max_by("value", "ts").alias("value"), F.max("ts").alias("ts"))

"""Synthetic ridge and valley grids."""

from __future__ import annotations

import math

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from talusgrid.grid import Georef, Grid


def _wave_grid(spark: SparkSession, ny: int, nx: int, wave: Column, amp: float, sig: float, slope_y: float | None, seed: int) -> Grid:
    """amp * wave(col) + N(0, sig) for each cell, raised by the least value's size, times slope_y t (t: 0 to ny) if tilted."""
    geo = Georef(nx, ny)
    cells = geo.frame(spark).withColumn("z", wave * amp + (F.randn(seed) * sig if sig else F.lit(0.0)))
    least = cells.agg(F.abs(F.min("z")).alias("least"))
    z = F.col("z") + F.col("least")
    if slope_y is not None:
        z = z * F.lit(slope_y) * (F.col("row") * (ny / max(ny - 1, 1)))
    return Grid(cells.join(F.broadcast(least)).select("row", "col", z.alias("value")), geo)


def _phase(nx: int, width: float) -> Column:
    """2 pi (nx / width) t with t from 0 to 1 over the columns."""
    return F.col("col") / max(nx - 1, 1) * (2 * math.pi * nx / width)


def sinusoid_grid(spark: SparkSession, ny: int, nx: int, width: float, amp: float = 1.0, sig: float = 0.0, slope_y: float | None = None, seed: int = 0) -> Grid:
    return _wave_grid(spark, ny, nx, F.sin(_phase(nx, width)), amp, sig, slope_y, seed)


def triangle_grid(spark: SparkSession, ny: int, nx: int, width: float, amp: float = 1.0, sig: float = 0.0, slope_y: float | None = None, seed: int = 0) -> Grid:
    """A triangle wave: up from -1 to 1 over the first half of a period and down over the other."""
    part = _phase(nx, width) / (2 * math.pi)
    part = part - F.floor(part)
    return _wave_grid(spark, ny, nx, F.when(part < 0.5, part * 4.0 - 1.0).otherwise(3.0 - part * 4.0), amp, sig, slope_y, seed)

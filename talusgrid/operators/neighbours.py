"""Neighbourhoods without self-joins.

A grid is dealt out in square tiles with a halo: one shuffle. In a tile all shifts are found
from one table of places, and no task holds more than a tile. Gaps in the grid are seen as such.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talusgrid.grid import Grid
from talusgrid.runtime import partitions

#: Side of a tile in cells.
TILE = 256
#: The eight neighbours as (name, row offset, column offset).
EIGHT = (("e", 0, 1), ("se", 1, 1), ("s", 1, 0), ("sw", 1, -1), ("w", 0, -1), ("nw", -1, -1), ("n", -1, 0), ("ne", -1, 1))


def tiled(cells: DataFrame, halo_rows: int, halo_cols: int, tile: int = TILE) -> DataFrame:
    """Each cell in its own tile (``own``), and as halo in every tile within reach; partitioned by tile."""

    def reached(c: str, halo: int) -> Column:
        return F.sequence(F.floor((F.col(c) - halo) / tile), F.floor((F.col(c) + halo) / tile))

    out = cells.withColumn("tr", F.explode(reached("row", halo_rows))) if halo_rows else cells.withColumn("tr", F.floor(F.col("row") / tile))
    out = out.withColumn("tc", F.explode(reached("col", halo_cols))) if halo_cols else out.withColumn("tc", F.floor(F.col("col") / tile))
    own = (F.col("tr") == F.floor(F.col("row") / tile)) & (F.col("tc") == F.floor(F.col("col") / tile))
    return out.withColumn("own", own).repartition(partitions(cells.sparkSession), "tr", "tc")


def shifted(grid: Grid, offsets: Sequence[tuple[str, int, int]], band: str = "value", keep: Iterable[str] = (), tile: int = TILE) -> DataFrame:
    """row, col, the band and the columns ``keep``, and for each (name, drow, dcol) the band's value there, NULL where there is no cell.

    A task has the cells of a tile as Arrow columns, finds the place of each cell's neighbours
    and takes the values from there, whatever their type: nothing is sorted by line.
    """
    keep = [c for c in keep if c != band]
    dr, dc = (max((abs(o[k]) for o in offsets), default=0) for k in (1, 2))
    cells = grid.cells.select("row", "col", band, *keep)
    kind = cells.schema[band].dataType
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in cells.schema] + [T.StructField(name, kind) for name, _, _ in offsets])
    names = [band, *keep]

    def run(cells: pa.Table) -> pa.Table:
        r, c = (cells.column(n).to_numpy() for n in ("row", "col"))
        top, left = r.min() - dr, c.min() - dc
        place = np.full((r.max() - top + dr + 1, c.max() - left + dc + 1), -1)
        place[r - top, c - left] = np.arange(len(r))
        own = np.flatnonzero(cells.column("own").to_numpy())
        r, c = r[own], c[own]
        out = [pa.array(r), pa.array(c), *[cells.column(n).take(pa.array(own)) for n in names]]
        values = cells.column(band).combine_chunks()
        for _, i, j in offsets:
            at = place[r - top + i, c - left + j]
            out.append(values.take(pa.array(at, mask=at < 0)))
        return pa.table(out, names=schema.names)

    return tiled(cells, dr, dc, tile).groupBy("tr", "tc").applyInArrow(run, schema)


def eight(grid: Grid, band: str = "value", keep: Iterable[str] = ()) -> DataFrame:
    return shifted(grid, EIGHT, band, keep)


def under_kernel(grid: Grid, offsets: Sequence[tuple[int, int, float]], aggregates: Sequence[Column], wrap: bool = False, band: str = "value") -> DataFrame:
    """Aggregates by cell over the values under a kernel of (drow, dcol, weight) around it.

    Aggregates refer to ``v`` (a neighbour's value, never NULL), ``k`` (its weight), ``di`` and
    ``dj``. Values are sent to the cells whose kernel they lie under, partly aggregated before
    the shuffle. With ``wrap`` the grid is periodic; else cells outside are left out.
    """
    geo = grid.geo
    kernel = F.array(*[F.struct(F.lit(int(i)).alias("di"), F.lit(int(j)).alias("dj"), F.lit(float(w)).alias("k")) for i, j, w in offsets])
    sent = grid.cells.where(F.col(band).isNotNull()).select("row", "col", F.col(band).alias("v"), F.explode(kernel).alias("o"))
    row, col = F.col("row") - F.col("o.di"), F.col("col") - F.col("o.dj")
    if wrap:
        row, col = F.pmod(row, F.lit(geo.ny).cast("long")), F.pmod(col, F.lit(geo.nx).cast("long"))
    sent = sent.select(row.alias("row"), col.alias("col"), "v", F.col("o.k").alias("k"), F.col("o.di").alias("di"), F.col("o.dj").alias("dj"))
    return sent.where(geo.inside()).groupBy("row", "col").agg(*aggregates)


def _runs(offsets: Sequence[tuple[int, int, float]]) -> list[tuple[int, int, int, float]]:
    """The kernel as runs (drow, first dcol, length, weight) of neighbouring offsets of equal weight."""
    runs: list[list] = []
    for i, k, j in sorted((int(i), float(k), int(j)) for i, j, k in offsets):
        last = runs[-1] if runs else None
        if last and (last[0], last[1] + last[2], last[3]) == (i, j, k):
            last[2] += 1
        else:
            runs.append([i, j, 1, k])
    return [tuple(r) for r in runs]


class _Blocks:
    """Sums, or extremes, of 1, 2, 4 ... values from each column of an array on."""

    def __init__(self, z: np.ndarray, longest: int, join: np.ufunc) -> None:
        self.join, self.of = join, [z]
        while 2 << (len(self.of) - 1) <= longest:
            half, last = 1 << (len(self.of) - 1), self.of[-1]
            self.of.append(join(last[:, :-half], last[:, half:]))

    def over(self, row: int, col: int, length: int, shape: tuple[int, int]) -> np.ndarray:
        """For each cell of ``shape``, the values ``length`` long from (row, col) away of it."""
        part = lambda k, at: self.of[k][row : row + shape[0], at : at + shape[1]]
        top = length.bit_length() - 1
        if self.join is not np.add:  # extremes may overlap
            return self.join(part(top, col), part(top, col + length - (1 << top)))
        out = np.zeros(shape)
        for k in range(top + 1):
            if length >> k & 1:
                out += part(k, col)
                col += 1 << k
        return out


def kernel_stats(grid: Grid, offsets: Sequence[tuple[int, int, float]], stats: Sequence[str], wrap: bool = False, band: str = "value") -> DataFrame:
    """row, col, n and the ``stats`` (sum, weighted; min; max) of the n values under a kernel, where there are any.

    The grid is dealt out once, in tiles with halos as wide as the kernel; in a tile the runs of
    each kernel row are put together from blocks of 1, 2, 4 ... values, so that a cell costs the
    kernel's rows times the logarithm of their length, and nothing is subtracted. Else as
    ``under_kernel``; NaN counts as no data.
    """
    geo, runs = grid.geo, _runs(offsets)
    pr, pc = (max((abs(int(o[k])) for o in offsets), default=0) for k in (0, 1))
    tile, longest = max(TILE, pr, pc), max((r[2] for r in runs), default=1)
    cells = grid.cells.where(F.col(band).isNotNull()).select("row", "col", F.col(band).cast("double").alias("v"))
    if wrap:
        for c, n, pad in (("row", geo.ny, pr), ("col", geo.nx, pc)):
            images = F.sequence(F.ceil((-pad - F.col(c)) / n), F.floor((n - 1 + pad - F.col(c)) / n))
            cells = cells.withColumn("image", F.explode(images)).withColumn(c, F.col(c) + F.col("image") * n).drop("image")

    def run(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        top, left = int(key[0]) * tile, int(key[1]) * tile
        z = np.full((tile + 2 * pr, tile + 2 * pc), np.nan)
        z[cells["row"].to_numpy() - top + pr, cells["col"].to_numpy() - left + pc] = cells["v"].to_numpy()
        there = ~np.isnan(z)
        shape = (tile, tile)
        made = {"n": (_Blocks(there.astype(float), longest, np.add), np.zeros(shape))}
        for s in stats:
            join, none = {"sum": (np.add, 0.0), "min": (np.minimum, np.inf), "max": (np.maximum, -np.inf)}[s]
            made[s] = (_Blocks(np.where(there, z, none), longest, join), np.full(shape, none))
        for i, j, length, weight in runs:
            for s, (blocks, out) in made.items():
                found = blocks.over(pr + i, pc + j, length, shape)
                blocks.join(out, found * weight if s == "sum" and weight != 1 else found, out=out)
        r, c = np.nonzero(made["n"][1] > 0)
        inside = (r + top >= 0) & (r + top < geo.ny) & (c + left >= 0) & (c + left < geo.nx)
        r, c = r[inside], c[inside]
        return pd.DataFrame({"row": r + top, "col": c + left, "n": made["n"][1][r, c].astype(np.int64)} | {s: made[s][1][r, c] for s in stats})

    schema = "row long, col long, n long" + "".join(f", `{s}` double" for s in stats)
    return tiled(cells, pr, pc, tile).drop("own").groupBy("tr", "tc").applyInPandas(run, schema)

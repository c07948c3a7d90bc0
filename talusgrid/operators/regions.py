"""Connected regions of equal values.

Regions are found within tiles first; the few pairs of labels that touch across tile edges are
then joined by star contraction, so that rounds depend on the number of tiles, not of cells.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talusgrid.components import components
from talusgrid.grid import Grid
from talusgrid.operators.doubling import ONE_TASK
from talusgrid.operators.neighbours import EIGHT, TILE, shifted
from talusgrid.runtime import checkpointed


def _label(nx: int, diagonal: bool):
    """Label a tile's cells with the smallest cell id of their region in the tile."""
    steps = [(i, j) for _, i, j in EIGHT if diagonal or not (i and j)]

    def run(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(cells["row"].min()), int(cells["col"].min())
        r, c = cells["row"].to_numpy() - r0, cells["col"].to_numpy() - c0
        z = np.full((r.max() + 3, c.max() + 3), np.nan)
        z[r + 1, c + 1] = cells["value"].to_numpy()
        label = np.full(z.shape, np.iinfo(np.int64).max)
        label[r + 1, c + 1] = cells["row"].to_numpy() * nx + cells["col"].to_numpy()
        while True:
            new = label.copy()
            for i, j in steps:
                other, same = np.roll(label, (-i, -j), (0, 1)), np.roll(z, (-i, -j), (0, 1)) == z
                np.minimum(new, np.where(same, other, new), out=new)
            # jump to the label of the cell that the label names, where it lies in the tile
            lr, lc = new // nx - r0 + 1, new % nx - c0 + 1
            ok = ~np.isnan(z) & (lr >= 0) & (lr < z.shape[0]) & (lc >= 0) & (lc < z.shape[1])
            new[ok] = np.minimum(new[ok], new[lr[ok], lc[ok]])
            if (new == label).all():
                break
            label = new
        return pd.DataFrame({"row": cells["row"], "col": cells["col"], "value": cells["value"], "label": label[r + 1, c + 1]})

    return run


def _joined(links: pa.Table) -> pa.Table:
    """(node, component) of links (a, b) between labels: the smallest node that each leads to."""
    a, b = (links.column(c).to_numpy() for c in ("a", "b"))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(on := np.flatnonzero(root[a] != root[b])):
        p, q = root[a[on]], root[b[on]]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (root[root] != root).any():
            root = root[root]
    return pa.table({"node": nodes, "component": nodes[root]})


def regions(grid: Grid, diagonal: bool = False) -> DataFrame:
    """(row, col, value, region) of cells with data: region is the smallest cell id of the connected cells of equal value."""
    geo = grid.geo
    data = grid.cells.where("value is not null").select("row", "col", "value")
    local = checkpointed(data.groupBy(F.floor(F.col("row") / TILE), F.floor(F.col("col") / TILE)).applyInPandas(_label(geo.nx, diagonal), "row long, col long, value double, label long"))
    ways = [o for o in EIGHT if diagonal or not (o[1] and o[2])]
    # within a tile cells of equal value that touch have one label: only those on its edge can touch others
    edge = F.pmod(F.col("row"), F.lit(TILE)).isin(0, TILE - 1) | F.pmod(F.col("col"), F.lit(TILE)).isin(0, TILE - 1)
    pair = shifted(Grid(local.where(edge).select("row", "col", F.struct("value", "label").alias("value")), geo), ways)
    touching = pair.select("value", F.explode(F.array(*[F.col(n) for n, _, _ in ways])).alias("o")).where("o is not null and o.value = value.value and o.label <> value.label")
    links = checkpointed(touching.select(F.col("value.label").alias("a"), F.col("o.label").alias("b")).distinct())
    names = links.groupBy(F.lit(0).alias("one")).applyInArrow(_joined, "node long, component long") if links.count() <= ONE_TASK else components(links, checkpointed)
    return local.join(names, local["label"] == names["node"], "left").select("row", "col", "value", F.coalesce("component", "label").alias("region"))

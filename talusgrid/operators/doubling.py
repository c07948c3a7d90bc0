"""Sums, maxima and labels along the links of a forest, by blocks of nodes and across them.

Every node has at most one link. Nodes are dealt out in blocks of neighbouring ids, one shuffle;
in a block all paths are followed at once up to where they leave it. Across blocks only the
nodes are left that links enter a block by: few, if links lead to near ids, as those of flow do.
They are solved in one task up to ONE_TASK of them, else, and for ids that aren't whole
numbers, in rounds of joins: in round k each node knows the node 2^k links away.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talusgrid.runtime import checkpointed

#: Ids in a block, whose nodes a task holds.
BLOCK = 1 << 17
#: Nodes between blocks that one task solves, and those that are sent to all tasks instead of joined by shuffle.
ONE_TASK, SENT = 1 << 20, 1 << 17


def _rounds(state: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Repeat the step until no link is left, or a round has ended none.

    Round k ends the links of all nodes within 2^k steps of an end. Paths have no gaps: if a
    round ends none, what is left runs in circles.
    """
    state = checkpointed(state)
    left = state.where("j is not null").count()
    while left:
        state = checkpointed(step(state))
        now = state.where("j is not null").count()
        if now == left:
            break
        left = now
    return state


def _jump(state: DataFrame, own: list[Column], far: list[str]) -> DataFrame:
    """Each row with the columns ``far`` (as far_...) of the row it links to; its link becomes that row's."""
    there = state.select(F.col("id").alias("far_id"), F.col("j").alias("far_j"), *[F.col(c).alias(f"far_{c}") for c in far])
    return state.join(there, state["j"] == there["far_id"], "left").select("id", F.col("far_j").alias("j"), *own)


def _sum_step(columns: list[str]) -> Callable[[DataFrame], DataFrame]:
    def step(state: DataFrame) -> DataFrame:
        sent = state.where("j is not null").groupBy(F.col("j").alias("to")).agg(*[F.sum(c).alias(f"in_{c}") for c in columns])
        moved = _jump(state, [F.col(c) for c in columns], [])
        return moved.join(sent, moved["id"] == sent["to"], "left").select("id", "j", *[(F.col(c) + F.coalesce(F.col(f"in_{c}"), F.lit(0))).alias(c) for c in columns])

    return step


def _max_step(state: DataFrame) -> DataFrame:
    sent = state.where("j is not null").groupBy(F.col("j").alias("to")).agg(F.max(F.col("m") + F.col("d")).alias("in_m"))
    moved = _jump(state, [F.col("m"), (F.col("d") + F.coalesce(F.col("far_d"), F.lit(0.0))).alias("d")], ["d"])
    return moved.join(sent, moved["id"] == sent["to"], "left").select("id", "j", F.greatest(F.col("m"), F.coalesce(F.col("in_m"), F.lit(0.0))).alias("m"), "d")


def _path_step(columns: list[str]) -> Callable[[DataFrame], DataFrame]:
    def step(state: DataFrame) -> DataFrame:
        own = [F.coalesce("far_root", "root").alias("root"), (F.col("n") + F.coalesce("far_n", F.lit(0))).alias("n")]
        return _jump(state, own + [(F.col(c) + F.coalesce(F.col(f"far_{c}"), F.lit(0))).alias(c) for c in columns], ["root", "n", *columns])

    return step


# -- blocks -----------------------------------------------------------------------------------


class _Block:
    """The nodes of a block, or of all blocks: columns as arrays and each link as a position, -1 without one here."""

    def __init__(self, table: pa.Table) -> None:
        self.table = table
        self.p, self.id = (table.column(c).to_numpy() for c in ("p", "id"))
        self.j, self.linked = self.values("j")
        # positions in the order of (p, id), of which a block has one p only
        ps, p = np.unique(self.p, return_inverse=True)
        low = int(self.id.min()) if len(self.id) else 0
        span = (int(self.id.max()) - low if len(self.id) else 0) + 1
        key, want = p * span + (self.id - low), p * span + (self.j - low)
        order = np.argsort(key, kind="stable")
        at = np.minimum(np.searchsorted(key[order], want), max(len(key) - 1, 0))
        hit = self.linked & (self.j >= low) & (self.j < low + span) & (key[order][at] == want)
        self.to = np.where(hit, order[at], -1)

    def values(self, name: str) -> tuple[np.ndarray, np.ndarray]:
        """A column with 0 for nulls, and where it has none."""
        column = self.table.column(name).combine_chunks()
        there = column.is_valid().to_numpy(zero_copy_only=False)
        return (column if there.all() else column.fill_null(0)).to_numpy(zero_copy_only=False).copy(), there

    def rounds(self):
        """(from, to, next link) positions of the links of each round of doubling, until none is left that ends."""
        link = self.to.copy()
        for _ in range(len(link).bit_length() + 1):
            on = np.flatnonzero(link >= 0)
            if not len(on):
                break
            to = link[on]
            yield on, to
            link[on] = link[to]
        self.circles = link >= 0

    def paths(self, sums: list[np.ndarray]) -> np.ndarray:
        """The position of each path's end here; ``sums`` become sums along it. Nodes that run in circles keep their own."""
        root, own = np.arange(len(self.to)), [s.copy() for s in sums]
        for on, to in self.rounds():
            root[on] = root[to]
            for s in sums:
                s[on] = s[on] + s[to]
        root[self.circles] = np.flatnonzero(self.circles)
        for s, o in zip(sums, own, strict=True):
            s[self.circles] = o[self.circles]
        return root

    def leaves(self, root: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The node of another block that each node's path goes on to, and whether there is one."""
        out = self.j[root]
        return out, self.linked[root] & (self.to[root] < 0) & (out // size != self.id // size)

    def gather(self, values: np.ndarray) -> None:
        """Add to each node the values of all that lead to it here."""
        for on, to in self.rounds():
            values += np.bincount(to, values[on], len(values)).astype(values.dtype)

    def highest(self, m: np.ndarray, d: np.ndarray) -> None:
        """Raise m to the largest of m plus the way from any node that leads here; d is the step of each."""
        for on, to in self.rounds():
            sent, step = m[on] + d[on], d[on] + d[to]
            np.maximum.at(m, to, sent)
            d[on] = step


def _nullable(values: np.ndarray, there: np.ndarray) -> pa.Array:
    return pa.array(values, mask=~there)


def _flat(nodes: DataFrame, columns: list[str | Column]) -> tuple[DataFrame, Callable[[Column, Column], Column]] | None:
    """(p, id, j, columns, block) with ids (of p) as whole numbers, and how to put an id together again; None if they aren't."""
    kind = nodes.schema["id"].dataType
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    if isinstance(kind, whole):
        flat = nodes.select(F.lit(0).cast("long").alias("p"), F.col("id").cast("long").alias("id"), F.col("j").cast("long").alias("j"), *columns)
        back = lambda p, i: i.cast(kind)
    elif isinstance(kind, T.StructType) and len(kind) == 2 and all(isinstance(f.dataType, whole) for f in kind):
        a, b = kind.names
        flat = nodes.select(F.col("id")[a].cast("long").alias("p"), F.col("id")[b].cast("long").alias("id"), F.col("j")[b].cast("long").alias("j"), *columns)
        back = lambda p, i: F.struct(p.cast(kind[a].dataType).alias(a), i.cast(kind[b].dataType).alias(b))
    else:
        return None
    return flat.withColumn("block", F.floor(F.col("id") / F.lit(BLOCK)).cast("long")), back


def _near(rows: DataFrame, count: int) -> DataFrame:
    return F.broadcast(rows) if count <= SENT else rows


def _across(inner: DataFrame, count: int, run: Callable[[pa.Table], pa.Table], step: Callable[[DataFrame], DataFrame], columns: list[str]) -> DataFrame:
    """(p, id, columns) of the nodes (p, id, j, columns) between blocks."""
    if count <= ONE_TASK:
        kinds = ", ".join(f"`{c}` {inner.schema[c].dataType.simpleString()}" for c in columns)
        return checkpointed(inner.groupBy(F.lit(0).alias("one")).applyInArrow(run, f"p long, id long, {kinds}"))
    state = inner.select(F.struct("p", "id").alias("id"), F.when(F.col("j").isNotNull(), F.struct("p", F.col("j").alias("id"))).alias("j"), *[c for c in inner.columns if c not in ("p", "id", "j")])
    return _rounds(state, step).select("id.p", "id.id", *columns)


def _ddl(nodes: DataFrame, columns: list[str]) -> dict[str, str]:
    """The types that sums of columns have: whole numbers stay so."""
    return {c: "long" if nodes.schema[c].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") else "double" for c in columns}


def subtree_sum(nodes: DataFrame, columns: list[str]) -> DataFrame:
    """Sums over each node and all nodes that lead to it; ``nodes`` has (id, j, columns), j NULL at roots."""
    types = _ddl(nodes, columns)
    dealt = _flat(nodes, [F.col(c).cast(t).alias(c) for c, t in types.items()])
    if dealt is None:
        return _rounds(nodes.select("id", "j", *columns), _sum_step(columns)).drop("j")
    (flat, back), size = dealt, BLOCK

    def gathered(table: pa.Table) -> tuple[_Block, dict[str, pa.Array]]:
        b, sums = _Block(table), {}
        for c in columns:
            v, there = b.values(c)
            b.gather(v)
            sums[c] = _nullable(v, there)
        return b, sums

    def first(table: pa.Table) -> pa.Table:
        b, sums = gathered(table)
        root = b.paths([])
        out, leaves = b.leaves(root, size)
        return pa.table({"p": b.p, "block": table.column("block"), "id": b.id, "j": _nullable(b.j, b.to >= 0), "out": _nullable(out, leaves), "last": root == np.arange(len(root))} | sums)

    def all_blocks(table: pa.Table) -> pa.Table:
        b, sums = gathered(table)
        return pa.table({"p": b.p, "id": b.id} | sums)

    def second(table: pa.Table) -> pa.Table:
        b, sums = _Block(table), {}
        for c in columns:
            more, own = b.values(f"more_{c}")[0], b.values(c)
            b.gather(more)
            sums[c] = _nullable(own[0] + more, own[1])
        return pa.table({"p": b.p, "id": b.id} | sums)

    kinds = ", ".join(f"`{c}` {t}" for c, t in types.items())
    near = checkpointed(flat.groupBy("p", "block").applyInArrow(first, f"p long, block long, id long, j long, out long, last boolean, {kinds}"))
    flows = checkpointed(near.where("last and out is not null").groupBy("p", F.col("out").alias("id")).agg(*[F.sum(c).alias(f"in_{c}") for c in columns]))
    n = flows.count()
    if n:
        inner = near.select("p", "id", F.col("out").alias("j")).join(_near(flows, n), ["p", "id"]).select("p", "id", "j", *[F.coalesce(f"in_{c}", F.lit(0)).cast(types[c]).alias(c) for c in columns])
        whole = _across(inner, n, all_blocks, _sum_step(columns), columns).withColumnsRenamed({c: f"more_{c}" for c in columns})
        near = near.join(_near(whole, n), ["p", "id"], "left").groupBy("p", "block").applyInArrow(second, f"p long, id long, {kinds}")
    return near.select(back(F.col("p"), F.col("id")).alias("id"), *columns)


def subtree_max(nodes: DataFrame) -> DataFrame:
    """(id, m): the largest sum of ``step`` along any path that leads to a node, 0 at sources; nodes has (id, j, step)."""
    dealt = _flat(nodes, [F.lit(0.0).alias("m"), F.col("step").cast("double").alias("d")])
    if dealt is None:
        return _rounds(nodes.select("id", "j", F.lit(0.0).alias("m"), F.col("step").alias("d")), _max_step).select("id", "m")
    (flat, back), size = dealt, BLOCK

    def highest(b: _Block) -> np.ndarray:
        m = b.values("m")[0]
        b.highest(m, b.values("d")[0])
        return m

    def first(table: pa.Table) -> pa.Table:
        b = _Block(table)
        m, far = highest(b), b.values("d")[0]
        root = b.paths([far])
        out, leaves = b.leaves(root, size)
        return pa.table({"p": b.p, "block": table.column("block"), "id": b.id, "j": _nullable(b.j, b.to >= 0), "out": _nullable(out, leaves), "last": root == np.arange(len(root)), "m": m, "d": table.column("d"), "far": far})

    def later(table: pa.Table) -> pa.Table:
        b = _Block(table)
        return pa.table({"p": b.p, "id": b.id, "m": highest(b)})

    near = checkpointed(flat.groupBy("p", "block").applyInArrow(first, "p long, block long, id long, j long, out long, last boolean, m double, d double, far double"))
    flows = checkpointed(near.where("last and out is not null").groupBy("p", F.col("out").alias("id")).agg(F.max(F.col("m") + F.coalesce("d", F.lit(0.0))).alias("in_m")))
    n = flows.count()
    if n:
        inner = near.select("p", "id", F.col("out").alias("j"), F.col("far").alias("d")).join(_near(flows, n), ["p", "id"]).select("p", "id", "j", F.col("in_m").alias("m"), "d")
        whole = _across(inner, n, later, _max_step, ["m"]).withColumnRenamed("m", "in_m")
        near = near.select("p", "block", "id", "j", "d").join(_near(whole, n), ["p", "id"], "left").withColumn("m", F.coalesce("in_m", F.lit(0.0))).groupBy("p", "block").applyInArrow(later, "p long, id long, m double")
    return near.select(back(F.col("p"), F.col("id")).alias("id"), "m")


def path_sum(nodes: DataFrame, columns: list[str]) -> DataFrame:
    """(id, root, n, columns): sums over the path from a node to its root, both included; n counts its nodes."""
    types = _ddl(nodes, columns)
    dealt = _flat(nodes, [F.col(c).cast(t).alias(c) for c, t in types.items()])
    if dealt is None:
        return _rounds(nodes.select("id", "j", F.col("id").alias("root"), F.lit(1).cast("long").alias("n"), *columns), _path_step(columns)).drop("j")
    (flat, back), size = dealt, BLOCK

    def along(b: _Block, n: np.ndarray) -> tuple[np.ndarray, dict]:
        own = [b.values(c) for c in columns]
        root = b.paths([n, *[v for v, _ in own]])
        return root, {"n": n} | {c: _nullable(v, there) for c, (v, there) in zip(columns, own, strict=True)}

    def first(table: pa.Table) -> pa.Table:
        b = _Block(table)
        root, sums = along(b, np.ones(len(b.id), np.int64))
        out, leaves = b.leaves(root, size)
        return pa.table({"p": b.p, "id": b.id, "out": _nullable(out, leaves), "root": b.id[root]} | sums)

    def all_blocks(table: pa.Table) -> pa.Table:
        b = _Block(table)
        root, sums = along(b, b.values("n")[0])
        return pa.table({"p": b.p, "id": b.id, "root": b.values("root")[0][root]} | sums)

    kinds = "root long, n long" + "".join(f", `{c}` {t}" for c, t in types.items())
    near = checkpointed(flat.groupBy("p", "block").applyInArrow(first, f"p long, id long, out long, {kinds}"))
    gates = checkpointed(near.where("out is not null").select("p", F.col("out").alias("id")).distinct())
    n = gates.count()
    sums = ["root", "n", *columns]
    if n:
        inner = near.join(_near(gates, n), ["p", "id"]).select("p", "id", F.col("out").alias("j"), *sums)
        far = _across(inner, n, all_blocks, _path_step(columns), sums).select("p", F.col("id").alias("out"), *[F.col(c).alias(f"far_{c}") for c in sums])
        own = [(F.col(c) + F.coalesce(f"far_{c}", F.lit(0))).alias(c) for c in ("n", *columns)]
        near = near.join(_near(far, n), ["p", "out"], "left").select("p", "id", F.coalesce("far_root", "root").alias("root"), *own)
    return near.select(back(F.col("p"), F.col("id")).alias("id"), back(F.col("p"), F.col("root")).alias("root"), "n", *columns)


def path_to(nodes: DataFrame, columns: list[str], targets: DataFrame) -> DataFrame:
    """(id, target, n, columns): as ``path_sum`` down to the first of the targets (id), for nodes whose path meets one, itself included.

    Links may form cycles; a node that is led into one without meeting a target has none.
    """
    ends = targets.select(F.col("id").alias("end")).distinct()
    state = nodes.join(ends, nodes["id"] == ends["end"], "left").select("id", F.when(F.col("end").isNull(), F.col("j")).alias("j"), F.when(F.col("end").isNull(), 0).otherwise(1).cast("long").alias("met"), *columns)
    # a target ends its path, so that at most one is met
    return path_sum(state, ["met", *columns]).where("met = 1").select("id", F.col("root").alias("target"), "n", *columns)


def reaches(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """(id, target): the first of the targets (id) on the path from each node that meets one, as ``path_to``."""
    return path_to(nodes, [], targets).select("id", "target")

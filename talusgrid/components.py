"""Connected components of a graph by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A node with more neighbours than both this many and this share of all edges is broadcast as the centre of a star.
STAR_ROWS, STAR_SHARE = 200, 1e-4


def components(edges: DataFrame, keep: Callable[[DataFrame], DataFrame], rounds: int = 40) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b); the component is its smallest node.

    The number of rounds is logarithmic in the longest chain. ``keep`` writes each round to the
    shared folder, so that a lost executor costs one round at most. Loops are ignored; an empty
    input gives no rows.
    """
    now = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def print_of(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())

    before = print_of(now)
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count("*").alias("n"))
        # centres of large stars go out to their rows: at most 2 / STAR_SHARE nodes, whatever the input
        many = max(STAR_ROWS, int(before[0] * STAR_SHARE))
        tagged = both.join(F.broadcast(least.where(F.col("n") > many).select("a", F.col("m").alias("centre"))), "a", "left")
        others = tagged.where("centre is null").join(least.where(F.col("n") <= many).select("a", "m"), "a")
        starred = tagged.where("centre is not null").select("a", "b", F.col("centre").alias("m")).unionByName(others.select("a", "b", "m"))
        large = starred.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        pairs = large.join(small, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")))).alias("e"))
        now = keep(pairs.select("e.a", "e.b").where("a <> b").distinct())
        after = print_of(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("connected components did not settle")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)

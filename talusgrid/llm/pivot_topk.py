"""Exact top-k search by inner product with a table of distances to pivots.

Vectors become integers, floor(SCALE * x). With M the largest norm, each vector gets one more
component sqrt(M^2 - |x|^2) and each query 0, so that |q' - x'|^2 = |q|^2 + M^2 - 2 q.x: the
largest inner product is the smallest distance. Distances of every vector to PIVOTS pivots are
computed once; by the triangle inequality the largest |d(q, p) - d(x, p)| over the pivots is a
lower bound on d(q, x). A task visits its candidates in the order of that bound, and stops at
the first whose bound shows that it can't reach the k-th best exact score so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talusgrid.llm import runtime as R

SCALE, PIVOTS, SAMPLE = 256, 24, 2048
#: Queries that all tasks hold at once on average, and candidates looked at together.
QUERY_BLOCK, CHUNK, STEP = 2048, 4096, 64
#: Sums of products below it fit 64 bits; beyond it they are Python's integers.
_FITS = 1 << 62
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def _scaled(column: pa.Array, width: int) -> np.ndarray:
    """floor(SCALE * x) of each vector of a list column as doubles, shorter ones filled with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), width))
    rows = np.repeat(np.arange(len(column)), lengths)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return np.floor(out * SCALE)


def _integers(scaled: np.ndarray, exact: bool) -> np.ndarray:
    """Whole doubles as 64-bit integers, or, where their products may not fit, as Python's."""
    if not exact:
        return scaled.astype(np.int64)
    return np.array([[int(v) for v in row] for row in scaled], dtype=object).reshape(scaled.shape)


def _lifted(x: np.ndarray, largest: float) -> np.ndarray:
    norms = (x**2).sum(1)
    return np.concatenate([x, np.sqrt(np.maximum(largest - norms, 0))[:, None]], axis=1)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first: each pivot is the vector farthest from those before it."""
    chosen = [0]
    far = np.sqrt(((sample - sample[0]) ** 2).sum(1))
    while len(chosen) < min(n, len(sample)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.sqrt(((sample - sample[chosen[-1]]) ** 2).sum(1)))
    return sample[chosen]


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if scores.dtype == object:
        order = sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k]
    else:
        order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def _search(queries: np.ndarray, query_rows: np.ndarray, query_ids: np.ndarray, pivots: np.ndarray, largest: float, k: int, width: int, exact: bool):
    lifted = np.concatenate([queries, np.zeros((len(queries), 1))], axis=1)
    to_pivots, square = _distances(lifted, pivots), (queries**2).sum(1)
    slack = 1e-6 * (1 + np.sqrt(largest) + np.sqrt(square))
    whole = _integers(queries, exact)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0, whole.dtype), np.zeros(0, np.int64))] * len(queries)

        def reach_of(i: int, scores: np.ndarray) -> float:
            """The largest distance whose inner product may reach the k-th best."""
            return np.sqrt(max(square[i] + largest - 2.0 * float(scores[-1]), 0)) + slack[i] if len(scores) == k else np.inf

        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                part = batch.slice(start, CHUNK)
                rows_, ids = (part.column(c).to_numpy(zero_copy_only=False) for c in ("row", "id"))
                x = _integers(_scaled(part.column("vector"), width), exact)
                table = np.frombuffer(b"".join(part.column("pivots").to_pylist()), dtype=np.float64).reshape(len(x), -1)
                for i in range(len(queries)):
                    bound = np.maximum(np.abs(table - to_pivots[i]).max(1) - slack[i], 0)
                    scores, found = best[i]
                    reach = reach_of(i, scores)
                    open_ = np.flatnonzero(bound <= reach)
                    open_ = open_[np.argsort(bound[open_], kind="stable")]
                    for a in range(0, len(open_), STEP):
                        if bound[open_[a]] > reach:
                            break
                        at = open_[a : a + STEP]
                        at = at[rows_[at] != query_rows[i]]
                        scores, found = _best(np.concatenate([scores, x[at] @ whole[i]]), np.concatenate([found, ids[at]]), k)
                        reach = reach_of(i, scores)
                    best[i] = scores, found
        for i in range(0, len(queries), 1000):
            part = best[i : i + 1000]
            n = [len(s) for s, _ in part]
            scores = [int(v) for s, _ in part for v in s]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(query_rows[i : i + 1000], n)),
                    pa.array(np.repeat(query_ids[i : i + 1000], n)),
                    pa.array(np.concatenate([x for _, x in part])),
                    pa.array([min(max(v, _LOW), _HIGH) for v in scores], pa.int64()),
                    pa.array([str(v) for v in scores] if exact else [None] * len(scores), pa.string()),
                ],
                names=["query_row", "query_id", "id", "score", "exact"],
            )

    return run


def _with_distances(pivots: np.ndarray, largest: float, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _distances(_lifted(_scaled(batch.column("vector"), width), largest), pivots)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vector"), batch.column("q"), pa.array([x.tobytes() for x in d], pa.binary())], names=["id", "vector", "q", "pivots"])

    return run


def top_k(vectors: DataFrame, is_query, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """The k rows with the largest integer inner product for each row that ``is_query`` picks.

    Columns: query_id, rank (from 1), the id column, score (all long but rank). A query's own
    row is no candidate; ties go to the smaller id. Vectors that are null or hold a null or
    non-finite component take no part, nor do those whose scaled norm is beyond doubles (1e150),
    nor null ids. An empty vector scores 0 with all. Vectors of different lengths are compared
    as if filled with zeros. Rows with one id are separate candidates and separate queries: each
    query row has k ranks of its own, and the other rows of its id are candidates. Scores are
    exact at every size and are ranked as such; one beyond 64 bits is given as the nearest long.
    Queries pass over all vectors in blocks of about QUERY_BLOCK.
    """
    spark = vectors.sparkSession
    vectors = R.columns(vectors, id_column, vector_column)
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("q")).where(F.col("id").isNotNull() & F.col("vector").isNotNull())
    rows = rows.where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    # doubles from 2^53 on are whole
    scaled = F.transform("vector", lambda x: F.when(F.abs(x * SCALE) < float(1 << 53), F.floor(x * SCALE).cast("double")).otherwise(x * SCALE))
    norm = F.aggregate(scaled, F.lit(0.0), lambda a, x: a + x * x)
    rows = rows.withColumn("norm", norm).where("norm < 1e300")
    width, largest = rows.agg(F.max(F.size("vector")), F.max("norm")).first()
    empty = spark.createDataFrame([], f"query_id long, rank int, `{id_column}` long, score long")
    if width is None:
        return empty
    exact = largest >= _FITS  # by Cauchy and Schwarz no sum of products is larger
    by_hash = rows.select("id", "vector").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    sample = _lifted(_scaled(by_hash.column("vector").combine_chunks(), width), largest)
    pivots = choose_pivots(sample, PIVOTS)
    table = R.arrow_map(rows.select("id", "vector", "q"), _with_distances(pivots, largest, width), "id long, vector array<double>, q boolean, pivots binary")
    table = R.stored(table.withColumn("row", F.monotonically_increasing_id()), "pivots")
    queries = table.where("q").select("row", "id", "vector")
    blocks = -(-queries.count() // QUERY_BLOCK)
    found = None
    for block in range(blocks):
        got = queries.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block).toArrow()
        if not got.num_rows:
            continue
        x = _scaled(got.column("vector").combine_chunks(), width)
        search = _search(x, got.column("row").to_numpy(), got.column("id").to_numpy(), pivots, largest, k, width, exact)
        part = R.arrow_map(table.select("row", "id", "vector", "pivots"), search, "query_row long, query_id long, id long, score long, exact string")
        part = R.stored(part, "found") if blocks > 4 else part
        found = part if found is None else found.unionByName(part)
    if found is None:
        return empty
    # digits of exact scores: those with more are larger, or smaller where they are negative
    size, sign = F.length("exact"), F.when(F.col("exact").startswith("-"), -1).otherwise(1)
    digits = F.when(sign > 0, F.col("exact")).otherwise(F.translate("exact", "0123456789", "9876543210"))
    order = Window.partitionBy("query_row").orderBy(*([F.desc(sign), F.desc(size * sign), F.desc(digits)] if exact else [F.desc("score")]), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_column), "score")

"""Near-duplicate grouping with HyperMinHash registers.

Each document's set of word shingles is summarised by REGISTERS buckets; a bucket keeps the
number of leading zeros and MANTISSA bits of the smallest hash that fell into it. Groups of
WIDTH registers form bands. Documents that share a band are compared by the
collision-corrected Jaccard estimate; those that may be similar form families, and inside a
family every pair is decided on the full sets. Copies with one set are one node from the start.

No step gathers an unbounded group: buckets and families beyond CHUNK members are dealt out as
pairs of chunks, so that every pair meets in exactly one task or more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talusgrid.llm import kernels as K
from talusgrid.llm import runtime as R

#: 25 bands of 5 miss a pair of large sets at a similarity of 0.8 with a chance of 5e-5, and one at 0.85 with 1e-6.
REGISTERS, WIDTH, MANTISSA = 125, 5, 10
BANDS = REGISTERS // WIDTH
#: Members of a band bucket, and of a family, that one task compares with each other.
BUCKET_CHUNK, FAMILY_CHUNK = 2048, 512
#: Standard errors that a register estimate may lie below the threshold.
SLACK = 5.0


def registers(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """HyperMinHash registers (rows x REGISTERS, uint16; 0: empty bucket) of each row's hash set."""
    rows = len(offsets) - 1
    low = np.full(rows * REGISTERS, np.iinfo(np.uint64).max, dtype=np.uint64)
    seen = np.zeros(rows * REGISTERS, dtype=bool)
    if len(values):
        bucket = ((values >> np.uint64(40)) * np.uint64(REGISTERS)) >> np.uint64(24)
        slot = np.repeat(np.arange(rows, dtype=np.int64) * REGISTERS, np.diff(offsets)) + bucket.astype(np.int64)
        np.minimum.at(low, slot, K.mix64(values))
        seen[slot] = True
    exponent = np.frexp((low >> np.uint64(11)).astype(np.float64))[1].astype(np.int64)
    zeros = np.minimum(53 - exponent, 52)
    with np.errstate(over="ignore"):
        mantissa = (low << (zeros + 1).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
    out = ((zeros + 1) << MANTISSA) | mantissa.astype(np.int64)
    return np.where(seen, out, 0).astype(np.uint16).reshape(rows, REGISTERS)


def collision_rate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Chance that a register of unrelated sets of a and b shingles is the same."""
    i = np.arange(0, 41)
    share = lambda n: (below := 1 - (1 - 2.0**-i) ** np.maximum(n[..., None] / REGISTERS, 1.0))[..., :-1] - below[..., 1:]
    return (share(a) * share(b)).sum(-1) / (1 << MANTISSA)


def jaccard_estimate(one: np.ndarray, others: np.ndarray, n_one, n_others) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected estimate of each row of ``others`` with ``one``, and the registers it rests on."""
    used = ((one != 0) | (others != 0)).sum(1)
    same = ((one == others) & (others != 0)).sum(1)
    chance = collision_rate(np.broadcast_to(np.asarray(n_one, float), np.shape(n_others)), np.asarray(n_others, float))
    fix = (same - chance * used) / np.maximum(1 - chance, 0.5)
    return np.where(used > 0, np.maximum(fix, 0) / np.maximum(used, 1), 0.0), used


def _may_link(est: np.ndarray, used: np.ndarray, threshold: float) -> np.ndarray:
    return est >= threshold - SLACK * np.sqrt(threshold * (1 - threshold) / np.maximum(used, 1))


SIGNED = "doc_id long, n_shingles long, set_hash binary, sig binary"


def _set_hash(values: np.ndarray) -> bytes | None:
    return hashlib.blake2b(values.data, digest_size=16).digest() if len(values) else None


def _sign(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in R.slices(whole):
                values, offsets = K.shingle_hashes(*K.word_hashes(*K.text_bytes(batch.column("text"))), width)
                values, offsets = K.distinct_by_row(values, offsets)
                sig = registers(values, offsets)
                n = np.diff(offsets)
                hashes = [_set_hash(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(hashes, pa.binary()), pa.array([x.tobytes() for x in sig], pa.binary())],
                    names=["doc_id", "n_shingles", "set_hash", "sig"],
                )

    return run


def _bucket_edges(threshold: float):
    """A spanning forest, within the partition, of the pairs in each bucket that may be links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = R.Forest()
        for table in R.grouped(batches, "g"):
            m = table.num_rows
            if m < 2:
                continue
            ids = table.column("rep").to_numpy()
            n = table.column("n").to_numpy().astype(float)
            sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), dtype=np.uint16).reshape(m, REGISTERS)
            left, queue = np.arange(1, m), [0]
            while len(left):
                if queue:
                    x = queue.pop()
                else:
                    x, left = left[0], left[1:]
                    if not len(left):
                        break
                near = np.minimum(n[x], n[left]) >= threshold * np.maximum(n[x], n[left])
                est, used = jaccard_estimate(sig[x], sig[left], n[x], n[left])
                near &= _may_link(est, used, threshold)
                found = left[near]
                for y in found:
                    forest.join(int(ids[x]), int(ids[y]))
                queue.extend(found.tolist())
                left = left[~near]
        yield from R.edge_batches(forest)

    return run


def _sets(width: int):
    """The full set of each class, once from each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for batch in R.slices(whole):
                values, offsets = K.distinct_by_row(*K.shingle_hashes(*K.word_hashes(*K.text_bytes(batch.column("text"))), width))
                sets, rows = [], []
                for i, (rep, want) in enumerate(zip(batch.column("rep").to_pylist(), batch.column("set_hash").to_pylist(), strict=True)):
                    own = values[offsets[i] : offsets[i + 1]]
                    if rep not in seen and _set_hash(own) == want:
                        seen.add(rep)
                        rows.append(i)
                        sets.append(own.tobytes())
                kept = batch.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in ("rep", "node", "family", "size")), pa.array(sets, pa.binary())], names=["rep", "node", "family", "size", "set"])

    return run


def linked_pairs(sets: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i < j) with den * |intersection| >= num * |union|, counted on the full sets."""
    m = len(sets)
    sizes = np.asarray([len(s) for s in sets], dtype=np.int64)
    if m == 2:
        joined = np.sort(np.concatenate(sets))
        common = int((joined[1:] == joined[:-1]).sum())
        hit = sizes.min() > 0 and den * common >= num * (sizes.sum() - common)
        return (np.array([0]), np.array([1])) if hit else (np.zeros(0, int), np.zeros(0, int))
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(m), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.concatenate(([True], values[1:] != values[:-1])) if len(values) else np.zeros(0, bool)
    column = np.cumsum(new) - 1
    often = np.bincount(column)[column] > 1 if len(values) else new
    column, owner = column[often], owner[often]
    common = np.zeros((m, m), dtype=np.float64)
    if len(column):
        column = np.cumsum(np.concatenate(([0], (column[1:] != column[:-1]).astype(np.int64))))
        step = 4096
        edges = np.searchsorted(column, np.arange(0, column[-1] + 1 + step, step))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b > a:
                x = np.zeros((m, step), dtype=np.float32)
                x[owner[a:b], column[a:b] - column[a] // step * step] = 1
                common += x @ x.T
    union = sizes[:, None] + sizes[None, :] - common
    i, j = np.nonzero(np.triu((den * common >= num * union) & (common > 0), 1))
    return i, j


def _family_edges(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = R.Forest()
        for table in R.grouped(batches, "g"):
            if table.num_rows < 2:
                continue
            ids = table.column("node").to_numpy()
            i, j = linked_pairs([np.frombuffer(x, dtype=np.uint64) for x in table.column("set").to_pylist()], num, den)
            for a, b in zip(ids[i].tolist(), ids[j].tolist(), strict=True):
                forest.join(a, b)
        yield from R.edge_batches(forest)

    return run


def _dealt(rows: DataFrame, group: str, size: str, member: str, chunk: int) -> DataFrame:
    """Give each row the task keys ``g`` where it meets all other members of its group.

    A group of up to ``chunk`` members has one key. A larger one is cut into k chunks by the
    member's hash, with a key for every pair of chunks.
    """
    k = F.ceil(F.col(size) / F.lit(chunk)).cast("long")
    own = F.pmod(F.xxhash64(F.col(member), F.lit(7)), k)
    keys = F.when(k <= 1, F.array(F.xxhash64(F.col(group)))).otherwise(
        F.transform(F.filter(F.sequence(F.lit(0).cast("long"), k - 1), lambda o: o != own), lambda o: F.xxhash64(F.col(group), F.least(o, own), F.greatest(o, own)))
    )
    return rows.withColumn("g", F.explode(keys))


def _shared_ids(some: DataFrame, reps: DataFrame) -> DataFrame:
    """Edges (a, b) between the nodes of the classes that rows of one id are in: each with the first of them."""
    h = F.xxhash64("set_hash")
    shared = R.stored(some.groupBy("doc_id").agg(F.min(h).alias("a"), F.max(h).alias("b")).where("a < b").select("doc_id"), "shared")
    n = shared.count()
    if not n:
        return shared.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b"))
    held = R.stored(R.semi_by_id(some.select("doc_id", "set_hash"), shared, "doc_id", n).distinct().join(reps.select("set_hash", "node"), "set_hash").select("doc_id", "node"), "held")
    first = held.groupBy("doc_id").agg(F.min("node").alias("b"))
    return R.semi_by_id(held, first, "doc_id", n, "inner").select(F.col("node").alias("a"), "b").where("a <> b")


def near_duplicates(documents: DataFrame, similarity: tuple[int, int] = (80, 100), width: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of documents (doc_id, text).

    Two documents are linked if |A n B| / |A u B| of their sets of ``width``-word shingles is at
    least ``similarity`` (numerator, denominator); the component is the smallest doc_id that is
    reachable over links, itself included, and only that document is kept.

    Rows of one doc_id that have words are linked too, whatever their texts: one id is one node,
    and all its rows are kept or none. n_shingles is that of the row's own text. Null and empty
    texts, and texts without words, have no shingles and are linked with nothing, not even with
    rows of their id. A null doc_id has no component, links nothing and is kept. Other columns
    are ignored, also one whose name differs in case only. An empty table gives no rows.
    """
    num, den = similarity
    threshold = num / den
    docs = R.columns(documents, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spark = docs.sparkSession
    parts = R.partitions(spark)
    signed = R.stored(R.arrow_map(docs, _sign(width), SIGNED).withColumn("row", F.monotonically_increasing_id()), "signed")
    some = signed.where("doc_id is not null and n_shingles > 0")
    # a class goes by its first row, as ids may be shared; the node of all classes with one smallest id is that id
    first = F.min(F.struct("row", "doc_id"))
    reps = R.stored(some.groupBy("set_hash").agg(first["row"].alias("rep"), first["doc_id"].alias("of"), F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")), "classes")

    #: Below this size a set can't be similar without being equal.
    least = next(n for n in range(1, den + 2) if den * n >= num * (n + 1))
    bands = F.filter(
        F.array(*[F.struct(F.lit(j).alias("j"), F.substring("sig", 2 * WIDTH * j + 1, 2 * WIDTH).alias("part")) for j in range(BANDS)]),
        lambda b: b["part"] != F.lit(bytes(2 * WIDTH)),
    )
    banded = reps.where(F.col("n") >= least).select("rep", F.explode(F.transform(bands, lambda b: F.xxhash64(b["j"], b["part"]))).alias("band"))
    sizes = banded.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    met = banded.join(sizes, "band")
    dealt = _dealt(met, "band", "size", "rep", BUCKET_CHUNK).select("g", "rep")
    full = dealt.join(reps.select("rep", "n", "sig"), "rep").repartition(parts, "g").sortWithinPartitions("g")
    families = R.connected_components(R.arrow_map(full.select("g", "rep", "n", "sig"), _bucket_edges(threshold), "a long, b long"))
    families = R.stored(families.select(F.col("node").alias("rep"), F.col("component").alias("family")), "families")
    counts = families.groupBy("family").agg(F.count("*").alias("size"))
    # the text of a class is that of its first row; other rows of that row's id are told apart by their sets
    members = R.stored(families.join(counts, "family").join(reps.select("rep", "node", F.col("of").alias("doc_id"), "set_hash"), "rep"), "members")

    chosen = R.semi_by_id(docs, members, "doc_id", members.count(), "inner").select("rep", "node", "family", "size", "set_hash", "text")
    sets = R.arrow_map(chosen, _sets(width), "rep long, node long, family long, size long, set binary")
    dealt = _dealt(sets, "family", "size", "rep", FAMILY_CHUNK).select("g", "node", "set").repartition(parts, "g").sortWithinPartitions("g")
    edges = R.arrow_map(dealt, _family_edges(num, den), "a long, b long").unionByName(_shared_ids(some, reps))
    links = R.connected_components(edges)
    labels = reps.select("set_hash", "node").join(links, "node", "left").select("set_hash", F.coalesce("component", "node").alias("component_id"))
    placed = some.select("doc_id", "n_shingles", "set_hash").join(labels, "set_hash")
    rest = signed.where("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = placed.select("doc_id", "n_shingles", "component_id").unionByName(rest)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))

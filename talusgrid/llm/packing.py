"""Best-fit packing of documents into bins of a fixed number of words, with conflicts.

Bins are kept in the order of their residual room. An item goes to the bin with the least room
that holds it, found by a successor search; a bin that already has its source or a copy of it,
by the bin's two bitmaps, is passed over for the next larger one. Items come in decreasing
size. Documents are dealt out by hash to shards that are packed apart, so that no task holds
more than SHARD items at once.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talusgrid.llm import kernels as K
from talusgrid.llm import runtime as R
from talusgrid.llm.near_dedup import near_duplicates

SHARD = 4096
#: Documents at least this similar, in sets of so many words, are copies of each other.
SIMILARITY, WIDTH = (80, 100), 5
_MEASURED = "row long, doc_id long, source string, n_words long, words long"
_PACKED = "bin_id long, offset int, doc_id long, piece int, start_word long, n_words long"


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in R.slices(whole):
            words, offsets = K.word_hashes(*K.text_bytes(batch.column("text")))
            digests = [int.from_bytes(hashlib.blake2b(words[a:b].data, digest_size=8).digest(), "little", signed=True) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(np.diff(offsets), pa.int64()), pa.array(digests, pa.int64())], names=["row", "doc_id", "source", "n_words", "words"])


class Bins:
    """Open bins by residual room, with bitmaps of the sources and of the clusters they hold."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.order: list[tuple[int, int]] = []  #: (room, bin), sorted
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def put(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """The bin for an item and its offset there; source and cluster are bits, or 0."""
        at = bisect_left(self.order, (size, -1))
        for i in range(at, len(self.order)):
            room, bin_ = self.order[i]
            if not (self.sources[bin_] & source or self.clusters[bin_] & cluster):
                del self.order[i]
                break
        else:
            room, bin_ = self.capacity, len(self.sources)
            self.sources.append(0)
            self.clusters.append(0)
        self.sources[bin_] |= source
        self.clusters[bin_] |= cluster
        if room > size:
            insort(self.order, (room - size, bin_))
        return bin_, self.capacity - room


def pack_shard(items: list[tuple[int, int, object, object]], capacity: int) -> list[tuple[int, int]]:
    """Bin and offset of each item (size, start, source, cluster), which come in decreasing size."""
    seen = Counter(c for _, _, _, c in items if c is not None)
    source_bits: dict[object, int] = {}
    cluster_bits: dict[object, int] = {}
    bins = Bins(capacity)
    out = []
    for size, _, source, cluster in items:
        s = 0 if source is None else source_bits.setdefault(source, 1 << len(source_bits))
        c = cluster_bits.setdefault(cluster, 1 << len(cluster_bits)) if seen[cluster] > 1 else 0
        out.append(bins.put(size, s, c))
    return out


def _pack(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in R.grouped(batches, "shard"):
            shard, made = table.column("shard")[0].as_py(), 0
            for start in range(0, table.num_rows, SHARD):
                part = table.slice(start, SHARD)
                cols = {c: part.column(c).to_pylist() for c in ("doc_id", "source", "cluster", "piece", "start_word", "size")}
                placed = pack_shard(list(zip(cols["size"], cols["start_word"], cols["source"], cols["cluster"], strict=True)), capacity)
                base = (shard << 32) + made
                made += max(b for b, _ in placed) + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([base + b for b, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int32()), pa.array(cols["doc_id"], pa.int64()), pa.array(cols["piece"], pa.int32()), pa.array(cols["start_word"], pa.int64()), pa.array(cols["size"], pa.int64())],
                    names=["bin_id", "offset", "doc_id", "piece", "start_word", "n_words"],
                )

    return run


def pack(documents: DataFrame, capacity: int = 2048) -> DataFrame:
    """(bin_id, offset, doc_id, piece, start_word, n_words) for every piece of every document.

    A document of more than ``capacity`` words is cut into pieces, all but the last of which
    fill a bin. No bin holds two pieces of one source, or of documents of one group of near
    copies (see near_dedup; the same words, letter case aside, are always one). Documents without words, null ones included, get a row without a bin.
    A null source conflicts with nothing. Repeated rows are packed each; other columns are
    ignored; an empty table gives no rows.
    """
    spark = documents.sparkSession
    documents = R.columns(documents, "doc_id", "source", "text")
    rows = documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    rows = R.stored(rows, "rows")
    groups = near_duplicates(rows.select(F.col("row").alias("doc_id"), "text"), SIMILARITY, WIDTH).select(F.col("doc_id").alias("row"), F.col("component_id").alias("cluster"))
    measured = R.stored(R.arrow_map(rows, _measure, _MEASURED).join(groups, "row"), "measured")
    some = measured.where("n_words > 0")
    pieces = F.ceil(F.col("n_words") / F.lit(capacity)).cast("int")
    items = some.select("doc_id", "source", "words", "cluster", "n_words", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"))
    items = items.withColumn("start_word", F.col("piece").cast("long") * capacity).withColumn("size", F.least(F.lit(capacity).cast("long"), F.col("n_words") - F.col("start_word")))
    shards = max(1, -(-items.count() // (SHARD * 3 // 4)))
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "words"), F.lit(shards)))
    dealt = dealt.select("shard", "doc_id", "source", "words", "cluster", "piece", "start_word", "size").repartition(min(shards, R.partitions(spark)), "shard").sortWithinPartitions("shard", F.desc("size"), "doc_id", "piece", "source", "words", "cluster")
    packed = R.arrow_map(dealt, _pack(capacity), _PACKED)
    none = measured.where("n_words = 0").select(F.lit(None).cast("long").alias("bin_id"), F.lit(None).cast("int").alias("offset"), "doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start_word"), "n_words")
    return packed.unionByName(none)

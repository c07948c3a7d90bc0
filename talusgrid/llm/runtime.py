"""Shared folders, size-checked broadcasts and streaming helpers for the operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talusgrid.components import components

#: Bytes of text that the NumPy kernels take at once (they use about 40 bytes for each).
SLICE_BYTES = 1 << 20
#: Rows that go to and from a Python worker at once: whole texts are long, and a worker holds a few batches.
BATCH_ROWS = 1000
#: Most rows of ids (16 bytes each at most) that are broadcast; beyond it a shuffle join is used.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. On a local master a new folder serves where it is unset."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        if kept.isDefined():
            return kept.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(where)
        where = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return where


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that is deleted when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read back: a cut of lineage that survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def columns(df: DataFrame, *names: str) -> DataFrame:
    """The rows, with other columns whose names differ from one of these in case only renamed, so that these can be named."""
    wanted = {n.casefold() for n in names}
    clash = [i for i, c in enumerate(df.columns) if c not in names and c.casefold() in wanted and any(n in df.columns and n.casefold() == c.casefold() for n in names)]
    return df.toDF(*[f"_other{i}_{c}" if i in clash else c for i, c in enumerate(df.columns)]) if clash else df


def semi_by_id(rows: DataFrame, ids: DataFrame, key: str, n_ids: int, how: str = "left_semi") -> DataFrame:
    """Join on ids: broadcast when their counted number is within BROADCAST_ROWS, else by shuffle."""
    return rows.join(F.broadcast(ids) if n_ids <= BROADCAST_ROWS else ids.hint("shuffle_merge"), key, how)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Row ranges of the batch with about SLICE_BYTES of text each (one row at least)."""
    n = batch.num_rows
    if not n:
        return
    sizes = np.zeros(n, dtype=np.int64)
    column = batch.column(text)
    lengths = pa.compute.binary_length(column.cast(pa.large_string()))
    sizes[:] = pa.compute.fill_null(lengths, 0).to_numpy(zero_copy_only=False)
    which = np.cumsum(sizes) // SLICE_BYTES
    edges = np.concatenate(([0], np.flatnonzero(np.diff(which)) + 1, [n]))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield batch.slice(a, b - a)


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of equal keys in a stream that is sorted by the key, whole across batch edges."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        edges = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if held and keys[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = keys[a]
    if held:
        yield pa.Table.from_batches(held)


class Forest:
    """Union-find over integer ids with the smallest id of each tree as its root."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        r = x
        while (p := up.get(r, r)) != r:
            r = p
        while up.get(x, x) != r:
            up[x], x = r, up[x]
        return r

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        if a > b:
            a, b = b, a
        self.up[b] = a
        self.up.setdefault(a, a)
        return True

    def stars(self) -> tuple[list[int], list[int]]:
        nodes = [x for x in self.up if self.root(x) != x]
        return nodes, [self.root(x) for x in nodes]


EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def edge_batches(forest: Forest) -> Iterator[pa.RecordBatch]:
    a, b = forest.stars()
    for i in range(0, len(a), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(a[i : i + 50_000], pa.int64()), pa.array(b[i : i + 50_000], pa.int64())], schema=EDGES)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of ``edges`` (a, b), each round written to the shared folder."""
    return components(edges, lambda df: stored(df, "stars"))


def arrow_map(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` in batches of BATCH_ROWS, after which a worker gives freed memory back."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, out in enumerate(f(batches)):
            yield out
            if i % 16 == 15:
                pa.default_memory_pool().release_unused()
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def same_columns(documents: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``arrow_map`` by a function that keeps the columns in their places, also where names differ in case only."""
    names = documents.columns
    if len({n.casefold() for n in names}) == len(names):
        return arrow_map(documents, f, documents.schema)
    apart = documents.toDF(*[f"{i}_{n}" for i, n in enumerate(names)])
    return arrow_map(apart, f, apart.schema).toDF(*names)


def is_mappable(path: str) -> bool:
    return path.startswith(("file:", "/"))


def local_path(path: str) -> str:
    return "/" + path.removeprefix("file:").lstrip("/")


def put_file(path: str, data: bytes | np.ndarray) -> None:
    """Write a file of the shared folder whole or not at all; a repeated task writes the same bytes."""
    data = memoryview(np.ascontiguousarray(data)).cast("B") if isinstance(data, np.ndarray) and data.size else bytes(data) if not isinstance(data, np.ndarray) else b""
    if is_mappable(path):
        path = local_path(path)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}"
        with open(part, "wb") as out:
            out.write(data)
        os.replace(part, path)
        return
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    part = f"{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, name)


def map_file(path: str, dtype) -> np.ndarray:
    """A file of the shared folder as a memory-mapped array.

    Where the folder is no mounted path, its bytes go to an unlinked scratch file first, which
    disappears with the worker.
    """
    if is_mappable(path):
        path = local_path(path)
        return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.zeros(0, dtype)
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    with store.open_input_stream(name) as source, tempfile.TemporaryFile() as scratch:
        while chunk := source.read(8 << 20):
            scratch.write(chunk)
        scratch.flush()
        return np.memmap(scratch, dtype=dtype, mode="r") if scratch.tell() else np.zeros(0, dtype)

"""Cuts of lineage for iterative plans."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share. On a local master a new folder serves where none is configured."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        where = context.getConf().get("spark.checkpoint.dir", None)
        if not where and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(where or tempfile.mkdtemp(prefix="checkpoints-"))
    return context._jsc.sc().getCheckpointDir().get()


def local_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, for sinks that write a file through a mounted path."""
    where = shared_folder(spark)
    if not where.startswith(("file:", "/")):
        raise RuntimeError(f"{where} isn't a mounted path")
    path = f"/{where.removeprefix('file:').strip('/')}/{name}-{uuid.uuid4().hex}"
    os.makedirs(path)
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, kept in the shared checkpoint folder: a cut of lineage that survives lost executors.

    As plain Parquet, which is written and read by column at a small part of what serialized rows
    cost. Without compression or dictionaries the files are as large as the rows, so that the
    planner doesn't take a large table for one to broadcast.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/rows-{uuid.uuid4().hex}"
    df.write.option("compression", "none").option("parquet.enable.dictionary", "false").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

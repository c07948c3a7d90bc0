"""A corpus pipeline: language, near duplicates, benchmark leaks, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talusgrid.llm import decontamination, language_id, near_dedup, packing, secrets
from talusgrid.llm import runtime as R
from talusgrid.llm.queries import CAPACITY, LEAK_RATE, held_out, table

#: The least calibrated probability of its language that keeps a document.
LEAST_LANGUAGE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose text has a language that the model is sure enough of."""
    model = language_id.train(docs.where(~held_out(5, 0)).select("doc_id", "text", "lang"))
    return language_id.with_language(docs, model, LEAST_LANGUAGE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near duplicates (0.8 or more): of its smallest id, a null id last.

    Rows are compared by text alone, whatever their ids; texts without words are in no group.
    """
    row = "row"
    while row in docs.columns:
        row += "_"
    rows = R.stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    groups = near_dedup.near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"), similarity=(80, 100), width=5)
    groups = R.stored(groups.select(F.col("doc_id").alias(row), "component_id"), "groups")
    ids = rows.select(row, F.col("doc_id").cast("long").alias("id"))
    kept = groups.join(ids, row).groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", row))[row].alias(row))
    gone = R.stored(groups.select(row).join(kept, row, "left_anti"), "gone")
    return R.semi_by_id(rows, gone, row, gone.count(), "left_anti").select(docs.columns)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item with few enough edits."""
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"), LEAK_RATE)


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts; no document is dropped."""
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deal the documents into bins of equal size."""
    return packing.pack(docs, CAPACITY)


STAGES = [("language_id", language), ("near_dedup", near_duplicates), ("decontamination", leaks), ("secrets", no_secrets), ("packing", packed)]

#: The stages that fit models or search for edits can't be written in SQL; tests compare them with plainer code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after another, over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = R.stored(docs, name)
    return docs

"""Tables of named outlets: (prefix, name, x, y)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "prefix string, name string, x double, y double"


def of_dict(spark: SparkSession, outlets: dict[str, dict[str, tuple[float, float]]]) -> DataFrame:
    return spark.createDataFrame([(p, n, float(x), float(y)) for p, named in outlets.items() for n, (x, y) in named.items()], SCHEMA)


def to_dict(outlets: DataFrame) -> dict[str, dict[str, tuple[float, float]]]:
    out: dict[str, dict[str, tuple[float, float]]] = {}
    for r in outlets.select("prefix", "name", "x", "y").toLocalIterator():
        out.setdefault(r.prefix, {})[r.name] = (r.x, r.y)
    return out


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """All outlets; of one prefix and name the new one."""
    both = old.select("prefix", "name", "x", "y").withColumn("k", F.lit(0)).unionByName(new.select("prefix", "name", "x", "y").withColumn("k", F.lit(1)))
    order = Window.partitionBy("prefix", "name").orderBy(F.desc("k"))
    return both.withColumn("n", F.row_number().over(order)).where("n = 1").drop("k", "n")


def save(outlets: DataFrame, path: str) -> None:
    outlets.select("prefix", "name", "x", "y").write.mode("overwrite").json(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path)


def points(outlets: DataFrame, prefix: str, names: list[str] | None = None) -> DataFrame:
    """The outlets of a prefix as numbered points (point, name, x, y), in the order of their names."""
    rows = outlets.where(F.col("prefix") == prefix)
    rows = rows.where(F.col("name").isin(names)) if names else rows
    return rows.withColumn("point", (F.row_number().over(Window.orderBy("name")) - 1).cast("long")).select("point", "name", "x", "y")

"""All registered queries of the raster engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from talusgrid.plans import raster_queries, source_queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return raster_queries.queries() | source_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return raster_queries.oracle_sql() | source_queries.SQL

"""All queries of the library on the driver tables, by name, with their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import trace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame, and the SQL that gives the same rows."""

    def add(f):
        key = name or f.__name__
        assert key not in QUERIES, key
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""
SELECT event_type AS header, count(*) AS files, CAST(sum(CAST(round(value * 1000000) AS BIGINT)) AS BIGINT) AS total_us
FROM events GROUP BY event_type
""")
def header_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("header"), F.round(F.col("value") * 1000000).cast("bigint").alias("dur"))
    return trace.cost(e, ["header"]).withColumnsRenamed({"us": "total_us", "n": "files"})


from . import file_queries, image_queries, more_queries, relation_queries, scale_queries, small_queries, texture_queries, trace_queries  # noqa: E402, F401  they register their queries

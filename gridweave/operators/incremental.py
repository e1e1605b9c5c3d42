"""Reports kept as partial states, one partition for each file, so that a refresh reads only the files that have changed.

The store is a Parquet table partitioned by `file`; a partition has the partial state of its file's timings, which merges by sums, and a row with the file's stamp, which is
all that a file without events has. A refresh overwrites the partitions of new and changed files, and of those that have gone (then without a stamp), and no others. A refresh that
fails leaves the partitions as they were, and the next one finds the same files changed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import materialise
from . import trace

STORE = "modified timestamp, name string, count bigint, duration bigint, duration_sub bigint, file string"


def _store(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(STORE).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], STORE)


def refresh(files: DataFrame, store: str, read: Callable[[list[str]], DataFrame]) -> dict[str, int]:
    """Brings a store up to date with files (path, modified): {"changed": new and changed files, "gone": files that are no more}.

    read gives the events (path, name, dur[, dur_sub]) of a list of paths; it is called once, with the paths of changed files, if there are any. path is the one that files has.
    """
    spark = files.sparkSession
    known = _store(spark, store).where("modified is not null").select(F.col("file").alias("path"), "modified").distinct()
    now = materialise(files.select("path", "modified"), "files")
    changed = materialise(trace.refreshed(now, known), "changed")
    gone = materialise(known.join(now, "path", "left_anti"), "gone")
    paths = [r["path"] for r in changed.select("path").collect()]  # what a reader is told to read; one short row for each changed file
    stamps = changed.select("path", "modified").unionByName(gone.select("path", F.lit(None).cast("timestamp").alias("modified")))
    rows = stamps
    if paths:
        events = read(paths)
        events = events if "dur_sub" in events.columns else events.withColumn("dur_sub", F.lit(0).cast("bigint"))
        rows = stamps.unionByName(trace.timings(events, ["path", "name"]), allowMissingColumns=True)
    n = {"changed": len(paths), "gone": gone.count()}
    if any(n.values()):
        whole = rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast(k).alias(c) for c, k in (x.split() for x in STORE.split(", ")[:-1])), F.col("path").alias("file"))
        whole.repartition("file").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file").parquet(store)
    return n


def report(spark: SparkSession, store: str, by: list[str] = ("name",)) -> DataFrame:
    """The report over all files of a store, merged from their parts."""
    return trace.merge_timings(_store(spark, store).where("count is not null"), list(by))

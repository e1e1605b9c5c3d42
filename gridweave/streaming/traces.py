"""Streams of trace events: files arrive in a folder, events are appended as they close."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

EVENT = "tid bigint, name string, ph string, ts bigint, dur bigint, depth int, value bigint"


def arrivals(spark: SparkSession, folder: str, schema: str = EVENT, files_per_trigger: int = 1000) -> DataFrame:
    """Events of JSON line files as they arrive; the source's checkpoint remembers files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def admitted(events: DataFrame, start: int, most_depth: int = 16) -> DataFrame:
    """Late starts are moved to `start` and shortened; what ends before, counters before it and too deep scopes are dropped."""
    late = F.greatest(F.lit(start) - F.col("ts"), F.lit(0))
    moved = events.withColumn("dur", F.when(F.col("ph") == "X", F.col("dur") - late).otherwise(F.col("dur"))).withColumn("ts", F.when(F.col("ph") == "X", F.greatest("ts", F.lit(start))).otherwise(F.col("ts")))
    keep = F.when(F.col("ph") == "X", (F.col("dur") > 0) & (F.coalesce("depth", F.lit(0)) < most_depth)).otherwise(F.col("ts") >= start)
    return moved.where(keep)


def append(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends events as gzip JSON lines; the sink's log makes each batch count once."""
    return events.writeStream.format("json").option("compression", "gzip").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def totals(events: DataFrame) -> DataFrame:
    """Running count and duration of each name: state is one row a name."""
    return events.where("ph = 'X'").groupBy("name").agg(F.count("*").alias("count"), F.sum("dur").alias("duration"))


def keep_totals(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Recomputes the report for every batch of new files and replaces it, as a reload of all files would."""

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return totals(events).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(replace).trigger(availableNow=True).start()


class Numbers(StatefulProcessor):
    """Numbers new threads of a process from where the last batch ended; the state is one number."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "tid bigint")

    def handleInputRows(self, key, rows, timerValues):
        new = pd.concat(list(rows))
        if not len(new):
            return
        start = self.last.get()[0] if self.last.exists() else 0
        new = new.sort_values("thread")[["process", "thread"]]
        new["tid"] = np.arange(start + 1, start + len(new) + 1)
        self.last.update((start + len(new),))
        yield new

    def close(self) -> None:
        pass


def track_numbers(events: DataFrame, track: str = "thread", process: str | None = None) -> DataFrame:
    """A stream (process, thread, tid): every thread of a process gets the next number from 1 when it is first seen, and keeps it; those of one batch in their order.

    Threads already seen are kept as keyed state, spread over the partitions, and stopped there; only new ones reach the process's counter. So the work of a batch is its own
    rows and its new threads. State is kept in RocksDB, which transformWithState asks for.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = events.where(F.col(track).isNotNull()).select((F.lit("") if process is None else F.col(process).cast("string")).alias("process"), F.col(track).alias("thread"))
    kind = dict(rows.dtypes)["thread"]
    new = rows.dropDuplicates(["process", "thread"]).groupBy("process")
    return new.transformWithStateInPandas(Numbers(), f"process string, thread {kind}, tid bigint", "Append", "None")


def track_ids(events: DataFrame, path: str, checkpoint: str, track: str = "thread", process: str | None = None) -> StreamingQuery:
    """Keeps a table of track_numbers(): each batch appends its new threads."""
    return track_numbers(events, track, process).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def flush(events: DataFrame, path: str, checkpoint: str, every: str = "10 seconds") -> StreamingQuery:
    """Like append(), for a source that does not end: what has arrived is written at every interval, and at stop()."""
    return events.writeStream.format("json").option("compression", "gzip").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(processingTime=every).start()

"""Sinks: trace JSON, text reports, and rows of encoded containers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.strings import js_escape
from ..operators.relations import ordinals
from ..sources.containers import write_dds, write_ktx1, write_ktx2

#: Columns of a written event, in order.
FIELDS = ["cat", "pid", "tid", "ph", "ts", "dur", "name", "args"]


def event_json(events: DataFrame) -> DataFrame:
    """One JSON object per event, with the fields that the events have."""
    return events.select(F.to_json(F.struct(*(c for c in FIELDS if c in events.columns))).alias("value"))


def write_events(events: DataFrame, path: str, gzip: bool = True) -> None:
    """One event a line, which every reader of lines takes, however large the trace is."""
    event_json(events).write.mode("overwrite").option("compression", "gzip" if gzip else "none").text(path)


def trace_documents(events: DataFrame, by: str) -> DataFrame:
    """(by, document): whole trace documents, one for each file; a file's events must fit one row."""
    line = F.struct(*(c for c in FIELDS if c in events.columns))
    rows = events.select(by, F.struct(*(c for c in ("ts", "tid") if c in events.columns), F.to_json(line).alias("line")).alias("e"))
    lines = F.transform(F.sort_array(F.collect_list("e")), lambda x: x["line"])
    return rows.groupBy(by).agg(F.concat(F.lit('{"traceEvents":['), F.array_join(lines, ","), F.lit("]}")).alias("document"))


def hand_off(document: Column) -> Column:
    """Base64 for a viewer that is given its file inside a script."""
    return F.translate(F.base64(js_escape(document).cast("binary")), "\r\n", "")  # one line


def report_lines(rows: DataFrame, title: str, value: str, name: str, count: str) -> DataFrame:
    """(place, value): lines of a ranked text report, by value, then name; place gives the order, the title is 0."""
    line = F.format_string("%8d ms: %s (%d times, avg %d ms)", F.expr(f"{value} div 1000"), F.col(name), F.col(count), F.expr(f"{value} div 1000 div {count}"))
    head = rows.sparkSession.createDataFrame([(0, f"**** {title}")], "place int, value string")
    placed = ordinals(rows, [F.desc(value), F.col(name)], "place")
    return head.unionByName(placed.select((F.col("place") + 1).cast("int").alias("place"), line.alias("value")))


def write_text(lines: DataFrame, path: str) -> None:
    """Lines in the order of `place`, if there is one; reports are limited lists, so one task writes them."""
    ordered = lines.repartition(1).sortWithinPartitions("place").select("value") if "place" in lines.columns else lines.coalesce(1)
    ordered.write.mode("overwrite").text(path)


def containers(textures: DataFrame, scheme: int = 3, kind: str = "ktx2") -> DataFrame:
    """textures (path, format, width, height, levels array<binary>[, props array<struct<key,value>>]) -> (path, content): files of a kind: ktx2 (with its scheme), ktx or dds."""

    @F.pandas_udf(T.BinaryType())
    def encode(name: pd.Series, width: pd.Series, height: pd.Series, levels: pd.Series, props: pd.Series) -> pd.Series:
        def one(n, w, h, v, p):
            v, p = [bytes(x) for x in v], [(x["key"], x["value"]) for x in (p if p is not None else [])]
            return {"ktx2": lambda: write_ktx2(n, int(w), int(h), v, p, scheme), "ktx": lambda: write_ktx1(n, int(w), int(h), v, p), "dds": lambda: write_dds(n, int(w), int(h), v)}[kind]()

        return pd.Series([one(*x) for x in zip(name, width, height, levels, props, strict=True)])

    props = F.col("props") if "props" in textures.columns else F.array().cast("array<struct<key:string,value:string>>")
    return textures.select("path", encode("format", "width", "height", "levels", props).alias("content"))


def zip_update(entries: DataFrame, key: str = "bundle") -> DataFrame:
    """entries (bundle, name, content) -> (bundle, content): zip files with entries in name order; a bundle must fit one task."""
    import io
    import zipfile

    def one(group: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, content in sorted(zip(group["name"], group["content"], strict=True)):
                z.writestr(zipfile.ZipInfo(name), bytes(content), zipfile.ZIP_DEFLATED)
        return pd.DataFrame({key: [group[key].iloc[0]], "content": [out.getvalue()]})

    return entries.select(key, "name", "content").groupBy(key).applyInPandas(one, f"{key} string, content binary")


# Letters of the levels.
LEVELS = {"debug": "D", "info": "I", "warning": "W", "error": "E"}


def log_lines(messages: DataFrame, release: bool = False) -> DataFrame:
    """messages (level, group, text, file, line, thread, func) -> (level, value). Debug and info show the text alone; others level, group and text, and where they
    come from, on a second line, if they have a file. release: debug messages are dropped."""
    rows = messages.where(F.col("level") != "debug") if release else messages
    letter = F.element_at(F.create_map(*(F.lit(x) for p in LEVELS.items() for x in p)), F.col("level"))
    text = F.regexp_replace("text", r"\n\z", "")
    func = F.when((F.length("func") > 1) & ~F.col("func").endswith("]"), F.concat("func", F.lit("()"))).otherwise(F.col("func"))
    place = F.concat(F.lit("\n"), F.substring_index("file", "/", -1), F.lit(":"), F.col("line").cast("string"), F.lit(": "), F.coalesce("thread", F.lit("")), F.lit(" "), F.coalesce(func, F.lit("")))
    head = F.concat(F.lit("["), letter, F.lit("] "), F.coalesce("group", F.lit("")), F.lit(" "), text)
    return rows.select("level", F.when(F.col("level").isin("debug", "info"), text).otherwise(F.concat(head, F.coalesce(place, F.lit("")))).alias("value"))

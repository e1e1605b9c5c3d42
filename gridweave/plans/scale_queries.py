"""Queries of what must hold for large inputs: documents over several tasks, covered tracks, hot groups, refreshes, observed counters, subtrees, table functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import forest, incremental, memory, nesting, relations, trace
from ..scratch import fresh_path, materialise
from ..sinks import committed
from ..sources import documents, table_functions
from .catalog import query, table
from .file_queries import shares
from .more_queries import _UP, _nodes
from .trace_queries import _PARENTS, WIDE, events, sql_events

# --- documents over several tasks


def _detailed(spark, sf_dir):
    """Events whose details hold brackets, commas and quotes."""
    e = events(spark, sf_dir)
    detail = F.concat(F.lit("f(a, ]b, }c{\""), "detail", F.lit("\\"))
    return e.select("event_id", "tid", "name", F.lit("X").alias("ph"), "ts", "dur", F.create_map(F.lit("detail"), detail).alias("args"))


_DETAIL = "'f(a, ]b, }c{\"' || detail || chr(92)"


@query(f"SELECT tid, name, ts, dur, {_DETAIL} AS detail FROM {sql_events()}")
def trace_by_ranges(spark, sf_dir):
    """One document of all events, read by byte ranges."""
    path = fresh_path(spark, "document")
    committed.write_documents(_detailed(spark, sf_dir), path, gzip=False)
    return documents.trace_events(spark, path, range_bytes=1 << 18).select("tid", "name", "ts", "dur", F.element_at("args", "detail").alias("detail"))


@query(f"SELECT 'tid' || tid || '.json.gz' AS file, CAST(row_number() OVER (PARTITION BY tid ORDER BY ts, event_id) - 1 AS BIGINT) AS place, ts, {_DETAIL} AS detail FROM {sql_events()}")
def committed_documents(spark, sf_dir):
    """A gzip document for each track, published together; place is where an event stands in its document."""
    path = fresh_path(spark, "documents")
    rows = _detailed(spark, sf_dir).withColumns({"file": F.concat(F.lit("tid"), "tid"), "tid": F.col("event_id")})
    committed.write_documents(rows, path, "file")
    found = documents.trace_events(spark, path)
    return found.select(F.substring_index("path", "/", -1).alias("file"), F.col("event_id").alias("place"), "ts", F.element_at("args", "detail").alias("detail"))


@query(f"SELECT event_id, event_id % 5 = 0 AS corrupt, CASE WHEN event_id % 5 <> 0 THEN name END AS name FROM {sql_events()}")
def corrupt_records(spark, sf_dir):
    """Every fifth record of each document lacks a colon; the others are read, and it is told apart."""
    line = F.to_json(F.struct("name", "ts"))
    broken = F.concat(F.lit('{"name" "'), F.col("event_id").cast("string"), F.lit('"}'))
    e = events(spark, sf_dir)
    e = e.select("event_id", shares(e, "tid").alias("part"), F.struct("event_id", F.when(F.col("event_id") % 5 == 0, broken).otherwise(line).alias("line")).alias("r"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["line"]), ",")
    path = fresh_path(spark, "broken")
    e.groupBy("part").agg(F.concat(F.lit('{"traceEvents":['), lines, F.lit("]}")).alias("value")).write.partitionBy("part").text(path)
    found = documents.trace_events(spark, path, corrupt="bad").select(F.regexp_extract("path", "/part=([0-9]+)/", 1).cast("bigint").alias("part"), "event_id", "name", F.col("bad").isNotNull().alias("corrupt"))
    order = e.select("part", F.col("r.event_id").alias("id"))
    placed = relations.row_ordinals(order, ["part"], ["id"], "place").select(F.col("part").alias("p"), "place", "id")
    return found.join(placed, (F.col("part") == F.col("p")) & (F.col("event_id") == F.col("place"))).select(F.col("id").alias("event_id"), "corrupt", F.when(~F.col("corrupt"), F.col("name")).alias("name"))


@query(f"SELECT tid, CAST(row_number() OVER (PARTITION BY tid ORDER BY event_id) - 1 AS BIGINT) AS place, name, ts, dur FROM {sql_events()}")
def lateral_documents(spark, sf_dir):
    """Documents in a column, made rows by SQL alone."""
    table_functions.register(spark)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("event_id", F.to_json(F.struct("name", "ts", "dur")).alias("j")))), lambda r: r["j"])
    events(spark, sf_dir).groupBy("tid").agg(F.concat(F.lit('{"traceEvents":['), F.array_join(lines, ","), F.lit("]}")).alias("document")).createOrReplaceTempView("gridweave_documents")
    return spark.sql("SELECT d.tid, e.* FROM gridweave_documents d, LATERAL document_rows(d.document, 'traceEvents', 'name string, ts bigint, dur bigint') e")


# --- covered tracks and hot groups

_ONE = f"""WITH a AS (SELECT event_id, ts, dur FROM {sql_events()}), e AS (SELECT * FROM a UNION ALL SELECT -1, min(ts) - 5, max(ts + dur) - min(ts) + 9 FROM a),
r AS (SELECT *, row_number() OVER (ORDER BY ts, dur DESC, event_id DESC) AS rank FROM e)
"""


@query(_ONE + "SELECT r.event_id, max_by(p.event_id, p.rank) AS parent_id FROM r LEFT JOIN r p ON p.ts <= r.ts AND r.ts + r.dur <= p.ts + p.dur AND p.rank < r.rank GROUP BY r.event_id")
def covered_track(spark, sf_dir):
    """All events on one track, under one that covers it."""
    e = materialise(events(spark, sf_dir), "events")
    root = e.agg(F.min("ts").alias("a"), F.max(F.col("ts") + F.col("dur")).alias("b")).select(F.lit(-1).cast("bigint").alias("event_id"), F.lit(0).cast("bigint").alias("track"), F.lit("root").alias("name"), F.lit("").alias("detail"), (F.col("a") - 5).alias("ts"), (F.col("b") - F.col("a") + 9).alias("dur"))
    rows = e.select("event_id", F.lit(0).cast("bigint").alias("track"), "name", "detail", "ts", "dur").unionByName(root)
    return trace.nest(rows, ["track"]).select("event_id", "parent_id")


@query(_PARENTS + """, own AS (SELECT event_id, event_id AS anc, 0 AS steps FROM e UNION ALL SELECT * FROM anc),
c AS (SELECT own.event_id, string_agg(h.name, '>' ORDER BY steps) AS chain FROM own JOIN e h ON own.anc = h.event_id GROUP BY own.event_id)
SELECT chain, CAST(length(chain) - length(replace(chain, '>', '')) AS INTEGER) AS depth, count(*) AS n FROM c GROUP BY chain""")
def path_dictionary(spark, sf_dir):
    """Every path of names with the events that end there: events carry a name of their path, which is spelled out once."""
    nested = materialise(trace.nest(events(spark, sf_dir, WIDE), ["tid"], F.col("name")), "nested")
    spelled = nesting.chains(nesting.dictionary(nested)).select(F.col("path").alias("own"), F.array_join("chain", ">").alias("chain"), (F.size("chain") - 1).alias("depth"))
    return nested.groupBy("own").agg(F.count("*").alias("n")).join(spelled, "own").select("chain", "depth", "n")


@query("SELECT l_orderkey, l_linenumber, l_returnflag, coalesce(sum(l_quantity) OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS addr FROM lineitem")
def hot_block_addresses(spark, sf_dir):
    """Running sums in a few groups of very many rows, spread over range partitions."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity")
    found = relations.running_sums(rows, ["l_returnflag"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], "l_quantity", "addr", most=100)
    return found.select("l_orderkey", "l_linenumber", "l_returnflag", "addr")


# --- refreshes and counters


@query(f"""WITH now AS (SELECT * FROM {sql_events()} WHERE tid % 100 <> 7), f AS (SELECT name, CASE WHEN tid % 100 = 3 THEN 2 * dur ELSE dur END AS dur FROM now)
SELECT name, count(*) AS count, CAST(sum(dur) AS BIGINT) AS duration, CAST(98 AS BIGINT) AS untouched FROM f GROUP BY name""")
def refreshed_report(spark, sf_dir):
    """A report over up to 100 files; then one file changes, one goes, and only the changed one is read again. untouched: 100 less the files read and dropped by the refresh."""
    folder, store = fresh_path(spark, "files"), fresh_path(spark, "store")
    e = events(spark, sf_dir).select("name", "dur", (F.col("tid") % 100).alias("file"))
    e.repartition("file").write.partitionBy("file").json(folder)
    files = lambda: spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.col("modificationTime").alias("modified"))
    read = lambda paths: spark.read.schema("name string, dur bigint").json(paths).select(F.col("_metadata.file_path").alias("path"), "name", "dur")
    incremental.refresh(files(), store, read)
    changed = e.where("file = 3").select("name", (2 * F.col("dur")).alias("dur"), "file")
    changed.unionByName(e.where("file = 7").limit(0)).repartition(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file").json(folder)
    now = files().where("path not like '%/file=7/%'")
    done = incremental.refresh(now, store, read)
    untouched = 100 - done["changed"] - (done["gone"] - done["changed"])  # a changed file has a new name, so its old one has gone
    return incremental.report(spark, store).select("name", "count", "duration", F.lit(untouched).cast("bigint").alias("untouched"))


@query(f"SELECT name, CAST(c AS BIGINT) AS n FROM (SELECT count(*) FILTER (WHERE dur > 100000000) AS slow, count(*) FILTER (WHERE name = 'error') AS failed, count(*) AS written FROM {sql_events()}) UNPIVOT (c FOR name IN (slow, failed, written))")
def observed_counters(spark, sf_dir):
    """Counters of the job that writes the rows, observed on the way."""
    path = fresh_path(spark, "counted")
    seen = relations.counted(events(spark, sf_dir), {"slow": F.col("dur") > 100_000_000, "failed": F.col("name") == "error"}, lambda rows: rows.write.parquet(path))
    seen["written"] = spark.read.parquet(path).count()
    return spark.createDataFrame(list(seen.items()), "name string, n bigint")


# --- subtrees

_BOXES = _UP + ", t AS (SELECT up.node, sum(p.d) AS x, count(*) AS z FROM up JOIN p ON up.at = p.node GROUP BY up.node), s AS (SELECT up.at AS node, min(t.x) - 1 AS min_x, max(t.x) + 1 AS max_x, CAST(min(t.z) - 3 AS DOUBLE) AS min_z, CAST(max(t.z) + 3 AS DOUBLE) AS max_z FROM up JOIN t ON up.node = t.node GROUP BY up.at)"


def _subtrees(spark, sf_dir):
    sides = {"min_x": -1.0, "max_x": 1.0, "min_y": 0.0, "max_y": 2.0, "min_z": -3.0, "max_z": 3.0}
    nodes = materialise(_nodes(spark, sf_dir), "nodes")
    boxes = nodes.select("node", *(F.lit(v).alias(k) for k, v in sides.items()))
    return forest.subtree_bounds(nodes, relations.world_boxes(boxes, relations.global_transforms(nodes, "node", "parent", "m"), "node"), "node", "parent")


@query(_BOXES + " SELECT * FROM s")
def subtree_bounds(spark, sf_dir):
    return _subtrees(spark, sf_dir).select("node", "min_x", "max_x", "min_z", "max_z")


@query(_BOXES + " SELECT node FROM s WHERE max_x - 160 > 0 AND 11 - min_z > 0")
def subtree_cull(spark, sf_dir):
    """Nodes whose subtree reaches the inner side of both planes; a subtree that does not goes whole."""
    return relations.cull(_subtrees(spark, sf_dir), [(1.0, 0.0, 0.0, -160.0), (0.0, 0.0, -1.0, 11.0)]).select("node")

"""Trace operators on the driver's tables: events are intervals on a track per user, event_type is the name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import strings
from ..operators import trace
from ..streaming import traces
from .catalog import query, table

_TS = "ts - timestamp_ntz'1970-01-01 00:00:00'"
_MICROS = f"extract(day from {_TS}) * 86400000000L + extract(hour from {_TS}) * 3600000000L + extract(minute from {_TS}) * 60000000L + cast(extract(second from {_TS}) * 1000000 as bigint)"


def events(spark: SparkSession, sf_dir: str, scale: int = 1_000_000) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("tid"), F.col("event_type").alias("name"), F.expr(f"cast({_MICROS} as bigint)").alias("ts"),
        F.floor(F.col("value") * scale).cast("bigint").alias("dur"), F.col("props").alias("detail"),
    )


def sql_events(scale: int = 1_000_000) -> str:
    return f"(SELECT event_id, user_id AS tid, event_type AS name, epoch_us(ts) AS ts, CAST(floor(value * {scale}) AS BIGINT) AS dur, props AS detail FROM events)"


WIDE = 1_000_000_000  # long enough for events of a user to nest
_PARENTS = f"""
WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY ts, dur DESC, event_id DESC) AS rank FROM {sql_events(WIDE)}),
par AS (SELECT e.event_id, max_by(p.event_id, p.rank) AS parent_id FROM e JOIN e p ON e.tid = p.tid AND p.ts <= e.ts AND e.ts + e.dur <= p.ts + p.dur AND p.rank < e.rank GROUP BY e.event_id),
anc AS (SELECT event_id, parent_id AS anc, 1 AS steps FROM par UNION ALL SELECT anc.event_id, par.parent_id, anc.steps + 1 FROM anc JOIN par ON anc.anc = par.event_id)
"""


@query("SELECT count(*) AS n, CAST(sum(dur) AS BIGINT) AS us, min(ts) AS first_ts, max(ts + dur) AS last_ts, (max(ts + dur) - min(ts)) * 1e-6 AS span FROM " + sql_events(), "span_totals")
def span_totals(spark, sf_dir):
    return trace.span(events(spark, sf_dir))


@query(_PARENTS + ", d AS (SELECT event_id, max(steps) AS depth FROM anc GROUP BY event_id) SELECT e.event_id, par.parent_id, CAST(coalesce(d.depth, 0) AS INTEGER) AS depth FROM e LEFT JOIN par ON e.event_id = par.event_id LEFT JOIN d ON e.event_id = d.event_id")
def nesting(spark, sf_dir):
    return trace.nest(events(spark, sf_dir, WIDE), ["tid"]).select("event_id", "parent_id", "depth")


@query(_PARENTS + """, s AS (SELECT par.parent_id AS id, e.name, CAST(sum(e.dur) AS BIGINT) AS dur_sub FROM e JOIN par ON e.event_id = par.event_id GROUP BY 1, 2)
SELECT e.event_id, e.dur, coalesce(s.dur_sub, 0) AS dur_sub, greatest(0, e.dur - coalesce(s.dur_sub, 0)) AS dur_self FROM e LEFT JOIN s ON e.event_id = s.id AND e.name = s.name""")
def self_time(spark, sf_dir):
    return trace.self_time(trace.nest(events(spark, sf_dir, WIDE), ["tid"])).select("event_id", "dur", "dur_sub", "dur_self")


@query(_PARENTS + """SELECT e.event_id, pe.event_id AS parent_id, pe.name AS parent_name FROM e JOIN par ON e.event_id = par.event_id JOIN e pe ON par.parent_id = pe.event_id WHERE pe.name <> e.name""")
def parent_with_other_name(spark, sf_dir):
    return trace.other_parent(events(spark, sf_dir, WIDE), ["tid"]).select("event_id", "parent_id", "parent_name")


@query(_PARENTS + "SELECT anc.event_id, min_by(anc.anc, steps) AS holder FROM anc JOIN e ON anc.anc = e.event_id WHERE e.name = 'purchase' GROUP BY anc.event_id")
def nearest_ancestor_of_kind(spark, sf_dir):
    return trace.nearest_ancestor(events(spark, sf_dir, WIDE), ["tid"], F.col("name") == "purchase").select("event_id", "holder").where("holder is not null")


@query(_PARENTS + """, a AS (SELECT DISTINCT e.event_id FROM anc JOIN e ON anc.event_id = e.event_id JOIN e h ON anc.anc = h.event_id WHERE h.name = e.name)
SELECT name, CAST(sum(dur) AS BIGINT) AS us, count(*) AS n FROM e WHERE event_id NOT IN (SELECT event_id FROM a) GROUP BY name""")
def outermost_of_name(spark, sf_dir):
    return trace.cost(trace.outermost(events(spark, sf_dir, WIDE), ["tid"]), ["name"])


@query(_PARENTS + """, c AS (SELECT anc.event_id, string_agg(h.name, '>' ORDER BY steps) AS chain FROM anc JOIN e h ON anc.anc = h.event_id GROUP BY anc.event_id)
SELECT name, coalesce(chain, '') AS chain, count(*) AS n, CAST(sum(dur) AS BIGINT) AS us FROM e LEFT JOIN c ON e.event_id = c.event_id GROUP BY 1, 2""")
def ordered_path_groups(spark, sf_dir):
    return trace.chain_costs(events(spark, sf_dir, WIDE), ["tid"], ["name"]).select("name", F.array_join("chain", ">").alias("chain"), "n", "us")


@query("SELECT detail, name, CAST(sum(dur) AS BIGINT) AS us FROM " + sql_events() + " GROUP BY 1, 2")
def cost_by_function_and_path(spark, sf_dir):
    return trace.cost(events(spark, sf_dir), ["detail", "name"]).drop("n")


@query("SELECT detail, count(*) AS n, CAST(sum(dur) AS BIGINT) AS us, CAST(sum(dur) // 1000 AS BIGINT) AS ms, CAST(sum(dur) // 1000 // count(*) AS BIGINT) AS avg_ms FROM " + sql_events() + " GROUP BY 1")
def instantiation_average(spark, sf_dir):
    return trace.averages(trace.cost(events(spark, sf_dir), ["detail"])).select("detail", "n", "us", "ms", "avg_ms")


@query("SELECT CAST(sum(CASE WHEN name = 'view' THEN dur ELSE 0 END) AS BIGINT) AS parse_us, CAST(sum(CASE WHEN name = 'click' THEN dur ELSE 0 END) AS BIGINT) AS codegen_us, count(CASE WHEN name IN ('view', 'click') THEN 1 END) AS n FROM " + sql_events())
def conditional_totals(spark, sf_dir):
    return trace.kind_totals(events(spark, sf_dir), {"parse_us": "view", "codegen_us": "click"})


@query("SELECT tid, name, count(*) AS n, CAST(sum(dur) AS BIGINT) AS us, bool_or(dur > 100000000) AS slow FROM " + sql_events() + " GROUP BY 1, 2")
def header_flags(spark, sf_dir):
    return events(spark, sf_dir).groupBy("tid", "name").agg(F.count("*").alias("n"), F.sum("dur").alias("us"), F.bool_or(F.col("dur") > 100_000_000).alias("slow"))


@query(_PARENTS + """, s AS (SELECT par.parent_id AS id, e.name, sum(e.dur) AS sub FROM e JOIN par ON e.event_id = par.event_id GROUP BY 1, 2)
SELECT e.name, count(*) AS count, CAST(sum(e.dur) AS BIGINT) AS duration, CAST(coalesce(sum(s.sub), 0) AS BIGINT) AS duration_sub, CAST(greatest(0, sum(e.dur) - coalesce(sum(s.sub), 0)) AS BIGINT) AS duration_self FROM e LEFT JOIN s ON e.event_id = s.id AND e.name = s.name GROUP BY e.name""")
def partial_then_final(spark, sf_dir):
    timed = trace.self_time(trace.nest(events(spark, sf_dir, WIDE), ["tid"]))
    return trace.merge_timings(trace.timings(timed, ["tid", "name"]), ["name"])


@query("SELECT tid, max(CASE WHEN name = 'view' THEN dur END) AS view_us, max(CASE WHEN name = 'click' THEN dur END) AS click_us, min(CASE WHEN name = 'purchase' THEN ts END) AS first_purchase, greatest(coalesce(max(CASE WHEN name = 'error' THEN dur END), 0), 0) AS error_us FROM " + sql_events() + " GROUP BY tid")
def pivot_totals(spark, sf_dir):
    p = trace.pivot(events(spark, sf_dir), ["tid"], {"view_us": "view", "click_us": "click", "error_us": "error"}, {"first_purchase": "purchase"})
    return p.withColumn("error_us", F.greatest(F.coalesce("error_us", F.lit(0)), F.lit(0)))


@query("WITH p AS (SELECT tid, CAST(sum(CASE WHEN name = 'view' THEN dur ELSE 0 END) AS BIGINT) AS v, CAST(sum(CASE WHEN name = 'click' THEN dur ELSE 0 END) AS BIGINT) AS c FROM " + sql_events() + " GROUP BY tid) SELECT CAST(sum(v) // 10 AS BIGINT) AS v, CAST(sum(c) // 10 AS BIGINT) AS c FROM p")
def add_and_divide(spark, sf_dir):
    return trace.add_and_divide(trace.kind_totals(events(spark, sf_dir), {"v": "view", "c": "click"}, ["tid"]), ["v", "c"], 10)


@query("WITH p AS (SELECT tid, max(CASE WHEN name = 'view' THEN dur END) AS view, max(CASE WHEN name = 'click' THEN dur END) AS click FROM " + sql_events() + " GROUP BY tid) SELECT tid, 'view' AS name, view AS us FROM p WHERE view IS NOT NULL UNION ALL SELECT tid, 'click', click FROM p WHERE click IS NOT NULL")
def unpivot_totals(spark, sf_dir):
    p = trace.pivot(events(spark, sf_dir), ["tid"], {"view": "view", "click": "click"}, {})
    return p.unpivot(["tid"], ["view", "click"], "name", "us").where("us is not null")


@query("SELECT tid, coalesce(min(CASE WHEN name <> 'error' THEN ts END), min(ts)) AS start, coalesce(max(CASE WHEN name <> 'error' THEN ts + dur END), max(ts + dur)) AS \"end\", max(CASE WHEN name = 'error' THEN ts + dur END) AS free_end, count(*) AS count, count(CASE WHEN name = 'error' THEN 1 END) AS free_count FROM " + sql_events() + " GROUP BY tid")
def track_stats(spark, sf_dir):
    return trace.tracks(events(spark, sf_dir), "tid", F.col("name") == "error")


@query("WITH t AS (SELECT tid, CAST(sum(dur) AS BIGINT) AS used, CAST(sum(CASE WHEN name = 'error' THEN dur ELSE 0 END) AS BIGINT) AS free FROM " + sql_events() + " GROUP BY tid) SELECT tid, CASE WHEN used = 0 THEN 0 ELSE 100.0 * (used - free) / used END AS percent FROM t")
def percent_used(spark, sf_dir):
    return trace.percent_used(events(spark, sf_dir), "tid", F.col("name") == "error")


@query(f"WITH g AS (SELECT name, tid, CAST(sum(dur) AS BIGINT) AS us FROM {sql_events()} GROUP BY 1, 2), t AS (SELECT *, sum(us) OVER (PARTITION BY name) AS total FROM g) SELECT name, tid, us FROM t WHERE us / total >= 0.01")
def share_filter(spark, sf_dir):
    return trace.share_filter(trace.cost(events(spark, sf_dir), ["name", "tid"]).drop("n"), "us", ["name"])


@query("SELECT tid, CAST(sum(dur) AS BIGINT) AS us, count(*) AS n FROM " + sql_events() + " GROUP BY tid ORDER BY us DESC, tid LIMIT 10")
def top_files(spark, sf_dir):
    return trace.top(trace.cost(events(spark, sf_dir), ["tid"]), [F.desc("us"), F.col("tid")], trace.LIMITS["files"])


@query("SELECT detail, CAST(sum(dur) AS BIGINT) AS us, count(*) AS n FROM " + sql_events() + " GROUP BY detail ORDER BY us DESC, n DESC, detail DESC LIMIT 30")
def top_templates(spark, sf_dir):
    return trace.top(trace.cost(events(spark, sf_dir), ["detail"]), [F.desc("us"), F.desc("n"), F.desc("detail")], trace.LIMITS["templates"])


@query(f"WITH g AS (SELECT name, detail, CAST(sum(dur) AS BIGINT) AS us FROM {sql_events()} GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY us DESC, detail) AS place FROM g) SELECT name, detail, us, CAST(place AS INTEGER) AS place FROM r WHERE place <= 6")
def top_chains_of_header(spark, sf_dir):
    return trace.top_of_each(trace.cost(events(spark, sf_dir), ["name", "detail"]).drop("n"), "name", [F.desc("us"), F.col("detail")], trace.LIMITS["chains"] + 1)


@query("SELECT event_id, name, dur FROM " + sql_events() + " WHERE dur >= 10000 AND name IN ('view', 'click')")
def minimum_duration(spark, sf_dir):
    return trace.at_least(events(spark, sf_dir), names=["view", "click"]).select("event_id", "name", "dur")


@query("SELECT event_id, CASE name WHEN 'view' THEN 'ParseFile' WHEN 'click' THEN 'OptFunction' WHEN 'error' THEN 'Free' END AS kind FROM " + sql_events() + " WHERE name IN ('view', 'click', 'error')")
def name_to_type(spark, sf_dir):
    kinds = {"view": "ParseFile", "click": "OptFunction", "error": "Free"}
    return events(spark, sf_dir).select("event_id", trace.event_type(F.col("name"), kinds).alias("kind")).where("kind is not null")


@query("SELECT event_id, greatest(ts - 1704200000000000, 0) AS ts, dur + least(ts - 1704200000000000, 0) AS dur FROM " + sql_events() + " WHERE dur + least(ts - 1704200000000000, 0) > 0")
def start_clamp(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", F.lit("X").alias("ph"), (F.col("ts") - 1704200000000000).alias("ts"), "dur", F.lit(0).alias("depth"))
    return traces.admitted(e, 0).select("event_id", "ts", "dur")


@query("SELECT event_id, CAST(json_extract(detail, '$.k') AS BIGINT) AS k FROM " + sql_events())
def json_args(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", F.from_json("detail", "k bigint")["k"].alias("k"))


@query("SELECT DISTINCT tid, CAST(dense_rank() OVER (ORDER BY first_ts, tid) AS INTEGER) AS track FROM (SELECT tid, min(ts) AS first_ts FROM " + sql_events() + " GROUP BY tid)")
def track_ordinals(spark, sf_dir):
    return trace.track_ordinals(events(spark, sf_dir), "tid").select("tid", F.col("ordinal").alias("track"))


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'tion') ", "search_contains")
def search_contains(spark, sf_dir):
    return trace.search(table(spark, sf_dir, "documents"), "text", "TION").select("doc_id")


@query("SELECT doc_id FROM documents WHERE starts_with(lower(text), 't')", "search_prefix")
def search_prefix(spark, sf_dir):
    return trace.search(table(spark, sf_dir, "documents"), "text", "T").select("doc_id")


@query("SELECT page_id, regexp_extract(url, '[^/]*$') AS base, regexp_replace(url, '\\.[^./]*$', '') AS stem FROM pages")
def path_parts(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", strings.file_name(u).alias("base"), strings.without_extension(u).alias("stem"))


@query("""SELECT page_id, CASE WHEN length(html) > 70 THEN substr(html, 1, 68) || '...' ELSE html END AS short, translate(url, '/', '|') AS bars FROM pages""")
def name_truncation(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", strings.truncate(F.col("html")).alias("short"), F.translate("url", "/", "|").alias("bars"))


@query("""SELECT p_partkey, 'v<' || replace(p_name, ' ', '<') || '>>::' || p_type AS name, 'v<$>::' || p_type AS collapsed FROM part""")
def collapse_names(spark, sf_dir):
    name = F.concat(F.lit("v<"), F.replace("p_name", F.lit(" "), F.lit("<")), F.lit(">>::"), F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("name"), strings.collapse_name(name).alias("collapsed"))


@query("""SELECT o_orderkey, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN (n >> 10) || ' KiB' WHEN n < 1073741824 THEN (n >> 20) || ' MiB' ELSE (n >> 30) || ' GiB' END AS size
FROM (SELECT o_orderkey, CAST(floor(o_totalprice * 100) AS BIGINT) AS n FROM orders)""")
def bytes_text(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", strings.bytes_text(F.floor(F.col("o_totalprice") * 100)).alias("size"))


@query("""SELECT page_id, regexp_extract(url, '[^/]*$') ~ '^[^.]*$' OR regexp_matches(regexp_extract(url, '[^/]*$'), '\\.[hiHI][^.]*$') AS header FROM pages""")
def header_predicate(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", strings.is_header(F.col("url")).alias("header"))

"""Trace events: decoding, nesting, self time, reports and tracks.

Events are rows (event_id, track..., name, ts, dur, detail); times are integer microseconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.strings import collapse_name, is_header, truncate
from ..scratch import materialise
from . import nesting, relations

# The event names that carry build cost.
BUILD_NAMES = {
    "ExecuteCompiler": "Compiler",
    "Frontend": "FrontEnd",
    "Backend": "BackEnd",
    "Source": "ParseFile",
    "ParseTemplate": "ParseTemplate",
    "ParseClass": "ParseClass",
    "InstantiateClass": "InstantiateClass",
    "InstantiateFunction": "InstantiateFunction",
    "OptModule": "OptModule",
    "OptFunction": "OptFunction",
}
#: Report limits.
LIMITS = {"files": 10, "templates": 30, "functions": 30, "headers": 10, "chains": 5, "name": 70, "min_us": 10_000}


def event_type(name: Column, names: dict[str, str] = BUILD_NAMES) -> Column:
    """Kind of an event by its name; null for other names."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), name)


def decode(events: DataFrame, names: dict[str, str] = BUILD_NAMES) -> DataFrame:
    """Complete events ("X") with a known name, a start and a duration; args.detail becomes detail, else args.name, else empty."""
    typed = events.where("ph = 'X' and ts is not null and dur is not null").withColumn("type", event_type(F.col("name"), names)).where("type is not null")
    detail = F.coalesce(F.try_element_at("args", F.lit("detail")), F.try_element_at("args", F.lit("name")), F.try_element_at(F.map_values("args"), F.lit(1)), F.lit(""))
    return typed.withColumn("detail", detail).drop("args")


def nest(events: DataFrame, tracks: list[str], step: Column | None = None, marks: dict[str, Column] | None = None, keys: dict[str, Column] | None = None) -> DataFrame:
    """Events (tracks..., event_id, name, detail, ts, dur) with their place among the events that hold them, as nesting.nest() gives it."""
    return nesting.nest(events.select(*tracks, "event_id", "name", "detail", "ts", "dur"), tracks, step, marks, keys)


def self_time(nested: DataFrame) -> DataFrame:
    """Adds dur_sub, the time of direct children with the same name, and dur_self."""
    children = nested.where("parent_id is not null").groupBy(F.col("parent_id").alias("event_id"), "name").agg(F.sum("dur").alias("dur_sub"))
    out = nested.join(children, ["event_id", "name"], "left").withColumn("dur_sub", F.coalesce("dur_sub", F.lit(0)))
    return out.withColumn("dur_self", F.greatest(F.lit(0), F.col("dur") - F.col("dur_sub")))


def timings(events: DataFrame, by: list[str]) -> DataFrame:
    """Partial state of a report: count, duration and duration inside same-named children; merges by sums."""
    return events.groupBy(*by).agg(F.count("*").alias("count"), F.sum("dur").alias("duration"), F.sum("dur_sub").alias("duration_sub"))


def merge_timings(parts: DataFrame, by: list[str]) -> DataFrame:
    merged = parts.groupBy(*by).agg(F.sum("count").alias("count"), F.sum("duration").alias("duration"), F.sum("duration_sub").alias("duration_sub"))
    return merged.withColumn("duration_self", F.greatest(F.lit(0), F.col("duration") - F.col("duration_sub")))


def share_filter(rows: DataFrame, value: str, group: list[str], least: float = 0.01) -> DataFrame:
    """Rows whose share of their group's total is at least `least`; totals are aggregated, then joined, so no group meets in one task."""
    totals = rows.groupBy(*group).agg(F.sum(value).alias("__total"))
    return rows.join(totals, group).where(F.coalesce(F.try_divide(F.col(value).cast("double"), F.col("__total")), F.lit(0.0)) >= least).drop("__total")


def template_cost(events: DataFrame, tracks: list[str], top: int = LIMITS["templates"]) -> DataFrame:
    """Instantiations by collapsed name, without those inside an event of the same collapsed name."""
    named = F.when(F.col("detail").contains("<"), F.col("detail"))
    nested = nest(events, tracks, keys={"inside": collapse_name(F.col("detail"))})
    cost = nested.where("not inside").withColumn("collapsed", collapse_name(named)).where("collapsed is not null").groupBy("collapsed").agg(F.sum("dur").alias("us"), F.count("*").alias("count"))
    return cost.orderBy(F.desc("us"), F.desc("count"), F.desc("collapsed")).limit(top).withColumn("collapsed", truncate(F.col("collapsed")))


def header_cost(events: DataFrame, tracks: list[str], top: int = LIMITS["headers"], chains: int = LIMITS["chains"] + 1, only_roots: bool = True) -> DataFrame:
    """Costliest headers with their costliest include chains (nearest includer first). A header is a root where no header includes it."""
    source = F.col("name") == "Source"
    nested = materialise(nest(events, tracks, F.when(source, F.col("detail")), {"includer": source & is_header(F.col("detail"))}), "nested")
    headers = nested.where(source & is_header(F.col("detail")))
    cost = headers.groupBy("detail").agg(F.sum("dur").alias("us"), F.count("*").alias("count"), F.bool_or(F.col("includer").isNull()).alias("root"))
    cost = cost.where("root") if only_roots else cost
    best = cost.orderBy(F.desc("us"), "detail").limit(top)
    paths = headers.join(best.select("detail"), "detail", "left_semi").groupBy("detail", "path").agg(F.sum("dur").alias("us"), F.count("*").alias("count"))
    spelled = paths.join(nesting.chains(nesting.dictionary(nested)), "path", "left").withColumn("chain", F.coalesce("chain", F.array().cast("array<string>")))
    ranked = spelled.withColumn("place", F.row_number().over(Window.partitionBy("detail").orderBy(F.desc("us"), "chain"))).where(F.col("place") <= chains)
    listed = ranked.groupBy("detail").agg(F.array_sort(F.collect_list(F.struct("place", "chain", "us", "count"))).alias("chains"))
    return best.join(listed, "detail").orderBy(F.desc("us"), "detail")


def tracks(events: DataFrame, track: str, free: Column) -> DataFrame:
    """Span and counts of each track; free blocks count for the span only where nothing else does."""
    used = ~free
    low, high = F.col("ts"), F.col("ts") + F.col("dur")
    return events.groupBy(track).agg(
        F.coalesce(F.min(F.when(used, low)), F.min(low)).alias("start"), F.coalesce(F.max(F.when(used, high)), F.max(high)).alias("end"),
        F.max(F.when(free, high)).alias("free_end"), F.count("*").alias("count"), F.count_if(free).alias("free_count"),
    )


def search(rows: DataFrame, column: str, text: str, files: int = 2) -> DataFrame:
    """One character: prefix; more: anywhere; both without case. No search over one file or none, or for nothing."""
    if files <= 1 or not text:
        return rows
    name = F.lower(column)
    return rows.where(name.startswith(text.lower()) if len(text) == 1 else name.contains(text.lower()))


def viewer_names(events: DataFrame) -> DataFrame:
    """Names for a viewer: source events show their file, symbol events their detail; the process id goes."""
    file = F.substring_index("detail", "/", -1)
    shown = F.when(F.col("name").isin("Source", "OptModule"), file).when(F.col("name").isin("InstantiateClass", "InstantiateFunction", "OptFunction"), F.col("detail")).otherwise(F.col("name"))
    return events.withColumn("name", F.coalesce(F.when(F.col("detail") != "", shown), F.col("name"))).drop("pid")


def refreshed(files: DataFrame, cached: DataFrame) -> DataFrame:
    """Files (path, modified) whose stamp differs from the cached one, or that are new."""
    old = cached.select("path", F.col("modified").alias("__old"))
    return files.join(old, "path", "left").where(~F.col("modified").eqNullSafe(F.col("__old"))).drop("__old")


# --- filters, totals and layouts


def at_least(events: DataFrame, least_us: int = LIMITS["min_us"], names: list[str] | None = None) -> DataFrame:
    """Events of at least a duration, of some names only if they are given."""
    found = events.where(F.col("dur") >= least_us)
    return found if names is None else found.where(F.col("name").isin(names))


def nearest_ancestor(events: DataFrame, tracks: list[str], condition: Column, out: str = "holder") -> DataFrame:
    """Nested events with the id of the innermost ancestor that meets the condition; null without one."""
    return nest(events, tracks, marks={out: condition})


def outermost(events: DataFrame, tracks: list[str], field: str = "name") -> DataFrame:
    """Nested events without an ancestor that has the same name, or detail."""
    return nest(events, tracks, keys={"__inside": F.col(field)}).where("not __inside").drop("__inside")


def other_parent(events: DataFrame, tracks: list[str]) -> DataFrame:
    """Nested events whose direct parent has another name, with parent_name; those without a parent, or without a name on either side, are dropped."""
    nested = nest(events, tracks, F.coalesce(F.concat(F.lit("="), "name"), F.lit("")))
    parents = nesting.dictionary(nested).select(F.col("own").alias("path"), F.expr("if(step like '=%', substring(step, 2), null)").alias("parent_name"))
    return nested.drop("own", "step").join(parents, "path").where("parent_name <> name").drop("path")


def chain_costs(events: DataFrame, tracks: list[str], by: list[str], field: str = "name") -> DataFrame:
    """(by..., chain, n, us): count and time of each ordered chain of ancestors, innermost first; ancestors without the field are in no chain. Rows are grouped by the path's name; only the groups are spelled out."""
    nested = materialise(nest(events, tracks, F.col(field)), "nested")
    costs = nested.groupBy(*by, "path").agg(F.count("*").alias("n"), F.sum("dur").alias("us"))
    spelled = costs.join(nesting.chains(nesting.dictionary(nested)), "path", "left")
    return spelled.select(*by, F.coalesce("chain", F.array().cast("array<string>")).alias("chain"), "n", "us")


def cost(events: DataFrame, by: list[str]) -> DataFrame:
    """(by..., us, n)."""
    return events.groupBy(*by).agg(F.sum("dur").alias("us"), F.count("*").alias("n"))


def averages(costs: DataFrame) -> DataFrame:
    """Adds whole milliseconds, in all and per event, to (us, n)."""
    return costs.selectExpr("*", "us div 1000 as ms", "us div 1000 div n as avg_ms")


def kind_totals(events: DataFrame, kinds: dict[str, str], by: list[str] = ()) -> DataFrame:
    """(by..., one column of time for each entry {column: name}, n: events of any of these names)."""
    sums = [F.sum(F.when(F.col("name") == name, F.col("dur")).otherwise(0)).alias(column) for column, name in kinds.items()]
    return events.groupBy(*by).agg(*sums, F.count_if(F.col("name").isin(list(kinds.values()))).alias("n"))


def pivot(events: DataFrame, by: list[str], last: dict[str, str], first: dict[str, str]) -> DataFrame:
    """One row of each group: columns {column: name}; `last`: the largest duration of a name, `first`: the least start."""
    value = lambda name, c: F.when(F.col("name") == name, F.col(c))
    return events.groupBy(*by).agg(*(F.max(value(n, "dur")).alias(c) for c, n in last.items()), *(F.min(value(n, "ts")).alias(c) for c, n in first.items()))


def add_and_divide(rows: DataFrame, columns: list[str], by: int) -> DataFrame:
    """Sums of the columns over all rows, each divided as a whole number."""
    return rows.agg(*(F.sum(c).alias(c) for c in columns)).selectExpr(*(f"{c} div {by} as {c}" for c in columns))


def span(events: DataFrame) -> DataFrame:
    """(n, us, first_ts, last_ts, span): span in seconds."""
    end = F.col("ts") + F.col("dur")
    return events.agg(F.count("*").alias("n"), F.sum("dur").alias("us"), F.min("ts").alias("first_ts"), F.max(end).alias("last_ts"), ((F.max(end) - F.min("ts")) * F.lit(1e-6)).alias("span"))


def percent_used(events: DataFrame, track: str, free: Column) -> DataFrame:
    """(track, percent): share of a track's time that is not free; 0 where there is none."""
    t = events.groupBy(track).agg(F.sum("dur").alias("used"), F.sum(F.when(free, F.col("dur")).otherwise(0)).alias("free"))
    return t.select(track, F.coalesce(F.try_divide((F.col("used") - F.col("free")) * 100.0, F.col("used").cast("double")), F.lit(0.0)).alias("percent"))


def top(costs: DataFrame, order: list[Column], n: int) -> DataFrame:
    return costs.orderBy(*order).limit(n)


def top_of_each(costs: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group, with their place."""
    return costs.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("place") <= n)


# The totals of a build trace, column by name, and the two starts.
TOTALS = {
    "compiler": "Total ExecuteCompiler", "frontend": "Total Frontend", "source": "Total Source", "functions": "Total InstantiateFunction", "classes": "Total InstantiateClass",
    "codegen": "Total CodeGen Function", "debug": "Total DebugType", "backend": "Total Backend", "optimizer": "Total Optimizer", "passes": "Total CodeGenPasses", "opt_functions": "Total OptFunction",
}
STARTS = {"front": "Frontend", "back": "Backend"}


def build_totals(events: DataFrame, by: list[str], totals: dict[str, str] = TOTALS, starts: dict[str, str] = STARTS) -> DataFrame:
    """One row of each group: all totals (0 without), front (0 without) and back, which is not before the front end's end."""
    p = pivot(events, by, totals, starts)
    p = p.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in totals}).withColumn("front", F.coalesce("front", F.lit(0)))
    return p.withColumn("back", F.greatest(F.coalesce("back", F.lit(0)), F.col("front") + F.col("frontend")))


def totals_track(stats: DataFrame, by: list[str]) -> DataFrame:
    """(by..., place, ph, name, label, ts, dur, percent): a name row and eleven positioned rows for each row of build_totals(); parts are clamped to what holds them."""
    c = F.col
    classes = F.least(c("classes"), c("functions"))
    at_codegen = c("front") + c("source") + c("functions")
    codegen = F.when(at_codegen + c("codegen") > c("back"), c("back") - at_codegen).otherwise(c("codegen"))
    at_debug = at_codegen + codegen
    debug = F.when(c("debug") * 2 > c("back"), c("back") - at_debug).otherwise(c("debug"))
    after = c("back") + c("optimizer")
    rows = [
        ("ExecuteCompiler", F.lit(0), c("compiler")), ("Frontend", c("front"), c("frontend")), ("Source", c("front"), c("source")), ("InstantiateFunction", c("front") + c("source"), c("functions")),
        ("InstantiateClass", c("front") + c("source"), classes), ("CodeGen Function", at_codegen, codegen), ("Debug", at_debug, debug), ("Backend", c("back"), c("backend")),
        ("Optimizer", c("back"), c("optimizer")), ("CodeGenPasses", after, c("passes")), ("OptFunction", after, c("opt_functions")),
    ]
    kind = lambda x: x.cast("bigint")
    percent = lambda d: F.coalesce(F.try_divide(d * F.lit(100.0), c("compiler").cast("double")), F.lit(0.0))
    row = lambda k, ph, name, ts, dur, p: F.struct(F.lit(k).alias("place"), F.lit(ph).alias("ph"), F.lit(name).alias("name"), kind(ts).alias("ts"), kind(dur).alias("dur"), p.alias("percent"))
    head = row(0, "M", "thread_name", F.lit(None), F.lit(None), F.lit(None).cast("double"))
    every = F.array(head, *(row(k, "X", name, ts, dur, percent(dur)) for k, (name, ts, dur) in enumerate(rows, 1)))
    out = stats.select(*by, F.explode(every).alias("r")).select(*by, "r.*")
    label = F.when(c("ph") == "M", "Build Totals").otherwise(F.concat(F.format_string("%.0f%% ", "percent"), c("name")))
    return out.withColumn("label", label)


def with_totals(events: DataFrame, totals: DataFrame) -> DataFrame:
    """Report events with the totals track appended."""
    return relations.append([events, totals])


def report_order(events: DataFrame) -> list[Column]:
    """Order of a written report: phase, track, longest first, name."""
    return [F.col("ph"), F.col("tid"), F.desc("dur"), F.col("name")]


def catalog_order(by_duration: bool) -> list[Column]:
    """Order of a catalog: by id, or by folder, longest first, id."""
    return [F.col("folder"), F.desc("duration"), F.col("id")] if by_duration else [F.col("id")]


def track_ordinals(events: DataFrame, track: str) -> DataFrame:
    """(track, ordinal): tracks numbered from 1 by where each is first seen."""
    first = events.groupBy(track).agg(F.min("ts").alias("__first"))
    return relations.ordinals(first, ["__first", track]).select(track, (F.col("ordinal") + 1).cast("int").alias("ordinal"))


def repacked(events: DataFrame, track: str) -> DataFrame:
    """Events of each track laid end to end from 0, by name, then duration: a running sum of what comes before."""
    return relations.running_sums(events.drop("ts"), [track], ["name", "dur", "event_id"], "dur", "ts").select(*events.columns)


def largest_id(events: DataFrame, id_col: str) -> DataFrame:
    return events.agg(F.max(id_col).alias("largest"))


def time_range(file: Column, seconds: Column) -> Column:
    """Script that sets a viewer's range from 0 to some seconds, in whole nanoseconds; null for 0."""
    nanos = (seconds * F.lit(1e9)).cast("bigint")
    return F.when(seconds != 0, F.concat(F.lit("var objTime = {perfetto:{keepApiOpen:true,timeStart:0n,timeEnd:"), nanos.cast("string"), F.lit("n}};")))

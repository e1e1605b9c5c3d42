"""Reports, layouts, images, scenes and math on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import strings, vectors
from ..operators import image, memory, relations, textures, trace
from .catalog import query, table
from .image_queries import _C, _P, pixels, rgba
from .trace_queries import _PARENTS, WIDE, events, sql_events

# --- the build report


def _sources(spark, sf_dir):
    """Events as parsed files: a third are .cpp files, the others headers."""
    e = events(spark, sf_dir, WIDE)
    end = F.when(F.col("event_id") % 3 == 0, ".cpp").otherwise(".h")
    return e.withColumn("detail", F.concat(F.lit("d/f"), F.col("event_id") % 7, end)).withColumn("name", F.when(F.col("name") == "error", "Other").otherwise("Source"))


_SOURCES = _PARENTS + """, x AS (SELECT event_id, dur, 'd/f' || (event_id % 7) || CASE WHEN event_id % 3 = 0 THEN '.cpp' ELSE '.h' END AS detail, event_id % 3 <> 0 AND name <> 'error' AS header, name <> 'error' AS source FROM e),
c AS (SELECT anc.event_id, list(h.detail ORDER BY steps) FILTER (WHERE h.source) AS chain, bool_or(h.header) AS inside FROM anc JOIN x h ON anc.anc = h.event_id GROUP BY anc.event_id),
hd AS (SELECT x.event_id, x.detail, x.dur, coalesce(array_to_string(c.chain, '>'), '') AS chain, NOT coalesce(c.inside, false) AS root FROM x LEFT JOIN c ON x.event_id = c.event_id WHERE x.header),
cost AS (SELECT detail, CAST(sum(dur) AS BIGINT) AS us, count(*) AS count, bool_or(root) AS root FROM hd GROUP BY detail)
"""


@query(_SOURCES + "SELECT detail, us, count, root FROM cost WHERE root ORDER BY us DESC, detail LIMIT 10", "header_cost_report")
def header_cost_report(spark, sf_dir):
    return trace.header_cost(_sources(spark, sf_dir), ["tid"]).select("detail", "us", "count", "root")


@query(_SOURCES + """, best AS (SELECT detail FROM cost WHERE root ORDER BY us DESC, detail LIMIT 10), p AS (SELECT detail, chain, CAST(sum(dur) AS BIGINT) AS us, count(*) AS count FROM hd WHERE detail IN (SELECT detail FROM best) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY detail ORDER BY us DESC, string_split(chain, '>')) AS place FROM p) SELECT detail, CAST(place AS INTEGER) AS place, us, count FROM r WHERE place <= 6""")
def header_chains(spark, sf_dir):
    found = trace.header_cost(_sources(spark, sf_dir), ["tid"])
    return found.select("detail", F.explode("chains").alias("c")).select("detail", "c.place", "c.us", "c.count")


@query(_PARENTS + """, inner_ AS (SELECT DISTINCT anc.event_id FROM anc WHERE anc.anc % 5 = anc.event_id % 5) SELECT 'T' || (event_id % 5) || '<$>' AS collapsed, CAST(sum(dur) AS BIGINT) AS us, count(*) AS count FROM e WHERE event_id NOT IN (SELECT event_id FROM inner_) GROUP BY 1""")
def template_report(spark, sf_dir):
    e = events(spark, sf_dir, WIDE)
    named = e.withColumn("detail", F.concat(F.lit("T"), F.col("event_id") % 5, F.lit("<"), "event_id", F.lit("<x>>")))
    return trace.template_cost(named, ["tid"])


_MAP = {"compiler": "view", "frontend": "click", "source": "purchase", "functions": "error", "classes": "view", "codegen": "click", "debug": "error", "backend": "view", "optimizer": "click", "passes": "purchase", "opt_functions": "error"}
_STARTS = {"front": "click", "back": "error"}
_STATS = f"""WITH s AS (SELECT *, greatest(coalesce(bk, 0), front + frontend) AS back FROM (SELECT tid, {", ".join(f"coalesce(max(CASE WHEN name = '{n}' THEN dur END), 0) AS {c}" for c, n in _MAP.items())}, coalesce(min(CASE WHEN name = 'click' THEN ts END), 0) AS front, min(CASE WHEN name = 'error' THEN ts END) AS bk FROM {sql_events()} GROUP BY tid)),
g AS (SELECT *, front + source + functions AS at_codegen FROM s), k AS (SELECT *, CASE WHEN at_codegen + codegen > back THEN back - at_codegen ELSE codegen END AS cg FROM g), t AS (SELECT *, at_codegen + cg AS at_debug FROM k)
"""


@query(_STATS + "SELECT tid, CAST(front AS BIGINT) AS front, CAST(back AS BIGINT) AS back, CAST(compiler AS BIGINT) AS compiler, CAST(opt_functions AS BIGINT) AS opt_functions FROM s")
def build_totals(spark, sf_dir):
    return trace.build_totals(events(spark, sf_dir), ["tid"], _MAP, _STARTS).select("tid", "front", "back", "compiler", "opt_functions")


_ROWS = [
    ("ExecuteCompiler", "0", "compiler"), ("Frontend", "front", "frontend"), ("Source", "front", "source"), ("InstantiateFunction", "front + source", "functions"), ("InstantiateClass", "front + source", "least(classes, functions)"),
    ("CodeGen Function", "at_codegen", "cg"), ("Debug", "at_debug", "CASE WHEN debug * 2 > back THEN back - at_debug ELSE debug END"), ("Backend", "back", "backend"), ("Optimizer", "back", "optimizer"), ("CodeGenPasses", "back + optimizer", "passes"), ("OptFunction", "back + optimizer", "opt_functions"),
]


@query(_STATS + " UNION ALL ".join(f"SELECT tid, '{n}' AS name, CAST({ts} AS BIGINT) AS ts, CAST({d} AS BIGINT) AS dur, round(CASE WHEN compiler = 0 THEN 0 ELSE 100 * ({d}) / CAST(compiler AS DOUBLE) END, 6) AS percent FROM t" for n, ts, d in _ROWS) + " UNION ALL SELECT tid, 'thread_name', NULL, NULL, NULL FROM t")
def totals_track(spark, sf_dir):
    rows = trace.totals_track(trace.build_totals(events(spark, sf_dir), ["tid"], _MAP, _STARTS), ["tid"])
    return rows.select("tid", "name", "ts", "dur", F.round("percent", 6).alias("percent"))


@query(f"SELECT ph, count(*) AS n FROM (SELECT 'E' AS ph FROM {sql_events()} UNION ALL SELECT unnest(['M', 'X', 'X', 'X', 'X', 'X', 'X', 'X', 'X', 'X', 'X', 'X']) FROM (SELECT DISTINCT tid FROM {sql_events()})) GROUP BY ph")
def report_with_totals(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("ph", F.lit("E"))
    totals = trace.totals_track(trace.build_totals(events(spark, sf_dir), ["tid"], _MAP, _STARTS), ["tid"])
    return trace.with_totals(e, totals).groupBy("ph").agg(F.count("*").alias("n"))


@query(f"SELECT event_id, CAST(row_number() OVER (ORDER BY ph, tid, dur DESC, name, event_id) - 1 AS BIGINT) AS place FROM (SELECT *, CASE WHEN event_id % 2 = 0 THEN 'X' ELSE 'M' END AS ph FROM {sql_events()})")
def report_sort(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("ph", F.when(F.col("event_id") % 2 == 0, "X").otherwise("M"))
    return relations.ordinals(e, [*trace.report_order(e), F.col("event_id")], "place").select("event_id", "place")


@query("SELECT o_orderkey AS id, o_orderpriority AS folder, o_totalprice AS duration FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 200")
def catalog_sort(spark, sf_dir):
    files = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("folder"), F.col("o_totalprice").alias("duration"))
    return trace.top(files, trace.catalog_order(by_duration=True), 200)


@query("SELECT o_orderkey AS id FROM orders ORDER BY o_orderkey LIMIT 200")
def file_list_sort(spark, sf_dir):
    return trace.top(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), trace.catalog_order(by_duration=False), 200)


@query(f"SELECT event_id, CAST(coalesce(sum(dur) OVER (PARTITION BY tid ORDER BY name, dur, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ts FROM {sql_events()}")
def repacked_tracks(spark, sf_dir):
    return trace.repacked(events(spark, sf_dir), "tid").select("event_id", "ts")


@query("SELECT max(event_id) AS largest FROM events")
def largest_id(spark, sf_dir):
    return trace.largest_id(table(spark, sf_dir, "events"), "event_id")


@query("SELECT p_partkey, 'var objTime = {perfetto:{keepApiOpen:true,timeStart:0n,timeEnd:' || (CAST(p_size AS BIGINT) * 1000000000) || 'n}};' AS script FROM part")
def time_ranges(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", trace.time_range(F.col("p_name"), F.col("p_size").cast("double")).alias("script"))


@query("SELECT p_partkey, lower(p_brand) LIKE '%#1' AS ends, '0x' || lower(to_hex(p_partkey)) AS hex FROM part")
def text_forms(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", strings.ends_with(F.col("p_brand"), "#1", ignore_case=True).alias("ends"), strings.hex_text(F.col("p_partkey")).alias("hex"))


@query("SELECT CAST(sum(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END) AS BIGINT) AS failed FROM customer")
def failure_sum(spark, sf_dir):
    return relations.failures(table(spark, sf_dir, "customer").select((F.col("c_acctbal") < 0).cast("int").alias("code")), "code")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 300000")
def slow_rows(spark, sf_dir):
    return relations.slower_than(table(spark, sf_dir, "orders"), "o_totalprice", 300000).select("o_orderkey")


@query("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS BIGINT) AS ordinal FROM orders")
def global_ordinals(spark, sf_dir):
    return relations.ordinals(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"]).select("o_orderkey", "ordinal")


@query("""WITH f AS (SELECT o_custkey AS g, o_orderkey AS k, o_orderstatus AS s FROM orders), n AS (SELECT *, coalesce(lead(k) OVER w, first_value(k) OVER w) AS nk, coalesce(lead(s) OVER w, first_value(s) OVER w) AS ns, coalesce(lag(k) OVER w, last_value(k) OVER f) AS pk, coalesce(lag(s) OVER w, last_value(s) OVER f) AS ps FROM f WINDOW w AS (PARTITION BY g ORDER BY k), f AS (PARTITION BY g ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT k AS o_orderkey, coalesce(CASE WHEN ns = s AND nk <> k THEN nk END, CASE WHEN ps = s AND pk <> k THEN pk END) AS counterpart FROM n""")
def counterpart_files(spark, sf_dir):
    return relations.counterparts(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], "o_orderkey", "o_orderstatus").select("o_orderkey", "counterpart")


# --- memory and textures

_USAGE = "CAST(l_partkey % 64 AS BIGINT)"
_TYPES = ["FREE", "UNKNOWN", "BUFFER", "TEXTURE2D", "IMAGE_OPTIMAL"]


@query(f"""SELECT l_orderkey, l_linenumber, CASE l_suppkey % 5 WHEN 0 THEN '  ' WHEN 1 THEN '??' WHEN 2 THEN '?B' WHEN 3 THEN CASE WHEN u & 2 <> 0 THEN 'DT' WHEN u & 5 <> 0 THEN 'RT' WHEN u & 8 = 0 THEN 'TT' ELSE '?T' END ELSE '??' END AS direct,
CASE l_suppkey % 5 WHEN 0 THEN '  ' WHEN 1 THEN '??' WHEN 4 THEN CASE WHEN u & 32 <> 0 THEN 'DT' WHEN u & 208 <> 0 THEN 'RT' WHEN u & 4 <> 0 THEN 'TT' ELSE '?T' END WHEN 2 THEN CASE WHEN u & 128 <> 0 THEN 'VB' WHEN u & 64 <> 0 THEN 'IB' WHEN u & 20 <> 0 THEN 'UB' WHEN u & 256 <> 0 THEN 'DB' WHEN u & 40 <> 0 THEN 'SB' WHEN u & 3 <> 0 THEN 'MB' ELSE '?B' END ELSE '??' END AS vulkan FROM (SELECT *, {_USAGE} AS u FROM lineitem)""")
def categories_of_both(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, _TYPES)), (F.col("l_suppkey") % 5 + 1).cast("int"))
    usage = (F.col("l_partkey") % 64).cast("bigint")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", memory.category(F.lit("Direct3D 12"), kind, usage).alias("direct"), memory.category(F.lit("Vulkan"), kind, usage).alias("vulkan"))


@query("""SELECT p_partkey, CASE p_size % 7 WHEN 0 THEN 'sdf' WHEN 1 THEN 'normal' WHEN 2 THEN 'metal_rough' WHEN 3 THEN 'ao' WHEN 4 THEN 'albedo' WHEN 5 THEN 'height' ELSE 'unknown' END AS content FROM part""")
def library_contents(spark, sf_dir):
    ends = F.element_at(F.array(*map(F.lit, ["-sdf.png", "_Normal.ktx", "_Roughness.dds", "_AO.png", ".png", "-h.ktx2", "-n"])), F.col("p_size") % 7 + 1)
    name = F.concat(F.replace("p_name", F.lit("."), F.lit("")), ends)
    return table(spark, sf_dir, "part").select("p_partkey", textures.library_content_type(name).alias("content"))


@query("SELECT p_partkey, CAST(CASE p_partkey % 4 WHEN 0 THEN 130 WHEN 1 THEN 190 WHEN 2 THEN 70 END AS INTEGER) AS metal, CAST(CASE p_partkey % 4 WHEN 0 THEN 131 WHEN 1 THEN 166 WHEN 2 THEN 37 END AS INTEGER) AS vulkan, CAST(CASE p_partkey % 4 WHEN 0 THEN 71 WHEN 2 THEN 28 END AS INTEGER) AS directx FROM part")
def format_numbers(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("format", F.expr("CASE p_partkey % 4 WHEN 0 THEN 'BC1' WHEN 1 THEN 'ASTC6x6s' WHEN 2 THEN 'EXPrgba8' ELSE 'nope' END"))
    return textures.with_format(p).select("p_partkey", "metal", "vulkan", "directx")


# --- images

_TAP7 = "(SELECT * FROM (VALUES (0,0,3.0/7),(0,1,3.0/7),(0,2,1.0/7),(1,2,2.0/7),(1,3,3.0/7),(1,4,2.0/7),(2,4,1.0/7),(2,5,3.0/7),(2,6,3.0/7)) t(o, p, w))"
_TAP5 = "(SELECT * FROM (VALUES (0,0,2.0/5),(0,1,2.0/5),(0,2,1.0/5),(1,2,1.0/5),(1,3,2.0/5),(1,4,2.0/5)) t(o, p, w))"


@query(f"SELECT image_id, CAST(ty.o AS BIGINT) AS y, CAST(tx.o AS BIGINT) AS x, CAST(floor(round(sum(r * CAST(ty.w AS DOUBLE) * CAST(tx.w AS DOUBLE)), 6) + 0.5) AS BIGINT) AS r FROM {_P} q JOIN {_TAP7} ty ON q.y = ty.p JOIN {_TAP5} tx ON q.x = tx.p GROUP BY 1, 2, 3")
def mip_box_odd(spark, sf_dir):
    return image.box_mip(pixels(spark, sf_dir).where("y < 7 and x < 5"), ["r"])


@query(f"SELECT image_id, CAST(y // 2 AS BIGINT) AS y, CAST(x // 2 AS BIGINT) AS x, CAST(10 AS BIGINT) AS r FROM {_P} WHERE y % 2 = 0 AND x % 2 = 0 AND y < 4 AND x < 4")
def mip_box_constant(spark, sf_dir):
    return image.box_mip(pixels(spark, sf_dir).where("y < 5 and x < 5").withColumn("r", F.lit(10)), ["r"])


@query(f"SELECT image_id, y, x, CAST(r AS DOUBLE) / 255 * (CAST(a AS DOUBLE) / 255) AS r FROM {_C}")
def premultiplied_floats(spark, sf_dir):
    unit = rgba(spark, sf_dir).select("image_id", "y", "x", *((F.col(c).cast("double") / 255).alias(c) for c in "rgba"))
    return image.premultiply_float(unit).select("image_id", "y", "x", "r")


@query(f"SELECT image_id, y - 4 AS y, x AS x, r FROM {_P} WHERE y >= 4 AND x < 4")
def chunk_copy(spark, sf_dir):
    return image.chunk(pixels(spark, sf_dir), 2, 4, 4, 2).select("image_id", "y", "x", "r")


@query(f"""WITH p AS {_P}, d AS (SELECT a.image_id, a.y, a.x, coalesce(min(CASE WHEN b.r > 127 THEN (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) END), 516) AS near, coalesce(min(CASE WHEN b.r <= 127 THEN (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) END), 516) AS far
FROM p a JOIN p b ON a.image_id = b.image_id WHERE a.y % 2 = 1 AND a.x % 2 = 1 GROUP BY 1, 2, 3)
SELECT image_id, CAST(y // 2 AS INTEGER) AS y, CAST(x // 2 AS INTEGER) AS x, CAST(least(greatest(round_even(128 - 127 * least(greatest((sqrt(near) - sqrt(far)) / 4, -1), 1), 0), 0), 255) AS INTEGER) AS distance FROM d""")
def distance_field_small(spark, sf_dir):
    return image.distance_field(pixels(spark, sf_dir), "r", scale=2)


@query(f"SELECT image_id, count(CASE WHEN a <> 0 AND (r <> 0 OR g <> 0 OR b <> 0) THEN 1 END) AS nonzero, count(CASE WHEN a <> 0 AND r / CAST(255 AS DOUBLE) > CAST(0.55 AS DOUBLE) THEN 1 END) AS positive_x, CAST(0 AS BIGINT) AS hdr, count(CASE WHEN a <> 0 AND pow(r / CAST(255 AS DOUBLE) * 2 - 1, 2) + pow(g / CAST(255 AS DOUBLE) * 2 - 1, 2) > CAST(0.998001 AS DOUBLE) THEN 1 END) AS xy_length FROM {_C} GROUP BY image_id")
def highlights_more(spark, sf_dir):
    unit = rgba(spark, sf_dir).select("image_id", *((F.col(c) / 255.0).alias(c) for c in "rgba"))
    return unit.groupBy("image_id").agg(*(F.count_if(image.highlight(m)).alias(m) for m in ("nonzero", "positive_x", "hdr", "xy_length")))


@query(f"SELECT image_id, y, x, r, CAST(1 AS INTEGER) AS block_x, CAST(0 AS INTEGER) AS block_y FROM {_P} WHERE x = 4 AND y = 2")
def block_probe(spark, sf_dir):
    return image.probe(pixels(spark, sf_dir), 0.5, 0.3, 8, 8, block=(4, 4))


# --- scenes

_UP = "WITH RECURSIVE p AS (SELECT p_partkey AS node, CASE WHEN p_partkey > 0 THEN (p_partkey - 1) // 3 END AS parent, CAST(p_size AS DOUBLE) AS d FROM part), up AS (SELECT node, node AS at FROM p UNION ALL SELECT up.node, p.parent FROM up JOIN p ON up.at = p.node WHERE p.parent IS NOT NULL)"


def _nodes(spark, sf_dir):
    m = vectors.translation(F.col("p_size").cast("double"), 0, 1)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.expr("case when p_partkey > 0 then (p_partkey - 1) div 3 end").alias("parent"), m.alias("m"))


@query(_UP + " SELECT up.node, sum(p.d) AS x, CAST(count(*) AS DOUBLE) AS z FROM up JOIN p ON up.at = p.node GROUP BY up.node")
def global_transforms(spark, sf_dir):
    found = relations.global_transforms(_nodes(spark, sf_dir), "node", "parent", "m")
    at = lambda i: F.element_at(F.element_at("transform", i), 4)
    return found.select("node", at(1).alias("x"), at(3).alias("z"))


@query(_UP + ", t AS (SELECT up.node, sum(p.d) AS x, count(*) AS z FROM up JOIN p ON up.at = p.node GROUP BY up.node) SELECT min(x) - 1 AS min_x, max(x) + 1 AS max_x, CAST(0 AS DOUBLE) AS min_y, CAST(2 AS DOUBLE) AS max_y, CAST(min(z) - 3 AS DOUBLE) AS min_z, CAST(max(z) + 3 AS DOUBLE) AS max_z FROM t")
def scene_bounds(spark, sf_dir):
    sides = {"min_x": -1.0, "max_x": 1.0, "min_y": 0.0, "max_y": 2.0, "min_z": -3.0, "max_z": 3.0}
    boxes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), *(F.lit(v).alias(k) for k, v in sides.items()))
    return relations.scene_bounds(boxes, relations.global_transforms(_nodes(spark, sf_dir), "node", "parent", "m"), "node")


@query("SELECT vec_id FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings) WHERE x > -CAST(0.05 AS DOUBLE) AND -y + CAST(0.02 AS DOUBLE) > -CAST(0.05 AS DOUBLE)")
def sphere_cull(spark, sf_dir):
    at = lambda i: F.element_at("embedding", i).cast("double")
    s = table(spark, sf_dir, "embeddings").select("vec_id", at(1).alias("center_x"), at(2).alias("center_y"), at(3).alias("center_z"), F.lit(0.05).alias("radius"))
    return relations.cull_spheres(s, [(1.0, 0.0, 0.0, 0.0), (0.0, -1.0, 0.0, 0.02)]).select("vec_id")


# --- math

_V = "(SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c FROM embeddings)"


def _abc(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", *(F.element_at("embedding", i + 1).cast("double").alias(n) for i, n in enumerate("abc")))


@query(f"SELECT vec_id, round(a * 0.125 + 3 * b * 0.125 + 3 * c * 0.125 + 1 * 0.125, 9) AS curve, least(a, b, c) AS low, greatest(a, b, c) AS high, CASE WHEN a > b THEN a ELSE b END AS pick, trunc(a * 10) AS whole, round(a * 10 - 3 * trunc(a * 10 / 3), 9) AS rest FROM {_V}".replace("0.125", "CAST(0.125 AS DOUBLE)"))
def scalar_catalog(spark, sf_dir):
    a, b, c = (F.col(n) for n in "abc")
    return _abc(spark, sf_dir).select(
        "vec_id", F.round(vectors.bezier(a, b, c, F.lit(1.0), F.lit(0.5)), 9).alias("curve"), vectors.min3(a, b, c).alias("low"), vectors.max3(a, b, c).alias("high"), vectors.select(b, a, a > b).alias("pick"),
        vectors.trunc(a * 10).cast("double").alias("whole"), F.round(vectors.fmod(a * 10, F.lit(3.0)), 9).alias("rest"),
    )


@query(f"SELECT vec_id, CAST(CASE WHEN a = 0 THEN 0 ELSE floor(log2(abs(a))) + 1 END AS INTEGER) AS exponent, CASE WHEN a = 0 THEN 0 ELSE a / pow(2, floor(log2(abs(a))) + 1) END AS mantissa FROM {_V}")
def mantissas(spark, sf_dir):
    parts = vectors.frexp(F.col("a"))
    return _abc(spark, sf_dir).select("vec_id", parts["exponent"].alias("exponent"), parts["mantissa"].alias("mantissa"))


@query("SELECT l_orderkey, l_linenumber, (l_partkey & ~CAST(240 AS BIGINT)) | (l_suppkey & 240) AS bits FROM lineitem")
def bit_selection(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", vectors.bitselect(F.col("l_partkey"), F.col("l_suppkey"), F.lit(240).cast("bigint")).alias("bits"))


@query(f"SELECT vec_id, CAST(4 AS DOUBLE) AS trace, round(2 + a, 9) AS x, round(CAST(1 AS DOUBLE), 9) AS w FROM {_V}")
def matrix_inverse(spark, sf_dir):
    a, b, c = (F.col(n) for n in "abc")
    m = vectors.matrix([[2.0 + a, b, 0, 1], [0, 3.0 + c, a, 0], [b, 0, 2.0, 0], [0, 0, 0, 1]])
    held = _abc(spark, sf_dir).select("vec_id", m.alias("m")).withColumn("i", vectors.inverse(F.col("m"), 4)).withColumn("both", vectors.multiply(F.col("m"), F.col("i"), 4))
    return held.select("vec_id", F.round(vectors.trace(F.col("both"), 4), 9).alias("trace"), F.round(F.element_at(F.element_at("m", 1), 1), 9).alias("x"), F.round(F.element_at(F.element_at("both", 4), 4), 9).alias("w"))


@query(f"SELECT vec_id, 2 * a AS total, CAST(0 AS DOUBLE) AS nothing FROM {_V}")
def matrix_sums(spark, sf_dir):
    m = vectors.scaling(F.col("a"), F.col("b"), F.col("c"))
    at = lambda x: F.element_at(F.element_at(x, 1), 1)
    return _abc(spark, sf_dir).select("vec_id", at(vectors.add(m, m)).alias("total"), at(vectors.subtract(m, m)).alias("nothing"))


@query(f"SELECT vec_id, round(1 / tan(CAST(0.5 AS DOUBLE) + abs(a) / 2) / 2, 9) AS x, round(CAST(100 AS DOUBLE) / (1 - 100), 9) AS z, round(CAST(2 AS DOUBLE) / (1 + abs(b)), 9) AS flat FROM {_V}")
def projections(spark, sf_dir):
    a, b = F.abs("a"), F.abs("b")
    p, o = vectors.perspective(a + 1.0, F.lit(2.0), F.lit(1.0), F.lit(100.0)), vectors.orthographic(b + 1.0, F.lit(1.0), F.lit(0.0), F.lit(1.0))
    at = lambda m, i, j: F.round(F.element_at(F.element_at(m, i), j), 9)
    return _abc(spark, sf_dir).select("vec_id", at(p, 1, 1).alias("x"), at(p, 3, 3).alias("z"), at(o, 1, 1).alias("flat"))


@query(f"SELECT vec_id, a AS x, round(abs(b) + 1, 9) AS width FROM {_V}")
def decomposed(spark, sf_dir):
    held = _abc(spark, sf_dir).select("vec_id", vectors.translation(F.col("a"), F.col("b"), F.col("c")).alias("t"), vectors.rotation_z(F.col("c")).alias("r"), vectors.scaling(F.abs("b") + 1.0, 1, 1).alias("s"))
    held = held.withColumn("tr", vectors.multiply(F.col("t"), F.col("r"), 4)).withColumn("m", vectors.multiply(F.col("tr"), F.col("s"), 4))
    parts = held.select("vec_id", vectors.decompose(F.col("m")).alias("p"))
    return parts.select("vec_id", F.element_at("p.translation", 1).alias("x"), F.round(F.element_at("p.scale", 1), 9).alias("width"))


@query(f"SELECT vec_id, round(sqrt(a * a + b * b + c * c), 9) AS size, round(-a, 9) AS back FROM {_V}")
def turns(spark, sf_dir):
    """A quaternion and its inverse leave a vector as it is; refraction with equal media too."""
    q = vectors.normalize(F.array(F.col("b"), F.col("c"), F.col("a"), F.lit(1.0)))
    v = F.array(F.col("a"), F.col("b"), F.col("c"))
    held = _abc(spark, sf_dir).select("vec_id", q.alias("q"), v.alias("v")).withColumn("i", vectors.quaternion_inverse(F.col("q"))).withColumn("turned", vectors.quaternion_rotate(F.col("q"), F.col("v")))
    held = held.withColumn("back", vectors.quaternion_rotate(F.col("i"), F.col("turned")))
    straight = vectors.refract(F.array(F.lit(0.0), F.lit(0.0), F.lit(-1.0)), F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0)), F.lit(1.0))
    return held.select("vec_id", F.round(vectors.length(F.col("back")), 9).alias("size"), F.round(F.element_at(F.col("v"), 1) * F.element_at(straight, 3), 9).alias("back"))

"""Small functions and operators on the driver's tables, each with values that differ from row to row."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from ..functions import colors, strings, vectors
from ..operators import image, memory, relations, textures, trace
from ..scratch import fresh_path
from ..streaming import traces
from .catalog import query, table
from .image_queries import _C, rgba
from .more_queries import _MAP, _ROWS, _STARTS, _STATS
from .trace_queries import events, sql_events


def _number(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


# --- orders


@query("SELECT o_orderkey AS id, CAST(row_number() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) - 1 AS BIGINT) AS place FROM orders")
def catalog_places(spark, sf_dir):
    files = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("folder"), F.col("o_totalprice").alias("duration"))
    return relations.ordinals(files, trace.catalog_order(by_duration=True), "place").select("id", "place")


@query("SELECT o_orderkey AS id, CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS place FROM orders")
def file_list_places(spark, sf_dir):
    files = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return relations.ordinals(files, trace.catalog_order(by_duration=False), "place")


@query("SELECT DISTINCT l_returnflag AS pool_type, l_linestatus AS pool_name, CAST(l_suppkey AS VARCHAR) AS block_id, CAST(dense_rank() OVER (ORDER BY l_returnflag, l_linestatus, CAST(l_suppkey AS VARCHAR)) AS INTEGER) AS tid FROM lineitem")
def pool_order(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("pool_type"), F.col("l_linestatus").alias("pool_name"), F.lit("block").alias("kind"), F.col("l_suppkey").cast("string").alias("block_id"))
    return memory.block_tracks(rows).drop("kind")


@query(_STATS + ", r AS (" + " UNION ALL ".join(f"SELECT tid, 'X' AS ph, '{n}' AS name, CAST({ts} AS BIGINT) AS ts, CAST({d} AS BIGINT) AS dur FROM t" for n, ts, d in _ROWS) + f" UNION ALL SELECT tid, 'M', 'thread_name', NULL, NULL FROM t UNION ALL SELECT tid, 'E', name, ts, dur FROM {sql_events()}) SELECT * FROM r")
def report_rows(spark, sf_dir):
    """A report's events with the totals track behind them, row by row."""
    e = events(spark, sf_dir).withColumn("ph", F.lit("E"))
    totals = trace.totals_track(trace.build_totals(e, ["tid"], _MAP, _STARTS), ["tid"])
    return trace.with_totals(e, totals).select("tid", "ph", "name", "ts", "dur")


# --- texts


@query("SELECT o_orderkey, format('{:,}', CAST(o_orderkey * 12345 AS BIGINT)) AS text FROM orders")
def number_texts(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", strings.count_text((F.col("o_orderkey") * 12345).cast("bigint")).alias("text"))


@query("""SELECT p_partkey, printf('%.1f%%', 100.0 * p_size / 7) AS share, CASE WHEN p_size % 5 = 0 THEN '' ELSE printf('%.3f', (p_size % 5) / CAST(8 AS DOUBLE)) || CASE WHEN p_size % 2 = 0 THEN 'm' ELSE 's' END END AS duration FROM part""")
def duration_texts(spark, sf_dir):
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", strings.percent_text(size, F.lit(7.0)).alias("share"), strings.duration_text((size % 5) / 8.0, size % 2 == 0).alias("duration"))


@query("""SELECT p_partkey, 'a/' || p_type || '/' || p_brand AS folder, p_name || '.o' AS object, 'vector<' || p_name || '>' AS plain FROM part""")
def path_forms(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    path = F.concat(F.lit("root/x/a/"), "p_type", F.lit("/"), "p_brand", F.lit("/file.cpp"))
    folder = F.concat(F.lit("a/"), strings.short_directory(path))
    name = F.concat(F.lit("std::vector<eastl::"), "p_name", F.lit(">"))
    return p.select("p_partkey", folder.alias("folder"), strings.object_name(F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, ".json").otherwise(".JSON"))).alias("object"), strings.strip_namespaces(name).alias("plain"))


@query("""SELECT p_partkey, s AS text, length(s) = 4 AND length(translate(s, 'rgba01x', '')) = 0 AS swizzle, s IN ('rgba', 'xgbx', 'xxxx') AS channels
FROM (SELECT p_partkey, ['rgba', 'xgbx', 'rrr1', 'gggr', 'rgb', 'rgbaa', 'q000', 'xxxx', 'RGBA', ''][p_partkey % 10 + 1] AS s FROM part)""")
def swizzle_checks(spark, sf_dir):
    texts = F.array(*map(F.lit, ["rgba", "xgbx", "rrr1", "gggr", "rgb", "rgbaa", "q000", "xxxx", "RGBA", ""]))
    text = F.element_at(texts, (F.col("p_partkey") % 10 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", text.alias("text"), image.valid_swizzle(text).alias("swizzle"), image.valid_channels(text).alias("channels"))


# --- colors


@query(f"""SELECT image_id, y, x, round(r * {_number('0.2126')} + g * {_number('0.7152')} + b * {_number('0.0722')}, 6) AS luma,
round(CASE WHEN v <= {_number('0.0031308')} THEN v * {_number('12.92')} ELSE pow(v, 1 / {_number('2.4')}) * {_number('1.055')} - {_number('0.055')} END, 6) AS srgb,
CAST(round_even(least(greatest(s * 2, 0), 1) * 255, 0) AS INTEGER) AS unorm, CAST(round_even(least(greatest(s * 2, -1), 1) * 127, 0) + 128 AS INTEGER) AS snorm,
round(sqrt(1 - least(s * s + v * v, {_number('0.998001')})), 6) AS z
FROM (SELECT image_id, y, x, CAST(r AS DOUBLE) AS r, CAST(g AS DOUBLE) AS g, CAST(b AS DOUBLE) AS b, r / {_number('255')} AS v, r / {_number('256')} - {_number('0.4')} AS s FROM {_C})""")
def color_functions(spark, sf_dir):
    r, g, b = (F.col(c).cast("double") for c in "rgb")
    v, s = r / 255.0, r / 256.0 - 0.4
    return rgba(spark, sf_dir).select(
        "image_id", "y", "x", F.round(colors.rec709(r, g, b), 6).alias("luma"), F.round(colors.linear_to_srgb(v), 6).alias("srgb"), colors.to_unorm8(s * 2).alias("unorm"), colors.to_snorm8(s * 2).alias("snorm"),
        F.round(colors.reconstruct_z(s, v), 6).alias("z"),
    )


@query("SELECT l_orderkey, l_linenumber, (l_partkey & 255) - 128 AS signed, l_partkey & 255 AS unsigned FROM lineitem")
def endpoint_remaps(spark, sf_dir):
    signed = colors.remap_to_signed(F.col("l_partkey").bitwiseAND(255))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", signed.alias("signed"), colors.remap_from_signed(signed).alias("unsigned"))


@query(f"""WITH t AS (SELECT image_id, bool_or(a <> 255) AS has_alpha FROM {_C} GROUP BY image_id), f AS (SELECT image_id, has_alpha, ['BC7', 'BC7s', 'BC3', 'BC3s', 'ETCrgba', 'ETCsrgba', 'BC4', 'ASTC4x4'][image_id % 8 + 1] AS format FROM t)
SELECT image_id, format, CASE WHEN has_alpha THEN format ELSE CASE format WHEN 'BC7' THEN 'BC1' WHEN 'BC7s' THEN 'BC1s' WHEN 'BC3' THEN 'BC1' WHEN 'BC3s' THEN 'BC1s' WHEN 'ETCrgba' THEN 'ETCrgb' WHEN 'ETCsrgba' THEN 'ETCsrgb' ELSE format END END AS chosen FROM f""")
def opaque_formats(spark, sf_dir):
    names = F.array(*map(F.lit, ["BC7", "BC7s", "BC3", "BC3s", "ETCrgba", "ETCsrgba", "BC4", "ASTC4x4"]))
    t = image.traits(rgba(spark, sf_dir)).withColumn("format", F.element_at(names, (F.col("image_id") % 8 + 1).cast("int")))
    return t.select("image_id", "format", textures.opaque_format(F.col("format"), F.col("has_alpha")).alias("chosen"))


@query("""SELECT p_partkey, CASE p_partkey % 200 WHEN 131 THEN 'BC1' WHEN 145 THEN 'BC7' WHEN 146 THEN 'BC7s' WHEN 151 THEN 'ETCrgba' WHEN 37 THEN 'EXPrgba8' WHEN 9 THEN 'EXPr8' WHEN 166 THEN 'ASTC6x6s' ELSE 'other' END AS vulkan,
CASE p_partkey % 200 WHEN 71 THEN 'BC1' WHEN 98 THEN 'BC7' WHEN 28 THEN 'EXPrgba8' ELSE 'other' END AS directx FROM part""")
def formats_of_numbers(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 200).cast("int").alias("number"))
    known = lambda c, names: F.when(F.col(c).isin(names), F.col(c)).otherwise("other").alias(c)
    found = textures.format_of_number(p, "number", "vulkan").withColumnRenamed("format", "vulkan")
    found = textures.format_of_number(found, "number", "directx").withColumnRenamed("format", "directx")
    return found.select("p_partkey", known("vulkan", ["BC1", "BC7", "BC7s", "ETCrgba", "EXPrgba8", "EXPr8", "ASTC6x6s"]), known("directx", ["BC1", "BC7", "EXPrgba8"]))


# --- levels and containers

_LEVELS = "(SELECT p_partkey AS image_id, CAST(k AS INTEGER) AS mip, greatest(1, (p_size * 13) >> k) AS w, greatest(1, (p_size * 5) >> k) AS h FROM part, (SELECT unnest(range(0, 16)) AS k) WHERE (greatest(p_size * 13, p_size * 5) >> k) > 0)"


@query(f"SELECT * FROM (SELECT image_id, w AS mip_width, h AS mip_height, CAST(row_number() OVER (PARTITION BY image_id ORDER BY mip) - 3 AS INTEGER) AS level FROM {_LEVELS} WHERE least(w, h) >= 4 AND greatest(w, h) <= 300) WHERE level >= 0")
def kept_levels(spark, sf_dir):
    s = table(spark, sf_dir, "part").selectExpr("p_partkey as image_id", "p_size * 13 as width", "p_size * 5 as height")
    return image.kept_levels(image.mip_plan(s), 4, 300, skip=2).select("image_id", "mip_width", "mip_height", "level")


@query("SELECT p_partkey, [CAST(0 AS BIGINT), CAST((p_size + 3) // 4 * 4 AS BIGINT), CAST((p_size + 3) // 4 * 4 + (p_size * 3 + 4) // 4 * 4 AS BIGINT)] AS offsets FROM part")
def aligned_offsets(spark, sf_dir):
    size = F.col("p_size").cast("bigint")
    return table(spark, sf_dir, "part").select("p_partkey", image.aligned_offsets(F.array(size, size * 3 + 1, F.lit(5).cast("bigint"))).alias("offsets"))


@query("SELECT p_partkey, p_size % 3 <> 1 AS valid FROM part")
def checked_levels(spark, sf_dir):
    """Every third texture has a level that is one block short."""
    size = lambda n, k: F.greatest(F.lit(1), F.shiftright(n, k))
    length = lambda k: F.ceil(size(F.col("width"), k) / 4.0) * F.ceil(size(F.col("height"), k) / 4.0) * 16
    short = F.when(F.col("p_size") % 3 == 1, 16).otherwise(0)
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", (F.col("p_size") * 4).alias("width"), (F.col("p_size") * 3).alias("height"), F.lit("BC7").alias("format"))
    level = lambda k: F.struct(F.lit(k).alias("mip"), (length(k) - (short if k == 1 else F.lit(0))).cast("bigint").alias("length"))
    return textures.valid_levels(textures.with_format(rows.withColumn("levels", F.array(*(level(k) for k in range(3)))))).select("p_partkey", "valid")


@query("""SELECT p_partkey, 'swizzle=' || s || CASE s WHEN 'gggr' THEN ';post_swizzle=ag01' WHEN 'rrrg' THEN ';post_swizzle=ga01' WHEN 'rrr1' THEN ';post_swizzle=r001' ELSE '' END
|| CASE WHEN p_size % 3 = 0 THEN ';channels=Nrm.x,Nrm.y,X,X' WHEN p_size % 5 = 0 THEN ';channels=Alb.ra,Alb.ga,Alb.ba,Alb.a' WHEN p_size % 2 = 0 THEN ';channels=Alb.r,Alb.g,Alb.b,Alb.a' ELSE '' END
|| ';address=' || CASE p_size % 7 WHEN 0 THEN 'Rep,X,X' WHEN 1 THEN 'Rep,Rep,Rep' ELSE 'Rep,Rep,X' END || ';filter=Lin,Lin,' || CASE WHEN p_size % 11 = 0 THEN 'X' ELSE 'Lin' END AS props
FROM (SELECT p_partkey, p_size, ['gggr', 'rrrg', 'rrr1', 'rgba'][p_size % 4 + 1] AS s FROM part)""")
def container_props(spark, sf_dir):
    size = F.col("p_size")
    swizzle = F.element_at(F.array(*map(F.lit, ["gggr", "rrrg", "rrr1", "rgba"])), (size % 4 + 1).cast("int"))
    kind = F.when(size % 7 == 0, "1darray").when(size % 7 == 1, "3d").otherwise("2d")
    props = textures.base_props(swizzle, size % 3 == 0, size % 2 == 0, size % 5 == 0, kind, size % 11 != 0)
    text = F.array_join(F.transform(F.map_entries(props), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return table(spark, sf_dir, "part").select("p_partkey", text.alias("props"))


@query("SELECT s_suppkey AS pool_type FROM supplier WHERE s_suppkey % 3 <> 0 OR s_suppkey % 2 = 0")
def pruned_pools(spark, sf_dir):
    """Two thirds of the pools have a block, every other one a dedicated allocation."""
    s = F.col("s_suppkey")
    allocation = F.from_json(F.lit('{"Type":"BUFFER","Size":1}'), memory.ALLOCATION)
    blocks = F.from_json(F.when(s % 3 != 0, F.lit('{"1":{"TotalBytes":1}}')).otherwise(F.lit("{}")), f"map<string,{memory.BLOCK}>")
    pool = F.struct(blocks.alias("Blocks"), F.when(s % 2 == 0, F.array(allocation)).otherwise(F.array().cast(f"array<{memory.ALLOCATION}>")).alias("DedicatedAllocations"))
    return memory.prune_empty(table(spark, sf_dir, "supplier").select(s.alias("pool_type"), pool.alias("pool"))).select("pool_type")


# --- scalars and vectors

_E = "(SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c FROM embeddings)"


def _parts(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", *(F.element_at("embedding", k + 1).cast("double").alias(n) for k, n in enumerate("abc")))


@query(f"""SELECT vec_id, round(t * t * (3 - t * 2), 9) AS smooth, abs(a - b) <= {_number('0.1')} AS near, abs(a - b) <= {_number('0.5')} * greatest(abs(a), abs(b)) AS alike, CASE WHEN vec_id % 2 = 0 THEN c ELSE a END AS fixed
FROM (SELECT *, least(greatest((a + {_number('0.1')}) / {_number('0.3')}, 0), 1) AS t FROM {_E})""")
def scalar_checks(spark, sf_dir):
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    nan = F.when(F.col("vec_id") % 2 == 0, F.lit(float("nan"))).otherwise(a)
    smooth = vectors.smoothstep(F.lit(-0.1), F.lit(0.2), a)
    return _parts(spark, sf_dir).select("vec_id", F.round(smooth, 9).alias("smooth"), vectors.equal_abs(a, b, 0.1).alias("near"), vectors.equal_rel(a, b, 0.5).alias("alike"), vectors.fix_nan(nan, c).alias("fixed"))


@query(f"SELECT vec_id, round(a - 2 * d * x, 9) AS x, round(b - 2 * d * y, 9) AS y FROM (SELECT *, a * x + b * y AS d FROM (SELECT *, {_number('0.6')} AS x, {_number('0.8')} AS y FROM {_E}))")
def reflections(spark, sf_dir):
    found = vectors.reflect(F.array("a", "b"), F.array(F.lit(0.6), F.lit(0.8)))
    return _parts(spark, sf_dir).select("vec_id", *(F.round(F.element_at(found, k + 1), 9).alias(n) for k, n in enumerate("xy")))


@query(f"SELECT vec_id, round(sin(t / 2), 6) AS z, round(cos(t / 2), 6) AS w, round(a * cos(t) - b * sin(t), 6) AS x, round(a * sin(t) + b * cos(t), 6) AS y FROM (SELECT *, (vec_id % 8) / {_number('7')} * {_number('1.2')} + {_number('0.4')} AS t FROM {_E})")
def turned_between(spark, sf_dir):
    """Between turns about z by 0.4 and 1.6: the part of the way turns by the same part of the angle; vectors are turned by it."""
    turn = lambda angle: F.array(F.lit(0.0), F.lit(0.0), F.sin(F.lit(angle / 2)), F.cos(F.lit(angle / 2)))
    q = vectors.slerp(turn(0.4), turn(1.6), (F.col("vec_id") % 8) / 7.0)
    rows = _parts(spark, sf_dir).withColumn("q", q)
    v = vectors.quaternion_rotate(F.col("q"), F.array("a", "b", "c"))
    return rows.select("vec_id", *(F.round(F.element_at("q", k), 6).alias(n) for k, n in ((3, "z"), (4, "w"))), *(F.round(F.element_at(v, k), 6).alias(n) for k, n in ((1, "x"), (2, "y"))))


@query("""SELECT o_orderkey, CAST(CASE WHEN n = 0 THEN -1 ELSE bit_count(xor(n, n - 1)) - 1 END AS INTEGER) AS low, CAST(CASE WHEN n = 0 THEN -1 ELSE length(bin(n)) - 1 END AS INTEGER) AS high,
list_reduce(list_prepend(CAST(0 AS BIGINT), range(32)), lambda x, k: x | (((n >> k) & 1) << (31 - k))) AS reversed FROM (SELECT o_orderkey, CAST(o_orderkey % 5000 * 37 AS BIGINT) AS n FROM orders)""")
def bit_functions(spark, sf_dir):
    n = (F.col("o_orderkey") % 5000 * 37).cast("bigint")
    return table(spark, sf_dir, "orders").select("o_orderkey", vectors.first_bit_low(n).cast("int").alias("low"), vectors.first_bit_high(n).cast("int").alias("high"), vectors.reverse_bits(n).alias("reversed"))


# --- streams that go on


@query(f"SELECT event_id, ts, dur FROM {sql_events()} WHERE event_id % 3 = 0")
def stream_flush(spark, sf_dir):
    """Files come while the stream runs; all that has come is written when it is stopped."""
    rows = events(spark, sf_dir).where("event_id % 3 = 0").select(F.col("event_id").alias("value"), "tid", "name", F.lit("X").alias("ph"), "ts", "dur", F.lit(0).alias("depth"))
    source, path = fresh_path(spark, "arriving"), fresh_path(spark, "flushed")
    rows.where("value % 2 = 0").write.mode("append").json(source)
    running = traces.flush(traces.arrivals(spark, source), path, fresh_path(spark, "log"), every="200 milliseconds")
    try:
        rows.where("value % 2 = 1").write.mode("append").json(source)
        time.sleep(0.5)
        running.processAllAvailable()
    finally:
        running.stop()
    return spark.read.schema(traces.EVENT).json(path).select(F.col("value").alias("event_id"), "ts", "dur")


@query(f"SELECT name, count(*) AS count, CAST(sum(dur) AS BIGINT) AS duration FROM {sql_events()} GROUP BY name")
def stream_reload(spark, sf_dir):
    """A report over files that have come, and again, from its checkpoint, when more have."""
    rows = events(spark, sf_dir).select("tid", "name", F.lit("X").alias("ph"), "ts", "dur", F.lit(0).alias("depth"))
    source, path, log = (fresh_path(spark, n) for n in ("loaded", "report", "log"))
    for part in (0, 1):
        rows.where(F.col("tid") % 2 == part).write.mode("append").json(source)
        traces.keep_totals(traces.arrivals(spark, source), path, log).awaitTermination()
    return spark.read.parquet(path)

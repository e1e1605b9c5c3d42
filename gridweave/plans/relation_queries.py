"""Joins, windows, sets, memory and texture operators on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import memory, relations, textures
from .catalog import query, table


@query("""WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderdate < '1998-01-01' GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderdate >= '1998-01-01' GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'missing' WHEN a.k IS NULL THEN 'added' WHEN a.n = b.n THEN 'same' ELSE 'changed' END AS state FROM a FULL JOIN b ON a.k = b.k""")
def snapshot_changes(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderdate")
    early = F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    count = lambda c: o.where(c).groupBy("k").agg(F.count("*").alias("n"))
    return relations.changes(count(early), count(~early), "k", "n")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 20)")
def stale_sources(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_acctbal") * 20).alias("t"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("t"))
    return relations.stale(c, o, "k", "t").select(F.col("k").alias("c_custkey"))


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 25 AND l_discount < 0.05)")
def never_shipped(spark, sf_dir):
    return relations.not_members(table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem").where("l_quantity > 25 and l_discount < 0.05"), "p_partkey", "l_partkey").select("p_partkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def membership(spark, sf_dir):
    return relations.members(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), "c_custkey", "o_custkey").select("c_custkey")


@query("""WITH r AS (SELECT * FROM (VALUES ('red', 0, 0.0, 0.0, 0.25, 0.25), ('green', 1, 0.5, 0.25, 0.25, 0.25), ('blue', 2, 0.0, 0.0, 1.0, 0.5)) t(name, ordinal, x, y, w, h)),
p AS (SELECT p_partkey AS point_id, p_size / CAST(50 AS DOUBLE) AS u, (p_partkey % 101) / CAST(100 AS DOUBLE) AS v FROM part)
SELECT point_id, min_by(name, ordinal) AS name FROM p JOIN r ON u >= x AND u <= x + w AND v >= y AND v <= y + h GROUP BY point_id""")
def point_in_rectangle(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("point_id"), (F.col("p_size") / 50.0).alias("u"), ((F.col("p_partkey") % 101) / 100.0).alias("v"))
    r = spark.createDataFrame([("red", 0, 0.0, 0.0, 0.25, 0.25), ("green", 1, 0.5, 0.25, 0.25, 0.25), ("blue", 2, 0.0, 0.0, 1.0, 0.5)], "name string, ordinal int, x double, y double, w double, h double")
    return relations.point_in_rectangle(p, r)


@query("""WITH c AS (SELECT n_nationkey, unnest([n_name || 'X', r_name, n_name]) AS name, unnest([0, 1, 2]) AS rank FROM nation JOIN region ON n_regionkey = r_regionkey), k AS (SELECT n_name AS name FROM nation WHERE n_nationkey % 2 = 0 UNION SELECT r_name FROM region WHERE r_regionkey < 2)
SELECT n_nationkey, min_by(c.name, rank) AS found FROM c JOIN k ON c.name = k.name GROUP BY n_nationkey""")
def ranked_candidates(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    names = n.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("name")).union(r.where("r_regionkey < 2").select("r_name"))
    rows = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))  # 5 regions
    return relations.ranked_candidates(rows, names, F.array(F.concat("n_name", F.lit("X")), "r_name", "n_name"), "n_nationkey", "name")


_KEYS = "(SELECT user_id AS channel, epoch_us(ts) // 1000000 AS ts, min(value) AS value FROM events GROUP BY 1, 2)"


@query(f"""WITH k AS (SELECT *, lead(ts) OVER w AS n, lead(value) OVER w AS nv, row_number() OVER w = 1 AS f FROM {_KEYS} WINDOW w AS (PARTITION BY channel ORDER BY ts)),
q AS (SELECT DISTINCT user_id AS channel, 1704067200 + g * 43200 AS t FROM events, range(60) r(g))
SELECT q.channel, t, value + (coalesce(nv, value) - value) * coalesce((t - ts) / CAST(n - ts AS DOUBLE), 0) AS value FROM q JOIN k ON q.channel = k.channel AND ((t > ts AND t <= n) OR (f AND t = ts))""")
def keyframes(spark, sf_dir):
    from .trace_queries import events

    e = events(spark, sf_dir).select(F.col("tid").alias("channel"), F.expr("ts div 1000000").alias("ts"), "event_id")
    raw = table(spark, sf_dir, "events").select("event_id", "value")
    keys = e.join(raw, "event_id").groupBy("channel", "ts").agg(F.min("value").alias("value"))
    grid = table(spark, sf_dir, "events").select(F.col("user_id").alias("channel")).distinct().select("channel", F.explode(F.expr("transform(sequence(0, 59), g -> 1704067200L + g * 43200L)")).alias("t"))
    return relations.between_keys(grid, keys, "channel", 43200.0)


@query("SELECT l_orderkey, l_linenumber, coalesce(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS addr FROM lineitem")
def running_addresses(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("pos", F.struct("l_linenumber", "l_partkey", "l_suppkey"))
    return memory.addresses(rows, ["l_orderkey"], "pos", "l_quantity").select("l_orderkey", "l_linenumber", "addr")


@query("SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) - 1 AS INTEGER) AS ordinal FROM lineitem")
def block_ordinals(spark, sf_dir):
    return relations.row_ordinals(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "ordinal")


@query("SELECT l_orderkey, l_linenumber, l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey) AS share FROM lineitem")
def share_of_total(spark, sf_dir):
    return relations.shares(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_quantity").select("l_orderkey", "l_linenumber", "share")


@query("SELECT o_orderkey, coalesce(lag(o_orderkey) OVER w, o_orderkey) AS previous, coalesce(lead(o_orderkey) OVER w, o_orderkey) AS next FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def steps_clamped(spark, sf_dir):
    return relations.steps(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"], "o_orderkey", circular=False).select("o_orderkey", "previous", "next")


@query("SELECT o_orderkey, coalesce(lag(o_orderkey) OVER w, max(o_orderkey) OVER (PARTITION BY o_custkey)) AS previous, coalesce(lead(o_orderkey) OVER w, min(o_orderkey) OVER (PARTITION BY o_custkey)) AS next FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def steps_circular(spark, sf_dir):
    return relations.steps(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"], "o_orderkey", circular=True).select("o_orderkey", "previous", "next")


@query("SELECT o_orderkey, coalesce(lead(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <> o_orderstatus, false) AS separator FROM orders")
def group_separators(spark, sf_dir):
    return relations.changes_to_next(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"], "o_orderstatus", "separator").select("o_orderkey", "separator")


@query("""WITH RECURSIVE p AS (SELECT p_partkey AS node, CASE WHEN p_partkey > 0 THEN (p_partkey - 1) // 3 END AS parent FROM part),
up AS (SELECT node, parent AS ancestor, 1 AS steps FROM p WHERE parent IS NOT NULL UNION ALL SELECT up.node, p.parent, up.steps + 1 FROM up JOIN p ON up.ancestor = p.node WHERE p.parent IS NOT NULL)
SELECT node, ancestor, CAST(steps AS INTEGER) AS steps FROM up""")
def tree_ancestors(spark, sf_dir):
    p = table(spark, sf_dir, "part").selectExpr("p_partkey as node", "case when p_partkey > 0 then (p_partkey - 1) div 3 end as parent")
    return relations.ancestors(p, "node", "parent")


@query("""WITH e AS (SELECT p_partkey AS node, unnest([p_partkey * 2, p_partkey * 2 + 1]) AS child FROM part) SELECT node, child FROM e WHERE child IN (SELECT p_partkey FROM part)""")
def graph_relink(spark, sf_dir):
    p = table(spark, sf_dir, "part").selectExpr("p_partkey as node", "array(p_partkey * 2, p_partkey * 2 + 1) as children")
    return relations.relink(p, p, "children", "node")


_BOX = "(SELECT label, min(embedding[1]) AS min_x, max(embedding[1]) AS max_x, min(embedding[2]) AS min_y, max(embedding[2]) AS max_y, min(embedding[3]) AS min_z, max(embedding[3]) AS max_z FROM (SELECT label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS embedding FROM embeddings) GROUP BY label)"


@query(f"SELECT *, (max_x + min_x) / 2 AS center_x, (max_y + min_y) / 2 AS center_y, (max_z + min_z) / 2 AS center_z, sqrt(((max_x - min_x) / 2) * ((max_x - min_x) / 2) + ((max_y - min_y) / 2) * ((max_y - min_y) / 2) + ((max_z - min_z) / 2) * ((max_z - min_z) / 2)) AS radius FROM {_BOX}")
def bounding_boxes(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("label", *(F.element_at("embedding", i + 1).cast("double").alias(a) for i, a in enumerate("xyz")))
    return relations.bounds(e, ["label"])


@query("""WITH b AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)
SELECT vec_id FROM b WHERE 0.0 + (x + 0.1) * 1.0 + (y - 0.1) * 0.0 + (z - 0.1) * 0.0 > 0 AND 0.05 + (x - 0.1) * 0.0 + (y - 0.1) * -1.0 + (z - 0.1) * 0.0 > 0""".replace("0.1)", "CAST(0.1 AS DOUBLE))").replace("0.05", "CAST(0.05 AS DOUBLE)"))
def frustum_cull(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    at = lambda i: F.element_at("embedding", i).cast("double")
    boxes = e.select("vec_id", *((at(i + 1) + s * 0.1).alias(f"{n}_{a}") for i, a in enumerate("xyz") for n, s in (("min", -1), ("max", 1))))
    return relations.cull(boxes, [(1.0, 0.0, 0.0, 0.0), (0.0, -1.0, 0.0, 0.05)]).select("vec_id")


@query("SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000")
def append_rows(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"), "o_orderstatus")
    return relations.append([o.where("o_orderstatus = 'F'").select("k", "v"), o.where("v > 200000").select("v", "k")])


@query("SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F' UNION SELECT o_orderkey FROM orders WHERE o_totalprice > 200000")
def distinct_union(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_orderstatus", "o_totalprice")
    return relations.distinct_by([o.where("o_orderstatus = 'F'").select("k"), o.where("o_totalprice > 200000").select("k")], ["k"])


@query("SELECT c_nationkey, sum(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END) AS errors, sum(CASE WHEN c_acctbal = 0 THEN 1 ELSE 0 END) AS skipped, count(*) AS commands FROM customer GROUP BY 1".replace("sum(CASE", "CAST(sum(CASE").replace("END)", "END) AS BIGINT)"))
def command_counters(spark, sf_dir):
    c = F.col("c_acctbal")
    return relations.counters(table(spark, sf_dir, "customer"), ["c_nationkey"], {"errors": c < 0, "skipped": c == 0, "commands": F.lit(True)})


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey & 128 <> 0 THEN 'VB' WHEN l_partkey & 64 <> 0 THEN 'IB' WHEN l_partkey & 20 <> 0 THEN 'UB' WHEN l_partkey & 256 <> 0 THEN 'DB' WHEN l_partkey & 40 <> 0 THEN 'SB' WHEN l_partkey & 3 <> 0 THEN 'MB' ELSE '?B' END AS category FROM lineitem""")
def allocation_category(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", memory.category(F.lit("Vulkan"), F.lit("BUFFER"), F.col("l_partkey")).alias("category"))


@query("SELECT max(l_quantity) AS largest, count(*) AS n, 1000.0 / max(l_quantity) AS scale FROM lineitem")
def chart_parameters(spark, sf_dir):
    return relations.extent(table(spark, sf_dir, "lineitem"), "l_quantity", 1000)


@query("""WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, coalesce(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS addr FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(floor(addr * 2.5) AS INTEGER) AS x0, CAST(floor((addr + l_quantity) * 2.5) AS INTEGER) AS x1 FROM a""")
def bar_positions(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("pos", F.struct("l_linenumber", "l_partkey", "l_suppkey"))
    a = memory.addresses(rows, ["l_orderkey"], "pos", "l_quantity")
    return relations.bar_positions(a, "addr", "l_quantity", 2.5).select("l_orderkey", "l_linenumber", "x0", "x1")


_FORMAT = "CASE p_partkey % 4 WHEN 0 THEN 'BC1' WHEN 1 THEN 'ASTC6x6s' WHEN 2 THEN 'EXPrgba8' ELSE 'nope' END"


@query(f"""WITH f AS (SELECT * FROM (VALUES ('BC1', 4, 4, 8, 3, false), ('ASTC6x6s', 6, 6, 16, 4, true), ('EXPrgba8', 1, 1, 4, 4, false), ('Invalid', 1, 1, 0, 0, false)) t(format, bx, by_, bs, channels, is_srgb))
SELECT p_partkey, f.format, channels, is_srgb, CAST(ceil(p_size * 4 / CAST(bx AS DOUBLE)) * ceil(p_size / CAST(by_ AS DOUBLE)) * bs AS BIGINT) AS bytes FROM (SELECT *, {_FORMAT} AS want FROM part) p JOIN f ON f.format = CASE WHEN want = 'nope' THEN 'Invalid' ELSE want END""")
def format_lookup(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("format", F.expr(_FORMAT))
    return textures.with_format(p).select("p_partkey", "format", "channels", "is_srgb", textures.level_bytes(F.col("p_size") * 4, F.col("p_size")).alias("bytes"))


@query(f"SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'squish' WHEN 1 THEN 'astcenc' WHEN 2 THEN 'explicit' END AS encoder, CASE p_partkey % 4 WHEN 0 THEN 'BC1s' WHEN 1 THEN 'ASTC6x6' WHEN 2 THEN 'EXPsrgba8' ELSE 'nope' END AS toggled FROM part")
def encoder_pick(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("format", F.expr(_FORMAT))
    return textures.encoder_for(p).select("p_partkey", "encoder", textures.toggle_srgb(F.col("format")).alias("toggled"))


@query("""WITH n AS (SELECT p_partkey, replace(p_name, ' ', CASE WHEN p_size % 3 = 0 THEN '-cube' WHEN p_size % 3 = 1 THEN '-atlas4x2' ELSE '-' END) || CASE WHEN p_size % 2 = 0 THEN '-n' ELSE '' END AS name FROM part)
SELECT p_partkey, name, CASE WHEN name LIKE '%-n' OR name LIKE '%-normal' THEN 'normal' WHEN name LIKE '%-h' THEN 'height' ELSE 'albedo' END AS content, CASE WHEN contains(name, '-cube') THEN 'cube' ELSE '2d' END AS kind,
CAST(coalesce(TRY_CAST(regexp_extract(name, '-atlas(\\d+)x(\\d+)', 1) AS INTEGER), 0) AS INTEGER) AS columns, CAST(coalesce(TRY_CAST(regexp_extract(name, '-atlas(\\d+)x(\\d+)', 2) AS INTEGER), 0) AS INTEGER) AS rows FROM n""")
def names_to_types(spark, sf_dir):
    part = F.when(F.col("p_size") % 3 == 0, "-cube").when(F.col("p_size") % 3 == 1, "-atlas4x2").otherwise("-")
    name = F.concat(F.replace("p_name", F.lit(" "), part), F.when(F.col("p_size") % 2 == 0, "-n").otherwise(""))
    n = table(spark, sf_dir, "part").select("p_partkey", name.alias("name"))
    columns, rows = textures.atlas_grid(F.col("name"))
    return n.select("p_partkey", "name", textures.content_type(F.col("name")).alias("content"), textures.texture_type(F.col("name")).alias("kind"), columns.alias("columns"), rows.alias("rows"))


@query("SELECT mode, count(*) AS n FROM (SELECT CASE WHEN b = 0 THEN 8 ELSE CAST(log2(b & -b) AS INTEGER) END AS mode FROM (SELECT CAST(l_partkey % 256 AS INTEGER) AS b FROM lineitem)) GROUP BY mode")
def block_modes(spark, sf_dir):
    b = (F.col("l_partkey") % 256).cast("int")
    return table(spark, sf_dir, "lineitem").groupBy(textures.bc7_mode(b).alias("mode")).agg(F.count("*").alias("n"))


@query("SELECT o_custkey, list(o_orderstatus ORDER BY o_orderkey) AS path FROM orders GROUP BY 1".replace("SELECT o_custkey, list", "SELECT path, count(*) AS n FROM (SELECT o_custkey, list").replace("AS path FROM", "AS p FROM").replace("SELECT path,", "SELECT array_to_string(p, '') AS path,") + ") GROUP BY 1")
def ordered_array_groups(spark, sf_dir):
    p = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("p"))
    return p.groupBy(F.transform("p", lambda x: x["o_orderstatus"]).alias("p")).agg(F.count("*").alias("n")).select(F.array_join("p", "").alias("path"), "n")

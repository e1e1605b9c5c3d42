"""Image operators on `embeddings`: 64 numbers are an 8 x 8 grid, scaled to 0..255."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import colors, vectors
from ..operators import image
from .catalog import query, table


def pixels(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("i", "v"))
    v = F.least(F.greatest(F.rint((F.col("v").cast("double") + 0.5) * 255.0), F.lit(0.0)), F.lit(255.0)).cast("int")
    return e.select("image_id", F.expr("i div 8").cast("int").alias("y"), (F.col("i") % 8).alias("x"), v.alias("r"))


def rgba(spark, sf_dir):
    p = pixels(spark, sf_dir)
    return p.select("image_id", "y", "x", "r", F.when(F.col("x") % 2 == 0, F.col("r")).otherwise(255 - F.col("r")).alias("g"), F.col("r").alias("b"), F.when(F.col("r") < 64, 0).otherwise(255).alias("a"))


_P = """(SELECT vec_id AS image_id, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x, CAST(least(greatest(round_even((CAST(embedding[i + 1] AS DOUBLE) + 0.5) * 255.0, 0), 0.0), 255.0) AS INTEGER) AS r
FROM (SELECT vec_id, embedding, unnest(range(64)) AS i FROM embeddings))"""
_C = f"(SELECT image_id, y, x, r, CASE WHEN x % 2 = 0 THEN r ELSE 255 - r END AS g, r AS b, CASE WHEN r < 64 THEN 0 ELSE 255 END AS a FROM {_P})"


@query(f"SELECT image_id, y, x, r, r AS g, r AS b, 255 AS a FROM {_C}")
def swizzle_rrr1(spark, sf_dir):
    return image.swizzle(rgba(spark, sf_dir), "rrr1")


@query(f"SELECT image_id, bool_or(r <> g OR r <> b) AS has_color, bool_or(a <> 255) AS has_alpha FROM {_C} GROUP BY image_id")
def image_traits(spark, sf_dir):
    return image.traits(rgba(spark, sf_dir))


@query(f"SELECT image_id, CAST(y // 2 AS BIGINT) AS y, CAST(x // 2 AS BIGINT) AS x, CAST((sum(r) + 2) // 4 AS BIGINT) AS r, CAST((sum(g) + 2) // 4 AS BIGINT) AS g FROM {_C} GROUP BY image_id, y // 2, x // 2")
def mip_box(spark, sf_dir):
    return image.box_mip(rgba(spark, sf_dir), ["r", "g"], even=True)


@query(f"SELECT image_id, CAST(y // 2 AS BIGINT) AS y, CAST(x // 2 AS BIGINT) AS x, avg(r) AS r FROM {_P} GROUP BY image_id, y // 2, x // 2")
def mip_box_float(spark, sf_dir):
    return image.box_mip(pixels(spark, sf_dir), ["r"], integers=False, even=True)


_TAP = """(SELECT * FROM (VALUES (0,0,3.0/7),(0,1,3.0/7),(0,2,1.0/7),(1,2,2.0/7),(1,3,3.0/7),(1,4,2.0/7),(2,4,1.0/7),(2,5,3.0/7),(2,6,3.0/7)) t(o, p, w))"""


@query(f"SELECT image_id, ty.o AS y, tx.o AS x, round(sum(r * CAST(ty.w AS DOUBLE) * CAST(tx.w AS DOUBLE)), 4) AS r FROM {_P} q JOIN {_TAP} ty ON q.y = ty.p JOIN {_TAP} tx ON q.x = tx.p GROUP BY 1, 2, 3")
def mip_odd(spark, sf_dir):
    p = pixels(spark, sf_dir).where("y < 7 and x < 7")
    sizes = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.lit(7).alias("width"), F.lit(7).alias("height"))
    return image.weighted_mip(p, sizes, ["r"]).withColumn("r", F.round("r", 4))


_N = f"""(SELECT *, coalesce(lag(r) OVER rw, r) AS l, coalesce(lead(r) OVER rw, r) AS rt, coalesce(lag(r) OVER cw, r) AS u, coalesce(lead(r) OVER cw, r) AS d
FROM {_P} WINDOW rw AS (PARTITION BY image_id, y ORDER BY x), cw AS (PARTITION BY image_id, x ORDER BY y))"""


@query(f"SELECT image_id, y, x, (l - rt) * 0.01 / sqrt(((l - rt) * 0.01) * ((l - rt) * 0.01) + ((u - d) * 0.01) * ((u - d) * 0.01) + 1.0) AS nx, (u - d) * 0.01 / sqrt(((l - rt) * 0.01) * ((l - rt) * 0.01) + ((u - d) * 0.01) * ((u - d) * 0.01) + 1.0) AS ny, 1.0 / sqrt(((l - rt) * 0.01) * ((l - rt) * 0.01) + ((u - d) * 0.01) * ((u - d) * 0.01) + 1.0) AS nz FROM {_N}".replace("0.01", "CAST(0.01 AS DOUBLE)"))
def normals_clamped(spark, sf_dir):
    return image.height_to_normal(pixels(spark, sf_dir), "r", 0.01, wrap=False)


@query(f"SELECT image_id, y, x, r, coalesce(lag(r) OVER rw, last_value(r) OVER rf) AS left, coalesce(lead(r) OVER rw, first_value(r) OVER rf) AS right, coalesce(lag(r) OVER cw, last_value(r) OVER cf) AS up, coalesce(lead(r) OVER cw, first_value(r) OVER cf) AS down FROM {_P} WINDOW rw AS (PARTITION BY image_id, y ORDER BY x), cw AS (PARTITION BY image_id, x ORDER BY y), rf AS (PARTITION BY image_id, y ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), cf AS (PARTITION BY image_id, x ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def neighbors_wrapped(spark, sf_dir):
    return image.neighbors(pixels(spark, sf_dir), "r", wrap=True)


@query(f"WITH m AS (SELECT image_id, y // 2 AS py, x // 2 AS px, max(r) AS r FROM {_P} GROUP BY 1, 2, 3), c AS {_C} SELECT c.image_id, c.y, c.x, CASE WHEN c.a = 0 THEN m.r ELSE c.r END AS r, CASE WHEN c.a = 0 THEN m.r ELSE c.g END AS g, c.a FROM c JOIN m ON c.image_id = m.image_id AND c.y // 2 = m.py AND c.x // 2 = m.px")
def mip_flood(spark, sf_dir):
    p = rgba(spark, sf_dir)
    small = p.groupBy("image_id", F.expr("cast(y div 2 as int)").alias("y"), F.expr("cast(x div 2 as int)").alias("x")).agg(F.max("r").alias("r"))
    small = small.select("image_id", F.lit(1).alias("mip"), "y", "x", "r", F.col("r").alias("g"), F.col("r").alias("b"), F.lit(255).alias("a"))
    return image.mip_flood(p.withColumn("mip", F.lit(0)).select(*small.columns).unionByName(small), 2).where("mip = 0").select("image_id", "y", "x", "r", "g", "a")


@query(f"SELECT image_id, o.y, o.x, r FROM (SELECT CAST(a AS INTEGER) AS y, CAST(b AS INTEGER) AS x FROM range(3) t(a), range(5) u(b)) o JOIN {_P} q ON q.y = o.y * 8 // 3 AND q.x = o.x * 8 // 5")
def resize_point(spark, sf_dir):
    sizes = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.lit(8).alias("width"), F.lit(8).alias("height"))
    return image.resize_point(pixels(spark, sf_dir), sizes, 5, 3).select("image_id", "y", "x", "r")


@query(f"SELECT image_id, y, x, CAST((sum(r) OVER w + 8) // 16 AS BIGINT) AS r FROM {_P} WINDOW w AS (PARTITION BY image_id, y // 4, x // 4)")
def block_average(spark, sf_dir):
    return image.block_average(pixels(spark, sf_dir), ["r"], 4)


@query(f"SELECT image_id, count(CASE WHEN a < 255 AND a <> 0 THEN 1 END) AS transparent, count(CASE WHEN a <> 0 AND (r <> g OR r <> b) THEN 1 END) AS color, count(CASE WHEN a <> 0 AND r > 0 AND r < 255 AND r = g AND r = b THEN 1 END) AS gray, count(CASE WHEN a <> 0 AND g / 255.0 > CAST(0.55 AS DOUBLE) THEN 1 END) AS positive_y FROM {_C} GROUP BY image_id")
def highlights(spark, sf_dir):
    unit = rgba(spark, sf_dir).select("image_id", *((F.col(c) / 255.0).alias(c) for c in "rgba"))
    return unit.groupBy("image_id").agg(*(F.count_if(image.highlight(m)).alias(m) for m in ("transparent", "color", "gray", "positive_y")))


@query(f"SELECT image_id, CAST(y // 4 * 2 + x // 4 AS BIGINT) AS chunk, CAST(sum(r) AS BIGINT) AS total FROM {_P} GROUP BY 1, 2")
def chunk_split(spark, sf_dir):
    return image.chunks(pixels(spark, sf_dir), 4, 4, 2).groupBy("image_id", "chunk").agg(F.sum("r").alias("total"))


@query(f"WITH p AS {_P}, d AS (SELECT a.image_id, abs(a.r - b.r) AS d FROM p a JOIN p b ON a.image_id + 1 = b.image_id AND a.y = b.y AND a.x = b.x), m AS (SELECT image_id, max(d) AS max, avg(d) AS mean, avg(d * d) AS mse FROM d GROUP BY 1) SELECT *, sqrt(mse) AS rmse, CASE WHEN mse = 0 THEN 100.0 ELSE 20 * log10(255.0 / sqrt(mse)) END AS psnr FROM m")
def error_metrics(spark, sf_dir):
    p = pixels(spark, sf_dir)
    return image.metrics(p, p.withColumn("image_id", F.col("image_id") - 1), "r", ["image_id"])


@query(f"SELECT image_id, y, x, CASE WHEN u <= 0.04045 THEN u / 12.92 ELSE pow((u + 0.055) / 1.055, 2.4) END AS lin FROM (SELECT image_id, y, x, r / CAST(255 AS DOUBLE) AS u FROM {_P})".replace("0.04045", "CAST(0.04045 AS DOUBLE)").replace("0.055", "CAST(0.055 AS DOUBLE)"))
def srgb_to_linear(spark, sf_dir):
    return pixels(spark, sf_dir).select("image_id", "y", "x", colors.srgb_to_linear(F.col("r") / 255.0).alias("lin"))


@query(f"SELECT image_id, y, x, CAST(r * a // 255 AS INTEGER) AS pr, CAST(g * a // 255 AS INTEGER) AS pg, r - 128 AS signed_r FROM {_C}")
def premultiplied(spark, sf_dir):
    p = rgba(spark, sf_dir)
    return p.select("image_id", "y", "x", colors.premultiply(F.col("r"), F.col("a")).alias("pr"), colors.premultiply(F.col("g"), F.col("a")).alias("pg"), colors.remap_to_signed(F.col("r")).alias("signed_r"))


@query("WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS v FROM embeddings) SELECT vec_id, list_sum(v) AS total, list_min(v) AS least, list_max(v) AS most, list_sum(list_transform(v, lambda x: x * x)) AS len2, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS len FROM e")
def vector_reducers(spark, sf_dir):
    v = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", vectors.reduce_add(v).alias("total"), F.array_min(v).alias("least"), F.array_max(v).alias("most"), vectors.length_squared(v).alias("len2"), vectors.length(v).alias("len"))


@query("""WITH e AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c FROM embeddings)
SELECT vec_id, a + (b - a) * 0.25 AS lerp, CASE WHEN b >= a THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS step, least(greatest(a, 0.0), 1.0) AS saturate, a - floor(a) AS fract, a * b + c AS mad, round_even(a * 10, 0) AS round_even,
CAST(floor(a * 100) AS BIGINT) & 7 AS low_bits, sin(a) AS sin, atan2(a, b) AS atan2, exp(a) AS exp, degrees(a) AS degrees FROM e""".replace("0.25", "CAST(0.25 AS DOUBLE)"))
def math_catalog(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", *(F.element_at("embedding", i + 1).cast("double").alias(n) for i, n in enumerate("abc")))
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    return e.select(
        "vec_id", vectors.lerp(a, b, 0.25).alias("lerp"), vectors.step(a, b).alias("step"), vectors.saturate(a).alias("saturate"), vectors.fract(a).alias("fract"), vectors.mad(a, b, c).alias("mad"),
        vectors.round_even(a * 10).alias("round_even"), F.floor(a * 100).bitwiseAND(7).alias("low_bits"), F.sin(a).alias("sin"), F.atan2(a, b).alias("atan2"), F.exp(a).alias("exp"), vectors.degrees(a).alias("degrees"),
    )


@query("""WITH e AS (SELECT vec_id, list_transform(embedding[1:9], lambda x: CAST(x AS DOUBLE)) AS m FROM embeddings)
SELECT vec_id, round(m[1] * (m[5] * m[9] - m[6] * m[8]) - m[2] * (m[4] * m[9] - m[6] * m[7]) + m[3] * (m[4] * m[8] - m[5] * m[7]), 9) AS det, round(m[1] + m[5] + m[9], 9) AS trace,
round(m[2] * m[6] - m[3] * m[5], 9) AS cross_x, round(m[1] * m[4] + m[2] * m[5] + m[3] * m[6], 9) AS dot FROM e""")
def matrix_catalog(spark, sf_dir):
    v = [F.slice("embedding", i, 3).cast("array<double>") for i in (1, 4, 7)]
    m = F.array(*v)
    r = lambda x: F.round(x, 9)
    return table(spark, sf_dir, "embeddings").select("vec_id", r(vectors.determinant(m, 3)).alias("det"), r(vectors.trace(m, 3)).alias("trace"), r(F.element_at(vectors.cross(v[0], v[1]), 1)).alias("cross_x"), r(vectors.dot(v[0], v[1])).alias("dot"))


@query("""WITH s AS (SELECT p_partkey AS image_id, CAST(p_size * 13 AS INTEGER) AS width, p_size AS height FROM part),
m AS (SELECT *, unnest(range(least(16, CAST(floor(log2(greatest(width, height))) AS INTEGER) + 1))) AS k FROM s),
l AS (SELECT image_id, k, greatest(1, width >> CAST(k AS INTEGER)) AS w, greatest(1, height >> CAST(k AS INTEGER)) AS h FROM m)
SELECT image_id, CAST(k AS INTEGER) AS mip, w AS mip_width, h AS mip_height, CAST(ceil(w / 4.0) * ceil(h / 4.0) * 16 AS BIGINT) AS length,
CAST(coalesce(sum(ceil(w / 4.0) * ceil(h / 4.0) * 16) OVER (PARTITION BY image_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM l""")
def mip_plan(spark, sf_dir):
    s = table(spark, sf_dir, "part").selectExpr("p_partkey as image_id", "p_size * 13 as width", "p_size as height")
    size = F.ceil(F.col("mip_width") / 4.0) * F.ceil(F.col("mip_height") / 4.0) * 16
    return image.mip_offsets(image.mip_plan(s), size).select("image_id", "mip", "mip_width", "mip_height", F.col("length").cast("bigint").alias("length"), F.col("offset").cast("bigint").alias("offset"))


@query("SELECT p_partkey, p_size, (p_size & (p_size - 1)) = 0 AS pow2, CAST(pow(2, ceil(log2(p_size))) AS BIGINT) AS next FROM part")
def powers_of_two(spark, sf_dir):
    s = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", image.is_power_of_two(s).alias("pow2"), image.next_power_of_two(s).alias("next"))


@query(f"""WITH p AS {_P}, d AS (SELECT a.image_id, a.y, a.x, coalesce(min(CASE WHEN b.r > 127 THEN (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) END), 516) AS near, coalesce(min(CASE WHEN b.r <= 127 THEN (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) END), 516) AS far
FROM p a JOIN p b ON a.image_id = b.image_id GROUP BY 1, 2, 3)
SELECT image_id, y, x, CAST(least(greatest(round_even(128 - 127 * least(greatest((sqrt(near) - sqrt(far)) / 4, -1), 1), 0), 0), 255) AS INTEGER) AS distance FROM d""")
def distance_field(spark, sf_dir):
    return image.distance_field(pixels(spark, sf_dir), "r")


@query(f"SELECT image_id, y, x, CAST((x & 1) | ((y & 1) << 1) | ((x & 2) << 1) | ((y & 2) << 2) | ((x & 4) << 2) | ((y & 4) << 3) AS BIGINT) AS at FROM {_P}")
def morton_order(spark, sf_dir):
    return pixels(spark, sf_dir).select("image_id", "y", "x", image.morton(F.col("x"), F.col("y"), 3).alias("at"))

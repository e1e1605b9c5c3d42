"""More texture, trace and memory operators on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import image, memory, textures, trace
from .catalog import query, table
from .image_queries import _C, rgba


@query(f"SELECT image_id, y, x, CASE WHEN a = 0 THEN 0.0 ELSE CASE WHEN r / 255.0 <= 0.04045 THEN r / 255.0 / 12.92 ELSE pow((r / 255.0 + 0.055) / 1.055, 2.4) END END AS r FROM (SELECT image_id, y, x, CAST(r AS DOUBLE) AS r, a FROM {_C})".replace("255.0", "CAST(255 AS DOUBLE)").replace("0.04045", "CAST(0.04045 AS DOUBLE)").replace("0.055", "CAST(0.055 AS DOUBLE)").replace("0.0 ELSE", "CAST(0 AS DOUBLE) ELSE"))
def linear_prezero(spark, sf_dir):
    return image.linearize(rgba(spark, sf_dir), premultiplied=False, prezero=True).select("image_id", "y", "x", "r")


@query(f"SELECT image_id, y, x, a AS r, a AS g, a AS b, 255 AS a FROM {_C}")
def isolate_alpha(spark, sf_dir):
    return image.isolate(rgba(spark, sf_dir), "a")


@query(f"SELECT image_id, y, x, r, g, b, a FROM {_C} WHERE x = 4 AND y = 2")
def pixel_probe(spark, sf_dir):
    return image.probe(rgba(spark, sf_dir), 0.5, 0.3, 8, 8)


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'BC7s' WHEN p_size % 3 = 1 THEN 'BC7' ELSE 'Invalid' END AS format,
CASE WHEN p_size % 7 > 1 AND p_size % 5 > 0 THEN 'cubearray' WHEN p_size % 7 > 1 THEN 'cube' WHEN p_size % 2 > 0 THEN '3d' WHEN p_size % 5 > 0 THEN '2darray' ELSE '2d' END AS kind,
CAST(greatest(p_size % 2, 1) * greatest(p_size % 5, 1) * greatest(p_size % 7, 1) AS INTEGER) AS chunks FROM part""")
def header_types(spark, sf_dir):
    s = F.col("p_size")
    name = F.when(s % 3 == 2, "nope").otherwise("bc7")
    no = F.lit(False)
    return table(spark, sf_dir, "part").select(
        "p_partkey", textures.parse_format(name, no, s % 3 == 0, no).alias("format"), textures.kind_of_texture(s, s % 2, s % 5, s % 7).alias("kind"), textures.total_chunks(s % 2, s % 5, s % 7).cast("int").alias("chunks"),
    )


@query("""WITH f AS (SELECT o_orderpriority AS name, min(o_orderkey) AS first FROM orders GROUP BY 1), n AS (SELECT name, 'N' || (row_number() OVER (ORDER BY first, name) - 1) AS new FROM f)
SELECT o_orderkey, new AS o_orderpriority FROM orders JOIN n ON o_orderpriority = name""")
def obscured_names(spark, sf_dir):
    return memory.obscure_names(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey")


@query("SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN p_name WHEN p_type = 'SMALL' THEN regexp_extract(p_brand, '[^/]*$') ELSE p_type END AS name FROM part".replace("p_type = 'ECONOMY' THEN p_name", "p_type = 'ECONOMY' THEN p_brand").replace("p_type = 'SMALL' THEN regexp_extract(p_brand, '[^/]*$')", "p_type = 'SMALL' THEN p_brand"))
def viewer_names(spark, sf_dir):
    kind = F.when(F.col("p_type") == "ECONOMY", "OptFunction").when(F.col("p_type") == "SMALL", "Source").otherwise(F.col("p_type"))
    return trace.viewer_names(table(spark, sf_dir, "part").select("p_partkey", kind.alias("name"), F.col("p_brand").alias("detail"), F.lit(1).alias("pid"))).select("p_partkey", "name")


@query("SELECT c_custkey AS path, c_nationkey AS modified FROM customer WHERE c_nationkey <> c_custkey % 25")
def refreshed_files(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("path"), F.col("c_nationkey").cast("bigint").alias("modified"))
    return trace.refreshed(c, c.select("path", (F.col("path") % 25).alias("modified"))).withColumn("modified", F.col("modified").cast("int"))


_KINDS = ["FREE", "UNKNOWN", "BUFFER", "IMAGE_OPTIMAL", "IMAGE_LINEAR", "IMAGE_UNKNOWN", "TEXTURE2D"]


@query("""SELECT l_orderkey, l_linenumber, c[1] AS r, c[2] AS g, c[3] AS b FROM (SELECT l_orderkey, l_linenumber, CASE
WHEN k = 'FREE' THEN [220, 220, 220] WHEN k = 'UNKNOWN' THEN [175, 175, 175]
WHEN v AND k = 'BUFFER' THEN CASE WHEN u & 448 <> 0 THEN [255, 148, 148] WHEN u & 40 <> 0 THEN [255, 187, 121] WHEN u & 20 <> 0 THEN [255, 255, 0] ELSE [255, 255, 165] END
WHEN v AND k = 'IMAGE_OPTIMAL' THEN CASE WHEN u & 32 <> 0 THEN [246, 128, 255] WHEN u & 208 <> 0 THEN [179, 179, 255] WHEN u & 4 <> 0 THEN [0, 255, 255] ELSE [183, 255, 255] END
WHEN v AND k = 'IMAGE_LINEAR' THEN [0, 255, 0] WHEN v AND k = 'IMAGE_UNKNOWN' THEN [0, 255, 164]
WHEN NOT v AND k = 'BUFFER' THEN [255, 255, 165] WHEN NOT v AND k = 'TEXTURE2D' THEN CASE WHEN u & 2 <> 0 THEN [246, 128, 255] WHEN u & 5 <> 0 THEN [179, 179, 255] WHEN u & 8 = 0 THEN [0, 255, 255] ELSE [183, 255, 255] END
ELSE [0, 0, 0] END AS c FROM (SELECT l_orderkey, l_linenumber, l_partkey & 511 AS u, l_suppkey % 2 = 0 AS v, ['FREE', 'UNKNOWN', 'BUFFER', 'IMAGE_OPTIMAL', 'IMAGE_LINEAR', 'IMAGE_UNKNOWN', 'TEXTURE2D'][l_orderkey % 7 + 1] AS k FROM lineitem))""")
def rectangle_colors(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("l_orderkey") % 7 + 1).cast("int"))
    api = F.when(F.col("l_suppkey") % 2 == 0, "Vulkan").otherwise("Direct3D 12")
    color = memory.type_color(kind, F.col("l_partkey").bitwiseAND(511), api)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *(color[c].alias(c) for c in "rgb"))


@query("SELECT p_partkey, 'encode -f bc7' || CASE WHEN p_size % 2 = 0 THEN ' -srgb' ELSE '' END || ' -i ' || p_name || ' -o ' || p_type AS value FROM part")
def encode_scripts(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("source"), F.col("p_type").alias("target"), F.lit("BC7").alias("format"), (F.col("p_size") % 2 == 0).alias("is_srgb"), F.lit("albedo").alias("content"))
    return rows.select("p_partkey", textures.encode_line().alias("value"))

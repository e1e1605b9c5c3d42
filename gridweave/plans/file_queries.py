"""Sources, sinks, codecs and streams: the driver's rows are written by a sink, read back by the source, and compared with the rows themselves."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from .. import functions as registry
from ..functions import hashing, strings
from ..operators import codecs, memory, textures, trace
from ..scratch import fresh_path, materialise
from ..sinks import reports
from ..sources import archives, containers, documents
from ..streaming import traces
from .catalog import query, table
from .image_queries import _C, rgba
from .trace_queries import events, sql_events

_MS = 1_704_200_000_000_000  # a moment within the events


def saved(df, label: str) -> str:
    """Writes (value) rows as text files, one for each partition."""
    path = fresh_path(df.sparkSession, label)
    df.select("value").write.text(path)
    return path


#: Rows of a document that holds several tracks or pools, about; documents of a small table.
SHARE, FEWEST = 50_000, 8


def shares(rows, by: str):
    """The number of a document for each value of `by`: as many documents as rows ask for, so files are few and of bounded size, unless one value has more rows."""
    return F.pmod(F.xxhash64(by), F.lit(max(FEWEST, -(-rows.count() // SHARE))))


# --- trace documents


@query("SELECT tid, name, ts, dur, CAST(detail AS VARCHAR) AS detail FROM " + sql_events())
def trace_json_scan(spark, sf_dir):
    """Documents of many tracks each: one for each track would be very many small files."""
    rows = events(spark, sf_dir).select("tid", "name", F.lit("X").alias("ph"), "ts", "dur", F.create_map(F.lit("detail"), "detail").alias("args"))
    path = fresh_path(spark, "traces")
    rows = rows.withColumn("part", shares(rows, "tid"))
    reports.trace_documents(rows, "part").select("part", F.col("document").alias("value")).write.partitionBy("part").text(path)
    found = documents.trace_events(spark, path)
    return found.select("tid", "name", "ts", "dur", F.element_at("args", "detail").alias("detail"))


@query("SELECT tid, name, ts, dur FROM " + sql_events())
def trace_gzip_lines(spark, sf_dir):
    path = fresh_path(spark, "lines")
    reports.write_events(events(spark, sf_dir).select("tid", "name", F.lit("X").alias("ph"), "ts", "dur"), path)
    return spark.read.schema("tid bigint, name string, ts bigint, dur bigint").json(path)


@query("SELECT event_id, CASE name WHEN 'view' THEN 'ParseFile' WHEN 'click' THEN 'OptFunction' END AS type, detail FROM " + sql_events() + " WHERE name IN ('view', 'click') AND event_id % 3 <> 0")
def event_decode(spark, sf_dir):
    args = F.create_map(F.lit("detail"), "detail")
    rows = events(spark, sf_dir).select("event_id", "name", "ts", "dur", F.when(F.col("event_id") % 3 == 0, "B").otherwise("X").alias("ph"), args.alias("args"))
    return trace.decode(rows, {"view": "ParseFile", "click": "OptFunction"}).select("event_id", "type", "detail")


@query("SELECT tid, CAST(count(*) AS BIGINT) AS n, base64(encode('[' || string_agg(name, ',' ORDER BY event_id) || ']')) AS script FROM " + sql_events() + " GROUP BY tid")
def viewer_hand_off(spark, sf_dir):
    rows = events(spark, sf_dir).groupBy("tid").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "name"))), lambda x: x["name"]), ",").alias("names"))
    return rows.select("tid", "n", reports.hand_off(F.concat(F.lit("["), "names", F.lit("]"))).alias("script"))


# --- archives and codecs


def bundles(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("bundle"), F.concat(F.lit("f"), F.col("p_partkey"), F.when(F.col("p_partkey") % 2 == 0, ".json").otherwise(".txt")).alias("name"), F.encode("p_name", "utf-8").alias("content"))
    return materialise(reports.zip_update(p).select(F.col("bundle").alias("path"), "content"), "bundles")


_ZIP = "(SELECT p_brand AS path, 'f' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '.json' ELSE '.txt' END AS filename, p_name AS text FROM part)"


@query(f"SELECT path, filename, CAST(octet_length(encode(text)) AS BIGINT) AS uncompressed_size, CAST(row_number() OVER (PARTITION BY path ORDER BY filename) - 1 AS INTEGER) AS file_index FROM {_ZIP}")
def zip_listing(spark, sf_dir):
    return archives.zip_entries(bundles(spark, sf_dir)).select("path", "filename", "uncompressed_size", "file_index")


@query(f"SELECT path, filename, text, substr(text, 1, 3) AS start FROM {_ZIP}")
def zip_extract(spark, sf_dir):
    held = bundles(spark, sf_dir)
    part = lambda head: archives.zip_entries(held, content=True, head=head).select("path", "filename", F.decode("content", "utf-8").alias("start" if head else "text"))
    return part(None).join(part(3), ["path", "filename"])


@query(f"SELECT path, filename FROM {_ZIP} WHERE filename LIKE '%.json'")
def zip_extension_filter(spark, sf_dir):
    return archives.zip_entries(bundles(spark, sf_dir), extensions=[".json"]).select("path", "filename")


@query(f"SELECT path, filename, text FROM {_ZIP} WHERE filename = 'f12.json'")
def zip_point_lookup(spark, sf_dir):
    return archives.zip_lookup(bundles(spark, sf_dir), "f12.json").select("path", "filename", F.decode("content", "utf-8").alias("text"))


@query(f"SELECT path || '/' || filename AS path FROM {_ZIP} WHERE path = (SELECT path FROM {_ZIP} WHERE filename = 'f12.json')")
def same_archive(spark, sf_dir):
    held = bundles(spark, sf_dir)
    none = spark.createDataFrame([("x/loose.json", "loose.json", "x", 1)], "path string, name string, folder string, length bigint")
    every = materialise(archives.listing(none, archives.zip_entries(held)), "listing")
    return archives.same_group(every, every.where("name = 'f12.json'").first()["path"]).select("path")


@query(f"SELECT path || '/' || filename AS path, path AS archive, CAST(octet_length(encode(text)) AS BIGINT) AS length FROM {_ZIP} UNION ALL SELECT 'loose/' || n_name, NULL, CAST(n_nationkey AS BIGINT) FROM nation")
def folder_and_archives(spark, sf_dir):
    loose = table(spark, sf_dir, "nation").select(F.concat(F.lit("loose/"), "n_name").alias("path"), F.col("n_name").alias("name"), F.lit("loose").alias("folder"), F.col("n_nationkey").cast("bigint").alias("length"))
    return archives.listing(loose, archives.zip_entries(bundles(spark, sf_dir))).select("path", "archive", "length")


@query("SELECT n_regionkey AS folder, CAST(sum(octet_length(encode(n_name)) + 1) AS BIGINT) AS length, 'unknown' AS kind FROM nation GROUP BY 1")
def folder_scan(spark, sf_dir):
    path = fresh_path(spark, "folders")
    table(spark, sf_dir, "nation").select("n_regionkey", F.col("n_name").alias("value")).write.partitionBy("n_regionkey").text(path)
    found = archives.files(spark, path).where("name like 'part-%'").groupBy("folder").agg(F.sum("length").alias("length"), F.max("file_type").alias("kind"))
    return found.select(F.regexp_extract("folder", r"n_regionkey=(\d+)$", 1).cast("int").alias("folder"), "length", "kind")


@query("SELECT p_partkey, p_name AS gzip, p_name AS deflate, p_name AS zlib FROM part")
def codec_round_trips(spark, sf_dir):
    raw = F.encode("p_name", "utf-8")
    text = lambda c: F.decode(c, "utf-8")
    return table(spark, sf_dir, "part").select("p_partkey", text(archives.gunzip(archives.gzip_bytes(raw))).alias("gzip"), text(archives.inflate(archives.deflate(raw))).alias("deflate"), text(archives.unzlib(archives.zlib_bytes(raw))).alias("zlib"))


_BYTES = "(SELECT p_partkey, list_transform(range(1, length(p_name) + 1), lambda i: CAST(ord(substr(p_name, i, 1)) AS BIGINT)) AS b FROM part)"


@query(f"SELECT p_partkey, CAST(((len(b) + list_sum(list_transform(range(1, len(b) + 1), lambda i: b[i] * (len(b) - i + 1)))) % 65521) * 65536 + (1 + list_sum(b)) % 65521 AS BIGINT) AS adler FROM {_BYTES}")
def adler_checksums(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", hashing.adler32(F.encode("p_name", "utf-8")).alias("adler"))


@query(f"SELECT p_partkey, list_reduce(list_prepend(CAST(2166136261 AS BIGINT), b), lambda h, x: xor((h * 16777619) % 4294967296, x)) AS hash FROM {_BYTES}")
def fnv_hashes(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", strings.fnv1(F.col("p_name")).alias("hash"))


@query(f"SELECT CAST(sum(h) AS BIGINT) AS total FROM (SELECT list_reduce(list_prepend(CAST(2166136261 AS BIGINT), b), lambda h, x: xor((h * 16777619) % 4294967296, x)) AS h FROM {_BYTES})")
def registered_function(spark, sf_dir):
    registry.register(spark)
    return table(spark, sf_dir, "part").selectExpr("fnv1(p_name) as h").agg(F.sum("h").alias("total"))


_NAMES = "(SELECT p_partkey, 'a/b' || (p_partkey % 3) || '/' || CASE p_partkey % 5 WHEN 0 THEN '._' WHEN 1 THEN 'manifest' ELSE 'f' END || CASE p_partkey % 4 WHEN 0 THEN '.json' WHEN 1 THEN '.memtrace' WHEN 2 THEN '.json.gz' ELSE '.o' END AS path FROM part)"


@query(f"""SELECT p_partkey, CASE WHEN path LIKE '%.json' OR path LIKE '%.json.gz' THEN 'build' WHEN path LIKE '%.memtrace' THEN 'memory' ELSE 'unknown' END AS kind, CASE WHEN path LIKE '%.gz' THEN 'compressed' ELSE 'file' END AS container,
path NOT LIKE '%/.\\_%' ESCAPE '\\' AND (path LIKE '%.gz' OR path LIKE '%.memtrace' OR (path LIKE '%.json' AND path NOT LIKE '%/manifest.json')) AS supported FROM {_NAMES}""")
def file_kinds(spark, sf_dir):
    part = F.col("p_partkey")
    stem = F.when(part % 5 == 0, "._").when(part % 5 == 1, "manifest").otherwise("f")
    end = F.when(part % 4 == 0, ".json").when(part % 4 == 1, ".memtrace").when(part % 4 == 2, ".json.gz").otherwise(".o")
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("a/b"), part % 3, F.lit("/"), stem, end).alias("path"))
    return p.select("p_partkey", archives.file_type(F.col("path")).alias("kind"), archives.container_type(F.col("path")).alias("container"), archives.is_supported(F.col("path")).alias("supported"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'gz' WHEN 1 THEN 'png' WHEN 2 THEN 'ktx2' ELSE 'unknown' END AS kind, CAST(CASE p_partkey % 4 WHEN 1 THEN p_size END AS INTEGER) AS width FROM part")
def magic_sniffing(spark, sf_dir):
    k, size = F.col("p_partkey") % 4, F.col("p_size")
    png = F.concat(F.unhex(F.lit("89504E470D0A1A0A0000000D49484452")), F.unhex(F.lpad(F.hex(size), 8, "0")), F.unhex(F.lpad(F.hex(size), 8, "0")))
    content = F.when(k == 0, archives.gzip_bytes(F.encode("p_name", "utf-8"))).when(k == 1, png).when(k == 2, F.unhex(F.lit("AB4B5458203230BB0D0A1A0A00"))).otherwise(F.encode("p_name", "utf-8"))
    rows = table(spark, sf_dir, "part").select("p_partkey", content.alias("content")).withColumn("kind", archives.kind_by_magic(F.col("content")))
    return rows.select("p_partkey", "kind", F.when(F.col("kind") == "png", containers.png_header(F.col("content"))["width"]).alias("width"))


@query("SELECT p_partkey, CAST(p_size AS BIGINT) AS n, CAST(ceil(p_size / 4.0) * 4 AS BIGINT) AS next FROM part")
def typed_reads(spark, sf_dir):
    content = F.concat(F.unhex(F.lit("FFFF")), F.reverse(F.array(F.lit(0)))[0].cast("string").cast("binary"), F.unhex(F.lpad(F.hex("p_size"), 2, "0")), F.unhex(F.lit("000000")))
    n = archives.little_endian(F.col("content"), 3, 4)
    return table(spark, sf_dir, "part").select("p_partkey", content.alias("content")).select("p_partkey", n.alias("n"), archives.padded(n).alias("next"))


# --- texture containers


def plain_textures(spark, sf_dir):
    """Width p_size % 8 + 1, two rows and two levels of one byte a pixel."""
    w = F.col("p_size") % 8 + 1
    level = lambda n: F.encode(F.repeat(F.substring("p_name", 1, 1), n.cast("int")), "utf-8")
    small = F.greatest(F.floor(w / 2), F.lit(1))
    props = F.array(F.struct(F.lit("name").alias("key"), F.col("p_name").alias("value")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), F.lit("EXPr8").alias("format"), w.alias("width"), F.lit(2).alias("height"), F.array(level(w * 2), level(small)).alias("levels"), props.alias("props"))


_TEX = "(SELECT CAST(p_partkey AS VARCHAR) AS path, p_name, CAST(p_size % 8 + 1 AS INTEGER) AS width, CAST(greatest((p_size % 8 + 1) // 2, 1) AS BIGINT) AS small FROM part)"
_HEADER = "SELECT path, '{}' AS container, 'EXPr8' AS format, width, CAST(2 AS INTEGER) AS height, CAST(width * 2 AS BIGINT) AS first, small AS second, {} AS name FROM " + _TEX


def _header(found):
    at = lambda k: F.element_at("levels", k)["length"]
    return found.select("path", "container", "format", "width", "height", at(1).alias("first"), at(2).alias("second"), F.try_element_at("props", F.lit(1))["value"].alias("name"))


@query(_HEADER.format("ktx", "p_name"))
def ktx1_round_trip(spark, sf_dir):
    return _header(containers.textures(reports.containers(plain_textures(spark, sf_dir), kind="ktx")))


@query(_HEADER.format("ktx2", "p_name"))
def ktx2_round_trip(spark, sf_dir):
    return _header(containers.textures(reports.containers(plain_textures(spark, sf_dir), scheme=3)))


@query(_HEADER.format("dds", "CAST(NULL AS VARCHAR)"))
def dds_round_trip(spark, sf_dir):
    return _header(containers.textures(reports.containers(plain_textures(spark, sf_dir), kind="dds")))


@query(f"SELECT path, CAST(0 AS INTEGER) AS mip, repeat(substr(p_name, 1, 1), width * 2) AS payload FROM {_TEX} UNION ALL SELECT path, 1, repeat(substr(p_name, 1, 1), CAST(small AS INTEGER)) FROM {_TEX}")
def level_payloads(spark, sf_dir):
    return containers.level_payloads(reports.containers(plain_textures(spark, sf_dir), scheme=2)).withColumn("payload", F.decode("payload", "utf-8"))


@query(f"SELECT path, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CAST(ord(substr(p_name, 1, 1)) AS DOUBLE) AS r, CAST(255 AS DOUBLE) AS a FROM (SELECT *, unnest(range(width)) AS x FROM (SELECT *, unnest(range(2)) AS y FROM {_TEX}))")
def texture_into_image(spark, sf_dir):
    return codecs.texture_pixels(reports.containers(plain_textures(spark, sf_dir))).select("path", "y", "x", "r", "a")


@query(f"SELECT path, 'EXPrgba8' AS format, CAST(width * 8 AS BIGINT) AS first FROM {_TEX}")
def decoded_textures(spark, sf_dir):
    found = containers.textures(codecs.decoded(reports.containers(plain_textures(spark, sf_dir))))
    return found.select("path", "format", F.element_at("levels", 1)["length"].alias("first"))


@query(f"SELECT path, CASE WHEN width > 4 THEN CAST(small AS INTEGER) ELSE width END AS width FROM {_TEX}")
def thumbnails(spark, sf_dir):
    return codecs.thumbnails(reports.containers(plain_textures(spark, sf_dir)), largest=4).select("path", "width")


@query(f"SELECT path, CAST(3 * width AS BIGINT) AS bytes, CAST(width * 2 / CAST(1000000 AS DOUBLE) AS DOUBLE) AS megapixels FROM (SELECT path, width FROM {_TEX}) WHERE width % 2 = 0".replace("3 * width", "width * 2 + greatest(width // 2, 1)"))
def texture_info(spark, sf_dir):
    found = textures.info(containers.textures(reports.containers(plain_textures(spark, sf_dir))))
    return found.where("width % 2 = 0").select("path", "bytes", "megapixels")


@query(f"SELECT path, path || ': EXPr8 ' || width || 'x2, 2 levels, ' || (width * 2 + small) || ' bytes (100%)' AS value FROM {_TEX}")
def info_text(spark, sf_dir):
    found = textures.info(containers.textures(reports.containers(plain_textures(spark, sf_dir), scheme=0)))
    lines = textures.info_lines(found)
    return lines.select(F.regexp_extract("value", "^([^:]*):", 1).alias("path"), "value")


@query(f"SELECT CAST(image_id AS BIGINT) AS path, y, x, r, g, b, a FROM {_C}")
def png_round_trip(spark, sf_dir):
    files = containers.png_files(rgba(spark, sf_dir).withColumn("path", F.col("image_id").cast("string")))
    return containers.png_pixels(files).select(F.col("path").cast("bigint").alias("path"), "y", "x", "r", "g", "b", "a")


@query("SELECT vec_id AS path, true AS srgb FROM embeddings")
def png_rewrite(spark, sf_dir):
    files = containers.png_files(rgba(spark, sf_dir).withColumn("path", F.col("image_id").cast("string")))
    marked = files.withColumn("content", containers.png_with_srgb("content"))
    return containers.png_pixels(marked).groupBy(F.col("path").cast("bigint").alias("path")).agg(F.bool_and("srgb").alias("srgb"))


@query("SELECT p_partkey AS path, CAST((p_size * 31 / CAST(255 AS DOUBLE)) AS INTEGER) AS five, ((CAST(p_size * 31 / CAST(255 AS DOUBLE) AS INTEGER) << 3) | (CAST(p_size * 31 / CAST(255 AS DOUBLE) AS INTEGER) >> 2)) AS r FROM part".replace("CAST((p_size * 31 / CAST(255 AS DOUBLE)) AS INTEGER)", "CAST(round_even(p_size * 31 / CAST(255 AS DOUBLE), 0) AS INTEGER)").replace("CAST(p_size * 31 / CAST(255 AS DOUBLE) AS INTEGER)", "CAST(round_even(p_size * 31 / CAST(255 AS DOUBLE), 0) AS INTEGER)"))
def block_codec_constant(spark, sf_dir):
    """A block of one color keeps it to 5 bits."""
    pixel = F.unhex(F.concat(*(F.lpad(F.hex("p_size"), 2, "0"),) * 3, F.lit("FF")))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), F.lit(4).alias("width"), F.lit(4).alias("height"), F.unhex(F.repeat(F.hex(pixel), 16)).alias("rgba"))
    found = codecs.texture_pixels(reports.containers(codecs.encoded(rows, "BC1")))
    one = found.groupBy("path").agg(F.min("r").cast("int").alias("r"))
    return one.select(F.col("path").cast("bigint").alias("path"), F.shiftright("r", 3).alias("five"), "r")


@query("SELECT vec_id AS image_id, CAST(64 * 4 AS BIGINT) AS bytes FROM embeddings")
def explicit_pack(spark, sf_dir):
    rows = rgba(spark, sf_dir).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("y", "x", "r", "g", "b", "a"))).alias("p"))
    two = lambda c: F.lpad(F.hex(c), 2, "0")
    data = F.unhex(F.array_join(F.transform("p", lambda x: F.concat(two(x["r"]), two(x["g"]), two(x["b"]), two(x["a"]))), ""))
    packed = codecs.encoded(rows.select(F.col("image_id").cast("string").alias("path"), F.lit(8).alias("width"), F.lit(8).alias("height"), data.alias("rgba")), "EXPrgba8")
    return packed.select(F.col("path").cast("bigint").alias("image_id"), F.length(F.element_at("levels", 1)).cast("bigint").alias("bytes"))


# --- documents


@query("""SELECT 'Pool' || l_suppkey AS pool_type, l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS size, CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber, l_partkey, l_returnflag, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS addr FROM lineitem WHERE l_orderkey < 500""".replace(" WHERE l_orderkey < 500", ""))
def memory_dump_scan(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    allocation = F.struct(F.lit("BUFFER").alias("Type"), F.col("l_quantity").cast("bigint").alias("Size"), F.lit(128).cast("bigint").alias("Usage"), F.col("l_linenumber").cast("string").alias("Name"))
    key = F.struct("l_linenumber", "l_partkey", "l_returnflag", "l_extendedprice")
    blocks = li.groupBy("l_suppkey", "l_orderkey").agg(F.array_sort(F.collect_list(F.struct(key.alias("k"), allocation.alias("a")))).alias("s"))
    block = F.struct(F.transform("s", lambda x: x["a"]).alias("Suballocations"))
    pools = blocks.groupBy("l_suppkey").agg(F.map_from_entries(F.collect_list(F.struct(F.col("l_orderkey").cast("string").alias("key"), block.alias("value")))).alias("Blocks"))
    pool = F.struct(F.concat(F.lit("Pool"), "l_suppkey").alias("key"), F.struct("Blocks").alias("value"))
    dumps = pools.groupBy(shares(li, "l_suppkey").alias("part")).agg(F.map_from_entries(F.collect_list(pool)).alias("DefaultPools"))
    document = F.to_json(F.struct(F.struct(F.lit("Vulkan").alias("API")).alias("General"), "DefaultPools"))
    path = fresh_path(spark, "dumps")
    dumps.select("part", document.alias("value")).write.partitionBy("part").text(path)
    rows = memory.allocations(documents.memory_dump(spark, f"{path}/*"))
    return rows.select("pool_type", F.col("block_id").cast("bigint").alias("l_orderkey"), F.substring_index("name", "-", -1).cast("int").alias("l_linenumber"), "size", "addr")


@query("SELECT s_nationkey AS atlas, s_name AS name, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS INTEGER) AS ordinal, s_suppkey / CAST(200 AS DOUBLE) AS x, CAST(0.25 AS DOUBLE) AS h FROM supplier")
def atlas_scan(spark, sf_dir):
    x = F.col("s_suppkey").cast("double")
    region = F.struct(F.col("s_name").alias("name"), F.array(x, F.lit(0.0), F.lit(10.0), F.lit(25.0)).alias("rpx"))
    rows = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", region.alias("r")))), lambda v: v["r"]).alias("regions"))
    document = F.to_json(F.struct(F.col("s_nationkey").cast("string").alias("name"), F.lit(200).alias("width"), F.lit(100).alias("height"), "regions"))
    path = fresh_path(spark, "atlases")
    rows.select("s_nationkey", document.alias("value")).write.partitionBy("s_nationkey").text(path)
    return documents.atlas(spark, f"{path}/*").select(F.col("atlas").cast("int").alias("atlas"), "name", "ordinal", "x", "h")


@query("SELECT p_size % 2 = 0 AS srgb, CAST(count(*) AS BIGINT) AS commands, CAST(sum(CASE WHEN p_size % 2 = 0 THEN 8 ELSE 7 END) AS BIGINT) AS arguments FROM part GROUP BY 1")
def script_scan(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("f"), "p_partkey").alias("source"), F.concat(F.lit("t"), "p_partkey").alias("target"), F.lit("BC7").alias("format"), (F.col("p_size") % 2 == 0).alias("is_srgb"), F.lit("albedo").alias("content"))
    lines = textures.encode_script(rows)
    path = saved(lines.unionByName(spark.createDataFrame([("# a comment",), ("",), ("  ",)], "value string")), "scripts")
    found = documents.script(spark, path).select("arguments", F.array_contains("arguments", "-srgb").alias("srgb"))
    return found.groupBy("srgb").agg(F.count("*").alias("commands"), F.sum(F.size("arguments")).cast("bigint").alias("arguments"))


@query("SELECT n_nationkey AS node, n_name AS name, CAST(n_nationkey * 2 + 1 AS INTEGER) AS first FROM nation")
def scene_nodes(spark, sf_dir):
    node = F.struct(F.col("n_name").alias("name"), F.array(F.col("n_nationkey") * 2 + 1, F.col("n_nationkey") * 2 + 2).alias("children"))
    document = table(spark, sf_dir, "nation").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", node.alias("n")))), lambda x: x["n"]).alias("nodes"))).alias("value"))
    return documents.scene_nodes(spark, saved(document, "scenes")).select("node", "name", F.element_at("children", 1).alias("first"))


@query("SELECT s_suppkey AS path, CAST(k AS INTEGER) AS key, CAST(k * 2 AS DOUBLE) AS ts, CAST(s_suppkey + k AS DOUBLE) AS value FROM (SELECT s_suppkey, unnest(range(4)) AS k FROM supplier)")
def scene_keyframes(spark, sf_dir):
    @F.pandas_udf("binary")
    def scene(n: pd.Series) -> pd.Series:
        return n.map(lambda x: documents.write_glb([0.0, 2.0, 4.0, 6.0], [float(x + k) for k in range(4)]))

    files = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("path"), scene("s_suppkey").alias("content"))
    return documents.keyframes(files).select(F.col("path").cast("bigint").alias("path"), "key", "ts", F.element_at("value", 1).alias("value"))


@query("SELECT p_partkey, p_name AS text FROM part")
def data_uris(spark, sf_dir):
    uri = F.concat(F.lit("data:text/plain;base64,"), F.base64(F.encode("p_name", "utf-8")))
    return table(spark, sf_dir, "part").select("p_partkey", F.decode(documents.data_uri(uri), "utf-8").alias("text"))


# --- reports


@query("""SELECT CAST(place AS INTEGER) AS place, value FROM (SELECT 0 AS place, '**** Costs' AS value UNION ALL SELECT row_number() OVER (ORDER BY us DESC, name) AS place,
printf('%8d ms: %s (%d times, avg %d ms)', us // 1000, name, n, us // 1000 // n) AS value FROM (SELECT name, CAST(sum(dur) AS BIGINT) AS us, count(*) AS n FROM """ + sql_events() + " GROUP BY name))")
def text_report(spark, sf_dir):
    lines = reports.report_lines(trace.cost(events(spark, sf_dir), ["name"]), "Costs", "us", "name", "n")
    path = fresh_path(spark, "report")
    reports.write_text(lines, path)
    back = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.rtrim("value"), "\n")).alias("place", "value"))
    return back.where("value <> ''")


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name ELSE '[' || CASE p_size % 3 WHEN 1 THEN 'W' ELSE 'E' END || '] kit ' || p_name || CASE WHEN p_size % 2 = 0 THEN chr(10) || 'a.cpp:' || p_size || ': main run()' ELSE '' END END AS value FROM part WHERE p_size % 5 <> 0""")
def log_lines(spark, sf_dir):
    s = F.col("p_size")
    level = F.when(s % 5 == 0, "debug").when(s % 3 == 0, "info").when(s % 3 == 1, "warning").otherwise("error")
    rows = table(spark, sf_dir, "part").select("p_partkey", level.alias("level"), F.lit("kit").alias("group"), F.concat("p_name", F.lit("\n")).alias("text"), F.when(s % 2 == 0, "src/a.cpp").alias("file"), s.alias("line"), F.lit("main").alias("thread"), F.lit("run").alias("func"))
    keyed = rows.withColumn("text", F.concat(F.col("p_partkey").cast("string"), F.lit("|"), "text"))
    value = F.concat(F.regexp_extract("value", r"^(?s)(.*?)\d+\|", 1), F.regexp_replace("value", r"^(?s).*?\d+\|", ""))
    return reports.log_lines(keyed, release=True).select(F.regexp_extract("value", r"(\d+)\|", 1).cast("bigint").alias("p_partkey"), value.alias("value"))


@query("SELECT p_partkey, CAST(4 AS BIGINT) * ((p_size % 8) + 1) AS width FROM part".replace("CAST(4 AS BIGINT) * ((p_size % 8) + 1)", "CAST(40 AS INTEGER)"))
def strip_charts(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.lit(0).cast("bigint").alias("addr"), F.col("p_size").cast("bigint").alias("size"), F.lit("BUFFER").alias("type"), F.lit(128).cast("bigint").alias("usage"))
    charts = memory.strip_chart(rows, ["p_partkey"], 40)
    return charts.select("p_partkey", containers.png_header(F.col("content"))["width"].alias("width"))


@query("SELECT DISTINCT 'M' AS ph, CAST(NULL AS VARCHAR) AS cname, 'part' || s_nationkey AS label FROM supplier UNION ALL SELECT 'X', 'olive', NULL FROM supplier".replace("'part' || s_nationkey", "'default  block ' || s_nationkey"))
def names_before_allocations(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    rows = s.select(F.lit("default").alias("pool_type"), F.lit("").alias("pool_name"), F.lit("block").alias("kind"), F.col("s_nationkey").cast("string").alias("block_id"), F.col("s_name").alias("name"), F.lit(0).alias("addr"), F.lit(1).alias("size"), F.lit("olive").alias("color"))
    return memory.named_trace(rows).select("ph", "cname", "label")


# --- streams: files that have arrived are read to the end


def _arrived(spark, sf_dir):
    rows = events(spark, sf_dir).select(F.col("event_id").alias("value"), "tid", "name", F.when(F.col("event_id") % 4 == 0, "C").otherwise("X").alias("ph"), "ts", "dur", F.lit(0).alias("depth"))
    path = fresh_path(spark, "arrived")
    rows.repartition(4, "tid").write.json(path)
    return traces.arrivals(spark, path)


@query(f"SELECT event_id, greatest(ts, {_MS}) AS ts, dur - greatest({_MS} - ts, 0) AS dur FROM {sql_events()} WHERE event_id % 4 <> 0 AND dur - greatest({_MS} - ts, 0) > 0 UNION ALL SELECT event_id, ts, dur FROM {sql_events()} WHERE event_id % 4 = 0 AND ts >= {_MS}")
def stream_append(spark, sf_dir):
    path = fresh_path(spark, "appended")
    traces.append(traces.admitted(_arrived(spark, sf_dir), _MS), path, fresh_path(spark, "log")).awaitTermination()
    return spark.read.schema(traces.EVENT).json(path).select(F.col("value").alias("event_id"), "ts", "dur")


@query("SELECT name, count(*) AS count, CAST(sum(dur) AS BIGINT) AS duration FROM " + sql_events() + " WHERE event_id % 4 <> 0 GROUP BY name")
def stream_totals(spark, sf_dir):
    path = fresh_path(spark, "totals")
    traces.keep_totals(_arrived(spark, sf_dir), path, fresh_path(spark, "log")).awaitTermination()
    return spark.read.parquet(path)


@query(f"SELECT tid AS thread, CAST(dense_rank() OVER (ORDER BY tid) AS BIGINT) AS tid FROM (SELECT DISTINCT tid FROM {sql_events()})")
def stream_track_ids(spark, sf_dir):
    path = fresh_path(spark, "tracks")
    traces.track_ids(_arrived(spark, sf_dir).select(F.col("tid").alias("thread")), path, fresh_path(spark, "log")).awaitTermination()
    return spark.read.parquet(path).select("thread", "tid")

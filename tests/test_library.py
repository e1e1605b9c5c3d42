"""Sources, sinks, streams and functions against fixtures and round trips."""

import gzip
import io
import json
import random
import struct
import zipfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from gridweave.functions import hashing, strings, vectors
from gridweave.operators import image, memory, nesting, relations, trace
from gridweave.sinks import reports
from gridweave.sources import archives, containers, documents
from gridweave.streaming import traces

EVENTS = [
    ("Source", 20, 30, "/p/b.h"), ("Source", 10, 60, "/p/a.h"), ("InstantiateFunction", 72, 5, "f<int>"),
    ("InstantiateFunction", 71, 8, "f<v<int>>"), ("Frontend", 5, 80, ""), ("ExecuteCompiler", 0, 100, "main.json"),
]


@pytest.fixture(scope="module")
def events(spark):
    rows = [("f", i, n, d, ts, dur) for i, (n, ts, dur, d) in enumerate(EVENTS)]
    return spark.createDataFrame(rows, "file string, event_id bigint, name string, detail string, ts bigint, dur bigint")


def test_nesting_of_the_small_trace(spark, events):
    got = {r["event_id"]: (r["parent_id"], r["depth"]) for r in trace.nest(events, ["file"]).collect()}
    assert got == {0: (1, 3), 1: (4, 2), 2: (3, 3), 3: (4, 2), 4: (5, 1), 5: (None, 0)}
    assert {r["event_id"]: r["parent_id"] for r in nest_by_join(events, ["file"]).collect()} == {k: v[0] for k, v in got.items()}


def nest_by_join(events, tracks):
    """Parents by a range self-join: quadratic, for checks."""
    rank = F.row_number().over(Window.partitionBy(*tracks).orderBy("ts", F.desc("dur"), F.desc("event_id")))
    e = events.withColumn("rank", rank)
    p = e.select(*tracks, F.col("event_id").alias("p_id"), F.col("ts").alias("p_ts"), F.col("dur").alias("p_dur"), F.col("rank").alias("p_rank"))
    holds = (F.col("p_ts") <= F.col("ts")) & (F.col("ts") + F.col("dur") <= F.col("p_ts") + F.col("p_dur")) & (F.col("p_rank") < F.col("rank"))
    found = e.join(p, tracks).where(holds).groupBy("event_id").agg(F.max_by("p_id", "p_rank").alias("parent_id"))
    return events.select("event_id").join(found, "event_id", "left")


def test_a_busy_track_is_cut_over_many_partitions(spark):
    rows = [("busy" if i % 4 else None, i, "n", "", (i * 7919) % 5000, (i * 31) % 60) for i in range(3000)]
    table = spark.createDataFrame(rows, "file string, event_id bigint, name string, detail string, ts bigint, dur bigint")
    busy = table.where("file is not null")
    got = {r["event_id"]: r["parent_id"] for r in trace.nest(table, ["file"]).where("file is not null").collect()}
    assert got == {r["event_id"]: r["parent_id"] for r in nest_by_join(busy, ["file"]).collect()}


def by_list(rows, tracks=1):
    """What nesting.nest() gives, by a stack for each track: {id: (parent, depth, steps from the outside in, nearest marked, whether an ancestor has the key)}."""
    out, stacks = {}, {}
    for track, number, ts, dur, step, mark, key in sorted((r for r in rows if r[2] is not None and r[3] is not None), key=lambda r: (r[2], -r[3], -r[1])):
        stack = stacks.setdefault(track, [])
        while stack and stack[-1][0] < ts + dur:
            stack.pop()
        marked = [x[1] for x in stack if x[3]]
        out[number] = (stack[-1][1] if stack else None, len(stack), tuple(x[2] for x in stack if x[2] is not None), marked[-1] if marked else None, key is not None and any(x[4] == key for x in stack))
        stack.append((ts + dur, number, step, mark, key))
    return out | {r[1]: (None, 0, (), None, False) for r in rows if r[2] is None or r[3] is None}


@pytest.mark.parametrize("chunk,parts,cover", [(7, 3, True), (64, 8, True), (50_000, 4, True), (10, 5, False), (1, 2, True)])
def test_nesting_by_merged_stacks(spark, monkeypatch, chunk, parts, cover):
    monkeypatch.setattr(nesting, "CHUNK", chunk)
    r = random.Random(chunk)
    rows = [(r.choice(["busy", "busy", "busy", None, "b"]), k, r.randrange(300), r.choice([0, 1, 3, 9, 40, 150]), r.choice(["a", "b", None]), r.random() < 0.2, r.choice(["x", "y", "z", None])) for k in range(600)]
    rows += [("busy", 1000 + k, -5, 1000 - k, f"deep{k % 3}", k == 7, None) for k in range(30)] if cover else []
    rows += [("busy", 2000, None, 5, "n", True, "x"), ("busy", 2001, 5, None, "n", True, "x"), ("lone", 2002, 1, 1, None, False, None)]
    table = spark.createDataFrame(rows, "track string, event_id bigint, ts bigint, dur bigint, s string, m boolean, k string").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        nested = nesting.nest(table, ["track"], F.col("s"), {"marked": F.col("m")}, {"again": F.col("k")})
        chains = {bytes(x["path"]): tuple(reversed(x["chain"])) for x in nesting.chains(nesting.dictionary(nested)).collect()}
        found = nested.collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    got = {x["event_id"]: (x["parent_id"], x["depth"], chains[bytes(x["path"])] if x["path"] is not None else (), x["marked"], x["again"]) for x in found}
    assert got == by_list(rows) and len(found) == len(rows)
    assert nested.columns == ["track", "event_id", "ts", "dur", "s", "m", "k", "parent_id", "depth", "path", "own", "step", "marked", "again"]


def test_a_covered_track_goes_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(nesting, "CHUNK", 5000)
    table = spark.range(120_000).selectExpr("1 as track", "id as event_id", "'n' as name", "'d' as detail", "if(id = 0, 0, id) as ts", "if(id = 0, 1000000, id % 7) as dur")
    nested = trace.nest(table, ["track"])
    shares = nested.groupBy(F.spark_partition_id()).count().collect()
    assert nested.where("parent_id is null").count() == 1 and len(shares) >= 2 and max(s["count"] for s in shares) <= 80_000


def test_self_time_and_templates(spark, events):
    nested = trace.nest(events, ["file"])
    own = {r["event_id"]: (r["dur_sub"], r["dur_self"]) for r in trace.self_time(nested).collect()}
    assert own[1] == (30, 30) and own[0] == (0, 30)
    (top,) = trace.template_cost(events, ["file"]).collect()
    assert (top["collapsed"], top["us"], top["count"]) == ("f<$>", 8, 1)


def test_header_report(spark, events):
    rows = trace.header_cost(events, ["file"], only_roots=False).collect()
    assert [(r["detail"], r["us"], r["root"]) for r in rows] == [("/p/a.h", 60, True), ("/p/b.h", 30, False)]
    assert rows[1]["chains"][0]["chain"] == ["/p/a.h"]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 8)), min_size=1, max_size=12))
def test_sweep_gives_innermost_container(intervals):
    order = sorted(range(len(intervals)), key=lambda e: (intervals[e][0], -intervals[e][1], -e))
    state = nesting.Sweep(0, 0)
    for k, e in enumerate(order):
        ts, dur = intervals[e]
        parent = state.take(ts + dur, e)[0]
        holders = [p for p in order[:k] if intervals[p][0] <= ts and ts + dur <= sum(intervals[p])]
        assert parent == (holders[-1] if holders else None)


@pytest.mark.parametrize("name, expected", [("f<int>", "f<$>"), ("f<v<int>>::g<a>", "f<$>::g<$>"), ("operator<", "operator<"), ("a<b", "a<b"), ("a>b<", "a>b<"), ("plain", "plain"), ("", "")])
def test_collapse_name(spark, name, expected):
    assert spark.range(1).select(strings.collapse_name(F.lit(name)).alias("x")).first()["x"] == expected


def test_string_functions(spark):
    row = spark.range(1).select(
        strings.is_header(F.lit("/a/b.hpp")), strings.is_header(F.lit("/a/vector")), strings.is_header(F.lit("/a/b.cpp")), strings.is_header(F.lit("a.")),
        strings.short_directory(F.lit("/a/b/c/d.json")), strings.bytes_text(F.lit(2047)), strings.object_name(F.lit("x.JSON")),
    ).first()
    assert list(row) == [True, True, False, False, "b/c", "1 KiB", "x.o"]
    h = spark.createDataFrame([("ab",), (None,)], "t string").select(strings.fnv1(F.col("t")), hashing.adler32(F.col("t").cast("binary"))).collect()
    assert h[0][0] == (((0x811C9DC5 * 0x01000193 % 2**32) ^ 97) * 0x01000193 % 2**32) ^ 98 and h[1][0] is None and h[0][1] == 0x012600C4


def test_quaternions_and_matrices(spark):
    v = lambda *x: F.array(*(F.lit(float(a)) for a in x))
    s = 0.5**0.5
    row = spark.range(1).select(vectors.quaternion_rotate(v(0, 0, s, s), v(1, 0, 0)), vectors.slerp(v(0, 0, 0, 1), v(0, 0, 1, 0), F.lit(0.5)), vectors.inverse3(F.array(v(2, 0, 0), v(0, 4, 0), v(0, 0, 1))), vectors.reverse_bits(F.lit(1))).first()
    assert np.allclose(row[0], [0, 1, 0]) and np.allclose(row[1], [0, 0, s, s]) and np.allclose(row[2], np.diag([0.5, 0.25, 1])) and row[3] == 2**31


DUMP = {
    "General": {"API": "Vulkan", "GPU": "g"},
    "DefaultPools": {"Type 0": {"PreferredBlockSize": 1, "Blocks": {"7": {"TotalBytes": 350, "Suballocations": [
        {"Type": "BUFFER", "Size": 100, "Usage": 0x80}, {"Type": "FREE", "Size": 50}, {"Type": "IMAGE_OPTIMAL", "Size": 200, "Usage": 4}]}},
        "DedicatedAllocations": [{"Type": "IMAGE_LINEAR", "Size": 9, "Usage": 1, "Name": "x"}]}},
    "CustomPools": {},
}


def test_memory_dump(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps(DUMP))
    rows = memory.allocations(documents.memory_dump(spark, str(tmp_path / "d.json"))).orderBy("kind", "pos").collect()
    assert [(r["addr"], r["name"], r["size"]) for r in rows] == [(0, "VB-M", 100), (150, "TT-M", 200), (0, "LT-x", 9)]
    assert memory.trace_rows(memory.allocations(documents.memory_dump(spark, str(tmp_path / "d.json")))).count() == 3


def test_trace_source_tolerates_trailing_commas_and_gzip(spark, tmp_path):
    text = '{"traceEvents":[{"ph":"X","tid":1,"ts":0,"dur":5,"name":"Source","args":{"detail":"a.h"}},{"ph":"M","name":"thread_name","args":{"name":"t"}},]}'
    (tmp_path / "a.json").write_text(text)
    with gzip.open(tmp_path / "b.json.gz", "wt") as f:
        f.write(text)
    e = documents.trace_events(spark, str(tmp_path))
    assert e.count() == 4
    assert [(r["detail"], r["type"]) for r in trace.decode(e).collect()] == [("a.h", "ParseFile")] * 2


def test_atlas_script_and_catalog(spark, tmp_path):
    (tmp_path / "x-atlas.json").write_text(json.dumps({"name": "A", "width": 128, "height": 128, "regions": [{"name": "red", "ruv": [0, 0, 0.25, 0.25]}, {"name": "px", "rpx": [64, 32, 32, 32]}]}))
    rows = {r["name"]: (r["x"], r["y"], r["w"], r["h"]) for r in documents.atlas(spark, str(tmp_path / "x-atlas.json")).collect()}
    assert rows == {"red": (0, 0, 0.25, 0.25), "px": (0.5, 0.25, 0.25, 0.25)}
    (tmp_path / "s.txt").write_text("encode -i a.png\n# no\n\ninfo b.ktx\n")
    assert [r["arguments"] for r in documents.script(spark, str(tmp_path / "s.txt")).orderBy("line").collect()] == [["encode", "-i", "a.png"], ["info", "b.ktx"]]
    kinds = {r["name"]: r["file_type"] for r in archives.files(spark, str(tmp_path)).collect()}
    assert kinds == {"x-atlas.json": "build", "s.txt": "unknown"}


def test_zip_entries_and_codecs(spark, tmp_path):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("d/", "")
        z.writestr("d/a.json", "hello" * 50, zipfile.ZIP_DEFLATED)
        z.writestr("inner.zip", "x")
    (tmp_path / "t.zip").write_bytes(out.getvalue())
    files = spark.read.format("binaryFile").load(str(tmp_path / "t.zip"))
    (row,) = archives.zip_entries(files, content=True, head=5).collect()
    assert (row["filename"], row["uncompressed_size"], bytes(row["content"])) == ("d/a.json", 250, b"hello")
    data = spark.createDataFrame([(bytearray(b"abc" * 9),)], "x binary")
    for there, back in ((archives.gzip_bytes, archives.gunzip), (archives.deflate, archives.inflate), (archives.zlib_bytes, archives.unzlib)):
        assert bytes(data.select(back(there("x"))).first()[0]) == b"abc" * 9


LEVELS = [bytes(range(64)), bytes(16), bytes(4)]


@pytest.mark.parametrize("scheme", [0, 2, 3])
def test_ktx2_round_trip(scheme):
    data = containers.write_ktx2("EXPrgba8", 4, 4, LEVELS, [("a", "b"), ("key", "value")], scheme)
    t = containers.read_ktx2(data)
    assert [containers.read_level(data, scheme, x) for x in t["levels"]] == LEVELS
    assert t["props"] == [("a", "b"), ("key", "value")] and (t["format"], t["width"]) == ("EXPrgba8", 4)
    assert all(o % 4 == 0 for o, _, _ in t["levels"]) and t["levels"][2][0] < t["levels"][0][0]


def test_other_containers_and_texture_rows(spark):
    ktx, dds = containers.write_ktx1("BC1", 8, 8, [bytes(32), bytes(8)]), containers.write_dds("BC7", 8, 4, [bytes(32)])
    rows = spark.createDataFrame([("a", bytearray(ktx)), ("b", bytearray(dds)), ("c", bytearray(b"junk"))], "path string, content binary")
    got = {r["path"]: r for r in containers.textures(rows).collect()}
    assert (got["a"]["format"], [x["length"] for x in got["a"]["levels"]]) == ("BC1", [32, 8])
    assert got["b"]["format"] == "BC7" and got["c"]["error"]
    made = reports.containers(spark.createDataFrame([("t", "EXPr8", 2, 2, [bytearray(4), bytearray(1)])], "path string, format string, width int, height int, levels array<binary>")).first()
    assert containers.read_ktx2(bytes(made["content"]))["format"] == "EXPr8"


def test_png(spark):
    px = bytes(i % 251 for i in range(4 * 5 * 3))
    data = containers.write_png(5, 3, px, srgb=True)
    assert containers.read_png(data) == (5, 3, True, px)
    rows = spark.createDataFrame([("p", bytearray(data))], "path string, content binary")
    assert containers.png_pixels(rows).count() == 15
    assert tuple(rows.select(containers.png_header("content").alias("h")).first()["h"]) == (5, 3)


def test_scene_keyframes(spark):
    binary = struct.pack("<2f", 0, 2) + struct.pack("<6f", 0, 0, 0, 10, 0, 0)
    document = json.dumps({"animations": [{"channels": [{"sampler": 0, "target": {"node": 0, "path": "translation"}}], "samplers": [{"input": 0, "output": 1}]}],
                           "accessors": [{"bufferView": 0, "componentType": 5126, "count": 2, "type": "SCALAR"}, {"bufferView": 1, "componentType": 5126, "count": 2, "type": "VEC3"}],
                           "bufferViews": [{"byteOffset": 0}, {"byteOffset": 8}]}).encode()
    document += b" " * (-len(document) % 4)
    body = struct.pack("<I4s", len(document), b"JSON") + document + struct.pack("<I4s", len(binary), b"BIN\0") + binary
    glb = struct.pack("<4sII", b"glTF", 2, 12 + len(body)) + body
    rows = documents.keyframes(spark.createDataFrame([("s", bytearray(glb))], "path string, content binary")).orderBy("key").collect()
    assert [(r["ts"], r["value"]) for r in rows] == [(0.0, [0.0, 0.0, 0.0]), (2.0, [10.0, 0.0, 0.0])]


@pytest.mark.parametrize("shape,spread", [((1, 1), 4.0), ((3, 5), 2.0), ((7, 7), 3.5), ((2, 40), 4.0), ((23, 9), 6.0)])
def test_distance_field_is_exact(spark, shape, spread):
    rng = np.random.default_rng(shape[1])
    grid = rng.random(shape) < 0.2
    rows = [("a", y, x, 200 if grid[y, x] else 10) for y in range(shape[0]) for x in range(shape[1])] + [("one", y, 0, 200) for y in range(3)]
    got = {(r["image_id"], r["y"], r["x"]): r["distance"] for r in image.distance_field(spark.createDataFrame(rows, "image_id string, y int, x int, v int"), "v", spread=spread).collect()}
    away = lambda y, x, side: min((np.hypot(y - b, x - a) for b, a in zip(*np.nonzero(grid == side), strict=True)), default=1e9)
    for y in range(shape[0]):
        for x in range(shape[1]):
            step = np.clip((away(y, x, True) - away(y, x, False)) / spread, -1, 1)
            assert got["a", y, x] == np.clip(np.rint(128 - 127 * step), 0, 255)
    assert {got["one", y, 0] for y in range(3)} == {255} and len(got) == len(rows)


def test_odd_mip_keeps_the_mean(spark):
    rows = [(1, y, x, float(y * 3 + x)) for y in range(3) for x in range(3)]
    p = spark.createDataFrame(rows, "image_id int, y int, x int, r double")
    sizes = spark.createDataFrame([(1, 3, 3)], "image_id int, width int, height int")
    (out,) = image.weighted_mip(p, sizes, ["r"]).collect()
    assert out["r"] == pytest.approx(4.0)


def test_stream_appends_and_totals(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text('{"tid":1,"name":"s","ph":"X","ts":-5,"dur":10,"depth":0}\n{"tid":1,"name":"old","ph":"X","ts":-9,"dur":3}\n{"tid":1,"name":"c","ph":"C","ts":-1,"value":3}\n')
    kept = traces.admitted(traces.arrivals(spark, str(source)), 0)
    traces.append(kept, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    rows = spark.read.json(str(tmp_path / "out")).collect()
    assert [(r["name"], r["ts"], r["dur"]) for r in rows] == [("s", 0, 5)]
    (source / "b.json").write_text('{"tid":2,"name":"s","ph":"X","ts":1,"dur":2}\n')
    traces.keep_totals(traces.admitted(traces.arrivals(spark, str(source)), 0), str(tmp_path / "t"), str(tmp_path / "ck2")).awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "t")).collect()] == [("s", 2, 7)]


def test_report_sink(spark, events, tmp_path):
    rows = events.groupBy("name").agg(F.sum(F.col("dur") * 1000).alias("us"), F.count("*").alias("n")).orderBy(F.desc("us")).limit(1)
    reports.write_text(reports.report_lines(rows, "Files", "us", "name", "n"), str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).count() == 2
    reports.write_events(events.select(F.lit("X").alias("ph"), "name", "ts", "dur"), str(tmp_path / "e"))
    assert spark.read.json(str(tmp_path / "e")).count() == 6


def test_block_codecs(spark):
    from gridweave.operators import codecs

    flat = np.zeros((5, 6, 4), np.uint8)
    flat[..., :] = (255, 0, 0, 255)
    assert (codecs.decode("BC1", codecs.ENCODERS["BC1"](flat), 6, 5) == flat).all()
    ramp = np.zeros((8, 8, 4), np.int64)
    ramp[..., 0], ramp[..., 1], ramp[..., 3] = np.arange(8) * 30, np.arange(8)[:, None] * 20, 255
    got = codecs.decode("BC5", codecs.ENCODERS["BC5"](ramp), 8, 8).astype(int)
    assert np.abs(got - ramp).max() <= 8
    half = np.random.default_rng(2).random((3, 2, 4)).astype(np.float16)
    assert (codecs.decode("EXPrgba16f", codecs.ENCODERS["EXPrgba16f"](half), 2, 3) == half.astype(np.float32)).all()
    data = containers.write_ktx2("BC1", 6, 5, [codecs.ENCODERS["BC1"](flat)], (), 3)
    rows = codecs.texture_pixels(spark.createDataFrame([("t", bytearray(data))], "path string, content binary"))
    assert rows.count() == 30 and rows.where("r <> 255 or g <> 0 or a <> 255").count() == 0
    with pytest.raises(ValueError):
        codecs.decode("ASTC4x4", b"", 4, 4)


def test_level_validation(spark):
    from gridweave.operators import textures

    rows = spark.createDataFrame([("a", "BC1", 8, 8, [(0, 32), (1, 8), (2, 8)]), ("b", "BC1", 8, 8, [(0, 31)])], "path string, format string, width int, height int, levels array<struct<mip:int,length:bigint>>")
    assert {r["path"]: r["valid"] for r in textures.valid_levels(textures.with_format(rows)).collect()} == {"a": True, "b": False}


def test_ancestors_of_deep_and_wide_trees(spark):
    chain = spark.range(150).selectExpr("id as node", "case when id > 0 then id - 1 end as parent")
    got = relations.ancestors(chain, "node", "parent")
    assert got.count() == got.distinct().count() == 150 * 149 // 2
    assert not got.where("node - ancestor <> steps").limit(1).count()
    n, depth = 120_000, lambda i: 0 if i == 0 else 1 + depth((i - 1) // 3)
    wide = spark.range(n).selectExpr("id as node", "case when id > 0 then (id - 1) div 3 end as parent")
    assert relations.ancestors(wide, "node", "parent").count() == sum(map(depth, range(n))) > 1_000_000


def test_ancestors_of_several_parents_and_cycles(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "node bigint, parent bigint")
    diamond = relations.ancestors(rows((1, None), (2, 1), (3, 1), (4, 2), (4, 3), (None, 4), (5, 99)), "node", "parent")
    named = sorted(map(tuple, diamond.where("node is not null").collect()))
    assert named == [(2, 1, 1), (3, 1, 1), (4, 1, 2), (4, 1, 2), (4, 2, 1), (4, 3, 1), (5, 99, 1)]
    assert sorted(map(tuple, diamond.where("node is null").select("ancestor", "steps").collect())) == [(1, 3), (1, 3), (2, 2), (3, 2), (4, 1)]
    assert not relations.ancestors(rows((1, None)), "node", "parent").count()
    for cycle in ([(7, 7)], [(1, 2), (2, 3), (3, 1), (4, 1)]):
        with pytest.raises(ValueError, match="cycle"):
            relations.ancestors(rows(*cycle), "node", "parent")


def test_hashes_of_a_batch(spark):
    def one(data):
        h = 0x811C9DC5
        for b in data.partition(b"\0")[0]:
            h = (h * 0x01000193 & 0xFFFFFFFF) ^ ((b - 256 if b > 127 else b) & 0xFFFFFFFF)
        return h

    texts = [b"", b"a", "é\u4e2d".encode(), b"longer text", b"cut\0here", b"zz"]
    assert hashing.fnv1(texts).tolist() == [one(t) for t in texts]


def test_names_of_any_length_collapse_in_time(spark):
    long = "a<" + "b," * 20_000 + "c<d>>::e<f>"
    names = ["vector<int>", "a<b<c>>::d<e>", "operator<", "a<b", "a>b<", "plain", long]
    table = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in table.select(strings.collapse_name(F.col("n"))).collect()]
    assert got == ["vector<$>", "a<$>::d<$>", "operator<", "a<b", "a>b<", "plain", "a<$>::e<$>"]


def test_odd_mips_keep_a_constant(spark):
    pixels = spark.createDataFrame([(i, y, x, 10) for i, n in ((1, 5), (2, 4), (3, 1)) for y in range(n) for x in range(n)], "image_id bigint, y int, x int, r int")
    got = image.box_mip(pixels, ["r"]).collect()
    assert {r["r"] for r in got} == {10} and {i: sum(r["image_id"] == i for r in got) for i in (1, 2, 3)} == {1: 4, 2: 4, 3: 1}


def test_bad_files_are_rows(spark):
    from gridweave.operators import codecs

    bad = spark.createDataFrame([("x", bytearray(b"no file")), ("y", bytearray(b"DDS short"))], "path string, content binary")
    for found in (containers.png_pixels(bad), codecs.texture_pixels(bad), containers.textures(bad), archives.zip_entries(bad)):
        assert [r["error"] is not None for r in found.collect()] == [True, True]


@pytest.mark.parametrize("color,channels", [(0, 1), (2, 3), (4, 2), (6, 4)])
def test_every_png_filter(color, channels):
    import zlib

    r = np.random.default_rng(color)
    grid = r.integers(0, 256, (6, 5, channels), dtype=np.uint8)
    rows, before = b"", np.zeros((5, channels), np.int64)
    for y, row in enumerate(grid.astype(np.int64)):
        left, corner = np.vstack((np.zeros((1, channels), np.int64), row[:-1])), np.vstack((np.zeros((1, channels), np.int64), before[:-1]))
        p = left + before - corner
        a, b, c = abs(p - left), abs(p - before), abs(p - corner)
        paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, before, corner))
        kind = y % 5
        rows += bytes([kind]) + ((row - [0 * row, left, before, (left + before) // 2, paeth][kind]) % 256).astype(np.uint8).tobytes()
        before = row
    chunk = lambda k, body: struct.pack(">I", len(body)) + k + body + struct.pack(">I", zlib.crc32(k + body))
    data = containers.PNG + chunk(b"IHDR", struct.pack(">2I5B", 5, 6, 8, color, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
    width, height, _, rgba = containers.read_png(data)
    got = np.frombuffer(rgba, np.uint8).reshape(height, width, 4)
    want = np.full((6, 5, 4), 255, np.uint8)
    want[..., :3] = grid[..., :3] if channels > 2 else grid[..., :1]
    if channels in (2, 4):
        want[..., 3] = grid[..., -1]
    assert (width, height) == (5, 6) and (got == want).all()


def test_scratch_tables_belong_to_their_call(spark):
    import threading

    from gridweave import scratch

    df = spark.range(3)
    with scratch.scope():
        inner = scratch.materialise(df, "inner")
        assert inner.count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FILE_NOT_EXIST|FileNotFound"):
        inner.collect()
    held = {}

    def pipeline(name):
        with scratch.stage_tables(first=True):
            held[name] = scratch.materialise(df, name)
        barrier.wait()
        with scratch.stage_tables():  # drops this thread's stage before, no other one
            pass
        barrier.wait()

    def other():
        with scratch.stage_tables(first=True):
            held["other"] = scratch.materialise(df, "other")
        barrier.wait()
        barrier.wait()

    barrier = threading.Barrier(2)
    threads = [threading.Thread(target=pipeline, args=("one",)), threading.Thread(target=other)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert held["other"].count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FILE_NOT_EXIST|FileNotFound"):
        held["one"].collect()


def test_a_cluster_needs_a_shared_folder():
    from gridweave import scratch

    class Context:
        def __init__(self, master):
            self.master, self.set = master, None

        def getCheckpointDir(self):
            return None

        def setCheckpointDir(self, path):
            self.set = path

    class Session:
        class conf:
            @staticmethod
            def get(key, default):
                return default

        def __init__(self, master):
            self.sparkContext = Context(master)

    assert scratch.shared_dir(Session("local[4]")).startswith("file:///")
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            scratch.shared_dir(Session(master))


def test_ancestors_have_no_cap(spark):
    chain = spark.range(150).selectExpr("id as node", "case when id > 0 then id - 1 end as parent")
    got = relations.ancestors(chain, "node", "parent")
    assert got.count() == 150 * 149 // 2 and got.agg(F.max("steps")).first()[0] == 149
    loop = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "node bigint, parent bigint")
    with pytest.raises(ValueError, match="cycle"):
        relations.ancestors(loop, "node", "parent")


def test_a_long_gap_between_keys_is_one_row(spark):
    keys = spark.createDataFrame([("a", 0, 0.0), ("a", 10**12, 1.0), ("b", 5, 2.0)], "channel string, ts bigint, value double")
    asked = spark.createDataFrame([("a", 5 * 10**11), ("a", 10**12), ("a", 10**12 + 1), ("a", 0), ("b", 4), ("b", 5), ("c", 1)], "channel string, t bigint")
    got = sorted((r["channel"], r["t"], r["value"]) for r in relations.between_keys(asked, keys, "channel", 10.0).collect())
    assert got == [("a", 0, 0.0), ("a", 5 * 10**11, 0.5), ("a", 10**12, 1.0), ("b", 5, 2.0)]


def test_ranges_of_large_documents(spark, tmp_path):
    """One document by ranges equals the whole; strings are left alone; bad records are told apart."""
    r = random.Random(1)
    texts = ["f(a, ]b, }c", 'x"y', "back\\", '\\"', "}}}{{", "é日", "plain", ", ]", ", }", '"traceEvents":[']
    made = [{"name": t * r.choice([1, 1, 5, 30]), "ph": "X", "ts": i, "dur": 1, "args": r.choice([{"detail": t}, {}])} for i, t in ((i, r.choice(texts)) for i in range(1200))]
    text = '{"other":[{"name":"no"}],"meta":{"x":"no"}, "traceEvents" : [' + ",".join(json.dumps(e, ensure_ascii=False) for e in made) + ',\n],"tail":[{"name":"not this"}],"beginningOfTime":5}'
    (tmp_path / "a.json").write_text(text)
    (tmp_path / "array.json").write_text(" [" + ",\n".join(json.dumps(e) for e in made[:50]) + "]")
    with gzip.open(tmp_path / "c.json.gz", "wt") as f:
        f.write(text)
    (tmp_path / "torn.json").write_text(text[: len(text) * 2 // 3])
    (tmp_path / "bad.json").write_text('{"traceEvents":[{"name":"a","ph":"X"},{"name":"b" "ph"},3,[1,{"name":"deep"}],{"name":"c","ts":"x"},{"name":"d","ph":"M"}]}')
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "none.json").write_text('{"a":1,"b":[{"name":"x"}]}')
    (tmp_path / "inner.json").write_text('{"meta":{"traceEvents":[{"name":"no"}]},"x":[{"traceEvents":[{"name":"no"}]}],"s":"\\"traceEvents\\":[{}","traceEvents":[' + ",".join(json.dumps(e) for e in made[:300]) + "]}")
    (tmp_path / "late.json").write_text('{"o":[' + ",".join('{"name":"}"}' for _ in range(3000)) + '],"traceEvents":[' + ",".join(json.dumps(e) for e in made[:9]) + "]}")
    for size in (None, 9000):
        got = {}
        for row in documents.trace_events(spark, str(tmp_path), "bad", size).collect():
            got.setdefault(row["path"].rsplit("/", 1)[1], []).append(row)
        for own in got.values():
            own.sort(key=lambda x: x["event_id"])
        for name, n in (("a.json", 1200), ("array.json", 50), ("c.json.gz", 1200), ("late.json", 9), ("inner.json", 300)):
            assert [(x["event_id"], x["name"], x["args"], x["bad"]) for x in got[name]] == [(k, e["name"], e["args"], None) for k, e in enumerate(made[:n])], (size, name)
        torn = got["torn.json"]
        assert [x["name"] for x in torn[:-1]] == [e["name"] for e in made[: len(torn) - 1]] and torn[-1]["bad"] and len(torn) > 600
        assert [(x["name"], x["bad"] is not None) for x in got["bad.json"]] == [("a", False), (got["bad.json"][1]["name"], True), (got["bad.json"][2]["name"], True), ("d", False)]
        assert set(got) == {"a.json", "array.json", "c.json.gz", "late.json", "inner.json", "torn.json", "bad.json"}
    assert documents.trace_events(spark, str(tmp_path / "bad.json")).count() == 2


def test_committed_documents(spark, tmp_path):
    from gridweave.sinks import committed

    rows = [(f"f/{i % 3}" if i % 5 else None, i % 4, "X", (i * 7) % 50, 1, f'n"{i}') for i in range(500)]
    table = spark.createDataFrame(rows, "file string, tid bigint, ph string, ts bigint, dur bigint, name string").repartition(4)
    for compress in (True, False):
        path = tmp_path / f"out{compress}"
        assert committed.write_documents(table, str(path), "file", gzip=compress) == 500
        read = lambda p: json.loads((gzip.open if compress else open)(p, "rt").read())["traceEvents"]
        got = {p.name.split(".")[0]: read(p) for p in path.iterdir() if not p.name.startswith(".")}
        assert set(got) == {"f%2F0", "f%2F1", "f%2F2", "%null"}
        assert sorted(e["name"] for own in got.values() for e in own) == sorted(r[5] for r in rows)
        assert all([e["ts"] for e in own] == sorted(e["ts"] for e in own) for own in got.values())
        assert documents.trace_events(spark, str(path)).count() == 500
    with pytest.raises(FileExistsError):
        committed.write_documents(table, str(path))
    assert committed.write_documents(table.limit(7), str(path), overwrite=True) == 7 and documents.trace_events(spark, str(path)).count() == 7
    assert committed.write_documents(table.limit(0), str(tmp_path / "nothing")) == 0 and not list((tmp_path / "nothing").iterdir())
    broken = table.withColumn("name", F.when(F.col("ts") == 33, F.raise_error(F.lit("lost"))).otherwise(F.col("name")))
    before = sorted(p.name for p in tmp_path.iterdir())
    with pytest.raises(Exception, match="lost"):
        committed.write_documents(broken, str(tmp_path / "failed"), "file")
    assert sorted(p.name for p in tmp_path.iterdir()) == before


def test_large_documents_come_from_many_tasks(spark, tmp_path, monkeypatch):
    from gridweave.sinks import committed

    table = spark.range(4000).selectExpr("'X' ph", "id % 3 tid", "id ts", "1L dur", "concat('n ]', id, ', }') name")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        committed.write_documents(table, str(tmp_path / "one"), gzip=False)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    found = documents.trace_events(spark, str(tmp_path / "one"), range_bytes=40_000)
    assert found.orderBy("event_id").select("name").collect() == table.orderBy("ts").select("name").collect()
    pieces = spark.read.text(str(tmp_path / "one"), lineSep="}")
    assert found.select("event_id").distinct().count() == 4000 and pieces.count() >= 4000


@pytest.mark.parametrize("most", [5, 1_000_000])
def test_running_sums_of_hot_groups(spark, most):
    r = random.Random(most)
    rows = [(r.choice(["hot", "hot", "hot", None, "b"]), k, r.choice([None, 1, 2, 5, -3])) for k in range(500)]
    got = relations.running_sums(spark.createDataFrame(rows, "g string, k int, v bigint").repartition(7), ["g"], ["k"], "v", "sum", most)
    now, want = {}, set()
    for g, k, v in rows:
        want.add((g, k, v, now.get(g, 0)))
        now[g] = now.get(g, 0) + (v or 0)
    found = [tuple(x) for x in got.collect()]
    assert set(found) == want and len(found) == 500 and got.columns == ["g", "k", "v", "sum"]
    assert relations.running_sums(spark.createDataFrame([], "g string, k int, v bigint"), ["g"], ["k"], "v", "sum", most).count() == 0


def test_counters_are_observed(spark, tmp_path):
    rows = spark.range(100)
    seen = relations.counted(rows, {"even": F.col("id") % 2 == 0, "none": F.col("id") < 0}, lambda x: x.write.parquet(str(tmp_path / "x")))
    assert seen == {"even": 50, "none": 0} and spark.read.parquet(str(tmp_path / "x")).count() == 100


def test_refresh_reads_what_changed(spark, tmp_path):
    from gridweave.operators import incremental

    read, store = [], str(tmp_path / "store")
    content = {f"f{k}": [("a", k), ("b", 1)] for k in range(20)} | {"empty": []}
    stamps = dict.fromkeys(content, "2024-01-01 00:00:00")

    def reader(paths):
        read.append(sorted(paths))
        return spark.createDataFrame([(p, n, d) for p in paths for n, d in content[p]], "path string, name string, dur bigint")

    files = lambda: spark.createDataFrame(list(stamps.items()), "path string, t string").selectExpr("path", "cast(t as timestamp) as modified")
    result = lambda: {r["name"]: (r["count"], r["duration"]) for r in incremental.report(spark, store).collect()}
    full = lambda: {n: (sum(x == n for own in content.values() for x, _ in own), sum(d for own in content.values() for x, d in own if x == n)) for n in {x for own in content.values() for x, _ in own}}
    assert incremental.refresh(files(), store, reader) == {"changed": 21, "gone": 0} and result() == full()
    assert incremental.refresh(files(), store, reader) == {"changed": 0, "gone": 0} and len(read) == 1
    content["f3"], stamps["f3"] = [("a", 1000), ("c", 5)], "2024-01-02 00:00:00"
    del content["f4"], stamps["f4"]
    content["new"], stamps["new"] = [("a", 7)], "2024-01-02 00:00:00"
    assert incremental.refresh(files(), store, reader) == {"changed": 2, "gone": 1} and read[1:] == [["f3", "new"]] and result() == full()
    content["f4"], stamps["f4"] = [("b", 9)], "2024-01-01 00:00:00"  # back again
    content["f5"], stamps["f5"] = [], "2024-01-03 00:00:00"
    assert incremental.refresh(files(), store, reader)["changed"] == 2 and read[2] == ["f4", "f5"] and result() == full()


def test_table_functions(spark):
    from gridweave.sources import table_functions

    table_functions.register(spark)
    docs = ['{"rows":[{"a":1,"b":"x"},3,{"a":"no","b":{"c":[1]},"d":true},{}]}', "[1]", "not json", None, '{"rows":5}']
    spark.createDataFrame([(k, d) for k, d in enumerate(docs)], "k int, d string").createOrReplaceTempView("docs")
    got = [tuple(r) for r in spark.sql("SELECT docs.k, r.* FROM docs, LATERAL document_rows(docs.d, 'rows', 'a bigint, b string, d boolean') r ORDER BY 1, 2").collect()]
    assert got == [(0, 0, 1, "x", None), (0, 2, None, '{"c":[1]}', True), (0, 3, None, None, None)]
    with pytest.raises(Exception, match="fields are"):
        spark.sql("SELECT * FROM document_rows('{}', 'rows', 'a int')").collect()


def test_track_numbers_go_on_after_a_restart(spark, tmp_path):
    source, out, log = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "log")
    source.mkdir()
    write = lambda k, names: (source / f"{k}.json").write_text("\n".join(json.dumps({"thread": n, "p": p}) for p, n in names))
    run = lambda: traces.track_ids(traces.arrivals(spark, str(source), "thread string, p string"), out, log, process="p").awaitTermination()
    found = lambda: {(r["process"], r["thread"]): r["tid"] for r in spark.read.parquet(out).collect()}
    write(1, [("x", "main"), ("x", "worker"), ("y", "main"), ("x", "main"), ("x", None)])
    run()
    first = found()
    assert first == {("x", "main"): 1, ("x", "worker"): 2, ("y", "main"): 1}
    write(2, [("x", "alpha"), ("x", "main"), ("y", "zeta"), ("y", "beta")])
    run()
    assert found() == first | {("x", "alpha"): 3, ("y", "beta"): 2, ("y", "zeta"): 3} and spark.read.parquet(out).count() == 6
    write(3, [("x", "main")])
    run()
    assert spark.read.parquet(out).count() == 6


def test_subtrees(spark):
    from gridweave.operators import forest

    r = random.Random(4)
    links = [(k, r.choice([None, r.randrange(k) if k else None, k - 1 if k else None, 9999])) for k in range(150)]
    values = [(k, r.randrange(-50, 50)) for k in range(150) if k % 5]
    up = dict(links)
    below = {k: set() for k in up}
    for k in up:
        at = k
        while at in up:
            below[at].add(k)
            at = up[at]
    found = forest.intervals(spark.createDataFrame(links, "n int, p int"), "n", "p")
    spans = {x["node"]: (x["first"], x["last"]) for x in found.collect()}
    assert sorted(a for a, _ in spans.values()) == list(range(150))
    assert all({m for m in spans if a <= spans[m][0] <= b} == below[k] for k, (a, b) in spans.items())
    got = forest.over_subtrees(found, spark.createDataFrame(values, "n int, v bigint"), "n", {"low": ("min", "v"), "high": ("max", "v"), "all": ("sum", "v")})
    own = dict(values)
    want = {k: [own[m] for m in below[k] if m in own] for k in up}
    assert {x["node"]: (x["low"], x["high"], x["all"]) for x in got.collect()} == {k: (min(v), max(v), sum(v)) for k, v in want.items() if v}
    with pytest.raises(ValueError, match="cycle"):
        forest.intervals(spark.createDataFrame([(1, 2), (2, 1), (3, None)], "n int, p int"), "n", "p")


def test_rounds_over_subtrees_follow_the_depth(spark, monkeypatch):
    """F8, F11: a flat forest takes few written tables, however many nodes it has, and a product of matrices is short enough to be compiled."""
    from gridweave.operators import forest

    labels, write = [], forest.materialise
    monkeypatch.setattr(forest, "materialise", lambda df, label: labels.append(label) or write(df, label))
    found = forest.intervals(spark.range(500).selectExpr("id n", "case when id % 100 > 0 then id - id % 100 end p"), "n", "p")
    assert {tuple(x) for x in found.collect()} == {(k, k, k if k % 100 else k + 99) for k in range(500)}
    assert len(labels) <= 6
    assert len(str(vectors.multiply(F.col("a"), F.col("b"), 4))) < 4000


def test_codecs_of_many_images_at_once(spark):
    from gridweave.operators import codecs

    r = np.random.default_rng(5)
    grids = [r.integers(0, 256, (h, w, 4), dtype=np.uint8) for h, w in ((5, 6), (5, 6), (4, 4), (5, 6), (1, 3))]
    for name in ("BC1", "BC4", "BC5", "EXPrg8", "EXPrgba8"):
        assert codecs.encode_all(name, grids) == [codecs.ENCODERS[name](g) for g in grids]
        parts = [(name, codecs.ENCODERS[name](g), g.shape[1], g.shape[0]) for g in grids]
        parts[1] = (name, parts[1][1][:-1], *parts[1][2:])
        for part, got in zip(parts, codecs.decode_all(parts), strict=True):
            assert isinstance(got, ValueError) if part is parts[1] else (got == codecs.decode(*part)).all()


def test_small_textures_share_frames():
    """A frame for each file took more time than its pixels."""
    import pandas as pd

    from gridweave.operators import codecs

    files = [containers.write_ktx2("EXPr8", 3, 2, [bytes([k % 256] * 6)]) for k in range(500)]
    frames = list(codecs._pixels(0)([pd.DataFrame({"path": [*map(str, range(500)), "bad"], "content": [*files, b"no file"]})]))
    assert len(frames) == 1 and len(frames[0]) == 3001 and frames[0]["error"].notna().sum() == 1
    assert (frames[0]["r"][:3000] == np.repeat(np.arange(500) % 256, 6)).all() and frames[0]["y"][3000:].isna().all()


def test_documents_hold_several_tracks(spark):
    """A document for each track made as many files as tracks; the number of documents follows the rows."""
    from gridweave.plans import file_queries

    rows = spark.range(0, 200_000, 1, 4)
    n = rows.select(file_queries.shares(rows, "id").alias("p")).distinct().count()
    assert n == file_queries.FEWEST
    assert spark.range(1000).select(file_queries.shares(spark.range(30 * file_queries.SHARE), "id").alias("p")).distinct().count() == 30


def test_small_images_share_batches():
    """A frame for each image took more time than its pixels."""
    import pyarrow as pa

    files = [containers.write_png(2, 3, bytes([k] * 24)) for k in range(200)]
    frames = list(containers._pixels([pa.RecordBatch.from_pydict({"path": [*map(str, range(200)), "bad"], "content": [*files, b"no file"]})]))
    assert len(frames) == 1 and frames[0].num_rows == 1201 and frames[0].column("error").null_count == 1200
    assert frames[0].column("r").to_pylist() == [k for k in range(200) for _ in range(6)] + [None]


def test_images_over_several_batches(spark):
    """A null key is an image too; one of more pixels than a batch of rows holds is one file."""
    big = spark.range(150 * 150).selectExpr("'big' as path", "cast(id div 150 as int) as y", "cast(id % 150 as int) as x")
    small = spark.createDataFrame([(None, 0, 0), ("a", 1, 1)], "path string, y int, x int")
    pixels = big.unionByName(small).selectExpr("*", "x as r", "y as g", "7 as b", "255 as a")
    files = containers.png_files(pixels)
    sizes = {r["path"]: containers.read_png(bytes(r["content"]))[:2] for r in files.collect()}
    assert sizes == {"big": (150, 150), None: (1, 1), "a": (2, 2)}
    assert containers.png_pixels(files).where("path = 'big' and (r <> x or g <> y or b <> 7 or a <> 255)").count() == 0


def test_odd_mips_join_no_grid(spark):
    """A grid of nine sources for each cell, joined with the pixels by place, took GBs of a task's memory; cells are summed from the pixels themselves."""
    r = np.random.default_rng(3)
    grids = {k: r.integers(0, 256, hw) for k, hw in enumerate([(5, 7), (3, 4), (1, 6), (9, 1), (2, 2)])}
    pixels = spark.createDataFrame([(k, y, x, int(g[y, x])) for k, g in grids.items() for y in range(g.shape[0]) for x in range(g.shape[1])] + [(0, 5, 0, 99)], "image_id int, y int, x int, r int")
    sizes = spark.createDataFrame([(k, g.shape[1], g.shape[0]) for k, g in grids.items()], "image_id int, width int, height int")

    def matrix(n):
        m = n // 2
        if n == 1:
            return np.ones((1, 1))
        out = np.zeros((m, n))
        for o in range(m):
            out[o, 2 * o : 2 * o + (2 if n % 2 == 0 else 3)] = 0.5 if n % 2 == 0 else np.array([m - o, m, o + 1]) / n
        return out

    want = {k: matrix(g.shape[0]) @ g @ matrix(g.shape[1]).T for k, g in grids.items()}
    found = image.weighted_mip(pixels, sizes, ["r"])
    got = found.collect()
    assert len(got) == sum(w.size for w in want.values()) and all(abs(x["r"] - want[x["image_id"]][x["y"], x["x"]]) < 1e-9 for x in got)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    keys = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert "image_id" in keys[0] and " AND " not in keys[0].replace("isnotnull", "")


@pytest.mark.parametrize("compress", [True, False])
def test_documents_of_a_task_are_whole_at_once(spark, tmp_path, monkeypatch, compress):
    """of many small documents only those at a task's ends are put together from members, and the first pass of the reader opens none."""
    from gridweave.sinks import committed
    from gridweave.sources import ranges

    tables, write = {}, committed.materialise
    keep = lambda df, label: tables.setdefault(label, write(df, label))
    monkeypatch.setattr(committed, "materialise", keep)
    monkeypatch.setattr(ranges, "materialise", keep)
    table = spark.range(3000).selectExpr("'X' ph", "id % 300 file", "id ts", "1L dur", "concat('n ]', id) name")
    path = tmp_path / "out"
    assert committed.write_documents(table, str(path), "file", gzip=compress) == 3000
    got = {p.name.split(".")[0]: json.loads((gzip.open if compress else open)(p, "rt").read())["traceEvents"] for p in path.iterdir() if not p.name.startswith(".")}
    assert {k: [e["ts"] for e in v] for k, v in got.items()} == {str(k): list(range(k, 3000, 300)) for k in range(300)}
    assert tables["members"].where("member is not null").count() <= 8 and tables["members"].count() >= 300
    assert documents.trace_events(spark, str(path)).count() == 3000
    assert not tables["sums"].count()


def test_small_ranges_share_tasks(spark, tmp_path, monkeypatch):
    """tasks grow with the bytes, not with the number of small ranges."""
    from gridweave.sinks import committed
    from gridweave.sources import ranges

    files, write = [], ranges.materialise

    def counted(df, label):
        found = write(df, label)
        files.append((label, len(found.inputFiles())))
        return found

    table = spark.range(4000).selectExpr("'X' ph", "id % 3 tid", "id ts", "1L dur", "concat('n ]', id, ', }') name")
    committed.write_documents(table, str(tmp_path / "one"), gzip=False)
    monkeypatch.setattr(ranges, "materialise", counted)
    found = documents.trace_events(spark, str(tmp_path / "one"), range_bytes=4_000)
    assert found.orderBy("event_id").select("name").collect() == table.orderBy("ts").select("name").collect()
    assert 0 < dict(files)["objects"] <= ranges.WAVES * spark.sparkContext.defaultParallelism + 1


def test_sweep_has_few_rows_in_hand():
    """a chunk is swept in slices, so Python's objects don't grow with it; what is open goes on from slice to slice."""
    import pyarrow as pa

    from gridweave.operators import nesting

    n = 3 * nesting.SLICE + 7
    ints = lambda values: pa.array(list(values), pa.int64())
    table = pa.table({"t": ints([0] * n), "x": ints(range(n)), "id": ints(range(n)), "end": ints(range(2 * n, n, -1)), "step": pa.nulls(n, pa.string())})
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    batch = pa.RecordBatch.from_arrays([pa.array([out.getvalue().to_pybytes()] * 2, pa.binary()), pa.nulls(2, pa.list_(pa.struct(nesting._OPEN)))], ["rows", "inherited"])
    found = list(nesting._swept(nesting.Shape(1, 2, 0, 0))(iter([batch])))
    assert max(map(len, found)) <= nesting.SLICE
    assert [x for b in found for x in b.column(2).to_pylist()] == 2 * [None, *range(n - 1)]
    assert [x for b in found for x in b.column(3).to_pylist()] == 2 * list(range(n))

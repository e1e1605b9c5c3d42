"""Stages that drop rows decide by row, where ids repeat or are null."""

import collections

import pytest

import corpus_pipeline
from gridweave.llm import exact_dedup, near_dedup

SCHEMA = "doc_id bigint, text string, __row string"
TEXT = {c: " ".join(f"{c}{k}" for k in range(60)) for c in "abcdef"}


def of(rows):
    return collections.Counter((r["doc_id"], r["text"]) for r in rows.collect())


@pytest.fixture(scope="module")
def docs(spark):
    a, b, c, d, e, f = TEXT.values()
    rows = [(1, a), (1, a), (2, a), (2, b), (3, b), (None, c), (None, c), (4, d), (None, d), (None, e + " x"), (None, e), (5, f), (6, None), (6, None), (7, f + " y")]
    return spark.createDataFrame([(i, t, "own") for i, t in rows], SCHEMA).repartition(3)


def test_exact(docs):
    t = TEXT
    got = exact_dedup.dedup(docs)
    assert got.columns == docs.columns
    want = [(1, t["a"]), (2, t["b"]), (None, t["c"]), (4, t["d"]), (None, t["e"] + " x"), (None, t["e"]), (5, t["f"]), (6, None), (7, t["f"] + " y")]
    assert of(got) == collections.Counter(want)


def test_near(docs):
    t = TEXT
    got = near_dedup.dedup(docs)
    assert got.columns == docs.columns
    kept = of(got)
    loose = kept.pop((None, t["e"]), 0) + kept.pop((None, t["e"] + " x"), 0)
    assert loose == 1 and kept == collections.Counter([(1, t["a"]), (2, t["b"]), (None, t["c"]), (4, t["d"]), (5, t["f"]), (6, None), (6, None)])


def test_decontamination(spark, docs, tmp_path):
    items = [(1, TEXT["a"][:60]), (2, TEXT["c"])]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.decontamination_stage(spark, docs, str(tmp_path))
    want = [(r["doc_id"], r["text"]) for r in docs.collect() if r["text"] not in (TEXT["a"], TEXT["c"])]
    assert got.columns == docs.columns and of(got) == collections.Counter(want)


def test_heavy_digests_are_found(spark):
    from gridweave.llm.heavy import heavy_hashes

    rows = spark.createDataFrame([(bytes([7]) if i % 3 == 0 else i.to_bytes(4, "big"),) for i in range(3000)], "digest binary").repartition(4)
    found = {r["h"] for r in heavy_hashes(rows, "digest", "h", 0.01).collect()}
    assert len(found) <= 100 and rows.where("digest = X'07'").selectExpr("xxhash64(digest) h").first()["h"] in found


def test_language_rejects_what_it_cannot_tell(spark):
    """Where labels are noise, calibrated scores are near 1/4 and the stage drops texts; where they are not, it keeps them."""
    import random

    r = random.Random(1)
    words = {"en": "the and that with from", "de": "der und das nicht ein", "fr": "le et que dans une", "es": "el y que los por"}
    noise = " ".join(words.values()).split()
    clean = [(i, " ".join(r.choice(words[k].split()) for _ in range(30)), k) for i, k in enumerate(list(words) * 60)]
    mixed = [(i, " ".join(r.choice(noise) for _ in range(30)), k) for i, k in enumerate(list(words) * 60)]
    of = lambda rows: corpus_pipeline.language_stage(spark, spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), "")
    assert of(clean).count() > 230
    assert of(mixed).count() < 120

"""The pipeline's stages, one after another, against brute force on the smallest table."""

import os
import re

import pytest

import corpus_pipeline
from gridweave.llm._common import materialise

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def test_stages(spark):
    first = spark.read.parquet(f"{SF}/documents.parquet")
    docs, kept = first, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF), f"test-{name}", pinned=True)
        kept[name] = docs
        if name != "pack":
            assert docs.columns == first.columns
    texts = {r["doc_id"]: r["text"] for r in first.collect()}
    ids = {name: {r["doc_id"] for r in df.select("doc_id").collect()} for name, df in kept.items()}
    assert ids["language"] == {i for i, t in texts.items() if t and any(c.isalpha() for c in t)}
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t)
    first_of = {}
    for i in sorted(ids["language"]):
        first_of.setdefault(norm(texts[i]), i)
    assert ids["exact"] == set(first_of.values())
    lower = lambda t: t.translate({c: c + 32 for c in range(65, 91)})
    sets = {}
    for i in ids["exact"]:
        w = [x for x in re.split("[\x20\x09-\x0d]+", lower(texts[i])) if x]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    comp = {i: i for i in sets}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    for _ in range(len(pairs) + 1):
        for a, b in pairs:
            comp[a] = comp[b] = min(comp[a], comp[b])
    assert ids["near"] == {i for i in comp if comp[i] == i}
    split = lambda t: " " + " ".join(w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t)) if w) + " "
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = split(r["text"]).split()
        windows |= {" " + " ".join(w[k : k + 10]) + " " for k in range(max(1, len(w) - 9))}
    assert ids["decontaminate"] == {i for i in ids["near"] if not any(x in split(texts[i]) for x in windows)}
    assert ids["pack"] == ids["decontaminate"]


def test_other_operators_drop_the_encoders():
    """What tokenizing keeps in a worker process is not held beside the work of a later stage's tasks."""
    from types import SimpleNamespace

    import public_tokenizers

    from gridweave.llm import language, near_dedup, tokenizing

    for run in (language._predictor(SimpleNamespace(value=None), ()), near_dedup._signer(5, 64), near_dedup._verifier(85)):
        tokenizing.encoder(public_tokenizers.path(corpus_pipeline.TOKENIZER)).encode("some words")
        assert tokenizing.encoder.cache_info().currsize == 1
        list(run(iter([])))
        assert tokenizing.encoder.cache_info().currsize == 0


def test_all_stages_tidy_their_worker():
    """Tasks of near and decontaminate that come after a pack, or beside an idle worker that has packed, hold none of its caches either."""
    from types import SimpleNamespace

    import public_tokenizers

    from gridweave.llm import decontamination, near_dedup, tokenizing
    from gridweave.llm._common import tidied

    for run in (near_dedup._set_writer(5), decontamination._query(SimpleNamespace(value=None), 10), tidied(iter)):
        tokenizing.encoder(public_tokenizers.path(corpus_pipeline.TOKENIZER)).encode("some words")
        list(run(iter([])))
        assert tokenizing.encoder.cache_info().currsize == 0


def test_packing_takes_small_batches(spark, monkeypatch):
    """Long texts reach a packing task a few MB at a time, not 10,000 at once."""
    from gridweave.llm import packing

    capacity = packing.CAPACITY

    def leaves(*_):
        def run(batches):
            import pyarrow as pa

            for k, batch in enumerate(batches):  # a full sequence for each batch, that starts at the batch's size
                row = {"doc_id": k, "piece": 0, "start": batch.nbytes, "length": capacity, "ids_crc32": 0, "bin": k, "offset": 0, "fill": capacity}
                yield pa.RecordBatch.from_pylist([row], pa.schema([(n, pa.int32() if n == "piece" else pa.int64()) for n in row]))

        return run

    monkeypatch.setattr(packing, "_leaves", leaves)
    docs = spark.range(0, 300, 1, 1).selectExpr("id AS doc_id", "repeat('some words ', 9000) AS text")
    sizes = [r["start"] for r in packing.pack(docs, "").collect()]
    assert sum(sizes) > 25 << 20 and max(sizes) < 2 * packing.BATCH

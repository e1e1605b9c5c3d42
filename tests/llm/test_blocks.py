"""Blocks of test items stay below their bound, however often an item is repeated."""

from gridweave.llm import decontamination


def test_repeated_items(spark, monkeypatch):
    text = " ".join(f"w{k}" for k in range(20))
    items = [(1, text)] * 200 + [(k, f"other{k} words") for k in range(2, 12)] + [(99, "long " * 200)]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "x " + text + " y"), (2, "other5 words"), (3, None)], "doc_id bigint, text string")
    blocks, begin = [], decontamination.Items.__init__
    monkeypatch.setattr(decontamination.Items, "__init__", lambda self, block: blocks.append(block) or begin(self, block))
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 400)
    found = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontamination.contamination(docs, table).collect()}
    assert found == {1: (22, 20, ["1"]), 2: (2, 2, ["5"]), 3: (0, 0, [])}
    assert all(len(b) == 1 or sum(len(t) + len(i) + 16 for i, t in b) <= 400 for b in blocks)
    assert sum(map(len, blocks)) == 12


def test_a_broadcast_is_as_large_as_it_says():
    import pickle

    items = [(f"item{k}", "a b cd efg " * 300) for k in range(200)] + [("none", ""), ("one", "word")]
    packed = decontamination.Items(items)
    assert len(pickle.dumps(packed)) <= 4 * sum(len(t) for _, t in items) + sum(len(n) + 20 for n, _ in items) + 1000
    found = [(int(i), tuple(w)) for of, words in packed.windows(10, 77) for i, w in zip(of, words.tolist(), strict=True)]
    lex = decontamination.lexer()
    want = []
    for k, (_, text) in enumerate(items):
        w = lex.words([text.encode()])[4].tolist()
        n = min(10, len(w))
        want += [(k, tuple(w[i : i + n])) for i in range(len(w) - n + 1)] if n else []
    assert sorted(found) == sorted(want)

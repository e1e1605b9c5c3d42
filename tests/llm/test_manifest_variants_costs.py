"""The manifest, spelling variants and cost-balanced packing against brute force, and on hard inputs."""

import collections
import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridweave.llm import cost_packing, merkle, variants

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, leaf string, tree string, word string, n string, ids string"


def make(spark, rows):
    """Documents (doc_id, text, lang, source, n_chars) with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, "l", "t", "w", "n", "i") for r in rows], SCHEMA)


# --- manifest


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def up(nodes, k):
    """(root, siblings, sides) of node k, by recursion."""
    if len(nodes) == 1:
        return nodes[0], [], []
    other = k ^ 1
    root, above, sides = up([h(nodes[i : i + 2]) for i in range(0, len(nodes), 2)], k // 2)
    return root, ([nodes[other]] if other < len(nodes) else []) + above, [(k & 1, nodes[other] if other < len(nodes) else "")] + sides


def brute(rows):
    leaf = lambda i, t, lang, s, n: h(map(field, (i, s, lang, n, t)))
    groups = collections.defaultdict(list)
    for r in rows:
        bad = r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
        groups[r[2]].append((r[0], leaf(*r), leaf(*r[:4], r[4] + 1) if bad else leaf(*r)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    subs = [up([x[1] for x in groups[g]], 0)[0] for g in order]
    out = []
    for place, g in enumerate(order):
        root, above, over = up(subs, place)
        for k, (i, leaf_of, other) in enumerate(groups[g]):
            sub, own, sides = up([x[1] for x in groups[g]], k)
            for side, sibling in sides + over:
                other = h([sibling, other] if side else [other, sibling])
            out.append((i, leaf_of, sub, root, h(own + above), other, other == root))
    return out


def documents(n, langs, seed=3):
    r = random.Random(seed)
    rows = [(r.randrange(n * 2), r.choice(["x" * r.randrange(9), None, "été \n", ""]), r.choice(langs), r.choice(["s", None]), r.choice([5, None, 0, -1])) for _ in range(n)]
    return rows + [rows[0]] * 3 + [(None, "t", langs[0], None, 1), (None, None, None, None, None)]


CASES = [(150, ["en", "fr", None], 12, 16384), (150, ["en", "fr", "é", "z"], 2, 5), (90, [f"l{k}" for k in range(23)] + [None], 1, 3), (70, ["en"], 2, 4), (1, ["a"], 3, 1)]


@pytest.mark.parametrize("n,langs,block,top", CASES)
def test_manifest(spark, n, langs, block, top):
    rows = documents(n, langs)
    docs = make(spark, rows).repartition(5)
    bad = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    changed = {"n_chars": F.when(bad, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    got = merkle.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", changed, block=block, top=top)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(brute(rows))


def test_small_manifests(spark):
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    assert merkle.manifest(make(spark, []), fields, "lang", "doc_id").count() == 0
    one = merkle.manifest(make(spark, [(3, "t" * 70_000, None, None, None)]), fields, "lang", "doc_id").collect()
    assert [tuple(r) for r in one] == brute([(3, "t" * 70_000, None, None, None)]) and one[0]["proof_sha256"] == hashlib.sha256(b"").hexdigest()


def test_manifest_finds_changes(spark):
    """A change of any field of any row shows in its own verification."""
    rows = [(k, f"text {k}", "en", "s", k) for k in range(40)]
    for f, value in (("text", F.lit("other")), ("source", F.lit(None).cast("string")), ("lang", F.concat("lang", F.lit("x")))):
        got = merkle.manifest(make(spark, rows), ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", {f: F.when(F.col("doc_id") == 17, value).otherwise(F.col(f))}, block=2, top=4)
        assert {r["doc_id"] for r in got.collect() if not r["verified"]} == {17}


# --- spelling variants


def words_of(rows):
    n = collections.Counter()
    for i, t, *_ in rows:
        run = ""
        for c in (t or "") + " ":
            if c.isascii() and c.isalpha() or 0xC0 <= ord(c) <= 0xFF:
                run += c.lower() if c.isascii() else c
                continue
            if run:
                x = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                at = x % len(run)
                n[run[:at] + run[at + 1 :] if x % 31 == 0 else run] += 1
            run = ""
    return {w: k for w, k in n.items() if k >= 2 and len(w) >= 7}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def expected(rows):
    n = words_of(rows)
    close = {w: [o for o in n if near(w, o)] for w in n}
    form = {}
    for w, found in close.items():
        best = min(found, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(close[w]), n[form[w]] if form[w] else None)
    return out


def texts():
    r, rows = random.Random(5), []
    stems = ["aaaaaaa", "station", "nation×s", "überall", "ÿÿÿÿÿÿÿ", "abcdefgh", "abcdefghijklmnop"]
    for i in range(60):
        line = []
        for _ in range(30):
            w = r.choice(stems[:: r.choice([1, 2])])
            for _ in range(r.choice([0, 0, 0, 1, 1, 2])):
                at, c = r.randrange(len(w)), r.choice("abé×ÿ")
                w = r.choice([w[:at] + w[at + 1 :], w[:at] + c + w[at:], w[:at] + c + w[at + 1 :]])
            line.append(r.choice([w, w.upper(), w.title()]))
        rows.append((r.choice([i, i, None]), r.choice([" ", "1", "日", "\n"]).join(line), None, None, None))
    ladder = " ".join(["ladderab"] * 300 + ["ladderac"] * 25 + ["laddebac"] * 2)
    return rows + rows[:5] + [(1, None, None, None, None), (2, "", None, None, None), (4, ladder, None, None, None), (4, "x" * 5000 + " " + "short wo", None, None, None)]


@pytest.mark.parametrize("hot", [2, 40, 4096])
def test_variants(spark, hot):
    rows = texts()
    got = variants.groups(make(spark, rows).repartition(3), hot=hot).collect()
    want = expected(rows)
    assert {r["word"]: tuple(r)[1:] for r in got} == want and len(got) == len(want) > 100
    assert want["laddebac"][1] == "ladderab" and max(x[3] for x in want.values()) > 12


def test_variants_of_nothing(spark):
    assert variants.groups(make(spark, [])).count() == 0
    assert variants.groups(make(spark, [(1, "only once here", None, None, None), (None, None, None, None, None)])).count() == 0


def test_masks_and_keys():
    """Any two near words share a key."""
    import pyarrow as pa

    r = random.Random(8)
    for _ in range(300):
        w = bytes(r.choice(b"abcdxyz\xe9\xff") for _ in range(r.randrange(7, 12)))
        at, c = r.randrange(len(w)), bytes([r.choice(b"abcq\xe9")])
        o = r.choice([w[:at] + w[at + 1 :], w[:at] + c + w[at:], w[:at] + c + w[at + 1 :]])
        a = np.array([min(len(w), len(o))] * 2)
        keys = [k.tolist() for _, k in variants.Words(pa.array([w, o], pa.binary())).keys(a)]
        assert any(x == y for x, y in keys), (w, o)


# --- cost-balanced packing


def pieces(df):
    return [r.asDict() for r in df.collect()]


@pytest.mark.parametrize("leaf,fan,parts", [(2_000_000, 256, 3), (3000, 2, 7), (1, 2, 5)])
def test_cost_packing(spark, monkeypatch, leaf, fan, parts):
    monkeypatch.setattr(cost_packing, "LEAF_TOKENS", leaf)
    monkeypatch.setattr(cost_packing, "FAN", fan)
    r = random.Random(2)
    rows = [(k, " ".join(r.choice(["stone", "ring", "é", "1", "\n"]) for _ in range(int(r.paretovariate(0.9) * 8))), None, None, None) for k in range(120)]
    rows += [(500, None, None, None, None), (501, "", None, None, None), (None, "no id", None, None, None), (3, "a <|endoftext|> b", None, None, None), rows[7], rows[7], (600, "long " * 9000, None, None, None)]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTE)
    t.encode_special_tokens = False
    ids = collections.Counter((i, tuple([*t.encode(x or "", add_special_tokens=False).ids, 1])) for i, x, *_ in rows)
    got = pieces(cost_packing.pack(make(spark, rows).repartition(parts), BYTE, keep_ids=True))
    sequences, documents = collections.defaultdict(list), collections.defaultdict(list)
    for p in got:
        p["tokens"] = np.frombuffer(bytes(p["ids"]), "<u4")
        assert len(p["tokens"]) == p["length"] > 0 and zlib.crc32(bytes(p["ids"])) == p["ids_crc32"]
        sequences[p["sequence_id"]].append(p)
        documents[p["doc_id"], p["doc_tokens"]].append(p)
    fills = collections.Counter()
    for own in sequences.values():
        own.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in own] == [0, *itertools.accumulate(p["length"] for p in own)][:-1]
        assert math.isclose(own[0]["sequence_cost"], sum(cost_packing.LINEAR * p["length"] + cost_packing.QUADRATIC * p["length"] ** 2 for p in own))
        fills[sum(p["length"] for p in own)] += 1
    assert all(f == 2048 or f & (f - 1) == 0 for f in fills) and all(n == 1 for f, n in fills.items() if f < 2048)
    assert sum(f * n for f, n in fills.items()) == sum(len(x) * n for (_, x), n in ids.items())
    for (i, x), n in ids.items():  # each id lies in exactly one piece
        own = [p for p in documents[i, len(x)] if tuple(p["tokens"].tolist()) == x[p["start"] : p["start"] + p["length"]]]
        assert collections.Counter(k for p in own for k in range(p["start"], p["start"] + p["length"])) >= collections.Counter({k: n for k in range(len(x))})


def test_costs_are_balanced():
    r = random.Random(4)
    pieces = [(k, 0, size, bytes(4 * size)) for k, size in enumerate(r.choice([40, 300, 900, 1500]) for _ in range(4000))]
    total = sum(size for _, _, size, _ in pieces)
    filled, costs, left = cost_packing.balanced(pieces, [2048] * (total // 2048))
    assert sum(len(ids) // 4 for _, _, _, ids in left) == total % 2048
    assert all(sum(len(ids) // 4 for _, _, _, ids in own) == 2048 for own in filled)
    shuffled = random.Random(1).sample(pieces, len(pieces))  # cut in any order: what balancing has to beat
    plain, now = [[]], 0
    for _, _, size, _ in shuffled:
        while size:
            part = min(size, 2048 - now)
            plain[-1].append(part)
            size, now = size - part, now + part
            if now == 2048:
                plain.append([])
                now = 0
    cost = lambda own: sum(cost_packing.LINEAR * x + cost_packing.QUADRATIC * x * x for x in own)
    assert np.std(costs) < 0.8 * np.std([cost(own) for own in plain[:-1]])


def test_cost_packing_of_nothing(spark):
    assert cost_packing.pack(make(spark, []), BYTE).count() == 0
    with pytest.raises(ValueError):
        cost_packing.pack(make(spark, []), BYTE, capacity=1000)

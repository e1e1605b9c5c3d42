"""Substring dedup with suffix automata of reference shards.

Two ways in:

- remove_known(docs, reference): executors build automata over blocks of a reference table, each of at most BLOCK_WORDS words; passes over
  the documents broadcast at most PASS_BYTES of them, whose sizes are known before they are collected; documents stream through them for matching statistics, and
  maximal matching spans of WINDOW words or more are removed. Words go by 64-bit hashes there.
- repeated_words(docs): the corpus is its own reference. Broadcasting automata of all shards to all documents would
  be quadratic (README has figures), so the reference is cut down and the shards stay where they are:
  1. Each window of WINDOW words picks the run of GRAM words with the smallest hash inside it, its anchor. Equal windows have equal
     anchors, so a window whose anchor occurs once in the corpus repeats nothing. Counting anchors moves 16 bytes for about
     every seventh word; anchors met twice in a batch are settled there.
  2. Windows with a repeated anchor become segments of consecutive windows with that anchor and go to the anchor's shard. Equal segments
     of a batch are combined before the shuffle: the first goes on, the others repeat it. Anchors with more than OFTEN occurrences, or more where
     there would be over OFTEN_MOST of them (a broadcast of 8 MB), are dealt by window instead.
  3. A shard takes an anchor's segments in order of (document, start), gets their matching statistics against the automaton of all earlier ones,
     and then adds what they have of new windows to it. Windows matched at full length start earlier elsewhere. Words are compared themselves, hashes only route.

Words are runs of characters other than ASCII white space. Null or wordless texts have no words. A null id counts as the largest. Rows that share an id
are documents of their own, in order of a 64-bit hash of their texts; rows with the same id and text are one place and don't remove each other. An empty table gives
an empty result. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import SPACES, Lexer, materialise, mix, read_table, text_bytes, windows
from .automaton import SuffixAutomaton

WINDOW, GRAM = 20, 8
#: Buckets for each shuffle partition; words whose anchors are combined before they are sent.
BUCKETS, FLUSH_WORDS = 4, 4_000_000
#: Occurrences above which an anchor is dealt by window, and how many such anchors at most.
OFTEN, OFTEN_MOST = 2048, 1_000_000
#: Words of one automaton; bytes of automata that are broadcast at once.
BLOCK_WORDS, PASS_BYTES = 50_000, 64 << 20
_LAST = np.iinfo(np.int64).max


def _anchors(hashes: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window starts, anchor positions of those windows, gram hashes); only windows inside one text."""
    grams = windows(hashes, GRAM)
    if len(hashes) < WINDOW:
        return np.empty(0, np.int64), np.empty(0, np.int64), grams
    inside = np.zeros(len(hashes) + 1, np.int64)  # +1 where a text's windows begin, -1 where they end
    full = np.diff(edge) >= WINDOW
    np.add.at(inside, edge[:-1][full], 1)
    np.add.at(inside, edge[1:][full] - WINDOW + 1, -1)
    starts = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    view = np.lib.stride_tricks.sliding_window_view(grams, WINDOW - GRAM + 1)
    at = np.concatenate([view[starts[i : i + 65536]].argmin(1) for i in range(0, len(starts), 65536)]) if len(starts) else starts
    return starts, starts + at, grams


def _groups(values: np.ndarray) -> list[tuple[int, int]]:
    """(begin, end) of each run of equal values."""
    if not len(values):
        return []
    new = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))).tolist()
    return list(zip(new, [*new[1:], len(values)], strict=True))


def _anchor_rows(buckets: int, flush_words: int):
    """Rows (bucket, doc, hashes): anchors settled here; rows (bucket, hashes, docs, counts): one occurrence of each anchor for its bucket. As many rows for `flush_words` words, whatever the input's size."""
    lex = Lexer(SPACES, lower=False)

    def flush(hashes, docs):
        hashes, docs = np.concatenate(hashes), np.concatenate(docs)
        order = np.argsort(hashes, kind="stable")
        hashes, docs = hashes[order], docs[order]
        new = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1]))) if len(hashes) else np.empty(0, np.int64)
        counts = np.diff(np.append(new, len(hashes))).astype(np.int64)
        again = np.repeat(counts > 1, counts)
        rows = []
        # settled here: all occurrences of an anchor that occurs twice, by document
        mine, known = docs[again], hashes[again]
        by = np.argsort(mine, kind="stable")
        mine, known = mine[by], known[by]
        for a, b in _groups(mine):
            doc = int(mine[a])
            rows.append((int(doc % buckets), doc, known[a:b].tobytes(), None, None))
        reps, heads = hashes[new], docs[new]
        to = (mix(reps) % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(to, kind="stable")
        for a, b in _groups(to[by]):
            own = by[a:b]
            rows.append((int(to[own[0]]), None, reps[own].tobytes(), heads[own].astype(np.int64).tobytes(), counts[own].astype(np.int32).tobytes()))
        for i in range(0, len(rows), 2000):
            bucket, doc, h, d, c = zip(*rows[i : i + 2000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(doc, pa.int64()), pa.array(h, pa.binary()), pa.array(d, pa.binary()), pa.array(c, pa.binary())], ["bucket", "doc", "hashes", "docs", "counts"])

    def run(batches):
        hashes, docs, held = [], [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for first, _, _, _, edge, words in lex.chunks(text_bytes(batch.column(1))):
                _, anchor, grams = _anchors(words, edge)
                anchor = np.unique(anchor)
                hashes.append(grams[anchor])
                docs.append(ids[first + np.searchsorted(edge, anchor, side="right") - 1])
                held += len(words)
                if held >= flush_words:
                    yield from flush(hashes, docs)
                    hashes, docs, held = [], [], 0
        if hashes:
            yield from flush(hashes, docs)

    return run


def _repeated(often: int):
    """Rows (doc, hashes) of anchors that occur twice or more; rows (null, hash, count) of those that occur often."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        local = table.filter(table["docs"].is_null())
        rest = table.filter(table["docs"].is_valid())
        doc, found, n = local["doc"].to_pylist(), local["hashes"].to_pylist(), [0] * len(local)
        if len(rest):
            h, d, c = (np.concatenate([np.frombuffer(x, kind) for x in rest[k].to_pylist()]) for k, kind in (("hashes", np.uint64), ("docs", np.int64), ("counts", np.int32)))
            order = np.argsort(h, kind="stable")
            h, d, c = h[order], d[order], c[order].astype(np.int64)
            new = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            parts, totals = np.diff(np.append(new, len(h))), np.add.reduceat(c, new)
            keep = np.repeat(parts > 1, parts) & (c == 1)  # others are settled where they were found
            mine, known = d[keep], h[keep]
            by = np.argsort(mine, kind="stable")
            mine, known = mine[by], known[by]
            for a, b in _groups(mine):
                doc.append(int(mine[a])), found.append(known[a:b].tobytes()), n.append(0)
            for k in np.flatnonzero(totals > often):
                doc.append(None), found.append(h[new[k]].tobytes()), n.append(int(totals[k]))
        return pa.table({"doc": pa.array(doc, pa.int64()), "hashes": pa.array(found, pa.binary()), "n": pa.array(n, pa.int64())})

    return run


_SEGMENTS = "bucket long, anchor long, doc long, tie long, low int, high int, words binary"


def _segments(buckets: int, often):
    lex = Lexer(SPACES, lower=False)

    def run(batches):
        hot = often.value
        for batch in batches:
            ids, ties = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            order = np.lexsort((ties, ids))
            batch, ids, ties = batch.take(pa.array(order)), ids[order], ties[order]
            repeated = [x for blobs in batch.column(3).to_pylist() for x in blobs]
            repeated = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in repeated]))
            seen: dict[bytes, tuple] = {}
            rows = []
            for first, data, starts, ends, edge, words in lex.chunks(text_bytes(batch.column(2))):
                at, anchor, grams = _anchors(words, edge)
                if not len(at):
                    continue
                h = grams[anchor]
                keep = repeated[np.minimum(np.searchsorted(repeated, h), len(repeated) - 1)] == h
                at, anchor, h = at[keep], anchor[keep], h[keep]
                if not len(at):
                    continue
                single = hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h if len(hot) else np.zeros(len(h), bool)
                new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1))) | single
                begin = np.flatnonzero(new)
                finish = np.append(begin[1:], len(at)) - 1
                owner = np.searchsorted(edge, at[begin], side="right") - 1
                signed, whole = h.view(np.int64), data.tobytes()
                for a, b, o in zip(begin.tolist(), finish.tolist(), owner.tolist(), strict=True):
                    s, e, doc, tie, base = int(at[a]), int(at[b]), int(ids[first + o]), int(ties[first + o]), int(edge[o])
                    text = b" ".join(whole[starts[s] : ends[e + WINDOW - 1]].split())
                    where = (doc, tie, s - base)
                    known = seen.get(text)
                    if known == where:  # a row that repeats another one is the same place
                        continue
                    seen.setdefault(text, where)
                    if known is not None:
                        rows.append((tie % buckets, 0, doc, tie, s - base, e - base, None))
                    elif single[a]:
                        key = int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)
                        rows.append((key % buckets, key, doc, tie, s - base, e - base, text))
                    else:
                        rows.append((int(signed[a]) % buckets, int(signed[a]), doc, tie, s - base, e - base, text))
                if len(rows) > 20_000:
                    yield _segment_batch(rows)
                    rows = []
            if rows:
                yield _segment_batch(rows)

    return run


def _segment_batch(rows):
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["bucket", "anchor", "doc", "tie", "low", "high", "words"])


def _runs(flags: list[bool], low: int):
    """(first, last) window start of each run of true flags."""
    k, n = 0, len(flags)
    while k < n:
        if flags[k]:
            a = k
            while k + 1 < n and flags[k + 1]:
                k += 1
            yield low + a, low + k
        k += 1


def _shard(table: pa.Table) -> pa.Table:
    """Windows (doc, tie, low..high) that start earlier elsewhere."""
    known = table.filter(table["words"].is_null())
    out = list(zip(*(known[k].to_pylist() for k in ("doc", "tie", "low", "high")), strict=True))
    rest = table.filter(table["words"].is_valid()).sort_by([(k, "ascending") for k in ("anchor", "doc", "tie", "low")])
    columns = [rest[k].to_pylist() for k in ("anchor", "doc", "tie", "low", "words")]
    for a, b in _groups(np.array(columns[0], np.int64)):
        if b - a < 2:
            continue
        automaton = SuffixAutomaton()
        automaton.add(columns[4][a].split(b" "))
        for k in range(a + 1, b):
            doc, tie, low, words = columns[1][k], columns[2][k], columns[3][k], columns[4][k].split(b" ")
            same = columns[1][k - 1] == doc and columns[2][k - 1] == tie and columns[3][k - 1] == low
            full = [n >= WINDOW for n in automaton.matches(words)[WINDOW - 1 :]]
            if not same:  # a row that repeats another one is the same place
                out += [(doc, tie, x, y) for x, y in _runs(full, low)]
            if not all(full):
                automaton.add(words)
    return pa.Table.from_batches([_spans(out)])


def _spans(rows: list[tuple[int, int, int, int]]):
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    columns = zip(*rows, strict=True) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc", "tie", "low", "high"])


_SPANS = "doc long, tie long, low int, high int"


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, tie, text): the place of a document in the order. Texts that share an id are told apart, and ordered, by a 64-bit hash."""
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64(text_col).alias("tie"), F.col(text_col).alias("text"))


def repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, tie, low, high): windows starting at words low..high of a document (see _rows) whose words also start earlier."""
    rows, spark = _rows(docs, id_col, text_col), docs.sparkSession
    name = F.xxhash64("doc", "tie").alias("name")  # routes anchors back to the document; no document loses any by a collision
    buckets = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    anchors = rows.select(name, "text").mapInArrow(_anchor_rows(buckets, FLUSH_WORDS), "bucket long, doc long, hashes binary, docs binary, counts binary")
    repeats = materialise(anchors.groupBy("bucket").applyInArrow(_repeated(OFTEN), "doc long, hashes binary, n long"), "repeats")
    hot = repeats.where("doc is null")
    total = hot.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = hot.where(F.col("n") > total // OFTEN_MOST).select("hashes").collect()  # fewer than OFTEN_MOST, by their sum
    often = spark.sparkContext.broadcast(np.sort(np.frombuffer(b"".join(r["hashes"] for r in hot), np.uint64)))
    wanted = repeats.where("doc is not null").groupBy(F.col("doc").alias("name")).agg(F.collect_list("hashes").alias("hashes"))
    segments = rows.select(name, "*").join(wanted, "name").select("doc", "tie", "text", "hashes").mapInArrow(_segments(buckets, often), _SEGMENTS)
    spans = materialise(segments.groupBy("bucket").applyInArrow(_shard, _SPANS), "spans")
    often.destroy()
    return spans


def _keeper(window: int):
    lex = Lexer(SPACES, lower=False)

    def run(batches):
        for batch in batches:
            spans, texts = batch.column(2).to_pylist(), text_bytes(batch.column(1))
            total, gone, kept = [], [], []
            for first, data, starts, ends, edge, _ in lex.chunks(texts):
                whole = data.tobytes()
                for o in range(len(edge) - 1):
                    a, b = int(edge[o]), int(edge[o + 1])
                    own = spans[first + o]
                    total.append(b - a)
                    if not own:
                        gone.append(0)
                        kept.append(b" ".join(texts[first + o].split()))
                        continue
                    cover = np.zeros(b - a + 1, np.int64)
                    np.add.at(cover, [x["low"] for x in own], 1)
                    np.add.at(cover, [x["high"] + window for x in own], -1)
                    stay = np.flatnonzero(np.cumsum(cover[:-1]) == 0) + a
                    gone.append(b - a - len(stay))
                    kept.append(b" ".join([whole[x:y] for x, y in zip(starts[stay].tolist(), ends[stay].tolist(), strict=True)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array([x.decode() for x in kept], pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    return run


def _apply(docs: DataFrame, spans: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    found = spans.groupBy("doc", "tie").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    rows = _rows(docs, id_col, text_col).join(found, ["doc", "tie"], "left").select(F.when(F.col("doc") != _LAST, F.col("doc")).alias("doc_id"), "text", "spans")
    return rows.mapInArrow(_keeper(window), "doc_id long, n_words long, n_removed long, kept_text string")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text): kept words are joined by one blank."""
    return _apply(docs, repeated_words(docs, id_col, text_col), WINDOW, id_col, text_col)


def _automata(block_words: int, window: int):
    """Pickled automata over blocks of texts; the pieces of a long text overlap, so no span of `window` words is lost."""
    lex = Lexer(SPACES, lower=False)

    def run(batches):
        automaton, held = SuffixAutomaton(), 0
        row = lambda: pa.RecordBatch.from_pydict({"automaton": [pickle.dumps(automaton)]})
        for batch in batches:
            for _, _, _, _, edge, hashes in lex.chunks(text_bytes(batch.column(0))):
                for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                    for i in range(a, b, block_words):
                        part = hashes[i : min(b, i + block_words + window - 1)].tolist()
                        automaton.add(part)
                        held += len(part)
                        if held >= block_words:
                            yield row()
                            automaton, held = SuffixAutomaton(), 0
        if held:
            yield row()

    return run


def _known(shared, window: int):
    lex = Lexer(SPACES, lower=False)

    def run(batches):
        automata = [pickle.loads(x) for x in shared.value]
        for batch in batches:
            docs, ties, out = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for first, _, _, _, edge, hashes in lex.chunks(text_bytes(batch.column(2))):
                for k, (a, b) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)):
                    if b - a >= window:
                        words = hashes[a:b].tolist()
                        for automaton in automata:
                            out += [(docs[first + k], ties[first + k], x, y) for x, y in _runs([n >= window for n in automaton.matches(words)[window - 1 :]], 0)]
            yield _spans(out)

    return run


def remove_known(docs: DataFrame, reference: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", reference_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) after removing spans of `window` words or more that the reference holds."""
    spark, rows, spans = docs.sparkSession, _rows(docs, id_col, text_col), []
    built = materialise(reference.select(reference_col).mapInArrow(_automata(BLOCK_WORDS, window), "automaton binary"), "automata").withColumn("id", F.monotonically_increasing_id())
    sizes = sorted((r["id"], r["size"]) for r in built.select("id", F.length("automaton").alias("size")).collect())
    passes: list[tuple[list[int], int]] = []
    for number, size in sizes:
        if not passes or passes[-1][1] + size > PASS_BYTES:
            passes.append(([], 0))
        passes[-1] = [*passes[-1][0], number], passes[-1][1] + size
    for numbers, _ in passes:
        shared = spark.sparkContext.broadcast([bytes(r["automaton"]) for r in built.where(F.col("id").isin(numbers)).collect()])
        spans.append(materialise(rows.mapInArrow(_known(shared, window), _SPANS), "spans"))
        shared.destroy()
    merged = spans[0] if spans else spark.createDataFrame([], _SPANS)
    for more in spans[1:]:
        merged = merged.union(more)
    return _apply(docs, merged, window, id_col, text_col)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY t ORDER BY doc_id, i) AS place FROM win),
hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM r WHERE place > 1),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.p) AS s FROM words LEFT JOIN hit ON words.doc_id = hit.doc_id AND words.p = hit.p WHERE hit.p IS NULL GROUP BY 1),
gone AS (SELECT doc_id, count(*) AS n FROM hit GROUP BY 1)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(gone.n, 0) AS n_removed, sha256(coalesce(kept.s, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id LEFT JOIN gone ON d.doc_id = gone.doc_id
"""

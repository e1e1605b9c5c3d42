"""Benchmark decontamination by a distributed positional inverted index.

Each shard of the training documents stores its own postings: sorted terms (64-bit hashes of words), and
for each term the ascending positions of its occurrences. Queries start from the rarest term of a
phrase in the shard, shift its list by the term's place, and intersect it with the shifted lists of the
other terms, rarest first; the same lists answer proximity queries. Nothing is shuffled: a shard answers all phrases.

The test items are a stated query set. They are read in blocks of at most BLOCK_BYTES of text; a single item longer than that is a block of its own. A broadcast
holds 8 bytes for each word of a block and the items' names, so it is at most four times the block's text and the names, whatever the set's size. Blocks are looked up one after the other.

A window is `window` consecutive item words; an item of fewer words, but not none, is one window. Null or wordless documents
have no words and no hits; null or wordless items match nothing; repeated rows are judged one by one; an item without an id is named by the empty string.
Two different words share a hash with probability below 1e-9 for 10^4 test words and 10^6 terms in a shard.
"""

from __future__ import annotations

import itertools
from math import ceil

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Lexer, batch_bytes, materialise, read_table, text_bytes, tidied

WINDOW = 10
#: Words after which an index shard is closed.
SHARD_WORDS = 1_500_000
#: Bytes of item text in one broadcast.
BLOCK_BYTES = 8 << 20
#: Bytes of a batch of texts in a task.
BATCH = 8 << 20
_SEPARATORS = bytes({*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)} - {*range(0x41, 0x5B)})


def lexer() -> Lexer:
    return Lexer(_SEPARATORS, lower=True)


class ShardIndex:
    """Postings of one shard. positions[offsets[t]:offsets[t+1]] are those of terms[t]; texts are laid end to end."""

    def __init__(self, bounds: np.ndarray, terms: np.ndarray, offsets: np.ndarray, positions: np.ndarray):
        self.bounds, self.terms, self.offsets, self.positions = bounds, terms, offsets, positions
        self.n = int(bounds[-1])
        self.keys = np.repeat(np.arange(len(terms), dtype=np.int64), np.diff(offsets)) * max(self.n, 1) + positions

    @classmethod
    def build(cls, hashes: np.ndarray, bounds: np.ndarray) -> ShardIndex:
        order = np.argsort(hashes, kind="stable")
        terms, first = np.unique(hashes[order], return_index=True)
        return cls(bounds, terms, np.append(first, len(hashes)), order)

    def dump(self) -> tuple[bytes, bytes, bytes, bytes]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        gaps = np.diff(self.positions, prepend=0).astype("<i4")
        return tuple(squeeze(x.tobytes()) for x in (self.bounds.astype("<i8"), self.terms.astype("<u8"), np.diff(self.offsets).astype("<u4"), gaps))

    @classmethod
    def load(cls, bounds: bytes, terms: bytes, counts: bytes, gaps: bytes) -> ShardIndex:
        expand = zstandard.ZstdDecompressor().decompress
        a, b, c, d = (np.frombuffer(expand(x), kind) for x, kind in ((bounds, "<i8"), (terms, "<u8"), (counts, "<u4"), (gaps, "<i4")))
        return cls(a, b, np.concatenate(([0], np.cumsum(c, dtype=np.int64))), np.cumsum(d, dtype=np.int64))

    def lookup(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(term number, list length) of each word; length 0 if absent."""
        if not len(self.terms):
            return np.zeros(words.shape, np.int64), np.zeros(words.shape, np.int64)
        at = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
        return at, np.where(self.terms[at] == words, self.offsets[at + 1] - self.offsets[at], 0)

    def _holds(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        key = term * max(self.n, 1) + position
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        return (position >= 0) & (position < self.n) & (self.keys[at] == key)

    def phrases(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, start) of every exact occurrence inside one text; words: one phrase a row, all of one length."""
        count, length = words.shape
        term, size = self.lookup(words)
        phrase = np.flatnonzero(size.min(axis=1) > 0) if count else np.empty(0, np.int64)
        order = np.argsort(size[phrase], axis=1, kind="stable")
        rare = order[:, 0]
        lists, lengths = term[phrase, rare], size[phrase, rare]
        total = int(lengths.sum())
        inner = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        row = np.repeat(np.arange(len(phrase)), lengths)
        start = self.positions[np.repeat(self.offsets[lists], lengths) + inner] - np.repeat(rare, lengths)
        keep = (start >= 0) & (start + length <= self.n)
        row, start = row[keep], start[keep]
        for k in range(1, length):
            if not len(row):
                break
            place = order[row, k]
            keep = self._holds(term[phrase[row], place], start + place)
            row, start = row[keep], start[keep]
        if len(row):
            last = np.searchsorted(self.bounds, start + length - 1, side="right")
            keep = np.searchsorted(self.bounds, start, side="right") == last
            row, start = row[keep], start[keep]
        return phrase[row], start

    def near(self, words: np.ndarray, slop: int) -> np.ndarray:
        """Positions of the rarest word from which all other words, in any order, are at most slop places away in the same text."""
        term, size = self.lookup(words)
        if not len(words) or not size.min():
            return np.empty(0, np.int64)
        order = np.argsort(size, kind="stable")
        at = self.positions[self.offsets[term[order[0]]] : self.offsets[term[order[0]] + 1]]
        for k in order[1:]:
            own = self.positions[self.offsets[term[k]] : self.offsets[term[k] + 1]]
            text = np.searchsorted(self.bounds, at, side="right")
            low = np.maximum(at - slop, self.bounds[text - 1])
            high = np.minimum(at + slop, self.bounds[text] - 1)
            at = at[np.searchsorted(own, high, side="right") > np.searchsorted(own, low)]
        return at


_INDEX = "shard long, doc_ids binary, bounds binary, terms binary, counts binary, gaps binary"
_NULL = np.iinfo(np.int64).min


def _build(batches):
    lex, base, seq = lexer(), TaskContext.get().partitionId() << 24, 0
    names, hashes, counts, total = [], [], [], 0

    def shard():
        bounds = np.concatenate(([0], np.cumsum(np.concatenate(counts), dtype=np.int64)))
        index = ShardIndex.build(np.concatenate(hashes), bounds).dump()
        ids = np.array(names, "<i8").tobytes()
        return pa.RecordBatch.from_pydict(dict(zip(("shard", "doc_ids", "bounds", "terms", "counts", "gaps"), ([base + seq], [ids], *([x] for x in index)), strict=True)))

    for batch in batches:
        ids = [_NULL if x is None else x for x in batch.column(0).to_pylist()]
        for first, _, _, _, edge, found in lex.chunks(text_bytes(batch.column(1))):
            names += ids[first : first + len(edge) - 1]
            hashes.append(found)
            counts.append(np.diff(edge))
            total += len(found)
            if total >= SHARD_WORDS:
                yield shard()
                names, hashes, counts, total, seq = [], [], [], 0, seq + 1
    if names:
        yield shard()


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index: one row per shard."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with batch_bytes(docs.sparkSession, BATCH):
        return materialise(texts.mapInArrow(tidied(_build), _INDEX), "postings")


class Items:
    """Names and words of test items, laid end to end: what is broadcast. Windows are cut from it where they are looked up."""

    def __init__(self, items: list[tuple[str, str]]):
        self.names, lex = [name for name, _ in items], lexer()
        words = [lex.words([(text or "").encode()])[4] for _, text in items]
        self.words = np.concatenate([np.empty(0, np.uint64), *words])
        self.sizes = np.array([len(x) for x in words], np.int64)

    def windows(self, window: int, most: int = 20_000):
        """(item number of each window, words of each window), windows of one length at once, at most `most`."""
        begin, lengths = np.cumsum(self.sizes) - self.sizes, np.minimum(self.sizes, window)
        for length in np.unique(lengths[lengths > 0]).tolist():
            items = np.flatnonzero(lengths == length)
            count = self.sizes[items] - length + 1
            of = np.repeat(items, count)
            start = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + begin[of]
            view = np.lib.stride_tricks.sliding_window_view(self.words, length)
            for at in range(0, len(of), most):
                yield of[at : at + most], view[start[at : at + most]]


_MATCHES = "shard long, ordinal long, doc_id long, n_words long, n_hit long, items array<string>, starts array<int>, ends array<int>"


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of [start, end) spans as disjoint spans."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], starts[1:] > reach[:-1])) if len(starts) else np.zeros(0, bool)
    return starts[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)] if len(starts) else reach


def _query(block, window: int):
    def run(batches):
        items = block.value
        for batch in batches:
            for shard, doc_ids, *parts in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                index, doc_ids = ShardIndex.load(*parts), np.frombuffer(doc_ids, "<i8")
                pairs, spans = [], []
                for item_of, words in items.windows(window):
                    phrase, start = index.phrases(words)
                    if len(start):
                        doc = np.searchsorted(index.bounds, start, side="right") - 1
                        pairs.append(np.stack((doc, item_of[phrase]), 1))
                        spans.append(np.stack((doc, start, start + words.shape[1]), 1))
                found: dict[int, tuple] = {}
                if spans:
                    every, matched = np.concatenate(spans), np.unique(np.concatenate(pairs), axis=0)
                    low, high = merged(every[:, 1], every[:, 2])  # spans of different texts never overlap, but may touch
                    for d in np.unique(every[:, 0]).tolist():
                        a, b = index.bounds[d], index.bounds[d + 1]
                        i, j = np.searchsorted(high, a, side="right"), np.searchsorted(low, b)
                        own = matched[matched[:, 0].searchsorted(d) : matched[:, 0].searchsorted(d + 1), 1]
                        found[d] = (sorted(items.names[k] for k in own), np.maximum(low[i:j], a) - a, np.minimum(high[i:j], b) - a)
                none = ([], np.empty(0, np.int64), np.empty(0, np.int64))
                rows = [found.get(d, none) for d in range(len(doc_ids))]
                yield pa.RecordBatch.from_pydict({
                    "shard": np.full(len(rows), shard), "ordinal": np.arange(len(rows)), "doc_id": pa.array(doc_ids, mask=doc_ids == _NULL), "n_words": np.diff(index.bounds),
                    "n_hit": np.array([int((b - a).sum()) for _, a, b in rows], np.int64), "items": pa.array([x for x, _, _ in rows], pa.list_(pa.string())),
                    "starts": pa.array([a.tolist() for _, a, _ in rows], pa.list_(pa.int32())), "ends": pa.array([b.tolist() for _, _, b in rows], pa.list_(pa.int32())),
                })

    return tidied(run)


def _union(batches):
    for batch in batches:
        rows = batch.to_pydict()
        for k, (a, b) in enumerate(zip(rows["starts"], rows["ends"], strict=True)):
            low, high = merged(np.array(a, np.int64), np.array(b, np.int64))
            rows["starts"][k], rows["ends"][k], rows["n_hit"][k] = low.tolist(), high.tolist(), int((high - low).sum())
        yield pa.RecordBatch.from_pydict(rows, batch.schema)


def _dealt(rows: DataFrame, salt: int = 0):
    """Lists of (item, text) of at most BLOCK_BYTES, or of one item; every size is known before its rows are collected."""
    size = F.octet_length("item") + F.octet_length("text") + 16
    n = max(1, ceil((rows.agg(F.sum(size)).first()[0] or 0) / (BLOCK_BYTES / 2)))
    group = F.pmod(F.xxhash64("item", "text", F.lit(salt)), F.lit(n))
    for k, count, total in sorted(map(tuple, rows.groupBy(group.alias("k")).agg(F.count("*"), F.sum(size)).collect())):
        own = rows.where(group == k)
        if total > BLOCK_BYTES and count > 1:
            yield from _dealt(own, salt + 1)
        else:
            yield [(r["item"], r["text"]) for r in own.collect()]


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per document: (doc_id, n_words, n_hit, items, starts, ends); starts and ends are disjoint spans of hit words."""
    spark, index = docs.sparkSession, build_index(docs, id_col, text_col)
    chosen = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))
    n, found = 0, None
    for block in itertools.chain(_dealt(materialise(chosen.distinct(), "items")), [None]):
        if block is None and n:  # the end; without items there is one empty block
            break
        n += 1
        shared = spark.sparkContext.broadcast(Items(block or []))
        answers = materialise(index.mapInArrow(_query(shared, window), _MATCHES), "matches")
        shared.destroy()
        found = answers if found is None else found.unionByName(answers)
    if n > 1:
        found = found.groupBy("shard", "ordinal").agg(
            F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.max("n_hit").alias("n_hit"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"),
        ).mapInArrow(_union, _MATCHES)
    return found.select("doc_id", "n_words", "n_hit", F.array_distinct("items").alias("items"), "starts", "ends")


def _near(shared, slop: int):
    def run(batches):
        phrases = shared.value
        lex = lexer()
        asked = [lex.words([p.encode()])[4] for p in phrases]
        for batch in batches:
            rows = []
            for _, doc_ids, *parts in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                index, ids = ShardIndex.load(*parts), np.frombuffer(doc_ids, "<i8")
                for phrase, words in zip(phrases, asked, strict=True):
                    at = index.near(words, slop)
                    doc = np.searchsorted(index.bounds, at, side="right") - 1
                    rows += [(None if ids[d] == _NULL else int(ids[d]), phrase, int(p)) for d, p in zip(doc.tolist(), (at - index.bounds[doc]).tolist(), strict=True)]
            doc_id, phrase, place = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(doc_id, pa.int64()), pa.array(phrase, pa.string()), pa.array(place, pa.int64())], ["doc_id", "phrase", "place"])

    return run


def proximity(index: DataFrame, phrases: list[str], slop: int) -> DataFrame:
    """(doc_id, phrase, place): places of a phrase's rarest word from which all its other words, in any order, are at most `slop` words away in the same document.

    index: as of build_index(); phrases: a few, they are broadcast. Phrases without words match nothing.
    """
    shared = index.sparkSession.sparkContext.broadcast(list(phrases))
    return index.mapInArrow(_near(shared, slop), "doc_id long, phrase string, place long")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


#: Windows by hash join on their text; a word's hit is a place in any window that matches.
SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
sizes AS (SELECT DISTINCT least(10, len(w)) AS k FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS t
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS t
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)),
m AS (SELECT DISTINCT doc_id, item_id, dw.k AS k, i FROM dw JOIN bw ON dw.t = bw.t AND dw.k = bw.k),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM m)) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""

"""Groups spelling variants of a corpus's words by letter-parity bands.

A word's mask has one bit for each letter, set if the letter occurs an odd number of times. One inserted, deleted or replaced letter flips at most two
bits, so of the mask's three bands (letters dealt by their number modulo 3) at least one is equal in two words that are near. Such an edit also leaves the
words equal before or behind their middle. So near words of lengths a and a or a + 1 share one of six keys: a, a band's bits, and the half that is
left alone. Words with a key in common meet, those whose lengths fit and whose masks differ in two bits at most are verified letter by letter, and a pair counts at
the first key that its words share.

1. Tasks count words, combining them before the shuffle; words of LEAST letters and MENTIONS mentions or more make up the vocabulary, which is written.
2. Each word is sent out under its keys, sorted by key; tasks read the stream and hold at most HOT words of one key.
3. Words of a hotter key are not compared with one another: they go on under (key, each word that they give by leaving out one letter), and meet there. Near words share such
   a word, and only words that are near or two steps apart do: so few that no group grows with the input.
4. Counts of near words and the most frequent one of each are summed up; forms are followed by pointer doubling.

Letters are A-Z, a-z and U+00C0 to U+00FF, so a word is a string of bytes in Latin-1, whose order is that of code points. Null texts have no words; a null id counts as
empty. Repeated rows count as often as they occur. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import _pows, materialise, mix, read_table

LEAST, MENTIONS, RATIO = 7, 2, 10
#: One in so many mentions loses a letter.
SLIPS = 31
#: Words of a key that are compared with one another; distinct words that a task counts before it sends them on.
HOT, HELD = 4096, 400_000
#: Candidate pairs that are verified at once.
PAIRS = 1 << 18

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _counts(least: int, slips: int):
    """(word, n): words of Latin-1 letters with their mentions, after slips."""
    # a slip leaves at least one letter less, so shorter runs never count; runs of other lengths are skipped whole, as a match takes all it can
    runs = re.compile(rb"[a-z\xc0-\xff]{%d,}" % least)

    def flush(counts):
        counts = {w: n for w, n in counts.items() if len(w) >= least}
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    def run(batches):
        held: Counter = Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                seed = zlib.crc32(b"%s:" % (b"" if doc is None else str(doc).encode()))
                for word, n in Counter(runs.findall(text.encode("latin-1", "replace").translate(_LOWER))).items():
                    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), seed)
                    if h % slips == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    held[word] += n
                if len(held) >= HELD:
                    yield flush(held)
                    held = Counter()
        if held:
            yield flush(held)

    return run


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, mentions: int = MENTIONS, slips: int = SLIPS) -> DataFrame:
    """(word binary in Latin-1, n): the distinct words of enough letters and mentions."""
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counted = chosen.mapInArrow(_counts(least, slips), "word binary, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= mentions)


class Words:
    """Words as one array of bytes, with their masks in three bands, and hashes of their parts."""

    def __init__(self, column: pa.Array):
        words = column.to_pylist()
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        self.data = np.frombuffer(b"".join(words), np.uint8)
        self.start = np.cumsum(self.size) - self.size
        # a number for each letter: a-z, then U+00C0 on; modulo 3 its band, divided by 3 its bit there
        number = [c - 97 if 97 <= c <= 122 else 26 + c - 0xC0 if c >= 0xC0 else 0 for c in range(256)]
        bits = [np.array([1 << x // 3 if x % 3 == k else 0 for x in number], np.uint32) for k in range(3)]
        self.masks = [np.bitwise_xor.reduceat(b[self.data], self.start) if words else np.empty(0, np.uint32) for b in bits]
        power, self.inverse = _pows(len(self.data))
        self.run = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * power[: len(self.data)], dtype=np.uint64, out=self.run[1:])

    def part(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.run[end] - self.run[begin]) * self.inverse[begin])

    def keys(self, a: np.ndarray):
        """(label, keys): the six keys of each word in a pair whose shorter word has a letters. The label is 3 * half + band."""
        h, end = a // 2, self.start + self.size
        for side, (b, e) in enumerate(((self.start, self.start + h), (end - (a - h), end))):
            half = self.part(b, e)
            for k, mask in enumerate(self.masks):
                own = (mask.astype(np.uint64) << np.uint64(32)) + (a.astype(np.uint64) << np.uint64(3)) + np.uint64(3 * side + k)
                yield 3 * side + k, mix(half + mix(own)).view(np.int64)

    def matrix(self, of: np.ndarray, width: int) -> np.ndarray:
        """The words of these numbers, filled up with zero bytes."""
        columns = np.arange(width)
        inside = columns < self.size[of, None]
        return np.where(inside, self.data[np.minimum(self.start[of, None] + columns, len(self.data) - 1)], 0)


#: Words under a key: where they meet, which of their keys it is, the shorter word's length in the pairs sought there.
_KEYED = [("meet", pa.int64()), ("key", pa.int64()), ("a", pa.int32()), ("word", pa.binary()), ("n", pa.int64())]
_KEYED_DDL = "meet long, key long, a int, word binary, n long"
#: Found: near words of a word and the most frequent of them; or a word of a hot key, with that key and a.
_FOUND = [("word", pa.binary()), ("near", pa.int64()), ("form_n", pa.int64()), ("form", pa.binary()), ("key", pa.int64()), ("a", pa.int32())]
_FOUND_DDL = "word binary, near long, form_n long, form binary, key long, a int"


def _rows(fields, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, fields, strict=True)], schema=pa.schema(fields))


def _spread(batches):
    """Each word under its keys as the shorter or an equal word (a: its own length) and as the longer one (a: one less)."""
    for batch in batches:
        words, keys, lengths = Words(batch.column(0)), [], []
        for a in (words.size, words.size - 1):
            for _, key in words.keys(a):
                keys.append(key)
                lengths.append(a.astype(np.int32))
        key, times = np.concatenate(keys), len(keys)
        columns = [pa.array(key), pa.array(key), pa.array(np.concatenate(lengths)), *(pa.concat_arrays([batch.column(c)] * times) for c in (0, 1))]
        yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(_KEYED))


def _left_out(batches):
    """Words of hot keys under each word that they give by leaving out a letter, and the shorter ones under themselves."""
    for batch in batches:
        rows = []
        for word, n, key, a in zip(*(batch.column(c).to_pylist() for c in ("word", "form_n", "key", "a")), strict=True):
            given = {word[:i] + word[i + 1 :] for i in range(len(word))} | ({word} if len(word) == a else set())
            rows += [(int.from_bytes(blake2b(x + key.to_bytes(8, "little", signed=True), digest_size=8).digest(), "little", signed=True), key, a, word, n) for x in given]
        yield _rows(_KEYED, *(zip(*rows, strict=True) if rows else [()] * 5))


def _pairs(meet: np.ndarray):
    """Pairs (i, j), i < j, of places with equal values, about PAIRS at once; equal values stand together."""
    at, step, found, size = np.arange(len(meet)), 1, [], 0
    while len(at):
        at = at[at + step < len(meet)]
        at = at[meet[at + step] == meet[at]]
        found.append((at, at + step))
        size, step = size + len(at), step + 1
        if size >= PAIRS or not len(at):
            yield np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])
            found, size = [], 0


def _near(words: Words, a: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs (i, j) those that are near: the shorter word, of a letters, the other one, and the place of the edit."""
    swap = words.size[i] > words.size[j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    fit = (words.size[i] == a[i]) & (words.size[j] <= a[i] + 1) & (sum(np.bitwise_count(m[i] ^ m[j]) for m in words.masks) <= 2)
    i, j = i[fit], j[fit]
    if not len(i):
        return i, j, i
    width = int(words.size[j].max())
    left, right = words.matrix(i, width), words.matrix(j, width)
    differ = left != right
    place = differ.argmax(1)
    columns = np.arange(width - 1)
    behind = (columns >= place[:, None]) & (columns < words.size[i, None])
    inserted = (words.size[i] < words.size[j]) & ~((left[:, :-1] != right[:, 1:]) & behind).any(1)
    near = inserted | (words.size[i] == words.size[j]) & (differ.sum(1) == 1)
    return i[near], j[near], place[near]


def _compared(rows: pa.RecordBatch, summed: bool):
    """Near words among rows in order of `meet`, at the first key of each pair: its lowest equal band, and the first half before the second."""
    words, names = Words(rows.column(3)), rows.column(3).to_pylist()
    meet, key, a, n = (rows.column(c).to_numpy() for c in (0, 1, 2, 4))
    a, label = a.astype(np.int64), np.full(len(key), -1)
    for mark, own in words.keys(a):
        label[own == key] = mark
    best: dict[bytes, tuple[int, int, bytes]] = {}
    for i, j in _pairs(meet):
        i, j, place = _near(words, a, i, j)
        band = np.full(len(i), 3)
        for k in (2, 1, 0):
            band[words.masks[k][i] == words.masks[k][j]] = k
        first = label[i] == 3 * (place < a[i] // 2) + band
        both, other = np.concatenate((i[first], j[first])), np.concatenate((j[first], i[first]))
        found = zip([names[x] for x in both.tolist()], n[other].tolist(), [names[x] for x in other.tolist()], strict=True)
        if not summed:
            word, form_n, form = zip(*found, strict=True) if len(both) else ((), (), ())
            yield _rows(_FOUND, word, [1] * len(word), form_n, form, [None] * len(word), [None] * len(word))
            continue
        for word, count, form in found:
            near, most, least = best.get(word, (0, 0, b""))
            best[word] = (near + 1, *((count, form) if count > most or count == most and form < least else (most, least)))
    if best:
        near, form_n, form = zip(*best.values(), strict=True)
        yield _rows(_FOUND, best.keys(), near, form_n, form, [None] * len(near), [None] * len(near))


def _meet(hot: int | None, summed: bool):
    """Near words among rows in order of `meet`. Rows that meet more than `hot` others are passed on, with their key; the others of one value are held together."""

    def passed(rows: pa.RecordBatch):
        none = pa.nulls(len(rows), pa.int64())
        return pa.RecordBatch.from_arrays([rows.column(3), none, rows.column(4), pa.nulls(len(rows), pa.binary()), rows.column(1), rows.column(2)], schema=pa.schema(_FOUND))

    def run(batches):
        held, passing = None, None  # rows of the last value so far; the value whose rows are passed on
        for batch in batches:
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
                held = None
            if not len(batch):
                continue
            meet = batch.column(0).to_numpy()
            new = np.flatnonzero(np.concatenate(([True], meet[1:] != meet[:-1])))
            sizes = np.diff(np.append(new, len(meet)))
            big = sizes > hot if hot else np.zeros(len(sizes), bool)
            big[0] |= passing is not None and meet[0] == passing
            passing = int(meet[-1]) if big[-1] else None
            if passing is None:  # its rows may go on in the next batch
                held, batch = batch.slice(new[-1]), batch.slice(0, new[-1])
                big, sizes = big[:-1], sizes[:-1]
            flags = pa.array(np.repeat(big, sizes))
            if big.any():
                yield passed(batch.filter(flags))
                batch = batch.filter(pc.invert(flags))
            if len(batch):
                yield from _compared(batch, summed)
        if held is not None:
            yield from _compared(held, summed)

    return run


def near_words(words: DataFrame, hot: int = HOT) -> DataFrame:
    """(word, n_near, form, form_n) of the words (word, n) that have near words: how many, and the most frequent one of them."""
    sent = words.select("word", "n").mapInArrow(_spread, _KEYED_DDL)
    found = materialise(sent.repartition("meet").sortWithinPartitions("meet").mapInArrow(_meet(hot, True), _FOUND_DDL), "near")
    again = found.where("key is not null").mapInArrow(_left_out, _KEYED_DDL)
    more = again.repartition("meet").sortWithinPartitions("meet").mapInArrow(_meet(None, False), _FOUND_DDL).dropDuplicates(["word", "form"])
    every = found.where("key is null").unionByName(more)
    summed = every.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("n"), "form")).alias("best"))
    return summed.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.n")).alias("form_n"))


def roots(forms: DataFrame, most: int) -> DataFrame:
    """(word, root) of words (word, form) by following forms to their end; most: steps that any chain can have. Pointers double, so rounds are its logarithm."""
    found = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(max(most, 1)))):
        found = materialise(found, "roots")
        after = found.select(F.col("word").alias("root"), F.col("root").alias("after"))
        found = found.join(after, "root", "left").select("word", F.coalesce("after", "root").alias("root"))
    return found


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: int = RATIO, hot: int = HOT, **limits) -> DataFrame:
    """(word, form, root, n, n_near, form_n): form is the most frequent near word, if it has at least `ratio` times the mentions; limits: those of vocabulary()."""
    words = materialise(vocabulary(docs, id_col, text_col, **limits), "words")
    near = near_words(words, hot)
    known = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), *(F.when(F.col("form_n") >= ratio * F.col("n"), F.col(c)).alias(c) for c in ("form", "form_n")))
    known = materialise(known, "forms")
    largest = words.agg(F.max("n")).first()[0] or 1
    ends = roots(known.where("form is not null").select("word", "form"), math.floor(math.log(largest, ratio)) + 1)
    text = lambda c: F.decode(c, "ISO-8859-1")
    return known.join(ends, "word", "left").select(text(F.col("word")).alias("word"), text(F.col("form")).alias("form"), text(F.coalesce("root", "word")).alias("root"), "n", "n_near", "form_n")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(read_table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE table_of AS (
  SELECT list(v ORDER BY n) AS t FROM (SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS r(n))),
runs AS (
  SELECT doc_id, r, count(*) AS k
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS r FROM documents)
  WHERE length(r) >= 7 GROUP BY ALL),
coded AS (SELECT *, flatten(list_transform(string_split(doc_id || ':' || r, ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)::BIGINT] ELSE [195::BIGINT, ord(x)::BIGINT - 64] END)) AS bytes FROM runs),
hashed AS (SELECT r, k, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS h FROM coded, table_of),
slipped AS (SELECT CASE WHEN h % 31 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, k FROM hashed),
v AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM slipped WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
cut AS (SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest FROM (SELECT *, unnest(range(1, length(word) + 1)) AS p FROM v)),
pairs AS (
  SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN v b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN v b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-n, other)) AS form, max(n) AS form_n FROM pairs GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * v.n THEN form END AS form, CASE WHEN form_n >= 10 * v.n THEN form_n END AS form_n FROM v LEFT JOIN best ON v.word = best.word),
chain(word, last, step) AS (SELECT word, word, 0 FROM f UNION ALL SELECT c.word, f.form, c.step + 1 FROM chain c JOIN f ON c.last = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM f JOIN (SELECT word, arg_max(last, step) AS root FROM chain GROUP BY word) r ON f.word = r.word
"""

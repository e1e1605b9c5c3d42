"""Elias-Fano n-gram trie of order 3 and scoring of whole texts with it.

Model, over words and one end token that also starts each text: p1(w) = (c(w) + 0.1) / (N + 0.1 * (V + 1)), the base;
p2(w | v) = c(vw) / (c(v) + MU2) + MU2 / (c(v) + MU2) * p1(w); p3(w | uv) = c(uvw) / (c(uv) + MU3) + MU3 / (c(uv) + MU3) * p2(w | v). A text's
first token has no trigram. All shares c / (c + MU) and the trigrams' back-off weights are quantised to 8 bits, never upwards, so probabilities sum to at most 1.

Every training word has a number: those of its shard of level 0 stand by hash, and shards one after the other. Pairs and triples hold numbers. (Numbers have 32 bits: more than
MOST_WORDS distinct words are an error.)

Storage: level 0 holds the words' full 64-bit hashes and, as running sums, their counts. A trie holds level 1 contexts u, level 2 pairs uv with
share and weight, level 3 triples uvw with share, as numbers of words. Every level is an Elias-Fano sequence with stored rank and select directories; entries are
made monotone over all contexts by adding the running maximum of earlier contexts, and an Elias-Fano sequence of pointers parts them. A lookup is a successor search
in level 1, then in the range of u alone, then in the range of uv alone, on the compressed bits, many lookups at once. A shard's level or trie is one byte string, kept in
the written answer table and memory-mapped when it is queried.

The model grows with the corpus, so it is dealt into shards by the hash of u, and the texts' n-grams go to the shards rather than the
model to the texts. Documents are encoded once in batches; a batch sends each distinct word once, and with the numbers that come back each distinct pair and triple, with
training counts, and gets answers back in the order it sent them. A text is never split: one longer than BATCH_TOKENS is a batch. The number of messages of a batch depends on the shards alone, which follow the shuffle
partitions or SHARD_TOKENS. Contexts u with more than 1/HOT of all training tokens (at most
HOT of them, whose counts are broadcast, as is a number for each shard) are dealt by pair uv, so no shard grows with one word; the distinct successors of one pair, once a batch, stay together.

Words are runs of characters other than ASCII white space, A-Z lower-cased; null texts are empty: one end token. Repeated rows are scored
and counted one by one; a null id counts as a training row. Without training tokens N = V = 0 and the base is uniform. Words are told apart by 64-bit hashes (10^7
words share one with probability below 10^-5). Columns other than the id and the text are not read.
"""

from __future__ import annotations

import mmap
import os
import tempfile

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import SPACES, Lexer, crc_of_id, materialise, mix, read_table, scope, text_bytes
from .wavelet import Plane

MU2, MU3 = 1500.0, 10.0
#: Tokens of one batch; tokens of a shard; share of all tokens from which a context is dealt by pair.
BATCH_TOKENS, SHARD_TOKENS, HOT = 1_300_000, 4_000_000, 2000
#: Distinct training words that numbers of 32 bits can tell apart, with one for none.
MOST_WORDS = (1 << 31) - 2
#: Hash of the end token.
END = np.uint64(0)
#: Code c > 0 stands for 2 ** (-(c - 1) / STEP); 0 for nothing.
STEP = 8.0
_COMPRESS, _EXPAND = zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress


def _squeeze(x: np.ndarray) -> bytes:
    return _COMPRESS(x.tobytes())


def _expand(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(_EXPAND(x), kind)


class EliasFano:
    """Monotone sequence of unsigned 64-bit integers: low bits packed, high parts in unary with rank and select directories."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: Plane):
        self.n, self.bits, self.low, self.high = n, low_bits, low, high
        self.zeros = int(high.select(np.array([n - 1]), True)[0]) - n + 2 if n else 0  # in the unary part: one more than the highest part

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        marks = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros((int(marks[-1]) if n else 0) + 2, bool)  # ends with a zero
        flags[marks] = True
        low = np.zeros(-(-n * bits // 64) + 1, np.uint64)
        if bits:
            at = np.arange(n) * bits
            part, shift = values & np.uint64((1 << bits) - 1), (at & 63).astype(np.uint64)
            np.bitwise_or.at(low, at >> 6, part << shift)
            over = (at & 63) + bits > 64
            np.bitwise_or.at(low, (at[over] >> 6) + 1, part[over] >> (np.uint64(64) - shift[over]))
        return cls(n, bits, low, Plane.build(flags))

    def dump(self) -> bytes:
        parts = (self.low.astype("<u8"), *self.high.parts())
        return np.array([self.n, self.bits, *map(len, parts)], "<u8").tobytes() + b"".join(x.tobytes() + bytes(-x.nbytes % 8) for x in parts)

    @classmethod
    def load(cls, data, at: int) -> tuple[EliasFano, int]:
        n, bits, *sizes = np.frombuffer(data, "<u8", 8, at).tolist()
        at += 64
        parts = []
        for kind, size in zip(("<u8", "<u8", "<u4", "<u2", "<u4", "<u4"), sizes, strict=True):
            parts.append(np.frombuffer(data, kind, size, at))
            at += -(-parts[-1].nbytes // 8) * 8
        return cls(n, bits, parts[0], Plane(*parts[1:])), at

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i * self.bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        out = self.low[word] >> shift
        over = np.flatnonzero((at & 63) + self.bits > 64)
        out[over] |= self.low[word[over] + 1] << (np.uint64(64) - shift[over])
        return out & np.uint64((1 << self.bits) - 1)

    def access(self, i) -> np.ndarray:
        """Values at places i: a select in the unary part, then the low bits."""
        i = np.asarray(i, np.int64)
        return (self.high.select(i, True) - i).astype(np.uint64) << np.uint64(self.bits) | self._lows(i)

    def search(self, values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """First place in [begin, end) whose value is not below each value: two selects bound the places with its high part, low bits are halved there."""
        high = (values >> np.uint64(self.bits)).astype(np.int64)

        def upto(h):  # values whose high part is at most h
            inside = np.clip(h, 0, self.zeros - 1)
            return np.where(h < 0, 0, np.where(h >= self.zeros, self.n, self.high.select(inside, False) - inside))

        low, top = np.clip(upto(high - 1), begin, end), np.clip(upto(high), begin, end)
        want = values & np.uint64((1 << self.bits) - 1)
        busy = np.flatnonzero(low < top)
        while len(busy):
            mid = (low[busy] + top[busy]) >> 1
            less = self._lows(mid) < want[busy]
            low[busy] = np.where(less, mid + 1, low[busy])
            top[busy] = np.where(less, top[busy], mid)
            busy = busy[low[busy] < top[busy]]
        return low

    def find(self, values: np.ndarray, begin=None, end=None) -> np.ndarray:
        """Place of each value in [begin, end), -1 if absent."""
        values = np.asarray(values, np.uint64)
        if not self.n or not len(values):
            return np.full(len(values), -1)
        begin, end = np.zeros(len(values), np.int64) if begin is None else begin, np.full(len(values), self.n) if end is None else end
        at = self.search(values, begin, end)
        inside = np.flatnonzero(at < end)
        out = np.full(len(values), -1)
        good = inside[self.access(at[inside]) == values[inside]]
        out[good] = at[good]
        return out


class Level:
    """Sorted members of each of a number of contexts: pointers, and members made monotone over all contexts."""

    def __init__(self, pointers: EliasFano, members: EliasFano):
        self.pointers, self.members = pointers, members

    @classmethod
    def build(cls, starts: np.ndarray, members: np.ndarray) -> Level:
        """starts: first member of each context and, at the end, their number; no context is empty."""
        last = members[starts[1:] - 1].astype(np.uint64) + np.uint64(1)
        base = np.cumsum(last, dtype=np.uint64) - last
        return cls(EliasFano.build(starts), EliasFano.build(members.astype(np.uint64) + np.repeat(base, np.diff(starts))))

    def dump(self) -> bytes:
        return self.pointers.dump() + self.members.dump()

    @classmethod
    def load(cls, data, at: int) -> tuple[Level, int]:
        pointers, at = EliasFano.load(data, at)
        members, at = EliasFano.load(data, at)
        return cls(pointers, members), at

    def find(self, context: np.ndarray, member: np.ndarray) -> np.ndarray:
        """Place of a context's member, by successor search in the context's range; -1 if the context (then -1) or the member is absent."""
        out = np.full(len(context), -1)
        known = np.flatnonzero(context >= 0)
        if not len(known) or not self.members.n:
            return out
        begin, end = (self.pointers.access(context[known] + k).astype(np.int64) for k in (0, 1))
        base = np.where(begin > 0, self.members.access(np.maximum(begin - 1, 0)) + np.uint64(1), np.uint64(0))
        out[known] = self.members.find(base + member[known].astype(np.uint64), begin, end)
        return out


def _mapped(dump: bytes):
    """The bytes, as a memory map of a file that has no name any more, so nothing stays behind."""
    if not dump:
        return dump
    handle, path = tempfile.mkstemp(prefix="gridweave-")
    try:
        with os.fdopen(handle, "r+b") as f:
            f.write(dump)
            f.flush()
            return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    finally:
        os.unlink(path)


class NgramTrie:
    """level 1: contexts u -> level 2: pairs with share and back-off codes -> level 3: triples with share codes. Words are numbers."""

    MAGIC = b"GWEF4\0\0\0"

    def __init__(self, first: EliasFano, second: Level, third: Level, shares2, weights, shares3):
        self.first, self.second, self.third, self.shares2, self.weights, self.shares3 = first, second, third, shares2, weights, shares3

    @classmethod
    def build(cls, u, v, w, counts, words: Numbering, mu2: float, mu3: float) -> NgramTrie:
        """Distinct triples, sorted, with training counts above 0. All of a context's triples are there, but for hot contexts; a w that is no word is counted for its pair only."""
        new = lambda *x: np.flatnonzero(np.concatenate(([True], np.any([a[1:] != a[:-1] for a in x], 0)))) if len(u) else np.empty(0, np.int64)
        pair = new(u, v)
        own = new(u[pair])
        pair_counts = np.add.reduceat(counts, pair) if len(pair) else counts
        per_triple = np.repeat(pair_counts, np.diff(np.append(pair, len(u))))
        context = words.context_counts(u[pair[own]], np.add.reduceat(pair_counts, own) if len(own) else pair_counts)
        context = np.repeat(context, np.diff(np.append(own, len(pair))))
        return cls(
            EliasFano.build(u[pair[own]]), Level.build(np.append(own, len(pair)), v[pair]), Level.build(np.append(pair, len(u)), w),
            quantise(pair_counts / (context + mu2)), quantise(mu3 / (pair_counts + mu3)), np.where(w < words.none, quantise(counts / (per_triple + mu3)), 0).astype(np.uint8),
        )

    def dump(self) -> bytes:
        codes = (self.shares2, self.weights, self.shares3)
        return self.MAGIC + self.first.dump() + self.second.dump() + self.third.dump() + np.array([len(x) for x in codes], "<u8").tobytes() + b"".join(x.tobytes() for x in codes)

    @classmethod
    def load(cls, data) -> NgramTrie:
        if data[:8] != cls.MAGIC:
            raise ValueError("not an n-gram trie")
        first, at = EliasFano.load(data, 8)
        second, at = Level.load(data, at)
        third, at = Level.load(data, at)
        sizes, codes = np.frombuffer(data, "<u8", 3, at).tolist(), []
        at += 24
        for size in sizes:
            codes.append(np.frombuffer(data, np.uint8, size, at))
            at += size
        return cls(first, second, third, *codes)

    def pairs(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Place of each pair in level 2, -1 if absent."""
        return self.second.find(self.first.find(u), v)

    def codes(self, u: int, v: int, w: int) -> tuple[int, int, int]:
        """(pair share, pair weight, triple share) of one triple, for callers outside Spark."""
        one = lambda x: np.array([x], np.int64)
        pair = self.pairs(one(u), one(v))
        if pair[0] < 0:
            return 0, 1, 0
        triple = self.third.find(pair, one(w))
        return int(self.shares2[pair[0]]), int(self.weights[pair[0]]), int(self.shares3[triple[0]]) if triple[0] >= 0 else 0


class Numbering:
    """firsts: the number of each shard's first word, by shard; none: how many words have numbers, which stands for no word; hot, hot_counts: hot words' numbers, ascending, and their counts."""

    def __init__(self, firsts: np.ndarray, none: int, hot: np.ndarray, hot_counts: np.ndarray):
        self.firsts, self.none, self.hot, self.hot_counts = firsts, none, hot, hot_counts

    def hot_places(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among the hot words, whether it is one)."""
        if not len(self.hot):
            return np.zeros(len(numbers), np.int64), np.zeros(len(numbers), bool)
        at = np.minimum(np.searchsorted(self.hot, numbers), len(self.hot) - 1)
        return at, self.hot[at] == numbers

    def context_counts(self, numbers: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The counts of words, where `counts` is right for those that are not hot."""
        at, hot = self.hot_places(numbers)
        return np.where(hot, self.hot_counts[at] if len(self.hot) else 0, counts)


def quantise(share: np.ndarray) -> np.ndarray:
    return (1 + np.clip(np.ceil(-STEP * np.log2(share) - 1e-9), 0, 254)).astype(np.uint8)


SHARES = np.concatenate(([0.0], 2.0 ** (-np.arange(255) / STEP)))


# --- batches --------------------------------------------------------------------------------------

_ENCODED = "batch long, n long, ids binary, missing binary, train binary, lengths binary, tokens binary, vocabulary binary, counts binary"
#: With what level 0 has answered: the numbers of the batch's words, one more than them, so 0 is for words without training, and their counts.
_NUMBERED = "batch long, ids binary, missing binary, train binary, lengths binary, tokens binary, numbers binary, counts binary"


def _encoder(batch_tokens: int):
    def run(batches):
        lex = Lexer(SPACES, lower=True)
        base, seq = TaskContext.get().partitionId() << 24, 0
        held: list[tuple] = []
        size = 0

        def flush():
            ids, missing, train, lengths = (np.concatenate([x[k] for x in held]) for k in range(4))
            tokens = np.concatenate([x[4] for x in held])
            vocabulary, places = np.unique(tokens, return_inverse=True)
            counts = np.bincount(places[np.repeat(train, lengths)], minlength=len(vocabulary))
            row = [base + seq], [len(tokens)], [ids.tobytes()], [missing.tobytes()], [train.tobytes()], [lengths.astype("<i8").tobytes()], [_split32(places)], [vocabulary.tobytes()], [_squeeze(counts.astype("<u4"))]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in row], [x.split()[0] for x in _ENCODED.split(", ")])

        for batch in batches:
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")
            missing, train = (batch.column(k).to_numpy(zero_copy_only=False).astype(bool) for k in (2, 3))
            for first, _, _, _, edge, words in lex.chunks(text_bytes(batch.column(1))):
                n, own = len(edge) - 1, slice(first, first + len(edge) - 1)
                tokens = np.insert(words, edge[1:], END)
                held.append((ids[own], missing[own], train[own], np.diff(edge) + 1, tokens))
                size += len(tokens)
                if size >= batch_tokens and n:
                    yield flush()
                    held, size, seq = [], 0, seq + 1
        if held:
            yield flush()

    return run


def _split32(x: np.ndarray) -> bytes:
    """Compressed 32-bit integers, byte by byte of their places, which compresses better."""
    return _squeeze(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T))


def _join32(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(_expand(x, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _shard_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def _ranges(shards: np.ndarray) -> list[tuple[int, int, int]]:
    """(shard, begin, end) of sorted shard numbers."""
    if not len(shards):
        return []
    new = np.flatnonzero(np.concatenate(([True], shards[1:] != shards[:-1]))).tolist()
    return list(zip(shards[new].tolist(), new, [*new[1:], len(shards)], strict=True))


def _words_out(bits: int):
    def run(batches):
        for batch in batches:
            for key, vocabulary, counts in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                words, counts = np.frombuffer(vocabulary, "<u8"), _expand(counts, "<u4")
                rows = [(s, key, words[a:b].tobytes(), _squeeze(counts[a:b])) for s, a, b in _ranges(_shard_of(words, bits))]
                shard, keys, w, c = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(keys, pa.int64()), pa.array(w), pa.array(c)], ["shard", "batch", "words", "counts"])

    return run


#: kind 0: places and counts of words, 1 and 2: codes of pairs and triples, 9: a stored level or trie (batch -1).
_ANSWERS = "batch long, kind int, shard long, data binary, v long, n long"


def _answer_table(rows) -> pa.Table:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
    columns = list(zip(*rows, strict=True)) if rows else [()] * 6
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["batch", "kind", "shard", "data", "v", "n"])


def _count_words(table: pa.Table) -> pa.Table:
    """Level 0 of a shard; training counts and places of its words, looked up there, back to each batch; the shard's totals."""
    words = [np.frombuffer(x, "<u8") for x in table["words"].to_pylist()]
    counts = [_expand(x, "<u4") for x in table["counts"].to_pylist()]
    every, place = np.unique(np.concatenate(words), return_inverse=True)
    total = np.bincount(place, np.concatenate(counts), len(every)).astype(np.int64)
    trained = total > 0
    level = EliasFano.build(every[trained]).dump() + EliasFano.build(np.concatenate(([0], np.cumsum(total[trained])))).dump()
    rows, shard = [], table["shard"][0].as_py()
    at, found = 0, _pairs_of(*word_places(_mapped(level), every))
    for batch, own in zip(table["batch"].to_pylist(), words, strict=True):
        rows.append((batch, 0, shard, _squeeze(found[place[at : at + len(own)]].T), None, None))
        at += len(own)
    rows.append((-1, 9, shard, level, int(trained.sum()), int(total.sum())))
    return _answer_table(rows)


def _pairs_of(places: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.stack((places, counts), 1).astype("<i8")


def _by_shard(answers: pa.Table):
    """(shard, places, counts) of a batch's words as level 0 has answered; these stand by hash, so by shard."""
    answers = answers.sort_by("shard")
    for shard, data in zip(answers["shard"].to_pylist(), answers["data"].to_pylist(), strict=True):
        yield shard, *_expand(data, "<i8").reshape(2, -1)


def _numbered(shared):
    """A batch with the numbers and counts of its words."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        firsts, numbers, counts = shared.value.firsts, [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for shard, place, count in _by_shard(right):
            numbers.append(np.where(place >= 0, place + firsts[shard] + 1, 0))
            counts.append(count)
        kept = left.select([x.split()[0] for x in _NUMBERED.split(", ")[:-2]])
        for name, data in (("numbers", _split32(np.concatenate(numbers))), ("counts", _squeeze(np.concatenate(counts)))):
            kept = kept.append_column(name, pa.array([data] * len(kept), pa.binary()))
        return kept

    return run


def _hot_words(least: int):
    """(place, count) of the words of stored level 0 shards with more than `least` mentions."""

    def run(batches):
        for batch in batches:
            for shard, level in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums, _ = EliasFano.load(level, EliasFano.load(level, 0)[1])
                counts = np.diff(sums.access(np.arange(sums.n)).astype(np.int64))
                places = np.flatnonzero(counts > least)
                yield pa.RecordBatch.from_pydict({"shard": np.full(len(places), shard), "place": places, "count": counts[places]})

    return run


def numbering(levels: DataFrame, n: int, bits: int) -> Numbering:
    """From stored levels (shard, data, v): a number for each shard, and at most HOT hot words, come to the driver."""
    sizes = np.zeros(1 << bits, np.int64)
    for r in levels.select("shard", "v").collect():
        sizes[r["shard"]] = r["v"]
    firsts, none = np.cumsum(sizes) - sizes, int(sizes.sum())
    if none > MOST_WORDS:
        raise ValueError(f"{none} distinct words, more than {MOST_WORDS}")
    rows = levels.select("shard", "data").mapInArrow(_hot_words(n // HOT), "shard long, place long, count long").collect()
    hot = sorted((int(firsts[r["shard"]]) + r["place"], r["count"]) for r in rows)
    return Numbering(firsts, none, np.array([a for a, _ in hot], np.int64), np.array([c for _, c in hot], np.int64))


def word_places(level, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in level 0 and training counts of words (hashes): a successor search, then the step of the running sums; -1 and 0 for others."""
    keys, at = EliasFano.load(level, 0)
    sums, _ = EliasFano.load(level, at)
    place = keys.find(words)
    out, known = np.zeros(len(words), np.int64), place >= 0
    out[known] = (sums.access(place[known] + 1) - sums.access(place[known])).astype(np.int64)
    return place, out


class _Texts:
    """Texts of a batch: tokens as places among its distinct words, and where each text starts."""

    def __init__(self, row: dict):
        self.lengths, self.train = np.frombuffer(row["lengths"], "<i8"), np.frombuffer(row["train"], bool)
        self.tokens = _join32(row["tokens"]).astype(np.int32)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def total(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, self.starts)

    def columns(self, row: dict, counts: np.ndarray, own: np.ndarray) -> dict:
        """The columns that level 0 decides, from the training counts and base probabilities of the batch's words."""
        ids = pa.array(np.frombuffer(row["ids"], "<i8"), mask=np.frombuffer(row["missing"], bool))
        known, base = (counts > 0).astype(np.int64), np.log10(own)
        return {"doc_id": ids, "held_out": ~self.train, "n_tokens": self.lengths, "n_known": self.total(known[self.tokens]), "base_score": self.total(base[self.tokens])}


def base_of(counts: np.ndarray, v: int, n: int) -> np.ndarray:
    return (counts + 0.1) / (n + 0.1 * (v + 1))


class _Tree(_Texts):
    """Distinct pairs and triples of a batch in the order in which they are sent, and how its tokens map to them.

    Token i belongs to the triple of the token before it, itself and the one after it; its pair is that triple's first two. Only pairs of two training
    words are sent; another word, or nothing, as third gives the number after the last, so that pairs count right.
    """

    def __init__(self, row: dict, words: Numbering, bits: int):
        super().__init__(row)
        size = words.none + 1
        self.before = np.empty_like(self.tokens)
        self.before[1:] = self.tokens[:-1]
        self.before[self.starts] = 0  # the end token, whose hash is the least
        numbers = (_join32(row["numbers"]) - 1).astype(np.int32)
        at = numbers[self.tokens]
        valid = np.flatnonzero((at >= 0) & (numbers[self.before] >= 0)).astype(np.int32)
        after = np.append(at[1:], np.int32(-1))
        after[self.starts + self.lengths - 1] = -1
        after = np.where(after >= 0, after, size - 1)[valid]
        keys = numbers[self.before[valid]].astype(np.int64)
        keys *= size
        keys += at[valid]
        del at
        keys, pair = np.unique(keys, return_inverse=True)
        triples = pair * size
        triples += after
        pair = pair.astype(np.int32)
        del after
        triples, triple = np.unique(triples, return_inverse=True)
        triple = triple.astype(np.int32)
        counts = np.bincount(triple[np.repeat(self.train, self.lengths)[valid]], minlength=len(triples)).astype(np.int32)
        u, v = keys // size, keys % size
        hashed, (_, is_hot) = mix(u.astype(np.uint64) + np.uint64(1)), words.hot_places(u)
        shard = _shard_of(np.where(is_hot, mix(hashed ^ v.astype(np.uint64)), hashed), bits)
        del hashed, keys
        order = np.lexsort((v, u, shard, is_hot))
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        self.u, self.v, self.shard, self.cut = u[order], v[order], shard[order], int(len(order) - is_hot.sum())
        above = rank[triples // size]
        sent = np.argsort(above, kind="stable")
        place = np.empty(len(sent), np.int32)
        place[sent] = np.arange(len(sent), dtype=np.int32)
        self.w, self.counts, self.pair_of = (triples % size)[sent], counts[sent], above[sent]
        self.pair, self.triple = np.full(len(self.tokens), -1, np.int32), np.full(len(self.tokens), -1, np.int32)  # of each token
        self.pair[valid], self.triple[valid] = rank[pair], place[triple]

    def messages(self):
        """(shard, kind, steps of u, v, triples of each pair, w, counts)."""
        first = np.searchsorted(self.pair_of, np.arange(len(self.u) + 1))
        for kind, low, high in ((1, 0, self.cut), (2, self.cut, len(self.u))):
            for shard, a, b in _ranges(self.shard[low:high]):
                a, b = a + low, b + low
                i, j = first[a], first[b]
                yield shard, kind, _split32(np.diff(self.u[a:b], prepend=0)), _split32(self.v[a:b]), _split32(np.diff(first[a : b + 1])), _split32(self.w[i:j]), _squeeze(self.counts[i:j].astype("<u4"))


_MESSAGES = "shard long, batch long, kind int, u binary, v binary, runs binary, w binary, counts binary"


def _ngrams_out(bits: int, shared):
    kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 5]

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                rows = [(shard, row["batch"], kind, *rest) for shard, kind, *rest in _Tree(row, shared.value, bits).messages()]
                for at in range(0, len(rows), 64):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[at : at + 64], strict=True), kinds, strict=True)], [x.split()[0] for x in _MESSAGES.split(", ")])

    return run


def _answer_ngrams(shared, mu2: float, mu3: float):
    def run(table: pa.Table) -> pa.Table:
        rows, words = table.select(["batch", "kind", "shard"]).to_pylist(), shared.value
        size = words.none + 1
        column = lambda name: [_join32(x) for x in table[name].to_pylist()]
        u, v = [np.cumsum(x) for x in column("u")], column("v")
        sizes = [len(x) for x in u]
        pair_keys, pair = np.unique(np.concatenate(u) * size + np.concatenate(v), return_inverse=True)
        del u, v
        runs, w = np.concatenate(column("runs")), column("w")
        triple_sizes = [len(x) for x in w]
        triple_keys, triple = np.unique(np.repeat(pair, runs) * size + np.concatenate(w), return_inverse=True)
        del w, runs
        counts = np.bincount(triple, np.concatenate([_expand(x, "<u4") for x in table["counts"].to_pylist()]), len(triple_keys)).astype(np.int64)
        pu, pv = pair_keys // size, pair_keys % size
        tp, tw = triple_keys // size, triple_keys % size
        seen = np.flatnonzero(counts)
        dump = NgramTrie.build(pu[tp[seen]], pv[tp[seen]], tw[seen], counts[seen], words, mu2, mu3).dump()
        trie = NgramTrie.load(_mapped(dump))
        share, weight, third = np.zeros(len(pu), np.uint8), np.ones(len(pu), np.uint8), np.zeros(len(tp), np.uint8)
        at = np.empty(len(pu), np.int64)
        for i in range(0, len(pu), _LOOKUPS):
            at[i : i + _LOOKUPS] = trie.pairs(pu[i : i + _LOOKUPS], pv[i : i + _LOOKUPS])
        known = np.flatnonzero(at >= 0)
        share[known], weight[known] = trie.shares2[at[known]], trie.weights[at[known]]
        asked = np.flatnonzero(at[tp] >= 0)
        for i in range(0, len(asked), _LOOKUPS):
            k = asked[i : i + _LOOKUPS]
            found = trie.third.find(at[tp[k]], tw[k])
            held = found >= 0
            third[k[held]] = trie.shares3[found[held]]
        out, a, b = [(-1, 9, rows[0]["shard"], dump, None, None)], 0, 0
        for r, m, n in zip(rows, sizes, triple_sizes, strict=True):
            p, t = pair[a : a + m], triple[b : b + n]
            out.append((r["batch"], r["kind"], r["shard"], _squeeze(np.concatenate((np.array([m], "<u4").view(np.uint8), share[p], weight[p], third[t]))), None, None))
            a, b = a + m, b + n
        return _answer_table(out)

    return run


#: Lookups that are made at once.
_LOOKUPS = 1 << 16


def _score(bits: int, shared, v: int, n: int, mu2: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        right = right.sort_by([("kind", "ascending"), ("shard", "ascending")])
        parts: list[list[np.ndarray]] = [[], [], []]
        for x in right["data"].to_pylist():
            data = _expand(x, np.uint8)
            m = int(data[:4].view("<u4")[0])
            for part, piece in zip(parts, np.split(data[4:], (m, 2 * m)), strict=True):
                part.append(piece)
        for row in left.to_pylist():
            tree, counts = _Tree(row, shared.value, bits), _expand(row["counts"], "<i8")
            # place -1: a pair or triple that was not sent
            share, weight, third = (SHARES[np.concatenate([*x, np.array([c], np.uint8)])] for x, c in zip(parts, (0, 1, 0), strict=True))
            own = base_of(counts, v, n)  # of each word of the batch
            rest = mu2 / (counts + mu2)
            base = own[tree.tokens]
            p = rest[tree.before]
            p *= base
            p += share[tree.pair]
            w = np.ones(len(p))  # a token's trigram is the triple of the token before it; a first token has none
            w[1:] = weight[tree.pair[:-1]]
            w[tree.starts] = 1
            p *= w
            w[0], w[1:] = 0, third[tree.triple[:-1]]
            w[tree.starts] = 0
            p += w
            del w
            out.append(pa.table(tree.columns(row, counts, own) | {"score": tree.total(np.log10(p))}))
        return pa.concat_tables(out) if out else _NO_SCORES

    return run


_BASE = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double"
_NO_SCORES = pa.table([pa.array([], x) for x in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())], names=[x.split()[0] for x in _BASE.split(", ")] + ["score"])


def _base(v: int, n: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        counts = np.concatenate([np.empty(0, np.int64), *(x for _, _, x in _by_shard(right))])
        out = [pa.table(_Texts(row).columns(row, counts, base_of(counts, v, n))) for row in left.to_pylist()]
        return pa.concat_tables(out) if out else _NO_SCORES.drop_columns("score")

    return run


class Scored:
    """scores: (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score). words, tries: the stored model, (shard, data); a word's number is its place in its shard's level and numbering.firsts of the shard."""

    def __init__(self, scores: DataFrame, words: DataFrame, tries: DataFrame, numbering: Numbering):
        self.scores, self.words, self.tries, self.numbering = scores, words, tries, numbering


def _count(docs: DataFrame, train, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, int, int, int]:
    """Batches of encoded texts, level 0 and its answers to them, bits of a shard's number, V and N."""
    spark = docs.sparkSession
    learns = crc_of_id(F.col(id_col)) % 10 != 0 if train is None else train
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(id_col).isNull().alias("missing"), F.coalesce(learns, F.lit(True)).alias("train"))
    encoded = materialise(rows.mapInArrow(_encoder(BATCH_TOKENS), _ENCODED), "encoded")
    size = encoded.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = max(1, (2 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // SHARD_TOKENS) - 1).bit_length())
    words = encoded.select("batch", "vocabulary", "counts").mapInArrow(_words_out(bits), "shard long, batch long, words binary, counts binary")
    counted = materialise(words.groupBy("shard").applyInArrow(_count_words, _ANSWERS), "words")
    v, n = counted.where("batch < 0").agg(F.coalesce(F.sum("v"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    return encoded, counted, bits, v, n


def _answered(encoded: DataFrame, counted: DataFrame, task, schema: str) -> DataFrame:
    """Batches worked on with level 0's answers to them."""
    answers = counted.where("batch >= 0").select("batch", "shard", "data")
    return encoded.drop("n", "vocabulary", "counts").groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(task, schema)


def fit_and_score(docs: DataFrame, train=None, mu2: float = MU2, mu3: float = MU3, id_col: str = "doc_id", text_col: str = "text") -> Scored:
    """train: a condition on docs; by default crc32(id) mod 10 is not 0."""
    with scope():  # the texts' hashes and level 0's answers go when each batch has its numbers
        encoded, counted, bits, v, n = _count(docs, train, id_col, text_col)
        levels = materialise(counted.where("batch < 0").select("shard", "data", "v", "n"), "levels", outer=True)
        known = numbering(levels, n, bits)
        shared = docs.sparkSession.sparkContext.broadcast(known)
        batches = materialise(_answered(encoded, counted, _numbered(shared), _NUMBERED), "numbered", outer=True)
    sent = batches.select("batch", "train", "lengths", "tokens", "numbers").mapInArrow(_ngrams_out(bits, shared), _MESSAGES)
    codes = materialise(sent.groupBy("shard").applyInArrow(_answer_ngrams(shared, mu2, mu3), _ANSWERS), "codes")
    answers = codes.where("batch >= 0").select("batch", "kind", "shard", "data")
    found = batches.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_score(bits, shared, v, n, mu2), f"{_BASE}, score double")
    scores = found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
    return Scored(scores, levels.select("shard", "data"), codes.where("batch < 0").select("shard", "data"), known)


def score(docs: DataFrame, train=None, mu2: float = MU2, mu3: float = MU3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return fit_and_score(docs, train, mu2, mu3, id_col, text_col).scores


def base_score(docs: DataFrame, train=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of score() but the last: level 0 decides them, so pairs and triples are neither sent nor stored."""
    encoded, counted, _, v, n = _count(docs, train, id_col, text_col)
    found = _answered(encoded, counted, _base(v, n), _BASE)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read_table(spark, sf_dir, "documents"))


def base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op2 SQL can express: the counts and the base."""
    return base_score(read_table(spark, sf_dir, "documents")).withColumn("base_score", F.round("base_score", 6))


BASE_SQL = r"""
WITH table_of AS (
  SELECT list(v ORDER BY n) AS t FROM (SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS r(n))),
d AS (
  SELECT doc_id, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ord(substr(doc_id::VARCHAR, i, 1))::BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 10 = 0 AS held_out,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents, table_of),
tok AS (SELECT doc_id, held_out, unnest(list_append(w, '')) AS t FROM d),
c AS (SELECT t, count(*) AS c FROM tok WHERE NOT held_out GROUP BY t),
n AS (SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c.c) AS n_known, n.n AS train_tokens, round(sum(log10((coalesce(c.c, 0) + CAST(0.1 AS DOUBLE)) / (n.n + CAST(0.1 AS DOUBLE) * (n.v + 1)))), 6) AS base_score
FROM tok LEFT JOIN c ON tok.t = c.t, n GROUP BY doc_id, held_out, n.n
"""

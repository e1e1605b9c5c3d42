"""Token output as wavelet matrices: one compressed file per shard.

A shard holds the ids of consecutive documents as bit-planes, the most significant first; each plane stably
parts the sequence of the plane above into zeros, then ones. Each plane has a stored directory: ones before every 4096 bits (32-bit), ones
since then before every 64 bits (16-bit), for rank; the word that holds every 2048th one, and every 2048th zero, for select.
Token access, counting and occurrence lookup take a constant number of steps per plane on the packed bits; reading back whole shards undoes the parting plane by plane, from the lowest up.

File format, little-endian: b"GWWM2\0", then uint32 planes, uint64 documents, uint64 tokens, uint64 zeros of each
plane, int64 document ids (the least integer: null), uint64 document ends, then per plane the packed bits (64-bit words) and its four
directory arrays, each as uint64 size and that many bytes compressed by zstd.

Files are kept as rows (shard, content) of a Parquet table, so that Spark's committer writes them and any store
that Spark can reach may hold them. Shards follow ascending document ids, nulls first; repeated ids keep rows of their own.
A null text counts as empty. An empty table gives no shards and an empty result.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import materialise, read_table
from .tokenizing import encoder

MAGIC = b"GWWM2\0"
END_ID = 2
#: Tokens after which a shard is closed; positions that reading back looks up at once.
SHARD_TOKENS, BLOCK = 1 << 21, 1 << 17
#: Bits of a directory's large step; ones or zeros between samples for select.
LARGE, SAMPLE = 4096, 2048
_NULL = np.iinfo(np.int64).min
_WORDS = LARGE // 64


def _byte_selects() -> np.ndarray:
    """Place of the k-th one of each byte: 256 rows of 8, 8 where there are not so many."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(bool)
    out = np.full((256, 8), 8, np.uint8)
    row, place = np.nonzero(bits)
    out[row, (np.cumsum(bits, 1) - 1)[bits]] = place
    return out


_SELECT8 = _byte_selects()


class Plane:
    """Packed bits with directories for rank and select. All lookups are vectorised over positions."""

    __slots__ = ("words", "large", "small", "ones_at", "zeros_at", "_upto")

    def __init__(self, words, large, small, ones_at, zeros_at):
        self.words, self.large, self.small, self.ones_at, self.zeros_at = words, large, small, ones_at, zeros_at
        self._upto = None

    @classmethod
    def build(cls, bits: np.ndarray) -> Plane:
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros(-(-len(bits) // 64) + 1, "<u8")  # one more, so that rank at the end reads a word
        words.view(np.uint8)[: len(packed)] = packed
        before = np.concatenate(([0], np.cumsum(np.bitwise_count(words[:-1]), dtype=np.int64)))
        large = before[::_WORDS]
        small = before - np.repeat(large, _WORDS)[: len(words)]
        ones_at = np.searchsorted(before, np.arange(0, int(before[-1]), SAMPLE), side="right") - 1
        zeros = 64 * np.arange(len(words)) - before
        zeros_at = np.searchsorted(zeros, np.arange(0, len(bits) - int(before[-1]), SAMPLE), side="right") - 1
        return cls(words, large.astype("<u4"), small.astype("<u2"), ones_at.astype("<u4"), zeros_at.astype("<u4"))

    def parts(self) -> tuple[np.ndarray, ...]:
        return self.words, self.large, self.small, self.ones_at, self.zeros_at

    def upto(self) -> np.ndarray:
        """Ones up to each word's end, from both steps of the directory; kept once asked for, for runs of many ranks."""
        if self._upto is None:
            before = np.repeat(self.large, _WORDS)[: len(self.words)].astype(np.int32)
            before += self.small
            before += np.bitwise_count(self.words)
            self._upto = before
        return self._upto

    def bit_and_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bit at each position, and the ones before it: those up to its word's end without those from it on."""
        word = at >> 6
        rest = self.words.take(word)
        rest >>= (at & 63).astype(np.uint64)
        return (rest & np.uint64(1)).astype(bool), self.upto().take(word) - np.bitwise_count(rest)

    def rank(self, at) -> np.ndarray:
        return self.bit_and_rank(np.asarray(at, np.int64))[1]

    def select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Position of the k-th one or zero, from 0. The sample bounds the words that are halved."""
        k = np.asarray(k, np.int64)
        sample = self.ones_at if one else self.zeros_at
        low = sample[k // SAMPLE].astype(np.int64)
        high = np.append(sample, len(self.words) - 1)[k // SAMPLE + 1].astype(np.int64) + 1
        while (high - low > 1).any():  # the last word with at most k before it
            mid = (low + high) >> 1
            ones = self.large[mid >> 6].astype(np.int64) + self.small[mid]
            below = (ones if one else 64 * mid - ones) <= k
            low, high = np.where(below, mid, low), np.where(below, high, mid)
        ones = self.large[low >> 6].astype(np.int64) + self.small[low]
        rest = k - (ones if one else 64 * low - ones)
        word = self.words[low] if one else ~self.words[low]
        octets = np.ascontiguousarray(word, "<u8").view(np.uint8).reshape(-1, 8)
        reach = np.cumsum(np.bitwise_count(octets), 1, dtype=np.int64)
        octet = (reach <= rest[:, None]).sum(1)
        row = np.arange(len(k))
        rest -= np.where(octet > 0, reach[row, np.maximum(octet - 1, 0)], 0)
        return 64 * low + 8 * octet + _SELECT8[octets[row, octet], rest]


class WaveletMatrix:
    """Sequence of integers below 2**planes."""

    def __init__(self, n: int, zeros: list[int], levels: list[Plane]):
        self.n, self.zeros, self.levels, self.planes = n, zeros, levels, len(zeros)

    @classmethod
    def build(cls, ids: np.ndarray, planes: int) -> WaveletMatrix:
        if len(ids) and int(ids.max()) >> planes:
            raise ValueError(f"an id needs more than {planes} bits")
        rows, zeros, levels = ids.astype(np.uint16 if planes <= 16 else np.uint32), [], []
        for plane in range(planes - 1, -1, -1):
            ones = ((rows >> plane) & 1).astype(bool)
            levels.append(Plane.build(ones))
            order = np.flatnonzero(~ones), np.flatnonzero(ones)
            zeros.append(len(order[0]))
            rows = rows.take(np.concatenate(order), mode="clip")
        return cls(len(ids), zeros, levels)

    def access(self, at) -> np.ndarray:
        """Tokens at the given positions: one rank a plane."""
        at = np.asarray(at).astype(np.int32 if self.n < 1 << 31 else np.int64)
        out = np.zeros(np.shape(at), np.uint32)
        for zeros, level in zip(self.zeros, self.levels, strict=True):
            one, rank = level.bit_and_rank(at)
            out += out
            out += one
            at = np.where(one, rank + at.dtype.type(zeros), at - rank)
        return out

    def blocks(self, size: int | None = None):
        """The whole sequence, in order, `size` positions at a time."""
        size = size or BLOCK
        for a in range(0, self.n, size):
            yield self.access(np.arange(a, min(a + size, self.n)))

    def sequence(self) -> np.ndarray:
        """The whole sequence, in order: from the lowest plane up, each plane's bits say which tokens of the plane below come next, the zeros' or the ones'."""
        out = np.zeros(self.n, np.uint16 if self.planes <= 16 else np.uint32)
        for plane, (zeros, level) in enumerate(zip(reversed(self.zeros), reversed(self.levels), strict=True)):
            ones = np.unpackbits(level.words.view(np.uint8), count=self.n, bitorder="little").view(bool)
            below, out = out, np.empty_like(out)
            out[~ones] = below[:zeros]
            out[ones] = below[zeros:] | out.dtype.type(1 << plane)
        return out.astype(np.uint32)

    def _down(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        for k, level in enumerate(self.levels):
            a, b = level.rank([lo, hi]).tolist()
            lo, hi = (self.zeros[k] + a, self.zeros[k] + b) if (token >> (self.planes - 1 - k)) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of token in [lo, hi)."""
        if token >> self.planes:
            return 0
        a, b = self._down(token, lo, self.n if hi is None else hi)
        return b - a

    def occurrences(self, token: int, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """All positions of token in [lo, hi), ascending: down by rank, and up by select."""
        if token >> self.planes:
            return np.empty(0, np.int64)
        return self._up(token, np.arange(*self._down(token, lo, self.n if hi is None else hi)))

    def _up(self, token: int, at: np.ndarray) -> np.ndarray:
        for plane in range(self.planes - 1, -1, -1):
            one = bool((token >> (self.planes - 1 - plane)) & 1)
            at = self.levels[plane].select(at - self.zeros[plane] if one else at, one)
        return at

    def select(self, token: int, k: int) -> int:
        """Position of occurrence k, from 0; -1 if there are not so many."""
        if token >> self.planes or k < 0:
            return -1
        lo, hi = self._down(token, 0, self.n)
        return int(self._up(token, np.array([lo + k]))[0]) if lo + k < hi else -1


def write_shard(doc_ids: np.ndarray, ends: np.ndarray, ids: np.ndarray, planes: int) -> bytes:
    matrix, squeeze = WaveletMatrix.build(ids, planes), zstandard.ZstdCompressor(level=1).compress
    parts = [MAGIC, struct.pack("<IQQ", planes, len(doc_ids), len(ids)), np.array(matrix.zeros, "<u8").tobytes(), doc_ids.astype("<i8").tobytes(), ends.astype("<u8").tobytes()]
    for level in matrix.levels:
        for part in level.parts():
            body = squeeze(part.tobytes())
            parts += [struct.pack("<Q", len(body)), body]
    return b"".join(parts)


def read_shard(content: bytes) -> tuple[np.ndarray, np.ndarray, WaveletMatrix]:
    """(document ids, document ends, matrix) of a file."""
    if content[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token shard")
    at = len(MAGIC)
    planes, docs, tokens = struct.unpack_from("<IQQ", content, at)
    at += 20

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(content, kind, n, at)
        at += 8 * n
        return out

    zeros, doc_ids, ends, levels = take("<u8", planes).tolist(), take("<i8", docs), take("<u8", docs).astype(np.int64), []
    expand = zstandard.ZstdDecompressor().decompress
    for _ in range(planes):
        parts = []
        for kind in ("<u8", "<u4", "<u2", "<u4", "<u4"):
            (size,) = struct.unpack_from("<Q", content, at)
            parts.append(np.frombuffer(expand(content[at + 8 : at + 8 + size]), kind))
            at += 8 + size
        levels.append(Plane(*parts))
    return doc_ids, ends, WaveletMatrix(tokens, zeros, levels)


def _writer(tokenizer: str, end_id: int, shard_tokens: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encode = encoder(tokenizer)
        planes = max(1, int(max(encode.tokenizer.get_vocab_size() - 1, end_id)).bit_length())
        base, names, ends, blobs, total, seq = TaskContext.get().partitionId() << 24, [], [], [], 0, 0

        def shard():
            content = write_shard(np.array(names, np.int64), np.array(ends, np.int64), np.frombuffer(b"".join(blobs), "<u4"), planes)
            return pa.RecordBatch.from_pydict({"shard": [base + seq], "n_docs": [len(names)], "n_tokens": [total], "content": [content]})

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode.encode(text or "") + end
                names.append(_NULL if doc_id is None else doc_id)
                blobs.append(ids)
                total += len(ids) // 4
                ends.append(total)
                if total >= shard_tokens:
                    yield shard()
                    names, ends, blobs, total, seq = [], [], [], 0, seq + 1
        if names:
            yield shard()

    return run


def _reader(batches):
    for batch in batches:
        for shard, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            doc_ids, ends, matrix = read_shard(content)
            ids = memoryview(matrix.sequence().astype("<u4").tobytes())
            starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
            crcs = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict(
                {"shard": pa.array(np.full(len(ends), shard)), "doc_id": pa.array(doc_ids, mask=doc_ids == _NULL), "inner": starts, "n_tokens": ends - starts, "ids_crc32": pa.array(crcs, pa.int64())}
            )


def write_shards(docs: DataFrame, tokenizer: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written shards: (shard, n_docs, n_tokens, content), shard ids ascending with document ids."""
    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return materialise(ordered.mapInArrow(_writer(tokenizer, end_id, shard_tokens), "shard long, n_docs long, n_tokens long, content binary"), "shards")


def read_documents(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the shards' contents."""
    sizes = shards.select("shard", "n_tokens", F.shiftright("shard", 30).alias("block"))  # 64 partitions each
    blocks = sizes.groupBy("block").agg(F.sum("n_tokens").alias("size"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("block", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("block_start"))
    inside = Window.partitionBy("block").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(blocks, "block").select("shard", (F.col("block_start") + F.col("inside")).alias("shard_start"))
    rows = shards.select("shard", "content").mapInArrow(_reader, "shard long, doc_id long, inner long, n_tokens long, ids_crc32 long")
    return rows.join(starts, "shard").select("doc_id", (F.col("shard_start") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def _counter(tokens):
    def run(batches):
        for batch in batches:
            rows = []
            for content in batch.column(0).to_pylist():
                doc_ids, ends, matrix = read_shard(content)
                edges = np.concatenate(([0], ends))
                for token in tokens:
                    places = np.searchsorted(edges, matrix.occurrences(token), side="right") - 1
                    own, counts = np.unique(places, return_counts=True)
                    rows += [(None if doc_ids[d] == _NULL else int(doc_ids[d]), token, int(c)) for d, c in zip(own.tolist(), counts.tolist(), strict=True)]
            doc, token, n = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(token, pa.int64()), pa.array(n, pa.int64())], ["doc_id", "token", "n"])

    return run


def token_counts(shards: DataFrame, tokens: list[int]) -> DataFrame:
    """(doc_id, token, n): how often documents hold each of a few tokens, by occurrence lookup in the shards."""
    return shards.select("content").mapInArrow(_counter([int(t) for t in tokens]), "doc_id long, token long, n long")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_documents(write_shards(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))

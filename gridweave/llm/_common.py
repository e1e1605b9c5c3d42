"""Shared pieces: reading of tables, and a vectorised word lexer."""

from __future__ import annotations

import ctypes
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import batch_bytes, free_name, materialise, numbered, quoted, quotes, release, scope, shared_dir, stage_tables  # noqa: F401  the operators take them from here

#: White space of the contracts: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACES = b" \t\n\x0b\x0c\r"

def drop_encoders() -> None:
    """Drops the encoders and caches that tokenizing has left in this worker process, 100 MB and more: Spark hands the process on to tasks of other operators, which would hold them beside their own."""
    tokenizing = sys.modules.get(f"{__package__}.tokenizing")
    if tokenizing:
        tokenizing.encoder.cache_clear()
    give_back()


def give_back() -> None:
    """Returns memory that this worker process has freed, but that Arrow's pool and the allocator keep (110 and 33 MB after 58,000 texts): a process waits idle for its next task, of whatever stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def tidied(run):
    """run, a task's function over batches, without what earlier tasks have left in its worker process, and leaving little there itself."""

    def task(batches):
        drop_encoders()
        yield from run(batches)
        give_back()

    return task


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(column):
    """Lower-cases A-Z only, as the contracts ask; lower() would also change other letters."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(column, upper, upper.lower())


def crc_of_id(column):
    """crc32 of an id written as text."""
    return F.crc32(column.cast("string").cast("binary"))


# --- vectorised lexer -------------------------------------------------------------------------

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Odd multipliers, one per place of a word in a shingle or window.
PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


def _pows(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) <= n:
        size = 1 << max(20, int(n).bit_length())
        base, inverse = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 2**64), np.uint64)
        base[0] = inverse[0] = 1
        _powers[:] = [np.cumprod(base, dtype=np.uint64), np.cumprod(inverse, dtype=np.uint64)]
    return _powers[0], _powers[1]


class Lexer:
    """Splits UTF-8 texts into words and hashes each word to 64 bits, all in numpy.

    separators: the bytes between words. lower: A-Z count as a-z. Words never span texts. A word's
    hash is a polynomial in random byte values, finished by a bijective mixer.
    """

    #: Bytes of text that are worked on at once, unless one text alone is longer.
    CHUNK = 1 << 20

    def __init__(self, separators: bytes, lower: bool):
        self.inside = np.ones(256, bool)
        self.inside[list(separators)] = False
        self.values = _BYTE.copy()
        if lower:
            self.values[65:91] = self.values[97:123]

    def chunks(self, texts: list[bytes]):
        """Yields (first text, bytes, word starts, word ends, first word of each text and the end, hashes)."""
        i = 0
        while i < len(texts):
            j, total = i, 0
            while j < len(texts) and (j == i or total + len(texts[j]) <= self.CHUNK):
                total += len(texts[j])
                j += 1
            yield (i, *self.words(texts[i:j]))
            i = j

    def words(self, texts: list[bytes]):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        edges = np.concatenate(([0], np.cumsum(sizes)))
        data = np.frombuffer(b"".join(texts), np.uint8)
        n = len(data)
        if not n:
            none = np.empty(0, np.int64)
            return data, none, none, np.zeros(len(texts) + 1, np.int64), np.empty(0, np.uint64)
        inside = self.inside[data]
        cut = np.zeros(n + 1, bool)
        cut[edges] = True
        first = inside.copy()
        first[1:] &= ~inside[:-1] | cut[1:n]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | cut[1:n]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        power, inverse = _pows(n)
        run = np.zeros(n + 1, np.uint64)
        np.cumsum(self.values[data] * power[:n], dtype=np.uint64, out=run[1:])
        hashes = mix((run[ends] - run[starts]) * inverse[starts])
        return data, starts, ends, np.searchsorted(starts, edges), hashes


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of all runs of `size` consecutive words, over text edges too: callers cut those."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n] * PLACE[0]
    for k in range(1, size):
        out += hashes[k : k + n] * PLACE[k]
    return mix(out)


def text_bytes(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow column of strings; null gives b''."""
    return [x or b"" for x in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]

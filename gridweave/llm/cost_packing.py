"""Cost-balanced packing of tokenised documents into sequences of bounded length.

A piece of L tokens costs LINEAR * L + QUADRATIC * L * L, what a transformer's layers and its attention inside the piece take. A leaf
(about LEAF_TOKENS tokens of one input partition) opens as many sequences of `capacity` as its tokens fill, and gives its pieces, in descending order
of cost, to the sequence of the lowest cost that still has free places; what does not fit there goes on to the next one, so every sequence
is filled to its last place. Documents longer than the capacity are first cut into whole sequences and a rest.

The last tokens of a leaf, fewer than one sequence, go on to the partition's next leaf. Those of the partitions travel up a tree: nodes pack the rests of
FAN partitions each, and theirs are packed in turn until one node is left. Its rest becomes sequences whose lengths are powers of two, which
need no padding. So no sequence is padded, and at most log2(capacity) of all are shorter than the capacity. A node holds fewer than
FAN * capacity tokens, whatever the input's size.

Null texts count as empty: the document is its end token alone. Repeated rows and null ids are packed as rows of their own. An
empty table gives an empty result. Very long texts become many full pieces. Other columns of the input are not touched.
"""

from __future__ import annotations

import heapq
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialise, read_table
from .tokenizing import encoder

CAPACITY = 2048
END_ID = 1
#: Cost of a token, and of a pair of tokens of one piece: attention against the rest of a layer of width 2,048 (4 * L against 24 * width).
LINEAR, QUADRATIC = 1.0, 1 / 12288
#: Tokens that a leaf packs at once, about; rests that one node of the tree packs.
LEAF_TOKENS, FAN = 2_000_000, 256

_FIELDS = [
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()),
    ("offset", pa.int64()), ("sequence_cost", pa.float64()), ("leaf", pa.int64()), ("ids", pa.binary()),
]
_SCHEMA = pa.schema(_FIELDS)
_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_cost double, leaf long, ids binary"

#: A piece: (document, tokens before it, tokens of the document, its ids as bytes).
Piece = tuple[int | None, int, int, bytes]


def balanced(pieces: list[Piece], rooms: list[int], linear: float = LINEAR, quadratic: float = QUADRATIC) -> tuple[list[list[Piece]], list[float], list[Piece]]:
    """(pieces of each sequence, cost of each sequence, what is left): fills sequences with `rooms` free places each, the costliest pieces first."""
    filled: list[list[Piece]] = [[] for _ in rooms]
    costs, free = [0.0] * len(rooms), list(rooms)
    heap = [(0.0, k) for k in range(len(rooms)) if rooms[k]]
    waiting = sorted(pieces, key=lambda p: -len(p[3]))
    for at, piece in enumerate(waiting):
        doc, start, total, ids = piece
        while ids and heap:
            _, k = heap[0]
            size = min(free[k], len(ids) // 4)
            filled[k].append((doc, start, total, ids[: 4 * size]))
            costs[k] += linear * size + quadratic * size * size
            free[k] -= size
            if free[k]:
                heapq.heapreplace(heap, (costs[k], k))
            else:
                heapq.heappop(heap)
            start, ids = start + size, ids[4 * size :]
        if not heap:
            return filled, costs, [*([(doc, start, total, ids)] if ids else []), *waiting[at + 1 :]]
    return filled, costs, []


class Packer:
    """Gathers pieces and writes rows of filled sequences, numbered from `first`."""

    def __init__(self, capacity: int, first: int, keep_ids: bool):
        self.capacity, self.number, self.keep_ids = capacity, first, keep_ids
        self.pieces: list[Piece] = []
        self.tokens = 0
        self.rows: list[tuple] = []

    def add(self, doc, start: int, total: int, ids: bytes) -> None:
        """Whole sequences of a long piece go out at once; the rest waits."""
        full = 4 * self.capacity
        while len(ids) > full:
            self._put([[(doc, start, total, ids[:full])]], [LINEAR * self.capacity + QUADRATIC * self.capacity**2])
            start, ids = start + self.capacity, ids[full:]
        if ids:
            self.pieces.append((doc, start, total, ids))
            self.tokens += len(ids) // 4

    def _put(self, sequences, costs) -> None:
        for own, cost in zip(sequences, costs, strict=True):
            offset = 0
            for doc, start, total, ids in own:
                size = len(ids) // 4
                self.rows.append((doc, start, size, zlib.crc32(ids), total, self.number, offset, cost, None, ids if self.keep_ids else None))
                offset += size
            self.number += 1

    def fill(self, last: bool = False) -> None:
        """Packs what waits into whole sequences; at the very last, the rest into powers of two."""
        count, rest = divmod(self.tokens, self.capacity)
        rooms = [self.capacity] * count
        if last:
            rooms += [1 << k for k in range(rest.bit_length()) if rest >> k & 1]
        filled, costs, self.pieces = balanced(self.pieces, rooms)
        self.tokens = sum(len(p[3]) // 4 for p in self.pieces)
        self._put(filled, costs)

    def rest(self, leaf: int) -> None:
        """Rows without a sequence, for the next node."""
        self.rows += [(doc, start, len(ids) // 4, None, total, None, None, None, leaf, ids) for doc, start, total, ids in self.pieces]
        self.pieces = []

    def take(self) -> list[pa.Array]:
        columns = zip(*self.rows, strict=True) if self.rows else [()] * len(_FIELDS)
        out = [pa.array(c, kind) for c, (_, kind) in zip(columns, _FIELDS, strict=True)]
        self.rows = []
        return out


def _leaves(tokenizer: str, capacity: int, end_id: int, keep_ids: bool):
    end = end_id.to_bytes(4, "little")

    def run(batches):
        encode, part = encoder(tokenizer).encode, TaskContext.get().partitionId()
        packer = Packer(capacity, part << 32, keep_ids)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text or "") + end
                packer.add(doc_id, 0, len(ids) // 4, ids)
                if packer.tokens >= LEAF_TOKENS:
                    packer.fill()
                    yield pa.RecordBatch.from_arrays(packer.take(), schema=_SCHEMA)
        packer.fill()
        packer.rest(part)
        yield pa.RecordBatch.from_arrays(packer.take(), schema=_SCHEMA)

    return run


def _node(capacity: int, level: int, last: bool, keep_ids: bool):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("leaf", "ascending"), ("doc_id", "ascending"), ("start", "ascending"), ("doc_tokens", "ascending"), ("ids", "ascending")])  # the same if a task runs again
        node = table["leaf"][0].as_py() // FAN
        packer = Packer(capacity, (level << 56) + (node << 32), keep_ids)
        for row in zip(*(table[c].to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids")), strict=True):
            packer.add(*row)
        packer.fill(last)
        packer.rest(node)
        return pa.Table.from_arrays(packer.take(), schema=_SCHEMA)

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_cost[, ids]): one row per piece. capacity: a power of two."""
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = materialise(chosen.mapInArrow(_leaves(tokenizer, capacity, end_id, keep_ids), _DDL), "pieces")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_cost", *(["ids"] if keep_ids else [])]
    out, level = found.where("sequence_id is not null").select(*columns), 0
    while True:
        rests, level = found.where("sequence_id is null"), level + 1
        leaves = rests.agg(F.max("leaf")).first()[0]
        if leaves is None:
            return out
        last = leaves < FAN
        found = rests.groupBy(F.expr(f"leaf div {FAN}")).applyInArrow(_node(capacity, level, last, keep_ids), _DDL)
        found = materialise(found, "pieces")
        out = out.unionByName(found.where("sequence_id is not null").select(*columns))
        if last:
            return out


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))

"""Hierarchical residual packing of tokenised documents into sequences of bounded length.

Leaf level: every input partition encodes its documents, cuts only those longer than the capacity, and packs its
pieces by best fit, longest first. A sequence is final once its free places are fewer than the fill of the emptiest
sequence anywhere, as nothing can be added to it. The others travel up the tree as items of their own: each round deals
them to nodes of about GROUP items, anew each time, and packs each node by best fit.

After a node's pass no two of its sequences fit together, so at most one of them is half full or less, and two that are more than
half full never fit. The rounds end when one node has seen all that can still move, or when a round merges nothing; then the
sequences at most half full, one a node at most, meet in a last node. So all that can be missed are merges of those few
with sequences of other nodes that no round dealt to them.
A round moves (sequence, fill) pairs only; tokens and pieces stay where the leaves wrote them.

Null texts count as empty: the document is its end token alone. Repeated rows are packed as rows
of their own. An empty table gives an empty result. Very long texts become many full pieces.
"""

from __future__ import annotations

import zlib
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import batch_bytes, give_back, materialise, read_table
from .tokenizing import encoder

CAPACITY = 1024
END_ID = 2
#: Items that a leaf or one node of a round packs at once, about.
LEAF, GROUP = 200_000, 100_000
#: Bytes of a batch of texts in a task: 10,000 texts take 30 MB, and as much again as strings.
BATCH = 4 << 20


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each item, offset of each item, fill of each bin); longest items first, each into the fullest bin with room."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    fills: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if a bin has r free places
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        fitting = rooms >> need
        if fitting:
            room = need + (fitting & -fitting).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, at = capacity, len(fills)
            fills.append(0)
        bins[i], offsets[i] = at, capacity - room
        fills[at] += need
        room -= need
        if room:
            by_room[room].append(at)
            rooms |= 1 << room
    return bins, offsets, np.array(fills, np.int64)


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill long"


def _leaves(tokenizer: str, capacity: int, end_id: int, keep_ids: bool):
    end = np.array([end_id], "<u4").tobytes()

    def flush(leaf, rows, blobs):
        a = np.array(rows, np.int64).reshape(-1, 6)  # null?, id, piece, start, length, crc
        bins, offsets, fills = best_fit(a[:, 4], capacity)
        columns = [
            pa.array(a[:, 1], mask=a[:, 0] == 1), pa.array(a[:, 2].astype(np.int32)), pa.array(a[:, 3]), pa.array(a[:, 4]), pa.array(a[:, 5]),
            pa.array(bins + (leaf << 32)), pa.array(offsets), pa.array(fills[bins]),
        ]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset", "fill"]
        if keep_ids:
            columns.append(pa.array(blobs, pa.binary()))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches):
        give_back()  # what tasks of other operators have left
        encode, rows, blobs = encoder(tokenizer).encode, [], []
        leaf, part = TaskContext.get().partitionId() << 8, 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text or "") + end
                total = len(ids) // 4
                count = ceil(total / capacity)
                first = total - capacity * (count - 1)
                for k in range(count):
                    start = 0 if k == 0 else first + capacity * (k - 1)
                    length = first if k == 0 else capacity
                    own = ids[4 * start : 4 * (start + length)]
                    rows.append((doc_id is None, doc_id or 0, k, start, length, zlib.crc32(own)))
                    if keep_ids:
                        blobs.append(own)
            if len(rows) >= LEAF:
                yield flush(leaf + part, rows, blobs)
                rows, blobs, part = [], [], part + 1
        if rows:
            yield flush(leaf + part, rows, blobs)
        give_back()

    return run


def _merge(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        items, fills = table["bin"].to_numpy(), table["fill"].to_numpy()
        order = np.argsort(items, kind="stable")  # the same result if a task runs again
        items, fills = items[order], fills[order]
        bins, offsets, totals = best_fit(fills, capacity)
        name = np.full(len(totals), np.iinfo(np.int64).max)
        np.minimum.at(name, bins, items)
        return pa.table({"bin": items, "into": name[bins], "base": offsets, "total": totals[bins]})

    return run


def _round(bins: DataFrame, nodes: int, level: int, capacity: int) -> DataFrame:
    """(bin, into, base, total): where each sequence goes. The level salts the dealing, so other sequences meet in each round."""
    node = F.pmod(F.xxhash64("bin", F.lit(level)), F.lit(nodes)).alias("node")
    return materialise(bins.groupBy(node).applyInArrow(_merge(capacity), "bin long, into long, base long, total long"), "moves")


def _followed(moves: DataFrame, step: DataFrame) -> DataFrame:
    """The moves so far, then those of a round; what moves in a round could move in the rounds before, so it is known."""
    new = step.select(F.col("bin").alias("from"), F.col("into").alias("next"), F.col("base").alias("more"))
    joined = moves.join(new, F.col("into") == F.col("from"), "left")
    return materialise(joined.select("bin", F.coalesce("next", "into").alias("into"), (F.col("base") + F.coalesce("more", F.lit(0))).alias("base")), "moves")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]): one row per piece."""
    schema = _PIECES + (", ids binary" if keep_ids else "")
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with batch_bytes(docs.sparkSession, BATCH):
        pieces = materialise(chosen.mapInArrow(_leaves(tokenizer, capacity, end_id, keep_ids), schema), "pieces")
    open_bins, moves, level = pieces.where("offset = 0").select("bin", "fill"), None, 0
    while True:
        least, count = open_bins.agg(F.min("fill"), F.count("*")).first()
        if not count or 2 * least > capacity:  # no two fit together
            break
        movable = open_bins.where(F.col("fill") <= capacity - least)
        many = movable.count()
        if many < 2:
            break
        nodes = ceil(many / GROUP)
        step = _round(movable, nodes, level, capacity)
        left = step.where("base = 0").count()
        if left == many and nodes > 1:
            step = _round(movable.where(F.col("fill") <= capacity // 2), 1, level, capacity)
            nodes = 1
        moves = step.select("bin", "into", "base") if moves is None else _followed(moves, step)
        if nodes == 1:
            break
        open_bins, level = step.where("base = 0").select(F.col("into").alias("bin"), F.col("total").alias("fill")), level + 1
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if keep_ids else [])]
    if moves is None:
        return pieces.withColumnRenamed("bin", "sequence_id").select(*columns)
    moved = pieces.join(moves.where("bin <> into or base > 0"), "bin", "left")
    return moved.withColumn("sequence_id", F.coalesce("into", "bin")).withColumn("offset", F.col("offset") + F.coalesce("base", F.lit(0))).select(*columns)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))

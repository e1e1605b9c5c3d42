"""Merkle manifest of a table: leaves, roots of groups, one root, and a proof and a verification of each row.

H is the lowercase hex SHA-256 of its inputs, one after the other; digests count as hex text. A row's leaf is H of its fields, each `-` if null, else
its byte count in UTF-8, `:` and its value. In each group the leaves stand in order; while several nodes remain, every two consecutive ones (the last
run may be one node) become their H. The groups' roots, null first, then by bytes, give the root in the same way.

1. Spark hashes the leaves, range-partitions them by (group, order, leaf) and writes them. Counts of each group in each partition give every
   leaf its place in its group: no task sees a whole group.
2. Blocks of 2^BLOCK consecutive places of a group go to a task each, which reduces them to one node and writes a row: the node, and the leaves it came from.
3. The nodes are a table 2^BLOCK times smaller. Up to TOP of them go to the driver, which builds the upper tree and broadcasts each node's suffix path (at most
   64 bytes for each of about 60 levels and a node). More than TOP are reduced again in blocks, and their paths joined back.
4. Executors rebuild each block, join its nodes' paths to the suffix, hash the proof of each row and fold each row's leaf, or that of its tampered
   copy, to a root.

Null values of the order come first. Rows that repeat an order value stand by their leaf; equal rows get the same set of proofs whatever their order. An empty table
gives an empty result. Other columns of the input, and their names, do not matter.
"""

from __future__ import annotations

import struct
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import relations
from ._common import crc_of_id, materialise, quoted, read_table

#: Levels that one task reduces; nodes that the driver takes.
BLOCK, TOP = 12, 16_384
#: The tree over the roots of groups has this number; groups have theirs from 0.
_GROUPS = -1
_KEY = "<?q"


def joined(digests: list[bytes]) -> bytes:
    return sha256(b"".join(digests)).hexdigest().encode()


def levels(nodes: list[bytes], most: int | None = None) -> list[list[bytes]]:
    """The nodes and all levels above them, up to one node, or exactly `most` levels."""
    out = [nodes]
    while len(out[-1]) > 1 if most is None else len(out) <= most:
        now = out[-1]
        out.append([joined(now[i : i + 2]) for i in range(0, len(now), 2)])
    return out


def path(tree: list[list[bytes]], place: int) -> list[tuple[int, bytes]]:
    """(side, sibling) of each level below the top: side 0, the node is left of it; 1, right of it; -1, it has none."""
    out = []
    for nodes in tree[:-1]:
        other = place ^ 1
        out.append((place & 1, nodes[other]) if other < len(nodes) else (-1, b""))
        place >>= 1
    return out


def packed(steps: list[tuple[int, bytes]]) -> bytes:
    """A path as text: a mark of each level, and its sibling."""
    return b"".join(b"LR-"[side : side + 1] + other if side >= 0 else b"-" for side, other in steps)


def unpacked(text: bytes) -> list[tuple[int, bytes]]:
    out, at = [], 0
    while at < len(text):
        side = b"LR-".index(text[at : at + 1])
        out.append((side, text[at + 1 : at + 65]) if side < 2 else (-1, b""))
        at += 65 if side < 2 else 1
    return out


def fold(leaf: bytes, steps: list[tuple[int, bytes]]) -> bytes:
    for side, other in steps:
        leaf = sha256(leaf if side < 0 else leaf + other if side == 0 else other + leaf).hexdigest().encode()
    return leaf


def field(column: Column) -> Column:
    """A value as it is hashed."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*(field(c) for c in fields)).cast("binary"), 256)


_BLOCKS = "tree long, pos long, size long, node binary, keys binary, leaves binary, other binary"


def _blocks(block: int):
    """One row of each block: its node, and its members: keys (9 bytes each, the first tells null from 0), leaves and other leaves (32 bytes each; other: those of tampered rows)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        tree, pos, size = (table[c][0].as_py() for c in ("tree", "pos", "size"))
        leaves = table["leaf"].to_pylist()
        top = levels([x.hex().encode() for x in leaves], None if size <= 1 << block else block)[-1][0]
        keys = b"".join(struct.pack(_KEY, x is not None, x or 0) for x in table["key"].to_pylist())
        row = [tree, pos >> block, -(-size >> block), bytes.fromhex(top.decode()), keys, b"".join(leaves), b"".join(table["other"].to_pylist())]
        return pa.table({name: pa.array([value], kind) for name, value, kind in zip(("tree", "pos", "size", "node", "keys", "leaves", "other"), row, [pa.int64()] * 3 + [pa.binary()] * 4, strict=True)})

    return run


def _reduced(nodes: DataFrame, block: int, label: str) -> DataFrame:
    """Blocks of nodes (tree, pos, size, key, leaf, other)."""
    return materialise(nodes.groupBy("tree", F.shiftright("pos", block).alias("block")).applyInArrow(_blocks(block), _BLOCKS), label)


_PATHS = "tree long, pos long, path binary, subroot binary, root binary"


def _upper(rows: list[tuple[int, int, bytes]]) -> list[tuple]:
    """Paths of the nodes (tree, pos, node), in order, to the root; the driver's part."""
    trees: dict[int, list[bytes]] = {}
    for tree, _, node in rows:
        trees.setdefault(tree, []).append(node.hex().encode())
    built = {tree: levels(nodes) for tree, nodes in trees.items()}
    if _GROUPS in built:
        root = built[_GROUPS][-1][0]
        return [(_GROUPS, k, packed(path(built[_GROUPS], k)), node, root) for k, node in enumerate(trees[_GROUPS])]
    over = levels([built[tree][-1][0] for tree in built])
    suffixes = [path(over, place) for place in range(len(built))]
    return [
        (tree, k, packed(path(nodes, k) + suffixes[place]), nodes[-1][0], over[-1][0]) for place, (tree, nodes) in enumerate(built.items()) for k in range(len(nodes[0]))
    ]


def _finish(block: int):
    """Paths (tree, pos, path, subroot, root) of a block's members."""

    def run(batches):
        for batch in batches:
            out = []
            for tree, pos, size, leaves, suffix, subroot, root in zip(*(batch.column(c).to_pylist() for c in ("tree", "pos", "size", "leaves", "path", "subroot", "root")), strict=True):
                nodes = [leaves[i : i + 32].hex().encode() for i in range(0, len(leaves), 32)]
                own = levels(nodes, None if size == 1 else block)
                top = own[-1][0]
                for k in range(len(nodes)):
                    if tree == _GROUPS:  # a group's root: its number is its place
                        out.append(((pos << block) + k, 0, packed(path(own, k)) + suffix, nodes[k], root))
                    else:
                        out.append((tree, (pos << block) + k, packed(path(own, k)) + suffix, subroot or top, root))
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            columns = zip(*out, strict=True) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["tree", "pos", "path", "subroot", "root"])

    return run


def _paths(nodes: DataFrame, block: int, top: int) -> DataFrame:
    """(tree, pos, path, subroot, root) of each node (tree, pos, size, node): size is the number of the tree's nodes, its members' places 0..size-1."""
    spark = nodes.sparkSession
    many = nodes.count()
    if many <= top:
        rows = sorted((r["tree"], r["pos"], bytes(r["node"])) for r in nodes.select("tree", "pos", "node").collect())
        return F.broadcast(spark.createDataFrame(_upper(rows), _PATHS)) if rows else spark.createDataFrame([], _PATHS)
    over = nodes.where(F.col("tree") == _GROUPS).limit(1).count() > 0
    if not over and not nodes.where("size > 1").limit(1).count():  # every group is one node: now the tree over them
        found = _paths(nodes.select(F.lit(_GROUPS).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(many).cast("long").alias("size"), "node"), block, top)
        return found.select(F.col("pos").alias("tree"), F.lit(0).cast("long").alias("pos"), "path", "subroot", "root")
    plain = nodes.select("tree", "pos", "size", F.lit(0).cast("long").alias("key"), F.col("node").alias("leaf"), F.lit(b"").alias("other"))
    blocks = _reduced(plain, block, "upper")
    above = _paths(blocks.select("tree", "pos", "size", "node"), block, top)
    paths = blocks.select("tree", "pos", "size", "leaves").join(above, ["tree", "pos"]).mapInArrow(_finish(block), _PATHS)
    if over:
        paths = paths.select(F.lit(_GROUPS).cast("long").alias("tree"), F.col("tree").alias("pos"), "path", "subroot", "root")
    return materialise(paths, "paths")


_OUT = "key long, leaf string, subroot string, root string, proof string, folded string"


def _proofs(block: int):
    """Rows of the members: proof and folded root of each."""

    def run(batches):
        for batch in batches:
            names = ("size", "keys", "leaves", "other", "path", "subroot", "root")
            for size, keys, leaves, other, suffix, subroot, root in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                nodes = [leaves[i : i + 32].hex().encode() for i in range(0, len(leaves), 32)]
                own, above = levels(nodes, None if size == 1 else block), unpacked(suffix)
                rest, proofs, folded = b"".join(x for _, x in above), [], []
                for k, leaf in enumerate(nodes):
                    steps = path(own, k)
                    proofs.append(sha256(b"".join([x for _, x in steps]) + rest).hexdigest())
                    tampered = other[32 * k : 32 * k + 32].hex().encode()
                    folded.append(fold(tampered, steps + above).decode())
                n = len(nodes)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([value if known else None for known, value in struct.iter_unpack(_KEY, keys)], pa.int64()), pa.array([x.decode() for x in nodes]),
                        pa.array([subroot.decode()] * n), pa.array([root.decode()] * n), pa.array(proofs), pa.array(folded),
                    ],
                    names=["key", "leaf", "subroot", "root", "proof", "folded"],
                )

    return run


def manifest(rows: DataFrame, fields: list[str], group: str, order: str, tampered: dict[str, Column] | None = None, block: int = BLOCK, top: int = TOP) -> DataFrame:
    """(order, leaf, subroot, root, proof_sha256, folded_root, verified): one row per input row.

    fields: the columns that make a leaf. order: an integer column. tampered: what replaces fields in the copy whose leaf is folded; without it, the rows themselves are verified.
    """
    c = lambda name: F.col(quoted(name))
    changed = [(tampered or {}).get(f, c(f)) for f in fields]
    leaf, other = leaf_digest([c(f) for f in fields]), leaf_digest(changed)
    hashed = rows.select(c(group).cast("string").alias("group"), c(order).cast("long").alias("key"), F.unhex(leaf).alias("leaf"), F.unhex(other).alias("other"))
    hashed = materialise(hashed, "leaves")
    # the row's number spreads rows that repeat one another over partitions; number = (partition, place in it) afterwards
    dealt = hashed.repartitionByRange(F.col("group").asc_nulls_first(), F.col("key").asc_nulls_first(), "leaf", F.monotonically_increasing_id())
    ordered = dealt.sortWithinPartitions(F.col("group").asc_nulls_first(), F.col("key").asc_nulls_first(), "leaf")
    ordered = materialise(ordered.withColumn("number", F.monotonically_increasing_id()).withColumn("part", F.shiftright("number", 33)), "ordered")
    counts = ordered.groupBy("part", "group").agg(F.count("*").alias("n"), F.min("number").alias("first"))
    same = Window.partitionBy("group")
    counts = counts.withColumns({"before": F.coalesce(F.sum("n").over(same.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "size": F.sum("n").over(same)})
    counts = materialise(counts, "counts")  # one row for each group in a partition
    groups = relations.ordinals(counts.select("group").distinct(), ["group"]).select(F.col("group").alias("name"), F.col("ordinal").cast("long").alias("tree"))
    places = counts.join(groups, F.col("group").eqNullSafe(F.col("name"))).select(F.col("part").alias("__part"), F.col("group").alias("__group"), "first", "before", "size", "tree")
    placed = ordered.join(places, (F.col("part") == F.col("__part")) & F.col("group").eqNullSafe(F.col("__group")))
    nodes = placed.select("tree", (F.col("before") + F.col("number") - F.col("first")).alias("pos"), "size", "key", "leaf", "other")
    blocks = _reduced(nodes, block, "blocks")
    above = _paths(blocks.select("tree", "pos", "size", "node"), block, top)
    out = blocks.join(above, ["tree", "pos"]).mapInArrow(_proofs(block), _OUT)
    return out.select(
        F.col("key").alias(order), "leaf", "subroot", "root", F.col("proof").alias("proof_sha256"), F.col("folded").alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    hit = F.coalesce(crc_of_id(F.col("doc_id")) % 7 == 0, F.lit(False))
    changed = {"n_chars": F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    return manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", changed)


SQL = r"""
WITH RECURSIVE table_of AS (
  SELECT list(v ORDER BY n) AS t FROM (SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS r(n))),
d AS (
  SELECT doc_id, lang, n_chars, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         coalesce(strlen(text) || ':' || text, '-') AS tail,
         xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ord(substr(doc_id::VARCHAR, i, 1))::BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 7 = 0 AS hit
  FROM documents, table_of),
leaves AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
         sha256(head || coalesce(strlen((n_chars + hit::INT)::VARCHAR) || ':' || (n_chars + hit::INT), '-') || tail) AS tampered,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos
  FROM d),
low(lang, lvl, nodes) AS (
  SELECT lang, 0, list(leaf ORDER BY doc_id) FROM leaves GROUP BY lang
  UNION ALL SELECT lang, lvl + 1, list_transform(range(0, (len(nodes) + 1) // 2), lambda i: sha256(array_to_string(nodes[2 * i + 1 : 2 * i + 2], ''))) FROM low WHERE len(nodes) > 1),
subs AS (SELECT lang, lvl AS height, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM low WHERE len(nodes) = 1),
high(lvl, nodes) AS (
  SELECT 0, list(subroot ORDER BY place) FROM subs
  UNION ALL SELECT lvl + 1, list_transform(range(0, (len(nodes) + 1) // 2), lambda i: sha256(array_to_string(nodes[2 * i + 1 : 2 * i + 2], ''))) FROM high WHERE len(nodes) > 1),
chain AS (
  SELECT subs.lang, subs.height, low.lvl, low.nodes FROM subs JOIN low ON subs.lang IS NOT DISTINCT FROM low.lang WHERE low.lvl < subs.height
  UNION ALL SELECT subs.lang, subs.height, subs.height + high.lvl, high.nodes FROM subs, high WHERE len(high.nodes) > 1),
steps(doc_id, lang, lvl, pos, folded, proof) AS (
  SELECT doc_id, lang, 0, pos, tampered, '' FROM leaves
  UNION ALL
  SELECT s.doc_id, s.lang, s.lvl + 1, p // 2,
         sha256(CASE WHEN p % 2 = 1 THEN c.nodes[p] || s.folded ELSE s.folded || coalesce(c.nodes[p + 2], '') END),
         s.proof || CASE WHEN p % 2 = 1 THEN c.nodes[p] ELSE coalesce(c.nodes[p + 2], '') END
  FROM (SELECT s.*, CASE WHEN s.lvl = subs.height THEN subs.place ELSE s.pos END AS p FROM steps s JOIN subs ON s.lang IS NOT DISTINCT FROM subs.lang) s
  JOIN chain c ON s.lang IS NOT DISTINCT FROM c.lang AND s.lvl = c.lvl),
ends AS (SELECT doc_id, max_by(folded, lvl) AS folded_root, max_by(proof, lvl) AS proof FROM steps GROUP BY doc_id)
SELECT l.doc_id, l.leaf, subs.subroot, top.root, sha256(ends.proof) AS proof_sha256, ends.folded_root, ends.folded_root = top.root AS verified
FROM leaves l JOIN subs ON l.lang IS NOT DISTINCT FROM subs.lang JOIN ends ON l.doc_id = ends.doc_id, (SELECT nodes[1] AS root FROM high WHERE len(nodes) = 1) AS top
"""

"""MinHash near-dedup by bottom-k sketches from one hash function.

1. Each text's shingle set is hashed once; its K smallest values are the sketch. Texts with equal sets form a class (its
   smallest id names it), found by a digest of the set with map-side combining; only classes go on.
2. Inverted lists of retained values generate overlaps. Two sets of similarity t share about t*K retained values, so a
   sketch needs only its rarest K - o + 1 values, o being a share far below t (chance of a miss under 1e-7 a link).
   Values found in one class alone fill those places first, so most classes are done here.
3. In each list the smallest class is compared with every other: links as stars, not as all pairs. Components follow.
4. Lists that still hold several components, if longer than two, are compared in blocks of bounded size: inside a task all
   overlaps of two blocks come from matrix products over set values, and only a spanning forest of new links leaves it. Long lists that share
   members are merged into clusters, so each class goes to one cluster only; where that would make more pairs than the lists themselves, the lists stay.
5. The estimate from the union's sketch filters pairs, exact Jaccard over full sets verifies them. In blocks, sets of more than `cut` values are first
   compared by their `cut` smallest ones, as in step 5; cut=None compares whole sets there. At cut 512 a link is missed with probability below 1e-9.

No join meets a frequent value, hub or group of copies in one task (heavy.py).

Words are runs of characters other than ASCII white space, A-Z lower-cased. A set: distinct shingles of SIZE words; of fewer words the whole
sequence; without words (or null) empty, linked with nothing, a component of its own. Repeated rows and ties are copies: the smallest id stays.
In near_duplicates() each row belongs to the class of its own text and a component has the name of its smallest id, also where different texts share an id; a null id is
a component without a number; dedup() decides by row. An empty table gives an empty result. Other columns are not read.
Sets hold 64-bit hashes; two of n shingles collide with probability n*n/2**65.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import PLACE, SPACES, Lexer, batch_bytes, materialise, mix, numbered, quoted, quotes, read_table, text_bytes, tidied, windows
from .components import components
from .heavy import lookup

SIZE = 5
PERCENT = 85
#: Retained values of a sketch; share below the threshold that an overlap is sure to reach; values for estimates.
K, SLACK = 64, 0.37
UNION_K, UNION_SLACK = 256, 0.15
#: Lists above this length are merged into clusters; classes of a block; set values that a block holds of each class.
LONG, BLOCK, CUT = 64, 1024, 512
#: Bytes of a batch of texts or of pairs of sets in a task: sets of long texts take 100 KB and more each, so 10,000 pairs would take a GB.
BATCH = 8 << 20


def shingles(hashes: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Sorted distinct shingle hashes of one text's words."""
    n = len(hashes)
    if n >= size:
        return np.unique(windows(hashes, size))
    return mix((hashes * PLACE[32 : 32 + n]).sum(keepdims=True, dtype=np.uint64)) if n else hashes


def _sets(texts: list[bytes], size: int):
    for _, _, _, _, edge, hashes in Lexer(SPACES, lower=True).chunks(texts):
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            yield shingles(hashes[a:b], size)


def _signer(size: int, k: int):
    def run(batches):
        for batch in batches:
            counts, digests, sketches = [], [], []
            for found in _sets(text_bytes(batch.column(1)), size):
                counts.append(len(found))
                digests.append(_digest(found) if len(found) else None)
                sketches.append(found[:k].view(np.int64))
            lengths = np.array([len(x) for x in sketches])
            flat = np.concatenate(sketches) if sketches else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), lists], ["doc_id", "n", "digest", "sketch"])

    return tidied(run)


def _digest(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def _set_writer(size: int):
    """Sets of the texts that are their class's: another text may have the same id."""

    def run(batches):
        for batch in batches:
            sets = list(_sets(text_bytes(batch.column(1)), size))
            own = pa.array([_digest(x) == d for x, d in zip(sets, batch.column(2).to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in sets], pa.binary())], ["class_id", "set"]).filter(own)

    return tidied(run)


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0


def estimate(a: np.ndarray, b: np.ndarray, k: int = UNION_K) -> float:
    """Similarity from the k smallest values of the union."""
    x, y = a[:k], b[:k]
    union = np.union1d(x, y)[:k]
    top = union[-1]
    return _overlap(x[x <= top], y[y <= top]) / len(union)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |A and B| >= percent * |A or B|, on full sets; the estimate goes first."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    if max(len(a), len(b)) > UNION_K and estimate(a, b) < percent / 100 - UNION_SLACK:
        return False
    both = _overlap(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def _verifier(percent: int):
    def run(batches):
        for batch in batches:
            a, b, sa, sb = (batch.column(k) for k in range(4))
            keep = [linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(sa, sb, strict=True)]  # no copies
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return tidied(run)


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b), a written table, whose full sets are linked. Many pairs may share their a."""
    left, right = sets.select(F.col("class_id").alias("a"), F.col("set").alias("sa")), sets.select(F.col("class_id").alias("b"), F.col("set").alias("sb"))
    return lookup(pairs.select("a", "b"), left, "a", salts=16).join(right, "b").select("a", "b", "sa", "sb").mapInArrow(_verifier(percent), "a long, b long")


def _products(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Overlap counts of all sets on the left with all on the right, by matrix products over the values they share."""
    values, counts = np.unique(np.concatenate(left + right), return_counts=True)
    values = values[counts > 1]
    out = np.zeros((len(left), len(right)), np.float32)

    def places(sets):
        at = [np.searchsorted(values, s) for s in sets]
        rows = np.repeat(np.arange(len(sets)), [len(x) for x in at])
        at, flat = np.concatenate(at), np.concatenate(sets)
        at = np.minimum(at, max(len(values) - 1, 0))
        keep = values[at] == flat if len(values) else np.zeros(len(flat), bool)
        return rows[keep], at[keep]

    (ra, ca), (rb, cb) = places(left), places(right)
    step = 4096
    for at in range(0, len(values), step):
        x, y = np.zeros((len(left), step), np.float32), np.zeros((len(right), step), np.float32)
        own, other = (ca >= at) & (ca < at + step), (cb >= at) & (cb < at + step)
        x[ra[own], ca[own] - at] = 1
        y[rb[other], cb[other] - at] = 1
        out += x @ y.T
    return out


def _blocks(percent: int, most: int | None):
    """One pair of blocks: links between components, as a forest; verified is false where sets were cut and only estimated."""

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table["class_id"].to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        ids, comps, sizes = (table[k].to_numpy() for k in ("class_id", "comp", "n"))
        block, first, second = table["block"].to_numpy(), table["i"][0].as_py(), table["j"][0].as_py()
        sets = [np.frombuffer(x, np.uint64) for x in table["set"].to_pylist()]
        left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
        none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "verified": pa.array([], pa.bool_())})
        if not len(left) or not len(right):
            return none
        both = _products([sets[k] for k in left], [sets[k] for k in right])
        na, nb = sizes[left][:, None], sizes[right][None, :]
        fits = (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (comps[left][:, None] != comps[right][None, :])
        if first == second:
            fits &= left[:, None] < right[None, :]
        whole = (na <= most) & (nb <= most) if most else np.ones(both.shape, bool)
        cut = np.minimum(np.minimum(na, nb), most or 0)
        good = fits & np.where(whole, 100 * both >= percent * (na + nb - both), both >= (percent / 100 - UNION_SLACK) * cut)
        parent = {}

        def root(x):
            while parent.get(x, x) != x:
                parent[x] = x = parent.get(parent[x], parent[x])
            return x

        a, b, sure = [], [], []
        pairs = np.argwhere(good & whole)
        for x, y in pairs.tolist():
            p, q = root(int(comps[left[x]])), root(int(comps[right[y]]))
            if p != q:
                parent[max(p, q)] = min(p, q)
                a.append(int(ids[left[x]])), b.append(int(ids[right[y]])), sure.append(True)
        for x, y in np.argwhere(good & ~whole).tolist():
            if root(int(comps[left[x]])) != root(int(comps[right[y]])):
                a.append(int(ids[left[x]])), b.append(int(ids[right[y]])), sure.append(False)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "verified": pa.array(sure, pa.bool_())})

    return run


def _candidates(classes: DataFrame, percent: int, k: int) -> DataFrame:
    """(value, class_id, n): for each class its rarest retained values, as many as an overlap cannot miss."""
    postings = classes.select("class_id", "n", F.size("sketch").alias("s"), F.explode("sketch").alias("value"))
    common = postings.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    shared = lookup(postings, common, "value").groupBy("class_id", "n", "s").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("v"))
    sure = F.least(F.lit(int(k * (percent / 100 - SLACK))), F.ceil(F.col("n") * percent / 100).cast("int"))
    slots = F.col("s") - sure + 1 - (F.col("s") - F.size("v"))
    return shared.withColumn("slots", slots).where("slots > 0").select("class_id", "n", F.explode(F.expr("slice(v, 1, slots)")).alias("x")).select("x.value", "class_id", "n")


def _dealt(rest: DataFrame) -> DataFrame:
    """(class_id, n, comp, g, i, j): copies of the members of lists (value, class_id, n, c, comp, pivot) for every pair of blocks that they take part in."""
    clusters = components(rest.where(F.col("c") > LONG).select(F.col("class_id").alias("a"), F.col("pivot").alias("b")))
    long = rest.where(F.col("c") > LONG).join(clusters, F.col("class_id") == F.col("node")).select("value", "class_id", "n", rest["comp"], clusters["comp"].alias("cluster"))
    long = materialise(long, "long")
    members = long.groupBy("cluster", "class_id").agg(F.lit(1).alias("one")).groupBy("cluster").agg(F.count("*").alias("m"))
    lists = long.groupBy("cluster", "value").agg(F.count("*").alias("m")).groupBy("cluster").agg(F.sum(F.col("m") * F.col("m")).alias("pairs"))
    apart = members.join(lists, "cluster").select("cluster", (F.col("m") * F.col("m") > F.col("pairs")).alias("apart"))
    named = lookup(long, apart, "cluster").select("class_id", "n", "comp", F.when(F.col("apart"), F.concat(F.lit("v"), F.col("value"))).otherwise(F.concat(F.lit("c"), F.col("cluster"))).alias("g"))
    short = rest.where(F.col("c") <= LONG).select("class_id", "n", "comp", F.concat(F.lit("v"), F.col("value")).alias("g"))
    grouped = materialise(short.unionByName(named.distinct()), "groups")
    sizes = grouped.groupBy("g").agg(F.count("*").alias("m")).where("m > 1").select("g", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    dealt = lookup(grouped, sizes, "g").withColumn("block", F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select("class_id", "n", "comp", "g", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, size: int = SIZE, k: int = K, cut: int | None = CUT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): one row per document."""
    with batch_bytes(docs.sparkSession, BATCH):
        return _near_duplicates(docs, percent, size, k, cut, id_col, text_col)


def _near_duplicates(docs: DataFrame, percent: int, size: int, k: int, cut: int | None, id_col: str, text_col: str) -> DataFrame:
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = materialise(texts.mapInArrow(_signer(size, k), "doc_id long, n long, digest binary, sketch array<long>"), "signed")
    classes = signed.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.max("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = materialise(classes.where("class_id is not null"), "classes")
    posts = materialise(_candidates(classes, percent, k), "posts")
    lists = posts.groupBy("value").agg(F.count("*").alias("c"), F.min(F.struct("class_id", "n")).alias("pivot")).where("c > 1")
    posts = materialise(lookup(posts, lists, "value").select("value", "class_id", "n", "c", "pivot"), "lists")
    wanted = posts.select("class_id").distinct().join(classes.select("class_id", "digest"), "class_id")
    sets = texts.join(wanted, texts["doc_id"] == wanted["class_id"]).select("class_id", "text", "digest").mapInArrow(_set_writer(size), "class_id long, set binary")
    sets = materialise(sets, "sets")

    fits = F.expr(f"100 * least(n, pivot.n) >= {percent} * greatest(n, pivot.n)")
    stars = posts.where("class_id <> pivot.class_id").where(fits).select(F.col("pivot.class_id").alias("a"), F.col("class_id").alias("b")).distinct()
    edges = materialise(verify(materialise(stars, "stars"), sets, percent), "edges")
    labels = components(edges)

    rest = posts.where("c > 2").join(labels, F.col("class_id") == F.col("node"), "left").select("value", "class_id", "n", "c", F.coalesce("comp", "class_id").alias("comp"))
    rest = materialise(rest, "rest")
    mixed = rest.groupBy("value").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("class_id").alias("pivot")).where("low < high").select("value", "pivot")
    rest = materialise(lookup(rest, mixed, "value"), "rest")
    held = sets.select("class_id", F.substring("set", 1, 8 * cut).alias("set") if cut else "set")
    found = _dealt(rest).join(held, "class_id").groupBy("g", "i", "j").applyInArrow(_blocks(percent, cut), "a long, b long, verified boolean")
    found = materialise(found, "found")
    doubtful = materialise(found.where("not verified").select("a", "b").distinct(), "doubtful")
    more = found.where("verified").select("a", "b").union(verify(doubtful, sets, percent))
    labels = components(materialise(edges.union(more), "edges"))

    named = classes.select("digest", "class_id").join(labels, F.col("class_id") == F.col("node"), "left").select("digest", F.coalesce("comp", "class_id").alias("comp"))
    known = lookup(signed.select("doc_id", "n", "digest"), named, "digest", "left")
    return known.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "doc_id").alias("component_id"))


def dedup(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, one of each component of rows, with all their columns: that of the smallest id (null is the largest), of equal ids any one."""
    rows, row = numbered(docs)
    found = near_duplicates(rows, percent, id_col=row, text_col=text_col).select(F.col("doc_id").alias("row"), "component_id")
    ids = rows.select(F.col(row).alias("row"), F.col(quoted(id_col)).isNull().alias("none"), F.col(quoted(id_col)).alias("id"))
    kept = found.join(ids, "row").groupBy("component_id").agg(F.min(F.struct("none", "id", "row")).alias("kept")).select(F.col("kept.row").alias(row))
    return rows.join(kept, row, "left_semi").select(*quotes(docs))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS t, len(w) < 5 AS short FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.t = b.t AND a.short = b.short AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM shared JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 85 * (x.n + y.n - k)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT a, b FROM edge UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a),
comp AS (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(comp.low, d.doc_id)) AS component_id, d.doc_id <= coalesce(comp.low, d.doc_id) AS kept
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN comp ON d.doc_id = comp.doc_id
"""

"""Exact dedup by a heavy-hitter split, with DataFrame operations only.

1. Each text is normalised (runs of white space become one blank; null counts as empty) and hashed
   with SHA-256; (id, digest) is written once, so the texts are scanned once.
2. Misra-Gries counters find candidate digests of frequent texts: Spark's freqItems is that
   algorithm, with mergeable counters per partition, here over 64-bit hashes of digests. Every digest with more than `support` of the rows is
   among its at most 1/support candidates, whatever the input's size.
3. Candidates are verified: their exact counts and smallest ids come from one map-side aggregate.
   Those with two rows or more are broadcast (at most 1/support rows) and resolve their rows on the map side.
4. All other rows are shuffled by digest; none of these groups exceeds `support` of the rows.

Ties: the smallest id stays. Rows that repeat an id are rows of their own; groups() names the one
that stays by the id alone, dedup() keeps one row of each digest. A null id counts as the largest. An empty table gives an empty result.
Columns of the input other than the id and the text are not touched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import materialise, numbered, quoted, quotes, read_table
from .heavy import heavy_hashes

#: Share of the rows from which a group of copies is resolved on the map side.
SUPPORT = 1 / 1000


def normalised(text):
    """Every run of white space becomes one blank. Two cheap steps: single blanks, the usual case, are no match."""
    blanks = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.regexp_replace(blanks, "  +", " ")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.sha2(normalised(F.col(text_col)).cast("binary"), 256).alias("digest"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """(id, digest, keep_id, group_size): one row per input row."""
    rows = materialise(digests(docs, id_col, text_col).withColumn("digest", F.unhex("digest")), "digests")
    candidates = heavy_hashes(rows, "digest", "h", support)
    heavy = (
        rows.join(F.broadcast(candidates), F.xxhash64("digest") == F.col("h"), "left_semi")
        .groupBy("digest")
        .agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
        .where("group_size > 1")
    )
    heavy = materialise(heavy.coalesce(1), "heavy")  # at most 1/support rows
    known = rows.join(F.broadcast(heavy), "digest", "inner").select("id", "digest", "keep_id", "group_size")
    same = Window.partitionBy("digest")
    rest = rows.join(F.broadcast(heavy), "digest", "left_anti").select(
        "id", "digest", F.min("id").over(same).alias("keep_id"), F.count("*").over(same).alias("group_size")
    )
    return known.unionByName(rest)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, one of each digest, with all their columns: that of the smallest id, of equal ids any one."""
    rows, row = numbered(docs)
    keyed = rows.select(F.struct(F.col(quoted(id_col)).isNull().alias("none"), F.col(quoted(id_col)).alias("id"), F.col(row).alias("row")).alias("key"), F.col(quoted(text_col)).alias("text"))
    gone = groups(keyed, "key", "text").where("id.row <> keep_id.row").select(F.col("id.row").alias(row))
    return rows.join(gone, row, "left_anti").select(*quotes(docs))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(read_table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""

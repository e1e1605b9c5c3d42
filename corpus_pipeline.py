"""The corpus pipeline: language ID, exact dedup, near dedup, benchmark decontamination, packing.

Each stage is (spark, docs, sf_dir) -> DataFrame. It works on all that its predecessor kept, and all but the last return the columns of
`documents`. Nulls, empty texts, repeated rows, extra columns and empty tables follow the operators' own docstrings:

- language: documents without any letter (null included) are rejected, and those whose calibrated probability is below MIN_SCORE, which could be of
  any learned language: texts of a few letters, or all texts where labels tell nothing. Clean texts stay; so do texts of letters in no learned language that look like one.
- exact: of equal texts the row with the smallest id stays; of rows that repeat it too, one.
- near: of each component of similarity NEAR_PERCENT or more over five-word shingles one row stays, that with the smallest id.
- decontaminate: rows that hold a benchmark window are dropped, with or without an id; other rows of the same id stay.
- pack: one row per piece of a document, with its sequence and place.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.llm import decontamination, exact_dedup, language, near_dedup, packing
from gridweave.llm._common import free_name, materialise, numbered, quoted, quotes, read_table, stage_tables

#: With four languages, a calibrated probability below this is close to no answer at all.
MIN_SCORE = 0.3
NEAR_PERCENT = 80
TOKENIZER = "byte_bpe_50k.json"


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with stage_tables(first=True):
        model = language.train(docs.where(language.training_fold()).select("text", "lang", F.col("doc_id").alias("id")))
        lang, score = free_name(docs, "__lang"), free_name(docs, "__score")
        judged = language.predict(docs, model, {c: F.col(quoted(c)) for c in docs.columns}, out=(lang, score))
        return judged.where((F.col(lang) != language.UNKNOWN) & (F.col(score) >= MIN_SCORE)).select(*quotes(docs))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with stage_tables():
        return exact_dedup.dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with stage_tables():
        return near_dedup.dedup(docs, NEAR_PERCENT)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with stage_tables():
        rows, row = numbered(docs)
        found = decontamination.contamination(rows, read_table(spark, sf_dir, "benchmark"), id_col=row)
        return rows.join(found.where("n_hit > 0").select(F.col("doc_id").alias(row)), row, "left_anti").select(*quotes(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with stage_tables():
        return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language", language_stage),
    ("exact", exact_stage),
    ("near", near_stage),
    ("decontaminate", decontamination_stage),
    ("pack", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}", pinned=True)
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL cannot train the network or pack; tests/llm holds the stages against brute force.
ORACLE_SQL = None

"""The corpus pipeline: quality, exact duplicates, near duplicates, mixing, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the one before it kept. All but the last return
the columns of ``documents``. Near duplicates are five-word shingles at a similarity of 0.8 or more. A document without
any label of its own is judged by its text like others; documents predicted as low quality go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from secspark.llm.common import columns, free_names, materialize, read_table
from secspark.llm.exact_dedup import exact_duplicates, normalised
from secspark.llm.mixing import mixed_rows
from secspark.llm.near_dedup import near_duplicates
from secspark.llm.packing import pack
from secspark.llm.quality import quality_scores

#: SQL can't express the classifier, so there is none for the whole; tests hold every stage against plain Python.
ORACLE_SQL = None


def _only(docs: DataFrame, decided: DataFrame, condition: str) -> DataFrame:
    """Rows of ``docs`` whose doc_id (null included) has a decision that meets ``condition``."""
    (own,) = free_names(docs, "good_id")
    good = decided.where(condition).select(F.col("doc_id").alias(own)).distinct()
    return docs.join(good, docs["doc_id"].cast("long").eqNullSafe(F.col(own)), "left_semi")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows predicted as high quality. Null and empty texts are scored like others; a repeated row stays or goes with its like,
    rows that share a doc_id stay if one of them does; null doc_ids are one id; an empty table gives no rows."""
    return _only(docs, quality_scores(docs, read_table(spark, sf_dir, "labels")), "predicted = 1")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each text: that with the smallest doc_id, null ids last, any one of rows that share it. Null text is
    empty; an empty table gives no rows."""
    decided = materialize(exact_duplicates(docs), "decided")
    sha, own, own_sha = free_names(docs, "sha", "good_id", "good_sha")

    def having(rows: DataFrame, good: DataFrame, how: str) -> DataFrame:
        good = good.select(F.col("doc_id").alias(own), F.col("text_sha256").alias(own_sha)).distinct()
        return rows.join(good, rows["doc_id"].cast("long").eqNullSafe(F.col(own)) & (rows[sha] == F.col(own_sha)), how)

    rows = docs.select(*columns(docs), F.sha2(normalised(docs["text"]), 256).alias(sha))
    rows = having(rows, decided.where("kept"), "left_semi")
    # rows that share even the id with the one that stays
    twice = decided.where("not kept and doc_id <=> keep_id")
    if not twice.isEmpty():
        rows = having(rows, twice, "left_anti").unionByName(having(rows, twice, "left_semi").dropDuplicates(["doc_id", sha]))
    return rows.drop(sha)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest doc_id. Texts without words and rows without a
    doc_id stay; rows that share a doc_id stay or go together; an empty table gives no rows."""
    return _only(docs, near_duplicates(docs, k=5, per_cent=80), "kept")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, shard after shard in the shards' order. Null sources are one source, null texts have no
    words; repeated rows are taken alike; an empty table gives no rows."""
    return mixed_rows(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows. Null text is empty, an empty text the closing id alone; repeated rows are packed again; an empty
    table gives no rows."""
    return pack(docs)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

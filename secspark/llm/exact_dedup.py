"""Operator 4: exact duplicates by a 128-bit content hash, with bytes compared inside groups.

Texts are equal when identical after replacing each run of blanks and bytes 9-13 by one blank. Rows are grouped by the
MD5 of the normalised text; only groups of two or more rows read their texts again, and each row's text is compared with
the keeper's. Where a comparison fails (a hash collision), that hash's rows are grouped by the text itself.

Cases: null text is empty; of rows with one doc_id and equal texts exactly one stays; null doc_ids come last, so they
stay only in groups without any other; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from secspark.llm.common import materialize, read_table, sized_broadcast


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def content_hash(norm: Column) -> Column:
    return F.unhex(F.md5(norm.cast("binary")))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hasher=content_hash) -> DataFrame:
    """Rows ``(doc_id, keep_id, group_size, kept, text_sha256)``, one for each row of ``docs``."""
    norm = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    heads = materialize(norm.select("doc_id", hasher(F.col("norm")).alias("h"), F.unhex(F.sha2("norm", 256)).alias("sha")), "heads")
    groups = materialize(heads.groupBy("h").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1"), "groups")
    side = sized_broadcast(groups)
    hashed = norm.withColumn("h", hasher(F.col("norm")))
    members = materialize(hashed.join(side, "h").select("h", "doc_id", "norm", "keep_id", "group_size"), "members")
    # written, so that the join below is between two plain tables and a hot group's rows can be split
    keepers = materialize(members.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("h").agg(F.min("norm").alias("first")), "keepers")
    bad = materialize(members.join(keepers, "h").where("norm <> first").select("h"), "collisions").distinct()
    split = members.join(F.broadcast(bad) if bad.isEmpty() else bad, "h", "left_semi")
    exact = split.groupBy("h", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    split = split.select("h", "norm", "doc_id").join(exact, ["h", "norm"])
    columns = ["doc_id", "keep_id", "group_size", F.sha2("norm", 256).alias("text_sha256")]
    same = members.join(bad, "h", "left_anti").select(*columns).unionByName(split.select(*columns))
    # one row stays where several share the smallest doc_id
    w = Window.partitionBy("text_sha256", "doc_id").orderBy("doc_id")
    same = same.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.row_number().over(w) == 1))
    alone = heads.join(side, "h", "left_anti").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lower(F.hex("sha")).alias("text_sha256"), F.lit(True).alias("kept"))
    return same.unionByName(alone).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read_table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
 doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM n
"""

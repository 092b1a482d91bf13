"""Shared pieces: tables in the shared folder, checked broadcasts, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from secspark.scratch import discard, exists, materialize, remove, scratch_dir  # noqa: F401

#: Rows up to which a two-column side may be broadcast; beyond it joins shuffle.
BROADCAST_ROWS = 200_000


def sized_broadcast(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` if it has at most ``limit`` rows (counted here), else leave the choice to the planner."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= limit else df


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, with underscores added until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def columns(df: DataFrame) -> list[Column]:
    """All columns of ``df``, whatever their names hold."""
    return [df["`" + c.replace("`", "``") + "`"] for c in df.columns]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Connected components of ``edges (a long, b long)``: rows ``(v, label)``, the label being the smallest vertex reachable.

    Each round takes the smallest of the neighbours' labels and the label of the own label, so chains shorten
    geometrically. Labels only fall, so their sum stands still exactly when nothing changed. Every round is
    written to the shared folder; nothing but that sum reaches the driver.
    """
    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    e = materialize(e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = materialize(e.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("v")).alias("label")), "labels")
    total = None
    for _ in range(max_rounds):
        now = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if now == total or now is None:
            discard(e)
            return labels
        total = now
        # a vertex's own label is like one more neighbour: the label of that label comes along
        near = e.unionByName(labels.select(F.col("v").alias("a"), F.col("label").alias("b")))
        step = near.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("label"))
        labels, old = materialize(step, "labels"), labels
        discard(old)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")

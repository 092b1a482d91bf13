"""Operator 7: mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Size is the number of words. Sources in code-point order (null last) weigh 3, 1, 2, repeating; they share ``budget``
times all words by weight; a target stops at ``max_epochs`` times its source, and the excess is shared again by weight.

A source's target is whole copies of it plus a remainder. The remainder's documents are drawn without replacement: the
source is permuted by a seeded hash and cut into blocks of neighbouring hashes (about 256 rows, and at most 65536 blocks); a block is taken whole while it fits, and
of the one block at the edge documents are taken in hash order while they fit the rest best. So each source's words miss
their target by less than one document, whatever the input's size. The blocks of all copies are then dealt among the output shards: the root of
a binary tree over shards holds each source's block count, every node draws its left child's counts from a multivariate
hypergeometric distribution, and the leaves are exact, disjoint quotas. Blocks fill the quotas in permuted order and rows
are ordered inside a shard by another hash. All draws are seeded, so reruns agree.

Only per-source totals (and the quotas, sources times shards) are on the driver, so sources may number about a million; up to
200,000 are broadcast, more are joined by shuffle. Per-block sums are prefix-summed in Spark.

Cases: null text counts 0 words and is never needed for a target (taken 0 words, kept or not); null sources are one
source; repeated rows are rows of their own; extra columns are ignored; without any words all targets are 0.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from secspark.llm.common import columns, free_names, materialize, read_table, sized_broadcast

WEIGHTS = (3.0, 1.0, 2.0)
#: Words of a part of a shard.
PART = 1_000_000
#: Step of the permutation of blocks; coprime to any count that it doesn't divide.
PRIME = 7919


def allocate(sizes: list[float], weights: list[float], budget: float, max_epochs: float) -> list[float]:
    """Targets by weight, none above ``max_epochs`` times its size; the excess goes to the others by weight."""
    cap = [max_epochs * s for s in sizes]
    target = [0.0] * len(sizes)
    open_, rest = list(range(len(sizes))), min(budget, sum(cap))
    while open_:
        share = rest / sum(weights[i] for i in open_)
        full = [i for i in open_ if share * weights[i] >= cap[i]]
        if not full:
            for i in open_:
                target[i] = share * weights[i]
            break
        for i in full:
            target[i] = cap[i]
            rest -= cap[i]
        open_ = [i for i in open_ if i not in set(full)]
    return target


def split_quotas(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """Block quotas (source x shard): every node deals its blocks to its two halves without replacement."""
    out = np.zeros((len(counts), shards), np.int64)

    def node(have: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[:, lo] = have
            return
        mid = (lo + hi) // 2
        total = int(have.sum())
        left_total = total * (mid - lo) // (hi - lo)
        rng = np.random.default_rng(int.from_bytes(hashlib.sha256(f"{seed}:{lo}:{hi}".encode()).digest()[:8], "little"))
        left = rng.multivariate_hypergeometric(have, left_total, method="marginals") if total else np.zeros_like(have)
        node(left, lo, mid)
        node(have - left, mid, hi)

    node(np.asarray(counts, np.int64), 0, shards)
    return out


def mix_sources(docs: DataFrame, weights=WEIGHTS, budget: float = 1.5, max_epochs: int = 2, shards: int = 64, rows_per_block: int = 256, max_blocks: int = 1 << 16, seed: int = 7, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Rows ``(doc_id, size, source, source_size, target, copies, taken, shard, shard_order)``, one for each row of ``docs``.

    ``shard`` is where the first copy goes (null if none is taken); a second copy goes half the shards further on.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    size = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = materialize(d.select("doc_id", "source", F.coalesce(size, F.lit(0).cast("long")).alias("size"), F.xxhash64(F.lit(seed), "doc_id", "source", F.length("text")).alias("r")), "sizes")

    totals = rows.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("rows")).collect()
    totals.sort(key=lambda t: (t["source"] is None, (t["source"] or "").encode()))
    words = [int(t["words"]) for t in totals]
    target = allocate(words, [weights[i % len(weights)] for i in range(len(words))], budget * sum(words), max_epochs)
    plan, blocks = [], []
    for i, t in enumerate(totals):
        whole = min(int(target[i] // words[i]), max_epochs) if words[i] else 0
        n = min(max_blocks, max(1, -(-int(t["rows"]) // rows_per_block)))
        blocks.append(n)
        plan.append((t["source"], i, words[i], float(target[i]), whole, float(target[i] - whole * words[i]), n))
    side = spark.createDataFrame(plan, "source string, sid int, source_size long, target double, whole int, rest double, blocks long")
    rows = rows.join(sized_broadcast(side, len(plan)), rows["source"].eqNullSafe(side["source"])).drop(side["source"])
    # the block of a row: its place in hash order; pmod by a prefix of the hash keeps neighbours together
    unit = (F.shiftrightunsigned("r", 11).cast("double")) / F.lit(float(1 << 53))
    rows = rows.withColumn("block", F.least(F.floor(unit * F.col("blocks")), F.col("blocks") - 1).cast("long"))

    per = rows.groupBy("sid", "block").agg(F.sum("size").alias("bs"), F.first("rest").alias("rest"))
    before = Window.partitionBy("sid").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("below", F.coalesce(F.sum("bs").over(before), F.lit(0)))
    # the first block that passes the remainder is the edge; blocks below it are taken whole
    per = per.withColumn("state", F.when(F.col("below") + F.col("bs") <= F.col("rest"), 1).when(F.col("below") <= F.col("rest"), 2).otherwise(0))
    per = materialize(per.select("sid", "block", "below", "state"), "blocks")
    rows = rows.join(per, ["sid", "block"])
    inside = Window.partitionBy("sid", "block").orderBy("r", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = rows.where("state = 2").withColumn("through", F.col("below") + F.sum("size").over(inside))
    edge = edge.withColumn("extra", (F.col("through") - F.col("size") / 2 <= F.col("rest")).cast("int"))
    others = rows.where("state <> 2").withColumn("through", F.lit(None).cast("long")).withColumn("extra", F.col("state"))
    taken = edge.unionByName(others).withColumn("copies", F.least(F.col("whole") + F.col("extra"), F.lit(max_epochs)).cast("int"))

    # drawn blocks are the first ones in hash order, a random draw; a bijection permutes them before they fill the quotas
    drawn = {r["sid"]: int(r["n"]) for r in per.where("state > 0").groupBy("sid").agg((F.max("block") + 1).alias("n")).collect()}
    drawn = [blocks[p[1]] if p[4] else drawn.get(p[1], 0) for p in plan]
    quotas = np.cumsum(split_quotas(drawn, shards, seed), axis=1)
    deal = spark.createDataFrame([(i, n, [int(x) for x in q]) for i, (n, q) in enumerate(zip(drawn, quotas, strict=True))], "sid int, drawn long, quotas array<long>")
    taken = taken.join(sized_broadcast(deal, len(plan)), "sid")
    step = F.when(F.col("drawn") % PRIME == 0, 1).otherwise(PRIME)
    taken = taken.withColumn("slot", F.when(F.col("drawn") > 0, F.pmod(F.col("block") * step + F.col("sid"), F.greatest("drawn", F.lit(1)))))
    slot = F.size(F.filter("quotas", lambda q: q <= F.col("slot")))
    return taken.select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), F.when(F.col("copies") > 0, slot).alias("shard"), F.xxhash64(F.lit(seed + 1), "r").alias("shard_order"))


def copy_shard(shard: Column, copy: Column, shards: int, max_epochs: int) -> Column:
    """Where copy 1, 2, ... goes: of two copies, the second half the shards further on."""
    return F.pmod(shard + F.floor((copy - 1) * shards / max_epochs), F.lit(shards)).cast("int")


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", shards: int = 64, max_epochs: int = 2, **options) -> DataFrame:
    """``docs`` as mixed: rows not taken go, rows taken twice come twice; the columns stay. Each shard's rows lie together, in
    the shard's order (of a large shard, part after part). Rows that share id and source are taken alike, as often as the most taken of them."""
    plan = mix_sources(docs, id_col=id_col, source_col=source_col, text_col=text_col, shards=shards, max_epochs=max_epochs, **options)
    own_id, own_source, m, copy, shard, order, part = free_names(docs, "m_id", "m_source", "m", "m_copy", "m_shard", "m_order", "m_part")
    best = F.max(F.struct("copies", "shard", "shard_order", "taken")).alias(m)
    plan = materialize(plan.groupBy(F.col("doc_id").alias(own_id), F.col("source").alias(own_source)).agg(best).where(F.col(m)["copies"] > 0), "plan")
    # a shard is dealt in parts, ranges of its order, so that a task's rows don't grow with the input
    words = plan.agg(F.sum(F.col(m)["taken"])).first()[0] or 0
    parts = max(1, -(-words // (shards * PART)))
    both = docs.join(plan, docs[id_col].cast("long").eqNullSafe(F.col(own_id)) & docs[source_col].cast("string").eqNullSafe(F.col(own_source)))
    copies = both.select(*columns(docs), m, F.explode(F.sequence(F.lit(1), F.col(m)["copies"])).alias(copy))
    place = F.when(F.col(copy) == 1, F.col(m)["shard_order"]).otherwise(F.xxhash64(F.col(m)["shard_order"], copy))
    placed = copies.withColumn(shard, copy_shard(F.col(m)["shard"], F.col(copy), shards, max_epochs)).withColumn(order, place)
    unit = F.shiftrightunsigned(F.col(order).bitwiseXOR(F.lit(-(1 << 63))), 11).cast("double") / F.lit(float(1 << 53))
    placed = placed.withColumn(part, F.least(F.floor(unit * parts), F.lit(parts - 1)))
    return placed.repartition(shard, part).sortWithinPartitions(shard, part, order).drop(m, copy, shard, order, part)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "shard", "shard_order")

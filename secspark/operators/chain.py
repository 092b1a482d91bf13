"""Hash chains: build by one fold per chain, verify in parallel.

``data_hash = H(data)``; ``hash = H([prev '|'] data_hash seq)`` with both hashes as hex text and the sequence as eight
little-endian bytes, the first node without a predecessor. H is SHA-256, which runs in the JVM, or BLAKE3
(``functions.blake3``), which runs in Arrow batches.

Cases: null data counts as empty; a row without a sequence is in no chain; rows repeating a sequence are nodes one after the
other; a null chain is a chain like others, and chains may be named by any type; a node without a hash is a violation; no rows
give no nodes and no violations; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from secspark.functions.blake3 import blake3

HASHES = {"sha256": lambda b: hashlib.sha256(b).hexdigest(), "blake3": lambda b: blake3([b])[0].hex()}


def little_endian(seq: Column) -> Column:
    """Eight bytes, the lowest first."""
    h = F.lpad(F.hex(seq.cast("long")), 16, "0")
    return F.unhex(F.concat(*[F.substring(h, 15 - 2 * i, 2) for i in range(8)]))


def node_hash(prev: Column, data_hash: Column, seq: Column) -> Column:
    """SHA-256 of a node."""
    return F.sha2(F.concat(F.coalesce(F.concat(prev, F.lit("|")), F.lit("")).cast("binary"), data_hash.cast("binary"), little_endian(seq)), 256)


def next_hash(prev: str | None, data_hash: str, seq: int, algorithm: str = "sha256") -> str:
    return HASHES[algorithm]((f"{prev}|" if prev else "").encode() + data_hash.encode() + int(seq).to_bytes(8, "little", signed=seq < 0))


def _fold(algorithm: str):
    """Rows come sorted by chain and sequence; only the running hash is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = prev = None
        first = True
        for b in batches:
            prevs, hashes = [], []
            for c, s, d in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if first or c != chain:
                    chain, prev, first = c, None, False
                prevs.append(prev)
                prev = next_hash(prev, d, s, algorithm)
                hashes.append(prev)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(prevs, pa.string()), pa.array(hashes, pa.string())], ["chain", "seq", "data_hash", "prev_hash", "hash"])

    return run


def build(rows: DataFrame, algorithm: str = "sha256") -> DataFrame:
    """``rows (chain, seq, data)`` to nodes ``(chain, seq, data_hash, prev_hash, hash)``; data hashes are made in parallel, and the
    fold streams over sorted rows."""
    data = F.coalesce(F.col("data").cast("binary"), F.lit(b""))
    data_hash = F.sha2(data, 256) if algorithm == "sha256" else blake3_hex(data)
    hashed = rows.where("seq is not null").select("chain", F.col("seq").cast("long"), data_hash.alias("data_hash"))
    return hashed.repartition("chain").sortWithinPartitions("chain", "seq").mapInArrow(_fold(algorithm), f"chain {rows.schema['chain'].dataType.simpleString()}, seq long, data_hash string, prev_hash string, hash string")


def blake3_hex(data: Column) -> Column:
    """BLAKE3 of a column's bytes as hex; null for null."""

    @F.pandas_udf("string")
    def run(s):
        some = s.notna()
        out = s.where(~some, None).astype(object)
        out[some] = [d.hex() for d in blake3([bytes(x) for x in s[some]])]
        return out

    return run(data.cast("binary"))


def heads(rows: DataFrame) -> DataFrame:
    """``(chain, seq, hash)`` of each chain's last node."""
    return build(rows).groupBy("chain").agg(F.max("seq").alias("seq"), F.max_by("hash", "seq").alias("hash"))


def verify(nodes: DataFrame, full: bool = True, from_seq: int | None = None, from_hash: str | None = None) -> DataFrame:
    """Violations ``(chain, seq, reason)``; no rows for intact chains. ``full`` recomputes every node's hash.

    ``from_seq``: check only later nodes; ``from_hash``: the hash that the first of them must point to.
    """
    if from_seq is not None:
        nodes = nodes.where(F.col("seq") > from_seq)
    w = Window.partitionBy("chain").orderBy("seq")
    n = nodes.withColumns({"before": F.lag("seq").over(w), "link": F.lag("hash").over(w)})
    first = F.col("before").isNull()
    expected = F.lit(from_hash) if from_hash is not None else F.lit(None).cast("string")
    reason = F.when(~first & (F.col("seq") != F.col("before") + 1), "gap")
    reason = reason.when(~first & ~F.col("prev_hash").eqNullSafe(F.col("link")), "link")
    if from_seq is None:
        reason = reason.when(first & F.col("prev_hash").isNotNull(), "first")
    elif from_hash is not None:
        reason = reason.when(first & ~F.col("prev_hash").eqNullSafe(expected), "checkpoint")
    if full:
        reason = reason.when(F.coalesce(F.col("hash") != node_hash(F.col("prev_hash"), F.col("data_hash"), F.col("seq")), F.lit(True)), "hash")
    return n.select("chain", "seq", reason.alias("reason")).where("reason is not null")


def damaged(records: DataFrame) -> DataFrame:
    """Records ``(seq, data, crc)`` whose bytes don't have their CRC, and gaps in the sequence: nothing ends silently. A gap is a
    record, not the first, without the one before it; that takes a join by sequence and no sort of all records."""
    bad = records.where(~F.crc32(F.col("data").cast("binary")).eqNullSafe(F.col("crc"))).select("seq", F.lit("crc").alias("reason"))
    seqs = records.select("seq").distinct()
    first = records.agg(F.min("seq").alias("first"))
    gap = seqs.join(seqs.select((F.col("seq") + 1).alias("seq")), "seq", "left_anti").join(F.broadcast(first), F.col("seq") > F.col("first"))
    return bad.unionByName(gap.select("seq", F.lit("gap").alias("reason")))


def truncate(records: DataFrame, before: int) -> DataFrame:
    """Records from ``before`` on, and always those of the newest file ``(seq, file, ...)``: it may still be written to."""
    newest = records.agg(F.max("file").alias("newest"))
    return records.join(F.broadcast(newest)).where((F.col("seq") >= before) | (F.col("file") == F.col("newest"))).drop("newest")


def read_from(records: DataFrame, seq: int, inclusive: bool = True) -> DataFrame:
    """Replay from a sequence, one record for each, in order; exclusive reading from 0 starts at the beginning."""
    keep = F.col("seq") >= seq if inclusive or seq == 0 else F.col("seq") > seq
    return records.where(keep).dropDuplicates(["seq"]).orderBy("seq")

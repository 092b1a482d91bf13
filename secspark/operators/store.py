"""Tables of one store: append, versions, compaction, statistics, histograms, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from secspark.errors import InvalidQuery, StorageError
from secspark.operators.query import latest
from secspark.scratch import exists, remove, scratch_dir

L0_TRIGGER, LEVEL_BYTES, MAX_LEVELS, LEVEL_PICK = 4, 640 << 20, 7, 4
CODECS = ("none", "snappy", "zstd")


class Store:
    """Parquet tables under one path, one folder for each kind and version; a committed append is durable.

    ``_current_<kind>`` (a table of one row) names the version that readers see. Compaction writes a new version and then
    switches that name, so a failure leaves the old one whole. Reading a kind that was never written raises StorageError.
    """

    def __init__(self, spark: SparkSession, path: str, codec: str = "zstd"):
        if codec not in CODECS:
            raise InvalidQuery(f"unknown codec {codec}")
        self.spark, self.path, self.codec = spark, path, codec

    def _folder(self, kind: str) -> str:
        name = f"{self.path}/_current_{kind}"
        version = self.spark.read.parquet(name).agg(F.max("version")).first()[0] if exists(self.spark, name) else 0
        return f"{self.path}/{kind}/v{version}"

    def append(self, kind: str, df: DataFrame, by: tuple[str, ...] = ()) -> None:
        w = df.write.mode("append").option("compression", self.codec).option("parquet.bloom.filter.enabled#id", "true")
        (w.partitionBy(*by) if by else w).parquet(self._folder(kind))

    def append_numbered(self, kind: str, df: DataFrame, order: str) -> DataFrame:
        """Append rows and return their ids ``(position, id)`` in the order given. Ids are version 4 UUIDs."""
        rows = df.withColumn("id", F.expr("uuid()"))
        path = scratch_dir(self.spark, "batch")
        rows.write.parquet(path)  # ids are drawn once
        self.append(kind, self.spark.read.parquet(path))
        return self.spark.read.parquet(path).select(F.col(order).alias("position"), "id").orderBy("position")

    def read(self, kind: str) -> DataFrame:
        folder = self._folder(kind)
        if not exists(self.spark, folder):
            raise StorageError(f"no {kind} in {self.path}")
        return self.spark.read.parquet(folder)

    def has(self, kind: str) -> bool:
        return exists(self.spark, self._folder(kind))

    def get(self, kind: str, id_) -> DataFrame:
        """Rows of one kind with an id; files without it are skipped by their bloom filters and statistics."""
        return self.read(kind).where(F.col("id") == id_)

    def get_any(self, id_, kinds: tuple[str, ...], version: str = "seq") -> DataFrame:
        """``(kind, id, record)``: the newest row with an id in each of the kinds, as JSON."""
        if not kinds:
            raise StorageError(f"no records in {self.path}")
        found = [latest(self.get(k, id_), "id", version).select(F.lit(k).alias("kind"), "id", F.to_json(F.struct("*")).alias("record")) for k in kinds]
        out = found[0]
        for f in found[1:]:
            out = out.unionByName(f)
        return out

    def scan_sorted(self, kind: str, key: str = "id") -> DataFrame:
        return self.read(kind).orderBy(key)

    def files(self, kind: str) -> DataFrame:
        """The manifest: ``(path, size, rows, min_id, max_id)`` of each file."""
        meta = self.read(kind).select("id", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"))
        return meta.groupBy("path").agg(F.first("size").alias("size"), F.count("*").alias("rows"), F.min("id").alias("min_id"), F.max("id").alias("max_id"))

    def compact(self, kind: str, key: str = "id", version: str = "seq") -> dict:
        """A new version of one table with the newest row of each key, ordered by key; returns counts."""
        df, old = self.read(kind), self._folder(kind)
        before = df.count()
        number = int(old.rpartition("/v")[2]) + 1
        new = f"{self.path}/{kind}/v{number}"
        remove(self.spark, new)  # of an attempt that failed
        latest(df, key, version).repartitionByRange(key).sortWithinPartitions(key).write.option("compression", self.codec).option("parquet.bloom.filter.enabled#id", "true").parquet(new)
        after = self.spark.read.parquet(new).count()
        self.spark.createDataFrame([(number,)], "version int").coalesce(1).write.mode("append").parquet(f"{self.path}/_current_{kind}")
        remove(self.spark, old)
        return {"read": before, "kept": after, "dropped": before - after}


def pick_compaction(files: DataFrame, trigger: int = L0_TRIGGER, budget: int = LEVEL_BYTES, pick: int = LEVEL_PICK) -> DataFrame:
    """Files ``(path, level, size, created)`` of the next compaction: level 0 if it has enough, else the oldest of the
    lowest level over its budget (ten times more for each level)."""
    per = files.groupBy("level").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    over = ((F.col("level") == 0) & (F.col("n") >= trigger)) | ((F.col("level") > 0) & (F.col("level") < MAX_LEVELS) & (F.col("n") >= 2) & (F.col("bytes") > budget * F.pow(F.lit(10.0), F.col("level") - 1)))
    level = per.where(over).agg(F.min("level").alias("pick"))
    rows = files.join(F.broadcast(level), F.col("level") == F.col("pick"))
    old = F.slice(F.array_sort(F.collect_list(F.struct("created", "path", "level"))), 1, pick)
    few = rows.where("level > 0").groupBy("level").agg(old.alias("f")).select(F.explode("f").alias("f")).select("f.path", "f.level")
    return rows.where("level = 0").select("path", "level").unionByName(few)


def kind_stats(rows: DataFrame) -> DataFrame:
    """``(kind, n, bytes, oldest, newest)`` of tagged rows ``(kind, payload, ts_ms)``."""
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.octet_length("payload").cast("long")).alias("bytes"), F.min("ts_ms").alias("oldest"), F.max("ts_ms").alias("newest"))


def histogram(df: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """``(edge, n)``: rows at or below each edge and above the one before; values beyond the last are in none."""
    col = F.col(value)
    edge = F.when(col <= edges[0], edges[0])
    for e in edges[1:]:
        edge = edge.when(col <= e, e)
    found = df.select(edge.cast("double").alias("edge")).where("edge is not null").groupBy("edge").agg(F.count("*").alias("n"))
    every = df.sparkSession.createDataFrame([(float(e),) for e in edges], "edge double")
    return every.join(found, "edge", "left").select("edge", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def histogram_stats(df: DataFrame, value: str) -> DataFrame:
    """Count, sum of whole parts, and their quotient."""
    s = F.coalesce(F.sum(F.col(value).cast("long")), F.lit(0))
    return df.agg(F.count(value).alias("count"), s.alias("sum")).select("count", "sum", F.when(F.col("count") > 0, F.col("sum") / F.col("count")).otherwise(0.0).alias("mean"))


def metrics_snapshot(df: DataFrame) -> DataFrame:
    """Rows ingested, bytes, failures (unreadable metadata) and their share."""
    bad = F.expr("try_parse_json(meta) is null").cast("long")
    return df.agg(F.count("*").alias("events"), F.sum(F.octet_length("raw").cast("long")).alias("bytes"), F.sum(bad).alias("errors"))

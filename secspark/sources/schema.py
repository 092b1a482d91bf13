"""Record schemas, and the driver's tables seen as logs, artifacts and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOGS = "id string, timestamp_ms bigint, ts timestamp_ntz, event_type string, source struct<host:string,ip:string,collector:string,format:string>, raw_data binary, metadata_json string, vector array<float>"
ARTIFACTS = "id string, hash_sha256 binary, file_type string, file_size bigint, capabilities bigint, imports array<string>, strings array<string>, vector array<float>, related_logs array<string>, timestamp_ms bigint"
LINKS = "field string, value string, refs array<string>"
CORRELATIONS = "source_id string, target_id string, kind string, score double"
API_EVENT = "id struct<hi:decimal(20,0),lo:decimal(20,0)>, event_type string, source_host string, source_ip string, collector string, format string, raw_data string, metadata string, vector array<float>"
API_ARTIFACT = "id struct<hi:decimal(20,0),lo:decimal(20,0)>, hash_sha256 string, file_type string, file_size bigint, imports array<string>, strings array<string>, vector array<float>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_ms(ts: Column | str) -> Column:
    """Milliseconds of a timestamp without zone."""
    name = ts if isinstance(ts, str) else "ts"
    return F.expr(f"timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', {name})")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, ts, ts_ms, event_type, host, meta, value)``."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), "ts", epoch_ms("ts").alias("ts_ms"), "event_type", F.col("user_id").alias("host"), F.col("props").alias("meta"), "value")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def text_logs(spark: SparkSession, sf_dir: str, with_vectors: bool = False) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("raw"), F.lit("").alias("meta"))
    return d.join(vectors(spark, sf_dir).select("id", "vec"), "id", "left") if with_vectors else d


def hash_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose text carries the hash of their user."""
    h = F.sha2(F.col("user_id").cast("string"), 256)
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.concat(F.lit('{"hash":"'), h, F.lit('"}')).alias("raw"), F.col("props").alias("meta"))


def user_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "events").select(F.col("user_id").alias("id")).distinct()
    return u.select("id", F.sha2(F.col("id").cast("string"), 256).alias("hash"), F.array(F.lit("")).alias("strings"))


def text_artifacts(spark: SparkSession, sf_dir: str, with_vectors: bool = False) -> DataFrame:
    """Benchmark passages as artifacts; their vectors are those of the ids from 100 on."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.sha2("text", 256).alias("hash"), F.array("text").alias("strings"))
    v = vectors(spark, sf_dir).select((F.col("id") - 100).alias("id"), "vec")
    return b.join(v, "id", "left") if with_vectors else b

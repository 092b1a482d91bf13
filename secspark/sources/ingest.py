"""JSON and security-log formats to records; embedding interface; builders' defaults."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from secspark.functions import scalar as S
from secspark.sources import schema

#: Lengths that a record's vector may have.
MAX_DIM = 4096
FORMATS = ("OCSF", "STIX", "TAXII", "Zeek", "Suricata", "PEHeader", "CEF", "LEEF", "Raw")


def valid_vector(v: Column) -> Column:
    """The vector, or null where its length isn't 1 to 4096."""
    return F.when(F.size(v).between(1, MAX_DIM), v)


def events_from_json(text: DataFrame, col: str = "value") -> DataFrame:
    """API events: defaults are an empty string, format Raw and no vector; the types' own names are kept."""
    e = text.select(F.from_json(col, schema.API_EVENT).alias("e")).select("e.*")
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    return e.select(empty("event_type").alias("event_type"), empty("source_host").alias("host"), F.col("source_ip").alias("ip"), empty("collector").alias("collector"), F.coalesce("format", F.lit("Raw")).alias("format"), empty("raw_data").alias("raw"), F.coalesce("metadata", F.lit("{}")).alias("meta"), valid_vector(F.col("vector")).alias("vec"))


def artifacts_from_json(text: DataFrame, col: str = "value") -> DataFrame:
    """API artifacts with ``error``: null where the hash is 32 bytes of hex."""
    a = text.select(F.from_json(col, schema.API_ARTIFACT).alias("a")).select("a.*")
    ok = S.parse_hash(F.col("hash_sha256"))
    return a.select(ok.alias("hash"), S.api_file_type(F.col("file_type")).alias("file_type"), F.coalesce("file_size", F.lit(0)).alias("file_size"), F.when(ok.isNull(), F.lit("hash must be 32 bytes of hex")).alias("error"))


def parse(text: DataFrame, fmt: str, col: str = "value") -> DataFrame:
    """``(event_type, host, ip, valid)`` of lines in a security-log format; ``valid`` is false where a line isn't of it."""
    v = F.col(col)
    js = lambda p: F.get_json_object(v, p)
    if fmt == "CEF":
        parts = F.split(v, r"(?<!\\)\|", 8)
        ok = v.startswith("CEF:") & (F.size(parts) == 8)
        kind, ext = F.get(parts, F.lit(5)), F.get(parts, F.lit(7))
        host, ip = (F.nullif(F.regexp_extract(ext, p, 1), F.lit("")) for p in (r"(?:^|\s)shost=(\S+)", r"(?:^|\s)src=(\S+)"))
    elif fmt == "LEEF":
        parts = F.split(v, r"\|", 6)
        ok = v.startswith("LEEF:") & (F.size(parts) >= 5)
        kind, ext = F.get(parts, F.lit(4)), F.coalesce(F.get(parts, F.lit(5)), F.lit(""))
        host, ip = (F.nullif(F.regexp_extract(ext, p, 1), F.lit("")) for p in (r"(?:^|\t)identHostName=([^\t]+)", r"(?:^|\t)src=([^\t]+)"))
    elif fmt == "Zeek":
        parts = F.split(v, "\t")
        ok = ~v.startswith("#") & (F.size(parts) >= 6)
        kind, host, ip = F.lit("NetworkConnection"), F.lit(None).cast("string"), F.get(parts, F.lit(2))
    elif fmt in ("OCSF", "STIX", "TAXII", "Suricata"):
        path = {"OCSF": ("$.class_name", "$.device.hostname", "$.src_endpoint.ip"), "STIX": ("$.type", "$.name", "$.value"), "TAXII": ("$.objects[0].type", "$.objects[0].name", "$.objects[0].value"), "Suricata": ("$.event_type", "$.host", "$.src_ip")}[fmt]
        kind, host, ip = map(js, path)
        ok = kind.isNotNull()
    else:
        kind, host, ip, ok = F.lit("Raw"), F.lit(None).cast("string"), F.lit(None).cast("string"), v.isNotNull()
    return text.select(F.when(ok, kind).alias("event_type"), F.when(ok, host).alias("host"), F.when(ok, ip).alias("ip"), F.coalesce(ok, F.lit(False)).alias("valid"))


class Embedder:
    """Texts to vectors; ``embed_batch`` is what runs, in Arrow batches."""

    dimension = 128

    def embed(self, text: str) -> list[float]:
        raise NotImplementedError

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        return [self.embed(t) for t in texts]


class NoOpEmbedder(Embedder):
    def __init__(self, dimension: int = 128):
        self.dimension = dimension

    def embed(self, text: str) -> list[float]:
        return [0.0] * self.dimension


class HashEmbedder(Embedder):
    """Deterministic values in [-1, 1) from a hash of the text."""

    def __init__(self, dimension: int = 16):
        self.dimension = dimension

    def embed(self, text: str) -> list[float]:
        seed = int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "little")
        return [float(x) for x in np.random.default_rng(seed).uniform(-1, 1, self.dimension)]


def embed(df: DataFrame, col: str, embedder: Embedder, out: str = "vec") -> DataFrame:
    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(embedder.embed_batch(b.fillna("").tolist()))

    return df.withColumn(out, run(F.col(col)))

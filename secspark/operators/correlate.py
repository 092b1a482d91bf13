"""Correlation of logs with artifacts by vector, hash and file name; links built from it.

``logs (id, raw, meta[, vec])``, ``artifacts (id, hash, strings[, vec])``; results ``(source_id, target_id, kind, score)``.

Cases: rows with a null id take no part; null texts, hashes, strings and vectors match nothing; rows that share an id count as one
record; empty tables give no rows. Ids may be of any type; other columns are ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from secspark.operators import search

try:
    import ahocorasick
except ImportError:  # the window joins below do the same
    ahocorasick = None

THRESHOLD, LIMIT, SHORT, LEAST_BYTES = 0.85, 100, 16, 5
#: Artifact strings, and their bytes, up to which they are shipped to all tasks for the containment test.
SHIPPED_STRINGS, SHIPPED_BYTES = 50_000, 8 << 20
_RANK = "CASE kind WHEN 'VectorSimilarity' THEN 0 WHEN 'HashMatch' THEN 1 ELSE 2 END"


def _rows(df: DataFrame, kind: str, score) -> DataFrame:
    return df.select("source_id", "target_id", F.lit(kind).alias("kind"), score.cast("double").alias("score"))


def by_vector(logs: DataFrame, artifacts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs over a similarity; of records that share an id every vector counts."""
    p = search.similar_pairs(logs.select("id", "vec"), artifacts.select("id", "vec"), threshold)
    return _rows(p.withColumnsRenamed({"a": "source_id", "b": "target_id"}), "VectorSimilarity", F.col("score"))


def _contained(strings):
    """``(source_id, target_id)`` of the logs that contain any of ``(target_id, s)``: one pass over each text."""

    def run(frames):
        targets: dict = {}
        for t, s in strings.value:
            targets.setdefault(s, []).append(t)
        tree = ahocorasick.Automaton()
        for s in targets:
            tree.add_word(s, s)
        if targets:
            tree.make_automaton()
        for f in frames:
            out = []
            if targets:
                for i, raw, meta in zip(f["source_id"], f["raw"], f["meta"], strict=True):
                    hit = {s for text in (raw, meta) if text for _, s in tree.iter(text)}
                    out += [(i, t) for t in {t for s in hit for t in targets[s]}]
            yield pd.DataFrame(out, columns=["source_id", "target_id"])

    return run


def _containing(logs: DataFrame, strings: DataFrame) -> DataFrame:
    """Pairs of ``logs (id, raw, meta)`` and shipped ``strings (target_id, s)``, each once."""
    text = logs.select(F.col("id").alias("source_id"), "raw", "meta")
    side = logs.sparkSession.sparkContext.broadcast([(r["target_id"], r["s"]) for r in strings.collect()])
    return text.mapInPandas(_contained(side), f"source_id {search.id_type(text, 'source_id')}, target_id {search.id_type(strings, 'target_id')}")


def _shipped(strings: DataFrame, col: str) -> bool:
    """Whether the strings are few and short enough to be on every task."""
    if not ahocorasick:
        return False
    n = strings.limit(SHIPPED_STRINGS + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(col)), F.lit(0)).alias("bytes")).first()
    return n["n"] <= SHIPPED_STRINGS and n["bytes"] <= SHIPPED_BYTES


def _windows(text: Column, pattern: str) -> Column:
    """All matches of a pattern, overlapping ones too, in one pass over the text."""
    return F.regexp_extract_all(text, F.lit(f"(?=({pattern}))"), F.lit(1))


def by_hash(logs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Logs that contain an artifact's short hash, the first 16 digits in lower case; hashes that don't begin with 16 hex
    digits match nothing. Few hashes are shipped; else an equi-join: a short hash occurs in a text just if it is a
    16-character window of a run of hex digits."""
    logs, artifacts = (d.where("id is not null") for d in (logs, artifacts))
    hashes = artifacts.select(F.col("id").alias("target_id"), F.lower(F.substring("hash", 1, SHORT)).alias("short")).where(f"short rlike '^[0-9a-f]{{{SHORT}}}$'")
    if _shipped(hashes, "short"):
        return _rows(_containing(logs, hashes.withColumnRenamed("short", "s")).distinct(), "HashMatch", F.lit(1.0))
    found = F.concat(*[_windows(F.coalesce(F.col(c), F.lit("")), f"[0-9a-f]{{{SHORT}}}") for c in ("raw", "meta")])
    # windows are made distinct inside their row; pairs are few, so they are what is shuffled
    windows = logs.select(F.col("id").alias("source_id"), F.explode(F.array_distinct(found)).alias("short"))
    return _rows(windows.join(hashes, "short").select("source_id", "target_id").distinct(), "HashMatch", F.lit(1.0))


def by_filename(logs: DataFrame, artifacts: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """Strings of at least five bytes inside a log's text or metadata, one row for each pair. Few strings are shipped; else
    windows of a text, without the text, meet the strings' heads, and only texts with such a pair are read again."""
    logs, artifacts = (d.where("id is not null") for d in (logs, artifacts))
    strings = artifacts.select(F.col("id").alias("target_id"), F.explode("strings").alias("s")).where(F.octet_length("s") >= least).distinct()
    if _shipped(strings, "s"):
        return _rows(_containing(logs, strings).distinct(), "FilenameMatch", F.lit(0.9))
    heads = strings.withColumn("n", F.least(F.length("s"), F.lit(least)).cast("int")).withColumn("head", F.substring("s", F.lit(1), F.col("n")))
    texts = logs.select(F.col("id").alias("source_id"), F.explode(F.array(F.coalesce("raw", F.lit("")), F.coalesce("meta", F.lit("")))).alias("t"))
    lengths = sorted(r["n"] for r in heads.select("n").distinct().collect())  # at most ``least``
    if not lengths:
        return _rows(heads.select(F.lit(None).cast(logs.schema["id"].dataType).alias("source_id"), "target_id"), "FilenameMatch", F.lit(0.9))
    cut = [F.struct(F.lit(n).alias("n"), F.array_distinct(_windows(F.col("t"), f"(?s:.{{{n}}})")).alias("heads")) for n in lengths]
    windows = texts.select("source_id", F.explode(F.array(*cut)).alias("w")).select("source_id", "w.n", F.explode("w.heads").alias("head"))
    found = windows.join(heads, ["n", "head"]).select("source_id", "target_id", "s").distinct()
    both = found.join(texts, "source_id").where(F.col("t").contains(F.col("s")))
    return _rows(both.select("source_id", "target_id").distinct(), "FilenameMatch", F.lit(0.9))


def dedup(rows: DataFrame) -> DataFrame:
    """One row for each pair: the highest score; ties vector, hash, file name."""
    best = F.max_by(F.struct("kind", "score"), F.struct(F.col("score"), -F.expr(_RANK)))
    return rows.groupBy("source_id", "target_id").agg(best.alias("x")).select("source_id", "target_id", "x.kind", "x.score")


def limit_per_source(rows: DataFrame, n: int = LIMIT) -> DataFrame:
    w = Window.partitionBy("source_id").orderBy(F.desc("score"), "target_id")
    return rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).drop("rn")


def correlate_all(logs: DataFrame, artifacts: DataFrame, threshold: float = THRESHOLD, n: int = LIMIT, hashes: bool = True, filenames: bool = True) -> DataFrame:
    rows = []
    if "vec" in logs.columns and "vec" in artifacts.columns:
        rows.append(by_vector(logs, artifacts, threshold))
    rows += [by_hash(logs, artifacts)] * hashes + [by_filename(logs, artifacts)] * filenames
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return limit_per_source(dedup(out), n)


def swap(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "kind", "score")


def correlate_artifact(artifact: DataFrame, logs: DataFrame, **options) -> DataFrame:
    """One artifact (or several) against all logs: the artifact is the source, and the limit is on logs."""
    n = options.pop("n", LIMIT)
    return limit_per_source(swap(correlate_all(logs, artifact, n=2**31 - 1, **options)), n)


def by_ip(logs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Equal addresses: ``logs (id, ip)``, ``artifacts (id, ip)``."""
    a = logs.select(F.col("id").alias("source_id"), "ip").join(artifacts.select(F.col("id").alias("target_id"), "ip"), "ip").distinct()
    return _rows(a, "IpMatch", F.lit(1.0))


def index_entries(rows: DataFrame) -> DataFrame:
    """``(field, value, refs)``: the distinct sources of each target."""
    return rows.groupBy(F.lit("correlation").alias("field"), F.col("target_id").cast("string").alias("value")).agg(F.array_sort(F.collect_set("source_id")).alias("refs"))


def create_index(links: DataFrame) -> DataFrame:
    """Entries ``(field, value, refs)`` merged by key, refs as a set."""
    e = links.select("field", "value", F.explode_outer("refs").alias("r"))
    return e.groupBy("field", "value").agg(F.array_sort(F.collect_set("r")).alias("refs"))


def link_code_to_logs(artifacts: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``links (id, refs)`` appended to ``related_logs`` without repeats, and the reverse hash entries."""
    new = links.groupBy("id").agg(F.flatten(F.collect_list("refs")).alias("refs"))
    both = artifacts.join(new, "id", "left")
    out = both.withColumn("related_logs", F.array_sort(F.array_union("related_logs", F.coalesce("refs", F.expr("array()").cast(both.schema["refs"].dataType))))).drop("refs")
    entries = both.where("refs is not null").select(F.lit("hash").alias("field"), F.col("hash").alias("value"), F.array_sort(F.array_distinct("refs")).alias("refs"))
    return out, entries


def find_correlated(edges: DataFrame, id_) -> DataFrame:
    """Neighbours of an id in either direction of ``(source_id, target_id)``."""
    e = edges.select("source_id", "target_id")
    there = e.where(F.col("source_id") == id_).select(F.col("target_id").alias("id"))
    return there.union(e.where(F.col("target_id") == id_).select(F.col("source_id").alias("id"))).distinct()


def logs_for_hash(links: DataFrame, logs: DataFrame, hash_: str) -> DataFrame:
    refs = links.where((F.col("field") == "hash") & (F.col("value") == hash_)).select(F.explode("refs").alias("id")).distinct()
    return logs.join(refs, "id")

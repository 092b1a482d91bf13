"""Time partitions (hour, six hours, day; UTC), ranges and retention. ``ts`` is a timestamp without zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from secspark.errors import InvalidQuery, StorageError

HOURS = {"hourly": 1, "six_hour": 6, "daily": 24}


def window_index(ts: Column, window: str) -> Column:
    return F.floor(F.hour(ts) / HOURS[window]).cast("int")


def assign(df: DataFrame, window: str, ts_col: str = "ts") -> DataFrame:
    return df.withColumns({"date": F.to_date(ts_col), "win": window_index(F.col(ts_col), window)})


def bounds(df: DataFrame, window: str) -> DataFrame:
    """Adds start and exclusive end (epoch seconds), directory and file prefix to ``(date, win)``."""
    h = HOURS[window]
    start = F.unix_date("date").cast("long") * 86400 + F.col("win") * (3600 * h)
    hour = F.lpad((F.col("win") * h).cast("string"), 2, "0")
    return df.withColumns({"start_s": start, "end_s": start + 3600 * h, "dir": F.date_format("date", "yyyy-MM-dd"), "prefix": hour})


def for_range(spark: SparkSession, start_s: int, end_s: int, window: str) -> DataFrame:
    """Partitions that meet the closed range, in order."""
    if start_s > end_s:
        raise InvalidQuery("range starts after its end")
    width = 3600 * HOURS[window]
    n = spark.range(start_s // width, end_s // width + 1).select((F.col("id") * width).alias("s"))
    return n.select(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("s") / 86400).cast("int")).alias("date"), F.floor(F.pmod("s", F.lit(86400)) / width).cast("int").alias("win"))


def range_filter(df: DataFrame, start_s: int, end_s: int, window: str) -> DataFrame:
    """Rows of a table partitioned by (date, win) in a range: both partition columns are filtered too, so files are pruned."""
    day = lambda s: F.date_add(F.lit("1970-01-01").cast("date"), F.lit(s // 86400))
    win = lambda s: s % 86400 // (3600 * HOURS[window])
    first, last = day(start_s), day(end_s)
    after = (F.col("date") > first) | ((F.col("date") == first) & (F.col("win") >= win(start_s)))
    before = (F.col("date") < last) | ((F.col("date") == last) & (F.col("win") <= win(end_s)))
    ts = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    return df.where(F.col("date").between(first, last) & after & before & (ts >= start_s) & (ts <= end_s))


def stats(df: DataFrame) -> DataFrame:
    return df.groupBy("date", "win").agg(F.count("*").alias("n"), F.min("id").alias("min_id"), F.max("id").alias("max_id"))


def retention_candidates(parts: DataFrame, now_s: int, keep_s: int, window: str, at_least: int = 24) -> DataFrame:
    """Partitions strictly before the cutoff's; none where there are ``at_least`` or fewer in all."""
    width = 3600 * HOURS[window]
    parts = parts.select("date", "win").distinct()
    cut = (now_s - keep_s) // width * width
    start = F.unix_date("date").cast("long") * 86400 + F.col("win") * width
    total = parts.agg(F.count("*").alias("total"))
    return parts.crossJoin(F.broadcast(total)).where((F.col("total") > at_least) & (start < cut)).select("date", "win")


def enforce_retention(df: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows whose own window isn't among the candidates; other windows of the day stay."""
    return df.join(gone, ["date", "win"], "left_anti")


def delete_partitions(spark: SparkSession, path: str, gone: DataFrame) -> dict:
    """Deletes the folders ``date=.../win=...`` of ``gone (date, win)`` under ``path``; partitions deleted, bytes reclaimed, and an
    error for each that could not be. One that isn't there counts as none."""
    out = {"partitions_deleted": 0, "bytes_reclaimed": 0, "errors": []}
    files = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for r in gone.select(F.date_format("date", "yyyy-MM-dd").alias("date"), "win").collect():  # one row for each folder
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/date={r['date']}/win={r['win']}")
        try:
            if files.exists(where):
                size = files.getContentSummary(where).getLength()
                if not files.delete(where, True):
                    raise StorageError(f"{where.toString()} could not be deleted")
                out["partitions_deleted"] += 1
                out["bytes_reclaimed"] += size
        except Exception as e:
            out["errors"].append(f"{r['date']}/{r['win']}: {e}")
    return out


def rotation(entries: DataFrame, max_bytes: int, max_entries: int, max_age_ms: int = 300_000) -> DataFrame:
    """``(seq, file)`` of log entries ``(stream, seq, ts_ms, bytes)``: a new file begins where the current one has its bytes or entries,
    or is older than ``max_age_ms``. Each stream's entries are folded in order."""

    def run(batches):
        import pyarrow as pa

        stream = number = size = count = opened = None
        for b in batches:
            files = []
            for name, ts, n in zip(*(b.column(k).to_pylist() for k in ("stream", "ts_ms", "bytes")), strict=True):
                if name != stream or number is None:
                    stream, number, size, count, opened = name, 0, 0, 0, ts
                elif size + n > max_bytes or count >= max_entries or ts - opened >= max_age_ms:
                    number, size, count, opened = number + 1, 0, 0, ts
                size, count = size + n, count + 1
                files.append(number)
            yield pa.RecordBatch.from_arrays([b.column("stream"), b.column("seq"), pa.array(files, pa.int64())], ["stream", "seq", "file"])

    rows = entries.select(F.col("stream").cast("string"), F.col("seq").cast("long"), F.col("ts_ms").cast("long"), F.col("bytes").cast("long"))
    return rows.repartition("stream").sortWithinPartitions("stream", "seq").mapInArrow(run, "stream string, seq long, file long")

"""Structured Streaming: ingest with exactly-once files, windows, de-duplication, correlation, running chains, restart."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from secspark.operators import correlate
from secspark.operators.chain import next_hash


def read_files(spark: SparkSession, path: str, schema: str, per_trigger: int = 1, fmt: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).format(fmt).load(path)


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """All that is there now, then stop; the checkpoint makes a second run take up where this one ended."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


def run_batches(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> None:
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def deduplicated(stream: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def windowed(stream: DataFrame, ts: str, width: str, delay: str, by: str) -> DataFrame:
    w = F.window(ts, width)
    return stream.withWatermark(ts, delay).groupBy(w.alias("w"), by).agg(F.count("*").alias("n"))


def correlated(stream: DataFrame, artifacts: DataFrame, path: str, checkpoint: str) -> None:
    """Each batch of new logs against the known artifacts; a batch that is run again overwrites its own part."""

    def sink(batch: DataFrame, epoch: int) -> None:
        correlate.correlate_all(batch, artifacts).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    run_batches(stream, checkpoint, sink)


def chained(stream: DataFrame) -> DataFrame:
    """Running chains of ``(chain, seq, data_hash)``: nodes continue from the head that the state holds.

    Rows of a chain must arrive in order of ``seq``; inside a batch they are sorted.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        head = state.get[0] if state.exists else None
        f = pd.concat(list(frames)).sort_values("seq")
        out = []
        for s, d in zip(f["seq"], f["data_hash"], strict=True):
            h = next_hash(head, d, s)
            out.append((key[0], s, d, head, h))
            head = h
        state.update((head,))
        yield pd.DataFrame(out, columns=["chain", "seq", "data_hash", "prev_hash", "hash"])

    return stream.groupBy("chain").applyInPandasWithState(fold, f"chain {stream.schema['chain'].dataType.simpleString()}, seq long, data_hash string, prev_hash string, hash string", "head string", "append", "NoTimeout")

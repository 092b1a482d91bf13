"""A facade over one store: ingest and ask; every answer is a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from secspark.errors import StorageError
from secspark.functions import vectors as V
from secspark.operators import correlate, partition, search
from secspark.operators.query import QueryRequest, TimeRange
from secspark.operators.store import Store
from secspark.scratch import materialize


class Client:
    def __init__(self, spark: SparkSession, path: str, window: str = "hourly"):
        self.spark, self.store, self.window = spark, Store(spark, path), window

    def ingest_events(self, logs: DataFrame) -> None:
        self.store.append("logs", partition.assign(logs, self.window), ("date", "win"))

    def ingest_artifacts(self, artifacts: DataFrame) -> None:
        self.store.append("artifacts", artifacts)

    def event(self, id_) -> DataFrame:
        return self.store.get("logs", id_)

    def artifact(self, id_) -> DataFrame:
        return self.store.get("artifacts", id_)

    def events(self) -> DataFrame:
        return self.store.read("logs")

    def between(self, start_ms: int, end_ms: int) -> DataFrame:
        rows = self.events()
        if 0 <= start_ms <= end_ms:  # folders of other windows aren't read
            rows = partition.range_filter(rows, start_ms // 1000, end_ms // 1000, self.window)
        return QueryRequest(time_range=TimeRange(start_ms, end_ms)).run(rows).drop("total_matches")

    def query(self, request: QueryRequest) -> DataFrame:
        return request.run(self.events())

    def artifacts(self) -> DataFrame:
        return self.store.read("artifacts")

    def kinds(self) -> tuple[str, ...]:
        """Those of events and artifacts that the store has."""
        return tuple(k for k in ("logs", "artifacts") if self.store.has(k))

    def find_similar(self, vector, k: int = 10) -> DataFrame:
        """The nearest among events and artifacts: ``(kind, id, score)``."""
        kinds = self.kinds()
        if not kinds:
            raise StorageError(f"no vectors in {self.store.path}")
        return search.similar_of_kinds({name: self.store.read(name) for name in kinds}, V.literal(vector), k)

    def lookup(self, id_) -> DataFrame:
        """``(kind, id, record)`` of whatever has the id; the newest of each kind."""
        return self.store.get_any(id_, self.kinds(), "ts_ms")

    def correlate(self, **options) -> DataFrame:
        """The correlations found by this run; they and their links are appended to the store."""
        rows = materialize(correlate.correlate_all(self.events(), self.artifacts(), **options), "correlations")
        self.store.append("correlations", rows)
        self.store.append("links", correlate.index_entries(rows))
        return rows

    def find_correlated(self, id_) -> DataFrame:
        return correlate.find_correlated(self.store.read("correlations"), id_)

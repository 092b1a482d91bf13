"""Retry, rate limits and configuration of the driver's side of a store."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, fields, is_dataclass

from secspark.errors import InvalidQuery, SecsparkError, StorageError


def retry(run: Callable, attempts: int = 3, delay_s: float = 0.1, longest_s: float = 60.0, sleep: Callable = time.sleep):
    """``run()``, again after twice the delay each time while its error is recoverable; the last error is raised."""
    for i in range(max(1, attempts)):
        try:
            return run()
        except SecsparkError as e:
            if not e.recoverable or i + 1 >= attempts:
                raise
            sleep(min(longest_s, delay_s * 2**i))


class RateLimiter:
    """``capacity`` permits, all back after each interval; ``acquire`` raises a recoverable error when there are none."""

    def __init__(self, capacity: int, interval_s: float, clock: Callable = time.monotonic):
        self.capacity, self.interval_s, self.clock = capacity, interval_s, clock
        self.left, self.since = capacity, clock()

    def acquire(self) -> None:
        now = self.clock()
        if now - self.since >= self.interval_s:
            self.left, self.since = self.capacity, now
        if not self.left:
            raise StorageError("rate limit exceeded")
        self.left -= 1


class CachedClock:
    """Milliseconds since the epoch, read anew at most every ``step_ms``."""

    def __init__(self, step_ms: int = 1, clock: Callable = time.time):
        self.step_ms, self.clock, self.now_ms, self.read_ms = step_ms, clock, 0, -(1 << 62)

    def ms(self) -> int:
        t = int(self.clock() * 1000)
        if t - self.read_ms >= self.step_ms:
            self.now_ms = self.read_ms = t
        return self.now_ms


@dataclass
class Storage:
    path: str = "data"
    codec: str = "zstd"
    window: str = "hourly"
    compaction_files: int = 4
    retention_days: int = 30
    least_partitions: int = 24


@dataclass
class Index:
    exact_below: int = 1000
    target_recall: float = 0.95
    most_cells: int = 4096


@dataclass
class Ingestion:
    files_per_trigger: int = 1
    watermark: str = "10 minutes"
    dimension: int = 128


@dataclass
class Api:
    top_k: int = 10
    requests_per_second: int = 1000


@dataclass
class Config:
    """All settings; ``of`` reads JSON over the defaults and refuses names that it doesn't know."""

    storage: Storage = field(default_factory=Storage)
    index: Index = field(default_factory=Index)
    ingestion: Ingestion = field(default_factory=Ingestion)
    api: Api = field(default_factory=Api)

    @classmethod
    def of(cls, text: str) -> Config:
        def read(kind, values):
            known = {f.name: f for f in fields(kind)}
            if not isinstance(values, dict) or set(values) - set(known):
                raise InvalidQuery(f"unknown settings: {sorted(set(values) - set(known)) if isinstance(values, dict) else values}")
            now = kind()
            return kind(**{k: read(type(getattr(now, k)), v) if is_dataclass(getattr(now, k)) else type(getattr(now, k))(v) for k, v in values.items()})

        return read(cls, json.loads(text))

    def text(self) -> str:
        return json.dumps(asdict(self))

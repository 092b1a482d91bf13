"""Operator 10: quality by random Fourier features, ridge regression and isotonic calibration.

Statistics of the whole text (lengths, character classes, repeated words and lines) are standardised and mapped to random
Fourier features that approximate a Gaussian kernel. Each partition sums its part of the normal equations; the driver adds
the fixed number of partial sums and solves. Scores of a calibration fold, counted in 512 bins, are made monotone by
pooling adjacent violators and interpolated. Labels, language, source and doc_id are never inputs of a score.

Labelled training rows are at most ``max_train`` (a hash sample beyond it); statistics and scores cover all rows.

Cases: null and empty texts are scored like any other (all statistics 0); repeated rows have equal scores; rows with
a null doc_id or label don't train; of several labels of one doc_id each counts; extra columns are ignored; without
training rows of both labels every score is the share of label 1 (1.0 without any rows).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from secspark.llm.common import materialize, read_table
from secspark.llm.textbytes import text_chunks, word_bounds, word_hashes

#: Character classes counted by statistics, as byte sets.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "stop": b".,;:?'\"()-",
    "bang": b"!",
    "mark": b"#$%&*+/<=>@\\^_`{}~[]",
    "bar": b"|",
    "line": b"\n",
    "blank": b" \t\r\x0b\x0c",
    "high": bytes(range(128, 256)),
}
STATS = (*CLASSES, "log_bytes", "log_words", "mean_word", "long_word", "distinct", "repeat", "distinct_pairs", "distinct_lines")
#: Random features, partitions that sum the normal equations, most labelled training rows.
FEATURES, PARTS, MAX_TRAIN = 256, 16, 200_000
BINS = 512


def _per_row(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of ``values[at[i]:at[i + 1]]``."""
    sums = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return sums[at[1:]] - sums[at[:-1]]


def _distinct(keys: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Distinct keys of each row."""
    order = np.lexsort((keys, row))
    k, r = keys[order], row[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
    return np.bincount(r[new], minlength=rows)


_CODE = np.zeros(256, np.uint8)
for _i, _set in enumerate(CLASSES.values()):
    _CODE[list(_set)] = _i + 1


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of ``STATS`` for each text of a chunk."""
    rows = len(off) - 1
    out = np.zeros((rows, len(STATS)))
    size = np.maximum(np.diff(off), 1)
    of = np.repeat(np.arange(rows), np.diff(off))
    grid = np.bincount(of * 16 + _CODE[data], minlength=16 * rows).reshape(rows, 16)[:, 1 : len(CLASSES) + 1]
    n = len(CLASSES)
    out[:, :n] = grid / size[:, None]
    words, length, first = word_hashes(data, off)
    count = np.diff(first)
    row = np.repeat(np.arange(rows), count)
    some = np.maximum(count, 1)
    out[:, n] = np.log1p(np.diff(off))
    out[:, n + 1] = np.log1p(count)
    out[:, n + 2] = _per_row(length, first) / some
    out[:, n + 3] = _per_row(length > 20, first) / some
    if len(words):
        out[:, n + 4] = _distinct(words, row, rows) / some
        twin = np.zeros(len(words), np.int64)
        twin[1:] = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
        out[:, n + 5] = _per_row(twin, first) / some
        pair = words[:-1] * np.uint64(3) + words[1:]
        inner = row[1:] == row[:-1]
        pairs = np.bincount(row[1:][inner], minlength=rows)
        out[:, n + 6] = _distinct(pair[inner], row[1:][inner], rows) / np.maximum(pairs, 1)
    # a line's key is the sum of its words' hashes
    starts = np.flatnonzero(data == 10)
    if len(words):
        line = np.searchsorted(starts, word_bounds(data, off)[0]) + row * (len(starts) + 1)
        cut = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
        lines = np.bincount(row[cut], minlength=rows)
        out[:, n + 7] = _distinct(np.add.reduceat(words, cut), row[cut], rows) / np.maximum(lines, 1)
    return out


def _stats_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, j, data, off in text_chunks(b.column(1)):
            x = statistics(data, off)
            at = pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.ListArray.from_arrays(at, pa.array(x.ravel()))], ["doc_id", "x"])


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return materialize(d.mapInArrow(_stats_run, "doc_id long, x array<double>"), "statistics")


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATS))


class Fourier:
    """Standardisation and random features of a Gaussian kernel."""

    def __init__(self, mean: np.ndarray, std: np.ndarray, features: int = FEATURES, gamma: float | None = None, seed: int = 11):
        rng = np.random.default_rng(seed)
        d = len(mean)
        self.mean, self.std = mean, np.where(std > 1e-9, std, 1.0)
        self.w = rng.normal(size=(d, features)) * np.sqrt(2 * (gamma or 0.5 / d))
        self.b = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.std).clip(-8, 8)
        return np.hstack([np.cos(z @ self.w + self.b) * np.sqrt(2 / len(self.b)), np.ones((len(x), 1))])


def _sums_run(fourier: Fourier):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(fourier.b) + 1
        a, y = np.zeros((d, d)), np.zeros(d)
        for b in batches:
            if b.num_rows:
                z = fourier(_matrix(b.column("x")))
                a += z.T @ z
                y += z.T @ b.column("y").to_numpy().astype(float)
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary())], ["a", "y"])

    return run


def pool_adjacent(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of ``y`` (weights ``w``) on sorted ``x``: centres and means of the pooled blocks."""
    blocks: list[list[float]] = []
    for p, q, r in zip(x, y, w, strict=True):
        blocks.append([p * r, q * r, r])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [u + v for u, v in zip(blocks[-1], last, strict=True)]
    b = np.array(blocks)
    return b[:, 0] / b[:, 2], b[:, 1] / b[:, 2]


def _score_run(fourier: Fourier, beta: np.ndarray, knots: tuple[np.ndarray, np.ndarray] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = fourier(_matrix(b.column("x"))) @ beta if b.num_rows else np.zeros(0)
            s = s.clip(-1, 2)
            if knots is not None:
                # a slight slope keeps the order of scores inside a pooled block
                s = np.clip(np.interp(s, *knots) * 0.999 + (s + 1) / 3 * 0.001, 0, 1)
            rest = [b.column(c) for c in b.schema.names if c not in ("x", "score")]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(s, pa.float64())], [*[c for c in b.schema.names if c not in ("x", "score")], "score"])

    return run


def fold(doc_id: Column, n: int = 4) -> Column:
    """crc32 of the id's text modulo ``n``; null ids are in no fold."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def fit(stats: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, ridge: float = 1e-3):
    """Model of ``labels (doc_id, y)``: fold 3 calibrates, the folds given otherwise train. None without both labels."""
    rows = labels.where("doc_id is not null and y is not null").join(stats, "doc_id")
    rows = materialize(rows.select("x", F.col("y").cast("int").alias("y"), (fold(F.col("doc_id")) == 3).alias("cal"), F.xxhash64("doc_id").alias("h")), "training")
    n = rows.count()
    if n > max_train:
        share = max_train / n
        rows = rows.where(F.pmod("h", F.lit(1 << 20)) < int(share * (1 << 20)))
    about = rows.agg(*[f(F.col("x")[i]).alias(f"{p}{i}") for i in range(len(STATS)) for p, f in (("m", F.avg), ("s", F.stddev_pop))], F.avg("y").alias("y")).first()
    if about["y"] is None or about["y"] in (0.0, 1.0):
        return None, 1.0 if about["y"] is None else about["y"]
    mean, std = (np.array([about[f"{p}{i}"] for i in range(len(STATS))]) for p in "ms")
    fourier = Fourier(mean, std)
    # coalesced, so that no more than PARTS matrices reach the driver
    parts = rows.where("not cal").coalesce(PARTS).mapInArrow(_sums_run(fourier), "a binary, y binary").collect()
    d = FEATURES + 1
    a = sum(np.frombuffer(p["a"]).reshape(d, d) for p in parts)
    y = sum(np.frombuffer(p["y"]) for p in parts)
    beta = np.linalg.solve(a + ridge * max(1.0, a[-1, -1]) / d * np.eye(d), y)
    held = rows.where("cal").select("x", "y").mapInArrow(_score_run(fourier, beta, None), "y int, score double")
    counts = held.groupBy(F.round((F.col("score") + 1) / 3 * BINS).alias("bin")).agg(F.avg("score").alias("s"), F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("bin").collect()
    # half a row of each label at the ends keeps calibrated scores inside (0, 1)
    s = np.array([c["s"] for c in counts] or [0.5])
    knots = pool_adjacent(np.concatenate(([-1.0], s, [2.0])), np.array([0.0, *[c["y"] for c in counts or [{"y": about["y"]}]], 1.0]), np.array([0.5, *[float(c["n"]) for c in counts or [{"n": 1}]], 0.5]))
    return (fourier, beta, knots), about["y"]


def quality_scores(docs: DataFrame, labels: DataFrame, held_fold: int = 2, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = MAX_TRAIN) -> DataFrame:
    """Rows ``(doc_id, held_out, score, predicted)``, one for each row of ``docs``; fold ``held_fold`` never trains."""
    stats = document_statistics(docs, id_col, text_col)
    y = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).alias("y")).where(fold(F.col("doc_id")) != held_fold)
    model, share = fit(stats, y, max_train)
    if model is None:
        scored = stats.select("doc_id", F.lit(float(share)).alias("score"))
    else:
        scored = stats.mapInArrow(_score_run(*model), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == held_fold, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))

"""Operator 8: harmonic packing into sequences of ``capacity`` tokens.

A document is its token ids and one closing id 0. It is cut into whole sequences, then into pieces of 1/2, 1/4 and 1/8 of
the capacity as long as at least 1/16 remains, and one tail; so the tails of longer documents have 1/16 to 3/16. A piece of length L belongs to class k = capacity // L; a bin of class k takes exactly k pieces.
Classes 1, 2, 4 and 8 have pieces of exactly 1/k, without padding; others lose less than 1/(k+1) of their bins.
Each worker fills its own bins: no exchange, memory for one open bin a class. At a worker's end the pieces of unfilled
bins are laid one after another and cut at the sequences' ends, so only its last sequence is padded.

``sequence_id`` is the worker's number times 2**32 plus its count. Cases: null text is empty; an empty text is the
closing id alone; repeated rows are packed again; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from secspark.llm.common import read_table
from secspark.llm.tokens import encoder, packed, vocabulary_path

CAPACITY = 1024
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cut(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of a document of ``n`` tokens."""
    out = [capacity] * (n // capacity)
    rest, part = n % capacity, capacity // 2
    least = capacity // 8
    while part >= least and rest:
        # keep 1/16 for the tail, so that no tail is shorter in a longer document
        if rest == part or rest >= part + capacity // 16:
            out.append(part)
            rest -= part
        part //= 2
    if rest:
        out.append(rest)
    return out


class Packer:
    """One worker's bins. Pieces are ``(doc_id, start, length, ids, doc_tokens)``; rows come out with their places."""

    def __init__(self, worker: int, capacity: int = CAPACITY):
        self.capacity, self.next = capacity, worker << 32
        self.open: dict[int, list] = {}

    def _close(self, pieces: list) -> Iterator[tuple]:
        at = 0
        for doc, start, ids, total in pieces:
            yield doc, start, len(ids) // 4, zlib.crc32(ids), total, self.next, at
            at += len(ids) // 4
        self.next += 1

    def add(self, doc, ids: bytes) -> Iterator[tuple]:
        """``ids``: the document's packed ids with the closing one."""
        start, total = 0, len(ids) // 4
        for n in cut(total, self.capacity):
            k = self.capacity // n
            bin_ = self.open.setdefault(k, [])
            bin_.append((doc, start, ids[4 * start : 4 * (start + n)], total))
            start += n
            if len(bin_) == k:
                yield from self._close(self.open.pop(k))

    def finish(self) -> Iterator[tuple]:
        now, room = [], self.capacity
        for k in sorted(self.open):
            for doc, start, ids, total in self.open[k]:
                while ids:
                    part = ids[: 4 * room]
                    now.append((doc, start, part, total))
                    start, ids, room = start + len(part) // 4, ids[len(part) :], room - len(part) // 4
                    if not room:
                        yield from self._close(now)
                        now, room = [], self.capacity
        if now:
            yield from self._close(now)
        self.open = {}


def _run(path: str, capacity: int, batch_rows: int = 20_000):
    types = [pa.int64()] * 7
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        packer = Packer(TaskContext.get().partitionId(), capacity)
        rows: list[tuple] = []
        for b in batches:
            for doc, text in zip(b.column(0), b.column(1), strict=True):
                rows += packer.add(doc.as_py(), packed(enc.encode(text.as_py() or "") + [0]))
                if len(rows) >= batch_rows:
                    yield batch(rows)
                    rows = []
        rows += packer.finish()
        if rows:
            yield batch(rows)

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece. ``path``: the vocabulary, at the same place on every executor."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return d.mapInArrow(_run(path or vocabulary_path(), capacity), SCHEMA)


def fill(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: sequences, tokens, and the share of padding (lengths are padded to ``capacity`` unless a power of two)."""
    s = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    held = F.when(F.bit_count("n") == 1, F.col("n")).otherwise(F.lit(capacity))
    return s.agg(F.count("*").alias("sequences"), F.sum("n").alias("tokens"), (1 - F.sum("n") / F.sum(held)).alias("padding"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))

"""Vectorised work on the UTF-8 bytes of a string column (runs in Arrow workers)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
#: White space of all contracts: blank and the bytes 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_M64 = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(max(n, 1 << 21), b & _M64, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def column_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes and the n + 1 offsets of a string column; nulls count as empty."""
    a = pc.cast(pc.fill_null(arr, ""), pa.large_string())
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    buf = a.buffers()[2]
    return (np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)), off


def row_chunks(off: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes, at least one row each."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j


def text_chunks(arr: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for ranges of rows."""
    data, off = column_bytes(arr)
    for i, j in row_chunks(off, limit):
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]


def word_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the first word's number for each row (n + 1 values)."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    space = SPACE[data]
    before = np.empty(n, bool)
    before[0], before[1:] = True, space[:-1]
    edge = off[:-1][off[:-1] < n]
    before[edge] = True
    starts = np.flatnonzero(~space & before)
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, space[1:]
    last = off[1:][off[1:] > 0] - 1
    after[last] = True
    ends = np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, off: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash and length of every word (A-Z lowered), and the first word's number for each row."""
    starts, ends, first = word_bounds(data, off)
    if not len(starts):
        return np.zeros(0, np.uint64), ends - starts, first
    up, down = _pow(len(data) + 1)
    table = _BYTE[_LOWER] if lower else _BYTE
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(table[data] * up[:-1], out=sums[1:])
    size = (ends - starts).astype(np.uint64)
    return mix((sums[ends] - sums[starts]) * down[starts] + size * np.uint64(0xA0761D6478BD642F)), ends - starts, first


def doc_shingles(words: np.ndarray, first: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its k-word shingles; with fewer words one for the whole sequence."""
    mult = mix(np.arange(11, 11 + k, dtype=np.uint64)) | np.uint64(1)
    n = len(words) - k + 1
    rolled = np.zeros(max(n, 0), np.uint64)
    for j in range(k):
        rolled += words[j : j + max(n, 0)] * mult[j]
    rolled = mix(rolled)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(rolled[a : b - k + 1])
            yield s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif b > a:
            w = words[a:b] * mult[: b - a]
            yield mix(w.sum(dtype=np.uint64, keepdims=True) + np.array([0x8BB84B93962EACC9 >> (b - a)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)

"""Operator 2: language-model scoring by a probabilistic suffix tree.

Symbols are words (A-Z lowered) and one end, which closes a text and also stands before its first word. A context is the up
to ``depth`` words before a symbol, the end before the text included; the nearest word comes first in the tree.

Model. A context is seen n times in training; its t entries are the symbols that follow it twice or more, with counts c and
sum K, at every size of the corpus. It is retained if its distribution over its entries and one "other" diverges from that
of its suffix (the context without its oldest word; the word counts, for one word): the gain in log-likelihood has to exceed
t / 2 * ln(n). Every entry counts in the test, however rare its symbol. (If ``head`` is given, words beyond the ``head`` most
frequent are "other" in the test of one-word contexts.) Along the retained
suffixes of a position, from the shortest to the longest, a symbol's probability p becomes (c + (t + n - K) * p) / (n + t),
with c = 0 if it is no entry; it starts at the base model's. Each of these distributions sums to one.

Plan. One pass counts words (as 64-bit hashes); the most frequent (at most ``numbered``) get numbers that are broadcast.
One pass writes, for each position of all texts, the ``depth`` words before it, its symbol and its text as a packed window,
dealt by the nearest word, so that a shard holds all windows of its part of the tree: it counts, tests, and scores its
windows at once. Nothing of the tree is written, collected or broadcast. A nearest word with more than ``split`` windows (or one
in ``SHARE`` of all) is dealt by its next word too, and so on; what follows such a context is counted beforehand, and its entries go to all of its
shards. Shards have about ``SHARD`` windows at every size. Sums by text go back packed by the texts' chunks. Symbols without
a number meet their counts in a join; their part in the test of a one-word context is summed up in another and goes to the
context's shard.

Cases: null text is empty; empty texts are the end alone; a null doc_id neither trains nor is held out; repeated rows are
trained on and scored like others; without training rows score and base score are equal; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from secspark.llm.common import materialize, read_table
from secspark.llm.textbytes import mix, text_chunks, word_hashes

DEPTH = 5
#: Words that have numbers, at most (no score depends on it); windows of a context from which on it is dealt by its next word, also as a share of all
#: windows, so that small corpora are dealt evenly too; windows of a shard.
HEAD, SPLIT, SHARE, SHARD = 1 << 20, 500_000, 256, 300_000
#: Lowest count of an entry.
TWICE = 2
#: Code of the end symbol. Codes are never 0, which stands for "no word".
END = np.uint64(0x5851F42D4C957F2D)
_STEP, _SYMBOL = np.uint64(0xD1342543DE82EF95), np.uint64(0x2545F4914F6CDD1D)
_BITS48 = np.uint64((1 << 48) - 1)
#: Positions and texts of a chunk; sums that a task holds.
HELD, TEXTS, SUMS = 900_000, 1 << 16, 4_000_000
#: Numbers of words beyond the head and of places before a text.
_RARE, _NONE = (1 << 24) - 1, (1 << 24) - 2


def fold(doc_id: Column, n: int = 10) -> Column:
    """crc32 of the id's text modulo ``n``; null for null ids."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def _below(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Codes of contexts with one more word, of whose code 48 bits count (the empty context is 0)."""
    return mix(context * _STEP + (word & _BITS48))


def _gram(context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    return mix((context ^ _SYMBOL) * _STEP + symbol)


def _sequence(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts, each between two ends; the place of each in its text; where each text begins."""
    n = np.diff(first)
    at = np.concatenate(([0], np.cumsum(n + 2)))
    seq = np.full(at[-1], END, np.uint64)
    seq[np.arange(len(words)) + np.repeat(2 * np.arange(len(n)) + 1, n)] = np.maximum(words, np.uint64(1))
    return seq, (np.arange(at[-1]) - np.repeat(at[:-1], n + 2)).astype(np.int32), at


def _grouped(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values, one place of each, and the number of each place's value."""
    order = np.argsort(x)
    s = x[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    of = np.empty(len(s), np.int32)
    of[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return s[new], order[new], of


class Table:
    """Sorted distinct codes with values."""

    def __init__(self, codes: np.ndarray, *values: np.ndarray):
        order = np.argsort(codes)
        self.codes, self.values = codes[order], [v[order] for v in values]
        bits = max(1, len(codes).bit_length())
        self.shift = np.uint64(64 - bits)
        self.start = np.searchsorted(self.codes, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        self.ends = np.append(self.codes, np.uint64((1 << 64) - 1))

    def __len__(self) -> int:
        return len(self.codes)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Places of ``wanted``, -1 where there are none."""
        i = self.start[wanted >> self.shift].astype(np.int64)
        below = np.flatnonzero(self.ends[i] < wanted)
        while len(below):  # codes are hashes, so few share a start
            i[below] += 1
            below = below[self.ends[i[below]] < wanted[below]]
        i[(self.ends[i] != wanted) | (i == len(self.codes))] = -1
        return i


def _numbered(head) -> tuple[Table, np.ndarray]:
    """From the broadcast codes and counts by number: numbers by code, and log10 counts by number."""
    codes, n = head.value
    return Table(codes, np.arange(len(codes), dtype=np.int32)), np.log10(n + 0.1)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def out():
        code, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(n)], ["code", "n"])

    for b in batches:
        for _, _, data, off in text_chunks(b.column(0)):
            words = np.maximum(word_hashes(data, off)[0], np.uint64(1))
            held.append(words)
            size += len(words)
            if size > 2 * HELD:
                yield out()
                held, size = [], 0
    if held:
        yield out()


def _count_below(hot: Table, level: int, head=None):
    """What follows the contexts of ``level`` words in ``hot``: rows ``(ctx, sym, n)``; and their contexts of one more word:
    rows ``(ctx, null, n)`` with the shorter context as ``up``. With ``head``, also the symbols without a number that follow
    other contexts: rows ``(ctx, sym, n)`` with 0 as ``up``."""

    def out(kind: int, held):
        a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        one, at, of = _grouped(_gram(a, b))
        n = np.bincount(of, minlength=len(one))
        a, b = pa.array(a[at].view(np.int64)), pa.array(b[at].view(np.int64))
        none = pa.nulls(len(at), pa.int64())
        columns = ([b, none, a], [a, b, none], [a, b, pa.array(np.zeros(len(at), np.int64))])[kind]
        return pa.RecordBatch.from_arrays([*columns, pa.array(n)], ["ctx", "sym", "up", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbered = _numbered(head)[0] if head else None
        follow, deeper, beyond, size = [], [], [], 0
        for b in batches:
            for _, _, data, off in text_chunks(b.column(0)):
                words, _, first = word_hashes(data, off)
                seq, place, _ = _sequence(words, first)
                at = np.flatnonzero(place >= level)
                ctx = np.zeros(len(at), np.uint64)
                for k in range(1, level + 1):
                    ctx = _below(ctx, seq[at - k])
                i = hot.find(ctx) >= 0
                if numbered is not None:
                    j = np.flatnonzero(~i)
                    j = j[numbered.find(seq[at[j]]) < 0]
                    beyond.append((ctx[j], seq[at[j]]))
                    size += len(j)
                at, ctx = at[i], ctx[i]
                follow.append((ctx, seq[at]))
                more = place[at] > level
                deeper.append((ctx[more], _below(ctx[more], seq[at[more] - level - 1])))
                size += len(at)
                if size > HELD:
                    yield from (out(k, x) for k, x in enumerate((deeper, follow, beyond)) if x)
                    follow, deeper, beyond, size = [], [], [], 0
        yield from (out(k, x) for k, x in enumerate((deeper, follow, beyond)) if x)

    return run


def _planes(x: np.ndarray, size: int) -> bytes:
    return x.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :size].T.tobytes()


def _joined(raw: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros((len(raw) // size, 4), np.uint8)
    out[:, :size] = raw.reshape(size, -1).T
    return out.view("<u4").ravel()


def _pack(columns: list[np.ndarray], rare: list[np.ndarray], text: np.ndarray) -> bytes:
    """Columns of word numbers, codes of words without a number (48 bits; of symbols, the last column, all), and texts. Bytes
    of one weight are compressed together, as they have one distribution."""
    n, depth = len(text), len(columns) - 1
    planes = [_planes(c, 3) for c in columns]
    codes = np.concatenate(rare[:-1]) if depth else np.zeros(0, np.uint64)
    frames = [pa.compress(b"".join(p[k * n : (k + 1) * n] for p in planes), codec="zstd", asbytes=True) for k in range(3)]
    frames += [pa.compress(_planes(text, 2), codec="zstd", asbytes=True), codes.view(np.uint8).reshape(-1, 8)[:, :6].tobytes(), rare[-1].tobytes()]
    return np.array([n, *map(len, frames)], "<u4").tobytes() + b"".join(frames)


def _unpack(data: bytes, depth: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    n, *sizes = np.frombuffer(data, "<u4", 7).tolist()
    cut = 28 + np.concatenate(([0], np.cumsum(sizes)))
    frame = [data[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)]
    low, middle, high = (np.frombuffer(pa.decompress(f, decompressed_size=n * (depth + 1), codec="zstd", asbytes=True), np.uint8).reshape(depth + 1, n) for f in frame[:3])
    columns = [low[k] | middle[k].astype(np.int32) << 8 | high[k].astype(np.int32) << 16 for k in range(depth + 1)]
    text = _joined(np.frombuffer(pa.decompress(frame[3], decompressed_size=2 * n, codec="zstd", asbytes=True), np.uint8), 2)
    codes = np.zeros((len(frame[4]) // 6, 8), np.uint8)
    codes[:, :6] = np.frombuffer(frame[4], np.uint8).reshape(-1, 6)
    return columns, text, np.concatenate((codes.view(np.uint64).ravel(), np.frombuffer(frame[5], np.uint64)))


#: Kinds of rows: entries of split contexts, windows, texts, sums of a chunk's texts, symbols without a number, what these add
#: to the tests of one-word contexts.
_ENTRY, _WINDOWS, _TEXT, _SUM, _OPEN, _BEYOND = range(6)
_ROW = pa.schema(
    [("kind", pa.int32()), ("shard", pa.int32()), ("chunk", pa.int64()), ("trained", pa.int32()), ("code", pa.int64()), ("n", pa.int64()), ("data", pa.binary()), ("place", pa.int32()), ("a", pa.float64()), ("b", pa.float64())]
    + [("ids", pa.list_(pa.int64())), ("tokens", pa.list_(pa.int64())), ("head_sum", pa.list_(pa.float64())), ("head_known", pa.list_(pa.int64()))]
)
_DDL = "kind int, shard int, chunk long, trained int, code long, n long, data binary, place int, a double, b double, ids array<long>, tokens array<long>, head_sum array<double>, head_known array<long>"


def _rows(size: int, **known: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([known.get(f.name, pa.nulls(size, f.type)) for f in _ROW], schema=_ROW)


def _same(value: int, n: int) -> pa.Array:
    return pa.array(np.full(n, value, np.int32))


def _windows(head, hot, depth: int, shards: int):
    """Packed windows of all texts, dealt by context, and a row of texts for each chunk. Rows: (doc_id, text, trained)."""

    def out(chunk: int, held, table, log_count) -> Iterator[pa.RecordBatch]:
        split = hot.value
        every = shards + (int(split.values[0].sum()) if len(split) else 0)
        seq, place, ids, train, n_words = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        # texts that train come first in a chunk's numbers
        order = np.argsort(~train, kind="stable")
        number = np.empty(len(ids), np.int32)
        number[order] = np.arange(len(ids))
        rank = table.find(seq)
        rank = np.where(rank >= 0, table.values[0][rank], _RARE).astype(np.int32)
        at = np.flatnonzero(place > 0).astype(np.int32)
        text, place = np.repeat(number, n_words + 2)[at], place[at]
        symbol = rank[at]
        known = symbol != _RARE
        head_sum = np.bincount(text[known], log_count[symbol[known]], len(ids))
        head_known = np.bincount(text[known], minlength=len(ids))
        del symbol, known

        def column(k: int, of=slice(None)) -> np.ndarray:
            """Numbers of the k-th word before each position."""
            back = place[of]
            return np.where(back >= k, rank[at[of] - np.minimum(back, k)], np.int32(_NONE))

        # the shard: by the nearest word, and for split contexts by further words
        ctx = _below(np.uint64(0), seq[at - 1])
        shard = (ctx % np.uint64(shards)).astype(np.int64)
        some = np.arange(len(at)) if len(split) else np.zeros(0, np.int64)
        for level in range(1, depth + 1):
            if not len(some):
                break
            i = split.find(ctx[some])
            some, i = some[i >= 0], i[i >= 0]
            # without a further word in the tree any shard of the context will do
            deeper = (place[some] > level) & (level < depth)
            older = np.where(deeper, seq[at[some] - np.minimum(place[some], level + 1)], some.astype(np.uint64))
            shard[some] = split.values[1][i] + (mix(older) % split.values[0][i].astype(np.uint64)).astype(np.int64)
            some, older = some[deeper], older[deeper]
            ctx[some] = _below(ctx[some], older)
        del ctx
        near = (column(1).astype(np.int64) << 24) | column(min(2, depth))
        by = np.lexsort((near, shard)) if every >= 1 << 15 else np.argsort((shard << 48) | near)
        del near
        cut = np.searchsorted(shard[by], np.arange(every + 1))
        full = np.flatnonzero(np.diff(cut))
        for x in range(0, len(full), 64):  # small batches: the JVM holds them outside its heap
            part, data = full[x : x + 64], []
            for s in part:
                mine = by[cut[s] : cut[s + 1]]
                picked = [column(k, mine) for k in (*range(1, depth + 1), 0)]
                places = [at[mine] - k for k in (*range(1, depth + 1), 0)]
                data.append(_pack(picked, [seq[p[c == _RARE]] for p, c in zip(places, picked, strict=True)], text[mine]))
            n = len(part)
            yield _rows(n, kind=_same(_WINDOWS, n), shard=pa.array(part.astype(np.int32)), chunk=pa.array(np.full(n, chunk)), trained=_same(int(train.sum()), n), n=pa.array(np.full(n, len(ids))), data=pa.array(data, pa.binary()))
        one = lambda x, kind: pa.array([x], pa.list_(kind))
        yield _rows(1, kind=_same(_TEXT, 1), shard=_same(chunk % shards, 1), chunk=pa.array([chunk]), ids=one([None if v else x for x, v in zip(ids["id"][order].tolist(), ids["null"][order].tolist(), strict=True)], pa.int64()), tokens=one(n_words[order] + 1, pa.int64()), head_sum=one(head_sum, pa.float64()), head_known=one(head_known, pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, numbered = TaskContext.get().partitionId() << 24, _numbered(head)
        held, size, texts = [], 0, 0
        for b in batches:
            for i, j, data, off in text_chunks(b.column(1)):
                words, _, first = word_hashes(data, off)
                seq, place, _ = _sequence(words, first)
                ids = np.zeros(j - i, [("id", np.int64), ("null", bool)])
                own = b.column(0).slice(i, j - i)
                ids["id"], ids["null"] = own.fill_null(0).to_numpy(), own.is_null().to_numpy(zero_copy_only=False)
                train = b.column(2).slice(i, j - i).fill_null(False).to_numpy(zero_copy_only=False)
                for x in range(0, j - i, TEXTS // 2):  # a chunk has at most TEXTS texts
                    y = min(j - i, x + TEXTS // 2)
                    p, q = (first[x] + 2 * x, first[y] + 2 * y)
                    held.append((seq[p:q], place[p:q], ids[x:y], train[x:y], np.diff(first[x : y + 1])))
                    size, texts = size + q - p, texts + y - x
                    if size > HELD or texts > TEXTS // 2:
                        yield from out(chunk, held, *numbered)
                        chunk, held, size, texts = chunk + 1, [], 0, 0
        if held:
            yield from out(chunk, held, *numbered)

    return run


def _gain(n, up_n, s, k, up_k):
    """Gain in log-likelihood: ``s`` is the sum of c * ln(c / c of the suffix) over entries, ``k`` and ``up_k`` their counts."""
    with np.errstate(divide="ignore", invalid="ignore"):
        rest = np.where(n > k, (n - k) * np.log(np.maximum(n - k, 1) * up_n / (np.maximum(n, 1) * np.maximum(up_n - up_k, 1))), 0.0)
        return s + k * np.log(up_n / np.maximum(n, 1)) + rest


def _chain(columns: list[np.ndarray], symbol: np.ndarray, root: np.ndarray, total: int, train: np.ndarray, split: Table, entries: Table, beyond: Table):
    """For each window a and b such that its symbol's probability is a + b * base. ``columns``: codes of the words before
    it, the nearest first, 0 for none; ``root``: its symbol's count, 0 without a number; ``beyond``: by one-word context, what
    entries without a number add to the sums of its test."""
    a, b = np.zeros(len(symbol)), np.ones(len(symbol))
    at, ctx = np.arange(len(symbol)), np.zeros(len(symbol), np.uint64)
    up_n, up_c = np.full(len(symbol), float(total)), root.astype(float)
    columns.reverse()
    while columns:
        word = columns.pop()[at]
        ok = word != 0
        at, ctx, up_n, up_c = at[ok], _below(ctx[ok], word[ok]), up_n[ok], up_c[ok]
        if not len(at):
            break
        grams, g_at, g_of = _grouped(_gram(ctx, symbol[at]))
        codes, c_at, c_of = _grouped(ctx)
        c = np.bincount(g_of, train[at], len(grams))
        n = np.bincount(c_of, train[at], len(codes))
        above = c_of[g_at]
        here = split.find(codes) if len(split) else np.full(len(codes), -1)
        far = here[above] >= 0
        if far.any():
            i = entries.find(grams[far]) if len(entries) else np.full(far.sum(), -1)
            c[far] = np.where(i >= 0, entries.values[0][i], 0) if len(entries) else 0
        entry = c >= TWICE
        test = entry & (up_c[g_at] > 0)
        per = lambda of, x: np.bincount(of, x, len(codes))
        t, k = per(above[entry], np.ones(entry.sum())), per(above[entry], c[entry])
        up = up_c[g_at][test]
        sums = [per(above[test], c[test] * np.log(c[test] / up)), per(above[test], c[test]), per(above[test], up)]
        if len(beyond):
            i = beyond.find(codes)
            sums = [x + np.where(i >= 0, more[i], 0) for x, more in zip(sums, beyond.values, strict=True)]
            beyond = ()  # longer contexts are tested against counts of this shard
        gain = _gain(n, up_n[c_at], *sums)
        keep = (t > 0) & (gain > 0.5 * t * np.log(np.maximum(n, 1)))
        if far.any():
            h = here >= 0
            n[h], t[h], k[h], keep[h] = (v[here[h]] for v in split.values[2:])
        use = keep[c_of]
        own, i, g = c_of[use], at[use], g_of[use]
        rest, seen = (t + n - k)[own], (n + t)[own]
        a[i] = (np.where(entry[g], c[g], 0) + rest * a[i]) / seen
        b[i] = rest * b[i] / seen
        alive = n[c_of] >= TWICE
        at, ctx, up_n, up_c = at[alive], ctx[alive], n[c_of[alive]], c[g_of[alive]]
    return a, b


def _scorer(head, hot, depth: int, total: int, den: float):
    """Scores the windows of each shard (rows come sorted by shard and kind); passes texts on."""

    def shard_rows(blobs, grams, beyond, sums) -> Iterator[pa.RecordBatch]:
        split = hot.value
        by_rank, counts = head.value
        parts = [_unpack(x[0], depth) for x in blobs]
        size = [len(p[1]) for p in parts]
        code = []
        at = [0] * len(parts)
        for k in range(depth + 1):
            rank = np.concatenate([p[0][k] for p in parts])
            x = np.zeros(len(rank), np.uint64)
            some = rank < _NONE
            x[some] = by_rank[rank[some]]
            # codes beyond the head lie column by column in each blob
            first = 0
            for j, (columns, _, rare) in enumerate(parts):
                i = np.flatnonzero(columns[k] == _RARE)
                x[first + i] = rare[at[j] : at[j] + len(i)]
                at[j], first = at[j] + len(i), first + size[j]
            code.append(x)
        text = np.concatenate([p[1] for p in parts]).astype(np.int32)
        train = (text < np.repeat([x[2] for x in blobs], size)).astype(np.float32)
        del parts
        symbol = code.pop()
        known = rank < _NONE
        root = np.zeros(len(symbol))
        root[known] = counts[rank[known]]
        a, b = _chain(code, symbol, root, total, train, split, grams, beyond)
        gain = np.zeros(len(symbol))
        gain[known] = np.log10(a[known] * 10**den / (root[known] + 0.1) + b[known])
        cut = np.concatenate(([0], np.cumsum(size)))
        for x, (_, chunk, _, texts) in enumerate(blobs):
            mine = slice(cut[x], cut[x + 1])
            if chunk not in sums:
                sums[chunk] = np.zeros(texts)
            sums[chunk] += np.bincount(text[mine], gain[mine], texts)
        i = np.flatnonzero(~known)
        if len(i):
            chunk = np.repeat([x[1] for x in blobs], size)[i]
            yield _rows(len(i), kind=_same(_OPEN, len(i)), chunk=pa.array(chunk), place=pa.array(text[i].astype(np.int32)), code=pa.array(symbol[i].view(np.int64)), a=pa.array(a[i]), b=pa.array(b[i]))

    def out(sums) -> Iterator[pa.RecordBatch]:
        for chunk, x in sums.items():
            some = np.flatnonzero(x)
            data = pa.compress(_planes(some, 2) + x[some].astype(np.float32).tobytes(), codec="zstd", asbytes=True)
            yield _rows(1, kind=_same(_SUM, 1), chunk=pa.array([chunk]), n=pa.array([len(some)]), data=pa.array([data], pa.binary()))
        sums.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs, codes, counts, added, sums = None, [], [], [], [], {}

        def tables():
            none = np.zeros(0, np.uint64)
            return Table(*(np.concatenate(x) for x in (codes, counts))) if codes else Table(none, none), Table(*map(np.concatenate, zip(*added, strict=True))) if added else Table(none)

        for batch in batches:
            shard, kind = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
            texts = batch.filter(pa.array(kind == _TEXT))
            if texts.num_rows:
                yield pa.RecordBatch.from_arrays([texts.column(f.name).cast(f.type) for f in _ROW], schema=_ROW)
            edge = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1]))) if len(shard) else []
            for x, y in zip(edge, [*edge[1:], len(shard)], strict=False):
                if shard[x] != now:
                    if blobs:
                        yield from shard_rows(blobs, *tables(), sums)
                        if sum(map(len, sums.values())) > SUMS:
                            yield from out(sums)
                    now, blobs, codes, counts, added = shard[x], [], [], [], []
                for r in (np.flatnonzero(kind[x:y] == _ENTRY) + x).tolist():
                    code, n = _unpack_entries(batch.column("data")[r].as_py(), batch.column("n")[r].as_py())
                    codes.append(code)
                    counts.append(n)
                for r in (np.flatnonzero(kind[x:y] == _WINDOWS) + x).tolist():
                    blobs.append((batch.column("data")[r].as_py(), batch.column("chunk")[r].as_py(), batch.column("trained")[r].as_py(), batch.column("n")[r].as_py()))
                for r in (np.flatnonzero(kind[x:y] == _BEYOND) + x).tolist():
                    part = np.frombuffer(batch.column("data")[r].as_py(), np.uint64).reshape(4, -1)
                    added.append((part[0], *part[1:].view(np.float64)))
        if blobs:
            yield from shard_rows(blobs, *tables(), sums)
        yield from out(sums)

    return run


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text of a chunk; rows come sorted by chunk and kind, the chunk's texts first."""
    now = None
    for b in batches:
        kind = b.column("kind").to_numpy()
        r = 0
        while r < b.num_rows:
            if kind[r] == _TEXT:
                if now:
                    yield _text_rows(now)
                now = {k: b.column(k)[r].values for k in ("ids", "tokens", "head_sum", "head_known")}
                now["gain"], now["base"], now["known"] = np.zeros(len(now["ids"])), now["head_sum"].to_numpy().copy(), now["head_known"].to_numpy().copy()
                r += 1
            elif kind[r] == _SUM:
                n = b.column("n")[r].as_py()
                raw = np.frombuffer(pa.decompress(b.column("data")[r].as_py(), decompressed_size=6 * n, codec="zstd", asbytes=True), np.uint8)
                now["gain"][_joined(raw[: 2 * n], 2)] += raw[2 * n :].copy().view(np.float32)
                r += 1
            else:  # a run of rows of one chunk
                chunk = b.column("chunk").to_numpy()
                end = r + int(np.argmax(np.append(chunk[r:] != chunk[r], True) | np.append(kind[r:] != _OPEN, True)))
                place = b.column("place").slice(r, end - r).to_numpy()
                now["gain"] += np.bincount(place, b.column("a").slice(r, end - r).to_numpy(), len(now["gain"]))
                now["base"] += np.bincount(place, b.column("b").slice(r, end - r).to_numpy(), len(now["gain"]))
                now["known"] += np.bincount(place, b.column("n").slice(r, end - r).to_numpy(), len(now["gain"])).astype(np.int64)
                r = end
    if now:
        yield _text_rows(now)


def _text_rows(now: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([now["ids"], now["tokens"], pa.array(now["base"]), pa.array(now["known"]), pa.array(now["gain"])], ["doc_id", "n_tokens", "base", "known", "gain"])


def _pack_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries ``(ctx, sym, n)`` as packed codes and counts, a row for each context of a batch."""
    for b in batches:
        ctx, sym, n = (b.column(k).to_numpy() for k in ("ctx", "sym", "n"))
        code = _gram(ctx.view(np.uint64), sym.view(np.uint64))
        own = np.unique(ctx)
        data = [pa.compress(code[ctx == c].tobytes() + n[ctx == c].astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True) for c in own]
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array([int((ctx == c).sum()) for c in own], pa.int64()), pa.array(data, pa.binary())], ["ctx", "n", "data"])


def _unpack_entries(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(pa.decompress(data, decompressed_size=16 * n, codec="zstd", asbytes=True), np.uint8)
    return raw[: 8 * n].copy().view(np.uint64), np.ascontiguousarray(raw[8 * n :].reshape(8, n).T).view("<u8").ravel().astype(float)


def _pack_beyond(shards: int):
    """Sums ``(ctx, s, k, up_k)`` as packed columns, a row for each shard of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ctx = b.column("ctx").to_numpy().view(np.uint64)
            table = np.stack([ctx, *(b.column(k).to_numpy().view(np.uint64) for k in ("s", "k", "up_k"))])
            shard = (ctx % np.uint64(shards)).astype(np.int32)
            by = np.argsort(shard, kind="stable")
            own, first = np.unique(shard[by], return_index=True)
            data = [np.ascontiguousarray(table[:, x]).tobytes() for x in np.split(by, first[1:])] if len(own) else []
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(data, pa.binary())], ["shard", "data"])

    return run


def _size(n: str) -> Column:
    return F.floor(F.log2(n) * 16)


def _head(counts: DataFrame, head: int) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Tokens and distinct words of ``counts (code, n)``; codes and counts of the most frequent, whole size classes of them."""
    levels = sorted(((x["size"], x["v"], x["t"]) for x in counts.groupBy(_size("n").alias("size")).agg(F.count("*").alias("v"), F.sum("n").alias("t")).collect()), reverse=True)
    held, floor = 0, 1 << 30
    for s, v, _ in levels:
        held += v
        if held > head:
            break
        floor = s
    top = counts.where(_size("n") >= floor).toArrow()
    return sum(x[2] for x in levels), sum(x[1] for x in levels), top["code"].to_numpy().view(np.uint64), top["n"].to_numpy()


def _split_contexts(train: DataFrame, codes: np.ndarray, n: np.ndarray, ends: int, depth: int, split: int, head=None):
    """Contexts with more than ``split`` windows, level by level: ``{code: (n, shorter context)}`` and the tables ``(ctx,
    sym, n)`` of what follows them. There are at most total / split in a level. With ``head``, also the table ``(ctx, sym, n)``
    of symbols without a number that follow other one-word contexts twice or more, else None."""
    words = np.append(codes, END)
    often = np.append(n, ends)
    own = _below(np.zeros(len(words), np.uint64), words)
    now = {int(c): (int(x), 0) for c, x in zip(own[often > split], often[often > split], strict=True)}
    found, tables, level, beyond = {}, [], 1, None
    while (now or (head and level == 1)) and level <= depth:
        found |= now
        hot = Table(np.array(sorted(now), np.uint64), np.zeros(len(now)))
        rows = train.mapInArrow(_count_below(hot, level, head if level == 1 else None), "ctx long, sym long, up long, n long").groupBy("ctx", "sym", "up").agg(F.sum("n").alias("n"))
        rows = materialize(rows.where(F.when(F.col("sym").isNull(), F.col("n") > split).otherwise(F.col("n") >= TWICE)), "below")
        more = rows.where("sym is null").collect()
        tables.append(rows.where("sym is not null and up is null").select("ctx", "sym", "n"))
        if head and level == 1:
            beyond = rows.where("sym is not null and up is not null").select("ctx", "sym", "n")
        now = {r["ctx"] % (1 << 64): (r["n"], r["up"] % (1 << 64)) for r in more}
        level += 1
    return found, tables, beyond


def _signed(code: int) -> int:
    return code - (1 << 64) if code >= 1 << 63 else code


def _tests(spark: SparkSession, found: dict, tables: list[DataFrame], counts: DataFrame, least: int, ends: int, total: int) -> dict:
    """Windows, entries, sum and test of split contexts; one row for each reaches the driver. Words seen less than ``least``
    times aren't tested."""
    up = spark.createDataFrame([(_signed(c), _signed(p)) for c, (_, p) in found.items()], "ctx long, up long")
    out = {}
    for level, table in enumerate(tables):
        own = table
        if level == 0:
            root = counts.where(F.col("n") >= least).unionByName(spark.createDataFrame([(_signed(int(END)), ends)], "code long, n long")).where("n > 0")
            known = own.join(root.select(F.col("code").alias("sym"), F.col("n").alias("up_c")), "sym", "left")
        else:
            above = tables[level - 1].select(F.col("ctx").alias("up"), "sym", F.col("n").alias("up_c"))
            known = own.join(F.broadcast(up), "ctx").join(above, ["up", "sym"], "left")
        c = F.col("n").cast("double")
        some = F.col("up_c").isNotNull()
        sums = known.groupBy("ctx").agg(F.count("*").alias("t"), F.sum("n").alias("k"), F.sum(F.when(some, c * F.log(c / F.col("up_c")))).alias("s"), F.sum(F.when(some, c)).alias("kk"), F.sum(F.when(some, F.col("up_c"))).alias("up_k")).collect()
        for r in sums:
            n, parent = found[r["ctx"] % (1 << 64)]
            up_n = float(found[parent][0] if level else total)
            gain = float(_gain(np.array(float(n)), np.array(up_n), r["s"] or 0.0, np.array(r["kk"] or 0.0), np.array(float(r["up_k"] or 0))))
            out[r["ctx"] % (1 << 64)] = (float(n), float(r["t"]), float(r["k"]), gain > 0.5 * r["t"] * math.log(n))
    for c, (n, _) in found.items():
        out.setdefault(c, (float(n), 0.0, 0.0, False))
    return out


def score_texts(docs: DataFrame, trained: Column, depth: int = DEPTH, head: int | None = None, split: int = SPLIT, id_col: str = "doc_id", text_col: str = "text", numbered: int = HEAD) -> DataFrame:
    """Rows ``(doc_id, n_tokens, n_known, train_tokens, base_score, score)``, one for each row of ``docs``.

    ``trained``: a condition on ``doc_id`` that says which rows are learnt from. ``head``: words in the test of one-word
    contexts, all if None. ``numbered``: words that have numbers; no score depends on it.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("trained", F.coalesce(trained, F.lit(False)))
    train = d.where("trained").select("text")
    counts = materialize(train.mapInArrow(_count_words, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")), "words")
    ends = train.count()
    words, kinds, codes, n = _head(counts, numbered if head is None else head)
    rare = head is None and kinds > len(codes)
    total = words + ends
    den = math.log10(total + 0.1 * (kinds + (ends > 0) + 1))
    # numbers by frequency; the end has number 0
    order = np.lexsort((codes, -n))
    by_number = np.concatenate(([END], codes[order]))
    often = np.concatenate(([ends], n[order]))
    head_b = sc.broadcast((by_number, often.astype(np.uint32 if often.max() < 1 << 32 else np.int64)))
    shards = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / SHARD))

    split = max(1, min(split, total // SHARE))
    found, tables, beyond = _split_contexts(train, codes, n, ends, depth, split, head_b if rare else None)
    # an entry's symbol is seen twice or more
    tests = _tests(spark, found, tables, counts, TWICE if head is None else int(n.min()) if len(n) else 1, ends, total) if found else {}
    own = np.array(sorted(found), np.uint64)
    salts = np.array([math.ceil(found[int(c)][0] / split) for c in own], np.int64)
    first = shards + np.cumsum(salts) - salts  # split contexts have shards of their own
    hot = sc.broadcast(Table(own, salts, first, *(np.array([tests[int(c)][k] for c in own], kind) for k, kind in enumerate((float, float, float, bool)))))
    dealt = d.mapInArrow(_windows(head_b, hot, depth, shards), _DDL)
    if found:
        # the shards of each split context: its own, and those of longer ones
        where = {}
        for c, s, x in zip(own.tolist(), salts.tolist(), first.tolist(), strict=True):
            mine = range(x, x + s)
            while c:
                where.setdefault(c, set()).update(mine)
                c = found[c][1]
        side = spark.createDataFrame([(_signed(c), s) for c, ss in where.items() for s in ss], "ctx long, shard int")
        for table in tables:
            entries = table.mapInArrow(_pack_entries, "ctx long, n long, data binary").join(F.broadcast(side), "ctx")
            dealt = dealt.unionByName(entries.select(F.lit(_ENTRY).alias("kind"), "shard", "n", "data"), allowMissingColumns=True)
    if beyond is not None:
        # whole size classes have numbers, so the others are seen less often than any of these
        known = beyond.join(counts.where((F.col("n") >= TWICE) & (F.col("n") < (int(n.min()) if len(n) else 1 << 62))).select(F.col("code").alias("sym"), F.col("n").cast("double").alias("up")), "sym")
        c = F.col("n").cast("double")
        sums = known.groupBy("ctx").agg(F.sum(c * F.log(c / F.col("up"))).alias("s"), F.sum(c).alias("k"), F.sum("up").alias("up_k"))
        sums = sums.mapInArrow(_pack_beyond(shards), "shard int, data binary")
        dealt = dealt.unionByName(sums.withColumn("kind", F.lit(_BEYOND)), allowMissingColumns=True)
    dealt = dealt.repartition("shard").sortWithinPartitions("shard", "kind")
    scored = materialize(dealt.mapInArrow(_scorer(head_b, hot, depth, total, den), _DDL), "scored")
    many = F.coalesce(counts["n"], F.lit(0))
    still = scored.where(F.col("kind") == _OPEN).select("chunk", "place", "code", "a", "b")
    still = still.join(counts, "code", "left").select("chunk", "place", F.log10(F.col("a") * F.pow(F.lit(10.0), den - F.log10(many + 0.1)) + F.col("b")).alias("a"), F.log10(many + 0.1).alias("b"), (many > 0).cast("long").alias("n"))
    still = still.groupBy("chunk", "place").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("n").alias("n")).withColumn("kind", F.lit(_OPEN))
    rows = scored.where(F.col("kind") != _OPEN).unionByName(still, allowMissingColumns=True).drop("shard", "trained", "code")
    rows = rows.repartition("chunk").sortWithinPartitions("chunk", "kind").mapInArrow(_texts, "doc_id long, n_tokens long, base double, known long, gain double")
    base = F.col("base") - F.col("n_tokens") * den
    # the end is a known token once any text trains
    known = F.col("known") - (0 if ends else 1)
    return rows.select("doc_id", "n_tokens", known.cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), (base + F.col("gain")).alias("score"))


def op2_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = fold(F.col("doc_id"))
    out = score_texts(read_table(spark, sf_dir, "documents"), rest != 0)
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")

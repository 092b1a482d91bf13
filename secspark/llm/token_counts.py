"""Operator 3: token counts that follow edits.

A document is kept as a row of a table: the leaves (64 pre-tokens of the tokenizer's split pattern each) and a segment tree
with the characters and tokens of every subtree. The pattern matches from left to right, and each match depends only on the
text from its start to ``Encoder.reach`` characters past its end. An edit therefore finds its leaf by the tree, splits that
leaf alone again from the piece that holds the character ``reach`` before it until a new boundary behind the edit falls on
an old one; only these pieces are encoded again, and sums change only on the paths from their leaves to the root.

``build_trees`` makes the table, ``edited_counts`` applies a table of edits ``(doc_id, start, end, text)`` to it, or, without
one, the production edits (redactions) of each row's own text.

Cases: null text is empty and has no tokens; edits may be empty, touch the ends or cover the whole text; a null replacement
is empty; edits that overlap each other or leave the text raise ValueError; edits of a doc_id apply to all of its rows,
edits of an unknown or null one to none; repeated rows are counted again; extra columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from secspark.llm.common import materialize, read_table, sized_broadcast
from secspark.llm.tokens import Encoder, encoder, vocabulary_path

LEAF = 64
#: The production edits: e-mail addresses, IPv4 addresses and long digit runs are replaced. No pattern starts inside a run
#: of its own characters or gives such a run back, so a search takes time in proportion to the text.
EDITS = (
    (re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"), "<EMAIL>", "@"),
    (re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9.])"), "<IP>", "."),
    (re.compile(r"(?<![0-9])[0-9]{13,}+"), "<NUMBER>", ""),
)


class TokenTree:
    """Token count of one text under edits. ``leaves`` are strings; only leaves that an edit touches are split again."""

    def __init__(self, leaves: list[str], chars: list[int], tokens: list[int], enc: Encoder):
        self.leaves, self.chars, self.tokens, self.enc = leaves, chars, tokens, enc
        self.width = len(chars) // 2

    @classmethod
    def of(cls, text: str, enc: Encoder) -> tuple[TokenTree, int]:
        """The tree of a text and its number of pieces."""
        pieces = list(enc.pieces(text))
        count = enc.counts(pieces)
        leaves = ["".join(pieces[i : i + LEAF]) for i in range(0, len(pieces), LEAF)] or [""]
        width = 1 << (len(leaves) - 1).bit_length()
        tree = cls(leaves, [0] * (2 * width), [0] * (2 * width), enc)
        for i, leaf in enumerate(leaves):
            tree.chars[width + i] = len(leaf)
            tree.tokens[width + i] = sum(count[i * LEAF : (i + 1) * LEAF])
        for i in range(width - 1, 0, -1):
            tree._up(i)
        return tree, len(pieces)

    def _up(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def _find(self, place: int) -> tuple[int, int]:
        """The leaf that holds character ``place`` (the last one that has any, past the end) and its first character."""
        i, before = 1, 0
        while i < self.width:
            left = self.chars[2 * i]
            if place < before + left or self.chars[2 * i + 1] == 0:
                i = 2 * i
            else:
                i, before = 2 * i + 1, before + left
        return min(i - self.width, len(self.leaves) - 1), before

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def length(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join(self.leaves)

    def edit(self, start: int, end: int, new: str) -> int:
        """Replace characters ``start`` to ``end``; returns the pieces encoded again."""
        if not 0 <= start <= end <= self.length:
            raise ValueError(f"edit {start}:{end} is outside the text")
        reach = self.enc.reach
        leaf, begin = self._find(max(0, start - reach))
        stop, _ = self._find(end + reach)
        tail = begin + sum(map(len, self.leaves[leaf : stop + 1]))
        more = 1
        while True:  # twice as many further leaves each time, so that all the work is in proportion to the last try
            while tail < end + reach and stop + 1 < len(self.leaves):
                stop += 1
                tail += len(self.leaves[stop])
            whole = stop == len(self.leaves) - 1
            old = "".join(self.leaves[leaf : stop + 1])
            edited = old[: start - begin] + new + old[end - begin :]
            # boundaries behind the edit: starts of later leaves, and the pieces of the leaf that holds its end
            bounds, place = {}, begin
            for x in range(leaf, stop + 1):
                if place >= end and x > leaf:
                    bounds[place - begin + len(new) - (end - start)] = x
                place += len(self.leaves[x])
            fresh, used = self._resync(edited, bounds, whole, stop + 1)
            if used is not None:
                break
            tail += sum(map(len, self.leaves[stop + 1 : stop + 1 + more]))
            stop, more = min(stop + more, len(self.leaves) - 1), 2 * more
        # the new pieces stand in the first of the leaves that they replace
        self.leaves[leaf:used] = ["".join(fresh)] + [""] * (used - leaf - 1)
        for x in range(leaf, used):
            self.chars[self.width + x] = len(self.leaves[x])
            self.tokens[self.width + x] = 0
        self.tokens[self.width + leaf] = sum(self.enc.counts(fresh))
        up = {(self.width + x) // 2 for x in range(leaf, used)}
        while up and 0 not in up:
            for x in up:
                self._up(x)
            up = {x // 2 for x in up}
        return len(fresh)

    def _resync(self, edited: str, bounds: dict[int, int], whole: bool, end: int):
        """New pieces up to the first common boundary, and the leaf that starts there; None if it isn't in the window."""
        fresh, place = [], 0
        for piece in self.enc.pieces(edited):
            if place in bounds:
                return fresh, bounds[place]
            place += len(piece)
            if not whole and place + self.enc.reach > len(edited):
                return fresh, None
            fresh.append(piece)
        return fresh, end


def find_edits(text: str) -> list[tuple[int, int, str]]:
    """The production edits of a text, from left to right; of overlapping ones the first stays."""
    found = sorted((m.start(), m.end(), new) for pattern, new, needs in EDITS if needs in text for m in pattern.finditer(text))
    out: list[tuple[int, int, str]] = []
    for s, e, new in found:
        if not out or s >= out[-1][1]:
            out.append((s, e, new))
    return out


def apply_edits(tree: TokenTree, edits: list[tuple[int, int, str]]) -> int:
    """Apply disjoint edits given in places of the original text; returns the pieces encoded again."""
    again = 0
    bound = None
    for s, e, new in sorted(edits, key=lambda x: x[:2], reverse=True):
        if bound is not None and e > bound:
            raise ValueError("edits overlap")
        bound = s
        again += tree.edit(s, e, new or "")
    return again


_TREE = "doc_id long, leaves array<string>, chars array<int>, tokens array<int>, n_pieces long"


def _builder(path: str):
    schema = pa.schema([("doc_id", pa.int64()), ("leaves", pa.list_(pa.string())), ("chars", pa.list_(pa.int32())), ("tokens", pa.list_(pa.int32())), ("n_pieces", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            at = 0
            while at < b.num_rows:
                ids, rows, size = [], [], 0
                while at < b.num_rows and size < 1 << 22:  # so many characters to a batch
                    text = b.column(1)[at].as_py() or ""
                    tree, n = TokenTree.of(text, enc)
                    ids.append(b.column(0)[at].as_py())
                    rows.append((tree.leaves, tree.chars, tree.tokens, n))
                    size += len(text) + 64
                    at += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((ids, *zip(*rows, strict=True)), schema, strict=True)], schema=schema)

    return run


def _editor(path: str, own: bool):
    names = ["doc_id", "n_tokens", "n_pieces", "n_edits", "edited_tokens", "pieces_again"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            rows = []
            for i in range(b.num_rows):
                leaves, chars, tokens = (b.column(k)[i].as_py() for k in (1, 2, 3))
                tree = TokenTree(leaves, chars, tokens, enc)
                before = tree.total
                edits = find_edits(tree.text()) if own else [(x["start"], x["end"], x["text"]) for x in b.column(5)[i].as_py() or []]
                again = apply_edits(tree, edits)
                rows.append((before, b.column(4)[i].as_py(), len(edits), tree.total, again))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 5)]], names)

    return run


def build_trees(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table of segment trees, one row for each row of ``docs``, in the shared folder."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return materialize(d.mapInArrow(_builder(path or vocabulary_path()), _TREE), "trees")


def edited_counts(trees: DataFrame, edits: DataFrame | None = None, path: str | None = None) -> DataFrame:
    """Tokens before and after the edits, and the pieces encoded in all and again, for each row of ``trees``."""
    out, path = "doc_id long, n_tokens long, n_pieces long, n_edits long, edited_tokens long, pieces_again long", path or vocabulary_path()
    if edits is None:
        return trees.mapInArrow(_editor(path, True), out)
    e = edits.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.col("text").cast("string").alias("text")).alias("e"))
    e = materialize(e.groupBy("doc_id").agg(F.collect_list("e").alias("edits")), "edits")
    ids = sized_broadcast(e.select("doc_id"))
    # only documents that have edits bring their leaves to the join
    touched = trees.join(sized_broadcast(e), "doc_id").select(*trees.columns, "edits").mapInArrow(_editor(path, False), out)
    rest = trees.join(ids, "doc_id", "left_anti").select("doc_id", F.col("tokens")[1].cast("long").alias("n_tokens"), "n_pieces", F.lit(0).cast("long").alias("n_edits"), F.col("tokens")[1].cast("long").alias("edited_tokens"), F.lit(0).cast("long").alias("pieces_again"))
    return touched.unionByName(rest)


def token_counts(docs: DataFrame, edits: DataFrame | None = None, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``edited_counts`` of the trees of ``docs``."""
    return edited_counts(build_trees(docs, path, id_col, text_col), edits, path)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"))

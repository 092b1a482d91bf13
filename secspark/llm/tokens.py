"""Tokenizer access for the Arrow workers: piece tables of a byte-level BPE vocabulary, loaded once a process."""

from __future__ import annotations

import base64
import functools
import json
import struct
from collections.abc import Iterator
from pathlib import Path

import regex
import tiktoken

#: The public vocabulary: its rank file, and beside it the JSON file that names its added tokens.
RANKS = "byte_bpe_50k.tiktoken"


def vocabulary_path(name: str = RANKS) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class Encoder:
    """Ids of texts. Added tokens of the vocabulary are matched first, as its own library does by default; the text between
    them is split into pieces, which are looked up, new ones encoded; the table is emptied when it is full."""

    def __init__(self, path: str, limit: int = 400_000):
        import public_tokenizers

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
        also = Path(path).with_suffix(".json")
        self.added = {x["content"]: x["id"] for x in json.loads(also.read_text())["added_tokens"]} if also.exists() else {}
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self._split = regex.compile("|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True)) or "(?!)")
        #: Characters past its end that a piece may depend on ("'" before "re", or an added token), and one.
        self.reach = 3 + max([0, *map(len, self.added)])
        self._bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self.added)
        self._known: dict[str, int] = dict.fromkeys(self.added, 1)
        self._limit = limit

    def pieces(self, text: str) -> Iterator[str]:
        """The pieces of a text from left to right; their concatenation is the text."""
        at = 0
        for m in self._split.finditer(text):
            if m.start() > at:
                yield from self.pattern.findall(text[at : m.start()])
            yield m.group()
            at = m.end()
        if at < len(text):
            yield from self.pattern.findall(text[at:] if at else text)

    def counts(self, pieces: list[str]) -> list[int]:
        """Tokens of each piece."""
        known = self._known
        try:
            return [known[p] for p in pieces]
        except KeyError:
            if len(known) > self._limit:
                known.clear()
                known.update(dict.fromkeys(self.added, 1))
            for p in pieces:
                if p not in known:
                    known[p] = len(self._bpe.encode_ordinary(p))
            return [known[p] for p in pieces]

    def encode(self, text: str) -> list[int]:
        return self._bpe.encode(text, allowed_special="all", disallowed_special=())


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit ids."""
    return struct.pack(f"<{len(ids)}I", *ids)

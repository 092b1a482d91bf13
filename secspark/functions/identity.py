"""Ids as UUID text or a pair of unsigned 64-bit halves, and key derivation."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_HALF = "decimal(20,0)"


def new_id() -> Column:
    """A version 4 UUID as text."""
    return F.expr("uuid()")


def uuid_to_pair(text: Column) -> Column:
    """``struct(hi, lo)`` of a UUID's text; null where it isn't one."""
    h = F.lower(F.regexp_replace(text, "-", ""))
    half = lambda at: F.conv(F.substring(h, at, 16), 16, 10).cast(_HALF)
    return F.when(h.rlike("^[0-9a-f]{32}$"), F.struct(half(1).alias("hi"), half(17).alias("lo")))


def pair_to_uuid(hi: Column, lo: Column) -> Column:
    """A UUID's text, in lower case, from its halves."""
    part = lambda x: F.lpad(F.lower(F.conv(x.cast("string"), 10, 16)), 16, "0")
    h = F.concat(part(hi), part(lo))
    return F.concat_ws("-", *[F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def derive_key(password: Column, salt: Column, iterations: int) -> Column:
    """PBKDF2 with HMAC-SHA-256, 32 bytes as hex; null for a null."""
    if iterations < 1:
        raise ValueError("iterations must be positive")

    @F.pandas_udf("string")
    def run(p: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else hashlib.pbkdf2_hmac("sha256", bytes(a), bytes(b), iterations, 32).hex() for a, b in zip(p, s, strict=True)], dtype=object)

    return run(password.cast("binary"), salt.cast("binary"))

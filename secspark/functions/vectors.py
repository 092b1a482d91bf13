"""Vector functions as column expressions (JVM side). Null or unequal lengths give null; sums run in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    same = F.size(a) == F.size(b)
    return F.when(same, _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))))


def l2_squared(a: Column, b: Column) -> Column:
    same = F.size(a) == F.size(b)
    return F.when(same, _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(l2_squared(a, b))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where lengths differ or a norm is 0."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n).otherwise(F.when(a.isNotNull() & b.isNotNull(), F.lit(0.0)))


def normalized(a: Column) -> Column:
    """``a`` at length 1; a zero vector is unchanged."""
    # the norm is bound once: within the inner lambda it would be computed for every element
    unit = lambda n: F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))
    return F.transform(F.array(norm(a)), unit)[0]


def quantize_sq8(a: Column) -> Column:
    """Clamp to [-1, 1], times 127, rounded half away from zero, as tinyint."""
    return F.transform(a, lambda x: F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x.cast("double"))) * 127).cast("tinyint"))


def dequantize_sq8(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double") / 127)


def dot_sq8(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("int") * y.cast("int")), F.lit(0), lambda s, x: s + x)


def usable(vec: Column) -> Column:
    """True where a vector has elements and all of them are numbers; else false or null."""
    # null where an element is null: stays inside generated code, unlike a lambda
    return (F.size(vec) > 0) & ~F.array_contains(vec, F.lit(float("nan")).cast("float"))


def literal(v) -> Column:
    """A Python vector as a constant column."""
    return F.array(*[F.lit(float(x)) for x in v])

"""Small numeric expressions: guards, ratios, moments, vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lit(value: float) -> Column:
    return F.lit(float(value))


def round6(c: Column) -> Column:
    """To six decimals, halves up: the same in every engine, unlike ``round``."""
    return F.floor(c * lit(1e6) + lit(0.5)) / lit(1e6)


def ratio(a: Column, b: Column, default: float = 0.0) -> Column:
    """a / b, ``default`` where b is 0 or null."""
    return F.coalesce(F.when(b != 0, a.cast("double") / b.cast("double")), lit(default))


def finite(c: Column) -> Column:
    """Null, NaN and infinities as 0."""
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), lit(0.0)).otherwise(c)


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, lit(low)), lit(high))


def logistic(z: Column) -> Column:
    return lit(1.0) / (lit(1.0) + F.exp(-z))


def let(value: Column, body) -> Column:
    """``body`` of ``value``, computed once however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold(values: Column, step) -> Column:
    return F.aggregate(values, lit(0.0), step)


def total(values: Column) -> Column:
    return fold(values, lambda s, x: s + x)


def mean(values: Column) -> Column:
    return total(values) / F.size(values)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    return ratio(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def bin_index(c: Column, low: Column, high: Column, n: int) -> Column:
    """Equal-width bin, the last one closed."""
    return F.least(F.floor((c - low) / (high - low) * n), F.lit(n - 1)).cast("int")

"""Vector expressions over array columns; they stay in generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(_d(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0; null where a vector or an element is null or lengths differ."""
    n = norm(a) * norm(b)
    return F.when(F.size(a) != F.size(b), None).when(n == 0, 0.0).otherwise(dot(a, b) / n)


def l2_normalize(a: Column) -> Column:
    """Length 1; a zero vector stays."""
    n = norm(a)
    return F.when(n == 0, _d(a)).otherwise(F.transform(_d(a), lambda x: x / n))

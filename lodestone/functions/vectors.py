"""Column expressions over vectors (arrays), in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    """Inner product; null for vectors of different lengths."""
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def normalize(a: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    size = norm(a)
    return F.transform(a, lambda x: F.when(size == 0, x.cast("double")).otherwise(x.cast("double") / size))


def fit_dimension(a: Column, dim: int) -> Column:
    """Padded with zeros, or cut, to ``dim`` components."""
    return F.slice(F.concat(a.cast("array<double>"), F.array_repeat(F.lit(0.0), dim)), 1, dim)


def distance(a: Column, b: Column) -> Column:
    """1 - inner product: the cosine distance of unit vectors."""
    return F.lit(1.0) - dot(a, b)

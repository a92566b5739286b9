"""Dense vectors as arrays: JVM-side folds in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is below 1e-9."""
    na, nb = norm(a), norm(b)
    return F.when((na < 1e-9) | (nb < 1e-9), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))


def cosine_one(a: Column, b: Column) -> Column:
    """A zero norm counts as 1."""
    na, nb = norm(a), norm(b)
    return dot(a, b) / (F.when(na == 0, F.lit(1.0)).otherwise(na) * F.when(nb == 0, F.lit(1.0)).otherwise(nb))


def cosine_guarded(a: Column, b: Column) -> Column:
    """1e-9 added to the denominator."""
    return dot(a, b) / (norm(a) * norm(b) + F.lit(1e-9))


def unit(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: x / F.greatest(n, F.lit(1e-9)))


def add(a: Column, b: Column, scale: float = 1.0) -> Column:
    return F.zip_with(a, b, lambda x, y: x + F.lit(scale) * y)

"""Vector functions (F3): all JVM-side higher-order expressions over ``array<double>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sq_euclid(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x)


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(sq_euclid(a, b))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x))


def unit(a: Column) -> Column:
    """``a / |a|`` (zero vector stays zero); the norm is evaluated once per row."""
    pairs = F.arrays_zip(a.alias("x"), F.array_repeat(norm(a), F.size(a)).alias("n"))
    return F.transform(pairs, lambda p: F.when(p["n"] > 0, p["x"] / p["n"]).otherwise(F.lit(0.0)))


def cosine_dist(a: Column, b: Column) -> Column:
    """``1 - cos(a, b)``; 1 if either is the zero vector."""
    return F.lit(1.0) - F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def reciprocal(d: Column) -> Column:
    """Diverse-clustering metric: ``1/d``, and 0 for identical points."""
    return F.when(d == 0, F.lit(0.0)).otherwise(F.lit(1.0) / d)


def distance(metric: str, a: Column, b: Column) -> Column:
    if metric == "euclid":
        return euclid(a, b)
    if metric == "cosine":
        return cosine_dist(a, b)
    raise ValueError(f"unknown metric {metric!r} (euclid | cosine)")

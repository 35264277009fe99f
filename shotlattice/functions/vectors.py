"""Array vectors as column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    """Dot product; null if either is null."""
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """A vector of length one; null for a null vector or one too short to have a direction."""
    # the length is bound first: an expression inside the inner function would be computed again for each place
    return F.element_at(F.transform(F.array(norm(a)), lambda length: F.when(length >= 1e-6, F.transform(a.cast("array<double>"), lambda x: x / length))), 1)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def hellinger(p: Column, q: Column) -> Column:
    """Distance of two arrays of shares over the same places."""
    gaps = F.zip_with(p, q, lambda x, y: F.pow(F.sqrt(x) - F.sqrt(y), F.lit(2.0)))
    return F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x)) / F.sqrt(F.lit(2.0))

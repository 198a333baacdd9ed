"""Vectors as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.scalars import bound


def dot(a: Column, b: Column) -> Column:
    """Inner product; null for different lengths."""
    parts = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(parts, F.lit(0.0), lambda s, x: s + x))


def norm(a: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for different lengths or a zero vector."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    """Euclidean distance; null for different lengths."""
    gaps = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2)))
    return F.when(F.size(a) == F.size(b), F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x)))


def normalized(a: Column) -> Column:
    """The vector at length 1; a zero vector stays as it is."""
    return bound(norm(a), lambda length: F.transform(a, lambda x: F.coalesce(F.try_divide(x.cast("double"), length), F.lit(0.0))))

"""Arithmetic that several operators share."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """``value`` within two bounds; null stays null."""
    return F.when(value < low, F.lit(low)).when(value > high, F.lit(high)).otherwise(value)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` names it and in whatever lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def pearson(x: str, y: str) -> Column:
    """Correlation of two columns over rows with both; null where one is constant."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x).cast("double")), F.when(both, F.col(y).cast("double"))
    return F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution by the rational approximation 26.2.17 of Abramowitz and Stegun."""
    # fixed values: coefficients of the approximation
    coefficients = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    t = 1 / (1 + 0.2316419 * F.abs(x))
    series = reduce(lambda total, c: (total + F.lit(c)) * t, reversed(coefficients), F.lit(0.0))
    tail = F.exp(-x * x / 2) / F.sqrt(F.lit(2) * F.pi()) * series
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def strength(r: Column) -> Column:
    """Name of a correlation's strength."""
    a = F.abs(r)
    return F.when(a >= 0.8, "Very Strong").when(a >= 0.6, "Strong").when(a >= 0.4, "Moderate").when(a >= 0.2, "Weak").otherwise("Negligible")

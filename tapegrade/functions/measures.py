"""Column forms of the measures that Spark has no function for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero or null."""
    return F.try_divide(a, b)


def normal_cdf(z: Column) -> Column:
    """The normal distribution function by a polynomial, error below 1e-7."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    tail = F.exp(-z * z / 2) / 2.5066282746310002 * t * (0.31938153 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def chained(r: Column) -> Column:
    """Aggregate: the return of returns in a row."""
    return F.product(1 + r) - 1


def profit_factor(pnl: Column) -> Column:
    """Aggregate: gains over losses, null without losses."""
    return ratio(F.sum(F.greatest(pnl, F.lit(0))), -F.sum(F.least(pnl, F.lit(0))))


def entropy(share: Column) -> Column:
    """Aggregate: entropy of shares that sum to one; empty shares add nothing."""
    return -F.sum(F.when(share > 0, share * F.ln(share)).otherwise(0.0))


def modified_dietz(start: Column, end: Column, flow: Column, weight: float = 0.5) -> Column:
    """Return of a day with a flow present for ``weight`` of it; null where the base is not positive."""
    base = start + weight * flow
    return F.when(base > 0, (end - start - flow) / base)

"""Moments with the conventions that reports use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def skew_sample(c: str) -> Column:
    """The sample-adjusted skewness (G1); null with fewer than 3 values or no spread."""
    n = F.count(c)
    return F.when((n > 2) & (F.stddev_pop(c) > 0), F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def kurt_sample(c: str) -> Column:
    """The sample-adjusted excess kurtosis (G2); null with fewer than 4 values or no spread."""
    n = F.count(c)
    return F.when((n > 3) & (F.stddev_pop(c) > 0), ((n + 1) * F.kurtosis(c) + 6) * (n - 1) / ((n - 2) * (n - 3)))


def unique(c: str) -> Column:
    """Distinct values, a null counting as one."""
    return F.count_distinct(c) + F.max(F.when(F.col(c).isNull(), 1).otherwise(0))

"""Means of doubles that don't depend on the order of rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a value that one whole number takes; sums of up to 2^32 rows stay within 64 bits.
BITS = 31
#: Exponent of the smallest double.
LEAST = -1074


def _units(low: float, high: float) -> list[int]:
    """Exponents of units, such that multiples below 2^BITS of each make up any double between ``low`` and ``high``."""
    top, bottom = math.frexp(high)[1], max(math.frexp(low)[1] - 53, LEAST)
    return [max(top - BITS * (i + 1), LEAST) for i in range(max(1, -(-(top - bottom) // BITS)))]


def means(df: DataFrame, keys: list[str], c: str, name: str) -> DataFrame:
    """``keys`` and the mean of the doubles ``c``, null without any: the exact sum is rounded once, then divided.

    Values are taken apart into whole multiples of a few powers of two, whose sums are exact in any order. One more scan
    finds how many these must be. Groups with infinite values or NaN have the mean that these give.
    """
    inf, x = float("inf"), F.col(c).cast("double")
    finite = F.abs(x) < inf
    low, high = df.agg(F.min(F.when(finite & (x != 0), F.abs(x))), F.max(F.when(finite, F.abs(x)))).first()
    units = _units(low, high) if low is not None else [0]
    parts, rest = [], F.when(finite, x)
    for i, u in enumerate(units):
        part = (rest / F.lit(2.0**u)).cast("long")
        parts.append(F.sum(F.col(f"__{i}")).alias(f"__{i}"))
        df = df.withColumn(f"__{i}", part).withColumn("__rest", rest - F.col(f"__{i}") * F.lit(2.0**u))
        rest = F.col("__rest")

    def total(found: list[int]) -> float:
        whole = sum(v << (u - units[-1]) for v, u in zip(found, units))
        try:
            return float(whole << units[-1]) if units[-1] >= 0 else whole / (1 << -units[-1])
        except OverflowError:
            return inf if whole > 0 else -inf

    sums = df.groupBy(*keys).agg(F.avg(F.when(~finite, x)).alias("__odd"), F.count(x).alias("__n"), *parts)
    exact = F.when(F.col("__odd").isNull() & (F.col("__n") > 0), F.array(*[F.col(f"__{i}") for i in range(len(units))]))
    rounded = sums.withColumn("__sum", F.udf(lambda v: None if v is None else total(v), "double", useArrow=True)(exact))
    return rounded.select(*keys, F.coalesce("__odd", F.col("__sum") / F.col("__n")).alias(name))

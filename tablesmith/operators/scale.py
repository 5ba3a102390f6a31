"""Scalers. Fitting is one aggregate that gives parameters; transforming is a projection with those as literals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import order_stats

TINY = 1e-12


@dataclass(frozen=True)
class Params:
    """(x - center) / scale, then moved to [low, high] if given, then clipped to [least, most] if given."""

    center: float
    scale: float
    low: float = 0.0
    high: float = 1.0
    least: float | None = None
    most: float | None = None

    def forward(self, c: str) -> Column:
        out = (F.col(c) - self.center) / self.scale * (self.high - self.low) + self.low
        out = out if self.least is None else F.greatest(out, F.lit(self.least))
        return out if self.most is None else F.least(out, F.lit(self.most))

    def back(self, c: str) -> Column:
        return (F.col(c) - self.low) / (self.high - self.low) * self.scale + self.center


def _scale(x: float | None) -> float:
    return 1.0 if x is None or abs(x) < TINY else x


def fit(df: DataFrame, columns: list[str], method: str, low: float = 0.0, high: float = 1.0, clip: bool = False) -> dict[str, Params]:
    """Parameters by column. ``method``: standard, minmax, robust (nearest-rank quartiles), maxabs or none."""
    if method == "robust":
        return {c: Params(middle, _scale(None if a is None else b - a)) for c, (middle, a, b) in order_stats.summaries(df, columns).items()}
    measures = {"standard": (F.avg, F.stddev_samp), "minmax": (F.min, F.max), "maxabs": (lambda c: F.max(F.abs(c)), F.count), "none": (F.count, F.count)}[method]
    row = df.agg(*[f(c).cast("double").alias(f"{c}__{i}") for c in columns for i, f in enumerate(measures)]).first()
    out = {}
    for c in columns:
        a, b = row[f"{c}__0"], row[f"{c}__1"]
        if method == "standard":
            out[c] = Params(a, _scale(b))
        elif method == "minmax":
            out[c] = Params(a, _scale(b - a), low, high, low if clip else None, high if clip else None)
        elif method == "maxabs":
            out[c] = Params(0.0, _scale(a), least=-1.0 if clip else None, most=1.0 if clip else None)
        else:
            out[c] = Params(0.0, 1.0)
    return out


def transform(df: DataFrame, params: dict[str, Params]) -> DataFrame:
    return df.withColumns({c: p.forward(c) for c, p in params.items()})


def inverse(df: DataFrame, params: dict[str, Params]) -> DataFrame:
    return df.withColumns({c: p.back(c) for c, p in params.items()})


def sums(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """What running statistics are kept as: counts, sums and sums of squares, which add up over batches."""
    c = F.col(column).cast("double")
    return df.groupBy(*by).agg(F.count(c).alias("n"), F.sum(c).alias("s"), F.sum(c * c).alias("ss"), F.min(c).alias("low"), F.max(c).alias("high"))


def merged(parts: DataFrame, by: list[str]) -> DataFrame:
    """Running statistics of all that ``sums`` gave: n, mean, variance (sample), low, high."""
    n, s = F.sum("n"), F.sum("s")
    variance = F.when(n > 1, F.greatest(F.lit(0.0), (F.sum("ss") - s * s / n) / (n - 1))).otherwise(0.0)
    return parts.groupBy(*by).agg(n.alias("n"), (s / n).alias("mean"), variance.alias("variance"), F.min("low").alias("low"), F.max("high").alias("high"))

"""Imputation. Parameters are one aggregate; fills by neighbours in time are windows within an entity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import order_stats


def mode(df: DataFrame, column: str):
    """The most frequent value, the smallest of ties; None without values."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    row = counts.agg(F.min(F.struct((-F.col("n")).alias("k"), F.col(column).alias("v"))).alias("s")).first()
    return row["s"]["v"] if row["s"] else None


def statistic(df: DataFrame, column: str, how: str, constant=None):
    """mean, median (interpolated), upper_median (the value at n // 2), mode or constant."""
    if how == "mean":
        return df.agg(F.avg(column)).first()[0]
    if how == "median":
        return order_stats.median(df, column)
    if how == "upper_median":
        n = order_stats.count(df, column)
        return order_stats.at_ranks(df, column, [n // 2]).get(n // 2)
    return mode(df, column) if how == "mode" else constant


def fill(df: DataFrame, column: str, how: str, constant=None) -> DataFrame:
    value = statistic(df, column, how, constant)
    return df if value is None else df.withColumn(column, F.coalesce(F.col(column), F.lit(value)))


def forward(df: DataFrame, column: str, by: list[str], order: list[str]) -> DataFrame:
    return df.withColumn(column, F.last(column, ignorenulls=True).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))


def backward(df: DataFrame, column: str, by: list[str], order: list[str]) -> DataFrame:
    return df.withColumn(column, F.first(column, ignorenulls=True).over(W.partitionBy(*by).orderBy(*order).rowsBetween(0, W.unboundedFollowing)))


def nearest_rows(df: DataFrame, key: str, columns: list[str], k: int, metric: str = "euclidean", weights: str = "uniform", most_complete: int = 50_000) -> DataFrame:
    """Missing values from the k nearest complete rows: distances over the columns that a row has, over their number.

    Complete rows are broadcast after a check of their number; with more, they're to be sampled or clustered first.
    Nearest means least (distance, key); a row without any value gets means.
    """
    complete = df.dropna(subset=columns).select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in columns])
    if complete.limit(most_complete + 1).count() > most_complete:
        raise ValueError(f"more than {most_complete} complete rows; give a sample of them")
    means = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    missing = df.where(" or ".join(f"{c} is null" for c in columns))
    shared = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    gap = lambda c: F.coalesce(F.abs(F.col(c) - F.col(f"__{c}")), F.lit(0.0))
    raw = sum((gap(c) if metric == "manhattan" else gap(c) * gap(c) for c in columns), F.lit(0.0))
    dist = F.try_divide(raw, shared) if metric == "manhattan" else F.sqrt(F.try_divide(raw, shared))
    pairs = missing.select(key, *columns).crossJoin(F.broadcast(complete)).withColumn("__d", dist).where("__d is not null")
    near = pairs.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy("__d", "__k"))).where(F.col("__r") <= k)
    weight = 1 / (F.col("__d") + 1e-10) if weights == "distance" else F.lit(1.0)
    found = near.groupBy(F.col(key).alias("__id")).agg(*[(F.sum(F.col(f"__{c}") * weight) / F.sum(weight)).alias(f"__{c}") for c in columns])
    joined = df.join(found, df[key] == F.col("__id"), "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.col(f"__{c}"), F.lit(means[c])) for c in columns}).select(*df.columns)


def chained(df: DataFrame, columns: list[str], initial: str = "mean", rounds: int = 0) -> DataFrame:
    """Initial fills, then ``rounds`` of each column by simple regression on the sum of the others, where it was missing.

    Without rounds this is what the reported behaviour comes to: the initial fill stays.
    """
    flagged = df.withColumns({f"__{c}": F.col(c).isNull() for c in columns})
    for c in columns:
        flagged = fill(flagged, c, initial)
    for _ in range(rounds):
        for c in columns:
            x = sum((F.col(o) for o in columns if o != c), F.lit(0.0))
            row = flagged.where(~F.col(f"__{c}")).agg(F.regr_slope(F.col(c), x), F.regr_intercept(F.col(c), x)).first()
            if row[0] is not None:
                flagged = flagged.withColumn(c, F.when(F.col(f"__{c}"), x * row[0] + row[1]).otherwise(F.col(c)))
    return flagged.select(*df.columns)


def clean(df: DataFrame, order: list[str], by: list[str], most_missing: float = 80.0) -> DataFrame:
    """Drops columns that are missing too often and repeated rows, fills floats by means and strings forward."""
    n = F.count(F.lit(1))
    shares = df.agg(*[(F.count_if(F.col(c).isNull()) * 100.0 / n).alias(c) for c in df.columns]).first()
    kept = [c for c in df.columns if (shares[c] or 0) <= most_missing]
    out = df.select(*kept).dropDuplicates()
    kinds = dict(out.dtypes)
    for c in kept:
        if kinds[c] in ("double", "float"):
            out = fill(out, c, "mean")
        elif kinds[c] == "string" and shares[c]:
            out = forward(out, c, by, order)
    return out

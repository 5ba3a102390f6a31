"""Encoders. Lookups are small tables joined by a broadcast that Spark chooses from their size; order needs a key."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ranks


def categories(df: DataFrame, column: str, most: int = 1000) -> list:
    rows = df.where(F.col(column).isNotNull()).select(column).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{column} has more than {most} values; use another encoder")
    return sorted(r[0] for r in rows)


def one_hot(df: DataFrame, column: str, values: list | None = None) -> DataFrame:
    """<column>_<value> as 0 or 1, in order of values; null rows are all 0. The column itself goes."""
    values = categories(df, column) if values is None else values
    return df.select("*", *[F.coalesce(F.col(column) == v, F.lit(False)).cast("int").alias(f"{column}_{v}") for v in values]).drop(column)


def label(df: DataFrame, column: str, order: str) -> DataFrame:
    """(value, index): values numbered from 0 by first appearance in ``order``."""
    first = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.min(order).alias("at"))
    return ranks.numbered(first, ["at", "value"]).select("value", F.col("__i").cast("int").alias("index"))


def lookup(df: DataFrame, column: str, table: DataFrame, to: str, otherwise=None) -> DataFrame:
    """``df`` with ``column`` replaced by ``table``'s (value, to); unseen and null values give ``otherwise``."""
    joined = df.join(table.select(F.col("value").alias("__v"), F.col(to).alias("__to")), F.col(column) == F.col("__v"), "left")
    value = F.col("__to") if otherwise is None else F.coalesce("__to", F.lit(otherwise))
    return joined.withColumn(column, value).select(*df.columns)


def target(df: DataFrame, column: str, y: str) -> tuple[DataFrame, float]:
    """((value, mean of y), unweighted mean of the means for unseen values)."""
    means = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.avg(y).alias("mean"))
    return means, means.agg(F.avg("mean")).first()[0]


def smoothed(df: DataFrame, column: str, y: str, m: float = 10.0) -> tuple[DataFrame, float]:
    """((value, (n * mean + m * overall) / (n + m)), overall)."""
    overall = df.agg(F.avg(y)).first()[0]
    table = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(((F.sum(y) + m * overall) / (F.count(y) + m)).alias("mean"))
    return table, overall


def leave_one_out(df: DataFrame, column: str, y: str) -> DataFrame:
    """The mean of y over the other rows of the value; a value's only row gives the overall mean."""
    overall = df.agg(F.avg(y)).first()[0]
    sums = df.groupBy(F.col(column).alias("__v")).agg(F.sum(y).alias("__s"), F.count(y).alias("__n"))
    joined = df.join(sums, F.col(column).eqNullSafe(F.col("__v")))
    return joined.withColumn(column, F.coalesce(F.try_divide(F.col("__s") - F.col(y), F.col("__n") - 1), F.lit(overall))).select(*df.columns)


def frequency(df: DataFrame, column: str) -> DataFrame:
    """The value's share of all rows, null rows included; null gives 0."""
    n = df.count()
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg((F.count("*") / n).alias("share"))
    return lookup(df, column, counts, "share", 0.0)


def binary(df: DataFrame, column: str, table: DataFrame) -> DataFrame:
    """The bits of the label, the lowest first, as <column>_<bit>; unseen and null give 0."""
    k = table.count()
    bits = max(1, math.ceil(math.log2(k))) if k > 1 else 1
    out = lookup(df, column, table, "index", 0)
    return out.select("*", *[F.shiftright(F.col(column).cast("long"), i).bitwiseAND(F.lit(1)).cast("int").alias(f"{column}_{i}") for i in range(bits)]).drop(column)


def hashed(df: DataFrame, column: str, n: int = 4) -> DataFrame:
    """n columns of 1 or -1 by a digit of the value's SHA-256 salted with the column's number; null gives 0."""
    bit = lambda i: F.substring(F.sha2(F.concat(F.lit(f"{i}:"), F.col(column)), 256), 1, 1)
    return df.select("*", *[F.when(F.col(column).isNull(), 0).when(bit(i) < "8", 1).otherwise(-1).alias(f"{column}_hash_{i}") for i in range(n)]).drop(column)

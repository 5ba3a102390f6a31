"""Drift between two samples of a column, and in a stream of errors."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import order_stats
from ..functions.folds import folded

CRITICAL = {0.01: 1.63, 0.05: 1.36, 0.1: 1.22, 0.2: 1.07}


def ks(df: DataFrame, column: str, side: str, alpha: float = 0.05) -> DataFrame:
    """Of the two samples that the boolean ``side`` tells apart: the largest gap of their distributions, its bound and severity.

    Values are counted first; running sums go over ranges of values whose totals are added, not over one sorted list.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count_if(side).alias("a"), F.count_if(~F.col(side)).alias("b"))
    low, high, n, m = counts.agg(F.min("v"), F.max("v"), F.sum("a"), F.sum("b")).first()
    part = F.least(F.floor((F.col("v") - low) / ((high - low) or 1.0) * 64), F.lit(63))
    counts = counts.withColumn("part", part)
    totals = counts.groupBy("part").agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    before = W.partitionBy(F.lit(0)).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("ta").over(before), F.lit(0)).alias("pa"), F.coalesce(F.sum("tb").over(before), F.lit(0)).alias("pb"))
    run = W.partitionBy("part").orderBy("v")
    gaps = counts.join(F.broadcast(totals), "part").select(F.abs((F.col("pa") + F.sum("a").over(run)) / n - (F.col("pb") + F.sum("b").over(run)) / m).alias("gap"))
    bound = CRITICAL[alpha] * math.sqrt((n + m) / (n * m))
    severity = F.when(F.col("score") > 1.5 * bound, 2).when(F.col("score") > bound, 1).otherwise(0)
    return gaps.agg(F.max("gap").alias("score")).select(F.lit("ks").alias("test"), "score", F.lit(bound).alias("bound"), severity.alias("severity"))


def psi(df: DataFrame, column: str, side: str, bins: int = 10) -> DataFrame:
    """The population stability index over bins at the first sample's ranks i * n / bins; shares are 1e-4 at least."""
    first = df.where(F.col(side) & F.col(column).isNotNull())
    n, found = order_stats.ranked(first, {column: lambda n: [i * n // bins for i in range(1, bins)]})[column]
    cuts = [found[i * n // bins] for i in range(1, bins)]
    place = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda e: e < F.col(column)))
    counts = df.where(F.col(column).isNotNull()).groupBy(place.alias("bin")).agg(F.count_if(side).alias("a"), F.count_if(~F.col(side)).alias("b"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(F.broadcast(counts), "bin", "left").na.fill(0)
    total = every.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    p, q = F.greatest(F.col("a") / F.col("ta"), F.lit(1e-4)), F.greatest(F.col("b") / F.col("tb"), F.lit(1e-4))
    score = every.crossJoin(F.broadcast(total)).agg(F.sum((q - p) * F.ln(q / p)).alias("score"))
    return score.select(F.lit("psi").alias("test"), "score", F.lit(0.1).alias("bound"), F.when(F.col("score") > 0.2, 2).when(F.col("score") > 0.1, 1).otherwise(0).alias("severity"))


def js(df: DataFrame, column: str, side: str, bins: int = 20, bound: float = 0.1) -> DataFrame:
    """The Jensen-Shannon divergence, in bits, over equal bins of the joint range."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    place = F.least(F.floor((F.col(column) - low) / ((high - low) / bins or 1.0)), F.lit(bins - 1)).cast("int")
    counts = df.where(F.col(column).isNotNull()).groupBy(place.alias("bin")).agg(F.count_if(side).alias("a"), F.count_if(~F.col(side)).alias("b"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(F.broadcast(counts), "bin", "left").na.fill(0)
    total = every.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    p, q = F.col("a") / F.col("ta") + 1e-10, F.col("b") / F.col("tb") + 1e-10
    m = (p + q) / 2
    score = every.crossJoin(F.broadcast(total)).agg(((F.sum(p * F.ln(p / m)) + F.sum(q * F.ln(q / m))) / 2 / math.log(2)).alias("score"))
    return score.select(F.lit("js").alias("test"), "score", F.lit(bound).alias("bound"), F.when(F.col("score") > 2 * bound, 2).when(F.col("score") > bound, 1).otherwise(0).alias("severity"))


def vote(df: DataFrame, column: str, side: str) -> DataFrame:
    """Drift if two of the three tests find it, with the mean score and the highest severity."""
    tests = ks(df, column, side).unionByName(psi(df, column, side)).unionByName(js(df, column, side))
    return tests.agg(F.lit(column).alias("column"), F.count_if(F.col("severity") > 0).alias("votes"), F.avg("score").alias("score"), F.max("severity").alias("severity")).withColumn("drift", F.col("votes") >= 2)


def report(df: DataFrame, columns: list[str], side: str) -> DataFrame:
    """A row per column: size, mean, population deviation and the values at ranks trunc(n / 4), trunc(n / 2) and trunc(3 n / 4)
    of both samples, the three scores, how many of them tell of drift, and whether two do."""
    out = None
    place = lambda n: [min(int(n * p), n - 1) for p in (0.25, 0.5, 0.75)]
    for c in columns:
        row = None
        for name, part in (("before", df.where(F.col(side))), ("after", df.where(~F.col(side)))):
            n, found = order_stats.ranked(part, {c: place})[c]
            quarters = [found[k] for k in place(n)] if n else [None] * 3
            facts = part.agg(F.count(c).alias(f"n_{name}"), F.avg(c).alias(f"mean_{name}"), F.stddev_pop(c).alias(f"std_{name}"), *[F.lit(q).cast("double").alias(f"q{k}_{name}") for k, q in zip((25, 50, 75), quarters, strict=True)])
            row = facts if row is None else row.crossJoin(F.broadcast(facts))
        tests = ks(df, c, side).unionByName(psi(df, c, side)).unionByName(js(df, c, side))
        votes = tests.agg(*[F.max(F.when(F.col("test") == t, F.col("score"))).alias(t) for t in ("ks", "psi", "js")], F.count_if(F.col("severity") > 0).alias("votes"), F.max("severity").alias("__most"))
        own = row.crossJoin(F.broadcast(votes)).withColumn("drift", F.col("votes") >= 2).withColumn("severity", F.when(F.col("drift"), F.col("__most")).otherwise(0)).drop("__most")
        own = own.select(F.lit(c).alias("column"), *own.columns)
        out = own if out is None else out.unionByName(own)
    return out


def ddm(df: DataFrame, by: list[str], order: list[str], error: str, least: int = 30) -> DataFrame:
    """Each row's error rate p and deviation s, and whether p + s rises 2 or 3 deviations above their least sum so far."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = df.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("p", F.sum(F.col(error).cast("double")).over(w) / F.col("n"))
    rows = rows.withColumn("s", F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("n")))
    ripe = F.when(F.col("n") >= least, F.struct((F.col("p") + F.col("s")).alias("sum"), "p", "s"))
    rows = rows.withColumn("low", F.min(ripe).over(w))
    level = F.when(F.col("low").isNull(), 0).when(F.col("p") + F.col("s") > F.col("low.p") + 3 * F.col("low.s"), 2).when(F.col("p") + F.col("s") > F.col("low.p") + 2 * F.col("low.s"), 1).otherwise(0)
    return rows.withColumn("level", level).drop("low")


def eddm(df: DataFrame, by: list[str], order: list[str], error: str, least: int = 30, warn: float = 0.95, drift: float = 0.9) -> DataFrame:
    """At each error: the mean distance between errors plus 2 deviations, against its greatest so far."""
    w = W.partitionBy(*by).orderBy(*order)
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    rows = df.withColumn("i", F.row_number().over(w)).where(F.col(error))
    rows = rows.withColumn("distance", (F.col("i") - F.lag("i").over(w)).cast("double")).withColumn("errors", F.row_number().over(w))
    rows = rows.withColumn("mean", F.coalesce(F.sum("distance").over(upto), F.lit(0.0)) / F.col("errors"))
    rows = rows.withColumn("std", F.sqrt(F.greatest(F.lit(0.0), F.coalesce(F.sum(F.col("distance") * F.col("distance")).over(upto), F.lit(0.0)) / F.col("errors") - F.col("mean") * F.col("mean"))))
    rows = rows.withColumn("peak", F.max(F.when(F.col("errors") >= least, F.col("mean") + 2 * F.col("std"))).over(upto))
    ratio = F.try_divide(F.col("mean") + 2 * F.col("std"), F.col("peak"))
    return rows.withColumn("ratio", ratio).withColumn("level", F.when(ratio < drift, 2).when(ratio < warn, 1).otherwise(0))


def page_hinkley(df: DataFrame, by: list[str], order: list[str], x: str, key: str, delta: float = 0.005, bound: float = 50.0, keep: float = 0.9999) -> DataFrame:
    """(key, sum, drift): the cumulative deviation from a slowly moving mean over its least so far, folded per entity."""
    def step(state: tuple | None, v: float) -> tuple[tuple, tuple]:
        mean, total, low = state or (v, 0.0, 0.0)
        mean = keep * mean + (1 - keep) * v if state else v
        total += v - mean - delta
        low = min(low, total)
        return (mean, total, low), (total - low, total - low > bound)

    rows = df.select(*dict.fromkeys([*by, *order, key]), F.col(x).cast("double").alias("__x"))
    return folded(rows, by, order, ["__x"], "sum double, drift boolean", lambda: None, step).select(key, "sum", "drift")


def adwin(df: DataFrame, by: list[str], order: list[str], x: str, key: str, delta: float = 0.002, most: int = 10_000) -> DataFrame:
    """(key, width, drift): an adaptive window per entity of ``most`` values at most, cut at the split whose two parts differ
    most of all that differ by more than the Hoeffding bound. All splits of 10 or more values are tried, once a row."""
    import numpy as np

    def step(window: np.ndarray, v: float) -> tuple[np.ndarray, tuple]:
        window = np.append(window, v)[-most:]
        n, cut = len(window), False
        if n >= 10:
            left = np.arange(1, n)
            sums = np.cumsum(window)
            gap = np.abs(sums[:-1] / left - (sums[-1] - sums[:-1]) / (n - left))
            m = 1 / (1 / left + 1 / (n - left))
            over = np.where(gap > np.sqrt(np.log(n / delta) / (2 * m)), gap, 0.0)
            best = int(over.argmax())
            if over[best] > 0:
                window, cut = window[best + 1 :], True
        return window, (len(window), cut)

    rows = df.select(*dict.fromkeys([*by, *order, key]), F.col(x).cast("double").alias("__x"))
    return folded(rows, by, order, ["__x"], "width long, drift boolean", lambda: np.empty(0), step).select(key, "width", "drift")

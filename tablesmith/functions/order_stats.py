"""Exact order statistics of columns, at any size, for all columns and ranks together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bins into which a scan cuts each range that still holds a rank.
BINS = 4096
MOST = 1.7976931348623157e308


def _bin(x: Column, a: float, b: float) -> Column:
    """The bin of a value between a and b; both ends fall into different bins."""
    low, high = max(a, -MOST) / 2, min(b, MOST) / 2
    if (high - low) / BINS < 1e-290:
        return F.when(x > a, 1).otherwise(0)
    inner = F.greatest(F.least(F.floor((F.greatest(F.least(x, F.lit(MOST)), F.lit(-MOST)) / 2 - low) / (high - low) * (BINS - 2)) + 1, F.lit(BINS - 2)), F.lit(1))
    return F.when(x <= a, 0).when(x >= b, BINS - 1).otherwise(inner).cast("int")


def ranked(df: DataFrame, ranks: dict[str, Callable[[int], list[int]]]) -> dict[str, tuple[int, dict[int, float]]]:
    """For each column how many values it has, and those at the 0-based ranks that ``ranks`` gives for that number.

    Nulls and NaN don't count. The first scan takes numbers and ranges; each further one counts values in bins of the
    ranges that hold a rank, for all columns together, and narrows these to a bin, until a range is one value. What
    reaches the driver is counts of bins; nothing is sorted or gathered, and a few scans settle any number of rows.
    """
    values = {c: F.col(c).cast("double") for c in ranks}
    values = {c: F.when(~F.isnan(x), x) for c, x in values.items()}
    first = df.agg(*[f(x).alias(f"{i}_{j}") for i, x in enumerate(values.values()) for j, f in enumerate((F.count, F.min, F.max))]).first()
    found: dict[str, tuple[int, dict[int, float]]] = {}
    open_: dict[tuple[str, float, float], list[tuple[int, int]]] = {}  # range -> (rank, rank within the range)
    for i, (c, wanted) in enumerate(ranks.items()):
        n, a, b = (first[f"{i}_{j}"] for j in range(3))
        found[c] = (n, {})
        for k in {k for k in wanted(n) if 0 <= k < n} if n else ():
            open_.setdefault((c, a, b), []).append((k, k))
    while open_:
        spans, parts = {}, []
        for (c, a, b), inside in open_.items():
            if a == b:
                found[c][1].update({k: a for k, _ in inside})
            else:
                spans[len(spans)] = (c, a, b)
                x = values[c]
                parts.append(F.when(x.between(a, b), F.struct(F.lit(len(spans) - 1).alias("span"), _bin(x, a, b).alias("bin"), x.alias("x"))))
        if not spans:
            break
        rows = df.select(F.explode(F.filter(F.array(*parts), lambda s: s.isNotNull())).alias("s")).select("s.*")
        bins: dict[int, list] = {}
        for r in rows.groupBy("span", "bin").agg(F.count("*").alias("n"), F.min("x").alias("a"), F.max("x").alias("b")).collect():
            bins.setdefault(r["span"], []).append((r["bin"], r["n"], r["a"], r["b"]))
        narrowed: dict[tuple[str, float, float], list[tuple[int, int]]] = {}
        for i, (c, a, b) in spans.items():
            for k, left in open_[c, a, b]:
                for _, held, low, high in sorted(bins[i]):
                    if left < held:
                        narrowed.setdefault((c, low, high), []).append((k, left))
                        break
                    left -= held
        open_ = narrowed
    return found


def at_ranks(df: DataFrame, column: str, ranks: list[int]) -> dict[int, float]:
    """The values of ``column`` at 0-based ``ranks`` of its sorted values; ranks beyond them are left out."""
    return ranked(df, {column: lambda n: ranks})[column][1]


def count(df: DataFrame, column: str) -> int:
    return df.where(F.col(column).isNotNull()).count()


def summaries(df: DataFrame, columns: list[str], shares: tuple[float, ...] = (0.25, 0.75)) -> dict[str, tuple[float | None, ...]]:
    """For each column its median (the mean of the two middle values), then the values at ranks trunc(share * n)."""
    place = lambda n: [(n - 1) // 2, n // 2, *[min(int(n * p), n - 1) for p in shares]]
    out = {}
    for c, (n, found) in ranked(df, {c: place for c in columns}).items():
        got = [found[k] for k in place(n)] if n else [None] * (2 + len(shares))
        out[c] = (None if n == 0 else (got[0] + got[1]) / 2, *got[2:])
    return out


def nearest(df: DataFrame, column: str, *shares: float) -> list[float]:
    """The values at ranks trunc(share * n), the last rank at most."""
    return list(summaries(df, [column], shares)[column][1:])


def median(df: DataFrame, column: str) -> float | None:
    """The mean of the two middle values, or the middle one."""
    return summaries(df, [column], ())[column][0]

"""Value transforms, power transforms, bins, outliers and quantization, as expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import order_stats

NAN = float("nan")


def _guard(ok: Column, value: Column) -> Column:
    return F.when(ok, value).otherwise(F.lit(NAN))


def apply(name: str, x: Column, power: float = 2.0) -> Column:
    """log, log1p, log10, sqrt, power, reciprocal or identity; NaN outside the domain."""
    return {
        "log": lambda: _guard(x > 0, F.ln(x)), "log1p": lambda: _guard(x > -1, F.log1p(x)), "log10": lambda: _guard(x > 0, F.log10(x)), "sqrt": lambda: _guard(x >= 0, F.sqrt(x)),
        "power": lambda: F.pow(x, F.lit(power)), "reciprocal": lambda: F.when(F.abs(x) > 1e-10, 1 / F.when(F.abs(x) > 1e-10, x)).otherwise(F.lit(NAN)), "identity": lambda: x,
    }[name]()


def box_cox(x: Column, lam: float, shift: float = 0.0) -> Column:
    y = x + shift
    return _guard(y > 0, F.ln(y) if abs(lam) < 1e-10 else (F.pow(y, F.lit(lam)) - 1) / lam)


def box_cox_inverse(y: Column, lam: float, shift: float = 0.0) -> Column:
    return (F.exp(y) if abs(lam) < 1e-10 else F.pow(y * lam + 1, F.lit(1 / lam))) - shift


def yeo_johnson(x: Column, lam: float) -> Column:
    up = F.log1p(x) if abs(lam) < 1e-10 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
    down = -F.log1p(-x) if abs(lam - 2) < 1e-10 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(x >= 0, up).otherwise(down)


def yeo_johnson_inverse(y: Column, lam: float) -> Column:
    up = F.expm1(y) if abs(lam) < 1e-10 else F.pow(y * lam + 1, F.lit(1 / lam)) - 1
    down = -F.expm1(-y) if abs(lam - 2) < 1e-10 else 1 - F.pow(1 - y * (2 - lam), F.lit(1 / (2 - lam)))
    return F.when(y >= 0, up).otherwise(down)


GRID = [round(-2 + 0.1 * i, 1) for i in range(41)]


def best_lambda(df: DataFrame, column: str, family: str) -> tuple[float, float, DataFrame]:
    """(lambda, shift, likelihoods): the lambda of GRID with the greatest log-likelihood, the first of ties; one scan."""
    low = df.agg(F.min(column)).first()[0]
    shift = 1 - low if family == "box_cox" and low <= 0 else 0.0
    x = F.col(column) + shift
    jacobian = F.sum(F.ln(x)) if family == "box_cox" else F.sum(F.signum(x) * F.log1p(F.abs(x)))
    f = (lambda lam: box_cox(x, lam)) if family == "box_cox" else (lambda lam: yeo_johnson(x, lam))
    row = df.where(F.col(column).isNotNull()).agg(F.count("*").alias("n"), jacobian.alias("j"), *[F.var_pop(f(lam)).alias(f"v{i}") for i, lam in enumerate(GRID)])
    entries = F.array(*[F.struct(F.lit(lam).alias("lam"), (-F.col("n") / 2 * F.ln(F.greatest(F.col(f"v{i}"), F.lit(1e-300))) + (lam - 1) * F.col("j")).alias("likelihood")) for i, lam in enumerate(GRID)])
    table = row.select(F.explode(entries).alias("s")).select("s.*")
    best = max(((r["likelihood"], -i) for i, r in enumerate(table.collect()) if not math.isnan(r["likelihood"])))
    return GRID[-best[1]], shift, table


def edges(df: DataFrame, column: str, bins: int, how: str, rounds: int = 50) -> list[float]:
    """Inner and outer edges: uniform, quantile (values at trunc(q * (n - 1))) or kmeans in one dimension."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    if how == "uniform":
        return [low + (high - low) * i / bins for i in range(bins + 1)]
    if how == "quantile":
        place = lambda n: [int(i / bins * (n - 1)) for i in range(bins + 1)]
        n, found = order_stats.ranked(df, {column: place})[column]
        return [found[k] for k in place(n)]
    centers = [low + (high - low) * (i + 0.5) / bins for i in range(bins)]
    for _ in range(rounds):
        cuts = [(a + b) / 2 for a, b in zip(centers, centers[1:], strict=False)]
        rows = df.where(F.col(column).isNotNull()).groupBy(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda e: e < F.col(column))).alias("k")).agg(F.avg(column).alias("m")).collect()
        new = list(centers)
        for r in rows:
            new[r["k"]] = r["m"]
        done = max(abs(a - b) for a, b in zip(new, centers, strict=True)) < 1e-9
        centers = sorted(new)
        if done:
            break
    return [low, *[(a + b) / 2 for a, b in zip(centers, centers[1:], strict=False)], high]


def bin_of(x: Column, cuts: list[float]) -> Column:
    """The bin by upper edges, which belong to the lower bin; below the first and above the last edge it's the last bin."""
    last = len(cuts) - 2
    inner = F.size(F.filter(F.array(*map(F.lit, cuts[1:-1])), lambda e: e < x)) if len(cuts) > 2 else F.lit(0)
    return F.when(x.isNull(), None).when((x < cuts[0]) | (x > cuts[-1]), last).otherwise(inner)


def bounds(df: DataFrame, column: str, method: str, k: float) -> tuple[float, float]:
    """Bounds beyond which values are outliers. ``method``: iqr, zscore, percentile (k percent on each side) or modified."""
    if method == "iqr":
        a, b = order_stats.nearest(df, column, 0.25, 0.75)
        return a - k * (b - a), b + k * (b - a)
    if method == "zscore":
        m, s = df.agg(F.avg(column), F.stddev_pop(column)).first()
        return m - k * s, m + k * s
    if method == "percentile":
        place = lambda n: [int(n * k / 100), min(math.ceil(n * (100 - k) / 100), n - 1)]
        n, found = order_stats.ranked(df, {column: place})[column]
        return tuple(found[r] for r in place(n))
    n, found = order_stats.ranked(df, {column: lambda n: [n // 2]})[column]
    middle = found[n // 2]
    spread = df.agg(F.avg(F.abs(F.col(column) - middle))).first()[0] * 1.4826
    return middle - k * spread, middle + k * spread


def is_outlier(c: str, of: tuple[float, float]) -> Column:
    return F.coalesce((F.col(c) < of[0]) | (F.col(c) > of[1]), F.lit(False))


def treat(df: DataFrame, c: str, of: tuple[float, float], how: str) -> DataFrame:
    """clip, nan, remove, mean, median or none. mean and median are those of the values within bounds."""
    x, out = F.col(c), is_outlier(c, of)
    if how == "clip":
        return df.withColumn(c, F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(of[0])), F.lit(of[1]))))
    if how == "nan":
        return df.withColumn(c, F.when(out, F.lit(NAN)).otherwise(x))
    if how == "remove":
        return df.where(~out)
    if how in ("mean", "median"):
        inside = df.where(~out)
        value = inside.agg(F.avg(c)).first()[0] if how == "mean" else order_stats.median(inside, c)
        return df.withColumn(c, F.when(out, F.lit(value)).otherwise(x))
    return df


def half_away(x: Column) -> Column:
    return F.signum(x) * F.floor(F.abs(x) + 0.5)


def quantize(x: Column, low: float, high: float, bits: int = 8, symmetric: bool = True, signed: bool = True) -> tuple[Column, float, int]:
    """(quantized, scale, zero point); the range comes from a calibrator. Ties round away from zero; values clamp."""
    least, most = (-(2 ** (bits - 1)), 2 ** (bits - 1) - 1) if signed else (0, 2**bits - 1)
    if symmetric:
        scale, zero = max(abs(low), abs(high)) / most or 1.0, 0
    else:
        scale = (high - low) / (most - least) or 1.0
        zero = int(min(most, max(least, round(least - low / scale))))
    return F.least(F.greatest(half_away(x / scale) + zero, F.lit(least)), F.lit(most)).cast("int"), scale, zero


def dequantize(q: Column, scale: float, zero: int) -> Column:
    return (q - zero) * scale


def moving_range(df: DataFrame, column: str, batch: str, keep: float = 0.9) -> tuple[float, float]:
    """The range by batches in order: each batch's least and greatest value moves the bounds by 1 - ``keep``; batches are few."""
    low = high = None
    for r in df.groupBy(batch).agg(F.min(column).alias("a"), F.max(column).alias("b")).where("a is not null").orderBy(batch).collect():
        low = r["a"] if low is None else keep * low + (1 - keep) * r["a"]
        high = r["b"] if high is None else keep * high + (1 - keep) * r["b"]
    return low, high


def calibrate(df: DataFrame, column: str, method: str = "minmax", share: float = 0.999, bins: int = 2048) -> tuple[float, float]:
    """minmax; percentile: the values at the ranks that cut (1 - ``share``) / 2 of the values on either side; or histogram: the
    edges of bins between which ``share`` of the values lie, in equal shares cut on both sides."""
    if method == "percentile":
        place = lambda n: [int((1 - share) / 2 * (n - 1)), math.ceil((1 + share) / 2 * (n - 1))]
        n, found = order_stats.ranked(df, {column: place})[column]
        return tuple(found[k] for k in place(n))
    low, high = df.agg(F.min(column), F.max(column)).first()
    if method == "minmax" or high == low:
        return low, high
    width = (high - low) / bins
    counts = {r["b"]: r["n"] for r in df.groupBy(F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)).alias("b")).agg(F.count("*").alias("n")).collect() if r["b"] is not None}
    total, off = sum(counts.values()), (1 - share) / 2
    run, a, b = 0, 0, bins
    for i in range(bins):
        run += counts.get(i, 0)
        if run <= off * total:
            a = i + 1
        if run < (1 - off) * total:
            b = i + 2
    return low + a * width, low + min(b, bins) * width


def softmax(v: Column, log: bool = False) -> Column:
    top = F.array_max(v)
    total = F.aggregate(v, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return F.transform(v, lambda x: x - top - F.ln(total)) if log else F.transform(v, lambda x: F.exp(x - top) / total)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def argmax(v: Column) -> Column:
    return F.array_position(v, F.array_max(v)) - 1


def mean(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)


def variance(v: Column) -> Column:
    m = mean(v)
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / F.size(v)

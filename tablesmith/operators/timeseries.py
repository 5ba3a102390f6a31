"""Time-series operators. Rows are ordered within an entity by explicit keys; frames never span entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.folds import folded


def over(by: list[str], order: list[str]) -> WindowSpec:
    return W.partitionBy(*by).orderBy(*order)


def lag(c: str, k: int, w: WindowSpec, fill: float = 0.0) -> Column:
    return F.lag(c, k, fill).over(w)


def rolling(c: str, size: int, w: WindowSpec, name: str, least: int = 1) -> Column:
    """mean, sum, min, max, std (population), median, skew or kurt over the last ``size`` rows; null below ``least`` rows.

    Skewness needs 3 rows and kurtosis 4, and both some spread; otherwise they're 0.
    """
    frame = w.rowsBetween(1 - size, 0)
    n = F.count(c).over(frame)
    spread = F.stddev_pop(c).over(frame)
    value = {
        "mean": lambda: F.avg(c).over(frame), "sum": lambda: F.sum(c).over(frame), "min": lambda: F.min(c).over(frame), "max": lambda: F.max(c).over(frame), "std": lambda: spread, "median": lambda: F.percentile(c, 0.5).over(frame),
        "skew": lambda: F.when((n < 3) | (spread < 1e-12), 0.0).otherwise(F.skewness(c).over(frame)), "kurt": lambda: F.when((n < 4) | (spread < 1e-12), 0.0).otherwise(F.kurtosis(c).over(frame)),
    }[name]()
    return F.when(n >= least, value)


def diff(c: str, k: int, w: WindowSpec) -> Column:
    return F.col(c) - F.lag(c, k).over(w)


def ewm(df: DataFrame, c: str, by: list[str], order: list[str], span: float, key: str) -> DataFrame:
    """(key, ewm): e[i] = a x[i] + (1 - a) e[i-1] with a = 2 / (span + 1), by a fold over each entity's rows; a null keeps e."""
    a = 2 / (span + 1)

    def step(e: float | None, v: float | None) -> tuple[float | None, tuple]:
        e = e if v is None else v if e is None else a * v + (1 - a) * e
        return e, (e,)

    rows = df.select(*dict.fromkeys([*by, *order, key]), F.col(c).cast("double").alias("__x"))
    return folded(rows, by, order, ["__x"], "ewm double", lambda: None, step).select(key, "ewm")


def calendar_approximate(ts: Column) -> dict[str, Column]:
    """Calendar fields from Unix seconds by plain arithmetic with mean years and months, as the reported behaviour has them."""
    days = F.floor(F.unix_seconds(ts.cast("timestamp")) / 86400)
    dow, doy = F.pmod(days + 4, F.lit(7)), F.pmod(days, F.lit(365))
    month = F.least(F.floor(doy / 30.44) + 1, F.lit(12))
    hour = F.floor(F.pmod(F.unix_seconds(ts.cast("timestamp")), F.lit(86400)) / 3600)
    return {"year": F.floor(days / 365.25) + 1970, "month": month, "dow": dow, "hour": hour, "week": F.floor(doy / 7) + 1, "quarter": F.floor((month - 1) / 3) + 1, "is_weekend": (dow >= 5).cast("int")}


def calendar(ts: Column) -> dict[str, Column]:
    return {"year": F.year(ts), "month": F.month(ts), "day": F.dayofmonth(ts), "dow": F.dayofweek(ts) - 1, "hour": F.hour(ts), "week": F.weekofyear(ts), "quarter": F.quarter(ts), "is_weekend": F.dayofweek(ts).isin(1, 7).cast("int")}


def cyclical(x: Column, period: float) -> tuple[Column, Column]:
    angle = x * (2 * 3.141592653589793 / period)
    return F.sin(angle), F.cos(angle)


def difference(df: DataFrame, c: str, w: WindowSpec, order: int = 1, season: int = 0) -> DataFrame:
    """``order``-th differences after a seasonal one; rows without enough history go."""
    out = df
    if season:
        out = out.withColumn(c, diff(c, season, w)).where(F.col(c).isNotNull())
    for _ in range(order):
        out = out.withColumn(c, diff(c, 1, w)).where(F.col(c).isNotNull())
    return out


def decompose(df: DataFrame, c: str, by: list[str], order: list[str], period: int, multiplicative: bool = False) -> DataFrame:
    """``df`` with trend (centred mean, shrinking at the ends), seasonal (mean per place in the period, centred) and residual."""
    w, half = over(by, order), period // 2
    rows = df.withColumn("__i", F.row_number().over(w) - 1).withColumn("trend", F.avg(c).over(w.rowsBetween(-half, half)))
    rows = rows.withColumn("__p", F.col("__i") % period).withColumn("__d", F.try_divide(F.col(c), F.col("trend")) if multiplicative else F.col(c) - F.col("trend"))
    pattern = rows.groupBy(*by, "__p").agg(F.avg("__d").alias("__s"))
    center = F.avg("__s").over(W.partitionBy(*by))
    pattern = pattern.withColumn("seasonal", F.col("__s") / center if multiplicative else F.col("__s") - center).drop("__s")
    out = rows.join(pattern, [*by, "__p"])
    rest = F.try_divide(F.col(c), F.col("trend") * F.col("seasonal")) if multiplicative else F.col(c) - F.col("trend") - F.col("seasonal")
    return out.withColumn("residual", rest).drop("__i", "__p", "__d")


def seasonal_means(df: DataFrame, c: str, by: list[str], order: list[str], period: int) -> DataFrame:
    """``df`` with place (in the period) and pattern, the mean of its rows there."""
    rows = df.withColumn("place", (F.row_number().over(over(by, order)) - 1) % period)
    return rows.join(rows.groupBy(*by, "place").agg(F.avg(c).alias("pattern")), [*by, "place"])


def chain(x: Column, log: bool = True, lam: float | None = None) -> Column:
    """ln(x + 1), then Box-Cox of that plus 1 where ``lam`` is given; differences are ``difference``'s."""
    out = F.log1p(x) if log else x
    return out if lam is None else F.log1p(out) if abs(lam) < 1e-10 else (F.pow(out + 1, F.lit(lam)) - 1) / lam


def unchained(y: Column, log: bool = True, lam: float | None = None) -> Column:
    out = y if lam is None else F.expm1(y) if abs(lam) < 1e-10 else F.pow(y * lam + 1, F.lit(1 / lam)) - 1
    return F.expm1(out) if log else out


def folds(spark, n: int, spec: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """(fold, role, row_idx) of folds (id, train start, train end, test start, test end), ends excluded."""
    table = spark.createDataFrame(spec, "fold int, a int, b int, c int, d int")
    parts = F.explode(F.array(F.struct(F.lit("train").alias("role"), F.col("a").alias("lo"), F.col("b").alias("hi")), F.struct(F.lit("test").alias("role"), F.col("c").alias("lo"), F.col("d").alias("hi"))))
    rows = table.select("fold", parts.alias("p")).where("p.lo < p.hi")
    return rows.select("fold", "p.role", F.explode(F.sequence(F.col("p.lo"), F.col("p.hi") - 1)).alias("row_idx"))


def expanding(n: int, splits: int, test: int, gap: int = 0, most_train: int | None = None) -> list[tuple]:
    """Folds from the end backwards, ids ascending in time; folds without training rows are left out."""
    out = []
    for k in range(splits):
        end = n - k * test
        start = end - test
        train_end = start - gap
        if start <= 0 or train_end <= 0:
            continue
        out.append((splits - 1 - k, max(0, train_end - most_train) if most_train else 0, train_end, start, end))
    return out[::-1]


def walking(n: int, first: int, step: int, horizon: int, expand: bool = True) -> list[tuple]:
    out, at, k = [], first, 0
    while at + horizon <= n:
        out.append((k, 0 if expand else at - first, at, at, at + horizon))
        at, k = at + step, k + 1
    return out


def blocked(n: int, splits: int, gap: int = 0) -> list[tuple]:
    """Each block is tested on all that lies before it and a gap; the first has nothing before it."""
    size, out = n // splits, []
    for k in range(splits):
        start, end = k * size, n if k == splits - 1 else (k + 1) * size
        if start > gap:
            out.append((k, 0, start - gap, start, end))
    return out


def purged(n: int, splits: int, purge: int) -> list[tuple]:
    size = n // (splits + 1)
    return [(k, 0, start - purge, start, min(n, start + size)) for k in range(splits) if (start := (k + 1) * size) - purge > 0]

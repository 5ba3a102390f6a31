"""Profiles: one scan's aggregates over all columns, turned into a row per column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import moments, order_stats


def per_column(df: DataFrame, columns: list[str], measures: dict) -> DataFrame:
    """A row per column with ``measures`` {name: f(column) -> aggregate}; all are taken in one scan."""
    row = df.agg(*[F.struct(F.lit(c).alias("column"), *[f(c).alias(m) for m, f in measures.items()]).alias(f"s{i}") for i, c in enumerate(columns)])
    return row.select(F.explode(F.array(*[f"s{i}" for i in range(len(columns))])).alias("s")).select("s.*")


def info(df: DataFrame) -> DataFrame:
    """column, dtype, null_count, n_unique and null_pct of every column."""
    kinds = dict(df.dtypes)
    out = per_column(df, df.columns, {"null_count": lambda c: F.count_if(F.col(c).isNull()), "n_unique": moments.unique, "rows": lambda c: F.count(F.lit(1))})
    dtype = F.coalesce(*[F.when(F.col("column") == c, F.lit(k)) for c, k in kinds.items()])
    return out.select("column", dtype.alias("dtype"), "null_count", "n_unique", F.round(F.try_divide(F.col("null_count") * 100.0, F.col("rows")), 2).alias("null_pct"))


def analyze(df: DataFrame, columns: list[str]) -> DataFrame:
    """The numeric profile: spread, nearest-rank quartiles, sample skewness and kurtosis, outliers and zeros."""
    found = order_stats.summaries(df, columns)
    middle, bounds = {c: x[0] for c, x in found.items()}, {c: x[1:] for c, x in found.items()}

    def outliers(c: str) -> Column:
        a, b = bounds[c]
        return F.count_if((F.col(c) < a - 1.5 * (b - a)) | (F.col(c) > b + 1.5 * (b - a)))

    r = lambda f: lambda c: F.round(f(c), 4)
    return per_column(df, columns, {
        "mean": r(F.avg), "std": r(F.stddev_samp), "min": r(F.min), "max": r(F.max), "median": lambda c: F.round(F.lit(middle[c]), 4),
        "q25": lambda c: F.round(F.lit(bounds[c][0]), 4), "q75": lambda c: F.round(F.lit(bounds[c][1]), 4),
        "skew": r(moments.skew_sample), "kurt": r(moments.kurt_sample), "variance": r(F.var_samp), "cv": lambda c: F.round(F.try_divide(F.stddev_samp(c) * 100, F.avg(c)), 2),
        "range": lambda c: F.round(F.max(c) - F.min(c), 4), "iqr": lambda c: F.round(F.lit(bounds[c][1] - bounds[c][0]), 4), "outliers": outliers, "total": lambda c: F.round(F.sum(c), 2), "zeros": lambda c: F.count_if(F.col(c) == 0),
    })


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Equal-width bins with their lower edges and counts; empty bins count 0."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    width = (high - low) / bins
    place = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)) if width else F.lit(0)
    counts = df.where(F.col(column).isNotNull()).groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(bins if width else 1).select(F.col("id").cast("int").alias("bin"))
    return every.join(F.broadcast(counts), "bin", "left").select("bin", (F.lit(low) + F.col("bin") * width).alias("lower"), F.coalesce("n", F.lit(0)).alias("n"))


def top_values(df: DataFrame, columns: list[str], k: int = 10) -> DataFrame:
    """The k most frequent values of each column with their shares, ties by value."""
    from pyspark.sql import Window as W

    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("s")).select("s.*").where("value is not null")
    counts = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    total = counts.groupBy("column").agg(F.sum("n").alias("all"))
    ranked = counts.withColumn("place", F.row_number().over(W.partitionBy("column").orderBy(F.desc("n"), "value"))).where(F.col("place") <= k)
    return ranked.join(F.broadcast(total), "column").select("column", "value", "n", "place", F.round(F.col("n") * 100 / F.col("all"), 2).alias("pct"))


def entropy(df: DataFrame, columns: list[str], bits: bool = True) -> DataFrame:
    """The entropy of each column's values, in bits or nats, and the most frequent value, the smallest of ties."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("s")).select("s.*").where("value is not null")
    counts = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    log = F.log2("n") if bits else F.ln("n")
    total = F.log2(F.sum("n")) if bits else F.ln(F.sum("n"))
    return counts.groupBy("column").agg(F.count("*").alias("n_unique"), F.round(total - F.sum(F.col("n") * log) / F.sum("n"), 6).alias("entropy"), F.max_by("value", F.struct("n", F.lit(0))).alias("__any"), F.min(F.struct((-F.col("n")).alias("k"), "value"))["value"].alias("mode")).drop("__any")


def correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlations of all pairs, nulls as 0; no spread gives 0, and a column with itself 1."""
    filled = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = filled.agg(*[F.coalesce(F.nanvl(F.corr(a, b), F.lit(0.0)), F.lit(0.0)).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    entries = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"p{i}").alias("r")) for i, p in enumerate(pairs) for a, b in (p, p[::-1])]
    entries += [F.struct(F.lit(c).alias("a"), F.lit(c).alias("b"), F.lit(1.0).alias("r")) for c in columns]
    return row.select(F.explode(F.array(*entries)).alias("s")).select("s.*")


def duplicates(df: DataFrame) -> DataFrame:
    """Rows, distinct rows and rows that repeat an earlier one."""
    groups = df.groupBy(*df.columns).agg(F.count("*").alias("n"))
    return groups.agg(F.sum("n").alias("rows"), F.count("*").alias("distinct_rows"), (F.sum("n") - F.count("*")).alias("duplicates"))


def quality(df: DataFrame, columns: list[str]) -> DataFrame:
    """Completeness, uniqueness, outliers and validity of numeric columns, the overall score and what it warns of.

    overall = .3 completeness + .2 distinct + .25 consistency + .25 validity, with consistency 1 for typed columns and
    validity = completeness * (1 - outliers).
    """
    bounds = {c: x[1:] for c, x in order_stats.summaries(df, columns).items()}

    def outside(c: str) -> Column:
        a, b = bounds[c]
        return F.count_if((F.col(c) < a - 1.5 * (b - a)) | (F.col(c) > b + 1.5 * (b - a)))

    table = per_column(df, columns, {
        "n": lambda c: F.count(F.lit(1)), "valid": F.count, "distinct": F.count_distinct, "outside": outside, "zeros": lambda c: F.count_if(F.col(c) == 0), "std": F.stddev_samp, "skew": moments.skew_sample, "kurt": moments.kurt_sample,
    })
    table = table.withColumns({"completeness": F.col("valid") / F.col("n"), "distinct_ratio": F.col("distinct") / F.col("valid"), "outlier_ratio": F.col("outside") / F.col("valid")})
    validity = F.col("completeness") * (1 - F.col("outlier_ratio"))
    overall = 0.3 * F.col("completeness") + 0.2 * F.col("distinct_ratio") + 0.25 + 0.25 * validity
    rules = [
        ("HighMissingness", F.col("completeness") < 0.7), ("ConstantColumn", F.col("std") < 1e-10), ("HighSkewness", F.abs("skew") > 2), ("HighKurtosis", F.abs("kurt") > 7),
        ("ManyZeros", F.col("zeros") / F.col("valid") > 0.5), ("HighOutlierRatio", F.col("outlier_ratio") > 0.1), ("HighCardinality", (F.col("distinct_ratio") > 0.95) & (F.col("n") > 20)),
    ]
    warnings = F.array_join(F.filter(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules]), lambda w: w.isNotNull()), ",")
    return table.select("column", *[F.round(c, 6).alias(c) for c in ("completeness", "distinct_ratio", "outlier_ratio")], F.round(validity, 6).alias("validity"), F.round(overall, 6).alias("overall"), warnings.alias("warnings"))


def column_types(df: DataFrame, columns: list[str]) -> DataFrame:
    """What each column is taken for: constant, id, categorical or numeric, and the encoding that fits."""
    table = per_column(df, columns, {"n": lambda c: F.count(F.lit(1)), "n_unique": F.count_distinct})
    ratio = F.col("n_unique") / F.col("n")
    kind = F.when(F.col("n_unique") <= 1, "constant").when((ratio > 0.95) & (F.col("n_unique") > 100), "id").when((F.col("n_unique") <= 50) & (ratio < 0.05), "categorical").otherwise("numeric")
    encoding = F.when(kind != "categorical", "none").when(F.col("n_unique") <= 10, "onehot").otherwise("target")
    return table.select("column", "n_unique", F.round(ratio, 6).alias("unique_ratio"), kind.alias("kind"), encoding.alias("encoding"))


def characteristics(df: DataFrame, columns: list[str]) -> DataFrame:
    """Sparsity, mean skewness, missing and 3-sigma outlier shares over all columns, and the choices that follow."""
    spread = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)])
    near = df.crossJoin(F.broadcast(spread))
    total = lambda f: sum((f(i, c) for i, c in enumerate(columns)), F.lit(0))
    row = near.agg(
        (total(lambda i, c: F.count_if(F.col(c) == 0)) / (F.count(F.lit(1)) * len(columns))).alias("sparsity"),
        (total(lambda i, c: F.abs(F.skewness(c))) / len(columns)).alias("skewness"),
        (total(lambda i, c: F.count_if(F.col(c).isNull())) / (F.count(F.lit(1)) * len(columns))).alias("missing"),
        (total(lambda i, c: F.count_if(F.abs(F.col(c) - F.col(f"m{i}")) > 3 * F.col(f"s{i}"))) / (F.count(F.lit(1)) * len(columns))).alias("outliers"),
    )
    scaler = F.when(F.col("outliers") > 0.05, "robust").when(F.col("sparsity") > 0.5, "maxabs").when(F.col("skewness") > 1, "minmax").otherwise("standard")
    return row.select(*[F.round(c, 6).alias(c) for c in row.columns], scaler.alias("scaler"))


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, population variance, skewness and excess kurtosis of each column."""
    return per_column(df, columns, {"mean": lambda c: F.round(F.avg(c), 6), "variance": lambda c: F.round(F.var_pop(c), 4), "skew": lambda c: F.round(F.skewness(c), 6), "kurt": lambda c: F.round(F.kurtosis(c), 6)})


def shifted(before: DataFrame, after: DataFrame, columns: list[str], least: float = 3.0) -> DataFrame:
    """Whether the mean of each column of ``after`` lies more than ``least`` deviations of ``before`` away."""
    a = per_column(before, columns, {"mean": F.avg, "std": lambda c: F.greatest(F.stddev_pop(c), F.lit(1e-10))})
    b = per_column(after, columns, {"now": F.avg})
    z = (F.col("now") - F.col("mean")) / F.col("std")
    return a.join(F.broadcast(b), "column").select("column", F.round(z, 6).alias("z"), (F.abs(z) > least).alias("shifted"))


def gate(df: DataFrame, numeric: list[str], other: list[str], y: str | None = None, most_imbalance: float = 10.0) -> DataFrame:
    """The quality report: a row per column (completeness, distinct, outlier and zero shares, consistency, validity,
    warnings), and a row ``*`` of the table with its means, uniqueness and overall score.

    Shares are of all rows. Consistency is 1 for typed columns; for text it's the share of its larger kind, numbers or
    not. Validity is completeness * consistency * (1 - outliers), overall .3 completeness + .2 uniqueness + .25
    consistency + .25 validity. A table that repeats rows, and a target ``y`` whose largest class has more than
    ``most_imbalance`` times the rows of the smallest, are warned of in the last row.
    """
    bounds = {c: x[1:] for c, x in order_stats.summaries(df, numeric).items()}
    lit = lambda x: F.lit(x).cast("double")
    first = {c: (r[f"{c}__0"], r[f"{c}__1"], r[f"{c}__2"]) for r in [df.agg(*[f(c).alias(f"{c}__{i}") for c in numeric for i, f in enumerate((F.min, F.max, F.count))]).first()] for c in numeric} if numeric else {}

    def outside(c: str) -> Column:
        a, b = bounds.get(c, (None, None))
        return F.lit(0).cast("long") if a is None else F.count_if((F.col(c) < a - 1.5 * (b - a)) | (F.col(c) > b + 1.5 * (b - a)))

    def uneven(c: str) -> Column:
        """Values that aren't whole steps from the least one, if values are evenly spread."""
        low, high, n = first.get(c, (None, None, 0))
        if not n or n < 2 or high == low:
            return F.lit(1).cast("long")
        step = (float(high) - float(low)) / (n - 1)
        place = (F.col(c).cast("double") - float(low)) / step
        return F.count_if(F.abs(place - F.round(place)) * step >= 1e-9)

    def consistency(c: str) -> Column:
        if c in numeric:
            return F.lit(1.0)
        share = F.count_if(F.trim(F.col(c)).rlike(r"^[-+]?[0-9]+([.][0-9]+)?$")) / F.count(c)
        return F.coalesce(F.greatest(share, 1 - share), F.lit(1.0))

    on = lambda f: lambda c: f(c) if c in numeric else lit(None)
    table = per_column(df, [*numeric, *other], {
        "n": lambda c: F.count(F.lit(1)), "valid": F.count, "distinct": F.count_distinct, "outside": outside, "uneven": uneven, "consistency": consistency, "zeros": lambda c: F.count_if(F.col(c) == 0) if c in numeric else F.lit(0).cast("long"),
        "std": on(lambda c: F.stddev_samp(c)), "skew": on(moments.skew_sample), "kurt": on(moments.kurt_sample),
    })
    share = lambda c: F.coalesce(F.try_divide(c, F.col("n")), F.lit(0.0))
    table = table.withColumns({"completeness": F.coalesce(F.try_divide("valid", "n"), F.lit(1.0)), "distinct_ratio": share(F.col("distinct")), "outlier_ratio": share(F.col("outside")), "zeros_ratio": share(F.col("zeros"))})
    table = table.withColumn("validity", F.col("completeness") * (1 - F.col("outlier_ratio")) * F.col("consistency"))
    many = (F.col("distinct_ratio") > 0.95) & (F.col("n") > 20)
    rules = [
        ("HighMissingness", F.col("completeness") < 0.7), ("ConstantColumn", (F.col("std") < 1e-10) & (F.col("n") > 1)), ("LowVariance", (F.col("std") >= 1e-10) & (F.col("std") < 1e-6)),
        ("HighSkewness", F.abs("skew") > 2), ("HighKurtosis", F.abs("kurt") > 7), ("HighZeroRatio", F.col("zeros_ratio") > 0.5), ("HighOutlierRatio", F.col("outlier_ratio") > 0.1), ("HighCardinality", many),
        ("SuspectedId", many & (F.col("distinct_ratio") > 0.99) & (F.col("distinct") == F.col("valid")) & (F.col("uneven") == 0)),
    ]
    joined = lambda found: F.array_join(F.filter(F.array(*[F.when(rule, F.lit(name)) for name, rule in found]), lambda w: w.isNotNull()), ",")
    columns = table.withColumn("warnings", joined(rules)).withColumn("overall", lit(None))
    repeats = duplicates(df).first()
    unique = 1 - repeats["duplicates"] / repeats["rows"] if repeats["rows"] else 1.0
    sizes = df.where(F.col(y).isNotNull()).groupBy(y).count().agg(F.max("count"), F.min("count")).first() if y else (None, None)
    uneven_classes = bool(sizes[0] and sizes[0] > most_imbalance * sizes[1])
    means = table.agg(*[F.avg(c).alias(c) for c in ("completeness", "outlier_ratio", "zeros_ratio", "consistency", "validity")])
    whole = means.select(
        F.lit("*").alias("column"), "completeness", F.lit(unique).alias("distinct_ratio"), "outlier_ratio", "zeros_ratio", "consistency", "validity", joined([("DuplicateRows", F.lit(bool(repeats["duplicates"]))), ("ClassImbalance", F.lit(uneven_classes))]).alias("warnings"),
        (0.3 * F.col("completeness") + 0.2 * unique + 0.25 * F.col("consistency") + 0.25 * F.col("validity")).alias("overall"),
    )
    return columns.select(*whole.columns).unionByName(whole)

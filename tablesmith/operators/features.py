"""Generated features, text vectors and feature selection."""

from __future__ import annotations

import math
from itertools import combinations, combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lineage

# The stop words that tokens leave out.
STOP_WORDS = [
    "a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "is", "was", "are", "were", "be", "have", "has", "it", "this", "that", "i", "you", "he", "she", "we", "they",
]


def polynomial(columns: list[str], degree: int, bias: bool = False, interaction_only: bool = False) -> dict[str, Column]:
    """Products of columns up to ``degree``, named like ``a^2`` and ``a * b``; the bias is ``1``."""
    out: dict[str, Column] = {"1": F.lit(1.0)} if bias else {}
    choose = combinations if interaction_only else combinations_with_replacement
    for k in range(1, degree + 1):
        for pick in choose(columns, k):
            powers = {c: pick.count(c) for c in dict.fromkeys(pick)}
            value = F.lit(1.0)
            for c, p in powers.items():
                for _ in range(p):
                    value = value * F.col(c)
            out[" * ".join(c if p == 1 else f"{c}^{p}" for c, p in powers.items())] = value
    return out


def interactions(columns: list[str], ops: list[str]) -> dict[str, Column]:
    """Pairs of columns by multiply, add, subtract, divide (b + 1e-10), max, min, mean or difference."""
    out = {}
    for a, b in combinations(columns, 2):
        x, y = F.col(a), F.col(b)
        every = {"multiply": (f"{a}*{b}", x * y), "add": (f"{a}+{b}", x + y), "subtract": (f"{a}-{b}", x - y), "divide": (f"{a}/{b}", x / (y + 1e-10)), "max": (f"max({a},{b})", F.greatest(x, y)), "min": (f"min({a},{b})", F.least(x, y)), "mean": (f"mean({a},{b})", (x + y) / 2), "difference": (f"|{a}-{b}|", F.abs(x - y))}
        out |= dict(every[o] for o in ops)
    return out


def crossing(df: DataFrame, columns: list[str], least: float = 0.3, top: int = 10) -> DataFrame:
    """(a, b, r): the pairs with the greatest |correlation| of at least ``least``."""
    pairs = list(combinations(columns, 2))
    row = df.agg(*[F.coalesce(F.corr(a, b), F.lit(0.0)).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    table = row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"p{i}").alias("r")) for i, (a, b) in enumerate(pairs)])).alias("s")).select("s.*")
    return table.where(F.abs("r") >= least).orderBy(F.desc(F.abs("r")), "a", "b").limit(top)


def tokens(text: Column, stop: bool = True) -> Column:
    """Lower-cased runs of letters and digits of 2 bytes or more, without stop words."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: F.octet_length(t) >= 2)
    return F.filter(words, lambda t: ~t.isin(STOP_WORDS)) if stop else words


def ngrams(words: Column, least: int, most: int) -> Column:
    """Runs of ``least`` to ``most`` words, joined by spaces."""
    def runs(n: int) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))
        return F.when(F.size(words) >= n, each).otherwise(F.array().cast("array<string>"))

    return F.concat(*[runs(n) for n in range(least, most + 1)])


def term_counts(docs: DataFrame, key: str, words: Column) -> DataFrame:
    return docs.select(key, F.explode(words).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def vocabulary(counts: DataFrame, n: int, min_df: int = 1, max_df: float = 1.0, most: int | None = None) -> DataFrame:
    """(term, df) with min_df <= df <= ceil(max_df * n), the most frequent first and ties by term."""
    out = counts.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df").between(min_df, math.ceil(max_df * n)))
    return out.orderBy(F.desc("df"), "term").limit(most) if most else out


def tf_idf(docs: DataFrame, key: str, words: Column, sublinear: bool = False, **limits) -> DataFrame:
    """(key, term, weight): tf * (ln((n + 1) / (df + 1)) + 1), scaled to unit length per document."""
    n = docs.count()
    counts = lineage.cut(term_counts(docs, key, words))
    tf = 1 + F.ln("tf") if sublinear else F.col("tf")
    weighed = counts.join(vocabulary(counts, n, **limits), "term").select(key, "term", (tf * (F.ln((F.lit(n) + 1) / (F.col("df") + 1)) + 1)).alias("w"))
    return weighed.select(key, "term", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(key)))).alias("weight"))


def hashing(docs: DataFrame, key: str, words: Column, bits: int = 8) -> DataFrame:
    """(key, slot, weight): counts on 2 ** bits slots by the djb2 hash of a term's bytes, scaled to unit length.

    h = 33 h + byte is only needed modulo the number of slots, a power of two.
    """
    width = 1 << bits
    codes = lambda t: F.transform(F.sequence(F.lit(1), F.octet_length(t)), lambda i: F.conv(F.substring(F.hex(t.cast("binary")), i * 2 - 1, F.lit(2)), 16, 10).cast("long"))
    slot = F.aggregate(codes(F.col("term")), F.lit(5381 % width).cast("long"), lambda h, b: F.pmod(h * 33 + b, F.lit(width)))
    counts = docs.select(key, F.explode(words).alias("term")).select(key, slot.alias("slot")).groupBy(key, "slot").agg(F.count("*").alias("n"))
    return counts.select(key, "slot", (F.col("n") / F.sqrt(F.sum(F.col("n") * F.col("n")).over(W.partitionBy(key)))).alias("weight"))


def variances(df: DataFrame, columns: list[str]) -> DataFrame:
    row = df.agg(*[F.var_pop(c).alias(c) for c in columns])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("variance")) for c in columns])).alias("s")).select("s.*")


def target_correlation(df: DataFrame, columns: list[str], y: str) -> DataFrame:
    """(column, r) with the target; no spread gives 0. Selection by correlation, rank, share or importance filters it."""
    row = df.agg(*[F.coalesce(F.corr(c, y), F.lit(0.0)).alias(c) for c in columns])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("r")) for c in columns])).alias("s")).select("s.*")


def eliminated(df: DataFrame, columns: list[str], y: str, keep: int, step: int = 1) -> DataFrame:
    """(column, rank): recursive elimination by |r| with the target, ``step`` columns a round; the ``keep`` that are left rank 1.

    The first column to go has the rank of all columns' number, the next one less, and so on; ties go by name.
    """
    rows = sorted((abs(r["r"]), r["column"]) for r in target_correlation(df, columns, y).collect())
    gone = max(0, len(rows) - keep)
    return df.sparkSession.createDataFrame([(c, len(rows) - i if i < gone else 1) for i, (_, c) in enumerate(rows)], "column string, rank int")


def by_percentile(df: DataFrame, columns: list[str], y: str, percentile: float) -> DataFrame:
    """(column, r) of the columns whose |r| is at least that at rank trunc(percentile / 100 * (n - 1))."""
    table = target_correlation(df, columns, y).withColumn("r", F.abs("r"))
    bound = sorted(r["r"] for r in table.collect())[int(percentile / 100 * (len(columns) - 1))]
    return table.where(F.col("r") >= bound)


def mutual_information(df: DataFrame, columns: list[str], y: str) -> DataFrame:
    """(column, mi) in nats, over clamp(sqrt(n), 2, 20) equal bins of the column and of the target; one pass for all columns."""
    names = [*columns, y]
    row = df.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{c}__{i}") for c in names for i, f in enumerate((F.min, F.max))]).first()
    bins = int(min(20, max(2, math.sqrt(row["n"]))))

    def place(c: str) -> Column:
        low, high = row[f"{c}__0"], row[f"{c}__1"]
        return F.least(F.floor((F.col(c) - low) / (high - low) * bins), F.lit(bins - 1)) if high > low else F.lit(0)

    long = df.select(place(y).alias("y"), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), place(c).alias("x")) for c in columns])).alias("s")).select("s.column", "s.x", "y")
    joint = long.groupBy("column", "x", "y").agg(F.count("*").alias("n"))
    px, py = W.partitionBy("column", "x"), W.partitionBy("column", "y")
    n = row["n"]
    return joint.withColumn("t", F.col("n") / n * F.ln(F.col("n") * n / (F.sum("n").over(px) * F.sum("n").over(py)))).groupBy("column").agg(F.sum("t").alias("mi"))


def redundant(df: DataFrame, columns: list[str], bound: float = 0.9) -> list[str]:
    """Columns to drop: of each pair above the bound, the one with the greater mean |r|, greedily in order."""
    from .profile import correlation

    r = {(x["a"], x["b"]): abs(x["r"]) for x in correlation(df, columns).collect()}
    mean = {c: sum(r[c, o] for o in columns if o != c) / max(1, len(columns) - 1) for c in columns}
    gone: list[str] = []
    for a, b in combinations(columns, 2):
        if r[a, b] > bound and a not in gone and b not in gone:
            gone.append(a if mean[a] > mean[b] else b)
    return gone


def leakage(df: DataFrame, columns: list[str], y: str, bound: float = 0.95) -> DataFrame:
    """Columns that tell the target, or whose names suggest time or identity."""
    table = target_correlation(df, columns, y)
    suspicious = F.lower("column").rlike("date|time|timestamp|_id$|^id$")
    return table.select("column", F.round("r", 6).alias("r"), F.when(F.abs("r") > bound, "critical").when(suspicious, "warning").otherwise("none").alias("leak"))


def pca(df: DataFrame, columns: list[str], k: int):
    """(loadings, shares, projection): the covariance of standardised columns is one aggregate, its eigenvectors the driver's.

    A component's sign is such that its greatest loading is positive.
    """
    import numpy as np

    stats = df.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{c}__{i}") for c in columns for i, f in enumerate((F.avg, F.stddev_pop))], *[F.covar_samp(a, b).alias(f"c{i}") for i, (a, b) in enumerate(combinations_with_replacement(columns, 2))]).first()
    scale = [stats[f"{c}__1"] or 1.0 for c in columns]
    cov = np.zeros((len(columns), len(columns)))
    for i, (a, b) in enumerate(combinations_with_replacement(range(len(columns)), 2)):
        cov[a, b] = cov[b, a] = stats[f"c{i}"] / scale[a] / scale[b]
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:k]
    vectors = vectors[:, order] * np.sign(vectors[np.abs(vectors[:, order]).argmax(0), order])
    z = [(F.col(c) - stats[f"{c}__0"]) / scale[i] for i, c in enumerate(columns)]
    projected = df.select("*", *[sum((z[i] * float(vectors[i, j]) for i in range(len(columns))), F.lit(0.0)).alias(f"pc{j + 1}") for j in range(len(order))])
    return vectors, values[order] / values.sum(), projected

"""Anomaly scores over columns and over neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import near, order_stats


def zscore(df: DataFrame, columns: list[str], bound: float = 3.0) -> DataFrame:
    """score: the greatest |z| over columns, with population deviations of at least 1e-10; label -1 beyond the bound."""
    row = df.agg(*[f(c).alias(f"{c}__{i}") for c in columns for i, f in enumerate((F.avg, F.stddev_pop))]).first()
    parts = [F.abs((F.col(c) - row[f"{c}__0"]) / max(row[f"{c}__1"], 1e-10)) for c in columns]
    score = F.greatest(*parts) if len(parts) > 1 else parts[0]
    return df.withColumn("score", score).withColumn("label", F.when(F.col("score") > bound, -1).otherwise(1))


def iqr_votes(df: DataFrame, columns: list[str], k: float = 1.5, least: int = 1) -> DataFrame:
    """score: how many columns lie beyond nearest-rank fences; label -1 from ``least`` of them."""
    parts = []
    for c, (_, a, b) in order_stats.summaries(df, columns).items():
        parts.append(((F.col(c) < a - k * (b - a)) | (F.col(c) > b + k * (b - a))).cast("int"))
    return df.withColumn("score", sum(parts, F.lit(0))).withColumn("label", F.when(F.col("score") >= least, -1).otherwise(1))


def mahalanobis(df: DataFrame, columns: list[str], share: float = 0.05) -> DataFrame:
    """score: the Mahalanobis distance with the sample covariance plus 1e-6; label -1 at or beyond the rank trunc(share * n)."""
    import numpy as np

    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.covar_samp(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)], F.count(F.lit(1)).alias("n")).first()
    cov = np.eye(len(columns)) * 1e-6
    for i, (a, b) in enumerate(pairs):
        x, y = columns.index(a), columns.index(b)
        cov[x, y] += row[f"c{i}"]
        if x != y:
            cov[y, x] += row[f"c{i}"]
    inverse = np.linalg.inv(cov)
    gap = [F.col(c) - row[f"m{i}"] for i, c in enumerate(columns)]
    total = sum((gap[i] * gap[j] * float(inverse[i, j]) for i in range(len(columns)) for j in range(len(columns))), F.lit(0.0))
    out = df.withColumn("score", F.sqrt(F.greatest(total, F.lit(0.0))))
    n, rank = row["n"], int(share * row["n"])
    bound = order_stats.at_ranks(out, "score", [n - 1 - rank])[n - 1 - rank]
    return out.withColumn("label", F.when(F.col("score") >= bound - 1e-12, -1).otherwise(1))


def ood(train: DataFrame, df: DataFrame, columns: list[str], share: float = 0.95) -> DataFrame:
    """score: the norm of z over columns; out beyond the value at rank ceil(share * n) - 1 of the training scores."""
    import math

    row = train.agg(*[f(c).alias(f"{c}__{i}") for c in columns for i, f in enumerate((F.avg, F.stddev_pop))]).first()
    total = sum((F.pow((F.col(c) - row[f"{c}__0"]) / max(row[f"{c}__1"], 1e-10), F.lit(2)) for c in columns), F.lit(0.0))
    scored = train.withColumn("score", F.sqrt(total))
    n = order_stats.count(scored, "score")
    rank = min(n - 1, max(0, math.ceil(share * n) - 1))
    bound = order_stats.at_ranks(scored, "score", [rank])[rank]
    return df.withColumn("score", F.sqrt(total)).withColumn("out", F.col("score") > bound)


def neighbours(df: DataFrame, key: str, vector: str, k: int, other: DataFrame | None = None, metric: str = "euclidean", keep_self: bool = False) -> DataFrame:
    """(key, near, dist, rank) of the k nearest rows of ``other``, or of ``df`` itself, by (dist, key)."""
    found = near.pairs(df, df if other is None else other, key, vector, k=k, metric=metric, itself=keep_self)
    return found.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy("dist", "near")))


def lof(df: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(key, lof): local outlier factors over the k nearest others."""
    near = neighbours(df, key, vector, k)
    reach = near.groupBy(F.col(key).alias("near")).agg(F.max("dist").alias("radius"))
    density = near.join(reach, "near").groupBy(key).agg(F.try_divide(F.count("*"), F.sum(F.greatest("dist", "radius"))).alias("density"))
    other = density.select(F.col(key).alias("near"), F.col("density").alias("theirs"))
    return near.join(other, "near").join(density, key).groupBy(key).agg((F.avg("theirs") / F.max("density")).alias("lof"))


def isolation_forest(df: DataFrame, key: str, columns: list[str], trees: int = 100, sample: int = 256, seed: int = 5) -> DataFrame:
    """(key, score) by isolation trees that the driver grows, each on min(sample, rows) rows drawn with replacement; rows
    are scored by the trees' arrays, which are broadcast. A null counts as larger than every cut and isn't grown on."""
    import math

    import numpy as np

    rng = np.random.default_rng(seed)
    n = df.count()
    rows = df.select(*columns).na.drop().sample(min(1.0, 2 * trees * sample / max(n, 1)), seed=seed).limit(2 * trees * sample).toPandas().to_numpy(float)
    if not len(rows):
        return df.select(key, F.lit(0.5).alias("score"))
    c = lambda m: 0.0 if m < 2 else 2 * (math.log(m - 1) + 0.5772156649) - 2 * (m - 1) / m
    size = min(sample, len(rows))
    limit = math.ceil(math.log2(size))
    # Of each node: the column (-1 for a leaf), the cut, the nodes below and on or above it, and a leaf's depth.
    nodes: list[list[float]] = []

    def grow(x: np.ndarray, depth: int) -> int:
        j, at = int(rng.integers(len(columns))), len(nodes)
        low, high = x[:, j].min(initial=np.inf), x[:, j].max(initial=-np.inf)
        nodes.append([-1, 0.0, at, at, depth + c(len(x))])
        if depth < limit and len(x) > 1 and low < high:
            cut = float(rng.uniform(low, high))
            nodes[at] = [j, cut, grow(x[x[:, j] < cut], depth + 1), grow(x[x[:, j] >= cut], depth + 1), 0.0]
        return at

    roots = [grow(rows[rng.integers(len(rows), size=size)], 0) for _ in range(trees)]
    shared = df.sparkSession.sparkContext.broadcast((np.array(nodes), roots))
    norm = max(c(size), 1e-9)

    def score(batches):
        table, roots = shared.value
        column, cut, below, above = table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3].astype(int)
        for pdf in batches:
            x, total = pdf[columns].to_numpy(float), np.zeros(len(pdf))
            for root in roots:
                at = np.full(len(x), root)
                for _ in range(limit):
                    at = np.where(x[np.arange(len(x)), column[at]] < cut[at], below[at], above[at])
                total += table[at, 4]
            yield pdf[[key]].assign(score=2.0 ** (-total / len(roots) / norm))

    return df.select(*dict.fromkeys([key, *columns])).mapInPandas(score, f"`{key}` {df.schema[key].dataType.simpleString()}, score double")

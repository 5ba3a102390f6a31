"""Metrics, calibration, votes, explanations, fairness and other reports over predictions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import order_stats


def classification(df: DataFrame, y: str, p: str) -> DataFrame:
    """Accuracy (|y - p| < .5) and precision, recall and F1 with both cut at .5."""
    t, q = F.col(y) > 0.5, F.col(p) > 0.5
    row = df.agg(F.avg((F.abs(F.col(y) - F.col(p)) < 0.5).cast("double")).alias("accuracy"), F.count_if(t & q).alias("tp"), F.count_if(~t & q).alias("fp"), F.count_if(t & ~q).alias("fn"))
    precision = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0))
    recall = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0))
    row = row.select("accuracy", precision.alias("precision"), recall.alias("recall"))
    return row.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def regression(df: DataFrame, y: str, p: str) -> DataFrame:
    e = F.col(y) - F.col(p)
    row = df.agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), (F.var_pop(y)).alias("__v"))
    return row.select("mse", F.sqrt("mse").alias("rmse"), "mae", F.coalesce(1 - F.try_divide(F.col("mse"), F.col("__v")), F.lit(0.0)).alias("r2"))


def reliability(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """(bin, n, confidence, accuracy) over equal bins of the predicted probability."""
    place = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("confidence"), F.avg(F.col(y).cast("double")).alias("accuracy"))


def calibration_error(table: DataFrame) -> DataFrame:
    """ece and mce of what ``reliability`` or ``adaptive`` gives."""
    gap = F.abs(F.col("confidence") - F.col("accuracy"))
    return table.agg((F.sum(gap * F.col("n")) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"))


def adaptive(df: DataFrame, y: str, p: str, key: str, bins: int = 10) -> DataFrame:
    """As ``reliability`` over chunks of ceil(n / bins) rows in order of (p, key); ranks are summed over ranges of p."""
    n = df.count()
    size = -(-n // bins)
    part = F.least(F.floor(F.col(p) * 64), F.lit(63))
    rows = df.withColumn("__part", part)
    counts = rows.groupBy("__part").agg(F.count("*").alias("__n"))
    before = counts.select("__part", F.coalesce(F.sum("__n").over(W.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    ranked = rows.join(F.broadcast(before), "__part").withColumn("__i", F.col("__b") + F.row_number().over(W.partitionBy("__part").orderBy(p, key)) - 1)
    return ranked.groupBy(F.floor(F.col("__i") / size).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("confidence"), F.avg(F.col(y).cast("double")).alias("accuracy"))


def brier(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.agg(F.avg(F.pow(F.col(p) - F.col(y), F.lit(2))).alias("brier"))


def isotonic(df: DataFrame, y: str, p: str) -> DataFrame:
    """(p, n, fitted): the exact isotonic regression. Values of p are counted first; pools are merged where they fall, on
    at most 100 000 distinct values (round p beforehand for more)."""
    counts = df.groupBy(p).agg(F.count("*").alias("n"), F.avg(F.col(y).cast("double")).alias("m")).orderBy(p).limit(100_001).toPandas()
    if len(counts) > 100_000:
        raise ValueError("more than 100000 distinct scores")
    pools: list[list[float]] = []
    for n, m in zip(counts["n"], counts["m"], strict=True):
        pools.append([n, m, 1])
        while len(pools) > 1 and pools[-2][1] > pools[-1][1]:
            n2, m2, k2 = pools.pop()
            n1, m1, k1 = pools.pop()
            pools.append([n1 + n2, (n1 * m1 + n2 * m2) / (n1 + n2), k1 + k2])
    counts["fitted"] = [m for _, m, k in pools for _ in range(k)]
    return df.sparkSession.createDataFrame(counts[[p, "n", "fitted"]], f"{p} double, n long, fitted double")


def platt(df: DataFrame, y: str, p: str, rounds: int = 50) -> tuple[float, float]:
    """(a, b) of sigmoid(a * logit(p) + b) by Newton steps on smoothed targets; one aggregate a step."""
    x = F.ln(F.greatest(F.col(p), F.lit(1e-12)) / F.greatest(1 - F.col(p), F.lit(1e-12)))
    pos, n = df.agg(F.sum(F.col(y).cast("long")), F.count("*")).first()
    hi, lo = (pos + 1) / (pos + 2), 1 / (n - pos + 2)
    rows = df.select(x.alias("x"), F.when(F.col(y) > 0.5, hi).otherwise(lo).alias("t"))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        q = 1 / (1 + F.exp(-(a * F.col("x") + b)))
        w, e = q * (1 - q), q - F.col("t")
        g1, g2, h11, h12, h22 = rows.agg(F.sum(e * F.col("x")), F.sum(e), F.sum(w * F.col("x") * F.col("x")) + 1e-9, F.sum(w * F.col("x")), F.sum(w) + 1e-9).first()
        det = h11 * h22 - h12 * h12
        if abs(det) < 1e-18:
            break
        da, db = (h22 * g1 - h12 * g2) / det, (h11 * g2 - h12 * g1) / det
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-8:
            break
    return a, b


def temperature(df: DataFrame, y: str, p: str, grid: int = 60) -> float:
    """The temperature of a grid from .25 to 4 with the least log loss; one aggregate."""
    x = F.ln(F.greatest(F.col(p), F.lit(1e-12)) / F.greatest(1 - F.col(p), F.lit(1e-12)))
    ts = [0.25 * 16 ** (i / (grid - 1)) for i in range(grid)]
    loss = lambda t: F.avg(-F.when(F.col(y) > 0.5, F.ln(1 / (1 + F.exp(-x / t)) + 1e-15)).otherwise(F.ln(1 - 1 / (1 + F.exp(-x / t)) + 1e-15)))
    row = df.agg(*[loss(t).alias(f"l{i}") for i, t in enumerate(ts)]).first()
    return min((row[i], t) for i, t in enumerate(ts))[1]


def conformal(df: DataFrame, y: str, p: str, level: float = 0.9) -> float:
    """The half width of prediction intervals: the value at rank clamp(ceil(level * (n + 1))) - 1 of |y - p|."""
    rows = df.select(F.abs(F.col(y) - F.col(p)).alias("e"))
    place = lambda n: max(1, min(n, math.ceil(level * (n + 1)))) - 1
    n, found = order_stats.ranked(rows, {"e": lambda n: [place(n)]})["e"]
    return found[place(n)]


def entropy_confidence(p: Column) -> Column:
    """1 - H / ln n of an array of probabilities."""
    h = F.aggregate(p, F.lit(0.0), lambda s, x: s - F.when(x > 0, x * F.ln(F.when(x > 0, x))).otherwise(0.0))
    return F.when(F.size(p) > 1, 1 - h / F.ln(F.size(p))).otherwise(1.0)


def hard_vote(preds: DataFrame, key: str, weight: Column | None = None) -> DataFrame:
    """(key, label) of the greatest weight over rows (key, model, label); ties by the smallest label."""
    votes = preds.groupBy(key, "label").agg(F.sum(F.lit(1.0) if weight is None else weight).alias("w"))
    return votes.groupBy(key).agg(F.min(F.struct((-F.col("w")).alias("w"), "label"))["label"].alias("label"))


def combine(preds: DataFrame, key: str, value: str, how: str, weight: str | None = None, trim: float = 0.1) -> DataFrame:
    """mean (weighted if given), median or trimmed mean of each key's predictions."""
    v = F.array_sort(F.collect_list(value))
    out = {
        "mean": lambda: F.sum(F.col(value) * F.col(weight)) / F.sum(weight) if weight else F.avg(value), "median": lambda: F.percentile(value, 0.5),
        "trimmed": lambda: F.aggregate(F.slice(v, F.floor(F.size(v) * trim).cast("int") + 1, F.size(v) - 2 * F.floor(F.size(v) * trim).cast("int")), F.lit(0.0), lambda s, x: s + x) / (F.size(v) - 2 * F.floor(F.size(v) * trim)),
    }[how]()
    return preds.groupBy(key).agg(out.alias(value))


def partial_dependence(df: DataFrame, column: str, score, points: int = 10, low: float = 5, high: float = 95) -> DataFrame:
    """(grid, mean): ``score`` (a function of a column's replacement) averaged over rows, at points between two percentiles."""
    place = lambda n: [int(p / 100 * (n - 1)) for p in (low, high)]
    n, found = order_stats.ranked(df, {column: place})[column]
    a, b = (found[k] for k in place(n))
    grid = [a + (b - a) * i / (points - 1) for i in range(points)]
    row = df.agg(*[F.avg(score(F.lit(g))).alias(f"g{i}") for i, g in enumerate(grid)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(g).alias("grid"), F.col(f"g{i}").alias("mean")) for i, g in enumerate(grid)])).alias("s")).select("s.*")


def grid_of(df: DataFrame, column: str, points: int, low: float = 5, high: float = 95) -> list[float]:
    """Evenly spaced points between the values at two percentiles' ranks."""
    place = lambda n: [int(p / 100 * (n - 1)) for p in (low, high)]
    n, found = order_stats.ranked(df, {column: place})[column]
    a, b = (found[k] for k in place(n))
    return [a + (b - a) * i / (points - 1) for i in range(points)]


def partial_dependence_2d(df: DataFrame, one: str, other: str, score, points: int = 5) -> tuple[DataFrame, float]:
    """((x, y, mean) over the grid of two columns, the share of its variance that isn't the sum of both columns' own).

    ``score`` is a function of replacements for both; one scan gives all means.
    """
    xs, ys = grid_of(df, one, points), grid_of(df, other, points)
    cells = [(i, j) for i in range(points) for j in range(points)]
    alone = [F.avg(score(F.lit(x), F.col(other))).alias(f"x{i}") for i, x in enumerate(xs)] + [F.avg(score(F.col(one), F.lit(y))).alias(f"y{j}") for j, y in enumerate(ys)]
    row = df.agg(*[F.avg(score(F.lit(xs[i]), F.lit(ys[j]))).alias(f"m{i}_{j}") for i, j in cells], *alone).first()
    mean = sum(row[f"m{i}_{j}"] for i, j in cells) / len(cells)
    rest = sum((row[f"m{i}_{j}"] - (row[f"x{i}"] + row[f"y{j}"] - mean)) ** 2 for i, j in cells)
    total = sum((row[f"m{i}_{j}"] - mean) ** 2 for i, j in cells)
    return df.sparkSession.createDataFrame([(xs[i], ys[j], row[f"m{i}_{j}"]) for i, j in cells], "x double, y double, mean double"), rest / total if total > 0 else 0.0


def centered_ice(df: DataFrame, key: list[str], column: str, score, points: int = 4) -> DataFrame:
    """(key, i, change): each row's score at the grid's points, less that at the first."""
    grid = grid_of(df, column, points)
    first = score(F.lit(grid[0]))
    return df.select(*key, F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("i"), (score(F.lit(g)) - first).alias("change")) for i, g in enumerate(grid)])).alias("s")).select(*key, "s.i", "s.change")


def beta_calibration(df: DataFrame, y: str, p: str, rounds: int = 25) -> tuple[float, float, float]:
    """(a, b, c) of sigmoid(c + a ln p - b ln(1 - p)) by Newton steps, one aggregate each."""
    import numpy as np

    q = F.least(F.greatest(F.col(p), F.lit(1e-10)), F.lit(1 - 1e-10))
    rows = df.select(F.ln(q).alias("u"), (-F.ln(1 - q)).alias("v"), F.lit(1.0).alias("w"), F.col(y).cast("double").alias("y"))
    names, theta = ("u", "v", "w"), np.array([1.0, 1.0, 0.0])
    for _ in range(rounds):
        s = 1 / (1 + F.exp(-sum((F.col(n) * float(t) for n, t in zip(names, theta, strict=True)), F.lit(0.0))))
        row = rows.agg(*[F.sum((s - F.col("y")) * F.col(n)).alias(f"g{n}") for n in names], *[F.sum(s * (1 - s) * F.col(m) * F.col(n)).alias(f"h{m}{n}") for m in names for n in names]).first()
        move = np.linalg.solve(np.array([[row[f"h{m}{n}"] for n in names] for m in names]) + 1e-9 * np.eye(3), np.array([row[f"g{n}"] for n in names]))
        theta = theta - move
        if np.abs(move).sum() < 1e-8:
            break
    return tuple(theta.tolist())


def linear_shap(df: DataFrame, weights: dict[str, float]) -> dict[str, Column]:
    """Exact Shapley values of a linear score: weight times the distance from the mean."""
    row = df.agg(*[F.avg(c).alias(c) for c in weights]).first()
    return {c: (F.col(c) - row[c]) * w for c, w in weights.items()}


def permutation_importance(df: DataFrame, columns: list[str], y: str, key: str, score) -> DataFrame:
    """(column, importance): the rise of the mean squared error when a column's values move to other rows.

    The row at a place in the order of the key gets the value of the row at that place in the order of draws; both
    orders are numbered in ranges, so that no task sorts all rows.
    """
    from ..functions.ranks import numbered

    base = df.agg(F.avg(F.pow(F.col(y) - score(*[F.col(c) for c in columns]), F.lit(2)))).first()[0]
    rows, out = numbered(df, [key]).drop("__n"), None
    for c in columns:
        order = F.sha2(F.concat_ws(":", F.lit(c), key), 256)
        other = numbered(df.select(key, F.col(c).alias("__v")), [order, key]).select("__i", "__v")
        moved = rows.join(other, "__i").withColumn(c, F.col("__v"))
        one = moved.agg(F.lit(c).alias("column"), (F.avg(F.pow(F.col(y) - score(*[F.col(x) for x in columns]), F.lit(2))) - base).alias("importance"))
        out = one if out is None else out.unionByName(one)
    return out


def fairness(df: DataFrame, group: str, y: str, p: str) -> DataFrame:
    """Per group: n, selection rate, true and false positive rates, precision and base rate."""
    t, q = F.col(y) == 1, F.col(p) == 1
    rate = lambda a, b: F.coalesce(F.try_divide(F.count_if(a), F.count_if(b)), F.lit(0.0))
    every = F.lit(True)
    return df.groupBy(F.col(group).alias("group")).agg(F.count("*").alias("n"), rate(q, every).alias("selection"), rate(t & q, t).alias("tpr"), rate(~t & q, ~t).alias("fpr"), rate(t & q, q).alias("ppv"), rate(t, every).alias("base"))


def fairness_pairs(groups: DataFrame) -> DataFrame:
    """Each pair of groups: disparate impact, parity gaps and whether all are within .8 and .1."""
    a, b = groups.alias("a"), groups.alias("b")
    pairs = a.join(F.broadcast(b), F.col("a.group") < F.col("b.group"))
    gap = lambda c: F.abs(F.col(f"a.{c}") - F.col(f"b.{c}"))
    impact = F.coalesce(F.try_divide(F.least("a.selection", "b.selection"), F.greatest("a.selection", "b.selection")), F.lit(1.0))
    out = pairs.select(F.col("a.group").alias("one"), F.col("b.group").alias("other"), impact.alias("impact"), gap("selection").alias("parity"), F.greatest(gap("tpr"), gap("fpr")).alias("odds"), gap("ppv").alias("predictive"))
    return out.withColumn("fair", (F.col("impact") >= 0.8) & (F.col("parity") <= 0.1) & (F.col("odds") <= 0.1) & (F.col("predictive") <= 0.1))


def bias(df: DataFrame, group: str, y: str) -> DataFrame:
    """Per group: share, positive rate, under-representation (under 5 % and 30 rows) and label skew (over .15 from the whole)."""
    total = df.agg(F.count("*").alias("all"), F.avg(F.col(y).cast("double")).alias("rate"))
    groups = df.groupBy(F.col(group).alias("group")).agg(F.count("*").alias("n"), F.avg(F.col(y).cast("double")).alias("positive"))
    return groups.crossJoin(F.broadcast(total)).select("group", "n", (F.col("n") / F.col("all")).alias("share"), "positive", ((F.col("n") / F.col("all") < 0.05) & (F.col("n") < 30)).alias("under"), (F.abs(F.col("positive") - F.col("rate")) > 0.15).alias("skewed"))


def pareto(df: DataFrame, key: str, low: list[str]) -> DataFrame:
    """The rows that no other beats: none is at most equal in all of ``low`` (all minimised) and less in one.

    A task keeps the rows that none of its own beats; what these tasks keep is reduced the same way until one task
    has all of them. Rows with a null in ``low`` are beaten by none and beat none.
    """
    names = df.columns

    def skyline(batches):
        import numpy as np
        import pyarrow as pa

        held = None
        for b in batches:
            held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            values = np.array([held[c].cast(pa.float64()).to_numpy() for c in low]).T
            order = np.lexsort(values.T[::-1])
            keep: list[int] = []
            for i in order:  # in this order a row is only beaten by one before it
                x = values[i]
                front = values[keep] if keep else np.zeros((0, len(low)))
                if not ((front <= x).all(1) & (front < x).any(1)).any():
                    keep.append(i)
            held = held.take(sorted(keep))
        if held is not None:
            yield from held.to_batches()

    whole = df.where(" and ".join(f"`{c}` is not null" for c in low))
    parts = whole.rdd.getNumPartitions()
    front = whole.mapInArrow(skyline, df.schema)
    while parts > 1:
        parts = -(-parts // 8)
        front = front.repartition(parts).mapInArrow(skyline, df.schema)
    return front.unionByName(df.where(" or ".join(f"`{c}` is null" for c in low))).select(*names)

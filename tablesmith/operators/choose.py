"""Choices that depend on a table's shape or on scores: algorithms, folds, models, calibration and parameters."""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lineage, order_stats
from . import evaluate, learn, sampling

# What is left out for small, large and wide tables.
SLOW = ["GradientBoosting", "XGBoost", "LightGBM", "CatBoost", "SGDClassifier", "SGDRegressor"]
EXPENSIVE = ["KNN", "SVM"]
NONLINEAR = ["RandomForest", "ExtraTrees", "GradientBoosting", "XGBoost", "LightGBM", "CatBoost", "KNN", "SVM"]


def excluded(rows: Column, columns: Column, small: int = 1000, large: int = 100_000, wide: float = 1.0) -> Column:
    """The algorithms to leave out, for columns that hold numbers of rows and of features."""
    none = F.array().cast("array<string>")
    pick = lambda rule, names: F.when(rule, F.array(*map(F.lit, names))).otherwise(none)
    return F.array_distinct(F.concat(pick(rows < small, SLOW), pick(rows > large, EXPENSIVE), pick((columns > 0) & (rows > 0) & (columns / rows > wide), NONLINEAR)))


def folds(rows: Column, grouped: Column, repeated_below: int = 5000) -> Column:
    """group_k_fold where there's a group column, repeated 3 x 5 folds for few rows, else stratified 5 folds."""
    return F.when(grouped, "group_k_fold").when(rows < repeated_below, "repeated_3x5").otherwise("stratified_5")


def best(scores: DataFrame, k: int, name: str = "model") -> DataFrame:
    """(model, mean, std) of the k models with the greatest mean score, ties by name."""
    table = scores.groupBy(name).agg(F.avg("score").alias("mean"), F.coalesce(F.stddev_pop("score"), F.lit(0.0)).alias("std"))
    return table.orderBy(F.desc("mean"), name).limit(k)


def calibration(df: DataFrame, y: str, p: str, least: float = 0.005, bins: int = 10) -> tuple[str | None, dict[str, float]]:
    """(platt, isotonic or None, errors of raw, platt and isotonic): the calibration with the least expected error, if it gains ``least``."""
    a, b = evaluate.platt(df, y, p)
    logit = F.ln(F.greatest(F.col(p), F.lit(1e-12)) / F.greatest(1 - F.col(p), F.lit(1e-12)))
    fitted = evaluate.isotonic(df, y, p).select(F.col(p).alias("__p"), "fitted")
    both = df.select(F.col(y).alias("y"), F.col(p).alias("raw"), (1 / (1 + F.exp(-(a * logit + b)))).alias("platt")).join(fitted, F.col("raw") == F.col("__p")).withColumnRenamed("fitted", "isotonic")
    place = lambda c: F.least(F.floor(F.col(c) * bins), F.lit(bins - 1))
    long = both.select("y", F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("p"), place(c).alias("bin")) for c in ("raw", "platt", "isotonic")])).alias("s")).select("y", "s.*")
    cells = long.groupBy("kind", "bin").agg(F.count("*").alias("n"), F.abs(F.avg("p") - F.avg(F.col("y").cast("double"))).alias("gap"))
    errors = {r["kind"]: r["e"] for r in cells.groupBy("kind").agg((F.sum(F.col("gap") * F.col("n")) / F.sum("n")).alias("e")).collect()}
    chosen = "platt" if errors["platt"] <= errors["isotonic"] else "isotonic"
    return (chosen if errors[chosen] < errors["raw"] - least else None), errors


def grid(spark, space: dict[str, list]) -> DataFrame:
    """(trial, parameters...): all combinations of the values of ``space``, in order."""
    rows = [(i, *values) for i, values in enumerate(product(*space.values()))]
    return spark.createDataFrame(rows, ["trial", *space])


def drawn(spark, space: dict[str, tuple[float, float, str]], trials: int, seed: int = 0) -> DataFrame:
    """(trial, parameters...): values between two bounds by hashes of the trial; kinds are uniform, log and int."""
    rows = spark.range(trials).withColumnRenamed("id", "trial")
    for name, (low, high, kind) in space.items():
        u = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), F.lit(name), "trial"), 256), 1, 8), 16, 10).cast("double") / float(1 << 32)
        rows = rows.withColumn(name, {"uniform": low + u * (high - low), "log": F.exp(math.log(max(low, 1e-300)) + u * math.log(high / max(low, 1e-300))), "int": F.floor(low + u * (high - low + 1)).cast("long")}[kind])
    return rows


def halving(scores: DataFrame, budgets: list[int], keep: int = 3) -> DataFrame:
    """(trial, budget, place, kept): at each budget the best 1 / ``keep`` of the trials that were kept before go on, ties by trial.

    ``scores`` has (trial, budget, score), greater is better; trials are few.
    """
    from pyspark.sql import Window as W

    alive, out = scores.select("trial").distinct(), None
    for budget in budgets:
        here = scores.where(F.col("budget") == budget).join(alive, "trial", "left_semi")
        ranked = here.withColumn("place", F.row_number().over(W.partitionBy("budget").orderBy(F.desc("score"), "trial"))).withColumn("n", F.count("*").over(W.partitionBy("budget")))
        ranked = ranked.select("trial", "budget", "place", (F.col("place") <= F.greatest(F.lit(1), F.floor(F.col("n") / keep))).alias("kept"))
        alive = ranked.where("kept").select("trial")
        out = ranked if out is None else out.unionByName(ranked)
    return out


def pruned(scores: DataFrame, share: float) -> DataFrame:
    """(trial, step, prune): whether a trial's score is above that at rank trunc(share * n) of the n scores of its step.

    ``scores`` has (trial, step, score), less is better; steps are few. NaN is the greatest score and nulls
    come after it; prune is null where the score or the bound is. Scores without a step are left out.
    """
    kept = lineage.cut(scores.where(F.col("step").isNotNull()))
    sizes = {r["step"]: (r["n"], r["odd"]) for r in kept.groupBy("step").agg(F.count("*").alias("n"), F.count(F.when(F.isnan("score"), 1)).alias("odd")).collect()}
    ranks = {k: min(int(share * n), n - 1) for k, (n, _) in sizes.items()}
    columns = {f"score_{i}": k for i, k in enumerate(ranks)}
    wide = kept.select(*[F.when(F.col("step") == k, F.col("score")).alias(c) for c, k in columns.items()])
    found = order_stats.ranked(wide, {c: lambda n, k=k: [ranks[k]] for c, k in columns.items()}) if columns else {}
    bound = F.lit(None).cast("double")
    for c, k in columns.items():
        n, values = found[c]
        at = values.get(ranks[k], float("nan") if ranks[k] < n + sizes[k][1] else None)
        bound = F.when(F.col("step") == k, F.lit(at).cast("double")).otherwise(bound)
    return kept.select("trial", "step", (F.col("score") > bound).alias("prune"))


def parzen(history: list[tuple[float, float]], low: float, high: float, candidates: int = 24, share: float = 0.25, seed: int = 0) -> float:
    """The next value to try: of candidates near good ones (the best ``share`` by least loss) that with the greatest ratio of
    the densities of good and of other values, by Gaussian kernels."""
    import random

    rng = random.Random(seed * 1_000_003 + len(history))
    if len(history) < 4:
        return rng.uniform(low, high)
    ordered = sorted(history, key=lambda h: h[1])
    cut = max(1, int(len(ordered) * share))
    good, bad = [h[0] for h in ordered[:cut]], [h[0] for h in ordered[cut:]]
    width = (high - low) / max(2.0, math.sqrt(len(history)))
    density = lambda x, of: sum(math.exp(-0.5 * ((x - v) / width) ** 2) for v in of) / len(of) + 1e-12
    drawn_ = [min(high, max(low, rng.gauss(rng.choice(good), width))) for _ in range(candidates)]
    return max(drawn_, key=lambda x: density(x, good) / density(x, bad))


def stacked(df: DataFrame, key: str, models: dict[str, list[str]], y: str, k: int = 5, alpha: float = 1e-6) -> tuple[DataFrame, dict[str, float], float]:
    """(rows with each model's out-of-fold prediction and ``stacked``, weights, intercept).

    Models are ridge regressions on their own columns, a closed form each; a row's prediction comes from the folds that
    don't hold it, and the final regression is on these predictions.
    """
    rows = sampling.stratified(df.withColumn("__all", F.lit(0)), "__all", k, key).drop("__all")
    for name, columns in models.items():
        parts = F.lit(None).cast("double")
        for fold in range(k):
            w, b = learn.linear(rows.where(F.col("fold") != fold), columns, y, alpha)
            parts = F.when(F.col("fold") == fold, sum((F.col(c) * v for c, v in w.items()), F.lit(b))).otherwise(parts)
        rows = rows.withColumn(name, parts)
    weights, intercept = learn.linear(rows, list(models), y, alpha)
    return rows.withColumn("stacked", sum((F.col(c) * v for c, v in weights.items()), F.lit(intercept))), weights, intercept


def blended(df: DataFrame, order: str, models: dict[str, list[str]], y: str, share: float = 0.2, alpha: float = 1e-6) -> tuple[DataFrame, dict[str, float]]:
    """(held rows with each model's prediction and ``blended``, weights): models learn from the first rows, weights from the held last ``share``.

    A model's weight is the inverse of its mean squared error there, and weights sum to 1.
    """
    rows = sampling.tail_split(df, order, share)
    held = rows.where("held")
    for name, columns in models.items():
        w, b = learn.linear(rows.where("not held"), columns, y, alpha)
        held = held.withColumn(name, sum((F.col(c) * v for c, v in w.items()), F.lit(b)))
    errors = held.agg(*[F.avg(F.pow(F.col(m) - F.col(y), F.lit(2))).alias(m) for m in models]).first()
    inverse = {m: 1 / max(errors[m], 1e-12) for m in models}
    weights = {m: v / sum(inverse.values()) for m, v in inverse.items()}
    return held.withColumn("blended", sum((F.col(m) * v for m, v in weights.items()), F.lit(0.0))), weights

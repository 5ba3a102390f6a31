"""Models: closed forms as aggregates, neighbours and clusters as joins, and MLlib for the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lineage
from ..functions.near import pairs
from .anomaly import neighbours
from .transforms import distance


def linear(df: DataFrame, columns: list[str], y: str, alpha: float = 0.0) -> tuple[dict[str, float], float]:
    """(weights, intercept) of least squares with an L2 penalty on the weights alone: one aggregate, solved on the driver."""
    import numpy as np

    names = [*columns, y]
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(names)], *[F.covar_pop(a, b).alias(f"c{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(names) if j >= i]).first()
    k, n = len(columns), row["n"]
    xx = np.array([[row[f"c{min(i, j)}_{max(i, j)}"] * n for j in range(k)] for i in range(k)]) + alpha * np.eye(k)
    w = np.linalg.solve(xx, np.array([row[f"c{i}_{k}"] * n for i in range(k)]))
    return dict(zip(columns, w.tolist(), strict=True)), float(row[f"m{k}"] - sum(w[i] * row[f"m{i}"] for i in range(k)))


def gaussian_bayes(df: DataFrame, columns: list[str], y: str, smoothing: float = 1e-9) -> DataFrame:
    """(class, prior, <column>_mean, <column>_var): a table to join with what is classified."""
    n = df.count()
    return df.groupBy(F.col(y).alias("class")).agg((F.count("*") / n).alias("prior"), *[e for c in columns for e in (F.avg(c).alias(f"{c}_mean"), (F.var_pop(c) + smoothing).alias(f"{c}_var"))])


def gaussian_predict(df: DataFrame, key: str, columns: list[str], table: DataFrame) -> DataFrame:
    """(key, class, probability) of the likeliest class, ties by the smallest; classes are few and broadcast."""
    terms = [-0.5 * F.ln(2 * 3.141592653589793 * F.col(f"{c}_var")) - F.pow(F.col(c) - F.col(f"{c}_mean"), F.lit(2)) / (2 * F.col(f"{c}_var")) for c in columns]
    scored = df.select(key, *columns).crossJoin(F.broadcast(table)).select(key, "class", (F.ln("prior") + sum(terms, F.lit(0.0))).alias("ll"))
    top = scored.groupBy(key).agg(F.max("ll").alias("top"), F.min(F.struct((-F.col("ll")).alias("l"), "class"))["class"].alias("class"), F.collect_list("ll").alias("all"))
    return top.select(key, "class", (1 / F.aggregate("all", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top")))).alias("probability"))


def multinomial_bayes(counts: DataFrame, labels: DataFrame, key: str, y: str, alpha: float = 1.0) -> DataFrame:
    """(class, term, logp) of term counts (key, term, tf) and labels (key, y), with additive smoothing over all terms."""
    known = counts.select("term").distinct().count()
    joined = counts.join(labels, key).groupBy(F.col(y).alias("class"), "term").agg(F.sum("tf").alias("n"))
    totals = joined.groupBy("class").agg(F.sum("n").alias("all"))
    return joined.join(F.broadcast(totals), "class").select("class", "term", F.ln((F.col("n") + alpha) / (F.col("all") + alpha * known)).alias("logp"))


def knn(df: DataFrame, key: str, vector: str, y: str, train: DataFrame, k: int = 5, metric: str = "euclidean", weighted: bool = False) -> DataFrame:
    """(key, label, mean): the vote of the k nearest training rows, ties by the smallest label, and their mean label."""
    near = neighbours(df, key, vector, k, train, metric=metric)
    joined = near.join(train.select(F.col(key).alias("near"), F.col(y).alias("label")), "near")
    weight = 1 / (F.col("dist") + 1e-10) if weighted else F.lit(1.0)
    votes = joined.groupBy(key, "label").agg(F.sum(weight).alias("w"))
    return votes.groupBy(key).agg(F.min(F.struct((-F.col("w")).alias("w"), "label"))["label"].alias("label"), (F.sum(F.col("label") * F.col("w")) / F.sum("w")).alias("mean"))


def assign(df: DataFrame, key: str, vector: str, centers: DataFrame) -> DataFrame:
    """(key, cluster, dist) of the nearest of ``centers`` (cluster, center), ties by the smallest cluster."""
    each = df.select(key, vector).crossJoin(F.broadcast(centers)).select(key, "cluster", distance(F.col(vector), F.col("center")).alias("dist"))
    return each.groupBy(key).agg(F.min(F.struct("dist", "cluster")).alias("s")).select(key, "s.cluster", "s.dist")


def k_means(df: DataFrame, key: str, vector: str, k: int, rounds: int = 20, tolerance: float = 1e-4) -> DataFrame:
    """(cluster, center): Lloyd's iterations from rows drawn by hash; each round is one aggregate, centers are broadcast."""
    spark = df.sparkSession
    centers = [(i, r[vector]) for i, r in enumerate(df.orderBy(F.xxhash64(F.lit("start"), key), key).limit(k).collect())]
    size = len(centers[0][1]) if centers else 0
    for _ in range(rounds):
        table = spark.createDataFrame(centers, "cluster int, center array<double>")
        own = df.join(assign(df, key, vector, table), key)
        sums = own.groupBy("cluster").agg(F.array(*[F.avg(F.col(vector)[i]) for i in range(size)]).alias("center")).collect()
        new = dict(centers) | {r["cluster"]: r["center"] for r in sums}
        moved = max(sum((a - b) ** 2 for a, b in zip(new[i], c, strict=True)) for i, c in centers)
        centers = sorted(new.items())
        if moved < tolerance**2:
            break
    return spark.createDataFrame(centers, "cluster int, center array<double>")


def dbscan(df: DataFrame, key: str, vector: str, radius: float, least: int, rounds: int = 100) -> DataFrame:
    """(key, core, cluster): cores have ``least`` rows within the radius, themselves included; clusters are cores that
    reach each other, named by their smallest key, and rows near a core; noise has none. Labels hook onto smaller ones
    nearby and jump to their labels' labels until none changes, which takes few rounds; more than ``rounds`` are an error."""
    near = lineage.cut(pairs(df, df, key, vector, radius=radius, itself=True).select(key, "near"))
    cores = near.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(key)
    links = lineage.cut(near.join(cores, key).join(cores.select(F.col(key).alias("near")), "near").select(key, "near"))
    label = lineage.cut(cores.withColumn("cluster", F.col(key)))
    for _ in range(rounds):
        low = links.join(label.select(F.col(key).alias("near"), "cluster"), "near").groupBy(key).agg(F.min("cluster").alias("low"))
        both = label.join(low, key)
        hooks = both.select(key, "low").unionByName(both.select(F.col("cluster").alias(key), "low"))
        low = hooks.groupBy(key).agg(F.min("low").alias("low"))
        jump = low.select(F.col(key).alias("low"), F.col("low").alias("cluster"))
        new = lineage.cut(low.join(jump, "low").select(key, "cluster"))
        changed = new.join(label.withColumnRenamed("cluster", "was"), key).where("cluster <> was").limit(1).count()
        label = new
        if not changed:
            break
    else:
        raise RuntimeError(f"clusters still change after {rounds} rounds")
    border = near.join(label.select(F.col(key).alias("near"), "cluster"), "near").groupBy(key).agg(F.min("cluster").alias("reach"))
    own = label.select(key, F.col("cluster").alias("mine"))
    return df.select(key).join(own, key, "left").join(border, key, "left").select(key, F.col("mine").isNotNull().alias("core"), F.coalesce("mine", "reach").alias("cluster"))


def best_split(df: DataFrame, column: str, y: str, measure: str = "gini") -> DataFrame:
    """(threshold, gain) of the best cut of a column for a 0/1 target: running counts over distinct values; ties by the least."""
    counts = df.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"), F.sum(F.col(y).cast("long")).alias("s"))
    total = counts.agg(F.sum("n").alias("tn"), F.sum("s").alias("ts"))
    run = W.partitionBy(F.lit(0)).orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    rows = counts.withColumn("ln", F.sum("n").over(run)).withColumn("ls", F.sum("s").over(run)).withColumn("next", F.lead("v").over(W.partitionBy(F.lit(0)).orderBy("v"))).crossJoin(F.broadcast(total)).where("next is not null")

    def impurity(n, s):
        p = s / n
        h = lambda q: F.when(q > 0, -q * F.ln(F.when(q > 0, q))).otherwise(0.0)
        return {"gini": lambda: 2 * p * (1 - p), "entropy": lambda: h(p) + h(1 - p), "variance": lambda: p * (1 - p)}[measure]()

    n, s, rn, rs = F.col("ln"), F.col("ls"), F.col("tn") - F.col("ln"), F.col("ts") - F.col("ls")
    gain = impurity(F.col("tn"), F.col("ts")) - n / F.col("tn") * impurity(n, s) - rn / F.col("tn") * impurity(rn, rs)
    return rows.select(((F.col("v") + F.col("next")) / 2).alias("threshold"), F.round(gain, 10).alias("gain")).agg(F.min(F.struct((-F.col("gain")).alias("g"), "threshold")).alias("s")).select("s.threshold", (-F.col("s.g")).alias("gain"))


def mllib(df: DataFrame, columns: list[str], y: str, kind: str, **options):
    """(model, predictions) of an MLlib estimator: logistic, tree, forest, boosted, svm, mlp, linear, tree_regressor,
    forest_regressor, boosted_regressor, naive_bayes or glm. Nulls count as 0."""
    from pyspark.ml import classification as C
    from pyspark.ml import regression as R
    from pyspark.ml.feature import VectorAssembler

    kinds = {
        "logistic": C.LogisticRegression, "tree": C.DecisionTreeClassifier, "forest": C.RandomForestClassifier, "boosted": C.GBTClassifier, "svm": C.LinearSVC, "mlp": C.MultilayerPerceptronClassifier, "naive_bayes": C.NaiveBayes,
        "linear": R.LinearRegression, "tree_regressor": R.DecisionTreeRegressor, "forest_regressor": R.RandomForestRegressor, "boosted_regressor": R.GBTRegressor, "glm": R.GeneralizedLinearRegression,
    }
    clean = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in [*columns, y]})
    table = VectorAssembler(inputCols=columns, outputCol="__x").transform(clean)
    model = kinds[kind](featuresCol="__x", labelCol=y, **options).fit(table)
    return model, model.transform(table).drop("__x", "rawPrediction")

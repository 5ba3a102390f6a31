"""Resampling and splits. What is drawn follows from hashes of keys, so reruns agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lineage, near, ranks
from .anomaly import neighbours


def draw(*keys: str) -> Column:
    """The order of random draws: a hash that SQL engines share."""
    return F.sha2(F.concat_ws(":", F.lit("draw"), *keys), 256)


def class_counts(df: DataFrame, y: str) -> DataFrame:
    counts = df.groupBy(y).agg(F.count("*").alias("n"))
    top = counts.agg(F.max("n").alias("top"))
    return counts.crossJoin(F.broadcast(top)).select(y, "n", (F.col("top") / F.col("n")).alias("imbalance"))


def over_plan(df: DataFrame, y: str, strategy: float = 1.0) -> DataFrame:
    """(class, n, target, more): every class is drawn up to trunc(largest * strategy)."""
    counts = df.groupBy(y).agg(F.count("*").alias("n"))
    top = counts.agg(F.floor(F.max("n") * strategy).alias("target"))
    return counts.crossJoin(F.broadcast(top)).select(y, "n", "target", F.greatest(F.col("target") - F.col("n"), F.lit(0)).alias("more"))


def over_sample(df: DataFrame, y: str, key: str, strategy: float = 1.0) -> DataFrame:
    """``df`` and copies, numbered by ``copy``: with replacement in turns, the rest to those first in the order of draws."""
    top = int((df.groupBy(y).count().agg(F.max("count")).first()[0] or 0) * strategy)
    more = F.greatest(F.lit(top) - F.col("__n"), F.lit(0))
    rows = ranks.numbered(df.where(F.col(y).isNotNull()), [draw(key), key], [y]).withColumn("more", more)
    times = F.expr("more div __n") + (F.col("__i") < F.col("more") % F.col("__n")).cast("int")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), times))).select(*df.columns, "copy")


def under_sample(df: DataFrame, y: str, key: str, strategy: float = 1.0) -> DataFrame:
    """trunc(smallest / strategy) rows of every class, those first in the order of draws."""
    target = int((df.groupBy(y).count().agg(F.min("count")).first()[0] or 0) / strategy)
    return ranks.numbered(df, [draw(key), key], [y]).where(F.col("__i") < target).select(*df.columns)


def near_miss(df: DataFrame, y: str, key: str, vector: str, k: int = 3, version: int = 1) -> DataFrame:
    """As many rows of the largest class as the smallest has, by least mean distance to the k nearest (or, in version 2, farthest) others."""
    counts = sorted((r["count"], r[y]) for r in df.groupBy(y).count().collect())
    smallest, largest = counts[0][0], counts[-1][1]
    others, own = df.where(F.col(y) != largest), df.where(F.col(y) == largest)
    mean = near.pairs(own, others, key, vector, k=k, farthest=version == 2, itself=True).groupBy(key).agg(F.avg("dist").alias("mean"))
    kept = ranks.numbered(mean, ["mean", key]).where(F.col("__i") < smallest).select(key)
    return own.join(kept, key, "left_semi").unionByName(others)


def smote(df: DataFrame, y: str, key: str, vector: str, k: int = 5, minority=None) -> DataFrame:
    """(source, near, vector): synthetic points of each class below the largest (or of ``minority`` alone), on lines to one of
    the k nearest that differ, until classes are even. Points are spread evenly over the rows that have such a neighbour.

    A class without two different rows gives none.
    """
    counts = df.where(F.col(y).isNotNull()).groupBy(y).count().collect()
    top = max((r["count"] for r in counts), default=0)
    plan = [(r[y], r["count"], top - r["count"]) for r in counts if r["count"] < top and minority in (None, r[y])]
    found = None
    for value, _, need in sorted(plan, key=str):
        rows = df.where(F.col(y) == value)
        own = rows.select(F.col(key).alias("source"), F.col(vector).alias("__a"))
        close = lineage.cut(near.pairs(rows, rows, key, vector, k=k, apart=True).select(F.col(key).alias("source"), "near"))
        givers = ranks.numbered(close.select("source").distinct(), [draw("source"), "source"])
        times = F.expr(f"{need} div __n") + (F.col("__i") < F.lit(need) % F.col("__n")).cast("long")
        turns = givers.withColumn("__t", times).where("__t > 0").select("source", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__t") - 1)).alias("turn"))
        made = _points(turns, close, own, vector)
        found = made if found is None else found.unionByName(made)
    return df.sparkSession.createDataFrame([], f"source {df.schema[key].dataType.simpleString()}, near {df.schema[key].dataType.simpleString()}, {vector} array<double>") if found is None else found


def borderline(df: DataFrame, y: str, key: str, vector: str, m: int = 5, low: float = 0.3, high: float = 0.7) -> DataFrame:
    """(key, share, borderline): the share of another class among the m nearest."""
    close = neighbours(df, key, vector, m)
    label = df.select(F.col(key).alias("near"), F.col(y).alias("__y"))
    return close.join(label, "near").join(df.select(key, y), key).groupBy(key).agg(F.avg((F.col("__y") != F.col(y)).cast("double")).alias("share")).withColumn("borderline", (F.col("share") > low) & (F.col("share") < high))


def adasyn_plan(df: DataFrame, y: str, key: str, vector: str, minority, k: int = 5, beta: float = 1.0) -> DataFrame:
    """(key, more): how many points each row of the minority gets, by the share of others among its nearest."""
    counts = {r[y]: r["count"] for r in df.groupBy(y).count().collect()}
    total = (max(counts.values()) - counts[minority]) * beta
    hard = borderline(df, y, key, vector, k).join(df.where(F.col(y) == minority).select(key), key, "left_semi")
    whole = hard.agg(F.sum("share").alias("__all"))
    return hard.crossJoin(F.broadcast(whole)).select(key, F.floor(F.try_divide(F.col("share"), F.col("__all")) * total + 0.5).cast("long").alias("more")).na.fill(0, ["more"])


def _points(turns: DataFrame, close: DataFrame, own: DataFrame, vector: str) -> DataFrame:
    """(source, near, vector): a point for each of ``turns`` (source, turn), on the line to one of ``close`` (source, near)."""
    picked = turns.join(close.groupBy("source").agg(F.collect_list("near").alias("__near")), "source")
    picked = picked.withColumn("near", F.array_min(F.transform("__near", lambda x: F.struct(F.sha2(F.concat_ws(":", F.lit("draw"), F.col("source"), x, F.col("turn")), 256).alias("d"), x.alias("near"))))["near"])
    part = F.conv(F.substring(draw("turn", "source"), 1, 8), 16, 10).cast("double") / float(1 << 32)
    other = own.select(F.col("source").alias("near"), F.col("__a").alias("__b"))
    joined = picked.select("source", "near", "turn").join(own, "source").join(other, "near").withColumn("u", part)
    return joined.select("source", "near", F.zip_with("__a", "__b", lambda p, q: p + F.col("u") * (q - p)).alias(vector))


def _own(df: DataFrame, y: str, key: str, vector: str, minority) -> DataFrame:
    return df.where(F.col(y) == minority).select(F.col(key).alias("source"), F.col(vector).alias("__a"))


def _near_own(df: DataFrame, y: str, key: str, vector: str, minority, k: int) -> DataFrame:
    """(source, near): the k nearest of the same class."""
    return neighbours(df.where(F.col(y) == minority), key, vector, k).select(F.col(key).alias("source"), "near")


def borderline_points(df: DataFrame, y: str, key: str, vector: str, minority, k: int = 5, m: int = 5) -> DataFrame:
    """(source, near, vector): synthetic points of the minority until it is even with the largest class, from its borderline rows in turns.

    Without a borderline row every row of the minority gives points.
    """
    counts = {r[y]: r["count"] for r in df.groupBy(y).count().collect()}
    need = max(counts.values()) - counts[minority]
    edge = borderline(df, y, key, vector, m).where("borderline").select(F.col(key).alias("source"))
    own = _own(df, y, key, vector, minority)
    givers = lineage.cut(own.select("source").join(edge, "source", "left_semi"))
    givers = givers if givers.limit(1).count() else own.select("source")
    placed = ranks.numbered(givers, [draw("source"), "source"])
    times = F.expr(f"{need} div __n") + (F.col("__i") < F.lit(need) % F.col("__n")).cast("long")
    turns = placed.withColumn("__t", times).where("__t > 0").select("source", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__t") - 1)).alias("turn"))
    return _points(turns, _near_own(df, y, key, vector, minority, k), own, vector)


def adasyn(df: DataFrame, y: str, key: str, vector: str, minority, k: int = 5, beta: float = 1.0, most_share: float = 0.75) -> DataFrame:
    """(source, near, vector): as many points of each row of the minority as ``adasyn_plan`` gives it.

    None where the minority has more than ``most_share`` of the largest class.
    """
    counts = {r[y]: r["count"] for r in df.groupBy(y).count().collect()}
    own = _own(df, y, key, vector, minority)
    plan = adasyn_plan(df, y, key, vector, minority, k, beta).select(F.col(key).alias("source"), "more")
    plan = plan.where(F.lit(counts[minority] <= most_share * max(counts.values())) & (F.col("more") > 0))
    turns = plan.select("source", F.explode(F.sequence(F.lit(0).cast("long"), F.col("more") - 1)).alias("turn"))
    return _points(turns, _near_own(df, y, key, vector, minority, k), own, vector)


def k_fold(df: DataFrame, k: int, order: str, n: int | None = None) -> DataFrame:
    """``df`` with fold: consecutive rows, the first n % k folds one longer. Rows are numbered in ranges of the key."""
    n = df.count() if n is None else n
    size, extra = divmod(n, k)
    i = F.col("__i")
    fold = F.when(i < extra * (size + 1), F.floor(i / (size + 1))).otherwise(extra + F.floor((i - extra * (size + 1)) / max(1, size)))
    return numbered(df, order).withColumn("fold", fold.cast("int")).drop("__i")


def numbered(df: DataFrame, order: str, parts: int = 32) -> DataFrame:
    """``df`` with __i, the place in ``order`` from 0, without one task that sorts all: counts of ranges are summed."""
    low, high = df.agg(F.min(order).cast("double"), F.max(order).cast("double")).first()
    part = F.least(F.floor((F.col(order).cast("double") - F.lit(low)) / F.lit((high - low) or 1.0) * parts), F.lit(parts - 1)) if low is not None else F.lit(0)
    rows = df.withColumn("__part", part)
    counts = rows.groupBy("__part").agg(F.count("*").alias("__n"))
    before = counts.select("__part", F.coalesce(F.sum("__n").over(W.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return rows.join(F.broadcast(before), "__part").withColumn("__i", F.col("__before") + F.row_number().over(W.partitionBy("__part").orderBy(order)) - 1).drop("__part", "__before")


def stratified(df: DataFrame, y: str, k: int, order: str) -> DataFrame:
    """``df`` with fold: rows of each class in order are dealt to folds in turn."""
    return ranks.numbered(df, [order], [y]).select(*df.columns, (F.col("__i") % k).cast("int").alias("fold"))


def group_fold(df: DataFrame, group: str, k: int) -> DataFrame:
    """Groups in order are dealt to folds in turn."""
    dealt = ranks.numbered(df.select(F.col(group).alias("__g")).distinct(), ["__g"]).select("__g", (F.col("__i") % k).cast("int").alias("fold"))
    return df.join(dealt, F.col(group) == F.col("__g")).drop("__g")


def repeated(df: DataFrame, k: int, times: int, key: str) -> DataFrame:
    """(.., turn, fold): rows in the order of draws, anew each turn, cut into folds of which the first n % k are one longer."""
    rows = df.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(times - 1).cast("long"))))
    numbered_ = ranks.numbered(rows, [draw(key, "turn"), key], ["turn"])
    i, size, extra = F.col("__i"), F.expr(f"__n div {k}"), F.col("__n") % k
    fold = F.when(i < extra * (size + 1), F.floor(i / (size + 1))).otherwise(extra + F.floor((i - extra * (size + 1)) / F.greatest(size, F.lit(1))))
    return numbered_.select(*rows.columns, fold.cast("int").alias("fold"))


def tail_split(df: DataFrame, order: str, share: float) -> DataFrame:
    """``df`` with held, for the last trunc(n * share) rows."""
    n = df.count()
    return numbered(df, order).withColumn("held", F.col("__i") >= n - int(n * share)).drop("__i")


def stratified_split(df: DataFrame, y: str, order: str, share: float) -> DataFrame:
    """``df`` with held, for the last clamp(trunc(n * share), 1, n - 1) rows of each class."""
    n = F.col("__n")
    size = F.greatest(F.lit(0), F.least(F.greatest(F.floor(n * share), F.lit(1)), n - 1))
    return ranks.numbered(df, [order], [y]).select(*df.columns, (F.col("__i") >= n - size).alias("held"))

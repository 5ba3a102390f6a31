"""Places of rows in an order, without a task that sorts them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut


def numbered(df: DataFrame, order: list[str | Column], by: list[str] | None = None) -> DataFrame:
    """``df`` with __i, each row's place in ``order`` from 0 among the rows of its group ``by``, and __n, that group's rows.

    Rows are dealt by ranges of group and order, so a large group spreads over many tasks, and sorted within these.
    They're kept once, as places and counts must be of the same rows; counts of tasks, and first places of groups, are
    small tables. The order must tell rows apart for reruns to agree.
    """
    by = by or []
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    named = df.withColumns({f"__o{i}": k for i, k in enumerate(keys)})
    every = [*by, *[f"__o{i}" for i in range(len(keys))]]
    rows = cut(named.repartitionByRange(*every).sortWithinPartitions(*every).withColumn("__m", F.monotonically_increasing_id()))
    part, place = F.shiftright("__m", 33), F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    counts, starts = sorted((r["p"], r["n"]) for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()), {}
    before = 0
    for p, n in counts:
        starts[p] = before
        before += n
    offsets = df.sparkSession.createDataFrame(list(starts.items()), "__p long, __before long")
    global_ = rows.join(F.broadcast(offsets), part == F.col("__p")).withColumn("__i", F.col("__before") + place)
    if not by:
        return global_.select(*df.columns, "__i", F.lit(max(before, 1)).cast("long").alias("__n"))  # without rows nobody reads it
    groups = global_.groupBy(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(by)]).agg(F.min("__i").alias("__first"), F.count("*").alias("__n"))
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__g{i}"))
    return global_.join(groups, same).select(*df.columns, (F.col("__i") - F.col("__first")).alias("__i"), "__n")

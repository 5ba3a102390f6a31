"""Rows that are near to each other: blocks of vectors against blocks of vectors, by matrix products, at any size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bytes of the vectors that are compared with all others at a time, and distances that a worker holds at a time.
CHUNK_BYTES, CELLS = 32 << 20, 2_000_000


def _matrix(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, places): the vectors of a column that are whole and finite, and where they stand."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(np.asarray(column.offsets))
    width = int(sizes.max(initial=0))
    use = (sizes == width) & column.is_valid().to_numpy(zero_copy_only=False) if width else np.zeros(len(column), bool)
    places = np.flatnonzero(use)
    flat = column.take(pa.array(places)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    rows = flat.reshape(len(places), width) if len(places) else np.zeros((0, width))
    whole = np.isfinite(rows).all(1)
    return rows[whole], places[whole]


def _exact(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances of pairs of rows, by plain sums, so that equal vectors are equally far."""
    if metric == "cosine":
        norm = np.sqrt((a * a).sum(1) * (b * b).sum(1))
        return np.where(norm > 0, 1 - (a * b).sum(1) / np.where(norm > 0, norm, 1), 1.0)
    return np.sqrt(((a - b) ** 2).sum(1))


def pairs(left: DataFrame, right: DataFrame, key: str, vector: str, k: int | None = None, radius: float | None = None, metric: str = "euclidean", farthest: bool = False, itself: bool = False, apart: bool = False) -> DataFrame:
    """(key, near, dist): of each row of ``left`` the ``k`` nearest (or farthest) rows of ``right`` by (dist, key), or all within ``radius``; with ``apart``, rows at no distance don't count.

    ``right`` is taken in chunks of bounded size, each broadcast on its own, and every batch of ``left`` is compared with
    a chunk by a matrix product; what may be among the nearest is computed again exactly. Only k rows of each chunk leave
    the workers. Vectors that are null, of another length, or hold a null or a non-finite value are near to nothing.
    """
    spark, kind = left.sparkSession, left.schema[key].dataType.simpleString()
    right = right.select(key, F.col(vector).cast("array<double>").alias(vector))
    shape = right.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size(vector)), F.lit(1)).alias("d")).first()
    chunks = max(1, -(-shape["n"] * 8 * max(1, shape["d"]) // CHUNK_BYTES))
    found = None
    for chunk in range(chunks):
        part = right if chunks == 1 else right.where(F.pmod(F.xxhash64(key), F.lit(chunks)) == chunk)
        table = part.orderBy(key).toArrow()
        rows, places = _matrix(table[vector])
        shared = spark.sparkContext.broadcast((rows, table[key].combine_chunks().take(pa.array(places))))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            other, keys = shared.value
            sign = -1.0 if farthest else 1.0
            for b in batches:
                own, at = _matrix(b.column(1))
                if not len(own) or not len(other) or own.shape[1] != other.shape[1]:
                    continue
                step = max(1, CELLS // len(other))
                for i in range(0, len(own), step):
                    x, names = own[i : i + step], b.column(0).take(pa.array(at[i : i + step]))
                    product = x @ other.T
                    if metric == "cosine":
                        norm = np.sqrt((x * x).sum(1)[:, None] * (other * other).sum(1)[None, :])
                        rough = np.where(norm > 0, 1 - product / np.where(norm > 0, norm, 1), 1.0)
                    else:
                        rough = (x * x).sum(1)[:, None] + (other * other).sum(1)[None, :] - 2 * product
                    slack = 1e-9 * (1 + np.abs(rough).max(1, keepdims=True) if metric == "cosine" else 1 + (x * x).sum(1)[:, None] + (other * other).sum(1).max())
                    rough *= sign
                    if radius is not None:
                        bound = (radius if metric == "cosine" else radius * radius) + slack
                    else:
                        level = np.where(rough <= 2 * slack, np.inf, rough) if apart else rough
                        most = min(k + (0 if itself or apart else 1), len(other)) - 1
                        bound = np.partition(level, most, axis=1)[:, most : most + 1] + 2 * slack
                    a, c = np.nonzero(rough <= bound)
                    dist = _exact(x[a], other[c], metric)
                    mine, near = names.take(pa.array(a)), keys.take(pa.array(c))
                    keep = np.ones(len(a), bool) if itself else ~pa.compute.equal(mine, near).to_numpy(zero_copy_only=False)
                    if radius is not None:
                        keep &= dist <= radius
                    if apart:
                        keep &= dist > 0
                    use = np.flatnonzero(keep)
                    if k is not None and len(use):
                        use = use[np.lexsort((c[use], sign * dist[use], a[use]))]  # keys of a chunk are in order
                        first = np.flatnonzero(np.diff(a[use], prepend=-1))
                        use = use[np.arange(len(use)) - np.repeat(first, np.diff(np.append(first, len(use)))) < k]
                    if len(use):
                        yield pa.RecordBatch.from_arrays([mine.take(pa.array(use)), near.take(pa.array(use)), pa.array(dist[use])], [key, "near", "dist"])

        own = left.select(key, F.col(vector).cast("array<double>").alias(vector)).mapInArrow(run, f"{key} {kind}, near {kind}, dist double")
        found = own if found is None else found.unionByName(own)
    if k is not None and chunks > 1:
        order = F.desc("dist") if farthest else F.col("dist")
        found = found.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy(order, "near"))).where(F.col("__r") <= k).drop("__r")
    return found

"""Shared pieces: checkpoints in the cluster's shared folder, Arrow batches of bounded size, components."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lineage

#: Rows of one Arrow batch sent to a Python worker; texts are long, so batches stay small.
BATCH_ROWS = 512
#: Bytes of one Arrow batch, where the running Spark has that setting.
BATCH_BYTES = 4 << 20
#: Edges of a partition of what is kept between steps, and partitions at least.
EDGES_PER_PART, LEAST_PARTS = 50_000, 8


def ready(spark: SparkSession) -> SparkSession:
    """Bounds the Arrow batches of this session and makes sure that there is a checkpoint folder."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key, None)
        if now is not None and not 0 < int(str(now).rstrip("bB")) <= most:
            spark.conf.set(key, str(most))
    _ship(spark)
    lineage.folder(spark)
    return spark


_SHIPPED: set[str] = set()


def _ship(spark: SparkSession) -> None:
    """Sends this library to the executors, unless they find it as the driver does: by PYTHONPATH or working folder."""
    root = str(Path(__file__).resolve().parents[2])
    here = [os.path.realpath(p or ".") for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]]
    app = spark.sparkContext.applicationId
    if root not in here and app not in _SHIPPED:
        _SHIPPED.add(app)
        with_package = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="tablesmith-"), "tablesmith"), "zip", root, "tablesmith")
        spark.sparkContext.addPyFile(with_package)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, kept in the shared checkpoint folder so that lost executors don't cost them."""
    ready(df.sparkSession)
    return lineage.cut(df)


def shuffled(df: DataFrame) -> DataFrame:
    """The rows of ``df``, which ends in a shuffle, such that several jobs read the files of that one shuffle."""
    ready(df.sparkSession)
    return lineage.shuffled(df)


def drop(spark: SparkSession, folder: str) -> None:
    """Deletes a folder, wherever Spark's file systems have it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for the nodes of undirected ``edges`` (a, b); component is the smallest node reachable.

    Alternates the large-star and small-star steps until the edges are stars. Minima are pre-aggregated and
    cut before they are joined back, so that the rows of a hub can be split by the adaptive skew join. What is
    kept between steps has a partition per EDGES_PER_PART edges, so that few edges don't make many small files.
    Loops and rows with nulls are ignored; empty edges give an empty result.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(rounds):
        seen = now.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0)).alias("h")).first()
        if tuple(seen) == before or seen["n"] == 0:
            break
        before, parts = tuple(seen), max(LEAST_PARTS, seen["n"] // EDGES_PER_PART)
        now = now.coalesce(parts)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(parts))
        large = both.where("v > u").join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = cut(large.coalesce(parts))
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")).coalesce(parts))
        small = large.join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        now = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).coalesce(parts).distinct().coalesce(parts))
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

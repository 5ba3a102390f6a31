"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The checkpoint folder: the one in spark.checkpoint.dir.

    Where that is unset, a folder of this machine serves a local master, as in tests; a cluster's executors could not
    all see it, so there it is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(given or tempfile.mkdtemp(prefix="tablesmith-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, kept in the shared checkpoint folder so that lost executors don't cost them.

    The optimizer's guesses of size and content aren't kept: a guess for a join is a product, and over the rounds of
    a loop its digits double with each. Adaptive execution measures instead.
    """
    folder(df.sparkSession)
    return _framed(df.checkpoint(eager=True)._jdf.queryExecution().logical().rdd(), df)


def shuffled(df: DataFrame) -> DataFrame:
    """The rows of ``df``, which ends in a shuffle, such that several jobs read the files of that one shuffle.

    Files that go with an executor are made again from the input.
    """
    return _framed(df._jdf.queryExecution().toRdd(), df)


def _framed(rows, like: DataFrame) -> DataFrame:
    spark = like.sparkSession
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, like._jdf.schema(), False), spark)

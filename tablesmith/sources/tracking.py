"""An append-only store of runs: parameters, metrics by step and tags, one row each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "run string, kind string, key string, value string, step long, ts timestamp"


class Runs:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def log(self, run: str, kind: str, values: dict, step: int = 0) -> None:
        rows = self.spark.createDataFrame([(run, kind, k, str(v), step) for k, v in values.items()], "run string, kind string, key string, value string, step long")
        rows.withColumn("ts", F.current_timestamp()).write.mode("append").partitionBy("kind").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def latest(self, kind: str) -> DataFrame:
        """(run, key, value) of the last step of each key."""
        return self.read().where(F.col("kind") == kind).groupBy("run", "key").agg(F.max_by("value", F.struct("step", "ts")).alias("value"))

    def best(self, metric: str, lowest: bool = True) -> DataFrame:
        rows = self.latest("metric").where(F.col("key") == metric).select("run", F.col("value").cast("double").alias("value"))
        return rows.orderBy("value" if lowest else F.desc("value"), "run").limit(1)

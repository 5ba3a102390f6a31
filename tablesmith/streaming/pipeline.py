"""Structured Streaming: stateless maps, running statistics, event-time windows and drift detectors with state."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lineage


def source(spark: SparkSession, path: str, schema, most_files: int = 1) -> DataFrame:
    """Parquet files that arrive under ``path``, ``most_files`` of them a batch: the source's own rate limit."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(path)


def running(stream: DataFrame, by: list[str], column: str) -> DataFrame:
    """Count, mean, sample variance and extremes so far; the state of a group is a few sums."""
    c = F.col(column).cast("double")
    return stream.groupBy(*by).agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.var_samp(c).alias("variance"), F.min(c).alias("low"), F.max(c).alias("high"))


def windowed(stream: DataFrame, ts: str, by: list[str], column: str, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Tumbling or sliding event-time windows; rows later than the watermark are dropped, and so is old state."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    out = stream.withWatermark(ts, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum(column).alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")


def sessions(stream: DataFrame, ts: str, by: list[str], gap: str, late: str = "10 minutes") -> DataFrame:
    out = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def page_hinkley(stream: DataFrame, by: str, order: str, x: str, delta: float = 0.005, bound: float = 50.0, keep: float = 0.9999) -> DataFrame:
    """(by, n, sum, drift) per group and batch; mean, sum and least sum are the group's state."""
    import pandas as pd

    kind = stream.schema[by].dataType.simpleString()

    def step(key, frames: Iterator, state) -> Iterator:
        n, mean, total, low = state.get if state.exists else (0, 0.0, 0.0, 0.0)
        drift = False
        for v in pd.concat(list(frames)).sort_values(order)[x].astype(float):
            mean = v if n == 0 else keep * mean + (1 - keep) * v
            n += 1
            total += v - mean - delta
            low = min(low, total)
            drift |= total - low > bound
        state.update((n, mean, total, low))
        yield pd.DataFrame({by: [key[0]], "n": [n], "sum": [total - low], "drift": [drift]})

    return stream.groupBy(by).applyInPandasWithState(step, f"{by} {kind}, n long, sum double, drift boolean", "n long, mean double, total double, low double", "update", "NoTimeout")


def predict(stream: DataFrame, score: Column, name: str = "score") -> DataFrame:
    """Scores as an expression: the same for a stream and a table."""
    return stream.withColumn(name, score)


def drain(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what there is and returns its rows, which executors write to the shared folder.

    With complete output the last batch has all rows; otherwise all batches do.
    """
    spark = stream.sparkSession
    folder = f"{lineage.folder(spark)}/{name}"
    last: list[int] = []

    def keep(batch: DataFrame, i: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={i}")
        last.append(i)

    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    if not last:
        return spark.createDataFrame([], stream.schema)
    whole = spark.read.schema(stream.schema)
    return whole.parquet(f"{folder}/rows/batch={last[-1]}") if mode == "complete" else whole.parquet(*[f"{folder}/rows/batch={i}" for i in sorted(set(last))])


def progress(query) -> dict[str, float]:
    """Of a running or ended query: batches, rows, and rows a second over the batches that its progress still has."""
    done = [p for p in query.recentProgress if p["numInputRows"]]
    rows, ms = sum(p["numInputRows"] for p in done), sum(p["durationMs"].get("triggerExecution", 0) for p in done)
    return {"batches": len(done), "rows": rows, "rows_a_second": rows * 1000 / ms if ms else 0.0}


def ddm(stream: DataFrame, by: str, order: str, error: str, least: int = 30) -> DataFrame:
    """(by, n, p, level) per group and batch: the error rate, and 1 or 2 where it rose 2 or 3 deviations above its least
    sum with the deviation so far at the batch's last row; counts and the least sum are the group's state."""
    import pandas as pd

    kind = stream.schema[by].dataType.simpleString()

    def step(key, frames: Iterator, state) -> Iterator:
        n, wrong, low, low_p, low_s = state.get if state.exists else (0, 0, float("inf"), 0.0, 0.0)
        p, level = 0.0, 0
        for e in pd.concat(list(frames)).sort_values(order)[error].astype(bool):
            n, wrong = n + 1, wrong + int(e)
            p = wrong / n
            s = (p * (1 - p) / n) ** 0.5
            if n >= least and p + s < low:
                low, low_p, low_s = p + s, p, s
            level = 0 if low == float("inf") else 2 if p + s > low_p + 3 * low_s else 1 if p + s > low_p + 2 * low_s else 0
        state.update((n, wrong, low, low_p, low_s))
        yield pd.DataFrame({by: [key[0]], "n": [n], "p": [p], "level": [level]})

    return stream.groupBy(by).applyInPandasWithState(step, f"{by} {kind}, n long, p double, level int", "n long, wrong long, low double, low_p double, low_s double", "update", "NoTimeout")

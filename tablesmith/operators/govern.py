"""Privacy, retention, audit, monitoring and limits."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import ranks
from ..functions.folds import folded

# What a column's values are matched against, what its name is searched for, and how long classes of data are kept.
PATTERNS = {
    "email": r"^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}$",
    "phone": r"^(\+?\d{1,3}[\s\-]?)?\(?\d{2,4}\)?[\s\-]?\d{3,4}[\s\-]?\d{3,4}$",
    "ssn": r"^\d{3}-?\d{2}-?\d{4}$",
    "credit_card": r"^\d{4}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}$",
    "ip_address": r"^(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)$",
    "postal_code": r"^\d{5}(-\d{4})?$",
}
NAMES = {
    "email": "(e[-_]?mail|email_addr)",
    "phone": "(phone|tel|mobile|cell)",
    "ssn": "(ssn|social_sec|national_id)",
    "credit_card": "(credit_card|card_num|cc_num)",
    "name": "(first_?name|last_?name|full_?name|surname|given_name)",
    "address": "(address|street|city|state|zip|postal)",
    "date_of_birth": "(dob|date_of_birth|birth_?date|birthday)",
    "ip_address": "(ip_addr|ip_address|source_ip|client_ip)",
}
RETENTION = {"public": None, "internal": 365, "confidential": 90, "restricted": 30}
#: What is advised for a column, by the kinds found in it; the first that applies.
ADVICE = {"remove": ("ssn", "credit_card"), "anonymize": ("email", "phone", "name"), "review": None}
BY_NAME, LEAST_SHARE, LEAST_VALID = 0.7, 0.1, 0.05


def pii_columns(df: DataFrame, columns: list[str], first: int = 1000, order: str | None = None) -> DataFrame:
    """(column, kind, confidence): kinds that a column's name suggests, or that more than LEAST_SHARE of its first values match.

    The ``first`` values that aren't null, in ``order``, are trimmed and matched; the share of matches takes the place of
    a name's confidence. Card numbers count only where LEAST_VALID of the values at least have a right check digit, and
    that share is their confidence. The bound on values is a parameter of the operator; each column is read by itself.
    """
    found = None
    for c in columns:
        value = F.col(c).cast("string")
        rows = df.where(value.isNotNull())
        rows = (rows.orderBy(order) if order else rows).limit(first).select(F.trim(value).alias("v"))
        luhn = F.coalesce(F.call_function("luhn_check", F.regexp_replace("v", "[- ]", "")), F.lit(False))
        hits = rows.agg(F.greatest(F.count("*"), F.lit(1)).alias("n"), *[F.count_if(F.col("v").rlike(p)).alias(k) for k, p in PATTERNS.items()], F.count_if(luhn).alias("__luhn"))
        named = [k for k, words in NAMES.items() if re.search(words, c, re.IGNORECASE)]

        def kind(k: str, named=named) -> Column:
            share = F.col(k) / F.col("n") if k in PATTERNS else F.lit(0.0)
            sure = F.when(share > LEAST_SHARE, share).otherwise(F.lit(BY_NAME if k in named else None).cast("double"))
            valid = F.col("__luhn") / F.col("n")
            return F.struct(F.lit(k).alias("kind"), F.when(valid >= LEAST_VALID, F.when(sure.isNotNull(), valid)).alias("confidence") if k == "credit_card" else sure.alias("confidence"))

        own = hits.select(F.lit(c).alias("column"), F.explode(F.array(*[kind(k) for k in dict.fromkeys([*PATTERNS, *named])])).alias("s")).select("column", "s.kind", "s.confidence").where("confidence is not null")
        found = own if found is None else found.unionByName(own)
    return found


def pii_advice(found: DataFrame) -> DataFrame:
    """(column, kinds, advice) of what ``pii_columns`` found: remove, anonymize or review."""
    kinds = F.array_sort(F.collect_set("kind"))
    advice = F.when(F.arrays_overlap(kinds, F.array(*map(F.lit, ADVICE["remove"]))), "remove").when(F.arrays_overlap(kinds, F.array(*map(F.lit, ADVICE["anonymize"]))), "anonymize").otherwise("review")
    return found.groupBy("column").agg(F.array_join(kinds, ",").alias("kinds"), advice.alias("advice"))


def risk(found: Column) -> Column:
    """From the number of columns with personal data."""
    return F.when(found == 0, "Low").when(found <= 2, "Medium").when(found <= 5, "High").otherwise("Critical")


def pseudonym(v: Column, salt: str) -> Column:
    return F.concat(F.lit("pseudo_"), F.substring(F.sha2(F.concat(F.lit(salt), v), 256), 1, 12))


def mask(v: Column, keep: int = 3) -> Column:
    return F.when(F.octet_length(v) > keep, F.concat(F.substring(v, 1, keep), F.lit("***"))).otherwise(F.repeat(F.lit("*"), F.octet_length(v)))


def suppress(v: Column) -> Column:
    return F.when(v.isNotNull(), F.lit("[REDACTED]"))


def randomize(df: DataFrame, column: str, key: str, seed: int = 42) -> DataFrame:
    """``df`` with the values of ``column`` dealt to other rows: rows in order of the key take values in the order of draws.

    The distribution of the values stays. Both orders are numbered in ranges, so that no task sorts all rows.
    """
    from .sampling import numbered

    spread = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), F.col(key)), 256), 1, 13), 16, 10).cast("long")
    values = numbered(df.select(F.col(column).alias("__value"), spread.alias("__draw")), "__draw").select("__i", "__value")
    return numbered(df, key).join(values, "__i").withColumn(column, F.col("__value")).select(*df.columns)


def generalize(x: Column, edges: list[float]) -> Column:
    """Bins [low, high) as text, and ``last+``."""
    out = F.when(x >= edges[-1], f"{edges[-1]:g}+")
    for a, b in zip(edges, edges[1:], strict=False):
        out = out.when((x >= a) & (x < b), f"{a:g}-{b:g}")
    return out.otherwise(f"<{edges[0]:g}")


def k_anonymity(df: DataFrame, quasi: list[str]) -> DataFrame:
    """The size of the smallest group of equal quasi-identifiers; 0 without any."""
    if not quasi:
        return df.sparkSession.createDataFrame([(0,)], "k long")
    return df.groupBy(*quasi).count().agg(F.coalesce(F.min("count"), F.lit(0)).alias("k"))


def retention(created: Column, kind: Column, now: str) -> tuple[Column, Column]:
    """(expires, expired) by the class of data, at the given moment."""
    days = F.coalesce(*[F.when(kind == k, F.lit(d)) for k, d in RETENTION.items() if d])
    expires = F.date_add(created.cast("date"), days)
    return expires, F.coalesce(expires < F.lit(now).cast("date"), F.lit(False))


def chained(df: DataFrame, by: list[str], order: list[str], payload: Column) -> DataFrame:
    """``df`` with prev and hash, each entry's hash covering the one before: a fold over each entity's log."""
    import hashlib

    def step(before: str, text: str) -> tuple[str, tuple]:
        now = hashlib.sha256(f"{before}|{text}".encode()).hexdigest()
        return now, (before, now)

    rows = df.withColumn("__payload", payload)
    return folded(rows, by, order, ["__payload"], "prev string, hash string", lambda: "genesis", step).drop("__payload")


def verify_chain(log: DataFrame, by: list[str], order: list[str], payload: Column) -> DataFrame:
    """``log`` with valid: its prev is the hash before, and its hash is what its payload gives."""
    before = F.coalesce(F.lag("hash").over(W.partitionBy(*by).orderBy(*order)), F.lit("genesis"))
    return log.withColumn("valid", (F.col("prev") == before) & (F.col("hash") == F.sha2(F.concat_ws("|", "prev", payload), 256)))


def latency(df: DataFrame, column: str) -> DataFrame:
    """n, mean, population deviation, extremes and the values at ranks trunc(p * (n - 1))."""
    from ..functions import order_stats

    n = order_stats.count(df, column)
    shares = (0.5, 0.95, 0.99)
    found = order_stats.at_ranks(df, column, [int(p * (n - 1)) for p in shares])
    return df.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"), F.min(column).alias("low"), F.max(column).alias("high"), *[F.lit(found.get(int(p * (n - 1)))).alias(f"p{round(p * 100)}") for p in shares])


def cumulative(df: DataFrame, column: str, bounds: list[float]) -> DataFrame:
    """(le, n): how many values are at most each bound."""
    row = df.agg(*[F.count_if(F.col(column) <= b).alias(f"b{i}") for i, b in enumerate(bounds)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)])).alias("s")).select("s.*")


def error_budget(df: DataFrame, by: str, failed: Column, most: float) -> DataFrame:
    """Per group: error rate, what is left of the budget in percent, and whether the objective is met."""
    return df.groupBy(by).agg(F.avg(failed.cast("double")).alias("rate")).select(by, "rate", F.greatest(F.lit(0.0), F.least(F.lit(100.0), (most - F.col("rate")) / most * 100)).alias("budget"), (F.col("rate") <= most).alias("met"))


def compliance(df: DataFrame) -> DataFrame:
    """Per standard: (passed + half of partial) over applicable controls, of rows (standard, control, status)."""
    applies = F.count_if(F.col("status") != "na")
    return df.groupBy("standard").agg((F.try_divide(F.count_if(F.col("status") == "pass") + 0.5 * F.count_if(F.col("status") == "partial"), applies)).alias("score"), applies.alias("controls"), F.count_if(F.col("status") == "fail").alias("gaps"))


def rate_limit(df: DataFrame, by: str, ts: str, key: str, most: int, seconds: int, how: str = "sliding") -> DataFrame:
    """(key, accepted): sliding and token-bucket limits carry state, which a task folds for each entity; fixed windows of the clock don't."""
    if how == "fixed":
        window = F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / seconds)
        return df.select(key, (F.row_number().over(W.partitionBy(by, window).orderBy(ts, key)) <= most).alias("accepted"))
    if how == "sliding":

        def step(held: deque, t: float) -> tuple[deque, tuple]:
            while held and held[0] <= t - seconds:
                held.popleft()
            accepted = len(held) < most
            if accepted:
                held.append(t)
            return held, (accepted,)

        start: Callable[[], object] = deque
    else:

        def step(bucket: tuple, t: float) -> tuple[tuple, tuple]:
            tokens, last = bucket
            tokens = min(float(most), tokens + (0 if last is None else (t - last) * most / seconds))
            return (tokens - (tokens >= 1), t), (tokens >= 1,)

        start = lambda: (float(most), None)
    rows = df.select(by, key, (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("__t"))
    return folded(rows, [by], ["__t", key], ["__t"], "accepted boolean", start, step).select(key, "accepted")


def batches(df: DataFrame, order: list[str], size: int, by: list[str]) -> DataFrame:
    """``df`` with batch: rows in order of priority and arrival, ``size`` a batch, within each of ``by``."""
    return ranks.numbered(df, order, by).select(*df.columns, F.floor(F.col("__i") / size).cast("int").alias("batch"))


def backpressure(df: DataFrame, by: list[str], order: list[str], queue: str, capacity: int, start: int = 1000, low: int = 100, high: int = 10_000) -> DataFrame:
    """``df`` with size, the next batch's: halved where the queue is above 80 % of the capacity, else raised by a fifth, within bounds."""

    def step(size: float, waiting: int) -> tuple[float, tuple]:
        size = max(float(low), size * 0.5) if waiting > 0.8 * capacity else min(float(high), size * 1.2)
        return size, (int(size),)

    return folded(df, by, order, [queue], "size long", lambda: float(start), step)

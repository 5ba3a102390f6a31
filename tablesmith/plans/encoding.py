"""Imputation, cleaning and encoding."""

from pyspark.sql import functions as F

from tablesmith.operators import encode, impute
from tablesmith.registry import query, table

MISSING = "(SELECT event_id, ts, user_id, CASE WHEN event_id % 11 <> 0 THEN event_type END AS event_type, CASE WHEN event_id % 7 <> 0 THEN value END AS value FROM events)"


def missing(s, d):
    e = table(s, d, "events")
    return e.select("event_id", "ts", "user_id", F.when(F.col("event_id") % 11 != 0, F.col("event_type")).alias("event_type"), F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"))


def _fill(value, c="value"):
    return f"SELECT event_id, coalesce({c}, {value}) AS {c} FROM {MISSING}"


@query("impute_mean", f"SELECT event_id, round(coalesce(value, (SELECT avg(value) FROM {MISSING})), 6) AS value FROM {MISSING}")
def impute_mean(s, d):
    return impute.fill(missing(s, d).select("event_id", "value"), "value", "mean").withColumn("value", F.round("value", 6))


@query("impute_median", _fill(f"(SELECT median(value) FROM {MISSING})"))
def impute_median(s, d):
    return impute.fill(missing(s, d).select("event_id", "value"), "value", "median")


@query("impute_upper_median", _fill(f"(SELECT list_sort(list(value))[count(value) // 2 + 1] FROM {MISSING} WHERE value IS NOT NULL)"))
def impute_upper_median(s, d):
    return impute.fill(missing(s, d).select("event_id", "value"), "value", "upper_median")


@query("impute_mode", _fill(f"(SELECT event_type FROM {MISSING} WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)", "event_type"))
def impute_mode(s, d):
    return impute.fill(missing(s, d).select("event_id", "event_type"), "event_type", "mode")


@query("impute_constant", f"SELECT event_id, coalesce(value, -1) AS value, coalesce(event_type, 'missing') AS event_type FROM {MISSING}")
def impute_constant(s, d):
    out = impute.fill(missing(s, d).select("event_id", "value", "event_type"), "value", "constant", -1.0)
    return impute.fill(out, "event_type", "constant", "missing")


@query("impute_forward", f"SELECT event_id, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM {MISSING}")
def impute_forward(s, d):
    return impute.forward(missing(s, d), "value", ["user_id"], ["ts", "event_id"]).select("event_id", "value")


@query("impute_backward", f"SELECT event_id, first_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value FROM {MISSING}")
def impute_backward(s, d):
    return impute.backward(missing(s, d), "value", ["user_id"], ["ts", "event_id"]).select("event_id", "value")


@query("impute_drop", f"SELECT event_id, value, event_type FROM {MISSING} WHERE value IS NOT NULL AND event_type IS NOT NULL")
def impute_drop(s, d):
    return missing(s, d).select("event_id", "value", "event_type").dropna()


_SUPPLIERS = "(SELECT s_suppkey, CASE WHEN s_suppkey % 5 <> 0 THEN s_acctbal END AS a, CASE WHEN s_suppkey % 7 <> 0 THEN CAST(s_nationkey AS DOUBLE) END AS b FROM supplier)"


@query("impute_knn", f"""WITH p AS (SELECT m.s_suppkey, c.a AS ca, c.b AS cb, sqrt((coalesce(pow(m.a - c.a, 2), 0) + coalesce(pow(m.b - c.b, 2), 0)) / nullif((m.a IS NOT NULL)::INT + (m.b IS NOT NULL)::INT, 0)) AS dist, c.s_suppkey AS k
    FROM {_SUPPLIERS} m, {_SUPPLIERS} c WHERE (m.a IS NULL OR m.b IS NULL) AND c.a IS NOT NULL AND c.b IS NOT NULL),
    f AS (SELECT s_suppkey, avg(ca) AS a, avg(cb) AS b FROM (SELECT * FROM p WHERE dist IS NOT NULL QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY dist, k) <= 3) GROUP BY 1)
    SELECT o.s_suppkey, round(coalesce(o.a, f.a, (SELECT avg(a) FROM {_SUPPLIERS})), 6) AS a, round(coalesce(o.b, f.b, (SELECT avg(b) FROM {_SUPPLIERS})), 6) AS b FROM {_SUPPLIERS} o LEFT JOIN f USING (s_suppkey)""")
def impute_knn(s, d):
    df = table(s, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 5 != 0, F.col("s_acctbal")).alias("a"), F.when(F.col("s_suppkey") % 7 != 0, F.col("s_nationkey").cast("double")).alias("b"))
    return impute.nearest_rows(df, "s_suppkey", ["a", "b"], 3).select("s_suppkey", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


@query("impute_chained", f"SELECT s_suppkey, round(coalesce(a, avg(a) OVER ()), 6) AS a, round(coalesce(b, avg(b) OVER ()), 6) AS b FROM {_SUPPLIERS}")
def impute_chained(s, d):
    df = table(s, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 5 != 0, F.col("s_acctbal")).alias("a"), F.when(F.col("s_suppkey") % 7 != 0, F.col("s_nationkey").cast("double")).alias("b"))
    return impute.chained(df, ["a", "b"]).select("s_suppkey", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


@query("impute_chained_rounds")
def impute_chained_rounds(s, d):
    df = table(s, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 5 != 0, F.col("s_acctbal")).alias("a"), F.when(F.col("s_suppkey") % 7 != 0, F.col("s_nationkey").cast("double")).alias("b"))
    return impute.chained(df, ["a", "b"], rounds=2)


@query("auto_clean", f"""WITH u AS (SELECT DISTINCT * FROM {MISSING}) SELECT event_id, user_id, last_value(event_type IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS event_type,
    round(coalesce(value, (SELECT avg(value) FROM u)), 6) AS value FROM u""")
def auto_clean(s, d):
    e = missing(s, d)
    out = impute.clean(e.unionByName(e.where("event_id % 10 = 0")).withColumn("empty", F.lit(None).cast("double")), ["ts", "event_id"], ["user_id"])
    return out.select("event_id", "user_id", "event_type", F.round("value", 6).alias("value"))


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("encode_one_hot", "SELECT event_id, " + ", ".join(f"CAST(event_type = '{v}' AS INTEGER) AS event_type_{v}" for v in ["click", "error", "purchase", "signup", "view"]) + " FROM events")
def encode_one_hot(s, d):
    return encode.one_hot(table(s, d, "events").select("event_id", "event_type"), "event_type")


_LABEL = "(SELECT event_type AS lv, row_number() OVER (ORDER BY min(event_id), event_type) - 1 AS index FROM events GROUP BY 1)"


@query("encode_label", f"SELECT event_id, CAST(index AS INTEGER) AS event_type FROM events JOIN {_LABEL} ON lv = event_type")
def encode_label(s, d):
    df = table(s, d, "events").select("event_id", "event_type")
    return encode.lookup(df, "event_type", encode.label(df, "event_type", "event_id"), "index")


@query("encode_target", "WITH m AS (SELECT c_mktsegment AS v, avg(c_acctbal) AS m FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1) SELECT c_custkey, round(coalesce(m, (SELECT avg(m) FROM m)), 6) AS x FROM customer LEFT JOIN m ON v = c_mktsegment")
def encode_target(s, d):
    df = table(s, d, "customer")
    means, unseen = encode.target(df.where("c_custkey % 2 = 0"), "c_mktsegment", "c_acctbal")
    return encode.lookup(df.select("c_custkey", F.col("c_mktsegment").alias("x")), "x", means, "mean", unseen).withColumn("x", F.round("x", 6))


@query("encode_smoothed", "WITH g AS (SELECT avg(c_acctbal) AS g FROM customer WHERE c_nationkey < 20), m AS (SELECT c_nationkey AS v, (sum(c_acctbal) + 10 * any_value(g)) / (count(*) + 10) AS m FROM customer, g WHERE c_nationkey < 20 GROUP BY 1) SELECT c_custkey, round(coalesce(m, g), 6) AS x FROM customer CROSS JOIN g LEFT JOIN m ON v = c_nationkey")
def encode_smoothed(s, d):
    df = table(s, d, "customer")
    means, unseen = encode.smoothed(df.where("c_nationkey < 20"), "c_nationkey", "c_acctbal")
    return encode.lookup(df.select("c_custkey", F.col("c_nationkey").alias("x")), "x", means, "mean", unseen).withColumn("x", F.round("x", 6))


@query("encode_leave_one_out", "SELECT c_custkey, round(coalesce((sum(c_acctbal) OVER w - c_acctbal) / nullif(count(*) OVER w - 1, 0), avg(c_acctbal) OVER ()), 6) AS x FROM customer WINDOW w AS (PARTITION BY c_mktsegment)")
def encode_leave_one_out(s, d):
    df = table(s, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("x"), "c_acctbal")
    return encode.leave_one_out(df, "x", "c_acctbal").select("c_custkey", F.round("x", 6).alias("x"))


@query("encode_frequency", f"SELECT event_id, round(CASE WHEN event_type IS NULL THEN 0 ELSE count(event_type) OVER (PARTITION BY event_type) / count(*) OVER () END, 6) AS event_type FROM {MISSING}")
def encode_frequency(s, d):
    return encode.frequency(missing(s, d).select("event_id", "event_type"), "event_type").withColumn("event_type", F.round("event_type", 6))


@query("encode_binary", f"SELECT event_id, CAST(index & 1 AS INTEGER) AS event_type_0, CAST((index >> 1) & 1 AS INTEGER) AS event_type_1, CAST((index >> 2) & 1 AS INTEGER) AS event_type_2 FROM events JOIN {_LABEL} ON lv = event_type")
def encode_binary(s, d):
    df = table(s, d, "events").select("event_id", "event_type")
    return encode.binary(df, "event_type", encode.label(df, "event_type", "event_id"))


@query("encode_hash", "SELECT event_id, " + ", ".join(f"CASE WHEN substr(sha256('{i}:' || event_type), 1, 1) < '8' THEN 1 ELSE -1 END AS event_type_hash_{i}" for i in range(3)) + " FROM events")
def encode_hash(s, d):
    return encode.hashed(table(s, d, "events").select("event_id", "event_type"), "event_type", 3)

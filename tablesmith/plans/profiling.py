"""Previews, profiles and quality."""

from pyspark.sql import functions as F

from tablesmith.operators import profile
from tablesmith.registry import query, table

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def union(parts):
    return " UNION ALL ".join(parts)


@query("preview", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10")
def preview(s, d):
    return table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice").orderBy("o_orderkey").limit(10)


INFO = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double", "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"}


@query("data_info", union(f"SELECT '{c}' AS \"column\", '{k}' AS dtype, count(*) - count({c}) AS null_count, count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS n_unique, round((count(*) - count({c})) * 100.0 / count(*), 2) AS null_pct FROM orders" for c, k in INFO.items()))
def data_info(s, d):
    return profile.info(table(s, d, "orders").select(*INFO))


def _q(c, p, t="lineitem"):
    return f"(SELECT list_sort(list({c}))[least(CAST(floor(count(*) * {p}) AS BIGINT), count(*) - 1) + 1] FROM {t})"


@query("analyze", union(
    f"""SELECT '{c}' AS "column", round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min, round(max({c}), 4) AS max, round(median({c}), 4) AS median,
    round(any_value(a), 4) AS q25, round(any_value(b), 4) AS q75, round(skewness({c}), 4) AS skew, round(kurtosis({c}), 4) AS kurt, round(var_samp({c}), 4) AS variance, round(stddev_samp({c}) * 100 / avg({c}), 2) AS cv,
    round(max({c}) - min({c}), 4) AS range, round(any_value(b) - any_value(a), 4) AS iqr, count(*) FILTER ({c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) AS outliers, round(sum({c}), 2) AS total, count(*) FILTER ({c} = 0) AS zeros
    FROM lineitem, (SELECT {_q(c, 0.25)} AS a, {_q(c, 0.75)} AS b)""" for c in NUM))  # fmt: skip
def analyze(s, d):
    return profile.analyze(table(s, d, "lineitem").select(*NUM), NUM)


@query("feature_stats_numeric", union(f"SELECT '{c}' AS \"column\", count({c}) AS n, count(*) - count({c}) AS nulls, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS low, max({c}) AS high, round(median({c}), 6) AS median FROM part" for c in ("p_size", "p_retailprice")))
def feature_stats_numeric(s, d):
    return profile.per_column(table(s, d, "part").select(F.col("p_size").cast("double").alias("p_size"), "p_retailprice"), ["p_size", "p_retailprice"], {"n": F.count, "nulls": lambda c: F.count_if(F.col(c).isNull()), "mean": lambda c: F.round(F.avg(c), 6), "std": lambda c: F.round(F.stddev_samp(c), 6), "low": F.min, "high": F.max, "median": lambda c: F.round(F.expr(f"percentile({c}, 0.5)"), 6)})


@query("feature_stats_categorical", union(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_unique, string_agg(DISTINCT {c}, '|' ORDER BY {c}) AS categories FROM lineitem" for c in ("l_returnflag", "l_linestatus")))
def feature_stats_categorical(s, d):
    return profile.per_column(table(s, d, "lineitem"), ["l_returnflag", "l_linestatus"], {"n_unique": F.count_distinct, "categories": lambda c: F.array_join(F.array_sort(F.collect_set(c)), "|")})


@query("histogram", """WITH b AS (SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 20 AS w FROM lineitem),
    c AS (SELECT CAST(least(floor((l_extendedprice - lo) / w), 19) AS INTEGER) AS bin, count(*) AS n FROM lineitem, b GROUP BY 1)
    SELECT CAST(i AS INTEGER) AS bin, round(lo + i * w, 6) AS lower, coalesce(n, 0) AS n FROM b, range(20) t(i) LEFT JOIN c ON c.bin = i""")
def histogram(s, d):
    return profile.histogram(table(s, d, "lineitem"), "l_extendedprice").withColumn("lower", F.round("lower", 6))


@query("top_values", """WITH v AS (SELECT 'o_orderpriority' AS "column", o_orderpriority AS value FROM orders UNION ALL SELECT 'o_orderstatus', o_orderstatus FROM orders),
    c AS (SELECT "column", value, count(*) AS n FROM v GROUP BY ALL)
    SELECT "column", value, n, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS place, round(n * 100.0 / sum(n) OVER (PARTITION BY "column"), 2) AS pct FROM c QUALIFY place <= 10""")
def top_values(s, d):
    return profile.top_values(table(s, d, "orders"), ["o_orderpriority", "o_orderstatus"])


def _entropy(log):
    return union(f"""SELECT '{c}' AS "column", count(*) AS n_unique, round(-sum(n / t * {log}(n / t)), 6) AS entropy, min_by(v, struct_pack(a := -n, b := v)) AS mode
    FROM (SELECT {c} AS v, CAST(count(*) AS DOUBLE) AS n, CAST(sum(count(*)) OVER () AS DOUBLE) AS t FROM orders GROUP BY 1)""" for c in ("o_orderpriority", "o_orderstatus"))


@query("entropy_bits", _entropy("log2"))
def entropy_bits(s, d):
    return profile.entropy(table(s, d, "orders"), ["o_orderpriority", "o_orderstatus"])


@query("entropy_nats", _entropy("ln"))
def entropy_nats(s, d):
    return profile.entropy(table(s, d, "orders"), ["o_orderpriority", "o_orderstatus"], bits=False)


@query("correlation_matrix", union(f"SELECT '{a}' AS a, '{b}' AS b, round({'1.0' if a == b else f'coalesce(corr({a}, {b}), 0)'}, 6) AS r FROM lineitem" + (" LIMIT 1" if a == b else "") if a != b else f"SELECT '{a}' AS a, '{b}' AS b, 1.0::DOUBLE AS r" for a in NUM for b in NUM))
def correlation_matrix(s, d):
    return profile.correlation(table(s, d, "lineitem"), NUM).withColumn("r", F.round("r", 6))


@query("duplicate_count", "SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS distinct_rows, CAST(sum(n) - count(*) AS BIGINT) AS duplicates FROM (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL)")
def duplicate_count(s, d):
    return profile.duplicates(table(s, d, "lineitem").select("l_partkey", "l_suppkey"))


MISSING = "(SELECT CASE WHEN event_id % 7 <> 0 THEN value END AS value, value - 20 AS signed FROM events)"


def _quality(c):
    return f"""SELECT '{c}' AS "column", round(v / n, 6) AS completeness, round(u / v, 6) AS distinct_ratio, round(o / v, 6) AS outlier_ratio, round(v / n * (1 - o / v), 6) AS validity,
    round(.3 * v / n + .2 * u / v + .25 + .25 * v / n * (1 - o / v), 6) AS overall,
    array_to_string(list_filter([CASE WHEN v / n < .7 THEN 'HighMissingness' END, CASE WHEN sd < 1e-10 THEN 'ConstantColumn' END, CASE WHEN abs(sk) > 2 THEN 'HighSkewness' END, CASE WHEN abs(ku) > 7 THEN 'HighKurtosis' END,
    CASE WHEN z / v > .5 THEN 'ManyZeros' END, CASE WHEN o / v > .1 THEN 'HighOutlierRatio' END, CASE WHEN u / v > .95 AND n > 20 THEN 'HighCardinality' END], lambda x: x IS NOT NULL), ',') AS warnings
    FROM (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count({c}) AS DOUBLE) AS v, count(DISTINCT {c}) AS u, count(*) FILTER ({c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) AS o, count(*) FILTER ({c} = 0) AS z, stddev_samp({c}) AS sd, skewness({c}) AS sk, kurtosis({c}) AS ku
    FROM {MISSING}, (SELECT l[CAST(floor(len(l) * .25) AS BIGINT) + 1] AS a, l[CAST(floor(len(l) * .75) AS BIGINT) + 1] AS b FROM (SELECT list_sort(list({c}) FILTER ({c} IS NOT NULL)) AS l FROM {MISSING})))"""


@query("quality_score", union(map(_quality, ("value", "signed"))))
def quality_score(s, d):
    df = table(s, d, "events").select(F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"), (F.col("value") - 20).alias("signed"))
    return profile.quality(df, ["value", "signed"])


TYPED = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


@query("column_types", union(f"""SELECT *, CASE WHEN kind <> 'categorical' THEN 'none' WHEN n_unique <= 10 THEN 'onehot' ELSE 'target' END AS encoding FROM (SELECT '{c}' AS "column", u AS n_unique, round(u / n, 6) AS unique_ratio,
    CASE WHEN u <= 1 THEN 'constant' WHEN u / n > .95 AND u > 100 THEN 'id' WHEN u <= 50 AND u / n < .05 THEN 'categorical' ELSE 'numeric' END AS kind FROM (SELECT count(*) AS n, count(DISTINCT {c}) AS u FROM orders))""" for c in TYPED))
def column_types(s, d):
    return profile.column_types(table(s, d, "orders"), TYPED)


def _sum(f):
    return "(" + " + ".join(f(c) for c in NUM) + ")"


_CHARACTER = f"""SELECT round(sparsity, 6) AS sparsity, round(skewness, 6) AS skewness, round(missing, 6) AS missing, round(outliers, 6) AS outliers,
    CASE WHEN outliers > .05 THEN 'robust' WHEN sparsity > .5 THEN 'maxabs' WHEN skewness > 1 THEN 'minmax' ELSE 'standard' END AS scaler FROM (SELECT {_sum(lambda c: f'count(*) FILTER ({c} = 0)')} / (count(*) * 4.0) AS sparsity,
    {_sum(lambda c: f'abs(skewness({c}) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1.0)))')} / 4 AS skewness, {_sum(lambda c: f'count(*) FILTER ({c} IS NULL)')} / (count(*) * 4.0) AS missing,
    {_sum(lambda c: f'count(*) FILTER (abs({c} - m_{c}) > 3 * s_{c})')} / (count(*) * 4.0) AS outliers
    FROM lineitem, (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in NUM)} FROM lineitem))"""


@query("dataset_characteristics", _CHARACTER)
def dataset_characteristics(s, d):
    return profile.characteristics(table(s, d, "lineitem").select(*NUM), NUM)


@query("distribution_fingerprint", union(f"SELECT '{c}' AS \"column\", round(avg({c}), 6) AS mean, round(var_pop({c}), 4) AS variance, round(skewness({c}) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1.0)), 6) AS skew, round(kurtosis_pop({c}), 6) AS kurt FROM lineitem" for c in NUM))
def distribution_fingerprint(s, d):
    return profile.fingerprint(table(s, d, "lineitem"), NUM)


@query("distribution_shift", "SELECT 'value' AS \"column\", round((b.m - a.m) / a.s, 6) AS z, abs((b.m - a.m) / a.s) > 3 AS shifted FROM (SELECT avg(value) AS m, greatest(stddev_pop(value), 1e-10) AS s FROM events WHERE event_id % 2 = 0) a, (SELECT avg(value) AS m FROM events WHERE event_id % 2 = 1) b")
def distribution_shift(s, d):
    e = table(s, d, "events")
    return profile.shifted(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["value"])


@query("datasheet", union(f"SELECT '{c}' AS \"column\", round((count(*) - count({c})) / count(*), 6) AS missing_ratio, count(DISTINCT {c}) AS n_unique FROM customer" for c in ("c_nationkey", "c_mktsegment", "c_acctbal")))
def datasheet(s, d):
    return profile.per_column(table(s, d, "customer"), ["c_nationkey", "c_mktsegment", "c_acctbal"], {"missing_ratio": lambda c: F.round(F.count_if(F.col(c).isNull()) / F.count(F.lit(1)), 6), "n_unique": F.count_distinct})


@query("class_distribution", "SELECT c_mktsegment AS class, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM customer GROUP BY 1")
def class_distribution(s, d):
    from pyspark.sql import Window as W

    counts = table(s, d, "customer").groupBy(F.col("c_mktsegment").alias("class")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy()), 6))


@query("content_hash", "SELECT 'nation' AS name, count(*) AS rows, sha256(string_agg(sha256(concat_ws('|', n_nationkey, n_name, n_regionkey)), '' ORDER BY sha256(concat_ws('|', n_nationkey, n_name, n_regionkey)))) AS hash FROM nation")
def content_hash(s, d):
    """A table's hash: of its rows' hashes in order; meant for reference tables."""
    rows = table(s, d, "nation").select(F.sha2(F.concat_ws("|", "n_nationkey", "n_name", "n_regionkey"), 256).alias("h"))
    return rows.agg(F.lit("nation").alias("name"), F.count("*").alias("rows"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("hash"))

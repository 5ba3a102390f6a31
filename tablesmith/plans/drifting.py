"""Drift and anomalies."""

from pyspark.sql import functions as F

from tablesmith.operators import anomaly, drift
from tablesmith.registry import query, table

SPLIT = "(SELECT value, ts < (SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM events) AS side FROM events)"


def split(s, d):
    e = table(s, d, "events")
    low, high = e.agg(F.min("ts"), F.max("ts")).first()
    return e.select("value", (F.col("ts") < F.lit(low + (high - low) / 2)).alias("side"))


_KS = f"""SELECT 'ks' AS test, max(abs(fa - fb)) AS score, any_value(bound) AS bound FROM (SELECT sum(a) OVER (ORDER BY value) / n AS fa, sum(b) OVER (ORDER BY value) / m AS fb, 1.36 * sqrt((n + m) / (n * m)) AS bound
    FROM (SELECT value, count(*) FILTER (side) AS a, count(*) FILTER (NOT side) AS b FROM {SPLIT} GROUP BY 1), (SELECT CAST(count(*) FILTER (side) AS DOUBLE) AS n, CAST(count(*) FILTER (NOT side) AS DOUBLE) AS m FROM {SPLIT}))"""
_PSI = f"""SELECT 'psi' AS test, sum((q - p) * ln(q / p)) AS score, .1 AS bound FROM (SELECT i, greatest(count(*) FILTER (side) / any_value(n), 1e-4) AS p, greatest(count(*) FILTER (NOT side) / any_value(m), 1e-4) AS q
    FROM range(10) t(i) LEFT JOIN (SELECT side, len(list_filter(cuts, lambda e: e < value)) AS bin FROM {SPLIT}, (SELECT list_transform(range(1, 10), lambda i: l[i * len(l) // 10 + 1]) AS cuts FROM (SELECT list_sort(list(value)) AS l FROM {SPLIT} WHERE side))) ON bin = i,
    (SELECT CAST(count(*) FILTER (side) AS DOUBLE) AS n, CAST(count(*) FILTER (NOT side) AS DOUBLE) AS m FROM {SPLIT}) GROUP BY 1)"""
_JS = f"""SELECT 'js' AS test, (sum(p * ln(p / ((p + q) / 2))) + sum(q * ln(q / ((p + q) / 2)))) / 2 / ln(2) AS score, .1 AS bound FROM (SELECT i, count(side) FILTER (side) / any_value(n) + 1e-10 AS p, count(side) FILTER (NOT side) / any_value(m) + 1e-10 AS q
    FROM range(20) t(i) LEFT JOIN (SELECT side, least(floor((value - lo) / w), 19) AS bin FROM {SPLIT}, (SELECT min(value) AS lo, (max(value) - min(value)) / 20 AS w FROM events)) ON bin = i,
    (SELECT CAST(count(*) FILTER (side) AS DOUBLE) AS n, CAST(count(*) FILTER (NOT side) AS DOUBLE) AS m FROM {SPLIT}) GROUP BY 1)"""


def _report(sql, twice="1.5"):
    return f"SELECT test, round(score, 6) AS score, round(bound, 6) AS bound, CASE WHEN score > {twice} * bound THEN 2 WHEN score > bound THEN 1 ELSE 0 END AS severity FROM ({sql})"


def _rounded(df):
    return df.select("test", F.round("score", 6).alias("score"), F.round("bound", 6).alias("bound"), "severity")


@query("drift_ks", _report(_KS))
def drift_ks(s, d):
    return _rounded(drift.ks(split(s, d), "value", "side"))


@query("drift_psi", _report(_PSI, "2"))
def drift_psi(s, d):
    return _rounded(drift.psi(split(s, d), "value", "side"))


@query("drift_js", _report(_JS, "2"))
def drift_js(s, d):
    return _rounded(drift.js(split(s, d), "value", "side"))


@query("drift_vote", f"SELECT 'value' AS \"column\", count(*) FILTER (severity > 0) AS votes, round(avg(score), 6) AS score, max(severity) AS severity, count(*) FILTER (severity > 0) >= 2 AS drift FROM ({_report(_KS)} UNION ALL {_report(_PSI, '2')} UNION ALL {_report(_JS, '2')})")
def drift_vote(s, d):
    return drift.vote(split(s, d), "value", "side").withColumn("score", F.round("score", 6))


_SIDE = "(SELECT count(value) AS n, avg(value) AS m, stddev_pop(value) AS sd, list_sort(list(value)) AS l FROM {} WHERE {})"
_Q = ", ".join(f"round({t}.l[least(CAST(floor({t}.n * {p}) AS BIGINT), {t}.n - 1) + 1], 6) AS q{k}_{name}" for t, name in (("x", "before"), ("y", "after")) for k, p in ((25, ".25"), (50, ".5"), (75, ".75")))


def _whole(c, source):
    ask = lambda sql: sql.replace(SPLIT, "@").replace("FROM events)", f"FROM {source})").replace("@", source)
    tests = " UNION ALL ".join(ask(_report(q, k)) for q, k in ((_KS, "1.5"), (_PSI, "2"), (_JS, "2")))
    return f"""SELECT '{c}' AS "column", x.n AS n_before, round(x.m, 6) AS mean_before, round(x.sd, 6) AS std_before, y.n AS n_after, round(y.m, 6) AS mean_after, round(y.sd, 6) AS std_after, {_Q}, round(k, 6) AS ks, round(p, 6) AS psi, round(j, 6) AS js, votes, votes >= 2 AS drift, CASE WHEN votes >= 2 THEN top ELSE 0 END AS severity
    FROM {_SIDE.format(source, 'side')} x, {_SIDE.format(source, 'NOT side')} y, (SELECT max(score) FILTER (test = 'ks') AS k, max(score) FILTER (test = 'psi') AS p, max(score) FILTER (test = 'js') AS j, count(*) FILTER (severity > 0) AS votes, max(severity) AS top FROM ({tests}))"""


_SHIFTED = "(SELECT value * 1.25 + 3 * CAST(NOT side AS INTEGER) AS value, side FROM " + SPLIT + ")"


@query("drift_features", _whole("value", SPLIT) + " UNION ALL " + _whole("shifted", _SHIFTED))
def drift_features(s, d):
    rows = split(s, d).withColumn("shifted", F.col("value") * 1.25 + 3 * (~F.col("side")).cast("int"))
    out = drift.report(rows, ["value", "shifted"], "side")
    return out.select("column", *[F.round(c, 6).alias(c) if c.split("_")[0] not in ("n", "column", "votes", "drift", "severity") else c for c in out.columns if c != "column"])


_RUN = "OVER (PARTITION BY user_id % 8 ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_DDM = f"""SELECT event_id, round(p, 6) AS p, round(s, 6) AS s, CASE WHEN low IS NULL THEN 0 WHEN p + s > low.p + 3 * low.s THEN 2 WHEN p + s > low.p + 2 * low.s THEN 1 ELSE 0 END AS level FROM (
    SELECT *, min(CASE WHEN n >= 30 THEN struct_pack(sum := p + s, p := p, s := s) END) OVER (PARTITION BY g ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS low FROM (
    SELECT *, sqrt(p * (1 - p) / n) AS s FROM (SELECT event_id, ts, user_id % 8 AS g, count(*) {_RUN} AS n, sum(CAST(event_type = 'error' AS DOUBLE)) {_RUN} / count(*) {_RUN} AS p FROM events)))"""


def errors(s, d):
    return table(s, d, "events").select("event_id", "ts", (F.col("user_id") % 8).alias("g"), (F.col("event_type") == "error").alias("error"), "value")


@query("drift_ddm", _DDM)
def drift_ddm(s, d):
    return drift.ddm(errors(s, d), ["g"], ["ts", "event_id"], "error").select("event_id", F.round("p", 6).alias("p"), F.round("s", 6).alias("s"), "level")


_O = "OVER (PARTITION BY g ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_EDDM = f"""SELECT event_id, errors, round(mean, 5) AS mean, CASE WHEN ratio < .9 THEN 2 WHEN ratio < .95 THEN 1 ELSE 0 END AS level FROM (SELECT *, (mean + 2 * std) / max(CASE WHEN errors >= 30 THEN mean + 2 * std END) {_O} AS ratio FROM (
    SELECT *, sqrt(greatest(0, coalesce(sum(dist * dist) {_O}, 0) / errors - mean * mean)) AS std FROM (SELECT *, coalesce(sum(dist) {_O}, 0) / errors AS mean FROM (
    SELECT event_id, ts, g, CAST(i - lag(i) OVER (PARTITION BY g ORDER BY ts, event_id) AS DOUBLE) AS dist, row_number() OVER (PARTITION BY g ORDER BY ts, event_id) AS errors FROM (
    SELECT event_id, ts, event_type, user_id % 8 AS g, row_number() OVER (PARTITION BY user_id % 8 ORDER BY ts, event_id) AS i FROM events) WHERE event_type = 'error'))))"""


@query("drift_eddm", _EDDM)
def drift_eddm(s, d):
    return drift.eddm(errors(s, d), ["g"], ["ts", "event_id"], "error").select("event_id", "errors", F.round("mean", 5).alias("mean"), "level")


@query("drift_ddm_eddm", f"SELECT event_id, CASE WHEN a.level > 0 AND b.level > 0 THEN 'drift' WHEN a.level > 0 OR b.level > 0 THEN 'warning' ELSE 'none' END AS state FROM ({_DDM}) a JOIN ({_EDDM}) b USING (event_id)")
def drift_ddm_eddm(s, d):
    rows = errors(s, d)
    a = drift.ddm(rows, ["g"], ["ts", "event_id"], "error").select("event_id", F.col("level").alias("a"))
    b = drift.eddm(rows, ["g"], ["ts", "event_id"], "error").select("event_id", F.col("level").alias("b"))
    state = F.when((F.col("a") > 0) & (F.col("b") > 0), "drift").when((F.col("a") > 0) | (F.col("b") > 0), "warning").otherwise("none")
    return a.join(b, "event_id").select("event_id", state.alias("state"))


_PH = """WITH RECURSIVE o AS (SELECT event_id, user_id % 8 AS g, value AS v, row_number() OVER (PARTITION BY user_id % 8 ORDER BY ts, event_id) AS i FROM events),
    c AS (SELECT event_id, g, i, v AS mean, 0 + v - v - .005::DOUBLE AS total, least(0::DOUBLE, 0 + v - v - .005::DOUBLE) AS low FROM o WHERE i = 1
    UNION ALL SELECT event_id, g, i, m, t, least(low, t) FROM (SELECT o.event_id, o.g, o.i, .9999::DOUBLE * c.mean + (1 - .9999::DOUBLE) * o.v AS m, c.total + (o.v - (.9999::DOUBLE * c.mean + (1 - .9999::DOUBLE) * o.v) - .005::DOUBLE) AS t, c.low AS low FROM c JOIN o ON o.g = c.g AND o.i = c.i + 1))
    SELECT event_id, round(total - low, 4) AS sum, total - low > 50 AS drift FROM c"""


@query("drift_page_hinkley", _PH)
def drift_page_hinkley(s, d):
    return drift.page_hinkley(errors(s, d), ["g"], ["ts", "event_id"], "value", "event_id").withColumn("sum", F.round("sum", 4))


@query("drift_adwin")
def drift_adwin(s, d):
    return drift.adwin(errors(s, d).withColumn("x", F.col("error").cast("double")), ["g"], ["ts", "event_id"], "x", "event_id")


@query("anomaly_zscore", "SELECT o_orderkey, round(abs((o_totalprice - m) / s), 6) AS score, CASE WHEN abs((o_totalprice - m) / s) > 2 THEN -1 ELSE 1 END AS label FROM orders, (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders)")
def anomaly_zscore(s, d):
    return anomaly.zscore(table(s, d, "orders"), ["o_totalprice"], 2.0).select("o_orderkey", F.round("score", 6).alias("score"), "label")


_F = "(SELECT l[len(l) // 4 + 1] AS a, l[len(l) * 3 // 4 + 1] AS b FROM (SELECT list_sort(list({c})) AS l FROM part))"


@query("anomaly_iqr_votes", f"SELECT p_partkey, score, CASE WHEN score >= 1 THEN -1 ELSE 1 END AS label FROM (SELECT p_partkey, CAST(p_size < x.a - .2 * (x.b - x.a) OR p_size > x.b + .2 * (x.b - x.a) AS INTEGER) + CAST(p_retailprice < y.a - .2 * (y.b - y.a) OR p_retailprice > y.b + .2 * (y.b - y.a) AS INTEGER) AS score FROM part, {_F.format(c='p_size')} x, {_F.format(c='p_retailprice')} y)")
def anomaly_iqr_votes(s, d):
    return anomaly.iqr_votes(table(s, d, "part"), ["p_size", "p_retailprice"], 0.2).select("p_partkey", "score", "label")


@query("anomaly_mahalanobis", """WITH m AS (SELECT avg(p_size) AS ma, avg(p_retailprice) AS mb, var_samp(p_size) + 1e-6 AS va, var_samp(p_retailprice) + 1e-6 AS vb, covar_samp(p_size, p_retailprice) AS c, count(*) AS n FROM part),
    s AS (SELECT p_partkey, n, sqrt((vb * pow(p_size - ma, 2) - 2 * c * (p_size - ma) * (p_retailprice - mb) + va * pow(p_retailprice - mb, 2)) / (va * vb - c * c)) AS score FROM part, m)
    SELECT p_partkey, round(score, 6) AS score, CASE WHEN score >= (SELECT list_reverse_sort(list(score))[CAST(floor(.05 * any_value(n)) AS BIGINT) + 1] FROM s) - 1e-12 THEN -1 ELSE 1 END AS label FROM s""")
def anomaly_mahalanobis(s, d):
    df = table(s, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return anomaly.mahalanobis(df, ["p_size", "p_retailprice"]).select("p_partkey", F.round("score", 6).alias("score"), "label")


@query("anomaly_ood", """WITH m AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders WHERE o_orderkey % 2 = 0), t AS (SELECT abs(o_totalprice - m) / s AS z FROM orders, m WHERE o_orderkey % 2 = 0),
    b AS (SELECT list_sort(list(z))[CAST(ceil(.95 * count(*)) AS BIGINT)] AS b FROM t) SELECT o_orderkey, round(abs(o_totalprice - m) / s, 6) AS score, abs(o_totalprice - m) / s > b + 1e-12 AS "out" FROM orders, m, b WHERE o_orderkey % 2 = 1""")
def anomaly_ood(s, d):
    df = table(s, d, "orders")
    return anomaly.ood(df.where("o_orderkey % 2 = 0"), df.where("o_orderkey % 2 = 1"), ["o_totalprice"]).select("o_orderkey", F.round("score", 6).alias("score"), "out")


_VEC = "(SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"
NEAR = f"SELECT a.vec_id, b.vec_id AS near, list_distance(a.v, b.v) AS dist, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS rank FROM {_VEC} a, {_VEC} b WHERE a.vec_id <> b.vec_id QUALIFY rank <= 5"


def vectors(s, d):
    return table(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")


@query("anomaly_lof", f"""WITH n AS ({NEAR}), r AS (SELECT vec_id AS near, max(dist) AS radius FROM n GROUP BY 1), d AS (SELECT vec_id, count(*) / sum(greatest(dist, radius)) AS density FROM n JOIN r USING (near) GROUP BY 1)
    SELECT n.vec_id, round(avg(o.density) / max(d.density), 5) AS lof FROM n JOIN d o ON o.vec_id = n.near JOIN d ON d.vec_id = n.vec_id GROUP BY 1""")
def anomaly_lof(s, d):
    return anomaly.lof(vectors(s, d), "vec_id", "v", 5).withColumn("lof", F.round("lof", 5))


@query("anomaly_isolation_forest")
def anomaly_isolation_forest(s, d):
    return anomaly.isolation_forest(table(s, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice"), "p_partkey", ["p_size", "p_retailprice"])

"""Windows, calendars, decomposition and time-ordered folds."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tablesmith.operators import timeseries as ts
from tablesmith.registry import query, table

BY, ORDER = ["user_id"], ["ts", "event_id"]
W = "OVER (PARTITION BY user_id ORDER BY ts, event_id"


@query("window_lag", f"SELECT event_id, lag(value, 1, 0.0) {W}) AS lag1, lag(value, 3, 0.0) {W}) AS lag3 FROM events")
def window_lag(s, d):
    w = ts.over(BY, ORDER)
    return table(s, d, "events").select("event_id", ts.lag("value", 1, w).alias("lag1"), ts.lag("value", 3, w).alias("lag3"))


R = f"{W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"


@query("window_rolling", f"SELECT event_id, " + ", ".join(f"round({sql} {R}, 6) AS {n}" for n, sql in {"mean": "avg(value)", "sum": "sum(value)", "min": "min(value)", "max": "max(value)", "std": "stddev_pop(value)", "median": "median(value)"}.items()) + " FROM events")
def window_rolling(s, d):
    w = ts.over(BY, ORDER)
    return table(s, d, "events").select("event_id", *[F.round(ts.rolling("value", 5, w, n), 6).alias(n) for n in ("mean", "sum", "min", "max", "std", "median")])


_M = f"list(value) {R}"
_MOMENT = "list_avg(list_transform(l, lambda x: pow(x - list_avg(l), {k})))"


@query("window_moments", f"""SELECT event_id, round(CASE WHEN len(l) < 3 OR list_stddev_pop(l) < 1e-12 THEN 0 ELSE m3 / pow(m2, 1.5) END, 5) AS skew, round(CASE WHEN len(l) < 4 OR list_stddev_pop(l) < 1e-12 THEN 0 ELSE m4 / (m2 * m2) - 3 END, 5) AS kurt
    FROM (SELECT event_id, l, {_MOMENT.format(k=2)} AS m2, {_MOMENT.format(k=3)} AS m3, {_MOMENT.format(k=4)} AS m4 FROM (SELECT event_id, {_M} AS l FROM events))""")
def window_moments(s, d):
    w = ts.over(BY, ORDER)
    return table(s, d, "events").select("event_id", *[F.round(ts.rolling("value", 5, w, n), 5).alias(n) for n in ("skew", "kurt")])


@query("window_diff", f"SELECT event_id, round(value - lag(value, 1) {W}), 6) AS d1, round(value - lag(value, 2) {W}), 6) AS d2 FROM events")
def window_diff(s, d):
    w = ts.over(BY, ORDER)
    return table(s, d, "events").select("event_id", F.round(ts.diff("value", 1, w), 6).alias("d1"), F.round(ts.diff("value", 2, w), 6).alias("d2"))


@query("window_ewm", f"""WITH RECURSIVE o AS (SELECT event_id, user_id, value, row_number() {W}) AS i FROM events),
    e AS (SELECT event_id, user_id, i, value AS e FROM o WHERE i = 1 UNION ALL SELECT o.event_id, o.user_id, o.i, .4 * o.value + .6 * e.e FROM e JOIN o ON o.user_id = e.user_id AND o.i = e.i + 1)
    SELECT event_id, round(e, 6) AS ewm FROM e""")
def window_ewm(s, d):
    return ts.ewm(table(s, d, "events"), "value", BY, ORDER, 4, "event_id").withColumn("ewm", F.round("ewm", 6))


_DAYS = "CAST(floor(epoch(ts) / 86400) AS BIGINT)"


@query("calendar_approximate", f"""SELECT event_id, CAST(floor(days / 365.25) + 1970 AS BIGINT) AS year, CAST(mo AS BIGINT) AS month, (days + 4) % 7 AS dow, CAST(floor((secs % 86400) / 3600) AS BIGINT) AS hour, CAST(floor((days % 365) / 7) + 1 AS BIGINT) AS week,
    CAST(floor((mo - 1) / 3) + 1 AS BIGINT) AS quarter, CAST((days + 4) % 7 >= 5 AS INTEGER) AS is_weekend FROM (SELECT event_id, {_DAYS} AS days, CAST(floor(epoch(ts)) AS BIGINT) AS secs, least(floor(({_DAYS} % 365) / 30.44) + 1, 12) AS mo FROM events)""")
def calendar_approximate(s, d):
    fields = ts.calendar_approximate(F.col("ts"))
    return table(s, d, "events").select("event_id", *[c.cast("int" if n == "is_weekend" else "long").alias(n) for n, c in fields.items()])


@query("calendar_exact", "SELECT event_id, year(ts) AS year, month(ts) AS month, day(ts) AS day, dayofweek(ts) AS dow, hour(ts) AS hour, week(ts) AS week, quarter(ts) AS quarter, CAST(dayofweek(ts) IN (0, 6) AS INTEGER) AS is_weekend FROM events")
def calendar_exact(s, d):
    return table(s, d, "events").select("event_id", *[c.cast("int" if n == "is_weekend" else "long").alias(n) for n, c in ts.calendar(F.col("ts")).items()])


@query("calendar_cyclical", "SELECT event_id, round(sin(hour(ts) * 2 * pi() / 24), 6) AS hour_sin, round(cos(hour(ts) * 2 * pi() / 24), 6) AS hour_cos FROM events")
def calendar_cyclical(s, d):
    a, b = ts.cyclical(F.hour("ts"), 24)
    return table(s, d, "events").select("event_id", F.round(a, 6).alias("hour_sin"), F.round(b, 6).alias("hour_cos"))


DAILY = "(SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, o_orderstatus AS status, sum(o_totalprice) AS x FROM orders GROUP BY ALL)"


def daily(s, d):
    return table(s, d, "orders").groupBy(F.col("o_orderdate").cast("date").cast("string").alias("day"), F.col("o_orderstatus").alias("status")).agg(F.sum("o_totalprice").alias("x"))


P = "OVER (PARTITION BY status ORDER BY day"


@query("difference_seasonal", f"SELECT day, status, round(x - lag(x) {P}), 2) AS x FROM (SELECT day, status, x - lag(x, 7) {P}) AS x FROM {DAILY} QUALIFY lag(x, 7) {P}) IS NOT NULL) QUALIFY lag(x) {P}) IS NOT NULL")
def difference_seasonal(s, d):
    return ts.difference(daily(s, d), "x", ts.over(["status"], ["day"]), 1, 7).withColumn("x", F.round("x", 2))


@query("difference_inverse", f"SELECT day, status, round(x, 2) AS x FROM {DAILY}")
def difference_inverse(s, d):
    w = ts.over(["status"], ["day"])
    steps = daily(s, d).withColumn("step", F.coalesce(ts.diff("x", 1, w), F.col("x")))
    return steps.select("day", "status", F.round(F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("x"))


def _decompose(op, inv):
    return f"""WITH r AS (SELECT day, status, x, avg(x) {P} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS trend, (row_number() {P}) - 1) % 7 AS p FROM {DAILY}),
    q AS (SELECT status, p, avg(x {op} trend) AS s FROM r GROUP BY ALL), c AS (SELECT status, p, s {op} avg(s) OVER (PARTITION BY status) AS seasonal FROM q)
    SELECT day, status, round(trend, 2) AS trend, round(seasonal, {4 if op == '/' else 2}) AS seasonal, round({inv}, {4 if op == '/' else 2}) AS residual FROM r JOIN c USING (status, p)"""


@query("decompose_additive", _decompose("-", "x - trend - seasonal"))
def decompose_additive(s, d):
    out = ts.decompose(daily(s, d), "x", ["status"], ["day"], 7)
    return out.select("day", "status", *[F.round(c, 2).alias(c) for c in ("trend", "seasonal", "residual")])


@query("decompose_multiplicative", _decompose("/", "x / (trend * seasonal)"))
def decompose_multiplicative(s, d):
    out = ts.decompose(daily(s, d), "x", ["status"], ["day"], 7, multiplicative=True)
    return out.select("day", "status", F.round("trend", 2).alias("trend"), F.round("seasonal", 4).alias("seasonal"), F.round("residual", 4).alias("residual"))


@query("deseasonalize", f"WITH r AS (SELECT day, status, x, (row_number() {P}) - 1) % 7 AS p FROM {DAILY}), q AS (SELECT status, p, avg(x) AS s FROM r GROUP BY ALL) SELECT day, status, round(x - s, 2) AS x FROM r JOIN q USING (status, p)")
def deseasonalize(s, d):
    rows = ts.seasonal_means(daily(s, d), "x", ["status"], ["day"], 7)
    return rows.select("day", "status", F.round(F.col("x") - F.col("pattern"), 2).alias("x"))


@query("reseasonalize", f"SELECT day, status, round(x, 2) AS x FROM {DAILY}")
def reseasonalize(s, d):
    rows = ts.seasonal_means(daily(s, d), "x", ["status"], ["day"], 7).withColumn("x", F.col("x") - F.col("pattern"))
    return rows.select("day", "status", F.round(F.col("x") + F.col("pattern"), 2).alias("x"))


@query("transform_chain", f"SELECT day, status, round((pow(ln(x + 1) + 1, .5) - 1) / .5, 6) AS y, round(x, 4) AS x FROM {DAILY}")
def transform_chain(s, d):
    y = ts.chain(F.col("x"), lam=0.5)
    return daily(s, d).select("day", "status", F.round(y, 6).alias("y"), F.round(ts.unchained(y, lam=0.5), 4).alias("x"))


@query("log_chain", f"SELECT day, status, round(ln(x + 1), 6) AS x FROM {DAILY}")
def log_chain(s, d):
    return daily(s, d).select("day", "status", F.round(F.log1p("x"), 6).alias("x"))


def _folds(values):
    return " UNION ALL ".join(f"SELECT {f} AS fold, 'train' AS role, CAST(i AS INTEGER) AS row_idx FROM range({a}, {b}) t(i) UNION ALL SELECT {f}, 'test', CAST(i AS INTEGER) FROM range({c}, {e}) t(i)" for f, a, b, c, e in values)


@query("folds_expanding", _folds([(0, 0, 14, 14, 16), (1, 0, 16, 16, 18), (2, 0, 18, 18, 20)]))
def folds_expanding(s, d):
    return ts.folds(s, 20, ts.expanding(20, 3, 2))


@query("folds_walking", _folds([(0, 0, 10, 10, 12), (1, 0, 13, 13, 15), (2, 0, 16, 16, 18)]))
def folds_walking(s, d):
    return ts.folds(s, 20, ts.walking(20, 10, 3, 2))


@query("folds_blocked", _folds([(1, 0, 4, 5, 10), (2, 0, 9, 10, 15), (3, 0, 14, 15, 20)]))
def folds_blocked(s, d):
    return ts.folds(s, 20, ts.blocked(20, 4, 1))


@query("folds_purged", _folds([(0, 0, 5, 7, 14), (1, 0, 12, 14, 21), (2, 0, 19, 21, 28)]))
def folds_purged(s, d):
    return ts.folds(s, 30, ts.purged(30, 3, 2))

"""Preprocessors, plans, the quality gate and choices."""

from pyspark.sql import functions as F

from tablesmith.operators import choose, prepare, profile
from tablesmith.registry import query, table

#: Orders with holes: a number, a class and a mostly empty column.
HOLES = """(SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS price, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority END AS priority, o_orderstatus AS status, CAST(o_custkey % 5 AS DOUBLE) AS small,
    CASE WHEN o_orderkey % 10 = 0 THEN 1.5 + o_orderkey END AS rare, 'x' AS same FROM orders)"""


def holes(s, d):
    k = F.col("o_orderkey")
    return table(s, d, "orders").select(
        "o_orderkey", F.when(k % 7 != 0, F.col("o_totalprice")).alias("price"), F.when(k % 11 != 0, F.col("o_orderpriority")).alias("priority"), F.col("o_orderstatus").alias("status"),
        (F.col("o_custkey") % 5).cast("double").alias("small"), F.when(k % 10 == 0, 1.5 + k).cast("double").alias("rare"), F.lit("x").alias("same"),
    )


PRIORITIES, STATUSES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"], ["F", "O", "P"]
_MODE = f"(SELECT priority FROM {HOLES} WHERE priority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, priority LIMIT 1)"
_FILLED = f"(SELECT o_orderkey, coalesce(price, (SELECT avg(price) FROM {HOLES})) AS price, coalesce(priority, {_MODE}) AS priority, status FROM {HOLES})"
_SCALED = "round((price - avg(price) OVER ()) / stddev_samp(price) OVER (), 6) + 0.0 AS price"


def _shown(df, columns):
    return df.select("o_orderkey", (F.round("price", 6) + 0.0).alias("price"), *columns)


@query("preprocess_pipeline", f"SELECT o_orderkey, {_SCALED}, " + ", ".join(f"CAST(priority = '{v}' AS INTEGER) AS \"priority_{v}\"" for v in PRIORITIES) + ", " + ", ".join(f"CAST(status = '{v}' AS INTEGER) AS \"status_{v}\"" for v in STATUSES) + f" FROM {_FILLED}")
def preprocess_pipeline(s, d):
    df = holes(s, d).select("o_orderkey", "price", "priority", "status")
    made = prepare.Preprocessor.from_json(prepare.Preprocessor().fit(df, ["price", "priority", "status"]).to_json()).transform(df)
    return _shown(made, [*[f"priority_{v}" for v in PRIORITIES], *[f"status_{v}" for v in STATUSES]])


@query("preprocess_robust_label", f"""WITH f AS (SELECT o_orderkey, coalesce(price, (SELECT median(price) FROM {HOLES})) AS price, coalesce(priority, {_MODE}) AS priority FROM {HOLES}),
    l AS (SELECT list_sort(list(price)) AS l, median(price) AS m FROM f) SELECT o_orderkey, round((price - m) / (l[CAST(floor(.75 * len(l)) AS BIGINT) + 1] - l[CAST(floor(.25 * len(l)) AS BIGINT) + 1]), 6) + 0.0 AS price, CAST(dense_rank() OVER (ORDER BY priority) - 1 AS INTEGER) AS priority FROM f, l""")
def preprocess_robust_label(s, d):
    df = holes(s, d).select("o_orderkey", "price", "priority")
    fitted = prepare.Preprocessor(fill="median", scaler="robust", encoder="label").fit(df, ["price", "priority"])
    return _shown(fitted.transform(df), ["priority"])


@query("preprocess_inverse", f"SELECT o_orderkey, round(price, 4) AS price FROM {_FILLED}")
def preprocess_inverse(s, d):
    df = holes(s, d).select("o_orderkey", "price")
    fitted = prepare.Preprocessor(scaler="minmax").fit(df, ["price"])
    return fitted.inverse(fitted.transform(df)).select("o_orderkey", F.round("price", 4).alias("price"))


@query("preprocess_partial_fit", f"SELECT count(price) AS n, round(avg(price), 4) AS mean, round(stddev_samp(price), 4) AS std, min(price) AS low, max(price) AS high FROM {HOLES}")
def preprocess_partial_fit(s, d):
    df = holes(s, d).select("o_orderkey", "price")
    fitted = prepare.Preprocessor().fit(df.where("o_orderkey % 3 = 0"), ["price"])
    for i in (1, 2):
        fitted.partial_fit(df.where(f"o_orderkey % 3 = {i}"))
    m = fitted.running["price"]
    return s.createDataFrame([(m.n, round(m.mean, 4), round(m.std, 4), m.low, m.high)], "n long, mean double, std double, low double, high double")


PLANNED = ["o_orderkey", "price", "priority", "status", "small", "rare", "same"]
_FACTS = " UNION ALL ".join(
    f"SELECT {i} AS i, '{c}' AS c, {c in ('price', 'small', 'rare', 'o_orderkey')} AS num, {c in ('price', 'small', 'rare')} AS fractional, count(*) AS n, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS u, {f'skewness({c})' if c in ('price', 'small', 'rare', 'o_orderkey') else '0'} AS skew FROM {HOLES}"
    for i, c in enumerate(PLANNED)
)
_PLAN = f"""WITH f AS (SELECT *, NOT num OR (u <= 50 AND u / n < .05) AS cat, u <= 1 OR (u / n > .95 AND u > 100 AND NOT fractional) AS gone FROM ({_FACTS})), k AS (SELECT *, missing / n > .5 AS empty FROM f WHERE NOT gone),
    p AS (SELECT 0 AS place, 'drop' AS action, 'unusable' AS method, c, i FROM f WHERE gone UNION ALL SELECT 1, 'drop', 'missing', c, i FROM k WHERE empty UNION ALL SELECT 2, 'impute', 'median', c, i FROM k WHERE missing > 0 AND NOT empty AND NOT cat
    UNION ALL SELECT 3, 'impute', 'mode', c, i FROM k WHERE missing > 0 AND NOT empty AND cat UNION ALL SELECT 4, 'encode', 'one_hot', c, i FROM k WHERE cat AND u <= 10 AND NOT empty UNION ALL SELECT 5, 'encode', 'frequency', c, i FROM k WHERE cat AND u > 10 AND NOT empty
    UNION ALL SELECT 6, 'outliers', 'clip', c, i FROM k WHERE NOT cat AND NOT empty UNION ALL SELECT 7, 'transform', 'yeo_johnson', c, i FROM k WHERE NOT cat AND NOT empty AND abs(skew) > 2 UNION ALL SELECT 8, 'scale', 'standard', c, i FROM k WHERE NOT cat AND NOT empty)
    SELECT CAST(dense_rank() OVER (ORDER BY place) - 1 AS INTEGER) AS place, action, method, columns FROM (SELECT place, action, method, string_agg(c, ',' ORDER BY i) AS columns FROM p GROUP BY ALL)"""


@query("compose_plan", _PLAN)
def compose_plan(s, d):
    df = holes(s, d)
    steps = prepare.compose(prepare.detected(df, PLANNED))
    return s.createDataFrame([(i, x.action, x.method, ",".join(x.columns)) for i, x in enumerate(steps)], "place int, action string, method string, columns string")


@query("auto_pipeline", f"""WITH f AS (SELECT o_orderkey, coalesce(price, (SELECT median(price) FROM {HOLES})) AS price, coalesce(priority, {_MODE}) AS priority, status FROM {HOLES}), c AS (SELECT *, least(greatest(price, avg(price) OVER () - 3 * stddev_pop(price) OVER ()), avg(price) OVER () + 3 * stddev_pop(price) OVER ()) AS clipped FROM f)
    SELECT o_orderkey, round((clipped - avg(clipped) OVER ()) / stddev_samp(clipped) OVER (), 6) + 0.0 AS price, """ + ", ".join(f"CAST(priority = '{v}' AS INTEGER) AS \"priority_{v}\"" for v in PRIORITIES) + ", " + ", ".join(f"CAST(status = '{v}' AS INTEGER) AS \"status_{v}\"" for v in STATUSES) + " FROM c")
def auto_pipeline(s, d):
    df = holes(s, d).drop("small")
    steps = prepare.compose(prepare.detected(df, ["price", "priority", "status", "rare", "same"]))
    return prepare.applied(df, steps).withColumn("price", F.round("price", 6) + 0.0)


_GATED = "(SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS holes, CASE WHEN event_id % 3 = 0 THEN value ELSE 0 END AS zeros, 1.0::DOUBLE AS constant, event_type, user_id % 10 AS few FROM events UNION ALL SELECT event_id, NULL, 0, 1.0, event_type, user_id % 10 FROM events WHERE event_id < 0)"
_NUM = ["event_id", "holes", "zeros", "constant"]


def _gate(c, num):
    if not num:
        return f"""SELECT '{c}' AS "column", count({c}) / count(*) AS completeness, count(DISTINCT {c}) / count(*) AS distinct_ratio, 0.0 AS outlier_ratio, 0.0 AS zeros_ratio, greatest(count(*) FILTER (regexp_matches({c}, '^[0-9.]+$')) / count({c}), 1 - count(*) FILTER (regexp_matches({c}, '^[0-9.]+$')) / count({c})) AS consistency,
        NULL AS sd, NULL AS sk, NULL AS ku, count(*) AS n, false AS stepped FROM {_GATED}"""
    bounds = f"(SELECT l[CAST(floor(len(l) * .25) AS BIGINT) + 1] AS a, l[CAST(floor(len(l) * .75) AS BIGINT) + 1] AS b, l FROM (SELECT list_sort(list({c}) FILTER ({c} IS NOT NULL)) AS l FROM {_GATED}))"
    return f"""SELECT '{c}' AS "column", count({c}) / count(*) AS completeness, count(DISTINCT {c}) / count(*) AS distinct_ratio, count(*) FILTER ({c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) / count(*) AS outlier_ratio, count(*) FILTER ({c} = 0) / count(*) AS zeros_ratio, 1.0 AS consistency,
    stddev_samp({c}) AS sd, CASE WHEN stddev_pop({c}) > 0 THEN skewness({c}) END AS sk, CASE WHEN stddev_pop({c}) > 0 THEN kurtosis({c}) END AS ku, count(*) AS n, count(DISTINCT {c}) = count({c}) AND (SELECT bool_and(abs(l[i + 1] - l[i] - (l[2] - l[1])) < 1e-9) FROM {bounds}, range(1, 50) t(i)) AS stepped FROM {_GATED}, {bounds}"""


_PARTS = " UNION ALL ".join(_gate(c, c in _NUM) for c in [*_NUM, "event_type"])
_TABLE = f"(SELECT *, completeness * (1 - outlier_ratio) * consistency AS validity FROM ({_PARTS}))"
_R = ", ".join(f"round({c}, 6)::DOUBLE AS {c}" for c in ("completeness", "distinct_ratio", "outlier_ratio", "zeros_ratio", "consistency", "validity"))


@query("quality_gate", f"""SELECT "column", {_R}, NULL::DOUBLE AS overall, array_to_string(list_filter([CASE WHEN completeness < .7 THEN 'HighMissingness' END, CASE WHEN sd < 1e-10 THEN 'ConstantColumn' END, CASE WHEN sd >= 1e-10 AND sd < 1e-6 THEN 'LowVariance' END, CASE WHEN abs(sk) > 2 THEN 'HighSkewness' END, CASE WHEN abs(ku) > 7 THEN 'HighKurtosis' END,
    CASE WHEN zeros_ratio > .5 THEN 'HighZeroRatio' END, CASE WHEN outlier_ratio > .1 THEN 'HighOutlierRatio' END, CASE WHEN distinct_ratio > .95 AND n > 20 THEN 'HighCardinality' END, CASE WHEN distinct_ratio > .99 AND n > 20 AND stepped THEN 'SuspectedId' END], lambda x: x IS NOT NULL), ',') AS warnings FROM {_TABLE}
    UNION ALL SELECT '*', round(avg(completeness), 6), round(any_value(q), 6), round(avg(outlier_ratio), 6), round(avg(zeros_ratio), 6), round(avg(consistency), 6), round(avg(validity), 6), round(.3 * avg(completeness) + .2 * any_value(q) + .25 * avg(consistency) + .25 * avg(validity), 6),
    CASE WHEN any_value(q) < 1 THEN 'DuplicateRows' ELSE '' END || CASE WHEN any_value(r) > 10 THEN CASE WHEN any_value(q) < 1 THEN ',' ELSE '' END || 'ClassImbalance' ELSE '' END FROM {_TABLE}, (SELECT (SELECT count(*) FROM (SELECT DISTINCT * FROM {_GATED})) / (SELECT count(*) FROM {_GATED}) AS q), (SELECT max(k) / min(k) AS r FROM (SELECT count(*) AS k FROM {_GATED} GROUP BY event_type))""")
def quality_gate(s, d):
    e = table(s, d, "events")
    df = e.select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("holes"), F.when(F.col("event_id") % 3 == 0, F.col("value")).otherwise(0.0).alias("zeros"), F.lit(1.0).alias("constant"), "event_type", (F.col("user_id") % 10).alias("few"))
    out = profile.gate(df, _NUM, ["event_type"], "event_type")
    return out.select("column", *[F.round(c, 6).alias(c) for c in ("completeness", "distinct_ratio", "outlier_ratio", "zeros_ratio", "consistency", "validity", "overall")], "warnings")


_SHAPES = "(SELECT c_custkey, c_custkey * c_custkey * 3 AS rows, c_custkey % 40 * (c_custkey % 7) AS columns FROM customer)"
_SMALL, _WIDE = "['GradientBoosting', 'XGBoost', 'LightGBM', 'CatBoost', 'SGDClassifier', 'SGDRegressor']", "['RandomForest', 'ExtraTrees', 'GradientBoosting', 'XGBoost', 'LightGBM', 'CatBoost', 'KNN', 'SVM']"


@query("algorithm_exclusion", f"SELECT c_custkey, array_to_string(list_concat(CASE WHEN rows < 1000 THEN {_SMALL} ELSE [] END, CASE WHEN rows > 100000 THEN ['KNN', 'SVM'] ELSE [] END, CASE WHEN columns > 0 AND rows > 0 AND columns / rows > 1 THEN list_filter({_WIDE}, lambda x: NOT (rows < 1000 AND list_contains({_SMALL}, x))) ELSE [] END), ',') AS excluded, CASE WHEN c_custkey % 13 = 0 THEN 'group_k_fold' WHEN rows < 5000 THEN 'repeated_3x5' ELSE 'stratified_5' END AS folds FROM {_SHAPES}")
def algorithm_exclusion(s, d):
    k = F.col("c_custkey")
    shapes = table(s, d, "customer").select("c_custkey", (k * k * 3).alias("rows"), (k % 40 * (k % 7)).alias("columns"))
    return shapes.select("c_custkey", F.array_join(choose.excluded(F.col("rows"), F.col("columns")), ",").alias("excluded"), choose.folds(F.col("rows"), k % 13 == 0).alias("folds"))


@query("top_models", "SELECT user_id % 20 AS model, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events GROUP BY 1 ORDER BY avg(value) DESC, 1 LIMIT 3")
def top_models(s, d):
    scores = table(s, d, "events").select((F.col("user_id") % 20).alias("model"), F.col("value").alias("score"))
    return choose.best(scores, 3).select("model", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("tuner_grid", "SELECT CAST(row_number() OVER (ORDER BY a, b) - 1 AS BIGINT) AS trial, depth, rate FROM (SELECT unnest([3, 5, 9]) AS depth, unnest([0, 1, 2]) AS a), (SELECT unnest([.01, .1]) AS rate, unnest([0, 1]) AS b)")
def tuner_grid(s, d):
    return choose.grid(s, {"depth": [3, 5, 9], "rate": [0.01, 0.1]}).select("trial", F.col("depth").cast("int").alias("depth"), "rate")


def _u(name):
    return f"CAST('0x' || substr(sha256('7:{name}:' || i), 1, 8) AS BIGINT) / 4294967296.0"


@query("tuner_random", f"SELECT i AS trial, round(2 + {_u('share')} * 6, 6) AS share, round(exp(ln(.0001) + {_u('rate')} * ln(10000)), 9) AS rate, CAST(floor(1 + {_u('depth')} * 10) AS BIGINT) AS depth FROM range(50) t(i)")
def tuner_random(s, d):
    found = choose.drawn(s, {"share": (2, 8, "uniform"), "rate": (0.0001, 1, "log"), "depth": (1, 10, "int")}, 50, 7)
    return found.select("trial", F.round("share", 6).alias("share"), F.round("rate", 9).alias("rate"), "depth")


_TRIALS = "(SELECT user_id % 60 AS trial, event_id % 3 AS budget, avg(value) AS score FROM events GROUP BY ALL)"
_RUNG = "SELECT t.*, row_number() OVER (ORDER BY score DESC, trial) AS place, count(*) OVER () AS n FROM {} t WHERE budget = {}"


@query("tuner_halving", f"WITH a AS ({_RUNG.format(_TRIALS, 0)}), b AS ({_RUNG.format(f'(SELECT * FROM {_TRIALS} WHERE trial IN (SELECT trial FROM a WHERE place <= greatest(1, n // 3)))', 1)}), c AS ({_RUNG.format(f'(SELECT * FROM {_TRIALS} WHERE trial IN (SELECT trial FROM b WHERE place <= greatest(1, n // 3)))', 2)}) SELECT trial, budget, place, place <= greatest(1, n // 3) AS kept FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c)")
def tuner_halving(s, d):
    scores = table(s, d, "events").groupBy((F.col("user_id") % 60).alias("trial"), (F.col("event_id") % 3).alias("budget")).agg(F.avg("value").alias("score"))
    return choose.halving(scores, [0, 1, 2]).select("trial", "budget", F.col("place").cast("long").alias("place"), "kept")


def _sold(s, d):
    c = (F.col("o_custkey") % 7).cast("double")
    return table(s, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").cast("double").alias("customer"), (F.col("o_totalprice") * c).alias("share"), F.col("o_totalprice").alias("y"))


_FOLDED = "(SELECT o_orderkey AS key, CAST(o_custkey AS DOUBLE) AS q, o_totalprice * (o_custkey % 7) AS d, o_totalprice AS y, (row_number() OVER (ORDER BY o_orderkey) - 1) % 5 AS f FROM orders)"


@query("stacking", f"""WITH t AS {_FOLDED}, m AS (SELECT g.f, regr_slope(y, q) AS s1, regr_intercept(y, q) AS i1, regr_slope(y, d) AS s2, regr_intercept(y, d) AS i2 FROM t, (SELECT unnest(range(5)) AS f) g WHERE t.f <> g.f GROUP BY g.f), o AS (SELECT key, y, i1 + s1 * q AS a, i2 + s2 * d AS b FROM t JOIN m USING (f)),
    c AS (SELECT var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS yb, avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM o), w AS (SELECT *, (ay * bb - yb * ab) / (aa * bb - ab * ab) AS w1, (yb * aa - ay * ab) / (aa * bb - ab * ab) AS w2 FROM c)
    SELECT key, round(my + w1 * (a - ma) + w2 * (b - mb), 2) AS stacked FROM o, w""")
def stacking(s, d):
    rows, *_ = choose.stacked(_sold(s, d), "key", {"customer": ["customer"], "share": ["share"]}, "y")
    return rows.select("key", F.round("stacked", 2).alias("stacked"))


_TAIL = "(SELECT o_orderkey AS key, CAST(o_custkey AS DOUBLE) AS q, o_totalprice * (o_custkey % 7) AS d, o_totalprice AS y, row_number() OVER (ORDER BY o_orderkey) > count(*) OVER () - CAST(floor(count(*) OVER () * .2) AS BIGINT) AS held FROM orders)"


@query("blending", f"""WITH t AS {_TAIL}, f AS (SELECT regr_slope(y, q) AS s1, regr_intercept(y, q) AS i1, regr_slope(y, d) AS s2, regr_intercept(y, d) AS i2 FROM t WHERE NOT held), h AS (SELECT key, y, i1 + s1 * t.q AS p, i2 + s2 * t.d AS q FROM t, f WHERE held),
    w AS (SELECT 1 / avg((p - y) ** 2) AS a, 1 / avg((q - y) ** 2) AS b FROM h) SELECT key, round((p * a + q * b) / (a + b), 2) AS blended FROM h, w""")
def blending(s, d):
    rows, _ = choose.blended(_sold(s, d), "key", {"customer": ["customer"], "share": ["share"]}, "y", alpha=0.0)
    return rows.select("key", F.round("blended", 2).alias("blended"))


@query("calibration_gate")
def calibration_gate(s, d):
    """Scores that are too sure of themselves: which calibration is chosen, and the errors without and with each."""
    labels = table(s, d, "labels").select(F.col("quality").alias("y"), (F.pmod(F.xxhash64("doc_id"), F.lit(1000)) / 1000.0).alias("u"))
    scored = labels.select("y", F.round(F.when(F.col("y") == 1, 0.35 + 0.64 * F.col("u")).otherwise(0.01 + 0.64 * F.col("u")), 3).alias("p"))
    chosen, errors = choose.calibration(scored, "y", "p")
    return s.createDataFrame([(chosen, *[round(errors[k], 6) for k in ("raw", "platt", "isotonic")])], "chosen string, raw double, platt double, isotonic double")

"""Scalers, transforms, bins, outliers, quantization and vector kernels."""

from pyspark.sql import functions as F

from tablesmith.operators import scale
from tablesmith.operators import transforms as T
from tablesmith.registry import query, table

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ORDERS = "o_orderkey, round({}, 6) AS x FROM orders"


def _lines(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", *NUMERIC)


def _rounded(df):
    return df.select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(c) for c in NUMERIC])


def _sql(f):
    return "SELECT l_orderkey, l_linenumber, " + ", ".join(f"round({f(c)}, 6) AS {c}" for c in NUMERIC) + " FROM lineitem"


@query("scale_standard", _sql(lambda c: f"({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER ()"))
def scale_standard(s, d):
    df = _lines(s, d)
    return _rounded(scale.transform(df, scale.fit(df, NUMERIC, "standard")))


@query("scale_minmax", _sql(lambda c: f"({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ())"))
def scale_minmax(s, d):
    df = _lines(s, d)
    return _rounded(scale.transform(df, scale.fit(df, NUMERIC, "minmax")))


@query("scale_minmax_clip", "SELECT l_orderkey, l_linenumber, round(least(1, greatest(-1, (l_quantity - a) / (b - a) * 2 - 1)), 6) AS l_quantity FROM lineitem, (SELECT min(l_quantity) AS a, max(l_quantity) AS b FROM lineitem WHERE l_discount < .05 AND l_quantity BETWEEN 5 AND 40)")
def scale_minmax_clip(s, d):
    df = _lines(s, d)
    params = scale.fit(df.where("l_discount < .05 and l_quantity between 5 and 40"), ["l_quantity"], "minmax", -1.0, 1.0, clip=True)
    return scale.transform(df, params).select("l_orderkey", "l_linenumber", F.round("l_quantity", 6).alias("l_quantity"))


def _rank(c, p):
    return f"(SELECT list_sort(list({c}))[CAST(floor(count(*) * {p}) AS BIGINT) + 1] FROM lineitem)"


@query("scale_robust", _sql(lambda c: f"({c} - (SELECT median({c}) FROM lineitem)) / CASE WHEN {_rank(c, .75)} - {_rank(c, .25)} < 1e-12 THEN 1 ELSE {_rank(c, .75)} - {_rank(c, .25)} END"))
def scale_robust(s, d):
    df = _lines(s, d)
    return _rounded(scale.transform(df, scale.fit(df, NUMERIC, "robust")))


@query("scale_maxabs", _sql(lambda c: f"{c} / max(abs({c})) OVER ()"))
def scale_maxabs(s, d):
    df = _lines(s, d)
    return _rounded(scale.transform(df, scale.fit(df, NUMERIC, "maxabs")))


@query("scale_inverse", _sql(lambda c: c))
def scale_inverse(s, d):
    df = _lines(s, d)
    params = scale.fit(df, NUMERIC, "standard")
    return _rounded(scale.inverse(scale.transform(df, params), params))


@query("running_stats", "SELECT l_returnflag, count(*) AS n, round(avg(l_extendedprice), 4) AS mean, round(var_samp(l_extendedprice), 2) AS variance, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem GROUP BY 1")
def running_stats(s, d):
    df = table(s, d, "lineitem")
    parts = [scale.sums(df.where(f"l_orderkey % 3 = {i}"), "l_extendedprice", ["l_returnflag"]) for i in range(3)]
    out = scale.merged(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["l_returnflag"])
    return out.select("l_returnflag", "n", F.round("mean", 4).alias("mean"), F.round("variance", 2).alias("variance"), "low", "high")


SIGNED = "(value - 20)"
TRANSFORMS = {
    "log": f"CASE WHEN {SIGNED} > 0 THEN ln(CASE WHEN {SIGNED} > 0 THEN {SIGNED} END) END", "log1p": f"CASE WHEN {SIGNED} > -1 THEN ln(1 + CASE WHEN {SIGNED} > -1 THEN {SIGNED} END) END", "log10": f"CASE WHEN {SIGNED} > 0 THEN log10(CASE WHEN {SIGNED} > 0 THEN {SIGNED} END) END",
    "sqrt": f"CASE WHEN {SIGNED} >= 0 THEN sqrt(abs({SIGNED})) END", "power": f"pow({SIGNED}, 2)", "reciprocal": f"CASE WHEN abs({SIGNED}) > 1e-10 THEN 1 / nullif({SIGNED}, 0) END", "identity": SIGNED,
}


@query("value_transforms", "SELECT event_id, " + ", ".join(f"round({sql}, 6) AS \"{n}\"" for n, sql in TRANSFORMS.items()) + " FROM events")
def value_transforms(s, d):
    x = F.col("value") - 20
    return table(s, d, "events").select("event_id", *[F.round(F.nanvl(T.apply(n, x), F.lit(None).cast("double")), 6).alias(n) for n in TRANSFORMS])


def _grid_sql(table_, var, jac):
    return f"SELECT lam, round(-n / 2.0 * ln(v) + (lam - 1) * j, 4) AS likelihood FROM (SELECT round(-2 + .1 * i, 1)::DOUBLE AS lam, count(*) AS n, var_pop({var}) AS v, sum({jac}) AS j FROM {table_}, range(41) t(i) GROUP BY 1)"


_BC = "CASE WHEN abs(round(-2 + .1 * i, 1)) < 1e-10 THEN ln(value + 1) ELSE (pow(value + 1, round(-2 + .1 * i, 1)) - 1) / nullif(round(-2 + .1 * i, 1), 0) END"


@query("box_cox_grid", _grid_sql("events", _BC, "ln(value + 1)"))
def box_cox_grid(s, d):
    df = table(s, d, "events").select((F.col("value") + 1).alias("value"))
    return T.best_lambda(df, "value", "box_cox")[2].select("lam", F.round("likelihood", 4).alias("likelihood"))


_L = "CAST(round(-2 + .1 * i, 1) AS DOUBLE)"
_YJ = f"CASE WHEN {SIGNED} >= 0 THEN CASE WHEN abs({_L}) < 1e-10 THEN ln(1 + greatest({SIGNED}, 0)) ELSE (pow(greatest({SIGNED}, 0) + 1, {_L}) - 1) / nullif({_L}, 0) END ELSE CASE WHEN abs({_L} - 2) < 1e-10 THEN -ln(1 - least({SIGNED}, 0)) ELSE -(pow(1 - least({SIGNED}, 0), 2 - {_L}) - 1) / nullif(2 - {_L}, 0) END END"


@query("yeo_johnson_grid", _grid_sql("events", _YJ, f"sign({SIGNED}) * ln(1 + abs({SIGNED}))"))
def yeo_johnson_grid(s, d):
    df = table(s, d, "events").select((F.col("value") - 20).alias("value"))
    return T.best_lambda(df, "value", "yeo_johnson")[2].select("lam", F.round("likelihood", 4).alias("likelihood"))


@query("power_round_trip", "SELECT event_id, round(value, 5) AS bc, round(value - 20, 5) AS yj FROM events")
def power_round_trip(s, d):
    df = table(s, d, "events")
    bc = T.box_cox_inverse(T.box_cox(F.col("value"), 0.5, 1.0), 0.5, 1.0)
    yj = T.yeo_johnson_inverse(T.yeo_johnson(F.col("value") - 20, 0.5), 0.5)
    return df.select("event_id", F.round(bc, 5).alias("bc"), F.round(yj, 5).alias("yj"))


@query("bin_uniform", "SELECT o_orderkey, CAST(CASE WHEN x = 0 THEN 0 ELSE ceil(x) - 1 END AS INTEGER) AS bin FROM (SELECT o_orderkey, (o_totalprice - min(o_totalprice) OVER ()) / ((max(o_totalprice) OVER () - min(o_totalprice) OVER ()) / 10) AS x FROM orders)")
def bin_uniform(s, d):
    df = table(s, d, "orders")
    return df.select("o_orderkey", T.bin_of(F.col("o_totalprice"), T.edges(df, "o_totalprice", 10, "uniform")).alias("bin"))


@query("bin_quantile", "SELECT o_orderkey, CAST(len(list_filter(e, lambda x: x < o_totalprice)) AS INTEGER) AS bin FROM orders, (SELECT list_transform(range(1, 8), lambda i: l[CAST(floor(i / 8.0 * (len(l) - 1)) AS BIGINT) + 1]) AS e FROM (SELECT list_sort(list(o_totalprice)) AS l FROM orders))")
def bin_quantile(s, d):
    df = table(s, d, "orders")
    return df.select("o_orderkey", T.bin_of(F.col("o_totalprice"), T.edges(df, "o_totalprice", 8, "quantile")).alias("bin"))


@query("bin_custom", "SELECT o_orderkey, CASE WHEN o_totalprice < 1000 OR o_totalprice > 400000 THEN 3 WHEN o_totalprice <= 50000 THEN 0 WHEN o_totalprice <= 100000 THEN 1 WHEN o_totalprice <= 200000 THEN 2 ELSE 3 END AS bin FROM orders")
def bin_custom(s, d):
    return table(s, d, "orders").select("o_orderkey", T.bin_of(F.col("o_totalprice"), [1000.0, 50000.0, 100000.0, 200000.0, 400000.0]).alias("bin"))


@query("bin_kmeans")
def bin_kmeans(s, d):
    df = table(s, d, "events")
    return df.select("event_id", T.bin_of(F.col("value"), T.edges(df, "value", 5, "kmeans")).alias("bin"))


_SORTED = "(SELECT list_sort(list(value)) AS l, avg(value) AS m, stddev_pop(value) AS s, count(*) AS n FROM events)"
BOUNDS = {
    "iqr": ("l[n // 4 + 1] - 1.5 * (l[n * 3 // 4 + 1] - l[n // 4 + 1])", "l[n * 3 // 4 + 1] + 1.5 * (l[n * 3 // 4 + 1] - l[n // 4 + 1])"), "zscore": ("m - 3 * s", "m + 3 * s"),
    "percentile": ("l[CAST(floor(n * 1 / 100.0) AS BIGINT) + 1]", "l[least(CAST(ceil(n * 99 / 100.0) AS BIGINT), n - 1) + 1]"),
    "modified": ("l[n // 2 + 1] - 3.5 * 1.4826 * list_avg(list_transform(l, lambda x: abs(x - l[n // 2 + 1])))", "l[n // 2 + 1] + 3.5 * 1.4826 * list_avg(list_transform(l, lambda x: abs(x - l[n // 2 + 1])))"),
}
K = {"iqr": 1.5, "zscore": 3.0, "percentile": 1.0, "modified": 3.5}


@query("outlier_bounds", " UNION ALL ".join(f"SELECT '{m}' AS method, round({a}, 5) AS low, round({b}, 5) AS high FROM {_SORTED}" for m, (a, b) in BOUNDS.items()))
def outlier_bounds(s, d):
    df = table(s, d, "events")
    return s.createDataFrame([(m, *(round(x, 5) for x in T.bounds(df, "value", m, k))) for m, k in K.items()], "method string, low double, high double")


@query("outlier_mask", f"SELECT event_id, value < a OR value > b AS value_outlier FROM events, (SELECT {BOUNDS['iqr'][0]} AS a, {BOUNDS['iqr'][1]} AS b FROM {_SORTED})")
def outlier_mask(s, d):
    df = table(s, d, "events")
    return df.select("event_id", T.is_outlier("value", T.bounds(df, "value", "iqr", 1.5)).alias("value_outlier"))


@query("outlier_clip", f"SELECT event_id, round(least(greatest(value, a), b), 6) AS value FROM events, (SELECT {BOUNDS['iqr'][0]} AS a, {BOUNDS['iqr'][1]} AS b FROM {_SORTED})")
def outlier_clip(s, d):
    df = table(s, d, "events").select("event_id", "value")
    return T.treat(df, "value", T.bounds(df, "value", "iqr", 1.5), "clip").withColumn("value", F.round("value", 6))


@query("outlier_remove", f"SELECT event_id, value FROM events, (SELECT {BOUNDS['zscore'][0]} AS a, {BOUNDS['zscore'][1]} AS b FROM {_SORTED}) WHERE value BETWEEN a AND b")
def outlier_remove(s, d):
    df = table(s, d, "events").select("event_id", "value")
    return T.treat(df, "value", T.bounds(df, "value", "zscore", 3.0), "remove")


@query("outlier_mean", f"WITH b AS (SELECT {BOUNDS['iqr'][0]} AS a, {BOUNDS['iqr'][1]} AS b FROM {_SORTED}) SELECT event_id, round(CASE WHEN value < a OR value > b THEN (SELECT avg(value) FROM events, b WHERE value BETWEEN a AND b) ELSE value END, 6) AS value FROM events, b")
def outlier_mean(s, d):
    df = table(s, d, "events").select("event_id", "value")
    return T.treat(df, "value", T.bounds(df, "value", "iqr", 1.5), "mean").withColumn("value", F.round("value", 6))


@query("outlier_median", f"WITH b AS (SELECT {BOUNDS['iqr'][0]} AS a, {BOUNDS['iqr'][1]} AS b FROM {_SORTED}) SELECT event_id, round(CASE WHEN value < a OR value > b THEN (SELECT median(value) FROM events, b WHERE value BETWEEN a AND b) ELSE value END, 6) AS value FROM events, b")
def outlier_median(s, d):
    df = table(s, d, "events").select("event_id", "value")
    return T.treat(df, "value", T.bounds(df, "value", "iqr", 1.5), "median").withColumn("value", F.round("value", 6))


def _quant(scale_, zero, lo, hi):
    return f"CAST(least(greatest(sign(c_acctbal / {scale_}) * floor(abs(c_acctbal / {scale_}) + .5) + {zero}, {lo}), {hi}) AS INTEGER)"


_R = "(SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)"


@query("quantize_symmetric", f"SELECT c_custkey, {_quant('sc', 0, -128, 127)} AS q, round({_quant('sc', 0, -128, 127)} * sc, 6) AS back FROM customer, (SELECT greatest(abs(lo), abs(hi)) / 127 AS sc FROM {_R})")
def quantize_symmetric(s, d):
    df = table(s, d, "customer")
    q, scale_, zero = T.quantize(F.col("c_acctbal"), *T.calibrate(df, "c_acctbal"))
    return df.select("c_custkey", q.alias("q"), F.round(T.dequantize(q, scale_, zero), 6).alias("back"))


@query("quantize_asymmetric", f"SELECT c_custkey, {_quant('sc', 'z', 0, 255)} AS q, round(({_quant('sc', 'z', 0, 255)} - z) * sc, 6) AS back FROM customer, (SELECT sc, least(255, greatest(0, round(-lo / sc))) AS z FROM (SELECT lo, (hi - lo) / 255 AS sc FROM {_R}))")
def quantize_asymmetric(s, d):
    df = table(s, d, "customer")
    q, scale_, zero = T.quantize(F.col("c_acctbal"), *T.calibrate(df, "c_acctbal"), symmetric=False, signed=False)
    return df.select("c_custkey", q.alias("q"), F.round(T.dequantize(q, scale_, zero), 6).alias("back"))


_HIST = """WITH b AS (SELECT min(c_acctbal) AS low, (max(c_acctbal) - min(c_acctbal)) / 2048 AS w, count(*) AS n FROM customer), c AS (SELECT i, count(c_acctbal) AS k FROM range(2048) t(i) CROSS JOIN b LEFT JOIN customer ON least(floor((c_acctbal - low) / w), 2047) = i GROUP BY 1), r AS (SELECT i, sum(k) OVER (ORDER BY i) AS run FROM c)
    SELECT low + coalesce(max(i + 1) FILTER (run <= (1 - .98::DOUBLE) / 2 * n), 0) * w AS low, low + least(coalesce(max(i + 2) FILTER (run < (1 - (1 - .98::DOUBLE) / 2) * n), 2048), 2048) * w AS high FROM r, b GROUP BY b.low, w, n"""


@query("calibrate_histogram", f"SELECT round(low, 4) AS low, round(high, 4) AS high FROM ({_HIST})")
def calibrate_histogram(s, d):
    low, high = T.calibrate(table(s, d, "customer"), "c_acctbal", "histogram", 0.98)
    return s.createDataFrame([(round(low, 4), round(high, 4))], "low double, high double")


_V = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"


@query("vector_kernels", f"""SELECT vec_id, round(list_sum({_V}), 5) AS total, round(list_avg({_V}), 6) AS mean, round(list_var_pop({_V}), 6) AS variance, list_position({_V}, list_max({_V})) - 1 AS argmax,
    round(list_dot_product({_V}, {_V}), 6) AS norm2, round(list_distance({_V}, list_reverse({_V})), 5) AS apart, round(exp({_V}[1]) / list_sum(list_transform({_V}, lambda x: exp(x))), 6) AS soft1, round({_V}[1] - ln(list_sum(list_transform({_V}, lambda x: exp(x)))), 5) AS log1 FROM embeddings""")
def vector_kernels(s, d):
    df = table(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    v = F.col("v")
    return df.select(
        "vec_id", F.round(T.mean(v) * F.size(v), 5).alias("total"), F.round(T.mean(v), 6).alias("mean"), F.round(T.variance(v), 6).alias("variance"), T.argmax(v).alias("argmax"), F.round(T.dot(v, v), 6).alias("norm2"),
        F.round(T.distance(v, F.reverse(v)), 5).alias("apart"), F.round(T.softmax(v)[0], 6).alias("soft1"), F.round(T.softmax(v, log=True)[0], 5).alias("log1"),
    )


@query("calibrate_percentile", "SELECT l[CAST(floor((1 - .98::DOUBLE) / 2 * (len(l) - 1)) AS BIGINT) + 1] AS low, l[CAST(ceil((1 + .98::DOUBLE) / 2 * (len(l) - 1)) AS BIGINT) + 1] AS high FROM (SELECT list_sort(list(c_acctbal)) AS l FROM customer)")
def calibrate_percentile(s, d):
    return s.createDataFrame([T.calibrate(table(s, d, "customer"), "c_acctbal", "percentile", 0.98)], "low double, high double")


@query("calibrate_moving", """WITH RECURSIVE b AS (SELECT c_nationkey AS k, min(c_acctbal) AS a, max(c_acctbal) AS b, row_number() OVER (ORDER BY c_nationkey) AS i FROM customer GROUP BY 1), r AS (SELECT i, a AS low, b AS high FROM b WHERE i = 1
    UNION ALL SELECT b.i, .9::DOUBLE * low + (1 - .9::DOUBLE) * a, .9::DOUBLE * high + (1 - .9::DOUBLE) * b FROM r JOIN b ON b.i = r.i + 1) SELECT round(low, 6) AS low, round(high, 6) AS high FROM r ORDER BY i DESC LIMIT 1""")
def calibrate_moving(s, d):
    low, high = T.moving_range(table(s, d, "customer"), "c_acctbal", "c_nationkey")
    return s.createDataFrame([(round(low, 6), round(high, 6))], "low double, high double")

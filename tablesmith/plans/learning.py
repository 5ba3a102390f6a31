"""Models."""

from pyspark.sql import functions as F

from tablesmith.operators import learn
from tablesmith.registry import query, table

from .drifting import vectors


@query("ols", "SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem")
def ols(s, d):
    w, b = learn.linear(table(s, d, "lineitem"), ["l_quantity"], "l_extendedprice")
    return s.createDataFrame([(round(w["l_quantity"], 6), round(b, 4))], "slope double, intercept double")


@query("ridge", "SELECT round(w, 6) AS slope, round(my - w * mx, 4) AS intercept FROM (SELECT covar_pop(l_extendedprice, l_quantity) * count(*) / (var_pop(l_quantity) * count(*) + 10) AS w, avg(l_extendedprice) AS my, avg(l_quantity) AS mx FROM lineitem)")
def ridge(s, d):
    w, b = learn.linear(table(s, d, "lineitem"), ["l_quantity"], "l_extendedprice", 10.0)
    return s.createDataFrame([(round(w["l_quantity"], 6), round(b, 4))], "slope double, intercept double")


@query("ols_two", """SELECT round((cyx * vz - cyz * cxz) / (vx * vz - cxz * cxz), 5) AS a, round((cyz * vx - cyx * cxz) / (vx * vz - cxz * cxz), 3) AS b FROM (SELECT covar_pop(l_extendedprice, l_quantity) AS cyx, covar_pop(l_extendedprice, l_discount) AS cyz, covar_pop(l_quantity, l_discount) AS cxz, var_pop(l_quantity) AS vx, var_pop(l_discount) AS vz FROM lineitem)""")
def ols_two(s, d):
    w, _ = learn.linear(table(s, d, "lineitem"), ["l_quantity", "l_discount"], "l_extendedprice")
    return s.createDataFrame([(round(w["l_quantity"], 5), round(w["l_discount"], 3))], "a double, b double")


_NB = "(SELECT o_orderstatus AS class, count(*) / (SELECT count(*) FROM orders) AS prior, avg(o_totalprice) AS m, var_pop(o_totalprice) + 1e-9 AS v FROM orders GROUP BY 1)"


@query("gaussian_bayes", f"SELECT o_orderkey, min_by(class, struct_pack(l := -ll, c := class)) AS class, round(1 / sum(exp(ll - top)), 6) AS probability FROM (SELECT *, max(ll) OVER (PARTITION BY o_orderkey) AS top FROM (SELECT o_orderkey, class, ln(prior) - .5 * ln(2 * pi() * v) - pow(o_totalprice - m, 2) / (2 * v) AS ll FROM orders, {_NB})) GROUP BY 1")
def gaussian_bayes(s, d):
    df = table(s, d, "orders")
    out = learn.gaussian_predict(df, "o_orderkey", ["o_totalprice"], learn.gaussian_bayes(df, ["o_totalprice"], "o_orderstatus"))
    return out.withColumn("probability", F.round("probability", 6))


@query("multinomial_bayes", "WITH c AS (SELECT doc_id, lower(w) AS term, count(*) AS tf FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) GROUP BY ALL), j AS (SELECT quality AS class, term, sum(tf) AS n FROM c JOIN labels USING (doc_id) GROUP BY ALL) SELECT class, term, round(ln((n + 1) / (sum(n) OVER (PARTITION BY class) + (SELECT count(DISTINCT term) FROM c))), 6) AS logp FROM j")
def multinomial_bayes(s, d):
    labels = table(s, d, "labels").select("doc_id", "quality")
    docs = table(s, d, "documents").join(labels.select("doc_id"), "doc_id", "left_semi")
    counts = docs.select("doc_id", F.explode(F.split("text", " ")).alias("w")).groupBy("doc_id", F.lower("w").alias("term")).agg(F.count("*").alias("tf"))
    return learn.multinomial_bayes(counts, labels, "doc_id", "quality").withColumn("logp", F.round("logp", 6))


_V = "(SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"


def _knn(dist, weight):
    return f"WITH n AS (SELECT a.vec_id, b.label, {dist} AS d FROM {_V} a, {_V} b WHERE a.vec_id % 2 = 1 AND b.vec_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY d, b.vec_id) <= 5), w AS (SELECT vec_id, label, sum({weight}) AS w FROM n GROUP BY ALL) SELECT vec_id, min_by(label, struct_pack(w := -w, l := label)) AS label, round(sum(label * w) / sum(w), 5) AS mean FROM w GROUP BY 1"


@query("knn_vote", _knn("list_distance(a.v, b.v)", "1.0::DOUBLE"))
def knn_vote(s, d):
    v = vectors(s, d)
    return learn.knn(v.where("vec_id % 2 = 1"), "vec_id", "v", "label", v.where("vec_id % 2 = 0")).withColumn("mean", F.round("mean", 5))


@query("knn_cosine", _knn("1 - list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v))", "1 / (d + 1e-10)"))
def knn_cosine(s, d):
    v = vectors(s, d)
    return learn.knn(v.where("vec_id % 2 = 1"), "vec_id", "v", "label", v.where("vec_id % 2 = 0"), metric="cosine", weighted=True).withColumn("mean", F.round("mean", 5))


@query("cluster_assign", f"SELECT vec_id, cluster, round(dist, 6) AS dist FROM (SELECT a.vec_id, CAST(b.vec_id AS INTEGER) AS cluster, list_distance(a.v, b.v) AS dist FROM {_V} a, {_V} b WHERE b.vec_id < 8) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, cluster) = 1")
def cluster_assign(s, d):
    v = vectors(s, d)
    centers = v.where("vec_id < 8").select(F.col("vec_id").cast("int").alias("cluster"), F.col("v").alias("center"))
    return learn.assign(v, "vec_id", "v", centers).withColumn("dist", F.round("dist", 6))


@query("k_means")
def k_means(s, d):
    v = vectors(s, d)
    return learn.assign(v, "vec_id", "v", learn.k_means(v, "vec_id", "v", 5, rounds=5)).withColumn("dist", F.round("dist", 6))


_E = f"SELECT a.vec_id, b.vec_id AS near FROM {_V} a, {_V} b WHERE list_distance(a.v, b.v) <= 1.15"


@query("dbscan", f"""WITH RECURSIVE e AS MATERIALIZED ({_E}), c AS MATERIALIZED (SELECT vec_id FROM e GROUP BY 1 HAVING count(*) >= 4), l AS MATERIALIZED (SELECT * FROM e WHERE vec_id IN (FROM c) AND near IN (FROM c)),
    r AS (SELECT vec_id, vec_id AS root FROM c UNION SELECT l.near, r.root FROM r JOIN l ON l.vec_id = r.vec_id), m AS (SELECT vec_id, min(root) AS cluster FROM r GROUP BY 1), b AS (SELECT e.vec_id, min(cluster) AS reach FROM e JOIN m ON m.vec_id = e.near GROUP BY 1)
    SELECT v.vec_id, m.vec_id IS NOT NULL AS core, coalesce(m.cluster, b.reach) AS cluster FROM embeddings v LEFT JOIN m USING (vec_id) LEFT JOIN b ON b.vec_id = v.vec_id""")
def dbscan(s, d):
    return learn.dbscan(vectors(s, d), "vec_id", "v", 1.15, 4)


def _split(i):
    return f"SELECT threshold, round(gain, 10) AS gain FROM (SELECT (v + nx) / 2 AS threshold, {i.format(n='N', s='S')} - ln / N * ({i.format(n='ln', s='ls')}) - (N - ln) / N * ({i.format(n='(N - ln)', s='(S - ls)')}) AS gain FROM (SELECT v, lead(v) OVER (ORDER BY v) AS nx, CAST(sum(n) OVER (ORDER BY v) AS DOUBLE) AS ln, CAST(sum(s) OVER (ORDER BY v) AS DOUBLE) AS ls, CAST(sum(n) OVER () AS DOUBLE) AS N, CAST(sum(s) OVER () AS DOUBLE) AS S FROM (SELECT d.n_chars AS v, count(*) AS n, sum(quality) AS s FROM documents d JOIN labels USING (doc_id) GROUP BY 1)) WHERE nx IS NOT NULL) ORDER BY round(gain, 10) DESC, threshold LIMIT 1"


@query("tree_split", _split("2 * {s} / {n} * (1 - {s} / {n})"))
def tree_split(s, d):
    df = table(s, d, "documents").select("doc_id", "n_chars").join(table(s, d, "labels"), "doc_id")
    return learn.best_split(df, "n_chars", "quality").withColumn("gain", F.round("gain", 10))


def _model(kind, target, columns, **options):
    def run(s, d):
        df = table(s, d, "lineitem").select(*columns, (F.col("l_returnflag") == "R").cast("double").alias("flag"), "l_extendedprice")
        _, out = learn.mllib(df, columns, target, kind, **options)
        return out.groupBy().agg(F.count("*").alias("rows"), F.round(F.avg("prediction"), 4).alias("mean_prediction"))

    return run


X = ["l_quantity", "l_discount", "l_tax"]
for _name, _kind, _target, _options in [
    ("model_logistic", "logistic", "flag", {"maxIter": 10}), ("model_tree", "tree", "flag", {"maxDepth": 4}), ("model_forest", "forest", "flag", {"numTrees": 5, "maxDepth": 4, "seed": 1}), ("model_boosted", "boosted", "flag", {"maxIter": 3, "seed": 1}),
    ("model_svm", "svm", "flag", {"maxIter": 5}), ("model_mlp", "mlp", "flag", {"layers": [3, 4, 2], "maxIter": 5, "seed": 1}), ("model_naive_bayes", "naive_bayes", "flag", {}), ("model_lasso", "linear", "l_extendedprice", {"elasticNetParam": 1.0, "regParam": 0.1}),
    ("model_elastic_net", "linear", "l_extendedprice", {"elasticNetParam": 0.5, "regParam": 0.1}), ("model_tree_regressor", "tree_regressor", "l_extendedprice", {"maxDepth": 4}), ("model_forest_regressor", "forest_regressor", "l_extendedprice", {"numTrees": 5, "maxDepth": 4, "seed": 1}), ("model_boosted_regressor", "boosted_regressor", "l_extendedprice", {"maxIter": 3, "seed": 1}),
]:
    query(_name)(_model(_kind, _target, X, **_options))

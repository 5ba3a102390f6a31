"""Resampling, folds and splits."""

from pyspark.sql import functions as F

from tablesmith.operators import sampling
from tablesmith.registry import query, table

COUNTS = "SELECT quality, count(*) AS n FROM labels GROUP BY 1"


@query("class_counts", f"SELECT quality, n, round(max(n) OVER () / n, 6) AS imbalance FROM ({COUNTS})")
def class_counts(s, d):
    return sampling.class_counts(table(s, d, "labels"), "quality").withColumn("imbalance", F.round("imbalance", 6))


@query("oversample_plan", f"SELECT quality, n, CAST(floor(max(n) OVER () * .8) AS BIGINT) AS target, CAST(greatest(floor(max(n) OVER () * .8) - n, 0) AS BIGINT) AS more FROM ({COUNTS})")
def oversample_plan(s, d):
    return sampling.over_plan(table(s, d, "labels"), "quality", 0.8)


DRAW = "sha256('draw:' || doc_id)"


@query("oversample", f"WITH p AS (SELECT quality, n, max(n) OVER () - n AS more FROM ({COUNTS})), r AS (SELECT l.doc_id, l.quality, n, more, row_number() OVER (PARTITION BY l.quality ORDER BY {DRAW}, doc_id) AS r FROM labels l JOIN p USING (quality)) SELECT doc_id, quality, unnest(range(0, more // n + CAST(r <= more % n AS BIGINT) + 1)) AS copy FROM r")
def oversample(s, d):
    return sampling.over_sample(table(s, d, "labels").select("doc_id", "quality"), "quality", "doc_id")


@query("undersample", f"SELECT doc_id, quality FROM labels QUALIFY row_number() OVER (PARTITION BY quality ORDER BY {DRAW}, doc_id) <= (SELECT min(n) FROM ({COUNTS}))")
def undersample(s, d):
    return sampling.under_sample(table(s, d, "labels").select("doc_id", "quality"), "quality", "doc_id")


_VEC = "(SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"
_CLASS = "(SELECT label, count(*) AS n FROM embeddings GROUP BY 1)"


def vectors(s, d):
    return table(s, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def _miss(order):
    return f"""WITH big AS (SELECT label FROM {_CLASS} ORDER BY n DESC, label DESC LIMIT 1), m AS (SELECT vec_id, avg(d) AS mean FROM (SELECT a.vec_id, list_distance(a.v, b.v) AS d FROM {_VEC} a, {_VEC} b, big WHERE a.label = big.label AND b.label <> big.label
    QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY d {order}, b.vec_id) <= 3) GROUP BY 1) SELECT vec_id, label FROM embeddings WHERE label <> (SELECT label FROM big) OR vec_id IN (SELECT vec_id FROM m ORDER BY mean, vec_id LIMIT (SELECT min(n) FROM {_CLASS}))"""


@query("near_miss", _miss(""))
def near_miss(s, d):
    return sampling.near_miss(vectors(s, d), "label", "vec_id", "v").select("vec_id", "label")


@query("near_miss_2", _miss("DESC"))
def near_miss_2(s, d):
    return sampling.near_miss(vectors(s, d), "label", "vec_id", "v", version=2).select("vec_id", "label")


@query("smote")
def smote(s, d):
    return sampling.smote(vectors(s, d), "label", "vec_id", "v").select("source", "near", F.round(F.element_at("v", 1), 6).alias("v1"))


_NEAR = f"(SELECT a.vec_id, a.label, b.label AS other FROM {_VEC} a, {_VEC} b WHERE a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) <= 5)"
_SHARE = f"(SELECT vec_id, label, avg(CAST(label <> other AS DOUBLE)) AS share FROM {_NEAR} GROUP BY ALL)"


@query("borderline", f"SELECT vec_id, round(share, 6) AS share, share > .3 AND share < .7 AS borderline FROM {_SHARE}")
def borderline(s, d):
    return sampling.borderline(vectors(s, d), "label", "vec_id", "v").select("vec_id", F.round("share", 6).alias("share"), "borderline")


@query("adasyn_plan", f"SELECT vec_id, coalesce(CAST(floor(share / nullif(sum(share) OVER (), 0) * (SELECT max(n) - any_value(n) FILTER (label = 3) FROM {_CLASS}) + .5) AS BIGINT), 0) AS more FROM {_SHARE} WHERE label = 3")
def adasyn_plan(s, d):
    return sampling.adasyn_plan(vectors(s, d), "label", "vec_id", "v", 3)


@query("k_fold", "SELECT o_orderkey, CAST(CASE WHEN i < (n % 7) * (n // 7 + 1) THEN i // (n // 7 + 1) ELSE n % 7 + (i - (n % 7) * (n // 7 + 1)) // (n // 7) END AS INTEGER) AS fold FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders)")
def k_fold(s, d):
    return sampling.k_fold(table(s, d, "orders").select("o_orderkey"), 7, "o_orderkey")


@query("stratified_fold", "SELECT o_orderkey, CAST((row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) % 5 AS INTEGER) AS fold FROM orders")
def stratified_fold(s, d):
    return sampling.stratified(table(s, d, "orders"), "o_orderstatus", 5, "o_orderkey").select("o_orderkey", "fold")


@query("group_fold", "SELECT c_custkey, CAST((dense_rank() OVER (ORDER BY c_nationkey) - 1) % 4 AS INTEGER) AS fold FROM customer")
def group_fold(s, d):
    return sampling.group_fold(table(s, d, "customer"), "c_nationkey", 4).select("c_custkey", "fold")


@query("repeated_fold", "SELECT c_custkey, turn, CAST(CASE WHEN i < n % 5 * (n // 5 + 1) THEN i // (n // 5 + 1) ELSE n % 5 + (i - n % 5 * (n // 5 + 1)) // (n // 5) END AS INTEGER) AS fold FROM (SELECT c_custkey, turn, count(*) OVER (PARTITION BY turn) AS n, row_number() OVER (PARTITION BY turn ORDER BY sha256('draw:' || c_custkey || ':' || turn), c_custkey) - 1 AS i FROM customer, range(2) t(turn))")
def repeated_fold(s, d):
    return sampling.repeated(table(s, d, "customer").select("c_custkey"), 5, 2, "c_custkey")


@query("leave_one_out_fold", "SELECT n_nationkey, CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INTEGER) AS fold FROM nation")
def leave_one_out_fold(s, d):
    return sampling.k_fold(table(s, d, "nation").select("n_nationkey"), 25, "n_nationkey")


@query("tail_split", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 >= count(*) OVER () - floor(count(*) OVER () * .2) AS held FROM orders")
def tail_split(s, d):
    return sampling.tail_split(table(s, d, "orders").select("o_orderkey"), "o_orderkey", 0.2)


@query("stratified_split", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) > count(*) OVER (PARTITION BY o_orderstatus) - least(greatest(floor(count(*) OVER (PARTITION BY o_orderstatus) * .2), 1), count(*) OVER (PARTITION BY o_orderstatus) - 1) AS held FROM orders")
def stratified_split(s, d):
    return sampling.stratified_split(table(s, d, "orders"), "o_orderstatus", "o_orderkey", 0.2).select("o_orderkey", "held")


@query("borderline_points")
def borderline_points(s, d):
    rows = vectors(s, d)
    least = rows.groupBy("label").count().orderBy("count", "label").first()["label"]
    return sampling.borderline_points(rows, "label", "vec_id", "v", least).select("source", "near", F.round(F.element_at("v", 1), 6).alias("v1"))


@query("adasyn")
def adasyn(s, d):
    rows = vectors(s, d)
    least = rows.groupBy("label").count().orderBy("count", "label").first()["label"]
    return sampling.adasyn(rows, "label", "vec_id", "v", least, beta=4.0, most_share=1.0).select("source", "near", F.round(F.element_at("v", 1), 6).alias("v1"))

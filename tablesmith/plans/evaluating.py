"""Metrics, calibration, fairness, privacy, governance and monitoring."""

from pyspark.sql import functions as F

from tablesmith.functions.sums import means
from tablesmith.operators import choose
from tablesmith.operators import evaluate as ev
from tablesmith.operators import govern as gv
from tablesmith.registry import query, table

CLF = "(SELECT l.doc_id, lang, CAST(quality AS DOUBLE) AS y, CAST(l.doc_id * 37 % 101 AS DOUBLE) / 101 * .6 + .4 * quality * (l.doc_id % 3) / 2 AS p FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"


def clf(s, d):
    labels, docs = table(s, d, "labels"), table(s, d, "documents").select("doc_id", "lang")
    p = (F.col("doc_id") * 37 % 101).cast("double") / 101 * 0.6 + F.lit(0.4) * F.col("quality") * (F.col("doc_id") % 3) / 2
    return labels.join(docs, "doc_id").select("doc_id", "lang", F.col("quality").cast("double").alias("y"), p.alias("p"))


def r6(df, *keep):
    return df.select(*[c if c in keep else F.round(c, 6).alias(c) for c in df.columns])


@query("classification_metrics", f"SELECT round(acc, 6) AS accuracy, round(pr, 6) AS \"precision\", round(rc, 6) AS recall, round(2 * pr * rc / (pr + rc), 6) AS f1 FROM (SELECT avg(CAST(abs(y - p) < .5 AS DOUBLE)) AS acc, count(*) FILTER (y > .5 AND p > .5) / count(*) FILTER (p > .5) AS pr, count(*) FILTER (y > .5 AND p > .5) / count(*) FILTER (y > .5) AS rc FROM {CLF})")
def classification_metrics(s, d):
    return r6(ev.classification(clf(s, d), "y", "p"))


@query("regression_metrics", "SELECT round(avg(pow(l_extendedprice - 1000 * l_quantity, 2)), 2) AS mse, round(sqrt(avg(pow(l_extendedprice - 1000 * l_quantity, 2))), 4) AS rmse, round(avg(abs(l_extendedprice - 1000 * l_quantity)), 4) AS mae, round(1 - avg(pow(l_extendedprice - 1000 * l_quantity, 2)) / var_pop(l_extendedprice), 6) AS r2 FROM lineitem")
def regression_metrics(s, d):
    out = ev.regression(table(s, d, "lineitem").withColumn("p", 1000 * F.col("l_quantity")), "l_extendedprice", "p")
    return out.select(F.round("mse", 2).alias("mse"), F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"), F.round("r2", 6).alias("r2"))


@query("fold_scores", f"SELECT round(avg(a), 6) AS mean, round(stddev_pop(a), 6) AS std FROM (SELECT doc_id % 5 AS fold, avg(CAST(abs(y - p) < .5 AS DOUBLE)) AS a FROM {CLF} GROUP BY 1)")
def fold_scores(s, d):
    folds = clf(s, d).groupBy((F.col("doc_id") % 5).alias("fold")).agg(F.avg((F.abs(F.col("y") - F.col("p")) < 0.5).cast("double")).alias("a"))
    return folds.agg(F.round(F.avg("a"), 6).alias("mean"), F.round(F.stddev_pop("a"), 6).alias("std"))


_REL = f"SELECT CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS n, avg(p) AS confidence, avg(y) AS accuracy FROM {CLF} GROUP BY 1"
_ADA = f"SELECT CAST((row_number() OVER (ORDER BY p, doc_id) - 1) // CAST(ceil(count(*) OVER () / 10.0) AS BIGINT) AS INTEGER) AS bin, p, y FROM {CLF}"


@query("reliability_diagram", f"SELECT bin, n, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy FROM ({_REL})")
def reliability_diagram(s, d):
    return r6(ev.reliability(clf(s, d), "y", "p"), "bin", "n")


@query("calibration_error", f"SELECT round(sum(abs(confidence - accuracy) * n) / sum(n), 6) AS ece, round(max(abs(confidence - accuracy)), 6) AS mce FROM ({_REL})")
def calibration_error(s, d):
    return r6(ev.calibration_error(ev.reliability(clf(s, d), "y", "p")))


@query("calibration_error_adaptive", f"SELECT round(sum(abs(confidence - accuracy) * n) / sum(n), 6) AS ece, round(max(abs(confidence - accuracy)), 6) AS mce FROM (SELECT bin, count(*) AS n, avg(p) AS confidence, avg(y) AS accuracy FROM ({_ADA}) GROUP BY 1)")
def calibration_error_adaptive(s, d):
    return r6(ev.calibration_error(ev.adaptive(clf(s, d), "y", "p", "doc_id")))


@query("brier", f"SELECT round(avg(pow(p - y, 2)), 6) AS brier FROM {CLF}")
def brier(s, d):
    return r6(ev.brier(clf(s, d), "y", "p"))


@query("isotonic")
def isotonic(s, d):
    return r6(ev.isotonic(clf(s, d), "y", "p"), "n")


@query("platt")
def platt(s, d):
    a, b = ev.platt(clf(s, d), "y", "p")
    return s.createDataFrame([(round(a, 5), round(b, 5))], "a double, b double")


@query("temperature", f"""SELECT round(min_by(t, loss), 6) AS temperature FROM (SELECT t, avg(-CASE WHEN y > .5 THEN ln(1 / (1 + exp(-x / t)) + 1e-15) ELSE ln(1 - 1 / (1 + exp(-x / t)) + 1e-15) END) AS loss
    FROM (SELECT .25 * pow(16, i / 59.0) AS t FROM range(60) r(i)), (SELECT y, ln(greatest(p, 1e-12) / greatest(1 - p, 1e-12)) AS x FROM {CLF}) GROUP BY t)""")
def temperature(s, d):
    return s.createDataFrame([(round(ev.temperature(clf(s, d), "y", "p"), 6),)], "temperature double")


@query("conformal", "SELECT round(list_sort(list(abs(l_extendedprice - 1000 * l_quantity)))[CAST(greatest(1, least(count(*), ceil(.9 * (count(*) + 1)))) AS BIGINT)], 4) AS half_width FROM lineitem")
def conformal(s, d):
    df = table(s, d, "lineitem").select("l_extendedprice", (1000 * F.col("l_quantity")).alias("p"))
    return s.createDataFrame([(round(ev.conformal(df, "l_extendedprice", "p"), 4),)], "half_width double")


_P3 = "[p, (1 - p) * .75, (1 - p) * .25]"


@query("entropy_confidence", f"SELECT doc_id, round(1 + list_sum(list_transform({_P3}, lambda x: CASE WHEN x > 0 THEN x * ln(CASE WHEN x > 0 THEN x END) ELSE 0 END)) / ln(3), 6) AS confidence FROM {CLF}")
def entropy_confidence(s, d):
    p = F.col("p")
    return clf(s, d).select("doc_id", F.round(ev.entropy_confidence(F.array(p, (1 - p) * 0.75, (1 - p) * 0.25)), 6).alias("confidence"))


PREDS = "(SELECT c_custkey, m AS model, (c_custkey * (m + 3) + c_nationkey * m) % 4 AS label, CAST((c_custkey * (m + 7)) % 97 AS DOUBLE) AS value, m + 1.0::DOUBLE AS w FROM customer, range(5) t(m))"


def preds(s, d):
    m = s.range(5).withColumnRenamed("id", "m")
    c = table(s, d, "customer").select("c_custkey", "c_nationkey").crossJoin(F.broadcast(m))
    return c.select("c_custkey", F.col("m").alias("model"), ((F.col("c_custkey") * (F.col("m") + 3) + F.col("c_nationkey") * F.col("m")) % 4).alias("label"), ((F.col("c_custkey") * (F.col("m") + 7)) % 97).cast("double").alias("value"), (F.col("m") + 1.0).alias("w"))


@query("vote_hard", f"SELECT c_custkey, label FROM (SELECT c_custkey, label, count(*) AS n FROM {PREDS} GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY n DESC, label) = 1")
def vote_hard(s, d):
    return ev.hard_vote(preds(s, d), "c_custkey")


@query("vote_weighted", f"SELECT c_custkey, label FROM (SELECT c_custkey, label, sum(w) AS n FROM {PREDS} GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY n DESC, label) = 1")
def vote_weighted(s, d):
    return ev.hard_vote(preds(s, d), "c_custkey", F.col("w"))


@query("vote_mean", f"SELECT c_custkey, round(sum(value * w) / sum(w), 6) AS value FROM {PREDS} GROUP BY 1")
def vote_mean(s, d):
    return r6(ev.combine(preds(s, d), "c_custkey", "value", "mean", "w"), "c_custkey")


@query("vote_median", f"SELECT c_custkey, median(value) AS value FROM {PREDS} GROUP BY 1")
def vote_median(s, d):
    return ev.combine(preds(s, d), "c_custkey", "value", "median")


@query("vote_trimmed", f"SELECT c_custkey, round(list_avg(list_sort(list(value))[2:4]), 6) AS value FROM {PREDS} GROUP BY 1")
def vote_trimmed(s, d):
    return r6(ev.combine(preds(s, d), "c_custkey", "value", "trimmed", trim=0.2), "c_custkey")


_PR = "(SELECT l[CAST(floor(.05 * (len(l) - 1)) AS BIGINT) + 1] AS a, l[CAST(floor(.95 * (len(l) - 1)) AS BIGINT) + 1] AS b FROM (SELECT list_sort(list(l_quantity)) AS l FROM lineitem))"


@query("partial_dependence", f"SELECT round(a + (b - a) * i / 9, 6) AS grid, round(avg(2 * (a + (b - a) * i / 9) + 3 * l_discount), 6) AS mean FROM lineitem, {_PR}, range(10) t(i) GROUP BY a, b, i")
def partial_dependence(s, d):
    return r6(ev.partial_dependence(table(s, d, "lineitem"), "l_quantity", lambda g: 2 * g + 3 * F.col("l_discount")))


@query("ice", f"SELECT l_orderkey, l_linenumber, i, round(2 * (a + (b - a) * i / 3) + 3 * l_discount, 6) AS score FROM lineitem, {_PR}, range(4) t(i)")
def ice(s, d):
    from tablesmith.functions import order_stats

    df = table(s, d, "lineitem")
    place = lambda n: [int(0.05 * (n - 1)), int(0.95 * (n - 1))]
    n, found = order_stats.ranked(df, {"l_quantity": place})["l_quantity"]
    a, b = (found[k] for k in place(n))
    grid = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("i"), F.lit(a + (b - a) * i / 3).alias("g")) for i in range(4)]))
    return df.select("l_orderkey", "l_linenumber", "l_discount", grid.alias("s")).select("l_orderkey", "l_linenumber", "s.i", F.round(2 * F.col("s.g") + 3 * F.col("l_discount"), 6).alias("score"))


@query("shap_linear", "SELECT l_orderkey, l_linenumber, round((l_quantity - avg(l_quantity) OVER ()) * 2, 5) AS l_quantity, round((l_discount - avg(l_discount) OVER ()) * -3, 5) AS l_discount FROM lineitem")
def shap_linear(s, d):
    df = table(s, d, "lineitem")
    phi = ev.linear_shap(df, {"l_quantity": 2.0, "l_discount": -3.0})
    return df.select("l_orderkey", "l_linenumber", F.round(phi["l_quantity"], 5).alias("l_quantity"), F.round(phi["l_discount"], 5).alias("l_discount"))


@query("shap_importance", "SELECT 'l_quantity' AS \"column\", round(avg(abs((l_quantity - m) * 2)), 6) AS importance FROM lineitem, (SELECT avg(l_quantity) AS m FROM lineitem) UNION ALL SELECT 'l_discount', round(avg(abs((l_discount - m) * -3)), 6) FROM lineitem, (SELECT avg(l_discount) AS m FROM lineitem)")
def shap_importance(s, d):
    from tablesmith.operators.profile import per_column

    df = table(s, d, "lineitem")
    phi = df.select(*[c.alias(n) for n, c in ev.linear_shap(df, {"l_quantity": 2.0, "l_discount": -3.0}).items()])
    return per_column(phi, ["l_quantity", "l_discount"], {"importance": lambda c: F.round(F.avg(F.abs(c)), 6)})


def _moved(c):
    y = {"a": "2 * w.v + o.b", "b": "2 * o.a + w.v"}[c]
    return f"""SELECT '{c}' AS "column", round(avg((o.y - ({y})) ** 2), 2) AS importance FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS i FROM p) o JOIN (SELECT {c} AS v, row_number() OVER (ORDER BY sha256('{c}:' || o_orderkey), o_orderkey) AS i FROM p) w USING (i)"""


@query("permutation_importance", f"WITH p AS (SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS a, o_totalprice AS b, 2 * CAST(o_custkey AS DOUBLE) + o_totalprice AS y FROM orders) {_moved('a')} UNION ALL {_moved('b')}")
def permutation_importance(s, d):
    df = table(s, d, "orders").select("o_orderkey", F.col("o_custkey").cast("double").alias("a"), F.col("o_totalprice").alias("b")).withColumn("y", 2 * F.col("a") + F.col("b"))
    return ev.permutation_importance(df, ["a", "b"], "y", "o_orderkey", lambda a, b: 2 * a + b).withColumn("importance", F.round("importance", 2))


_FAIR = f"SELECT lang AS \"group\", count(*) AS n, count(*) FILTER (p > .4) / count(*) AS selection, coalesce(count(*) FILTER (p > .4 AND y = 1) / nullif(count(*) FILTER (y = 1), 0), 0) AS tpr, coalesce(count(*) FILTER (p > .4 AND y <> 1) / nullif(count(*) FILTER (y <> 1), 0), 0) AS fpr, coalesce(count(*) FILTER (p > .4 AND y = 1) / nullif(count(*) FILTER (p > .4), 0), 0) AS ppv, count(*) FILTER (y = 1) / count(*) AS base FROM {CLF} GROUP BY 1"


def decided(s, d):
    return clf(s, d).withColumn("q", (F.col("p") > 0.4).cast("int"))


@query("fairness_groups", f"SELECT \"group\", n, {', '.join(f'round({c}, 6) AS {c}' for c in ('selection', 'tpr', 'fpr', 'ppv', 'base'))} FROM ({_FAIR})")
def fairness_groups(s, d):
    return r6(ev.fairness(decided(s, d), "lang", "y", "q"), "group", "n")


@query("fairness_pairs", f"WITH f AS ({_FAIR}), p AS (SELECT a.\"group\" AS one, b.\"group\" AS other, least(a.selection, b.selection) / greatest(a.selection, b.selection) AS impact, abs(a.selection - b.selection) AS parity, greatest(abs(a.tpr - b.tpr), abs(a.fpr - b.fpr)) AS odds, abs(a.ppv - b.ppv) AS predictive FROM f a JOIN f b ON a.\"group\" < b.\"group\") SELECT one, other, round(impact, 6) AS impact, round(parity, 6) AS parity, round(odds, 6) AS odds, round(predictive, 6) AS predictive, impact >= .8 AND parity <= .1 AND odds <= .1 AND predictive <= .1 AS fair FROM p")
def fairness_pairs(s, d):
    return r6(ev.fairness_pairs(ev.fairness(decided(s, d), "lang", "y", "q")), "one", "other", "fair")


@query("bias_scan", f"SELECT lang AS \"group\", count(*) AS n, round(count(*) / any_value(t), 6) AS share, round(avg(y), 6) AS positive, count(*) / any_value(t) < .05 AND count(*) < 30 AS under, abs(avg(y) - any_value(r)) > .15 AS skewed FROM {CLF}, (SELECT count(*) AS t, avg(y) AS r FROM {CLF}) GROUP BY 1")
def bias_scan(s, d):
    return r6(ev.bias(clf(s, d), "lang", "y"), "group", "n", "under", "skewed")


SCANNED = ["contact", "reach", "c_name", "card_num", "home_city", "c_custkey"]
#: The same expressions, written for SQL: what values match, and what names say.
_VALUES = {
    "email": "[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+[.][a-zA-Z]{2,}", "phone": "([+]?[0-9]{1,3}[ -]?)?[(]?[0-9]{2,4}[)]?[ -]?[0-9]{3,4}[ -]?[0-9]{3,4}", "ssn": "[0-9]{3}-?[0-9]{2}-?[0-9]{4}",
    "credit_card": "[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}", "ip_address": "((25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)[.]){3}(25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)", "postal_code": "[0-9]{5}(-[0-9]{4})?",
}
_NAMED = {"email": "e[-_]?mail|email_addr", "phone": "phone|tel|mobile|cell", "ssn": "ssn|social_sec|national_id", "credit_card": "credit_card|card_num|cc_num", "name": "first_?name|last_?name|full_?name|surname|given_name", "address": "address|street|city|state|zip|postal", "date_of_birth": "dob|date_of_birth|birth_?date|birthday", "ip_address": "ip_addr|ip_address|source_ip|client_ip"}
_LUHN = "list_sum(list_transform(range(1, len(r) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(r[i] AS INT) ELSE (2 * CAST(r[i] AS INT)) // 10 + (2 * CAST(r[i] AS INT)) % 10 END)) % 10 = 0"
PEOPLE = """(SELECT c_custkey, 'user' || c_custkey || '@mail.com' AS contact, '555-' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') || '-1234' AS reach, c_name, CASE WHEN c_custkey % 2 = 0 THEN '4111 1111 1111 1111' ELSE '4111 1111 1111 1112' END AS card_num,
    CASE WHEN c_custkey % 3 > 0 THEN 'town' END AS home_city FROM customer)"""
_SCAN = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", kind, CASE WHEN kind = 'credit_card' THEN CASE WHEN luhn >= .05 AND (share > .1 OR named) THEN luhn END WHEN share > .1 THEN share WHEN named THEN .7 END AS confidence FROM ("
    f"SELECT kind, named, coalesce(avg(CAST(CASE WHEN pattern = '' THEN false ELSE regexp_full_match(v, pattern) END AS DOUBLE)), 0) AS share, coalesce(avg(CAST(coalesce(CASE WHEN regexp_full_match(x, '[0-9]+') THEN {_LUHN} END, false) AS DOUBLE)), 0) AS luhn "
    f"FROM (VALUES " + ", ".join(f"('{k}', '{_VALUES.get(k, '')}', regexp_matches('{c}', '{_NAMED.get(k, '^$')}'))" for k in dict.fromkeys([*_VALUES, *_NAMED])) + f") k(kind, pattern, named) LEFT JOIN (SELECT v, replace(replace(v, '-', ''), ' ', '') AS x, string_split(reverse(x), '') AS r FROM (SELECT trim(CAST({c} AS VARCHAR)) AS v FROM {PEOPLE} WHERE {c} IS NOT NULL ORDER BY c_custkey LIMIT 1000)) ON true GROUP BY ALL)"
    for c in SCANNED
)
_SCAN = f"(SELECT * FROM ({_SCAN}) WHERE confidence IS NOT NULL)"


def people(s, d):
    k = F.col("c_custkey").cast("string")
    card = F.when(F.col("c_custkey") % 2 == 0, "4111 1111 1111 1111").otherwise("4111 1111 1111 1112")
    return table(s, d, "customer").select("c_custkey", F.concat(F.lit("user"), k, F.lit("@mail.com")).alias("contact"), F.concat(F.lit("555-"), F.lpad((F.col("c_custkey") % 1000).cast("string"), 3, "0"), F.lit("-1234")).alias("reach"), "c_name", card.alias("card_num"), F.when(F.col("c_custkey") % 3 > 0, "town").alias("home_city"))


@query("pii_columns", f"SELECT \"column\", kind, round(confidence, 6) AS confidence FROM {_SCAN}")
def pii_columns(s, d):
    return r6(gv.pii_columns(people(s, d), SCANNED, order="c_custkey"), "column", "kind")


@query("pii_advice", f"SELECT \"column\", string_agg(kind, ',' ORDER BY kind) AS kinds, CASE WHEN bool_or(kind IN ('ssn', 'credit_card')) THEN 'remove' WHEN bool_or(kind IN ('email', 'phone', 'name')) THEN 'anonymize' ELSE 'review' END AS advice FROM {_SCAN} GROUP BY 1")
def pii_advice(s, d):
    return gv.pii_advice(gv.pii_columns(people(s, d), SCANNED, order="c_custkey"))


@query("pii_risk", f"SELECT count(DISTINCT \"column\") AS columns, CASE WHEN count(DISTINCT \"column\") = 0 THEN 'Low' WHEN count(DISTINCT \"column\") <= 2 THEN 'Medium' WHEN count(DISTINCT \"column\") <= 5 THEN 'High' ELSE 'Critical' END AS risk FROM {_SCAN}")
def pii_risk(s, d):
    found = gv.pii_columns(people(s, d), SCANNED, order="c_custkey")
    return found.agg(F.count_distinct("column").alias("columns")).withColumn("risk", gv.risk(F.col("columns")))


@query("randomize", "WITH a AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS i FROM customer), b AS (SELECT c_acctbal, row_number() OVER (ORDER BY substr(sha256('42:' || c_custkey), 1, 13)) AS i FROM customer) SELECT c_custkey, c_acctbal FROM a JOIN b USING (i)")
def randomize(s, d):
    return gv.randomize(table(s, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey")


@query("anonymize", "SELECT c_custkey, 'pseudo_' || substr(sha256('salt' || c_name), 1, 12) AS pseudonym, CASE WHEN strlen(c_name) > 3 THEN substr(c_name, 1, 3) || '***' ELSE repeat('*', strlen(c_name)) END AS masked, CASE WHEN c_acctbal >= 5000 THEN '5000+' WHEN c_acctbal >= 0 AND c_acctbal < 1000 THEN '0-1000' WHEN c_acctbal >= 1000 AND c_acctbal < 5000 THEN '1000-5000' ELSE '<0' END AS bin FROM customer")
def anonymize(s, d):
    return table(s, d, "customer").select("c_custkey", gv.pseudonym(F.col("c_name"), "salt").alias("pseudonym"), gv.mask(F.col("c_name")).alias("masked"), gv.generalize(F.col("c_acctbal"), [0.0, 1000.0, 5000.0]).alias("bin"))


@query("k_anonymity", "SELECT min(n) AS k FROM (SELECT count(*) AS n FROM customer GROUP BY c_mktsegment, c_nationkey)")
def k_anonymity(s, d):
    return gv.k_anonymity(table(s, d, "customer"), ["c_mktsegment", "c_nationkey"])


_KIND = "CASE o_orderstatus WHEN 'F' THEN 'restricted' WHEN 'O' THEN 'internal' ELSE 'public' END"


@query("retention", f"SELECT o_orderkey, CAST(e AS VARCHAR) AS expires, coalesce(e < DATE '1998-01-01', false) AS expired FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) + CASE {_KIND} WHEN 'restricted' THEN 30 WHEN 'internal' THEN 365 END AS e FROM orders)")
def retention(s, d):
    kind = F.when(F.col("o_orderstatus") == "F", "restricted").when(F.col("o_orderstatus") == "O", "internal").otherwise("public")
    expires, expired = gv.retention(F.col("o_orderdate"), kind, "1998-01-01")
    return table(s, d, "orders").select("o_orderkey", expires.cast("string").alias("expires"), expired.alias("expired"))


@query("compliance_score", "SELECT n_regionkey AS standard, round((count(*) FILTER (n_nationkey % 4 = 0) + .5 * count(*) FILTER (n_nationkey % 4 = 1)) / count(*) FILTER (n_nationkey % 4 <> 3), 6) AS score, count(*) FILTER (n_nationkey % 4 <> 3) AS controls, count(*) FILTER (n_nationkey % 4 = 2) AS gaps FROM nation GROUP BY 1")
def compliance_score(s, d):
    status = F.element_at(F.array(*map(F.lit, ("pass", "partial", "fail", "na"))), F.col("n_nationkey") % 4 + 1)
    return r6(gv.compliance(table(s, d, "nation").select(F.col("n_regionkey").alias("standard"), status.alias("status"))), "standard", "controls", "gaps")


def log(s, d):
    e = table(s, d, "events").select("user_id", "event_id", "value")
    return gv.chained(e, ["user_id"], ["event_id"], F.concat_ws(":", "event_id", "user_id"))


@query("audit_chain", """WITH RECURSIVE o AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
    c AS (SELECT user_id, event_id, i, 'genesis' AS prev, sha256('genesis|' || event_id || ':' || user_id) AS hash FROM o WHERE i = 1 UNION ALL SELECT o.user_id, o.event_id, o.i, c.hash, sha256(c.hash || '|' || o.event_id || ':' || o.user_id) FROM c JOIN o ON o.user_id = c.user_id AND o.i = c.i + 1)
    SELECT event_id, prev, hash FROM c""")
def audit_chain(s, d):
    return log(s, d).select("event_id", "prev", "hash")


@query("audit_verify", "SELECT event_id, event_id % 50 <> 7 AND coalesce(lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) % 50 <> 13, true) AND event_id % 50 <> 13 AS valid FROM events")
def audit_verify(s, d):
    """Entries whose payload was changed, or whose hash was: the latter breaks the next entry, too."""
    text = F.concat_ws(":", "event_id", "user_id")
    kept = log(s, d).withColumn("text", F.when(F.col("event_id") % 50 == 7, F.lit("tampered")).otherwise(text)).withColumn("hash", F.when(F.col("event_id") % 50 == 13, F.reverse("hash")).otherwise(F.col("hash")))
    return gv.verify_chain(kept, ["user_id"], ["event_id"], F.col("text")).select("event_id", "valid")


@query("latency_stats", "SELECT count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS low, max(value) AS high, " + ", ".join(f"list_sort(list(value))[CAST(floor({p} * (count(*) - 1)) AS BIGINT) + 1] AS p{q}" for p, q in ((.5, 50), (.95, 95), (.99, 99))) + " FROM events")
def latency_stats(s, d):
    return r6(gv.latency(table(s, d, "events"), "value"), "n", "low", "high", "p50", "p95", "p99")


@query("latency_histogram", " UNION ALL ".join(f"SELECT {b}::DOUBLE AS le, count(*) FILTER (value <= {b}) AS n FROM events" for b in (5, 10, 25, 50, 100, 250)))
def latency_histogram(s, d):
    return gv.cumulative(table(s, d, "events"), "value", [5, 10, 25, 50, 100, 250])


@query("error_budget", "SELECT user_id, round(r, 6) AS rate, round(greatest(0, least(100, (.25 - r) / .25 * 100)), 4) AS budget, r <= .25 AS met FROM (SELECT user_id, avg(CAST(event_type = 'error' AS DOUBLE)) AS r FROM events GROUP BY 1)")
def error_budget(s, d):
    out = gv.error_budget(table(s, d, "events"), "user_id", F.col("event_type") == "error", 0.25)
    return out.select("user_id", F.round("rate", 6).alias("rate"), F.round("budget", 4).alias("budget"), "met")


@query("alerts", "SELECT user_id, n, n > 120 AS busy, e > .25 AS failing FROM (SELECT user_id, count(*) AS n, avg(CAST(event_type = 'error' AS DOUBLE)) AS e FROM events GROUP BY 1)")
def alerts(s, d):
    return table(s, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.avg((F.col("event_type") == "error").cast("double")).alias("e")).select("user_id", "n", (F.col("n") > 120).alias("busy"), (F.col("e") > 0.25).alias("failing"))


@query("pareto_front", "SELECT a.s_suppkey FROM supplier a WHERE NOT EXISTS (SELECT 1 FROM supplier b WHERE b.s_acctbal <= a.s_acctbal AND b.s_nationkey <= a.s_nationkey AND (b.s_acctbal < a.s_acctbal OR b.s_nationkey < a.s_nationkey))")
def pareto_front(s, d):
    return ev.pareto(table(s, d, "supplier"), "s_suppkey", ["s_acctbal", "s_nationkey"]).select("s_suppkey")


@query("scalarized_score", "SELECT s_suppkey, round(.7 * (s_acctbal - min(s_acctbal) OVER ()) / (max(s_acctbal) OVER () - min(s_acctbal) OVER ()) + .3 * s_nationkey / 24, 6) AS score FROM supplier")
def scalarized_score(s, d):
    df = table(s, d, "supplier")
    low, high = df.agg(F.min("s_acctbal"), F.max("s_acctbal")).first()
    return df.select("s_suppkey", F.round(0.7 * (F.col("s_acctbal") - low) / (high - low) + 0.3 * F.col("s_nationkey") / 24, 6).alias("score"))


@query("rate_limit_fixed", "SELECT event_id, row_number() OVER (PARTITION BY user_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) ORDER BY ts, event_id) <= 3 AS accepted FROM events")
def rate_limit_fixed(s, d):
    return gv.rate_limit(table(s, d, "events"), "user_id", "ts", "event_id", 3, 86400, "fixed")


_CALLS = "o AS (SELECT event_id, user_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)"


@query("rate_limit_sliding", f"""WITH RECURSIVE {_CALLS}, c AS (SELECT event_id, user_id, i, [t] AS held, true AS accepted FROM o WHERE i = 1
    UNION ALL SELECT event_id, user_id, i, CASE WHEN len(k) < 3 THEN list_append(k, t) ELSE k END, len(k) < 3 FROM (SELECT o.*, list_filter(c.held, lambda x: x > o.t - 86400) AS k FROM c JOIN o ON o.user_id = c.user_id AND o.i = c.i + 1)) SELECT event_id, accepted FROM c""")
def rate_limit_sliding(s, d):
    return gv.rate_limit(table(s, d, "events"), "user_id", "ts", "event_id", 3, 86400)


@query("rate_limit_bucket", f"""WITH RECURSIVE {_CALLS}, c AS (SELECT event_id, user_id, i, t, 2.0::DOUBLE AS tokens, true AS accepted FROM o WHERE i = 1
    UNION ALL SELECT event_id, user_id, i, t, CASE WHEN k >= 1 THEN k - 1 ELSE k END, k >= 1 FROM (SELECT o.*, least(3.0::DOUBLE, c.tokens + (o.t - c.t) * 3 / 86400) AS k FROM c JOIN o ON o.user_id = c.user_id AND o.i = c.i + 1)) SELECT event_id, accepted FROM c""")
def rate_limit_bucket(s, d):
    return gv.rate_limit(table(s, d, "events"), "user_id", "ts", "event_id", 3, 86400, "bucket")


@query("priority_batches", "SELECT o_orderkey, CAST((row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority, o_orderkey) - 1) // 32 AS INTEGER) AS batch FROM orders")
def priority_batches(s, d):
    return gv.batches(table(s, d, "orders"), ["o_orderpriority", "o_orderkey"], 32, ["o_orderstatus"]).select("o_orderkey", "batch")


_QUEUES = "(SELECT user_id % 8 AS g, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, count(*) AS queue FROM events GROUP BY ALL)"


@query("backpressure", f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY day) AS i FROM {_QUEUES}), c AS (SELECT g, day, i, CASE WHEN queue > .8 * 15 THEN 500.0::DOUBLE ELSE 1200.0::DOUBLE END AS size FROM o WHERE i = 1
    UNION ALL SELECT o.g, o.day, o.i, CASE WHEN o.queue > .8 * 15 THEN greatest(100.0::DOUBLE, c.size * .5) ELSE least(10000.0::DOUBLE, c.size * 1.2::DOUBLE) END FROM c JOIN o ON o.g = c.g AND o.i = c.i + 1) SELECT g, day, CAST(floor(size) AS BIGINT) AS size FROM c""")
def backpressure(s, d):
    queues = table(s, d, "events").groupBy((F.col("user_id") % 8).alias("g"), F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 86400).alias("day")).agg(F.count("*").alias("queue"))
    return gv.backpressure(queues, ["g"], ["day"], "queue", 15).select("g", "day", "size")


def trials(s, d):
    """Scores that don't depend on the order of rows: plain sums would part trials of equal values by their last bits."""
    steps = table(s, d, "events").select(F.col("user_id").alias("trial"), (F.col("event_id") % 4).alias("step"), "value")
    return means(steps, ["trial", "step"], "value", "score")


@query("median_pruner", "WITH t AS (SELECT user_id AS trial, event_id % 4 AS step, avg(value) AS score FROM events GROUP BY ALL), m AS (SELECT step, list_sort(list(score))[count(*) // 2 + 1] AS mid FROM t GROUP BY 1) SELECT trial, step, score > mid AS prune FROM t JOIN m USING (step)")
def median_pruner(s, d):
    """Prunes a trial's step that is worse than the upper median of all trials at that step."""
    return choose.pruned(trials(s, d), 0.5)


@query("percentile_pruner", "WITH t AS (SELECT user_id AS trial, event_id % 4 AS step, avg(value) AS score FROM events GROUP BY ALL), m AS (SELECT step, list_sort(list(score))[least(CAST(floor(.25 * count(*)) AS BIGINT), count(*) - 1) + 1] AS mid FROM t GROUP BY 1) SELECT trial, step, score > mid AS prune FROM t JOIN m USING (step)")
def percentile_pruner(s, d):
    return choose.pruned(trials(s, d), 0.25)


def _span(c, i, k):
    return f"(SELECT l[CAST(floor(.05 * (len(l) - 1)) AS BIGINT) + 1] + (l[CAST(floor(.95 * (len(l) - 1)) AS BIGINT) + 1] - l[CAST(floor(.05 * (len(l) - 1)) AS BIGINT) + 1]) * {i} / {k} FROM (SELECT list_sort(list({c})) AS l FROM lineitem))"


@query("partial_dependence_2d", f"""WITH g AS (SELECT i, j, {_span('l_quantity', 0, 4)} AS a0, {_span('l_quantity', 4, 4)} AS a1, {_span('l_discount', 0, 4)} AS b0, {_span('l_discount', 4, 4)} AS b1 FROM range(5) t(i), range(5) u(j))
    SELECT round(a0 + (a1 - a0) * i / 4, 6) AS x, round(b0 + (b1 - b0) * j / 4, 6) AS y, round((SELECT avg(l_tax) FROM lineitem) + (a0 + (a1 - a0) * i / 4) * (b0 + (b1 - b0) * j / 4), 4) AS mean FROM g""")
def partial_dependence_2d(s, d):
    table_, _ = ev.partial_dependence_2d(table(s, d, "lineitem"), "l_quantity", "l_discount", lambda a, b: F.col("l_tax") + a * b)
    return r6(table_).withColumn("mean", F.round("mean", 4))


@query("ice_centered", f"SELECT l_orderkey, l_linenumber, i, round(({_span('l_quantity', 3, 3)} - {_span('l_quantity', 0, 3)}) * i / 3 * l_discount, 6) AS change FROM lineitem, range(4) t(i)")
def ice_centered(s, d):
    return r6(ev.centered_ice(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"], "l_quantity", lambda g: g * F.col("l_discount") + F.col("l_tax")), "l_orderkey", "l_linenumber", "i")


@query("beta_calibration")
def beta_calibration(s, d):
    a, b, c = ev.beta_calibration(clf(s, d), "y", "p")
    return s.createDataFrame([(round(a, 4), round(b, 4), round(c, 4))], "a double, b double, c double")

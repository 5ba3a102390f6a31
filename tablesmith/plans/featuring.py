"""Features, text and selection."""

from pyspark.sql import functions as F

from tablesmith.operators import features as fx
from tablesmith.registry import query, table

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PART = ["p_size", "p_retailprice"]


def part(s, d):
    return table(s, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")


@query("polynomial_features", 'SELECT p_partkey, 1.0::DOUBLE AS "1", p_size::DOUBLE AS p_size, p_retailprice, round(p_size * p_size, 4)::DOUBLE AS "p_size^2", round(p_size * p_retailprice, 4) AS "p_size * p_retailprice", round(p_retailprice * p_retailprice, 4) AS "p_retailprice^2" FROM part')
def polynomial_features(s, d):
    return part(s, d).select("p_partkey", *[(c if n in ("1", *PART) else F.round(c, 4)).alias(n) for n, c in fx.polynomial(PART, 2, bias=True).items()])


OPS = ["multiply", "add", "subtract", "divide", "max", "min", "mean", "difference"]


@query("interaction_features", 'SELECT p_partkey, round(a * b, 4) AS "p_size*p_retailprice", round(a + b, 4) AS "p_size+p_retailprice", round(a - b, 4) AS "p_size-p_retailprice", round(a / (b + 1e-10), 6) AS "p_size/p_retailprice", greatest(a, b) AS "max(p_size,p_retailprice)", least(a, b) AS "min(p_size,p_retailprice)", round((a + b) / 2, 4) AS "mean(p_size,p_retailprice)", round(abs(a - b), 4) AS "|p_size-p_retailprice|" FROM (SELECT p_partkey, p_size::DOUBLE AS a, p_retailprice AS b FROM part)')
def interaction_features(s, d):
    made = fx.interactions(PART, OPS)
    return part(s, d).select("p_partkey", *[(c if n[:3] in ("max", "min") else F.round(c, 6 if "/" in n else 4)).alias(n) for n, c in made.items()])


@query("auto_crossing", " UNION ALL ".join(f"SELECT * FROM (SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem) WHERE abs(r) >= .3" for i, a in enumerate(NUM) for b in NUM[i + 1 :]))
def auto_crossing(s, d):
    return fx.crossing(table(s, d, "lineitem"), NUM).withColumn("r", F.round("r", 6))


STOP = ", ".join(f"'{w}'" for w in "a an the and or but in on at to for of with by is was are were be have has it this that i you he she we they".split())
TOKENS = f"list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda t: strlen(t) >= 2 AND t NOT IN ({STOP}))"


@query("tokenize", f"SELECT item_id, array_to_string({TOKENS}, ' ') AS tokens, len({TOKENS}) AS n FROM benchmark")
def tokenize(s, d):
    words = fx.tokens(F.col("text"))
    return table(s, d, "benchmark").select("item_id", F.array_join(words, " ").alias("tokens"), F.size(words).cast("long").alias("n"))


@query("word_ngrams", f"SELECT item_id, array_to_string(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), '|') AS grams FROM (SELECT item_id, {TOKENS} AS w FROM benchmark)")
def word_ngrams(s, d):
    words = fx.tokens(F.col("text"))
    return table(s, d, "benchmark").select("item_id", F.array_join(fx.ngrams(words, 1, 2), "|").alias("grams"))


_TF = f"(SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest({TOKENS}) AS term FROM benchmark) GROUP BY ALL)"


@query("count_vectorizer", f"WITH t AS {_TF} SELECT item_id, term, tf FROM t JOIN (SELECT term, count(*) AS df FROM t GROUP BY 1 HAVING df >= 2 AND df <= (SELECT ceil(.8 * count(*)) FROM benchmark) ORDER BY df DESC, term LIMIT 300) USING (term)")
def count_vectorizer(s, d):
    docs = table(s, d, "benchmark")
    counts = fx.term_counts(docs, "item_id", fx.tokens(F.col("text")))
    return counts.join(fx.vocabulary(counts, docs.count(), 2, 0.8, 300), "term").select("item_id", "term", "tf")


def _tfidf(tf):
    return f"WITH t AS {_TF}, w AS (SELECT item_id, term, {tf} * (ln(((SELECT count(*) FROM benchmark) + 1) / (df + 1)) + 1) AS w FROM t JOIN (SELECT term, count(*) AS df FROM t GROUP BY 1) USING (term)) SELECT item_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY item_id)), 6) AS weight FROM w"


@query("tf_idf", _tfidf("tf"))
def tf_idf(s, d):
    return fx.tf_idf(table(s, d, "benchmark"), "item_id", fx.tokens(F.col("text"))).withColumn("weight", F.round("weight", 6))


@query("tf_idf_sublinear", _tfidf("(1 + ln(tf))"))
def tf_idf_sublinear(s, d):
    return fx.tf_idf(table(s, d, "benchmark"), "item_id", fx.tokens(F.col("text")), sublinear=True).withColumn("weight", F.round("weight", 6))


_SLOT = "list_reduce(list_concat([5::BIGINT], list_transform(range(0, strlen(term)), lambda i: CAST('0x' || substr(hex(term), 2 * i + 1, 2) AS BIGINT))), lambda h, b: (h * 33 + b) % 256)"


@query("hashing_vectorizer", f"WITH s AS (SELECT item_id, slot, count(*) AS n FROM (SELECT item_id, {_SLOT} AS slot FROM (SELECT item_id, unnest({TOKENS}) AS term FROM benchmark)) GROUP BY ALL) SELECT item_id, slot, round(n / sqrt(sum(n * n) OVER (PARTITION BY item_id)), 6) AS weight FROM s")
def hashing_vectorizer(s, d):
    return fx.hashing(table(s, d, "benchmark"), "item_id", fx.tokens(F.col("text"))).withColumn("weight", F.round("weight", 6))


@query("variance_selection", " UNION ALL ".join(f"SELECT * FROM (SELECT '{c}' AS \"column\", round(var_pop({c}), 6) AS variance FROM lineitem) WHERE variance > .001" for c in NUM))
def variance_selection(s, d):
    return fx.variances(table(s, d, "lineitem"), NUM).select("column", F.round("variance", 6).alias("variance")).where("variance > .001")


@query("correlation_selection", " UNION ALL ".join(f"SELECT * FROM (SELECT '{c}' AS \"column\", round(coalesce(corr({c}, l_extendedprice), 0), 6) AS r FROM lineitem) WHERE abs(r) >= .05" for c in NUM if c != "l_extendedprice"))
def correlation_selection(s, d):
    return fx.target_correlation(table(s, d, "lineitem"), [c for c in NUM if c != "l_extendedprice"], "l_extendedprice").withColumn("r", F.round("r", 6)).where("abs(r) >= .05")


@query("rank_selection", "SELECT \"column\", row_number() OVER (ORDER BY abs(r) DESC, \"column\") AS place FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", coalesce(corr({c}, l_extendedprice), 0) AS r FROM lineitem" for c in NUM if c != "l_extendedprice") + ")")
def rank_selection(s, d):
    from pyspark.sql import Window as W

    rows = fx.target_correlation(table(s, d, "lineitem"), [c for c in NUM if c != "l_extendedprice"], "l_extendedprice")
    return rows.select("column", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc(F.abs("r")), "column").rowsBetween(W.unboundedPreceding, 0)).cast("long").alias("place"))


def _bin(c):
    return f"least(floor(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) * 20), 19)"


_MI = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", x, y, count(*) AS n FROM (SELECT {_bin(c)} AS x, {_bin('l_extendedprice')} AS y FROM lineitem) GROUP BY ALL" for c in NUM if c != "l_extendedprice")


@query("mutual_information", f"WITH j AS ({_MI}), t AS (SELECT \"column\", n, sum(n) OVER (PARTITION BY \"column\") AS t, sum(n) OVER (PARTITION BY \"column\", x) AS nx, sum(n) OVER (PARTITION BY \"column\", y) AS ny FROM j) SELECT \"column\", round(sum(n / t * ln(n * t / (nx * ny))), 6) AS mi FROM t GROUP BY 1")
def mutual_information(s, d):
    return fx.mutual_information(table(s, d, "lineitem"), [c for c in NUM if c != "l_extendedprice"], "l_extendedprice").withColumn("mi", F.round("mi", 6))


_ALL = {**{c: c for c in NUM}, "twice": "l_quantity * 2 + 1"}
_CORR = " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, '{a}' AS a, '{b}' AS b, abs(corr({x}, {y})) AS r FROM lineitem" for i, (a, x) in enumerate(_ALL.items()) for j, (b, y) in enumerate(_ALL.items()) if i != j)


@query("redundant_columns", f"WITH r AS ({_CORR}), m AS (SELECT a, avg(r) AS m FROM r GROUP BY 1) SELECT DISTINCT CASE WHEN x.m > y.m THEN r.a ELSE r.b END AS \"column\" FROM r JOIN m x ON x.a = r.a JOIN m y ON y.a = r.b WHERE i < j AND r > .9")
def redundant_columns(s, d):
    df = table(s, d, "lineitem").select(*NUM, (F.col("l_quantity") * 2 + 1).alias("twice"))
    return s.createDataFrame([(c,) for c in fx.redundant(df, [*NUM, "twice"])], "column string")


@query("leakage", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(corr({x}, o_totalprice), 6) AS r, CASE WHEN abs(corr({x}, o_totalprice)) > .95 THEN 'critical' WHEN {str('date' in c).lower()} THEN 'warning' ELSE 'none' END AS leak FROM orders" for c, x in (("price_eur", "o_totalprice * .9"), ("order_date", "epoch(o_orderdate)"), ("o_custkey", "o_custkey"))))
def leakage(s, d):
    df = table(s, d, "orders").select((F.col("o_totalprice") * 0.9).alias("price_eur"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("order_date"), "o_custkey", "o_totalprice")
    return fx.leakage(df, ["price_eur", "order_date", "o_custkey"], "o_totalprice")


@query("high_cardinality", "SELECT * FROM (SELECT 'c_nationkey' AS \"column\", count(DISTINCT c_nationkey) AS n_unique FROM customer UNION ALL SELECT 'c_name', count(DISTINCT c_name) FROM customer) WHERE n_unique > 50")
def high_cardinality(s, d):
    from tablesmith.operators.profile import per_column

    return per_column(table(s, d, "customer"), ["c_nationkey", "c_name"], {"n_unique": F.count_distinct}).where("n_unique > 50")


@query("pca")
def pca(s, d):
    _, shares, projected = fx.pca(table(s, d, "lineitem"), NUM, 2)
    return projected.select("l_orderkey", "l_linenumber", F.round("pc1", 6).alias("pc1"), F.round("pc2", 6).alias("pc2"), F.lit(round(float(shares[0]), 6)).alias("share1"))


_ABS = "(" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", abs(coalesce(corr({c}, l_extendedprice), 0)) AS r FROM lineitem" for c in NUM if c != "l_extendedprice") + ")"


@query("rfe_selection", f"SELECT \"column\", CAST(CASE WHEN i <= 2 THEN 4 - i ELSE 1 END AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (ORDER BY r, \"column\") AS i FROM {_ABS})")
def rfe_selection(s, d):
    return fx.eliminated(table(s, d, "lineitem"), [c for c in NUM if c != "l_extendedprice"], "l_extendedprice", 1)


@query("percentile_selection", f"SELECT \"column\", round(r, 6) AS r FROM {_ABS} WHERE r >= (SELECT list_sort(list(r))[2] FROM {_ABS})")
def percentile_selection(s, d):
    return fx.by_percentile(table(s, d, "lineitem"), [c for c in NUM if c != "l_extendedprice"], "l_extendedprice", 60).withColumn("r", F.round("r", 6))


@query("importance_selection", f"SELECT \"column\", round(r, 6) AS r FROM {_ABS} WHERE r >= .005")
def importance_selection(s, d):
    rows = fx.target_correlation(table(s, d, "lineitem"), [c for c in NUM if c != "l_extendedprice"], "l_extendedprice")
    return rows.select("column", F.abs("r").alias("r")).where("r >= .005").withColumn("r", F.round("r", 6))

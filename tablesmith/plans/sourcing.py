"""Sources and streams over the driver's tables."""

import uuid

from pyspark.sql import functions as F

from tablesmith.registry import query, table
from tablesmith.sources import files
from tablesmith.streaming import pipeline as st


@query("read_parquet", "SELECT * FROM nation")
def read_parquet(s, d):
    return files.read(s, f"{d}/nation.parquet")


@query("read_parquet_columns", "SELECT o_orderkey, o_totalprice FROM orders")
def read_parquet_columns(s, d):
    return files.read(s, f"{d}/orders.parquet", columns=["o_orderkey", "o_totalprice"])


@query("url_source", r"""SELECT page_id, CASE WHEN regexp_matches(lower(url), '^https?://(localhost|127\.|10\.|192\.168\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.|\[::1\])') THEN 'blocked' WHEN NOT regexp_matches(lower(url), '^https?://') THEN 'invalid' WHEN regexp_matches(lower(url), '^https?://(www\.)?kaggle\.com/') THEN 'kaggle'
    WHEN regexp_matches(lower(url), '^https?://(www\.)?(raw\.)?github(usercontent)?\.com/') THEN 'github' WHEN regexp_matches(lower(url), '^https?://docs\.google\.com/spreadsheets/') THEN 'sheets' WHEN regexp_matches(lower(url), '^https?://huggingface\.co/datasets/') THEN 'huggingface' ELSE 'direct' END AS source,
    CASE WHEN regexp_matches(p, '\.csv$') THEN 'csv' WHEN regexp_matches(p, '\.tsv$') THEN 'tsv' WHEN regexp_matches(p, '\.jsonl?$') THEN 'json' WHEN regexp_matches(p, '\.(parquet|pq)$') THEN 'parquet' WHEN regexp_matches(p, '\.xlsx?$') THEN 'excel' ELSE 'unknown' END AS format FROM (SELECT *, regexp_replace(lower(url), '[?#].*$', '') AS p FROM pages)""")
def url_source(s, d):
    return table(s, d, "pages").select("page_id", files.url_source(F.col("url")).alias("source"), files.url_format(F.col("url")).alias("format"))


INTS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


@query("downcast_plan", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CASE WHEN min({c}) >= -128 AND max({c}) <= 127 THEN 'tinyint' WHEN min({c}) >= -32768 AND max({c}) <= 32767 THEN 'smallint' WHEN min({c}) >= -2147483648 AND max({c}) <= 2147483647 THEN 'int' ELSE 'bigint' END AS type FROM lineitem" for c in INTS))
def downcast_plan(s, d):
    return files.downcast(table(s, d, "lineitem"), INTS)


@query("size_class", "SELECT 'orders' AS name, CASE WHEN count(*) < 1000 THEN 'tiny' WHEN count(*) < 10000 THEN 'small' WHEN count(*) < 100000 THEN 'medium' WHEN count(*) < 1000000 THEN 'large' ELSE 'huge' END AS size FROM orders")
def size_class(s, d):
    return s.createDataFrame([("orders", files.size_class(table(s, d, "orders").count()))], "name string, size string")


def _stream(s, d, name):
    schema = table(s, d, name).schema
    return s.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet*").parquet(d)


@query("stream_running_stats", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(var_samp(value), 5) AS variance, min(value) AS low, max(value) AS high FROM events GROUP BY 1")
def stream_running_stats(s, d):
    out = st.drain(st.running(_stream(s, d, "events"), ["event_type"], "value"), f"running_{uuid.uuid4().hex}")
    return out.select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("variance", 5).alias("variance"), "low", "high")


@query("stream_windows", "SELECT CAST(epoch(time_bucket(INTERVAL 1 DAY, ts)) AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_windows(s, d):
    events = _stream(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = st.drain(st.windowed(events, "ts", ["event_type"], "value", "1 day"), f"windows_{uuid.uuid4().hex}")
    return out.select(F.unix_seconds("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("stream_scores", "SELECT event_id, round(.5 * value + 1, 6) AS score FROM events")
def stream_scores(s, d):
    out = st.drain(st.predict(_stream(s, d, "events"), 0.5 * F.col("value") + 1).select("event_id", "score"), f"scores_{uuid.uuid4().hex}", "append")
    return out.withColumn("score", F.round("score", 6))


_STATE = """WITH RECURSIVE o AS (SELECT user_id, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
    c AS (SELECT user_id, i, v AS mean, 0 + v - v - .005::DOUBLE AS total, least(0::DOUBLE, 0 + v - v - .005::DOUBLE) AS low FROM o WHERE i = 1
    UNION ALL SELECT user_id, i, m, t, least(low, t) FROM (SELECT o.user_id, o.i, .9999::DOUBLE * c.mean + (1 - .9999::DOUBLE) * o.v AS m, c.total + (o.v - (.9999::DOUBLE * c.mean + (1 - .9999::DOUBLE) * o.v) - .005::DOUBLE) AS t, c.low AS low FROM c JOIN o ON o.user_id = c.user_id AND o.i = c.i + 1))
    SELECT user_id, count(*) AS n, round(arg_max(total - low, i), 4) AS sum, bool_or(total - low > 50) AS drift FROM c GROUP BY 1"""


@query("stream_page_hinkley", _STATE)
def stream_page_hinkley(s, d):
    out = st.page_hinkley(_stream(s, d, "events"), "user_id", "event_id", "value")
    return st.drain(out, f"hinkley_{uuid.uuid4().hex}", "update").withColumn("sum", F.round("sum", 4))


@query("window_sessions", "WITH b AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM b) SELECT user_id, count(*) AS n, CAST(floor(epoch(min(ts))) AS BIGINT) AS start FROM s GROUP BY user_id, k")
def window_sessions(s, d):
    """Sessions of a user: events not further apart than six hours."""
    rows = table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = rows.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"), F.min("ts").alias("t"))
    return out.select("user_id", "n", F.unix_seconds("t").alias("start"))

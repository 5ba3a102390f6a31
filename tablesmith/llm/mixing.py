"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents are shuffled by a hash and laid end to end into one stream of words, cut into blocks
of equal size. A golden-ratio sequence runs through the cumulative weights of the sources, so that slot i of
the mix goes to one source; the slots of a source are ranked, and rank k plays its block k modulo its blocks.
Slots join blocks, blocks join the parts of documents in them. A source stops when its target is met.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, ready

#: Weights of the sources in order of their code points, null last, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Passes over a source at most.
PASSES = 3
#: A source is cut into blocks of 1 to this many words, and into at least BLOCKS of them where it has the words.
BLOCK_WORDS = 4096
BLOCKS = 256
#: Slots, and documents on average, whose running sums are taken together.
CHUNK = 4096
#: Sources are listed on the driver; more than this are refused.
MOST_SOURCES = 100_000
SEED = 20240101
#: Digits of the golden ratio's fractional part, as an integer over 10**16.
GOLDEN = 6180339887498949
WORD = r"[^\x20\x09-\x0D]+"


def water_fill(sizes: list[int], weights: list[float], most: float) -> list[float]:
    """Targets that share sum(sizes) by weight, none above ``most`` times its size; the excess is shared again."""
    total, free, out = float(sum(sizes)), set(range(len(sizes))), [0.0] * len(sizes)
    while free:
        scale = sum(weights[i] for i in free)
        over = {i for i in free if total * weights[i] / scale > most * sizes[i]}
        if not over:
            for i in free:
                out[i] = total * weights[i] / scale
            break
        for i in over:
            out[i] = float(most * sizes[i])
        total -= sum(out[i] for i in over)
        free -= over
    return out


def sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)).cast("long"), F.lit(0).cast("long")))


def targets(sizes: DataFrame) -> list[dict]:
    """One entry per source in order: its number, name, words, target, words to take and words in a block."""
    rows = sizes.groupBy("source").agg(F.sum("size").alias("size")).limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    rows.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    share = water_fill([r["size"] for r in rows], [WEIGHTS[i % len(WEIGHTS)] for i in range(len(rows))], PASSES)
    out = []
    for i, (r, t) in enumerate(zip(rows, share, strict=True)):
        take = min(round(t), PASSES * r["size"])
        out.append({"src": i, "source": r["source"], "source_size": r["size"], "target": t, "take": take, "block": max(1, min(BLOCK_WORDS, r["size"] // BLOCKS))})
    return out


def order_key(*cols) -> F.Column:
    """The place of a document in its source's shuffled stream, from 0 to 2**63 - 1."""
    return F.xxhash64(F.lit(SEED), *cols).bitwiseAND(F.lit(2**63 - 1))


def entities(docs: DataFrame) -> DataFrame:
    """(doc_id, source, fold, size, n, key): documents with equal rows counted once, n times."""
    rows = sized(docs).select("doc_id", "source", "size", F.xxhash64("text").alias("fold"))
    return rows.groupBy("doc_id", "source", "fold").agg(F.max("size").alias("size"), F.count("*").alias("n")).withColumn("key", order_key("doc_id", "fold"))


def _layout(sizes: DataFrame, sources: DataFrame, n: int) -> DataFrame:
    """(doc_id, fold, src, begin, end) on the stream of each source, in order of key.

    Documents fall into ranges of their key, of about CHUNK / 8 rows on average, and a range's words are summed
    before the ranges of a source are run through, so no task holds a whole source.
    """
    buckets = max(1, n * 8 // CHUNK)
    keyed = sizes.where("size > 0").join(F.broadcast(sources.select("src", F.col("source").alias("s"))), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    keyed = keyed.withColumn("all", F.col("size") * F.col("n")).withColumn("bucket", F.least(F.floor(F.col("key") / 2.0**63 * buckets), F.lit(buckets - 1)))
    sums = keyed.groupBy("src", "bucket").agg(F.sum("all").alias("words"))
    sums = cut(sums.withColumn("base", F.sum("words").over(W.partitionBy("src").orderBy("bucket")) - F.col("words")).drop("words"))
    run = W.partitionBy("src", "bucket").orderBy("key", "doc_id", "fold").rowsBetween(W.unboundedPreceding, 0)
    keyed = keyed.withColumn("upto", F.sum("all").over(run))
    return keyed.join(sums, ["src", "bucket"]).withColumn("end", F.col("base") + F.col("upto")).withColumn("begin", F.col("end") - F.col("all"))


def schedule(spark, sources: list[dict]) -> DataFrame:
    """The slots of the mix: (slot, src, rank, block, words), words being those that the slot plays of its block."""
    live = [s for s in sources if s["take"] > 0]
    schema = "slot long, src int, rank long, block long, words long"
    if not live:
        return spark.createDataFrame([], schema)
    need = [-(-s["take"] // s["block"]) + s["take"] // max(1, s["source_size"]) + 1 for s in live]
    total, low = sum(need), min(need)
    edges, run = [], 0
    for k in need:
        run += k
        edges.append(run / total)
    edges[-1] = 1.0
    of = F.array(*[F.lit(s["src"]) for s in live])
    slots = int(total * (1 + 8 / low)) + 64
    point = (F.pmod(F.col("slot").cast("decimal(20,0)") * F.lit(GOLDEN).cast("decimal(18,0)"), F.lit(10**16).cast("decimal(18,0)"))).cast("double") / 1e16
    table = spark.range(slots).withColumnRenamed("id", "slot").withColumn("u", point)
    table = table.withColumn("k", F.size(F.filter(F.array(*[F.lit(e) for e in edges[:-1]]), lambda e: e <= F.col("u"))))
    table = table.select("slot", F.element_at(of, F.col("k") + 1).alias("src"), F.floor(F.col("slot") / CHUNK).alias("chunk"))
    counts = table.groupBy("src", "chunk").agg(F.count("*").alias("n"))
    counts = counts.withColumn("before", F.sum("n").over(W.partitionBy("src").orderBy("chunk")) - F.col("n")).drop("n")
    ranked = table.withColumn("at", F.row_number().over(W.partitionBy("chunk", "src").orderBy("slot")) - 1).join(counts, ["src", "chunk"])
    facts = spark.createDataFrame([(s["src"], s["source_size"], s["take"], s["block"], -(-s["source_size"] // s["block"])) for s in live], "src int, size long, take long, w long, blocks long")
    out = ranked.join(F.broadcast(facts), "src").withColumn("rank", (F.col("before") + F.col("at")).cast("long"))
    out = out.withColumn("block", F.pmod("rank", "blocks")).withColumn("done", F.expr("rank div blocks") * F.col("size") + F.col("block") * F.col("w"))
    full = F.least(F.col("w"), F.col("size") - F.col("block") * F.col("w"))
    return out.withColumn("words", F.least(full, F.col("take") - F.col("done"))).where("words > 0").select("slot", "src", "rank", "block", "words")


def mix(docs: DataFrame) -> tuple[DataFrame, DataFrame, list[dict]]:
    """The mix of ``docs`` (doc_id, text, source): parts, documents and sources.

    parts: (slot, src, doc_id, fold, start, length), the words [start, start + length) of a document that a slot plays;
    documents: as ``entities`` gives them; sources: as ``targets`` does. A null text has no words and is never
    played; a null source is a source of its own, the last; equal rows follow each other as one document.
    """
    spark = ready(docs.sparkSession)
    sizes = cut(entities(docs))
    sources = targets(sizes.withColumn("size", F.col("size") * F.col("n")))
    if not sources:
        return spark.createDataFrame([], "slot long, src int, doc_id long, fold long, start long, length long"), sizes, sources
    facts = spark.createDataFrame([(s["src"], s["source"], s["block"]) for s in sources], "src int, source string, w long")
    laid = _layout(sizes, facts, sizes.count()).join(F.broadcast(facts.select("src", "w")), "src")
    parts = laid.withColumn("block", F.explode(F.sequence(F.expr("begin div w"), F.expr("(end - 1) div w"))))
    parts = parts.withColumn("lo", F.greatest(F.col("begin"), F.col("block") * F.col("w"))).withColumn("hi", F.least(F.col("end"), (F.col("block") + 1) * F.col("w")))
    parts = parts.select("src", "block", "doc_id", "fold", "begin", "lo", "hi", (F.col("block") * F.col("w")).alias("zero"))
    played = schedule(spark, sources).join(parts, ["src", "block"]).withColumn("hi", F.least(F.col("hi"), F.col("zero") + F.col("words"))).where("hi > lo")
    return played.select("slot", "src", "doc_id", "fold", (F.col("lo") - F.col("begin")).alias("start"), (F.col("hi") - F.col("lo")).alias("length")), sizes, sources


def taken(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, source, key, size, source_size, target, taken.

    Documents with null or empty texts have no words and are taken 0 times; texts of any length count whole. Rows that
    repeat a document share what the mix takes of it, as evenly as can be; a null source is a source of its own. Other
    columns are ignored, whatever their names; an empty table gives no rows.
    """
    parts, sizes, sources = mix(docs)
    facts = docs.sparkSession.createDataFrame([(s["source"], s["source_size"], s["target"]) for s in sources], "s string, source_size long, target double")
    played = parts.groupBy("doc_id", "fold").agg(F.sum("length").alias("played")).withColumnsRenamed({"doc_id": "id", "fold": "f"})
    out = sizes.join(played, sizes["doc_id"].eqNullSafe(F.col("id")) & (F.col("fold") == F.col("f")), "left")
    out = out.join(F.broadcast(facts), F.col("source").eqNullSafe(F.col("s"))).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    share = F.expr("(coalesce(played, 0L) + i) div n")
    return out.select("doc_id", "source", "key", "size", "source_size", "target", share.alias("taken"))


def apply(docs: DataFrame) -> DataFrame:
    """The documents of the mix, whole, each as often as it is taken (rounded), with the columns of ``docs``.

    What ``taken`` decides comes down to one number of passes and one last key for each source, so the texts
    themselves need no shuffle. Documents without words or with null texts are left out: no slot
    plays them. Rows that repeat a document go together; other columns pass through; an empty table gives no rows.
    """
    rows = taken(docs).where("size > 0").withColumn("times", F.floor(F.col("taken") / F.col("size") + 0.5))
    marks = rows.groupBy("source").agg(F.min("times").alias("least"), F.max("times").alias("most"))
    marks = cut(rows.join(F.broadcast(marks.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s"))).groupBy("s", "least").agg(F.max(F.when(F.col("times") > F.col("least"), F.col("key"))).alias("upto")))
    marks = marks.withColumnsRenamed({c: f"__{c}" for c in marks.columns})
    keyed = docs.where(F.regexp_count("text", F.lit(WORD)) > 0).withColumn("__key", order_key("doc_id", F.xxhash64("text")))
    keyed = keyed.join(F.broadcast(marks), F.col("source").eqNullSafe(F.col("__s")))
    times = F.col("__least") + F.when(F.col("__key") <= F.col("__upto"), 1).otherwise(0)
    return keyed.withColumn("__times", times).where("__times > 0").withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times").cast("long")))).select(*docs.columns)

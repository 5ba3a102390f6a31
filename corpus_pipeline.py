"""A pipeline over documents: language ID, near-duplicates, secrets, mixing and packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesmith.llm import jaccard, langid, mixing, packing, secrets
from tablesmith.llm.common import drop, read, ready

#: SQL expresses neither trained models nor packing; tests hold the stages against brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or text; a missing lang is filled with the predicted one."""
    found = langid.predict(docs, langid.fit(docs)).where(F.col("lang_pred") != langid.UNKNOWN)
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that with the smallest id, of each group whose five-word shingles are similar by 0.8 or more.

    Documents without words and rows without an id stay; see ``jaccard.distinct`` for rows that repeat an id.
    """
    return jaccard.distinct(docs, n=5, num=80, den=100)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts."""
    return secrets.redact(docs, secrets.built_in(spark))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often as it takes them."""
    return mixing.apply(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences."""
    import public_tokenizers

    return packing.digest(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("ngram_jaccard", ngram_jaccard), ("secret_scan", secret_scan), ("mixing", mix_sources), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage kept is written to the shared folder and read by the next.

    A stage's folder goes as soon as the next one is written; the last one stays, as the result reads it.
    """
    docs = read(spark, sf_dir, "documents")
    folder, before = f"{ready(spark).sparkContext.getCheckpointDir()}/stages-{uuid.uuid4().hex}", None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            drop(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)

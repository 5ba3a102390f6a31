"""The queries of this package: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hnsw, imatch, jaccard, katz, langid, mixing, packing, pii, secrets, warc
from .common import read


#: The key of surrogates; a production job passes its own.
SURROGATE_KEY = "change-me"


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.built_in(spark))
    return found.select("doc_id", "start", "length", F.sha2("token", 256).alias("token_sha256"), "votes", "is_secret")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest_pages(read(spark, sf_dir, "pages"))


def op3_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_documents(read(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return packing.digest(read(spark, sf_dir, "documents"), tokenizer)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.pseudonymize(read(spark, sf_dir, "documents"), SURROGATE_KEY)
    return out.select("doc_id", "text", "n_entities")


def op7_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(read(spark, sf_dir, "embeddings"), 0.9)


def op8_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.edited(read(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.taken(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(read(spark, sf_dir, "documents"), n=3, num=90, den=100).select("doc_id", F.col("n_shingles").cast("long"), "component_id")


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_warc, op3_katz, op4_language_id, op5_packing, op6_pii, op7_hnsw, op8_imatch, op9_mixing, op10_ngram_jaccard)}

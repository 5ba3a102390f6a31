"""I-Match fingerprints.

Terms (words as ``words`` has them) whose share of documents lies within a band form the lexicon. A document's
distinct terms in the lexicon are sorted and hashed, in 64 bits, once for each of several randomised subsets of the lexicon. Subsets
of several rates are used, so that short and long documents have subsets that hold a few of their terms.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, ready
from .sketch import slot_counts, slots
from .words import mix, word_hashes

#: The band: a term's documents over all documents. As a document has few terms, this bounds the lexicon.
LOWEST, HIGHEST = 1 / 400, 1 / 4
#: Terms that a lexicon can have; a corpus would need some thousand distinct terms in a document to exceed it.
MOST_TERMS = 1_000_000
SLOT_BITS = 19
#: Fewest documents of a term of the lexicon, in small corpora.
FEWEST = 2
#: Rates of the subsets: one of 2 ** RATES[i] terms is in subset i.
RATES = (3,) * 4 + (4,) * 6 + (5,) * 8 + (6,) * 8 + (7,) * 6
SEEDS = np.random.default_rng(11).integers(1, 1 << 63, len(RATES), dtype=np.uint64) | np.uint64(1)


def lexicon(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of the terms in the band, counted over all ``docs``.

    The first scan counts terms on slots; a slot below the band holds no term in it. The second scan counts the
    terms of the other slots exactly. Slots fill as documents grow in number, and so does the band's bound, so
    few slots are left at any size.
    """
    spark = ready(docs.sparkSession)
    n = docs.count()
    low, high = max(FEWEST, LOWEST * n), max(FEWEST, HIGHEST * n)
    texts = docs.select("text")
    heavy = spark.sparkContext.broadcast(slot_counts(texts, np.unique, SLOT_BITS) >= low)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = heavy.value
        known, counts, held, size = np.empty(0, np.uint64), np.empty(0, np.int64), [], 0

        def merge() -> None:
            nonlocal known, counts, held, size
            found, times = np.unique(np.concatenate([known[:0], *held]), return_counts=True)
            known, back = np.unique(np.concatenate([known, found]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([counts, times]), len(known)).astype(np.int64)
            held, size = [], 0

        for b in batches:
            h, offsets = word_hashes(b.column(0))
            keep = often[slots(h, SLOT_BITS)]
            for a, z in zip(offsets[:-1], offsets[1:], strict=True):
                held.append(np.unique(h[a:z][keep[a:z]]))
                size += len(held[-1])
            if size > 2_000_000:
                merge()
        merge()
        for at in range(0, len(known), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(known[at : at + (1 << 16)].view(np.int64)), pa.array(counts[at : at + (1 << 16)])], ["term", "n"])

    counted = texts.mapInArrow(exact, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    rows = counted.where((F.col("n") >= low) & (F.col("n") <= high)).select("term").limit(MOST_TERMS + 1).toPandas()
    if len(rows) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms in the band; narrow it")
    return np.sort(rows["term"].to_numpy(np.int64).view(np.uint64))


def _find(known: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places of hashes in ``known``; len(known) for those that aren't there."""
    at = np.searchsorted(known, h)
    at[at == len(known)] = 0
    at[known[at] != h] = len(known)
    return at


class Fingerprints:
    """A row of 64-bit hashes for each text, one for each subset; 0 where a subset holds none of its terms.

    A subset's hash is that of the sorted list of a text's distinct terms in the subset. A text with no term in any
    subset has the hash of all its terms, in or out of the lexicon, in the first place, told apart by its seed.
    """

    def __init__(self, terms: np.ndarray):
        self.terms = terms
        self.inside = np.array([mix(terms * s) >> np.uint64(64 - r) == 0 for s, r in zip(SEEDS, RATES, strict=True)]) if len(terms) else np.zeros((len(SEEDS), 0), bool)

    def __call__(self, texts: pa.Array) -> np.ndarray:
        h, offsets = word_hashes(texts)
        out = np.zeros((len(texts), len(self.inside)), np.uint64)
        at = _find(self.terms, h) if len(self.terms) else np.zeros(len(h), np.int64)
        for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
            found = np.unique(at[a:b])  # the lexicon is sorted, so places in it are in the order of terms
            found = found[found < len(self.terms)]
            if len(found):
                own, inside = self.terms[found], self.inside[:, found]
                for k in np.flatnonzero(inside.any(1)):
                    out[i, k] = xxhash.xxh3_64_intdigest(own[inside[k]].tobytes()) or 1
            if not out[i].any():
                out[i, 0] = xxhash.xxh3_64_intdigest(np.unique(h[a:b]).tobytes(), seed=1) or 1
        return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal hashes among the subsets that hold terms of either; 1 where none does."""
    used = (a != 0) | (b != 0)
    return np.where(used.any(1), ((a == b) & used).sum(1) / np.maximum(used.sum(1), 1), 1.0)


def _hex(rows: np.ndarray) -> list[str]:
    return [r.astype(">u8").tobytes().hex() for r in rows]


def fingerprint(docs: DataFrame, terms: np.ndarray | None = None) -> DataFrame:
    """(doc_id, fingerprint) of all ``docs``, whole texts; a null text is empty, equal texts have equal fingerprints."""
    shared = ready(docs.sparkSession).sparkContext.broadcast(Fingerprints(lexicon(docs) if terms is None else terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(_hex(shared.value(b.column("text"))))], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


def ordered(docs: DataFrame) -> DataFrame:
    """(part, guest, doc_id, text) in ranges of doc_id, descending: a range also has, as a guest, the document after it.

    The bounds of the ranges come from a scan of the ids alone. After the last document comes the first. Rows
    without a doc_id are the last; rows of equal ids are ordered by their texts.
    """
    spark = ready(docs.sparkSession)
    n = partitions(spark)
    ids = docs.select("doc_id")
    at = [i / n for i in range(1, n)]
    cuts = ids.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, at)) if at else F.array(F.lit(0.5)), 10000).alias("q")).first()["q"] if at else None
    cuts = sorted(set(cuts or []), reverse=True)
    part = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c > F.col("doc_id")))) if cuts else F.when(F.col("doc_id").isNotNull(), F.lit(0)), F.lit(len(cuts) + 1))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("part", part.cast("int"))
    tops = sorted((r["part"], r["top"]) for r in rows.groupBy("part").agg(F.max("doc_id").alias("top")).collect())
    if not tops:
        return rows.select("part", F.lit(False).alias("guest"), "doc_id", "text")
    # The first row of each range is the guest of the range before it, and the first of all of the last range.
    before = {p: tops[i - 1][0] for i, (p, _) in enumerate(tops)}
    lead = F.coalesce(*[F.when((F.col("part") == p) & F.col("doc_id").eqNullSafe(F.lit(top).cast("long")), F.lit(before[p])) for p, top in tops]).cast("int")
    host = F.explode(F.when(lead.isNull(), F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("guest")))).otherwise(F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("guest")), F.struct(lead.alias("part"), F.lit(True).alias("guest")))))
    placed = rows.withColumn("__to", host).select("__to.part", "__to.guest", "doc_id", "text")
    return placed.repartitionById(max(n, tops[-1][0] + 1), F.col("part")).sortWithinPartitions("part", "guest", F.desc_nulls_last("doc_id"), "text")


def edited(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of all ``docs`` (doc_id, text).

    The edited text ends in the first characters of the next document's, by descending doc_id; rows without a doc_id are
    the last, and rows of equal ids follow their texts. A null text is empty; texts of any length are taken whole; each
    row is a document of its own, also where it repeats another. Other columns are ignored, whatever their names; an
    empty table gives no rows.
    """
    shared = ready(docs.sparkSession).sparkContext.broadcast(Fingerprints(lexicon(docs)))
    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = shared.value
        last: tuple | None = None
        pairs: list[tuple] = []

        def out() -> pa.RecordBatch:
            nonlocal pairs
            rows, pairs = pairs, []
            new = [t[: len(t) - len(t) // 2] + after[: len(t) // 2] for _, t, after in rows]
            own = prints(pa.array([t for _, t, _ in rows], pa.large_string()))
            changed = prints(pa.array(new, pa.large_string()))
            following = np.vstack([own[1:], own[-1:]])
            apart = [i for i, (_, _, after) in enumerate(rows) if i + 1 == len(rows) or rows[i + 1][1] is not after]
            if apart:
                following[apart] = prints(pa.array([rows[i][2] for i in apart], pa.large_string()))
            sha = [hashlib.sha256(t.encode()).hexdigest() for t in new]
            data = [[r[0] for r in rows], [len(r[1]) for r in rows], sha, _hex(own), _hex(changed), likeness(own, changed), likeness(own, following)]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(d, k) for d, k in zip(data, kinds, strict=True)], columns)

        size = closed = 0
        for b in batches:
            for part, guest, doc, text in zip(*(b.column(c).to_pylist() for c in ("part", "guest", "doc_id", "text")), strict=True):
                if last is not None and last[0] == part and not (guest and closed == part + 1):
                    pairs.append((last[1], last[2], text))
                    size += len(last[2])
                    if size > 4 << 20 or len(pairs) >= 2000:
                        yield out()
                        size = 0
                if guest:
                    closed = part + 1
                    last = None
                else:
                    last = (part, doc, text)
        if pairs:
            yield out()

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered(docs).mapInArrow(run, schema)

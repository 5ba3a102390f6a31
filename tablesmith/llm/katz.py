"""A Katz back-off bigram model: Good-Turing discounts, back-off weights that normalise exactly, all words and pairs.

P(w) is the discounted count of w over all tokens, and what the discounts leave is the one unknown word's. P(w | h)
is the discounted count of (h, w) over the count of h, or else the weight of h times P(w), the weight being what the
discounts of h leave over what P leaves to words not seen after h. Counts up to K are discounted by Good-Turing, and
greater ones by as much as K is, so that something is left after every history.

Counts lie in tables dealt by word: a table has all occurrences (word, word before, document), packed, of its words.
Frequent words are dealt by pair. The tables are scanned twice: for counts of counts, then for the terms of every
document's score; weights are asked for only where a pair wasn't seen. No table is ever gathered in one place.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCK, batches, dealt, numbered, pack, read, release, slices, small, text_bytes, unpack
from .common import ready, shuffled
from .sketch import PARTS, slots
from .words import mix, word_hashes

#: Counts up to this are discounted by Good-Turing.
K = 5
#: Added to every count by the base model.
ADDED = 0.1
#: Tokens that are packed together, and at most about as many that one bucket gets.
TOKENS, BUCKET_TOKENS = 1_000_000, 4_000_000
#: Bytes of text per token, at least.
TOKEN_BYTES = 5
#: Frequent words that get a short number in packed tables, and how often a task must see one to name it.
SHORT, OFTEN = 65_000, 20
#: A word with this share of a table, on average, is dealt by pair.
HOT = 0.25
#: Bits of the table of words in held-out documents, by which weights that none asks for are left out.
SEEN_BITS = 22
FIRST, LAST = np.uint64(0x1F0E1D2C3B4A5968), np.uint64(0x6C8E9CF570932BD5)


def _frequent(docs: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent words' hashes, sorted, and those to be dealt by pair. Only sizes and evenness depend on them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, held, size = np.empty(0, np.uint64), np.empty(0, np.int64), [], 0

        def merge() -> None:
            nonlocal known, counts, held, size
            found, times = np.unique(np.concatenate([known[:0], *held]), return_counts=True)
            known, back = np.unique(np.concatenate([known, found]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([counts, times]), len(known)).astype(np.int64)
            held, size = [], 0

        for b in slices(batches):
            held.append(word_hashes(b.column(0))[0])
            size += len(held[-1])
            if size > TOKENS:
                merge()
        merge()
        keep = counts >= OFTEN
        yield pa.RecordBatch.from_arrays([pa.array(known[keep].view(np.int64)), pa.array(counts[keep])], ["word", "n"])
        release()

    rows = docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(SHORT).toArrow()
    words, n = rows["word"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    return np.sort(words), np.sort(words[n > HOT * n.sum() / buckets])


def _held_words(docs: DataFrame) -> np.ndarray:
    """Whether a slot has a word of the texts of ``docs``: a table of fixed size, joined in PARTS ranges."""
    width = (1 << SEEN_BITS) // PARTS

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << SEEN_BITS, bool)
        for b in slices(batches):
            seen[slots(word_hashes(b.column(0))[0], SEEN_BITS)] = True
        data = [np.packbits(seen[i * width : (i + 1) * width]).tobytes() for i in range(PARTS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array(data, pa.binary())], ["part", "data"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for b in batches:
            for part, data in zip(b.column("part").to_pylist(), b.column("data").to_pylist(), strict=True):
                now = np.frombuffer(data, np.uint8)
                seen[part] = seen[part] | now if part in seen else now
        for part, now in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([now.tobytes()], pa.binary())], ["part", "data"])

    out = np.zeros(1 << SEEN_BITS, bool)
    for r in docs.select("text").mapInArrow(look, "part int, data binary").repartitionById(PARTS, F.col("part")).mapInArrow(join, "part int, data binary").collect():
        out[r["part"] * width : (r["part"] + 1) * width] = np.unpackbits(np.frombuffer(r["data"], np.uint8)).astype(bool)
    out[slots(np.array([FIRST]), SEEN_BITS)] = True
    return out


def _find(known: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places in ``known``, sorted; len(known) where it lacks a value."""
    at = np.searchsorted(known, h)
    if len(known):
        at[at == len(known)] = 0
        at[known[at] != h] = len(known)
    return at


def _tables(docs: DataFrame, short: np.ndarray, hot: np.ndarray, buckets: int) -> DataFrame:
    """(bucket, kind, source, data): packed occurrences (kind 0), and each source's documents (kind 1)."""
    shared = docs.sparkSession.sparkContext.broadcast((short, hot))

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        short, hot = shared.value
        task, turn = TaskContext.get().partitionId(), 0
        ids, held, train, words, sizes = [], [], [], [], []

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal turn, ids, held, train, words, sizes
            source = (task << 24) + turn
            turn += 1
            n, learned = np.array(sizes, np.int64), np.array(train, bool)
            ends = np.cumsum(n + 1) - 1
            known, number = numbered(np.append(np.insert(np.concatenate(words), np.cumsum(n), LAST), FIRST))
            words = []
            before = np.append(number[-1:], number[:-2])
            before[ends[:-1] + 1] = number[-1]
            # One value for (word, word before, document): fewer than 2**63, as TOKENS bounds all three.
            key = number[:-1] * np.int64(len(known)) + before
            del number, before
            key *= len(n)
            key += np.repeat(np.arange(len(n)), n + 1)
            key, times = np.unique(key, return_counts=True)
            doc, times = (key % len(n)).astype(np.int32), small(times)
            key //= len(n)
            wide, before = (key // len(known)).astype(np.int32), (key % len(known)).astype(np.int32)
            del key
            bucket = (known % np.uint64(buckets)).astype(np.int32)[wide]
            if len(hot):
                spread = np.flatnonzero((_find(hot, known) < len(hot))[wide])
                bucket[spread] = mix(known[wide[spread]] ^ (known[before[spread]] * np.uint64(3))) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
            code = _find(short, known)
            rows, where = [], []
            for i in range(buckets):
                own = order[bounds[i] : bounds[i + 1]]
                if len(own):
                    first = np.flatnonzero(np.diff(wide[own], prepend=-1))
                    rare, at = np.unique(before[own][code[before[own]] == len(short)], return_inverse=True)
                    h = code[before[own]]
                    h[h == len(short)] = len(short) + at
                    rows.append(pack({"w": known[wide[own[first]]], "k": small(np.diff(np.append(first, len(own)))), "rare": known[rare], "h": h.astype(np.uint32), "doc": small(doc[own]), "n": times[own], "t": np.packbits(learned[doc[own]])}))
                    where.append(i)
            rows.append(pickle.dumps((ids, held, (n + 1).tolist())))
            where.append(source % buckets)
            kind = [0] * (len(rows) - 1) + [1]
            ids, held, train, words, sizes = [], [], [], [], []
            yield from batches([(i, source, k, x) for i, k, x in zip(where, kind, rows, strict=True)])

        size = 0
        for b in slices(found):
            h, offsets = word_hashes(b.column("text"))
            words.append(h)
            sizes += np.diff(offsets).tolist()
            ids += b.column("doc_id").to_pylist()
            train += b.column("train").to_pylist()
            held += b.column("held_out").to_pylist()
            size += len(h) + b.num_rows
            if size > TOKENS:
                yield from out()
                size = 0
        if ids:
            yield from out()
        release()

    return docs.select("doc_id", "train", "held_out", "text").mapInArrow(run, BLOCK)


def _step(frame: DataFrame, run) -> DataFrame:
    """``run`` over the rows (bucket, source, kind, data) of each partition, which it holds in memory one bucket at a time."""

    def each(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in run(read(found)):
            yield from batches([row])
        release()

    return frame.mapInArrow(each, BLOCK)


class Table:
    """One bucket's occurrences, with the counts of training documents."""

    def __init__(self, rows: list[tuple[int, bytes]], short: np.ndarray):
        names = ("w", "h", "doc", "n", "at", "learned")
        parts: dict[str, list[np.ndarray]] = {k: [] for k in names}
        self.sources = [s for s, _ in rows]
        for i, (_, data) in enumerate(rows):
            x = unpack(data)
            h = np.concatenate([short, x["rare"]])[x["h"]]
            own = (np.repeat(x["w"], x["k"].astype(np.int64)), h, x["doc"].astype(np.int32), x["n"].astype(np.int32), np.full(len(h), i, np.int32), np.unpackbits(x["t"])[: len(h)].astype(bool))
            for k, a in zip(names, own, strict=True):
                parts[k].append(a)
        rows.clear()
        for k in names:
            setattr(self, k, np.concatenate(parts.pop(k)))
        taught = self.n * self.learned
        del self.learned
        self.words, self.word = numbered(self.w)
        self.count = np.bincount(self.word, taught, len(self.words)).astype(np.int64)
        pairs = mix(self.w) ^ (self.h * np.uint64(0x2545F4914F6CDD1D))
        del self.w
        pairs, self.pair, first = numbered(pairs, True)
        self.pair_count = np.bincount(self.pair, taught, len(pairs)).astype(np.int64)
        self.pair_word, self.pair_h = self.word[first], self.h[first]


def _discounts(of: np.ndarray) -> np.ndarray:
    """The discounted count over the count, for counts 0 to K, and last what is taken from each greater count.

    ``of``: the numbers of things seen 0 to K + 1 times. Where Good-Turing's are not all between 0 and 1, as with
    few data, every count loses n1 / (n1 + 2 n2), kept between 0.1 and 0.9.
    """
    out = np.ones(K + 2)
    n = of.astype(float)
    with np.errstate(all="ignore"):
        common = (K + 1) * n[K + 1] / n[1]
        r = np.arange(1, K + 1)
        good = ((r + 1) * n[r + 1] / n[r] / r - common) / (1 - common)
    if np.isfinite(good).all() and (good > 0).all() and (good < 1).all():
        out[1 : K + 1] = good
    else:
        lost = min(0.9, max(0.1, n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5))
        out[1 : K + 1] = (r - lost) / r
    out[K + 1] = K * (1 - out[K])
    return out


def _discounted(count: np.ndarray, by: np.ndarray) -> np.ndarray:
    return np.where(count <= K, count * by[np.minimum(count, K)], count - by[K + 1])


def _rows(items: Iterator[tuple[int, int, int, bytes]]) -> tuple[list, list]:
    tables, papers = [], []
    for _, source, kind, data in items:
        (papers if kind else tables).append((source, data))
    return tables, papers


def _facts(short: np.ndarray, hot: np.ndarray):
    """Of each bucket: tokens, words and counts of counts without hot words, counts of hot words, pairs' counts of counts."""

    def run(items: Iterator) -> Iterator[tuple]:
        tables, _ = _rows(items)
        if not tables:
            return
        t = Table(tables, short)
        is_hot = _find(hot, t.words) < len(hot)
        cold = t.count[~is_hot]
        of = lambda c: np.bincount(np.minimum(c[c > 0], K + 2), minlength=K + 3)[: K + 2]
        first = int(t.count[t.words == LAST].sum())
        facts = int(t.count.sum()), int((cold > 0).sum()), of(cold), dict(zip(t.words[is_hot].tolist(), t.count[is_hot].tolist(), strict=True)), of(t.pair_count), first
        yield 0, 0, 0, pickle.dumps(facts)

    return run


def _steps(count: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Where counts are 1 to K, and under K + 1 where they're more."""
    return [(r, np.flatnonzero(count == r)) for r in range(1, K + 1)] + [(K + 1, np.flatnonzero(count > K))]


def _score_terms(fixed, model, buckets: int):
    """Terms of scores by source (kind 0), documents (kind 1), what is left after histories (2) and who asks for it (3)."""

    def run(items: Iterator) -> Iterator[tuple[int, tuple]]:
        short, hot, asked = fixed.value
        hot_counts = model.value[3]
        tables, papers = _rows(items)
        for source, data in papers:
            yield source % buckets, source, 1, data
        if not tables:
            return
        t = Table(tables, short)
        count = t.count.copy()
        for i in np.flatnonzero(_find(hot, t.words) < len(hot)):
            count[i] = hot_counts.get(int(t.words[i]), 0)
        seen = t.pair_count > 0
        # For each occurrence the two counts on which its terms depend: integers, most of them small, take fewer bytes than sums.
        order = np.lexsort((t.doc, t.at))
        bounds = np.searchsorted(t.at[order], np.arange(len(t.sources) + 1))
        end = np.flatnonzero(t.words == LAST)
        for i, source in enumerate(t.sources):
            own = order[bounds[i] : bounds[i + 1]]
            word = t.word[own]
            yield source % buckets, source, 0, pack({"doc": small(np.diff(t.doc[own], prepend=0)), "n": small(t.n[own]), "word": small(count[word]), "pair": small(t.pair_count[t.pair[own]]), "end": np.packbits(np.isin(word, end))})
        del order
        # Of each history asked for what its weight depends on, as integers: how many pairs were seen 1 to K times and
        # oftener, how many words after it were, and the count of the latter; they say what is left, and what is covered.
        need = np.flatnonzero(asked[slots(t.pair_h, SEEN_BITS)] & seen)
        h, at = numbered(t.pair_h[need])
        word = count[t.pair_word[need]]
        facts = {f"p{r}": np.bincount(at[which], minlength=len(h)) for r, which in _steps(t.pair_count[need])}
        facts |= {f"w{r}": np.bincount(at[which], minlength=len(h)) for r, which in _steps(word)}
        facts["often"] = np.bincount(at, np.where(word > K, word, 0), len(h)).astype(np.int64)
        facts["unknown"] = np.bincount(at[word == 0], minlength=len(h))
        new = ~seen[t.pair]
        where = h % np.uint64(buckets)
        for i in range(buckets):
            own = np.flatnonzero(where == i)
            if len(own):
                yield i, 0, 2, pack({"h": small(np.diff(h[own], prepend=np.uint64(0)))} | {k: small(v[own]) for k, v in facts.items()})
        ask = np.flatnonzero(new)
        where = (t.h[ask] % np.uint64(buckets)).astype(np.int64)
        ask, where = ask[order := np.argsort(where, kind="stable")], where[order]
        bounds = np.searchsorted(where, np.arange(buckets + 1))
        for i in range(buckets):
            own = ask[bounds[i] : bounds[i + 1]]
            if len(own):
                yield i, 0, 3, pack({"sources": np.array(t.sources, np.int64), "h": t.h[own], "at": small(t.at[own]), "doc": small(t.doc[own]), "n": small(t.n[own])})

    return run


def _add(into: dict[int, dict[str, np.ndarray]], source: int, doc: np.ndarray, **values: np.ndarray) -> None:
    """Adds values by document to the sums of a source."""
    sums = into.setdefault(source, {k: np.zeros(0) for k in ("score", "base", "known")})
    size = int(doc.max(initial=-1)) + 1
    for k, v in values.items():
        now = np.bincount(doc, v, size)
        if len(sums[k]) < size:
            sums[k] = np.pad(sums[k], (0, size - len(sums[k])))
        sums[k][:size] += now


def _weights(model, buckets: int):
    """Adds up terms by source, and sends each who asks the logarithm of a history's weight times its count."""

    def run(items: Iterator[tuple[int, int, int, bytes]]) -> Iterator[tuple[int, int, int, bytes]]:
        total, vocabulary, _, _, by_word, by_pair, unknown = model.value
        sums: dict[int, dict] = {}
        left, asks = [], []
        for _, source, kind, data in items:
            if kind == 1:
                yield source % buckets, source, 1, data
                continue
            x = unpack(data)
            if kind == 2:
                low = np.arange(1, K + 1)
                lost = np.append(low * (1 - by_pair[1 : K + 1]), by_pair[K + 1])
                p = np.append(low * by_word[1 : K + 1], -by_word[K + 1])
                rest = sum(x.pop(f"p{r}") * lost[r - 1] for r in range(1, K + 2))
                seen = sum(x.pop(f"w{r}") * p[r - 1] for r in range(1, K + 2)) + x["often"]
                left.append((np.cumsum(x["h"], dtype=np.uint64), rest, seen / max(total, 1) + x["unknown"] * unknown))
            elif kind == 3:
                asks.append(x)
            else:
                doc, n = np.cumsum(x["doc"], dtype=np.int64), x["n"].astype(np.int64)
                word, pair = x["word"].astype(np.int64), x["pair"].astype(np.int64)
                history = (word > 0) & ~np.unpackbits(x["end"])[: len(doc)].astype(bool)
                p = np.where(word > 0, _discounted(word, by_word) / max(total, 1), unknown)
                term = np.log10(np.where(pair > 0, np.maximum(_discounted(pair, by_pair), 1e-300), p)) - np.where(history, np.log10(np.maximum(word, 1)), 0.0)
                _add(sums, source, doc, score=n * term, base=n * np.log10((word + ADDED) / (total + ADDED * (vocabulary + 1))), known=n * (word > 0))
        if asks and left:
            h, at = numbered(np.concatenate([x[0] for x in left]))
            rest = np.bincount(at, np.concatenate([x[1] for x in left]), len(h))
            free = 1 - np.bincount(at, np.concatenate([x[2] for x in left]), len(h))
            weight = np.log10(np.maximum(rest, 1e-300) / np.maximum(free, 1e-300))
            for x in asks:
                place = _find(h, x["h"])
                known = place < len(h)
                for i in np.unique(x["at"][known]):
                    own = known & (x["at"] == i)
                    _add(sums, int(x["sources"][i]), x["doc"][own].astype(np.int64), score=x["n"][own] * weight[place[own]])
        for source, x in sums.items():
            yield source % buckets, source, 0, pack(x)

    return run


def _documents(model):
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, _, docs, *_ = model.value
        start = np.log10(docs) if docs else 0.0
        sums: dict[int, dict] = {}
        papers = []
        for _, source, kind, data in read(found):
            if kind:
                papers.append((source, data))
            else:
                x = unpack(data)
                _add(sums, source, np.arange(len(x["score"])), score=x["score"])
                _add(sums, source, np.arange(len(x["base"])), base=x["base"], known=x["known"])
        for source, data in papers:
            ids, held, tokens = pickle.loads(data)
            x = {k: np.pad(v, (0, max(0, len(ids) - len(v))))[: len(ids)] for k, v in sums.pop(source).items()}
            columns = [pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(tokens, pa.int64()), pa.array(np.rint(x["known"]).astype(np.int64)), pa.array(np.full(len(ids), total)), pa.array(x["base"]), pa.array(x["score"] - start)]
            yield pa.RecordBatch.from_arrays(columns, SCORES)
        release()

    return run


SCORES = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of ``docs`` (doc_id, text, train, held_out).

    A null text is empty and has its end alone; texts of any length are scored whole. Each row is a document of its own,
    also where it repeats another; without training rows all words are unknown, with a probability of 1. An empty table
    gives no rows, and other columns are ignored, whatever their names.
    """
    spark = ready(docs.sparkSession)
    sc, buckets = spark.sparkContext, text_bytes(docs) // TOKEN_BYTES // BUCKET_TOKENS + 1
    short, hot = _frequent(docs, buckets)
    short = np.unique(np.append(short, FIRST))
    fixed = sc.broadcast((short, hot, _held_words(docs.where("held_out or not train"))))
    tables = shuffled(dealt(_tables(docs, short, hot, buckets), buckets))
    facts = [pickle.loads(r["data"]) for r in _step(tables, _facts(short, hot)).select("data").toLocalIterator()]
    hot_counts: dict[int, int] = {}
    for f in facts:
        for w, c in f[3].items():
            hot_counts[w] = hot_counts.get(w, 0) + c
    warm = np.array([c for c in hot_counts.values() if c > 0], np.int64)
    zero = np.zeros(K + 2, np.int64)
    words = sum((f[2] for f in facts), zero) + np.bincount(np.minimum(warm, K + 2), minlength=K + 3)[: K + 2]
    pairs = sum((f[4] for f in facts), zero)
    total, vocabulary = sum(f[0] for f in facts), sum(f[1] for f in facts) + len(warm)
    by_word, by_pair = _discounts(words), _discounts(pairs)
    low = np.arange(1, K + 1)
    lost = ((1 - by_word[1 : K + 1]) * low * words[1 : K + 1]).sum() + by_word[K + 1] * (vocabulary - words[1 : K + 1].sum())
    unknown = lost / total if total else 1.0
    model = sc.broadcast((total, vocabulary, sum(f[5] for f in facts), hot_counts, by_word, by_pair, unknown))
    terms = dealt(_step(tables, _score_terms(fixed, model, buckets)), buckets)
    return dealt(_step(terms, _weights(model, buckets)), buckets).mapInArrow(_documents(model), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score_documents(docs: DataFrame) -> DataFrame:
    """``score`` with the documents whose crc32 of their id, modulo 10, is 0 held out; a row without an id neither teaches nor is held out."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10))
    return score(docs.select("doc_id", "text", F.coalesce(fold != 0, F.lit(False)).alias("train"), F.coalesce(fold == 0, F.lit(False)).alias("held_out")))

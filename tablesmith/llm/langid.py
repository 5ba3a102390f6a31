"""Language identification by a blended-spectrum string kernel.

Two texts compare by the n-grams of 1 to 3 characters that both hold, whatever their counts, scaled by the
n-grams that each holds. The kernel against LANDMARKS texts, whitened, gives Nystroem features; ridge
regression of each language against the rest is solved on them, and batches are scored by matrix products.
N-grams that no landmark holds can't change a kernel against landmarks and don't count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import release
from .common import ready

#: Bounds of what the model is fitted on: about so many landmarks and so many labelled documents, spread evenly over languages.
LANDMARKS = 192
SAMPLE = 3000
ORDERS = (1, 2, 3)
RIDGE = 1e-2
#: With many languages there are more of both, so that each has these at least.
LEAST_LANDMARKS, LEAST_ROWS = 8, 64
#: Languages that the model is built for: landmarks are dense rows over their n-grams. More are an error, none is left out.
MOST_LANGUAGES = 64
SLOT_BITS = 20
#: Characters that one step of the n-gram count takes.
STEP = 1 << 18
UNKNOWN = "und"


def codes(text: str) -> Iterator[np.ndarray]:
    """The n-grams of a text, lower-cased, as numbers that differ for different n-grams, step by step."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    for at in range(0, len(points), STEP):
        part = points[at : at + STEP + max(ORDERS) - 1]
        for n in ORDERS:
            size = min(STEP, len(points) - at - n + 1)
            if size <= 0:
                continue
            code = np.zeros(size, np.uint64)
            for i in range(n):
                code = (code << np.uint64(21)) | (part[i : i + size] + np.uint64(1))
            yield code


def grams(text: str) -> np.ndarray:
    found = [np.unique(c) for c in codes(text)]
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.uint64)


class Vocabulary:
    """Numbers of n-grams by two probes of hashed slots; n-grams are told apart exactly."""

    def __init__(self, known: np.ndarray):
        self.size = len(known)
        rng = np.random.default_rng(5)
        while True:
            self.by = [np.uint64(int(x) | 1) for x in rng.integers(1, 1 << 63, 2)]
            self.code = [np.zeros(1 << SLOT_BITS, np.uint64) for _ in self.by]
            self.number = [np.full(1 << SLOT_BITS, len(known), np.int32) for _ in self.by]
            left = np.arange(len(known))
            for by, code, number in zip(self.by, self.code, self.number, strict=True):
                slot = self._slot(known[left], by)
                number[slot], code[slot] = left, known[left]
                left = left[number[slot] != left]
            if not len(left):
                return

    @staticmethod
    def _slot(code: np.ndarray, by: np.uint64) -> np.ndarray:
        return ((code * by) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def find(self, code: np.ndarray) -> np.ndarray:
        """The numbers of n-grams; those that aren't known have the number ``size``."""
        first, second = (self._slot(code, by) for by in self.by)
        out = self.number[0][first]
        miss = self.code[0][first] != code
        out[miss] = np.where(self.code[1][second[miss]] == code[miss], self.number[1][second[miss]], self.size)
        return out


class Model:
    def __init__(self, landmarks: list[np.ndarray]):
        self.vocabulary = Vocabulary(np.unique(np.concatenate(landmarks)) if landmarks else np.empty(0, np.uint64))
        rows = np.zeros((len(landmarks), self.vocabulary.size + 1), np.float32)
        for row, found in zip(rows, landmarks, strict=True):
            row[self.vocabulary.find(found)] = 1
        self.landmarks = self._unit(rows)
        values, vectors = np.linalg.eigh((self.landmarks @ self.landmarks.T).astype(np.float64))
        keep = values > 1e-6 * max(1.0, values.max(initial=0))
        self.whiten = (vectors[:, keep] / np.sqrt(values[keep])).astype(np.float32)
        self.names: list[str] = []
        self.weights = np.zeros((self.whiten.shape[1] + 1, 0))

    @staticmethod
    def _unit(rows: np.ndarray) -> np.ndarray:
        rows = rows[:, :-1]
        return rows / np.maximum(np.sqrt(rows.sum(1, keepdims=True)), 1)

    def features(self, texts: list[str]) -> np.ndarray:
        rows = np.zeros((len(texts), self.vocabulary.size + 1), np.float32)
        for row, text in zip(rows, texts, strict=True):
            for code in codes(text):
                row[self.vocabulary.find(code)] = 1
        return (self._unit(rows) @ self.landmarks.T) @ self.whiten

    def fit(self, x: np.ndarray, langs: list[str]) -> None:
        self.names = sorted(set(langs))
        y = np.array([[1.0 if lang == name else -1.0 for name in self.names] for lang in langs])
        weight = np.zeros(len(langs))
        for name in self.names:
            mine = np.array([lang == name for lang in langs])
            weight[mine] = 1 / mine.sum()
        x = np.hstack([x.astype(np.float64), np.ones((len(x), 1))])
        gram = (x * weight[:, None]).T @ x
        self.weights = np.linalg.solve(gram + RIDGE * np.eye(len(gram)) * np.trace(gram) / len(gram), (x * weight[:, None]).T @ y)

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The best language's number and its score: the regression's value moved from -1..1 to 0..1."""
        x = self.features(texts)
        value = x.astype(np.float64) @ self.weights[:-1] + self.weights[-1]
        best = value.argmax(1)
        return best, np.clip((value[np.arange(len(best)), best] + 1) / 2, 0, 1)


def _per_language(docs: DataFrame, counts: dict[str, int], most: int, salt: str) -> DataFrame:
    """About ``most`` documents, as many of each language, chosen by a hash of their ids."""
    share = -(-most // len(counts))
    place = F.pmod(F.xxhash64(F.lit(salt), "doc_id"), F.lit(1 << 40)).cast("double") / float(1 << 40)
    bound = F.coalesce(*[F.when(F.col("lang") == name, F.lit(min(1.0, 1.2 * share / n))) for name, n in counts.items()], F.lit(0.0))
    return docs.where(place < bound)


def fit(train: DataFrame) -> Model:
    """The model learned from ``train`` (doc_id, text, lang): rows without a text, a language or a letter don't teach.

    Languages are counted over all rows and all are learned; more than MOST_LANGUAGES raise a ValueError. Landmarks and
    documents are samples of whole texts, bounded by LANDMARKS and SAMPLE, or LEAST_LANDMARKS and LEAST_ROWS of each
    language where that is more, whose n-grams and features the executors work out.
    """
    ready(train.sparkSession)
    rows = train.where("text is not null and lang is not null and doc_id is not null").select("doc_id", "text", "lang")
    top = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES + 1).collect()
    if len(top) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages; the model is not built for so many")
    counts = {r["lang"]: r["count"] for r in top}
    landmarks, sample = max(LANDMARKS, LEAST_LANDMARKS * len(counts)), max(SAMPLE, LEAST_ROWS * len(counts))
    if not counts:
        return Model([])

    def spread(found: list, most: int) -> list:
        """At most ``most`` rows, in order of ids and with each language in turn."""
        by: dict[str, list] = {}
        for r in sorted(found, key=lambda r: r["doc_id"]):
            by.setdefault(r["lang"], []).append(r)
        turns = [(i, name, r) for name, own in sorted(by.items()) for i, r in enumerate(own)]
        return [r for _, _, r in sorted(turns, key=lambda t: t[:2])[:most]]

    def collect_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [grams(t) if any(map(str.isalpha, t)) else None for t in b.column("text").to_pylist()]
            data = pa.array([None if g is None else g.tobytes() for g in found], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), data], ["doc_id", "lang", "data"])

    near = _per_language(rows, counts, landmarks, "landmarks").mapInArrow(collect_grams, "doc_id long, lang string, data binary").where("data is not null")
    model = Model([np.frombuffer(r["data"], np.uint64) for r in spread(near.limit(4 * landmarks + 64).collect(), landmarks)])
    shared = train.sparkSession.sparkContext.broadcast(model)

    def collect_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            x = shared.value.features(texts)
            data = pa.array([v.tobytes() if any(map(str.isalpha, t)) else None for v, t in zip(x, texts, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), data], ["doc_id", "lang", "data"])

    found = _per_language(rows, counts, sample, "sample").mapInArrow(collect_features, "doc_id long, lang string, data binary").where("data is not null")
    found = spread(found.limit(2 * sample + 64).collect(), sample)
    if found:
        model.fit(np.array([np.frombuffer(r["data"], np.float32) for r in found]), [r["lang"] for r in found])
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score. A null text, or one without letters, is ``und`` with score 0, and so is
    everything under a model that learned nothing. Columns of ``docs`` with these names are replaced."""
    ready(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema) + ", lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            rows = [i for i, t in enumerate(texts) if model.names and any(map(str.isalpha, t))]
            for at in range(0, len(rows), 256):
                part = rows[at : at + 256]
                best, score = model.predict([texts[i] for i in part])
                scores[part] = score
                for i, k in zip(part, best, strict=True):
                    langs[i] = model.names[k]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(langs), pa.array(scores)], [*names, "lang_pred", "score"])
        release()

    return docs.select(*names).mapInArrow(run, schema)


def fold(column: str, k: int) -> F.Column:
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(k))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of all ``docs``, learned from those that aren't held out.

    A row without doc_id is not held out and doesn't teach; repeated rows get equal results.
    """
    held = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    model = fit(docs.where(~held))
    return predict(docs.select("doc_id", held.alias("held_out"), "text"), model).drop("text")

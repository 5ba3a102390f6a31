"""Counts of hashed keys of all documents on a fixed number of slots."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import release
from .words import word_hashes

PARTS = 16


def slots(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64)


def tallied(frame: DataFrame, found: Callable[[pa.RecordBatch], Iterable[np.ndarray]], bits: int) -> np.ndarray:
    """For each of 2 ** bits slots, how many of the keys that ``found`` gives for the batches of ``frame`` are on it.

    Each task sends one table, and the tables are added up in PARTS ranges, so what reaches the driver depends on
    ``bits`` alone.
    """
    width = (1 << bits) // PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int32)
        held, size = [], 0
        for b in batches:
            for keys in found(b):
                held.append(slots(keys, bits))
                size += len(held[-1])
                if size > 1 << 20:
                    total += np.bincount(np.concatenate(held), minlength=1 << bits).astype(np.int32)
                    held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=1 << bits).astype(np.int32)
        for i in range(PARTS):
            own = total[i * width : (i + 1) * width]
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([own.tobytes()], pa.binary())], ["part", "data"])
        release()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for part, data in zip(b.column("part").to_pylist(), b.column("data"), strict=True):
                if part not in sums:
                    sums[part] = np.zeros(width, np.int64)
                sums[part] += np.frombuffer(data.as_py(), np.int32)
        for part, now in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([now.tobytes()], pa.binary())], ["part", "data"])

    kept = frame.mapInArrow(count, "part int, data binary")
    total = np.zeros(1 << bits, np.int64)
    for r in kept.repartitionById(PARTS, F.col("part")).mapInArrow(add, "part int, data binary").toLocalIterator():
        total[r["part"] * width : (r["part"] + 1) * width] += np.frombuffer(r["data"], np.int64)
    return total


def slot_counts(texts: DataFrame, keys: Callable[[np.ndarray], np.ndarray], bits: int) -> np.ndarray:
    """``tallied`` for texts: the (document, key) pairs on each slot, an upper bound of the documents of each key there.

    ``keys`` gives the distinct keys of a document from the hashes of its words.
    """

    def found(b: pa.RecordBatch) -> Iterator[np.ndarray]:
        h, offsets = word_hashes(b.column(0))
        for a, z in zip(offsets[:-1], offsets[1:], strict=True):
            if z > a:
                yield keys(h[a:z])

    return tallied(texts, found, bits)

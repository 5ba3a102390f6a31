"""Packed blocks of arrays, dealt to buckets: what shuffles carry between Python scans."""

from __future__ import annotations

import ctypes
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens that a task packs together, and about as many that one bucket gets.
TOKENS = 1_000_000
#: Bytes of text per token, at least.
TOKEN_BYTES = 5
#: Rows of one batch of blocks.
ROWS = 8
BLOCK = "bucket int, source long, kind int, data binary"


def pack(arrays: dict[str, np.ndarray]) -> bytes:
    """Arrays by bytes of equal weight, which compress better."""
    planes = {k: (a.dtype.str, np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()) for k, a in arrays.items()}
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(planes))


def unpack(data: bytes) -> dict[str, np.ndarray]:
    out = {}
    for k, (kind, raw) in pickle.loads(zstandard.ZstdDecompressor().decompress(data)).items():
        size = np.dtype(kind).itemsize
        out[k] = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()
    return out


def small(a: np.ndarray) -> np.ndarray:
    """Values of 0 and more in the narrowest type that holds them."""
    most = int(a.max(initial=0))
    return a.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)


def batch(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    bucket, source, kind, data = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(source, pa.int64()), pa.array(kind, pa.int32()), pa.array(data, pa.binary())], ["bucket", "source", "kind", "data"])


def batches(rows: list[tuple[int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), ROWS):
        yield batch(rows[i : i + ROWS])


def read(found: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, bytes]]:
    for b in found:
        yield from zip(b.column("bucket").to_pylist(), b.column("source").to_pylist(), b.column("kind").to_pylist(), b.column("data").to_pylist(), strict=True)


def numbered(keys: np.ndarray, first: bool = False):
    """Distinct keys in order, and each key's place among them in 32 bits; with ``first``, where each occurs, too."""
    order = np.argsort(keys)
    now = keys[order]
    edge = np.append(True, now[1:] != now[:-1]) if len(now) else np.zeros(0, bool)
    place = np.empty(len(keys), np.int32)
    place[order] = np.cumsum(edge, dtype=np.int32) - 1
    return (now[edge], place, order[edge]) if first else (now[edge], place)


def slices(found: Iterator[pa.RecordBatch], column: str | int = "text", most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Batches cut into such of ``most`` bytes of ``column``, or of one row; what is computed of them is several times larger."""
    for b in found:
        at = 0
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        while at < b.num_rows:
            base = int(ends[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
            yield b.slice(at, stop - at)
            at = stop


def dealt(blocks: DataFrame, buckets: int) -> DataFrame:
    """``blocks`` with each bucket in a partition of its own."""
    return blocks.repartitionById(buckets, F.col("bucket"))


def text_bytes(docs: DataFrame) -> int:
    return int(docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"])


def _c():
    try:
        found = ctypes.CDLL(None)
        return found if hasattr(found, "malloc_trim") else None
    except OSError:
        return None


_C = _c()
if _C is not None:
    # Arrays of more than 512 kB go straight back to the system when freed, and so does the heap's end (M_MMAP_THRESHOLD, M_TRIM_THRESHOLD).
    _C.mallopt(-3, 512 << 10)
    _C.mallopt(-1, 2 << 20)


def release() -> None:
    """Gives memory that a worker has freed back to the system; idle workers would keep it."""
    pa.default_memory_pool().release_unused()
    if _C is not None:
        _C.malloc_trim(0)

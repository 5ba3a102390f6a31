"""Words of texts as 64-bit hashes, computed over whole byte buffers.

A word is a run of bytes other than \\x20 and \\x09-\\x0D, with A-Z lowered. Its hash is a polynomial over a
random value per byte, taken from prefix sums modulo 2**64, and then mixed. Two different words share a hash
with a probability of about 2**-60, so counts by hash are taken as counts by word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
EXACT = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
LOWERED = EXACT[_LOWER]
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        n = max(n, CHUNK)
        for name, base in (("up", BASE), ("down", INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hashed(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans from ``begin`` to ``end`` (their last positions) of bytes with these random values."""
    up, down = _powers(len(values))
    value = values * up[: len(values)]
    total = np.cumsum(value, dtype=np.uint64)
    h = (total[end] - total[begin] + value[begin]) * down[begin]
    return mix(h ^ (end - begin + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _words(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of ``data``, their first and their last bytes; no word crosses a position in ``cuts``."""
    word, edge = runs(data, cuts)
    begin, end = np.flatnonzero(word & edge[:-1]), np.flatnonzero(word & edge[1:])
    return hashed(LOWERED[data], begin, end), begin, end


def runs(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes are of words, and before which (the end, too) a run of words' or other bytes begins."""
    word = ~_SPACE[data]
    edge = np.zeros(len(word) + 1, bool)
    edge[cuts] = edge[0] = edge[-1] = True
    edge[1:-1] |= word[1:] != word[:-1]
    return word, edge


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of ``texts`` in order, and the offsets of each text's words; a null has none."""
    h, offsets, *_ = word_spans(texts)
    return h, offsets


def word_spans(texts: pa.Array, spans=_words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``word_hashes``, with each word's first byte, the one after its last, and the bytes.

    ``spans`` may find other spans than words in a piece of the bytes, which is cut at spaces and ends of texts only.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    n, none = len(texts), np.empty(0, np.int64)
    if n == 0:
        return np.empty(0, np.uint64), np.zeros(1, np.int64), none, none, np.empty(0, np.uint8)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and len(raw) else np.empty(0, np.uint8)
    parts, starts, ends, at, last = [], [], [], int(offsets[0]), int(offsets[-1])
    while at < last:
        stop = min(at + CHUNK, last)
        while stop < last:  # to the next space or end of a text
            ahead = data[stop : stop + 4096]
            gap = np.flatnonzero(_SPACE[ahead])
            bound = offsets[np.searchsorted(offsets, stop)]
            near = min(stop + int(gap[0]) if len(gap) else last, int(bound))
            if len(gap) or near < stop + len(ahead):
                stop = near
                break
            stop += len(ahead)
        inner = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, stop, "right")] - at
        h, begin, end = spans(data[at:stop], inner)
        parts.append(h)
        starts.append(begin + at)
        ends.append(end + (at + 1))
        at = stop
    if not parts:
        return np.empty(0, np.uint64), np.zeros(n + 1, np.int64), none, none, data
    h, start, end = np.concatenate(parts), np.concatenate(starts), np.concatenate(ends)
    return h, np.searchsorted(start, offsets, "left").astype(np.int64), start, end, data


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` words; fewer words make one run of all; no words make none."""
    if len(h) == 0:
        return h
    k = min(n, len(h))
    out = np.full(len(h) - k + 1, np.uint64(k * 0x51ED27), np.uint64)
    for i in range(k):
        out = out * BASE + h[i : len(h) - k + 1 + i]
    return mix(out)

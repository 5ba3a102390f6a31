"""Packing token sequences into windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import json
import os
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import release
from .common import ready
from .words import EXACT, LOWERED, hashed, runs, word_spans

WINDOW = 4096
#: Id that ends each document.
END = 2
#: Windows that one differencing fills, and the room it leaves in each for the spread between windows.
GROUP = 128
SLACK = 40
#: Share of windows by which their number may rise before items are cut.
WASTE = 1 / 64
#: Units whose ids a worker keeps at hand, units that are encoded together, and bytes of text whose units are looked up together.
CACHE = 400_000
TOGETHER = 512
GROUP_BYTES = 1 << 18
#: Bytes of ids that a worker holds before it hands them over.
HELD_BYTES = 1 << 20
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Items of ``sizes`` in ``k`` sets of near-equal sums.

    Each item starts as a partition into k sums of which one is not zero. The two partitions with the largest
    spread are merged, the largest sums of one with the smallest of the other, until one is left.
    """
    if not sizes:
        return [[] for _ in range(k)]
    heap = []
    for i, size in enumerate(sizes):
        heap.append((-size, i, [(size, i)] + [(0, -1)] * (k - 1)))
    heapq.heapify(heap)
    joined: list[tuple[int, int]] = []  # node n of len(sizes) or more holds the items of two nodes
    n, stamp = len(sizes), len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        out = []
        for (x, p), (y, q) in zip(a, reversed(b), strict=True):
            if p < 0 or q < 0:
                out.append((x + y, max(p, q)))
            else:
                joined.append((p, q))
                out.append((x + y, n + len(joined) - 1))
        out.sort(reverse=True)
        heapq.heappush(heap, (out[-1][0] - out[0][0], stamp, out))
        stamp += 1
    sets = []
    for _, top in heap[0][2]:
        items, left = [], [top]
        while left:
            x = left.pop()
            if x >= n:
                left += joined[x - n]
            elif x >= 0:
                items.append(x)
        sets.append(sorted(items))
    return sets


def windows(sizes: list[int], capacity: int = WINDOW, most: int | None = None) -> list[list[int]] | None:
    """Items in near-equal windows, none above ``capacity``; the number of windows rises until all fit, or None beyond ``most``."""
    k = max(1, -(-sum(sizes) // capacity))
    while most is None or k <= most:
        sets = difference(sizes, k)
        if max(sum(sizes[i] for i in s) for s in sets) <= capacity:
            return [s for s in sets if s]
        k += max(1, k // 64)
    return None


def fitted(sizes: list[int], capacity: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """(item, begin, end) in windows: whole items where WASTE of the windows more is enough for them.

    Else items are cut where the fewest windows overflow, and what is cut off goes where there is room.
    """
    k = max(1, -(-sum(sizes) // capacity))
    sets = windows(sizes, capacity, k + int(k * WASTE))
    if sets is not None:
        return [[(i, 0, sizes[i]) for i in s] for s in sets]
    out, rooms, over = [], [], []
    for s in difference(sizes, k):
        own, at = [], 0
        for i in sorted(s, key=lambda i: -sizes[i]):
            fits = min(sizes[i], capacity - at)
            if fits:
                own.append((i, 0, fits))
            if fits < sizes[i]:
                over.append((i, fits, sizes[i]))
            at += fits
        if at < capacity:
            rooms.append((capacity - at, len(out)))
        out.append(own)
    rooms.sort()
    for i, begin, end in over:
        while begin < end:
            room, at = rooms.pop()
            size = min(room, end - begin)
            out[at].append((i, begin, begin + size))
            begin += size
            if size < room:
                rooms.append((room - size, at))
    return [x for x in out if x]


#: What of a tokenizer file must read as here for runs between spaces to be encoded apart (fixed values of its format).
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def splits_at_spaces(rules: dict) -> bool:
    """Whether the tokenizer drops white space and joins nothing across it; other tokenizers get whole texts."""
    first = ((rules.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    parts = first.get("type") == "Split" and first.get("pattern") == {"Regex": RULE} and first.get("behavior") == "Removed" and first.get("invert") is True
    added = bool(rules["added_tokens"]) and all(x["content"].startswith("<|") and not (x["lstrip"] or x["rstrip"] or re.search(r"\s", x["content"])) for x in rules["added_tokens"])
    return bool(parts and added and (rules.get("normalizer") or {}).get("normalizers") == NORMALIZERS and rules["model"].get("end_of_word_suffix"))


#: Kinds of bytes: space, ASCII letter, digit, other ASCII, beyond ASCII.
_KIND = np.full(256, 3, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[65:91] = _KIND[97:123] = 1
_KIND[48:58] = 2
_KIND[128:] = 4
_SHORT = np.isin(np.arange(256), list(b"stmdSTMD"))


def units(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, first and last bytes of what RULE parts; a run between spaces is one unit where it is beyond ASCII or may hold an added token."""
    kind, (word, run) = _KIND[data], runs(data, cuts)
    edge = run.copy()
    edge[1:-1] |= (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    mark = np.flatnonzero((data == 39) & edge[:-1])  # an apostrophe that begins a unit takes an ending along
    if len(mark):
        ahead = np.append(data, np.zeros(3, np.uint8))
        hard = np.zeros(len(data) + 4, bool)
        hard[cuts] = True
        hard[len(data) :] = True
        one, two = ahead[mark + 1], ahead[mark + 2] | 32
        short = _SHORT[one] & ~hard[mark + 1]
        pair = (((one | 32) == 114) | ((one | 32) == 118)) & (two == 101) | ((one | 32) == 108) & (two == 108)
        long = ~short & pair & ~hard[mark + 1] & ~hard[mark + 2] & (kind[np.minimum(mark + 1, len(data) - 1)] == 1) & (_KIND[ahead[mark + 2]] == 1)
        edge[mark[short | long] + 1] = False
        edge[mark[short] + 2] = edge[mark[long] + 3] = True
    values = LOWERED[data]
    added = (data == 60) & (np.append(data[1:], 0) == 124)
    added[cuts[cuts > 0] - 1] = False
    whole = np.flatnonzero((kind == 4) | added)
    if len(whole):
        number = np.cumsum(run[:-1], dtype=np.int32)
        odd = np.zeros(int(number[-1]) + 1, bool)
        odd[number[whole]] = True
        odd = odd[number]
        edge[:-1] = np.where(odd, run[:-1], edge[:-1])
        values = np.where(odd, EXACT[data], values)
    begin, end = np.flatnonzero(word & edge[:-1]), np.flatnonzero(word & edge[1:])
    return hashed(values, begin, end), begin, end


class Encoder:
    """Ids of texts. Each unit (word, digit, signs, or run beyond ASCII) is encoded once by the tokenizer and kept in a table.

    The table is arrays of bounded size; it is emptied when full. New units are encoded many at a time.
    """

    def __init__(self, text: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        rules = json.loads(text)
        self.tokenizer, self.apart = Tokenizer.from_str(text), splits_at_spaces(rules)
        if self.apart:
            self.separator, self.between = f" {rules['added_tokens'][0]['content']} ".encode(), rules["added_tokens"][0]["id"]
            bare = {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, rules["pre_tokenizer"]["pretokenizers"][1]]}}
            self.merges = Tokenizer.from_str(json.dumps(rules | bare))
            vocabulary = self.merges.get_vocab()
            self.last = np.zeros(max(vocabulary.values()) + 1, bool)
            self.last[[i for x, i in vocabulary.items() if x.endswith(rules["model"]["end_of_word_suffix"])]] = True
        self.forget()

    def forget(self) -> None:
        self.known, self.place = np.empty(0, np.uint64), np.empty(0, np.int32)
        self.bounds, self.ids = np.zeros(1, np.int64), np.empty(0, np.uint32)

    def _plain(self, found: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids and sizes of ASCII units: by the merges alone, whose last token of each unit says that it ends."""
        groups = [found[i : i + TOGETHER] for i in range(0, len(found), TOGETHER)]
        for e in self.merges.encode_batch_fast([b" ".join(p).lower().decode("ascii") for p in groups], add_special_tokens=False):
            own = np.array(e.ids, np.uint32)
            yield own, np.diff(np.flatnonzero(self.last[own]), prepend=-1)

    def _others(self, found: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids and sizes of other units: by the tokenizer as it is, with an added token between them."""
        groups = [found[i : i + TOGETHER] for i in range(0, len(found), TOGETHER)]
        for part, e in zip(groups, self.tokenizer.encode_batch_fast([self.separator.join(p).decode("utf-8") for p in groups], add_special_tokens=False), strict=True):
            own = np.array(e.ids, np.uint32)
            cuts = np.flatnonzero(own == self.between)
            if len(cuts) == len(part) - 1:
                yield np.delete(own, cuts), np.diff(np.concatenate([[-1], cuts, [len(own)]])) - 1
            else:  # one of them holds that added token
                each = [np.array(self.tokenizer.encode(x.decode("utf-8"), add_special_tokens=False).ids, np.uint32) for x in part]
                yield np.concatenate(each), np.array([len(x) for x in each])

    def learn(self, h: np.ndarray, found: list[bytes]) -> None:
        """Adds units that aren't known, with their hashes in order."""
        plain = np.array([x.isascii() and b"<|" not in x for x in found])
        order = np.argsort(~plain, kind="stable")
        ids, sizes = zip(*self._plain([found[i] for i in order[: plain.sum()]]), *self._others([found[i] for i in order[plain.sum() :]]), strict=True)
        place = np.empty(len(found), np.int32)
        place[order] = np.arange(len(self.bounds) - 1, len(self.bounds) - 1 + len(found))
        self.bounds = np.append(self.bounds, self.bounds[-1] + np.cumsum(np.concatenate(sizes)))
        self.ids = np.concatenate([self.ids, *ids])
        at = np.searchsorted(self.known, h)
        self.known, self.place = np.insert(self.known, at, h), np.insert(self.place, at, place)

    def _places(self, h: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.known, h)
        if len(self.known):
            at[at == len(self.known)] = 0
            return np.where(self.known[at] == h, self.place[at], -1)
        return np.full(len(h), -1)

    def _group(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        h, offsets, start, end, data = word_spans(texts, units)
        each, first, back = np.unique(h, return_index=True, return_inverse=True)
        where = self._places(each)
        new = where < 0
        if new.any():
            if len(self.known) + new.sum() > CACHE or len(self.ids) > 4 * CACHE:
                self.forget()
                new[:] = True
            base = int(start[0])
            raw = data[base : int(end[-1])].tobytes()
            self.learn(each[new], [raw[a:z] for a, z in zip((start[first[new]] - base).tolist(), (end[first[new]] - base).tolist(), strict=True)])
            where = self._places(each)
        size, begin = np.diff(self.bounds)[where][back], self.bounds[where][back]
        ends = np.append(0, np.cumsum(size))
        at = np.repeat(begin - ends[:-1], size) + np.arange(ends[-1])
        return self.ids[at], ends[offsets]

    def __call__(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each of ``texts``, strings without nulls."""
        if not self.apart:
            for x in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False):
                yield np.array(x.ids, np.uint32)
            return
        texts = texts.cast(pa.large_string())
        sizes = np.cumsum(pa.compute.binary_length(texts).to_numpy(zero_copy_only=False))
        for own in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(sizes // GROUP_BYTES)) + 1) if len(texts) else []:
            ids, offsets = self._group(texts.slice(own[0], len(own)))
            for a, z in zip(offsets[:-1], offsets[1:], strict=True):
                yield ids[a:z]


#: A worker's encoder, by its rules; it outlives tasks.
_ENCODERS: dict[str, Encoder] = {}


def encoder(rules: str) -> Encoder:
    if rules not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[rules] = Encoder(rules)
        release()  # of what was read for it, more than what it keeps
    return _ENCODERS[rules]


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """Pieces of all ``docs`` (doc_id, text) with their ids (little-endian unsigned 32-bit) and places.

    ``tokenizer`` is the path of a tokenizer file, read on the driver. A null or empty text is its end id alone.
    A document's full windows are sequences of their own, as no other piece fits beside them. What is left of documents
    is packed whole, as much as fills GROUP windows together, so the last document of such a group is cut, and others
    only where the number of windows would rise by more than WASTE. This happens within the task that reads them: nothing is shuffled, and equal or skewed keys don't matter. sequence_id holds the task's number and the sequence's number in it. Rows that repeat a
    doc_id are packed as documents of their own; an empty table gives no pieces; other columns are ignored.
    """
    ready(docs.sparkSession)
    rules = docs.sparkSession.sparkContext.broadcast(Path(tokenizer).read_text("utf-8"))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, first = encoder(rules.value), TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        waiting: list[tuple] = []
        total = sequences = size_held = 0

        def place(sets: list[list[tuple]]) -> None:
            nonlocal sequences, size_held
            for items in sets:
                offset = 0
                for doc, start, ids, all_ids in items:
                    held.append((doc, start, len(ids), ids.tobytes(), all_ids, first + sequences, offset))
                    offset += len(ids)
                    size_held += ids.nbytes
                sequences += 1

        def settle() -> None:
            nonlocal waiting, total
            sets = fitted([len(x[2]) for x in waiting], window) if waiting else []
            place([[(waiting[i][0], waiting[i][1] + a, waiting[i][2][a:z], waiting[i][3]) for i, a, z in s] for s in sets])
            waiting, total = [], 0

        def out() -> pa.RecordBatch:
            nonlocal held, size_held
            rows, held, size_held = held, [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        full = GROUP * (window - SLACK)
        for batch in batches:
            for doc, own in zip(batch.column("doc_id").to_pylist(), encode(pa.compute.fill_null(batch.column("text"), "")), strict=True):
                ids = np.append(own, np.uint32(END)).astype("<u4")
                n, at = len(ids), 0
                while n - at >= window:
                    place([[(doc, at, ids[at : at + window], n)]])
                    at += window
                    if size_held > HELD_BYTES:
                        yield out()
                while at < n:
                    size = min(n - at, full - total)
                    waiting.append((doc, at, ids[at : at + size], n))
                    at, total = at + size, total + size
                    if total == full:
                        settle()
                    if size_held > HELD_BYTES:
                        yield out()
        settle()
        if held:
            yield out()
        release()

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``pack`` with the checksum of each piece's ids in place of the ids."""
    return pack(docs, tokenizer).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

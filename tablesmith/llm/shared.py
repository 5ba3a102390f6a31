"""Which documents share enough of their keys with others, counted exactly over all documents.

A key (a shingle's hash) that one document alone has is *single*. A set of n keys that is similar to another by
num / den has at least ceil(n num / den) keys in common with it, so one with more than n - ceil(n num / den) single
keys is similar to none. Tasks send sorted blocks of key prefixes with the document of each; keys that two documents
of a block have are sent once, without documents, so a frequent key costs one entry per block. Key prefixes are long
enough for few of them to meet by chance; where they do, a key only counts as shared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCK, TOKEN_BYTES, TOKENS, batches, dealt, pack, read, release, slices, small, text_bytes, unpack
from .common import cut, ready
from .words import mix, shingles, word_hashes

#: Bits of a key beyond those that number all of them: about one in 2 ** SPARE meets another by chance.
SPARE = 12
SETS = "doc_id long, n long, node long, twin long, alive boolean"


def names(own: np.ndarray) -> tuple[np.int64, np.int64]:
    """Two hashes of a set; together they name it."""
    one = own.sum(dtype=np.uint64) ^ mix(np.array([len(own)], np.uint64))[0]
    two = mix(own ^ np.uint64(0xABCD)).sum(dtype=np.uint64)
    return mix(np.array([one]))[0].view(np.int64), two.view(np.int64)


def most_single(size: np.ndarray, num: int, den: int) -> np.ndarray:
    """How many keys of a set of ``size`` may be missing from a similar one."""
    return size - -(-num * size // den)


def _sent(docs: DataFrame, n: int, bits: int, buckets: int) -> DataFrame:
    """Blocks of keys (kind 0) and each source's rows (kind 1)."""
    edges = np.array([-(-(i << bits) // buckets) for i in range(buckets + 1)], np.uint64)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, turn, rows, sets, total = TaskContext.get().partitionId(), 0, [], [], 0
        seen: dict[tuple[int, int], int] = {}

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal turn, rows, sets, total, seen
            source, sent = (task << 24) + turn, []
            turn += 1
            if sets:
                owner = np.repeat(np.arange(1, len(sets) + 1, dtype=np.uint32), [len(x) for x in sets])
                key, sets = np.concatenate(sets) >> np.uint64(64 - bits), []
                order = np.argsort(key)
                owner = owner[order]
                key = key[order]
                del order
                first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                many = np.diff(np.append(first, len(key))) > 1
                key, owner = key[first], owner[first]
                owner[many] = 0
                cuts = np.searchsorted(key, edges)
                for i in range(buckets):
                    a, z = cuts[i], cuts[i + 1]
                    if z > a:
                        sent.append((i, source, 0, pack({"key": small(np.diff(key[a:z], prepend=edges[i])), "owner": small(owner[a:z])})))
            doc, size, node, twin, at = (np.array(x) for x in zip(*rows, strict=True))
            absent = np.array([x is None for x in doc])
            doc = np.array([0 if x is None else x for x in doc], np.int64)
            sent.append((source % buckets, source, 1, pack({"doc": doc, "absent": absent, "n": size.astype(np.int64), "node": node.astype(np.int64), "twin": twin.astype(np.int64), "at": at.astype(np.int64)})))
            rows, sets, total, seen = [], [], 0, {}
            yield from batches(sent)

        for b in slices(found):
            h, offsets = word_hashes(b.column("text"))
            for doc, a, z in zip(b.column("doc_id").to_pylist(), offsets[:-1], offsets[1:], strict=True):
                own = np.unique(shingles(h[a:z], n))
                node, twin = names(own)
                at = -1
                if len(own) and doc is not None:
                    at = seen.setdefault((int(node), int(twin)), len(sets))
                    if at == len(sets):
                        sets.append(own)
                        total += len(own)
                rows.append((doc, len(own), node, twin, at))
                if total > TOKENS:
                    yield from out()
        if rows:
            yield from out()
        release()

    return docs.select("doc_id", "text").mapInArrow(run, BLOCK)


def _singles(buckets: int):
    """Of each source's documents, how many keys of the bucket are theirs alone."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, owners, sources = [], [], []
        for _, source, kind, data in read(found):
            if kind:
                yield from batches([(source % buckets, source, 1, data)])
            else:
                x = unpack(data)
                keys.append(np.cumsum(x["key"], dtype=np.uint64))
                owners.append(x["owner"].astype(np.uint32))
                sources.append(source)
        if keys:
            # Keys of a block are distinct, so a key that occurs once is of one block.
            at = np.repeat(np.arange(len(keys), dtype=np.uint32), [len(x) for x in keys])
            key, owner = np.concatenate(keys), np.concatenate(owners)
            del keys, owners
            order = np.argsort(key)
            key = key[order]
            edge = np.append(np.append(True, key[1:] != key[:-1]), True)
            del key
            order = order[edge[:-1] & edge[1:]]
            order = order[owner[order] > 0]
            at, owner = at[order], owner[order] - 1
            order = np.lexsort((owner, at))
            at, owner = at[order], owner[order]
            bounds = np.searchsorted(at, np.arange(len(sources) + 1))
            for i, source in enumerate(sources):
                who, times = np.unique(owner[bounds[i] : bounds[i + 1]], return_counts=True)
                if len(who):
                    yield from batches([(source % buckets, source, 0, pack({"who": small(np.diff(who, prepend=0)), "times": small(times)}))])
        release()

    return run


def _rows(num: int, den: int):
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        papers: dict[int, dict] = {}
        single: dict[int, np.ndarray] = {}
        for _, source, kind, data in read(found):
            x = unpack(data)
            if kind:
                papers[source] = x
                continue
            who = np.cumsum(x["who"], dtype=np.int64)
            now = single.get(source, np.zeros(0, np.int64))
            if len(now) <= who[-1]:
                now = np.pad(now, (0, int(who[-1]) + 1 - len(now)))
            now[who] += x["times"]
            single[source] = now
        for source, x in papers.items():
            now = np.append(single.get(source, np.zeros(0, np.int64)), np.zeros(int(x["at"].max(initial=-1)) + 2, np.int64))
            alive = (x["at"] >= 0) & (now[x["at"]] <= most_single(x["n"], num, den))
            yield pa.RecordBatch.from_arrays([pa.array(x["doc"], pa.int64(), mask=x["absent"]), pa.array(x["n"]), pa.array(x["node"]), pa.array(x["twin"]), pa.array(alive)], ["doc_id", "n", "node", "twin", "alive"])
        release()

    return run


def sets(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text): its set's size, its two names, and whether it may be similar to another.

    Sets are of ``n``-word shingles. A row without doc_id, or with an empty set, is never alive. Rows with equal sets
    in one block count once, all others as documents of their own, so exact copies far apart are alive.
    """
    ready(docs.sparkSession)
    tokens = text_bytes(docs) // TOKEN_BYTES
    buckets = tokens // TOKENS + 1
    bits = min(56, max(24, tokens.bit_length() + SPARE))
    counted = dealt(_sent(docs, n, bits, buckets), buckets).mapInArrow(_singles(buckets), BLOCK)
    return cut(dealt(counted, buckets).mapInArrow(_rows(num, den), SETS))

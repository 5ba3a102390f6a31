"""Set-similarity join of documents by word n-grams: a grouped prefix join.

Documents with equal sets of shingles make one node, named by hashes of the set. ``shared.sets`` counts exactly how
many shingles of each document no other document has, and leaves out those that have too many to be similar to
anything; the sets of the others are brought once. They're put in one order, rare shingles first, by counts among
these sets; the order only has to be the same for all. Two sets of Jaccard similarity t or more share a shingle
within their prefixes of size - ceil(t * size) + 1.

Nodes with equal prefixes and sizes make one group. Pairs of groups that share a prefix shingle are filtered by size
and by the place of that shingle, then expanded into members, filtered by bitmaps of their sets and verified. Since
only reachability is asked for, each step first compares with the pivot of a group or a few of a shingle, and later steps
leave out pairs that are connected already; a pair that is not connected is never left out, so components are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .blocks import release, slices
from .common import components, cut, ready
from .sketch import slots, tallied
from .words import mix, shingles, word_hashes

#: Bounds of the bits of the table by which shingles are ordered; it grows with the shingles counted.
FEWEST_BITS, MOST_BITS = 16, 22
#: Nodes of a partition of the tables of nodes and prefixes, and partitions at least.
NODES_PER_PART, LEAST_PARTS = 2000, 8
#: Pivots of a shingle at most.
PIVOTS = 4
#: Longs of the bitmap of a set.
BITMAP = 6
#: Bounds of the bits of the table that tells which documents' sets a scan must bring, and its bits per document.
WANTED_LEAST, WANTED_MOST, WANTED_EACH = 16, 25, 16


def _wanted(ids: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """A bit table in which each doc_id of ``ids`` has its bit, and its size; beyond the most bits it is only less selective."""
    bits = min(WANTED_MOST, max(WANTED_LEAST, (n * WANTED_EACH).bit_length()))
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << bits))
    words = ids.select((slot / 64).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(doc_id), {1 << bits}) % 64 as int))").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(1 << (bits - 6), np.int64)
    table[found["word"].to_numpy()] = found["bits"].to_numpy()
    return table, bits


def _sets(docs: DataFrame, alive: DataFrame, n: int, count: int) -> DataFrame:
    """(node, items): the sets of the ``count`` nodes of ``alive`` (node, doc_id, n), each brought from one document."""
    table, bits = _wanted(alive, count)
    shared_table = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared_table.value
        for b in slices(batches):
            slot = b.column("slot").to_numpy(zero_copy_only=False)
            keep = np.flatnonzero((wanted[slot >> 6] >> (slot & 63)) & 1)
            if len(keep):
                h, offsets = word_hashes(b.column("text").take(pa.array(keep)))
                own = [np.unique(shingles(h[a:z], n)) for a, z in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([shared.names(x)[0] for x in own], pa.int64()), pa.array([x.view(np.int64) for x in own], pa.list_(pa.int64()))], ["node", "items"])
        release()

    rows = docs.where("doc_id is not null").select(F.pmod(F.xxhash64("doc_id"), F.lit(1 << bits)).alias("slot"), "text")
    brought = rows.mapInArrow(run, "node long, items array<long>")
    found = cut(brought.join(alive.select("node"), "node", "left_semi").dropDuplicates(["node"]))
    shared_table.unpersist()
    return found


def _items(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    items = batch.column("items")
    offsets = np.asarray(items.offsets)
    return np.asarray(items.values).view(np.uint64)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _prefixes(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(node, n, prefix, b0 ... of the bitmap) of ``sets``."""
    tokens = int(sets.agg(F.coalesce(F.sum(F.size("items")), F.lit(0)).alias("n")).first()["n"])
    width = min(MOST_BITS, max(FEWEST_BITS, tokens.bit_length()))
    total = tallied(sets, lambda b: [_items(b)[0]], width)
    level = sets.sparkSession.sparkContext.broadcast(np.ceil(np.log2(np.maximum(total, 1))).astype(np.uint8))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = level.value
        for b in batches:
            items, offsets = _items(b)
            prefix, bits = [], []
            for a, z in zip(offsets[:-1], offsets[1:], strict=True):
                own = np.sort(items[a:z])
                own = own[np.argsort(rank[slots(own, width)], kind="stable")]
                prefix.append(own[: int(shared.most_single(len(own), num, den)) + 1].view(np.int64))
                odd = np.bincount((mix(own * np.uint64(3)) % np.uint64(64 * BITMAP)).astype(np.int64), minlength=64 * BITMAP) & 1
                bits.append(np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64))
            map_bits = np.array(bits, np.int64).reshape(-1, BITMAP)
            columns = [b.column("node"), pa.array(np.diff(offsets), pa.int64()), pa.array(prefix, pa.list_(pa.int64())), *[pa.array(map_bits[:, i]) for i in range(BITMAP)]]
            yield pa.RecordBatch.from_arrays(columns, ["node", "n", "prefix", *[f"b{i}" for i in range(BITMAP)]])

    return cut(sets.mapInArrow(run, "node long, n long, prefix array<long>, " + ", ".join(f"b{i} long" for i in range(BITMAP))))


def _near(num: int, den: int, x, y) -> F.Column:
    """Whether sizes and the places of a shared prefix shingle allow that two sets are similar enough.

    ``x`` and ``y`` give columns n and at. The test is made at every shared shingle as if it were their first; for
    the first it is exact, and a pair that is similar enough passes there.
    """
    size = den * F.least(x("n"), y("n")) >= num * F.greatest(x("n"), y("n"))
    place = (den + num) * F.least(x("n") - x("at"), y("n") - y("at")) >= num * (x("n") + y("n"))
    return size & place


_BITS = [f"b{i}" for i in range(BITMAP)]


def _alike(num: int, den: int) -> F.Column:
    """Whether the bitmaps of x and y allow that their sets are similar enough."""
    apart = sum((F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}"))) for c in _BITS), F.lit(0))
    return (den + num) * apart <= (den - num) * (F.col("x.n") + F.col("y.n"))


def _verified(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar enough: by size and bitmap, then by the sets themselves."""
    facts = lambda side, s: nodes.select(F.col("node").alias(side), F.struct("n", *_BITS).alias(s))
    likely = (den * F.least("x.n", "y.n") >= num * F.greatest("x.n", "y.n")) & _alike(num, den)
    left = pairs.select("a", "b").join(facts("a", "x"), "a").join(facts("b", "y"), "b").where(likely).select("a", "b")
    both = left.join(sets.select(F.col("node").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("items").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(den * common >= num * (F.size("x") + F.size("y") - common)).select("a", "b")


def _labels(nodes: DataFrame, links: DataFrame, parts: int) -> DataFrame:
    """(node, component) for all nodes."""
    found = components(links)
    return cut(nodes.select("node").join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component")).coalesce(parts))


def _lanes(member: DataFrame, rows: DataFrame, parts: int) -> DataFrame:
    """``rows`` with the least and the greatest component (lo, hi) of the members of their groups, and the number of these."""
    return cut(rows.join(member.groupBy("g").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("members")), "g").coalesce(parts))


def _by_pivot(member: DataFrame, rows: DataFrame, pivots: DataFrame, nodes: DataFrame, num: int, den: int, parts: int) -> DataFrame:
    """Pairs (a, b) of pivots of prefix shingles and other groups that may link and aren't connected."""
    lanes = _lanes(member, rows, parts)
    own = lanes.select(F.col("g").alias("of_g"), F.col("token").alias("of"), "lo", "hi").join(pivots, (F.col("of") == F.col("token")) & (F.col("of_g") == F.col("pivot.g"))).select("of", F.struct("pivot.*", "lo", "hi").alias("pivot"))
    # The conditions belong to the join, so that rows of groups that are connected never leave it.
    apart = (F.col("lo") != F.col("pivot.lo")) | (F.col("hi") != F.col("pivot.hi")) | (F.col("lo") != F.col("hi"))
    near = _near(num, den, F.col, lambda c: F.col(f"pivot.{c}"))
    pairs = lanes.join(own, (F.col("token") == F.col("of")) & (F.col("g") != F.col("pivot.g")) & apart & near)
    return cut(pairs.select(F.least("pivot.g", "g").alias("a"), F.greatest("pivot.g", "g").alias("b")).distinct().coalesce(parts))


def _unconnected(member: DataFrame, rows: DataFrame, pivots: DataFrame, nodes: DataFrame, num: int, den: int, parts: int) -> DataFrame:
    """Pairs (a, b) of nodes in one group, or in groups that share a prefix shingle, that may link and aren't connected.

    Rows of a group or a shingle that belong to its main component are only compared with the others. Groups of a
    shingle are dealt by bands of sizes too, of which a set only meets its own and the two beside it; groups of one
    member are compared by their bitmaps within the join.
    """
    split = member.groupBy("g").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    loose = cut(member.join(split.where("lo <> hi").select("g", F.col("lo").alias("main")), "g").coalesce(parts))
    minor = loose.where("component <> main").select("g", F.col("node").alias("a"), F.col("component").alias("ca"))
    within = minor.join(loose.select(F.col("g").alias("other"), F.col("node").alias("b"), F.col("component").alias("cb")), (F.col("g") == F.col("other")) & (F.col("ca") != F.col("cb"))).select("a", "b")
    lanes = _lanes(member, rows, parts)
    kinds = lanes.groupBy("token").agg(F.min("lo").alias("least"), F.max("hi").alias("most"), F.mode("lo", True).alias("main")).where("least <> most").select("token", "main")
    band = F.floor(F.log(F.col("n").cast("double")) / log(den / num) if num < den else F.col("n")).cast("long")
    bits = nodes.select(F.col("node").alias("g"), *_BITS)
    lanes = lanes.join(kinds, "token").join(bits, "g").withColumn("band", band).withColumn("major", (F.col("lo") == F.col("main")) & (F.col("hi") == F.col("main")))
    lanes = cut(lanes.coalesce(parts))
    facts = F.struct("g", "at", "n", "lo", "hi", "members", *_BITS)
    x = lanes.where(~F.col("major")).select("token", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), facts.alias("x"))
    y = lanes.select(F.col("token").alias("of"), F.col("band").alias("other"), facts.alias("y"), "major")
    apart = (F.col("x.lo") != F.col("y.lo")) | (F.col("x.hi") != F.col("y.hi")) | (F.col("x.lo") != F.col("x.hi"))
    once = F.col("major") | (F.col("x.g") < F.col("y.g"))
    near = _near(num, den, lambda c: F.col(f"x.{c}"), lambda c: F.col(f"y.{c}"))
    alike = _alike(num, den) | (F.col("x.members") > 1) | (F.col("y.members") > 1)
    across = x.join(y, (F.col("token") == F.col("of")) & (F.col("band") == F.col("other")) & once & apart & near & alike)
    across = across.select(F.col("x.g").alias("ga"), F.col("y.g").alias("gb")).distinct()
    side = lambda c: member.select(F.col("g").alias(f"g{c}"), F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    spread = across.join(side("a"), "ga").join(side("b"), "gb").where("ca <> cb").select("a", "b")
    return cut(within.unionByName(spread).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().coalesce(parts))


def join(docs: DataFrame, n: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(rows of ``docs`` with their sets' names, nodes that may link, with their components).

    Sets are of ``n``-word shingles and link when den * intersection >= num * union. A null or empty text has an
    empty set and links with nothing; so does a row without doc_id. Rows that repeat a doc_id are documents of
    their own, each with its set; equal sets always link. Other columns of ``docs`` are ignored.
    """
    ready(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    whole = shared.sets(docs, n, num, den)
    alive = cut(whole.where("alive").groupBy("node").agg(F.min("doc_id").alias("doc_id")))
    count = alive.count()
    # Tables of nodes and of their prefixes have a partition per NODES_PER_PART nodes: few nodes don't make many small files.
    parts = max(LEAST_PARTS, count // NODES_PER_PART)
    sets = _sets(docs, alive.coalesce(parts), n, count)
    nodes = _prefixes(sets, num, den).coalesce(parts)
    # Groups of nodes with equal prefixes and sizes; the smallest node is the group's pivot and name.
    keyed = nodes.select("node", "n", F.xxhash64("prefix").alias("p"), F.hash("prefix").alias("q"))
    heads = keyed.groupBy("n", "p", "q").agg(F.min("node").alias("g"))
    grouped = cut(keyed.join(heads, ["n", "p", "q"]).select("node", "g").coalesce(parts))
    # Prefix shingles that two groups or more share. A shingle's pivots are, of each of a few classes of its groups, the
    # group that shares most shingles: it lies in the middle of its near copies, and most of them link with it.
    tops = nodes.join(grouped.where("node = g").select("node"), "node", "left_semi")
    every = tops.select(F.col("node").alias("g"), "n", F.posexplode("prefix").alias("at", "token"))
    tokens = every.groupBy("token").agg(F.count("*").alias("k")).where("k > 1").select("token")
    rows = cut(every.join(tokens, "token").select("token", "g", "at", "n").coalesce(parts))
    middle = rows.join(rows.groupBy("g").agg(F.count("*").alias("shares")), "g")
    pivots = middle.groupBy("token", F.pmod(F.xxhash64("g"), F.lit(PIVOTS)).alias("kind")).agg(F.max(F.struct("shares", "g", "at", "n")).alias("pivot"))
    pivots = cut(pivots.select("token", F.struct("pivot.g", "pivot.at", "pivot.n").alias("pivot")).coalesce(parts))
    # First the pivots: of a group with its members, and with that one of its shingles' pivots that it shares most of.
    near = _near(num, den, F.col, lambda c: F.col(f"pivot.{c}"))
    first = rows.join(pivots.withColumnRenamed("token", "of"), (F.col("token") == F.col("of")) & (F.col("g") != F.col("pivot.g")) & near)
    first = first.select(F.col("pivot.g").alias("a"), F.col("g").alias("b")).groupBy("a", "b").agg(F.count("*").alias("k"))
    best = first.groupBy("b").agg(F.max_by("a", F.struct("k", "a")).alias("a"))
    links = cut(_verified(best.select("a", "b").unionByName(grouped.where("node <> g").select(F.col("g").alias("a"), F.col("node").alias("b"))), nodes, sets, num, den).coalesce(parts))
    label = _labels(nodes, links, parts)
    # Then the other pivots, and all pairs that may link, as far as they aren't connected yet.
    for step in (_by_pivot, _unconnected):
        member = cut(grouped.join(label, "node").coalesce(parts))
        more = cut(_verified(step(member, rows, pivots, nodes, num, den, parts), nodes, sets, num, den).coalesce(parts))
        if more.limit(1).count():
            links = links.unionByName(more)
            label = _labels(nodes, links, parts)
    return whole, label


def _components(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """A row per row of ``docs``: doc_id, n, node, its component (c, t) and the least doc_id of that; without a component c is null."""
    whole, label = join(docs, n, num, den)
    linked = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    alone = F.when(linked & F.col("component").isNull(), F.col("twin")).otherwise(F.lit(0))
    named = cut(whole.join(label, "node", "left").select("doc_id", "n", "node", F.when(linked, F.coalesce("component", "node")).alias("c"), alone.alias("t")))
    return named.join(named.where("c is not null").groupBy("c", "t").agg(F.min("doc_id").alias("least")), ["c", "t"], "left")


def similar(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of all ``docs`` (doc_id, text).

    One row per row of ``docs``. Without shingles, component_id is the document's own id; without doc_id it is null.
    Texts of any length are compared whole; repeated ids, ties and an empty table are no special cases, and columns
    other than doc_id and text are ignored. Where rows that repeat an id are in several components, each keeps its own.
    """
    return _components(docs, n, num, den).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def distinct(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any other columns) without near copies: of each component one row stays.

    It is that with the smallest doc_id; where several rows of a component have it, the first by their other columns.
    Rows without shingles or without doc_id all stay, and so do rows that share an id but not a component. Ids that are
    not repeated need no more than a join by id.
    """
    found = cut(_components(docs, n, num, den))
    gone = found.where("least is not null and doc_id <> least").select("doc_id", "node").distinct()
    again = cut(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if not again.limit(1).count():
        return docs.join(gone.select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    once = docs.join(again, "doc_id", "left_anti").join(gone.select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    rows = docs.join(again, "doc_id", "left_semi").select("doc_id", "text", F.struct(*docs.columns).alias("row"))
    schema = f"doc_id long, node long, n long, row {rows.schema['row'].dataType.simpleString()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            h, offsets = word_hashes(b.column("text"))
            own = [np.unique(shingles(h[a:z], n)) for a, z in zip(offsets[:-1], offsets[1:], strict=True)]
            columns = [b.column("doc_id"), pa.array([shared.names(x)[0] for x in own], pa.int64()), pa.array([len(x) for x in own], pa.int64()), b.column("row")]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "node", "n", "row"])

    several = rows.mapInArrow(run, schema).join(gone, ["doc_id", "node"], "left_anti")
    names = found.where("c is not null").select("node", "c", "t").distinct()
    one = several.where("n > 0").join(names, "node").groupBy("doc_id", "c", "t").agg(F.min("row").alias("row")).select("row")
    return once.unionByName(one.unionByName(several.where("n = 0").select("row")).select("row.*"))

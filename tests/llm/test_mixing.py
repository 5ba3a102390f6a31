import random
from collections import defaultdict

import pytest

from tablesmith.llm import mixing

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, target double, size string"


def test_water_fill():
    assert mixing.water_fill([100, 100, 100], [5, 2, 1], 3) == [187.5, 75.0, 37.5]
    out = mixing.water_fill([10, 100, 100], [5, 2, 1], 3)
    assert out[0] == 30 and sum(out) == pytest.approx(210) and out[1] == pytest.approx(120)
    assert mixing.water_fill([0, 0], [5, 2], 3) == [0, 0] and mixing.water_fill([], [], 3) == []


def corpus():
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.choice([1, 3, 40, 200])), rng.choice(["b", "a", "a", "a", "c", None]), "en", 1, 1.0, "x") for i in range(600)]
    return rows + [(900, None, "a", None, None, None, None), (901, " \n", "z", "en", 1, 1.0, "x"), rows[3], rows[3], (None, "w w w", "a", "en", 1, 1.0, "x"), (902, "w " * 60000, "b", "en", 1, 1.0, "x")]


def test_taken_meets_targets(frame):
    rows = corpus()
    out = mixing.taken(frame(rows, SCHEMA)).collect()
    assert len(out) == len(rows) and sorted((r.doc_id, r.taken) for r in out if r.doc_id is not None) == sorted((r.doc_id, r.taken) for r in mixing.taken(frame(rows, SCHEMA)).collect() if r.doc_id is not None)
    sums, sizes, target = defaultdict(int), defaultdict(int), {}
    for r in out:
        assert 0 <= r.taken <= 3 * r.size
        sums[r.source] += r.taken
        sizes[r.source] += r.size
        target[r.source] = r.target
    names = ["a", "b", "c", "z", None]
    want = mixing.water_fill([sizes[n] for n in names], [5, 2, 1, 5, 2], 3)
    for n, t in zip(names, want, strict=True):
        assert target[n] == pytest.approx(t) and abs(sums[n] - t) <= 1
    assert {r.size for r in out if r.doc_id == 900} == {0}


def test_slots_play_blocks_in_turn(frame):
    parts, _, sources = mixing.mix(frame(corpus(), SCHEMA))
    slots = mixing.schedule(parts.sparkSession, sources).collect()
    by = defaultdict(list)
    for s in sorted(slots, key=lambda s: s.slot):
        by[s.src].append(s)
    for s in sources:
        own = by[s["src"]]
        assert [x.rank for x in own] == list(range(len(own))) and sum(x.words for x in own) == s["take"]


def test_apply_and_empty(frame):
    docs = frame(corpus(), SCHEMA)
    out = mixing.apply(docs)
    assert out.columns == docs.columns
    times = defaultdict(int)
    for r in out.collect():
        times[r.doc_id] += 1
    assert max(v for k, v in times.items() if k != rows_id) <= 3 and 900 not in times
    assert mixing.taken(frame([], SCHEMA)).count() == 0 and mixing.apply(frame([], SCHEMA)).count() == 0


rows_id = 3


def test_slots_follow_the_golden_ratio(frame):
    """The schedule by plain arithmetic: points of the golden ratio through cumulative weights, ranked per source."""
    from bisect import bisect_right

    parts, _, sources = mixing.mix(frame(corpus(), SCHEMA))
    live = [s for s in sources if s["take"] > 0]
    need = [-(-s["take"] // s["block"]) + s["take"] // max(1, s["source_size"]) + 1 for s in live]
    edges = [sum(need[: i + 1]) / sum(need) for i in range(len(need))][:-1]
    got = {s.slot: (s.src, s.rank, s.block, s.words) for s in mixing.schedule(parts.sparkSession, sources).collect()}
    rank, left, want = defaultdict(int), {s["src"]: s["take"] for s in live}, {}
    for slot in range(max(got) + 1):
        s = live[bisect_right(edges, (slot * mixing.GOLDEN) % 10**16 / 1e16)]
        src, r = s["src"], rank[s["src"]]
        rank[src] += 1
        blocks = -(-s["source_size"] // s["block"])
        words = min(s["block"], s["source_size"] - r % blocks * s["block"], left[src])
        if words > 0:
            left[src] -= words
            want[slot] = (src, r, r % blocks, words)
    assert got == want and not any(left.values())

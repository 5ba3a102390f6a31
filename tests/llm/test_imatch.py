import hashlib
import random

from tablesmith.llm import imatch

SCHEMA = "doc_id long, text string, n_chars long, fingerprint string, part int, guest string"


def test_edits_follow_descending_ids(frame):
    rng = random.Random(7)
    words = [f"w{i}é" for i in range(300)]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 8, 60]))), 1, "x", 1, "y") for i in rng.sample(range(1000), 120)]
    rows += [(2000, None, None, None, None, None), (2001, "lonely", 1, "x", 1, "y"), (2002, "w1é " * 30_000, 1, "x", 1, "y"), (-5, rows[0][1], 1, "x", 1, "y")]
    order = sorted(rows, key=lambda r: -r[0])
    want = {}
    for i, (doc, text, *_) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        k = len(text) // 2
        want[doc] = (len(text), hashlib.sha256((text[: len(text) - k] + after[:k]).encode()).hexdigest())
    out = imatch.edited(frame(rows, SCHEMA).repartition(5)).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in out} == want and len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert by[-5].fingerprint == by[rows[0][0]].fingerprint
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)
    assert by[2001].near_edited == 0.0 or by[2001].n_chars < 2
    plain = {r.doc_id: r.fingerprint for r in imatch.fingerprint(frame(rows, SCHEMA)).collect()}
    assert plain == {r.doc_id: r.fingerprint for r in out}


def test_repeated_missing_and_no_rows(frame):
    rows = [(1, "a b", 1, "x", 1, "y"), (1, "a b", 1, "x", 1, "y"), (None, "c d", 1, "x", 1, "y")]
    assert imatch.edited(frame(rows, SCHEMA)).count() == 3
    assert imatch.edited(frame([], SCHEMA)).count() == 0
    one = imatch.edited(frame(rows[:1], SCHEMA)).collect()[0]
    assert one.edited_sha256 == hashlib.sha256(b"a a").hexdigest()


def test_lexicon_counts_documents(frame, monkeypatch):
    from tablesmith.llm.words import word_hashes
    import pyarrow as pa

    rows = [(i, f"all every{i % 2} rare{i} rare{i} " + ("mid " if i % 5 == 0 else ""), 1, "x", 1, "y") for i in range(100)]
    monkeypatch.setattr(imatch, "LOWEST", 0.1)
    found = set(imatch.lexicon(frame(rows, SCHEMA)).tolist())
    h = lambda w: int(word_hashes(pa.array([w]))[0][0])
    assert h("mid") in found and h("all") not in found and h("rare7") not in found and h("every1") not in found


def test_fingerprints_match_brute_force(frame, monkeypatch):
    import re

    import numpy as np
    import pyarrow as pa
    import xxhash

    from tablesmith.llm.words import mix, word_hashes

    monkeypatch.setattr(imatch, "LOWEST", 0.03)
    monkeypatch.setattr(imatch, "RATES", (0, 1, 2, 3, 3, 4))
    monkeypatch.setattr(imatch, "SEEDS", imatch.SEEDS[:6])
    rng = random.Random(5)
    words = [f"t{i}" for i in range(120)]
    rows = [(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(120)], k=rng.choice([1, 6, 30]))) + f" only{i}", 1, "x", 1, "y") for i in range(150)]
    rows += [(900, "", 1, "x", 1, "y"), (901, None, 1, "x", 1, "y"), (902, rows[0][1], 1, "x", 1, "y"), (903, "quite alone", 1, "x", 1, "y")]
    own = {d: set(re.findall(r"\S+", (t or "").lower())) for d, t, *_ in rows}
    df = {w: sum(w in o for o in own.values()) for w in set().union(*own.values())}
    code = {w: int(word_hashes(pa.array([w]))[0][0]) for w in df}
    kept = {w for w, n in df.items() if max(imatch.FEWEST, 0.03 * len(rows)) <= n <= len(rows) / 4}

    def plain(terms):
        out = []
        for seed, rate in zip(imatch.SEEDS, imatch.RATES):
            inside = sorted(code[w] for w in terms & kept if rate == 0 or int(mix(np.array([code[w] * int(seed) % 2**64], np.uint64))[0]) >> (64 - rate) == 0)
            out.append(xxhash.xxh3_64_intdigest(b"".join(x.to_bytes(8, "little") for x in inside)) if inside else 0)
        if not any(out):
            out[0] = xxhash.xxh3_64_intdigest(b"".join(x.to_bytes(8, "little") for x in sorted(code[w] for w in terms)), seed=1)
        return out

    got = {r.doc_id: r for r in imatch.edited(frame(rows, SCHEMA).repartition(3)).collect()}
    want = {d: plain(o) for d, o in own.items()}
    assert {d: r.fingerprint for d, r in got.items()} == {d: "".join(f"{x:016x}" for x in w) for d, w in want.items()}
    order = sorted(own, reverse=True)
    for d, after in zip(order, order[1:] + order[:1]):
        used = [(x, y) for x, y in zip(want[d], want[after]) if x or y]
        assert got[d].near_next == sum(x == y for x, y in used) / len(used)

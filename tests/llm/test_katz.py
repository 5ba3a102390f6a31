import random
import re
import zlib
from collections import Counter, defaultdict
from math import log10

from tablesmith.llm import katz

SCHEMA = "doc_id long, text string, source string, w long, h string, n string"


def brute(rows):
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]
    fold = {d: zlib.crc32(str(d).encode()) % 10 if d is not None else None for d, *_ in rows}
    one, two, after = Counter(), Counter(), Counter()
    for d, t, *_ in rows:
        if fold[d]:
            w = split(t)
            one.update(w)
            two.update(zip(["<s>", *w], w))
            after.update(["<s>", *w[:-1]])
    total = sum(one.values())

    def discount(counts):
        return katz._discounts(__import__("numpy").array([sum(c == r for c in counts) for r in range(katz.K + 2)]))

    d1, d2 = discount(one.values()), discount(two.values())
    cut = lambda c, d: c * d[c] if c <= katz.K else c - d[katz.K + 1]
    p = {w: cut(c, d1) / total for w, c in one.items()}
    unknown = 1 - sum(p.values())
    seen = defaultdict(list)
    for (h, w), c in two.items():
        seen[h].append((w, c))
    weight = {h: (1 - sum(cut(c, d2) for _, c in s) / after[h]) / (1 - sum(p[w] for w, _ in s)) for h, s in seen.items()}

    def of(h, w):
        if two[h, w]:
            return cut(two[h, w], d2) / after[h]
        return weight.get(h, 1.0) * p.get(w, unknown)

    for h in list(seen)[:40]:
        assert abs(sum(of(h, w) for w in one) + weight[h] * unknown - 1) < 1e-9
    out = []
    for d, t, *_ in rows:
        w = split(t)
        base = sum(log10((one[x] + 0.1) / (total + 0.1 * (len(one) + 1))) for x in w)
        out.append((str(d), fold[d] == 0, len(w), sum(one[x] > 0 for x in w), total, round(base, 6), round(sum(log10(of(h, x)) for h, x in zip(["<s>", *w], w)), 6)))
    return sorted(out)


def test_scores_match_brute_force(frame, monkeypatch):
    monkeypatch.setattr(katz, "OFTEN", 2)
    monkeypatch.setattr(katz, "HOT", 0.05)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(400)], k=rng.choice([1, 5, 80, 200]))), "s", 1, "x", "y") for i in range(200)]
    rows += [(300, None, None, None, None, None), (301, "", "s", 1, "x", "y"), (302, "NEW words Only w1", "s", 1, "x", "y"), (303, "y " * 40000, "s", 1, "x", "y"), (None, "w1 w2", "s", 1, "x", "y"), (5, rows[5][1], "s", 1, "x", "y")]
    docs = frame(rows, SCHEMA)
    got = sorted((str(r[0]), *r[1:5], round(r[5], 6), round(r[6], 6)) for r in katz.score_documents(docs).collect())
    want = brute(rows)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(abs(a - b) < 1e-5 * max(1, abs(b)) for g, w in zip(got, want, strict=True) for a, b in zip(g[5:], w[5:], strict=True))


def test_without_training_rows_or_rows(frame):
    assert katz.score_documents(frame([], SCHEMA)).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    r = katz.score_documents(frame([(held, "a b", "s", 1, "x", "y")], SCHEMA)).collect()[0]
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)

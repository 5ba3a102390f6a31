import random
import re

from tablesmith.llm import jaccard

SCHEMA = "doc_id long, text string, source string, n long, component string, node string"


def brute(rows, n, num, den):
    sets = {}
    for doc, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        k = min(n, len(words))
        sets[doc] = {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()
    near = {d: d for d in sets}

    def root(x):
        while near[x] != x:
            x = near[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                near[y] = x
    return {(d, len(sets[d]), root(d)) for d in ids}


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    rows, texts = [], []
    hot = " ".join(rng.choices(words, k=60))
    for i in range(260):
        if texts and rng.random() < 0.55:
            own = rng.choice(texts[:12]).split(" ")
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                own[rng.randrange(len(own))] = rng.choice(words)
            text = " ".join(own)
        else:
            text = " ".join(rng.choices(words, k=rng.choice([1, 2, 3, 4, 40, 90, 200])))
            if rng.random() < 0.3:
                text += " " + hot
        texts.append(text)
        rows.append((i, text.upper() if i % 9 == 0 else text, "s", 1, "x", "y"))
    return rows + [(900, None, None, None, None, None), (901, "", "s", 1, "x", "y"), (902, " \t\n ", "s", 1, "x", "y"), (903, "one", "s", 1, "x", "y"), (904, "ONE", "s", 1, "x", "y"), (905, "y " * 30000, "s", 1, "x", "y"), (906, "y " * 29000, "s", 1, "x", "y")]


def test_components_match_brute_force(frame):
    for seed, (n, num) in enumerate([(3, 90), (5, 80), (3, 60)]):
        rows = corpus(seed)
        got = {tuple(r) for r in jaccard.similar(frame(rows, SCHEMA), n, num, 100).collect()}
        assert got == brute(rows, n, num, 100)


def test_empty_table_and_missing_ids(frame):
    assert jaccard.similar(frame([], SCHEMA)).count() == 0
    rows = [(None, "a b c d", "s", 1, "x", "y"), (3, "a b c d", "s", 1, "x", "y"), (3, "a b c d", "s", 1, "x", "y"), (2, "A b c d", "s", 1, "x", "y")]
    got = sorted((tuple(r) for r in jaccard.similar(frame(rows, SCHEMA)).collect()), key=str)
    assert got == [(2, 2, 2), (3, 2, 2), (3, 2, 2), (None, 2, None)]


def test_repeated_ids_with_different_texts(frame):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(500)]
    a, b = rng.choices(words, k=300), rng.choices(words, k=300)
    c = b[:100] + ["other"] + b[101:]
    rows = [(i, " ".join(t), "s", 1, "x", "y") for i, t in ((7, a), (7, b), (9, c), (10, a))]
    got = sorted(tuple(r) for r in jaccard.similar(frame(rows, SCHEMA)).collect())
    size = lambda t: len({tuple(t[i : i + 3]) for i in range(len(t) - 2)})
    assert got == sorted([(7, size(a), 7), (7, size(b), 7), (9, size(c), 7), (10, size(a), 7)])


def test_copies_in_many_partitions(frame):
    rows = [(i, text, "s", 1, "x", "y") for i, text in enumerate(["p q r s t u v", "a b c d e f g h"] * 40)]
    got = {tuple(r) for r in jaccard.similar(frame(rows, SCHEMA).repartition(16)).collect()}
    assert got == {(i, 5 + i % 2, i % 2) for i in range(80)}


def test_blocks_of_any_size_give_the_same(frame, monkeypatch):
    from tablesmith.llm import shared

    rows = corpus(5)
    docs = frame(rows, SCHEMA).repartition(5)
    want = brute(rows, 3, 80, 100)
    for tokens, spare in ((500, 12), (20_000, 12), (3000, -30)):
        monkeypatch.setattr(shared, "TOKENS", tokens)
        monkeypatch.setattr(shared, "SPARE", spare)
        assert {tuple(r) for r in jaccard.similar(docs, 3, 80, 100).collect()} == want


def test_one_row_of_each_component_stays(frame):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(500)]
    a, b, c = (" ".join(rng.choices(words, k=200)) for _ in range(3))
    rows = [(7, a, "s", 1, "x", "y"), (7, b, "s", 1, "x", "y"), (7, b, "r", 1, "x", "y"), (9, b + " more", "s", 1, "x", "y"), (10, a, "s", 1, "x", "y"), (8, c, "s", 1, "x", "y")]
    rows += [(7, "", "s", 1, "x", "y"), (None, a, "s", 1, "x", "y"), (12, None, "s", 1, "x", "y"), (11, c, "s", None, None, None)]
    for own, want in ((rows, [rows[i] for i in (0, 2, 5, 6, 7, 8)]), (rows[3:6] + rows[7:], [rows[i] for i in (3, 4, 5, 7, 8)]), ([], [])):
        docs = frame(own, SCHEMA)
        out = jaccard.distinct(docs, 5, 80, 100)
        assert out.columns == docs.columns and sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(map(str, want))

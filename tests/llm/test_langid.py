import random

import pytest

from tablesmith.llm import langid

SCHEMA = "doc_id long, text string, lang string, lang_pred string, score string, source string"
WORDS = {"en": ["the", "and", "thing", "with", "reading"], "fr": ["élève", "leur", "aux", "cheveu", "être"], "de": ["über", "schön", "ich", "straße", "nicht"]}


def corpus(n=240):
    rng = random.Random(5)
    return [(i, " ".join(rng.choices(WORDS[lang], k=rng.choice([2, 10, 60]))), lang, "zz", "zz", "s") for i in range(n) for lang in [rng.choice(["en", "en", "fr", "de"])]]


def test_held_out_accuracy_and_edges(frame):
    rows = corpus() + [(900, None, "en", None, None, None), (901, "", "en", "x", "x", "s"), (902, "12 !! 34", "fr", "x", "x", "s"), (903, "the and thing", None, "x", "x", "s"), (None, "leur élève", "fr", "x", "x", "s"), (904, "nicht " * 60_000, "de", "x", "x", "s"), (5, *corpus()[5][1:])]
    out = langid.identify(frame(rows, SCHEMA)).collect()
    assert len(out) == len(rows)
    truth = {r[0]: r[2] for r in rows}
    got = {r.doc_id: r for r in out}
    held = [r for r in out if r.held_out and r.doc_id < 900]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held) > 0
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    assert got[903].lang_pred == "en" and got[None].lang_pred == "fr" and not got[None].held_out and got[904].lang_pred == "de"
    assert all(0 <= r.score <= 1 for r in out)


def test_nothing_to_learn(frame):
    assert langid.identify(frame([], SCHEMA)).count() == 0
    rows = [(1, "the thing", None, "x", "x", "s")]
    assert [r.lang_pred for r in langid.identify(frame(rows, SCHEMA)).collect()] == ["und"]


def test_grams_are_exact():
    import numpy as np

    known = langid.grams("abcdefgh über")
    v = langid.Vocabulary(known)
    assert sorted(v.find(known)) == list(range(len(known)))
    other = np.setdiff1d(langid.grams("zyxw vuts"), known)
    assert (v.find(other) == v.size).all()


def test_many_languages_are_all_learned_or_refused(frame, monkeypatch):
    draw = random.Random(3)

    def prose(lang):
        letters = random.Random(lang).sample("abcdefghijklmnopqrstuvwxyz", 9)
        return " ".join("".join(draw.choice(letters) for _ in range(draw.randint(2, 7))) for _ in range(60))

    def corpus(n, each):
        return frame([(i * n + lang, prose(lang), f"l{lang:02}", "s") for i in range(each) for lang in range(n)], "doc_id long, text string, lang string, source string")

    with pytest.raises(ValueError):
        langid.fit(corpus(langid.MOST_LANGUAGES + 1, 2))
    built = []
    init = langid.Model.__init__
    monkeypatch.setattr(langid.Model, "__init__", lambda self, landmarks: (built.append(len(landmarks)), init(self, landmarks))[1])
    docs = corpus(langid.MOST_LANGUAGES, 30)
    model = langid.fit(docs)
    assert len(model.names) == langid.MOST_LANGUAGES and built[0] > 6 * langid.MOST_LANGUAGES
    assert langid.predict(docs, model).where("lang = lang_pred").count() > 0.9 * docs.count()


def test_scores_are_those_of_an_explicit_kernel():
    """Nystroem landmarks and ridge regression, written out with sets of n-grams."""
    import numpy as np

    rows = corpus(60)
    landmarks, train, asked = [r[1] for r in rows[:12]], rows[12:48], [r[1] for r in rows[48:]] + ["über the cheveu", "zzz"]
    model = langid.Model([langid.grams(t) for t in landmarks])
    model.fit(model.features([r[1] for r in train]), [r[2] for r in train])

    def spectrum(text):
        low = text.lower()
        return {low[i : i + n] for n in langid.ORDERS for i in range(len(low) - n + 1)}

    known = set().union(*map(spectrum, landmarks))
    unit = lambda t: (spectrum(t) & known, len(spectrum(t) & known) ** 0.5 or 1.0)
    kernel = lambda xs, ys: np.array([[len(a & b) / max(p, 1) / max(q, 1) for b, q in map(unit, ys)] for a, p in map(unit, xs)])
    values, vectors = np.linalg.eigh(kernel(landmarks, landmarks))
    keep = values > 1e-6 * max(1.0, values.max())
    features = lambda xs: kernel(xs, landmarks) @ (vectors[:, keep] / np.sqrt(values[keep]))
    texts, langs = [r[1] for r in train], [r[2] for r in train]
    names = sorted(set(langs))
    weight = np.array([1 / langs.count(x) for x in langs])
    x = np.hstack([features(texts), np.ones((len(texts), 1))])
    y = np.array([[1.0 if lang == n else -1.0 for n in names] for lang in langs])
    gram = (x * weight[:, None]).T @ x
    w = np.linalg.solve(gram + langid.RIDGE * np.eye(len(gram)) * np.trace(gram) / len(gram), (x * weight[:, None]).T @ y)
    value = np.hstack([features(asked), np.ones((len(asked), 1))]) @ w
    best, score = model.predict(asked)
    assert [model.names[k] for k in best] == [names[k] for k in value.argmax(1)]
    assert np.allclose(score, np.clip((value.max(1) + 1) / 2, 0, 1), atol=1e-4)

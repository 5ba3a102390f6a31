import re

import numpy as np
import pyarrow as pa

from tablesmith.llm import words


def test_words_are_told_apart(monkeypatch):
    texts = ["Hello World hello", "", None, "   a  b\tc\x0bd ", "x" * 300 + " y", "éà É\xa0z ", "q", "r s", "\x00 \x1c"]
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    want = [re.findall(r"[^\x20\x09-\x0D]+", low(t or "")) for t in texts]
    results = []
    for chunk in (16, 64, 1 << 20):
        monkeypatch.setattr(words, "CHUNK", chunk)
        h, offsets = words.word_hashes(pa.array(texts))
        assert np.diff(offsets).tolist() == [len(w) for w in want]
        known = {}
        for word, x in zip(sum(want, []), h.tolist(), strict=True):
            assert known.setdefault(word, x) == x
        assert len(set(known.values())) == len(known)
        results.append(h.tolist())
    assert results[0] == results[1] == results[2]


def test_shingles():
    h = words.word_hashes(pa.array(["a b c d"]))[0]
    assert len(words.shingles(h, 3)) == 2 and len(words.shingles(h[:2], 3)) == 1 and len(words.shingles(h[:0], 3)) == 0
    assert words.shingles(h, 3)[1] == words.shingles(h[1:], 3)[0] != words.shingles(h[::-1][:3], 3)[0]

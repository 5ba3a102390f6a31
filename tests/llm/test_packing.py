import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tablesmith.llm import packing

SCHEMA = "doc_id long, text string, ids string, length string"
PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "ab\x1dc it's ŁÓDŹ ǅ", bytes(range(1, 256)).decode("latin-1"), "É <|x|> ²³½", "<|endoftext|> hi É ̈", "İstanbul ΣΑΣ 123", " \xa0 T̈ ", "naïve café's don't", "日本語 テスト"]


def test_encoder_gives_the_tokenizers_ids(monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 12)
    monkeypatch.setattr(packing, "TOGETHER", 3)
    monkeypatch.setattr(packing, "GROUP_BYTES", 64)
    plain = Tokenizer.from_file(PATH)
    rng = random.Random(8)
    texts = ["".join(rng.choices("aZst're vELlmd'' 1.,\n<|é", k=rng.choice([3, 9, 60]))) for _ in range(3000)]
    texts += ["'S it'S 'twas we'RE you'll'd ''s 's's .'s a'", "don't", "'", "'r", "e's", "can'", "tis 'v", "e"]
    texts += [*ODD, "x" * 500, "the The THE <|ENDOFTEXT|> <|endoftext|>x", *ODD]
    for rules in (open(PATH, encoding="utf-8").read(), open(PATH, encoding="utf-8").read().replace('"NFC"', '"NFKC"')):
        encode, plain = packing.Encoder(rules), Tokenizer.from_str(rules)
        assert encode.apart == ("NFKC" not in rules)
        for text, ids in zip(texts, encode(pa.array(texts)), strict=True):
            assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids, text
        assert list(encode(pa.array([], pa.string()))) == [] and len(encode.known) <= 60


def test_differencing():
    rng = random.Random(2)
    sizes = [rng.randint(1, 256) for _ in range(500)]
    sets = packing.difference(sizes, 8)
    sums = [sum(sizes[i] for i in s) for s in sets]
    assert sorted(i for s in sets for i in s) == list(range(500)) and max(sums) - min(sums) <= 2
    assert all(sum([5, 5, 5][i] for i in s) <= 8 for s in packing.windows([5, 5, 5], 8)) and packing.difference([], 2) == [[], []]


def test_items_are_cut_only_where_windows_would_be_wasted():
    rng = random.Random(4)
    for sizes in ([10] * 7, [6] * 9, [rng.randint(1, 10) for _ in range(400)], [1], [10, 9, 1]):
        sets = packing.fitted(sizes, 10)
        assert len(sets) <= -(-sum(sizes) // 10) * (1 + packing.WASTE) and all(sum(z - a for _, a, z in s) <= 10 and all(a < z for _, a, z in s) for s in sets)
        parts = sorted(x for s in sets for x in s)
        for i, size in enumerate(sizes):
            own = [(a, z) for j, a, z in parts if i == j]
            assert own[0][0] == 0 and own[-1][1] == size and all(x[1] == y[0] for x, y in zip(own, own[1:]))
    assert sorted(packing.fitted([10, 9, 1], 10)) == [[(0, 0, 10)], [(1, 0, 9), (2, 0, 1)]]


def test_pieces_rebuild_documents(spark, frame):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(["alpha", "beta", "gamma", "été"], k=rng.choice([1, 30, 400, 5000]))), "x", "y") for i in range(150)]
    rows += [(1000 + i, t, "x", "y") for i, t in enumerate(ODD)] + [(2000, None, None, None), (2001, "w " * 50_000, "x", "y")]
    docs = frame(rows, SCHEMA).repartition(3)
    plain = Tokenizer.from_file(PATH)
    pieces, places, total = defaultdict(list), defaultdict(list), 0
    for r in packing.pack(docs, PATH).collect():
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert len(ids) == r.length > 0
        pieces[r.doc_id].append((r.start, ids, r.doc_tokens))
        places[r.sequence_id].append((r.offset, r.length))
    for doc, text, *_ in rows:
        ids = [x for _, part, _ in sorted(pieces[doc]) for x in part]
        assert ids == plain.encode(text or "", add_special_tokens=False).ids + [2] and {n for *_, n in pieces[doc]} == {len(ids)}
        total += len(ids)
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    assert len(places) * packing.WINDOW <= 1.05 * total + 3 * packing.WINDOW
    assert packing.pack(frame([], SCHEMA), PATH).count() == 0


def test_digest(frame):
    import zlib

    r = packing.digest(frame([(1, "hello", "x", "y")], SCHEMA), PATH).collect()[0]
    ids = np.array([*Tokenizer.from_file(PATH).encode("hello", add_special_tokens=False).ids, 2], "<u4")
    assert r.ids_crc32 == zlib.crc32(ids.tobytes()) and r.doc_tokens == len(ids) == pytest.approx(r.length)


def test_workers_hold_little(monkeypatch):
    from types import SimpleNamespace as Own

    import pyspark

    monkeypatch.setattr(packing, "ready", lambda spark: spark)
    monkeypatch.setattr(pyspark, "TaskContext", Own(get=lambda: Own(partitionId=lambda: 0)))
    docs = Own(sparkSession=Own(sparkContext=Own(broadcast=lambda text: Own(value=text))))
    docs.select = lambda *columns: Own(mapInArrow=lambda run, schema: run)
    texts = ["w " * 1_000_000] + ["word of a text " * 1500] * 400
    given = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    got = list(packing.pack(docs, PATH)(iter([given])))
    ids = sum(sum(b.column("length").to_pylist()) for b in got)
    assert ids == 1_000_001 + 400 * 6001 and max(b.nbytes for b in got) <= packing.HELD_BYTES + 4 * packing.WINDOW * (packing.GROUP + 1) + (1 << 18)

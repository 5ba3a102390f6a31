import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
HEX = "04dbebab91ab85687d33eeaaf9ac699e1188f962"


def corpus():
    import random

    rng = random.Random(9)
    words = {"en": ["the", "and", "thing", "with", "reading", "house"], "fr": ["élève", "leur", "aux", "cheveu", "être", "pour"]}
    rows = []
    for i in range(120):
        lang = rng.choice(["en", "fr"])
        text = " ".join(rng.choice(words[lang]) + str(rng.randrange(40)) for _ in range(60))
        rows.append((i, text, lang, rng.choice(["a", "b", "c"]), len(text)))
    rows.append((500, rows[3][1], rows[3][2], "a", 1))
    rows.append((501, rows[4][1] + " extra", rows[4][2], "b", 1))
    rows.append((502, "12 34 !!", "en", "a", 1))
    rows.append((503, f'the thing token = "{HEX}" and reading', "en", "a", 1))
    return rows


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard", "secret_scan", "mixing", "packing"]
    docs = spark.createDataFrame(corpus(), SCHEMA)
    kept = corpus_pipeline.language_id(spark, docs, "")
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in corpus()} - {502}
    unique = corpus_pipeline.ngram_jaccard(spark, docs, "")
    assert unique.columns == docs.columns and sorted(r.doc_id for r in unique.collect()) == sorted({r[0] for r in corpus()} - {500, 501})
    clean = {r.doc_id: r.text for r in corpus_pipeline.secret_scan(spark, docs, "").collect()}
    assert clean == {r[0]: r[1].replace(HEX, "[SECRET]") for r in corpus()}
    mixed = corpus_pipeline.mix_sources(spark, docs, "")
    assert mixed.columns == docs.columns and mixed.count() > 0
    assert corpus_pipeline.pack(spark, docs, "").count() > 0


def test_run(spark, tmp_path):
    spark.createDataFrame(corpus(), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(out.columns)


WIDE = SCHEMA + ", node long, size string, score double, text_ string, component_id string, __key long"


def edges():
    """Nulls in every column, empty and very long texts, ties, repeated rows and ids, and columns with clashing names."""
    wide = lambda i, t, lang="en", source="a", n=7: (i, t, lang, source, n, 1, "s", 0.5, "t", "c", 2)
    base = " ".join(f"the{i % 9} thing with{i} reading" for i in range(40))
    rows = [wide(1, base), wide(1, base), wide(2, base + " more"), wide(3, None), wide(4, ""), wide(5, " \n\t "), wide(6, "12 34 !!"), wide(7, "leur élève " * 30_000, "fr", "b"), wide(8, f"see token = '{HEX}' the and thing with reading", None, None, None)]
    rows += [(None, "the house and thing with reading here", "en", "b", 1, 1, "s", 0.5, "t", "c", 2), (9, "the only thing reading there", *[None] * 9), wide(2, "a wholly other thing with the same id and reading")]
    return rows + [wide(100 + i, f"{'the thing with reading' if i % 2 else 'leur élève aux cheveu'} {i} {i * 7} {i * 13}", "en" if i % 2 else "fr", "ab"[i % 3 > 0]) for i in range(60)]


def test_stages_on_edges(spark):
    docs = spark.createDataFrame(edges(), WIDE)
    kept = corpus_pipeline.language_id(spark, docs, "")
    ids = lambda df: sorted(str(r.doc_id) for r in df.collect())
    letters = [r for r in edges() if r[1] and any(map(str.isalpha, r[1]))]
    assert kept.columns == docs.columns and ids(kept) == sorted(str(r[0]) for r in letters) and kept.where("lang is null").count() == 0
    unique = corpus_pipeline.ngram_jaccard(spark, docs, "")
    assert unique.columns == docs.columns
    assert ids(unique) == sorted([*(str(r[0]) for r in edges() if r[0] not in (1, 2)), "1", "2"])  # one of 1 and 1, and 2's other text
    assert [r.text for r in unique.where("doc_id = 2").collect()] == ["a wholly other thing with the same id and reading"]
    clean = corpus_pipeline.secret_scan(spark, docs, "")
    assert clean.columns == docs.columns and ids(clean) == ids(docs) and not [r for r in clean.collect() if r.text and HEX in r.text]
    assert [r.text for r in clean.where("doc_id in (3, 4, 5, 7)").orderBy("doc_id").collect()] == [None, "", " \n\t ", "leur élève " * 30_000]
    mixed = corpus_pipeline.mix_sources(spark, docs, "")
    times = {}
    for r in mixed.collect():
        times[str(r.doc_id)] = times.get(str(r.doc_id), 0) + 1
    assert mixed.columns == docs.columns and not {"3", "4", "5"} & set(times) and max(v for k, v in times.items() if k not in ("1", "2")) <= 3
    pieces = corpus_pipeline.pack(spark, docs, "").collect()
    tokens = {}
    for r in pieces:
        tokens[str(r.doc_id)] = tokens.get(str(r.doc_id), 0) + r.length
    assert set(tokens) == {str(r[0]) for r in edges()} and tokens["3"] == tokens["4"] == tokens["5"] == 1
    assert tokens["1"] == 2 * next(r.doc_tokens for r in pieces if r.doc_id == 1)


def test_stages_on_an_empty_table(spark):
    docs = spark.createDataFrame([], WIDE)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0, name

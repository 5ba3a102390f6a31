import uuid
import zipfile

from pyspark.sql import functions as F

from tablesmith.operators import prepare
from tablesmith.sources import files, tracking
from tablesmith.streaming import pipeline as st


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_round_trips_by_format(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b", 2.5), (2, "c\td", None)], "i int, s string, x double")
    for kind in ("csv", "tsv", "parquet", "json", "orc"):
        path = f"{tmp_path}/table.{kind}"
        files.write(df, path, files=1)
        back = files.read(spark, path, schema=df.schema)
        assert files.kind_of(path) == kind and rows(back.select("i", "s")) == [(1, "a,b"), (2, "c\td")]
        assert files.read(spark, path, schema=df.schema, columns=["x"]).columns == ["x"]
        assert files.info(spark, path).first()["rows"] == 2


def test_first_lines_are_skipped_in_each_file(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.csv").write_text(f"made by hand\n# note\na;b\n{i};x\n{i + 10};y\n")
    out = files.read(spark, str(tmp_path), "csv", sep=";", skip=2)
    assert dict(out.dtypes) == {"a": "int", "b": "string"} and rows(out) == [(0, "x"), (1, "x"), (2, "x"), (10, "y"), (11, "y"), (12, "y")]


def test_chunks_keep_all_columns(spark):
    out = files.chunks(spark.range(10).selectExpr("id", "id * 2 as x"), ["id"], 4)
    assert rows(out) == [(i, 2 * i, i // 4) for i in range(10)]


def test_workbook(spark, tmp_path):
    sheet = """<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>n</t></is></c><c r="C1" t="s"><v>1</v></c></row>
    <row r="2"><c r="A2"><v>1.5</v></c><c r="B2"><v>7</v></c></row><row r="3"><c r="B3" t="str"><v>z</v></c><c r="C3"><v>2</v></c></row></sheetData></worksheet>"""
    with zipfile.ZipFile(tmp_path / "t.xlsx", "w") as book:
        book.writestr("xl/worksheets/sheet1.xml", sheet)
        book.writestr("xl/sharedStrings.xml", """<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>x</t></si><si><r><t>lo</t></r><r><t>ng</t></r></si></sst>""")
    out = files.excel(spark, f"{tmp_path}/t.xlsx")
    assert dict(out.dtypes) == {"x": "double", "n": "string", "long": "double"} and [tuple(r) for r in out.collect()] == [(1.5, "7", None), (None, "z", 2.0)]


def test_runs(spark, tmp_path):
    store = tracking.Runs(spark, str(tmp_path))
    for run, loss in (("a", 0.5), ("b", 0.25)):
        store.log(run, "param", {"depth": 3})
        store.log(run, "metric", {"loss": loss * 2}, step=0)
        store.log(run, "metric", {"loss": loss}, step=1)
    assert rows(store.best("loss")) == [("b", 0.25)] and rows(store.latest("param")) == [("a", "depth", "3"), ("b", "depth", "3")]


def stream(spark, tmp_path, most=1):
    for i in range(4):
        spark.range(i * 50, i * 50 + 50).selectExpr("id", "id % 3 as g", "cast(id % 7 as double) as x", "timestamp_seconds(id * 60) as ts").coalesce(1).write.mode("append").parquet(str(tmp_path))
    return st.source(spark, str(tmp_path), "id long, g long, x double, ts timestamp", most)


def test_running_statistics_of_a_stream(spark, tmp_path):
    events = stream(spark, tmp_path)
    out = st.drain(st.running(events, ["g"], "x"), uuid.uuid4().hex)
    whole = spark.read.parquet(str(tmp_path)).groupBy("g").agg(F.count("x"), F.round(F.avg("x"), 9), F.min("x"), F.max("x"))
    assert rows(out.select("g", "n", F.round("mean", 9), "low", "high")) == rows(whole)


def test_windows_and_scores_of_a_stream(spark, tmp_path):
    events = stream(spark, tmp_path)
    out = st.drain(st.windowed(events, "ts", [], "x", "1 hour"), uuid.uuid4().hex)
    assert sorted(r.n for r in out.collect()) == [20, 60, 60, 60]
    scored = st.drain(st.predict(events, 2 * F.col("x")).select("id", "score"), uuid.uuid4().hex, "append")
    assert rows(scored) == [(i, 2.0 * (i % 7)) for i in range(200)]


def test_detector_keeps_its_state_over_batches(spark, tmp_path):
    one = st.drain(st.ddm(stream(spark, tmp_path).withColumn("bad", F.col("id") > 150), "g", "id", "bad"), uuid.uuid4().hex, "update")
    last = {r.g: r for r in one.collect() if r.n >= 66}
    assert {g: r.level for g, r in last.items()} == {0: 2, 1: 2, 2: 2} and sum(r.n for r in last.values()) == 200


def test_preprocessor(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.0, "a"), (2, None, "b"), (3, 3.0, None), (4, 8.0, "b")], "i int, x double, c string")
    fitted = prepare.Preprocessor(encoder="frequency", scaler="minmax").fit(df, ["x", "c"])
    fitted.save(spark, f"{tmp_path}/p")
    out = prepare.Preprocessor.load(spark, f"{tmp_path}/p").transform(df).orderBy("i").collect()
    assert [round(r.x, 6) for r in out] == [0.0, round(3 / 7, 6), round(2 / 7, 6), 1.0] and [r.c for r in out] == [0.25, 0.75, 0.75, 0.75]
    assert [r.x for r in fitted.inverse(fitted.transform(df)).orderBy("i").collect()] == [1.0, 4.0, 3.0, 8.0]
    more = fitted.partial_fit(spark.createDataFrame([(5, 1e9, "z")], df.schema)).running["x"]
    assert more.n == 4 and more.high == 1e9 and abs(more.mean - 250000003) < 1e-3
    unseen = fitted.transform(spark.createDataFrame([(9, None, "new")], df.schema)).first()
    assert unseen.c == 0.0

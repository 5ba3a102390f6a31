import math

import pytest
from pyspark.sql import functions as F

from tablesmith.functions import order_stats
from tablesmith.operators import anomaly, choose, drift, encode, evaluate, govern, impute, learn, sampling, scale, timeseries, transforms
from tablesmith.operators import features as fx


@pytest.fixture
def five(spark):
    return spark.createDataFrame([(i, float(i), 1) for i in range(1, 6)], "i int, x double, g int")


def values(df, c, order="i"):
    return [r[c] for r in df.orderBy(order).collect()]


def test_scalers(five):
    out = values(scale.transform(five, scale.fit(five, ["x"], "standard")), "x")
    assert sum(out) == pytest.approx(0) and out[2] == 0
    params = scale.fit(five, ["x"], "minmax", clip=True)
    wide = five.select("i", (F.col("x") * 10 - 20).alias("x"))
    assert values(scale.transform(wide, params), "x") == [0, 0, 1, 1, 1]
    assert values(scale.inverse(scale.transform(five, params), params), "x") == [1, 2, 3, 4, 5]


def test_order_statistics(spark, monkeypatch):
    monkeypatch.setattr(order_stats, "BINS", 8)
    inf, nan = float("inf"), float("nan")
    columns = {
        "spread": [float(i * 7919 % 1000) for i in range(400)], "equal": [2.5] * 400, "tail": [1.5**i for i in range(400)], "holes": [None if i % 3 else float(-i) for i in range(400)],
        "odd": [(inf, -inf, nan, 1.7e308, -1.7e308, 5e-324, 0.0, -0.5)[i % 8] for i in range(400)], "none": [None] * 400,
    }
    df = spark.createDataFrame(list(zip(*columns.values(), strict=True)), ", ".join(f"{c} double" for c in columns))
    for c, (n, found) in order_stats.ranked(df, {c: lambda n: [0, 1, n // 3, n // 2, n - 1, n] for c in columns}).items():
        want = sorted(v for v in columns[c] if v is not None and v == v)
        assert n == len(want) and found == {k: want[k] for k in {0, 1, n // 3, n // 2, n - 1} if 0 <= k < n}
    middle, low, high = order_stats.summaries(df, ["tail", "none"])["tail"]
    assert (middle, low, high) == ((1.5**199 + 1.5**200) / 2, 1.5**100, 1.5**300) and order_stats.median(df, "none") is None


def test_windows(five):
    w = timeseries.over(["g"], ["i"])
    rows = five.select("i", timeseries.lag("x", 1, w).alias("l1"), timeseries.lag("x", 2, w).alias("l2"), timeseries.rolling("x", 3, w, "mean").alias("m"))
    assert values(rows, "l1") == [0, 1, 2, 3, 4] and values(rows, "l2") == [0, 0, 1, 2, 3] and values(rows, "m") == [1, 1.5, 2, 3, 4]
    e = timeseries.ewm(five, "x", ["g"], ["i"], 3, "i")
    assert values(e, "ewm") == [1, 1.5, 2.25, 3.125, 4.0625]


def test_difference_and_folds(spark, five):
    w = timeseries.over(["g"], ["i"])
    tri = five.select("i", "g", (F.col("x") * (F.col("x") + 1) / 2).alias("x"))
    assert values(timeseries.difference(tri, "x", w), "x") == [2, 3, 4, 5]
    for k, a, b, c, d in timeseries.expanding(20, 3, 2) + timeseries.purged(30, 3, 2) + timeseries.blocked(20, 4, 1):
        assert a < b <= c < d
    assert [f[0] for f in timeseries.expanding(20, 3, 2)] == [0, 1, 2]


def test_outliers(spark):
    data = [0.5 * i for i in range(41)] + [-33.0, 61.5, None]
    df = spark.createDataFrame(list(enumerate(data)), "i int, x double")
    known = sorted(v for v in data if v is not None)
    a, b = known[int(43 * 0.25)], known[int(43 * 0.75)]
    low, high = transforms.bounds(df, "x", "iqr", 1.5)
    assert (low, high) == (a - 1.5 * (b - a), b + 1.5 * (b - a))
    assert values(transforms.treat(df, "x", (low, high), "clip"), "x") == data[:41] + [low, high, None]
    assert values(transforms.treat(df, "x", (low, high), "remove"), "x") == data[:41] + [None]
    assert values(transforms.treat(df, "x", (low, high), "median"), "x")[41:] == [10.0, 10.0, None]


def test_bins_send_outsiders_to_the_last(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([-1.0, 0.0, 1.0, 1.5, 2.0, 9.0, None])], "i int, x double")
    assert values(df.select("i", transforms.bin_of(F.col("x"), [0.0, 1.0, 2.0, 3.0]).alias("b")), "b") == [2, 0, 0, 1, 1, 2, None]


def test_drift(spark):
    near = spark.createDataFrame([(float(i), True) for i in range(1, 11)] + [(i + 0.5, False) for i in range(1, 11)], "x double, side boolean")
    far = spark.createDataFrame([(float(i), True) for i in range(1, 11)] + [(float(v), False) for v in range(100, 200, 10)], "x double, side boolean")
    assert drift.ks(near, "x", "side").first()["severity"] == 0 and drift.ks(far, "x", "side").first()["severity"] == 2
    assert drift.vote(far, "x", "side").first()["drift"]
    even = spark.createDataFrame([(float(i % 10), True) for i in range(100)] + [(float((i + 1) % 10), False) for i in range(100)], "x double, side boolean")
    assert drift.psi(even, "x", "side").first()["score"] < 0.2


def test_tokens(spark):
    df = spark.createDataFrame([("The Ärzte's 2nd gig, at BERLIN-Mitte: \u00bfno?", 1), ("", 2), (None, 3), ("a I of", 4)], "t string, i int")
    assert values(df.select("i", fx.tokens(F.col("t")).alias("w")), "w") == [["ärzte", "2nd", "gig", "berlin", "mitte", "no"], [], None, []]
    assert values(df.select("i", fx.ngrams(fx.tokens(F.col("t")), 2, 3).alias("w")), "w")[0] == ["ärzte 2nd", "2nd gig", "gig berlin", "berlin mitte", "mitte no", "ärzte 2nd gig", "2nd gig berlin", "gig berlin mitte", "berlin mitte no"]


def test_encoders(spark):
    df = spark.createDataFrame([(1, "b", 1.0), (2, "a", 2.0), (3, "b", 3.0), (4, None, 4.0)], "i int, c string, y double")
    table = encode.label(df, "c", "i")
    assert values(encode.lookup(df, "c", table, "index"), "c") == [0, 1, 0, None]
    assert encode.one_hot(df, "c").columns == ["i", "y", "c_a", "c_b"]
    assert values(encode.frequency(df, "c"), "c") == [0.5, 0.25, 0.5, 0.0]


def test_imputation(spark):
    df = spark.createDataFrame([(1, None, "u"), (2, 1.0, "u"), (3, None, "u"), (4, 3.0, "u")], "i int, x double, g string")
    assert values(impute.forward(df, "x", ["g"], ["i"]), "x") == [None, 1, 1, 3]
    assert values(impute.backward(df, "x", ["g"], ["i"]), "x") == [1, 1, 3, 3]
    assert values(impute.fill(df, "x", "mean"), "x") == [2, 1, 2, 3]


def test_privacy(spark):
    df = spark.createDataFrame([(1, "żółw 77"), (2, "ok"), (3, "ab\u00e9"), (4, ""), (5, None)], "i int, v string")
    assert values(df.select("i", govern.mask(F.col("v"), 4).alias("m")), "m") == ["żółw***", "**", "****", "", None]
    assert values(df.select("i", govern.suppress(F.col("v")).alias("m")), "m") == ["[REDACTED]"] * 4 + [None]
    mixed = govern.randomize(df, "v", "i")
    assert sorted(map(str, values(mixed, "v"))) == sorted(map(str, values(df, "v"))) and values(mixed, "i") == [1, 2, 3, 4, 5]
    groups = spark.createDataFrame([(i % 3, "x" if i < 8 else "y") for i in range(11)], "a int, b string")
    assert govern.k_anonymity(groups, ["a"]).first()["k"] == 3 and govern.k_anonymity(groups, ["a", "b"]).first()["k"] == 1 and govern.k_anonymity(groups, []).first()["k"] == 0


def test_personal_columns(spark):
    rows = [(i, f"u{i}@b.org" if i % 4 else None, f"{i:05d}", f"2001:db8::{i}", "4539 1488 0343 6467" if i % 2 else "4539 1488 0343 6468") for i in range(1, 41)]
    df = spark.createDataFrame(rows, "i int, contact string, place string, source_ip string, paid string")
    found = {(r["column"], r["kind"]): r["confidence"] for r in govern.pii_columns(df, ["contact", "place", "source_ip", "paid"], order="i").collect()}
    assert found == {("contact", "email"): 1.0, ("place", "postal_code"): 1.0, ("source_ip", "ip_address"): 0.7, ("paid", "credit_card"): 0.5}
    advice = {r["column"]: r["advice"] for r in govern.pii_advice(govern.pii_columns(df, ["contact", "place", "paid"], order="i")).collect()}
    assert advice == {"contact": "anonymize", "place": "review", "paid": "remove"}


def test_one_class_of_nearly_all_rows(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 100 == 0, "few").otherwise("many").alias("y")).repartition(6)
    assert sampling.under_sample(df, "y", "id").groupBy("y").count().collect() == sampling.under_sample(df, "y", "id").groupBy("y").count().collect()
    assert {r["y"]: r["count"] for r in sampling.under_sample(df, "y", "id").groupBy("y").count().collect()} == {"few": 30, "many": 30}
    assert {r["y"]: r["count"] for r in sampling.over_sample(df, "y", "id").groupBy("y").count().collect()} == {"few": 2970, "many": 2970}
    held = {r["y"]: r["n"] for r in sampling.stratified_split(df, "y", "id", 0.2).where("held").groupBy("y").agg(F.count("*").alias("n")).collect()}
    assert held == {"few": 6, "many": 594}
    folds = sampling.stratified(df, "y", 5, "id").groupBy("y", "fold").count().collect()
    assert {(r["y"], r["count"]) for r in folds} == {("few", 6), ("many", 594)}
    turns = sampling.repeated(df, 7, 2, "id").groupBy("turn", "fold").count().collect()
    assert sorted(r["count"] for r in turns) == [428] * 6 + [429] * 8


def test_nearest_in_chunks_are_those_of_a_plain_scan(spark, monkeypatch):
    import numpy as np

    from tablesmith.functions import near

    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 5))
    x[7] = x[9] = x[11]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(500, None), (501, [float("nan")] * 5), (502, [1.0])], "i long, v array<double>").repartition(3)
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    for size in (1 << 25, 1000):
        monkeypatch.setattr(near, "CHUNK_BYTES", size)
        got = {}
        for r in near.pairs(df, df, "i", "v", k=4).collect():
            got.setdefault(r["i"], set()).add(r["near"])
        assert got == {i: {j for _, j in sorted((round(dist[i, j], 12), j) for j in range(120) if j != i)[:4]} for i in range(120)}
        far = near.pairs(df, df, "i", "v", k=1, farthest=True)
        assert all(abs(r["dist"] - dist[r["i"]].max()) < 1e-12 for r in far.collect())
        within = {(r["i"], r["near"]) for r in near.pairs(df, df, "i", "v", radius=1.0, apart=True).collect()}
        assert within == {(i, j) for i in range(120) for j in range(120) if 0 < dist[i, j] <= 1.0}


def test_boosted_minorities(spark):
    rows = [(i, 0, [float(i % 20), float(i // 20)]) for i in range(100)] + [(200 + i, 1, [5.0 + 0.3 * i, 2.5]) for i in range(12)]
    df = spark.createDataFrame(rows, "i long, y int, v array<double>")
    for made in (sampling.borderline_points(df, "y", "i", "v", 1), sampling.adasyn(df, "y", "i", "v", 1)):
        points = made.collect()
        assert 80 <= len(points) <= 96 and all(5.0 <= r["v"][0] <= 8.4 and r["v"][1] == 2.5 and r["source"] != r["near"] for r in points)
    assert sampling.borderline_points(df, "y", "i", "v", 1).count() == 88
    assert sampling.adasyn(df, "y", "i", "v", 1, most_share=0.1).count() == 0


def test_choices(spark):
    from tablesmith.operators import choose

    assert choose.parzen([], 0, 1) != choose.parzen([(0.5, 1.0)], 0, 1)
    history: list = []
    for _ in range(60):
        v = choose.parzen(history, -4, 6, seed=3)
        history.append((v, (v - 1.5) ** 2))
    assert min(h[1] for h in history) < 0.01 and sum(h[1] for h in history[-20:]) < sum(h[1] for h in history[:20])
    df = spark.range(400).select("id", (F.col("id") % 20).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b")).withColumn("y", 3 * F.col("a") - 2 * F.col("b") + 1)
    rows, weights, _ = choose.stacked(df, "id", {"first": ["a"], "second": ["b"]}, "y")
    error = lambda c: rows.agg(F.avg(F.pow(F.col(c) - F.col("y"), F.lit(2)))).first()[0]
    assert error("stacked") < 0.1 * min(error("first"), error("second")) and set(weights) == {"first", "second"}


def test_plans(spark):
    from tablesmith.operators import prepare

    df = spark.range(300).select("id", (F.col("id") % 2).cast("string").alias("c"), F.when(F.col("id") % 9 > 0, F.exp(F.col("id") / 40)).alias("skewed"), F.lit(1).alias("one"), F.when(F.col("id") < 5, 1.0).alias("rare"), (F.col("id") * 2.0).alias("y"))
    steps = prepare.compose(prepare.detected(df, ["id", "c", "skewed", "one", "rare"]))
    assert [(s.action, s.method, s.columns) for s in steps] == [
        ("drop", "unusable", ("id", "one", "rare")), ("impute", "median", ("skewed",)), ("encode", "one_hot", ("c",)), ("outliers", "clip", ("skewed",)), ("transform", "yeo_johnson", ("skewed",)), ("scale", "standard", ("skewed",)),
    ]
    out = prepare.applied(df, steps, "y")
    assert {"c_0", "c_1", "skewed", "y"} <= set(out.columns) and out.where("skewed is null").count() == 0
    assert 0 < prepare.complexity(prepare.detected(df, ["c", "skewed"]), steps) <= 1 and prepare.models(prepare.detected(df, ["c"])) == ["boosted", "forest", "linear", "knn"]


def test_isotonic_pools_exactly(spark):
    df = spark.createDataFrame([(0.1, 1), (0.2, 0), (0.3, 0), (0.4, 1)], "p double, y int")
    fitted = values(evaluate.isotonic(df, "y", "p"), "fitted", "p")
    assert fitted == pytest.approx([1 / 3, 1 / 3, 1 / 3, 1.0])


def test_brier_and_reliability(spark):
    good = spark.createDataFrame([(1.0, 1.0), (0.0, 0.0)], "y double, p double")
    assert evaluate.brier(good, "y", "p").first()[0] == 0
    bad = good.select("y", (1 - F.col("p")).alias("p"))
    assert evaluate.brier(bad, "y", "p").first()[0] == 1


def test_smote_guards_lonely_rows(spark):
    rows = [(i, 0, [float(i), 0.0]) for i in range(5)] + [(9, 1, [7.0, 7.0])]
    df = spark.createDataFrame(rows, "i long, y int, v array<double>")
    assert sampling.smote(df, "y", "i", "v").count() == 0


def test_rate_limits(spark):
    df = spark.createDataFrame([(i, 1, t) for i, t in enumerate([0, 1, 2, 11, 12])], "i long, u long, s long").withColumn("ts", F.timestamp_seconds("s"))
    assert values(govern.rate_limit(df, "u", "ts", "i", 2, 10), "accepted") == [True, True, False, True, True]


def test_backpressure(spark):
    df = spark.createDataFrame([(1, i, q) for i, q in enumerate([810, 800, 5000, 0])], "g int, i int, q int")
    assert values(govern.backpressure(df, ["g"], ["i"], "q", 1000), "size") == [500, 600, 300, 360]
    assert math.isclose(len(timeseries.walking(20, 10, 3, 2)), 3)


def test_dbscan_joins_long_chains(spark):
    # Two chains of 150 cores a unit apart, whose keys are shuffled along them.
    rows = [(i * 37 % 300, [float(i + 50 * (i >= 150)), 0.0]) for i in range(300)]
    df = spark.createDataFrame(rows, "i long, v array<double>")
    found = {r["i"]: r["cluster"] for r in learn.dbscan(df, "i", "v", 1.0, 2).collect()}
    names = [min(k for k, _ in part) for part in (rows[:150], rows[150:])]
    assert [found[k] for k, _ in rows] == [names[0]] * 150 + [names[1]] * 150
    with pytest.raises(RuntimeError):
        learn.dbscan(df, "i", "v", 1.0, 2, rounds=1)


def plain_adwin(series, delta=0.002, most=10_000):
    window, out = [], []
    for v in series:
        window = [*window, v][-most:]
        n, best, at, total, left = len(window), 0.0, 0, sum(window), 0.0
        for split in range(1, n if n >= 10 else 0):
            left += window[split - 1]
            gap = abs(left / split - (total - left) / (n - split))
            if gap > math.sqrt(math.log(n / delta) * (1 / split + 1 / (n - split)) / 2) and gap > best:
                best, at = gap, split
        window = window[at:]
        out.append((len(window), at > 0))
    return out


def test_adwin_tries_all_splits_of_long_windows(spark):
    wide = [float(i * 7919 % 10 < 1) for i in range(900)] + [float(i * 7919 % 10 < 3) for i in range(500)]
    edge = [0.0] * 12 + [9.0, 9.0]
    for series in (wide, edge):
        df = spark.createDataFrame([(i, 1, v) for i, v in enumerate(series)], "i int, g int, x double")
        assert [(r["width"], r["drift"]) for r in drift.adwin(df, ["g"], ["i"], "x", "i").orderBy("i").collect()] == plain_adwin(series)
    short = [(float(i % 10 == 0)) for i in range(400)]
    df = spark.createDataFrame([(i, 1, v) for i, v in enumerate(short)], "i int, g int, x double")
    assert [(r["width"], r["drift"]) for r in drift.adwin(df, ["g"], ["i"], "x", "i", most=300).orderBy("i").collect()] == plain_adwin(short, most=300)
    # A small drift after 4000 values that windows of 1000 don't find.
    slow = [float(i * 7919 % 100 < (20 if i < 4000 else 29)) for i in range(8000)]
    df = spark.createDataFrame([(i, 1, v) for i, v in enumerate(slow)], "i int, g int, x double")
    found = drift.adwin(df, ["g"], ["i"], "x", "i")
    assert found.where("drift").count() > 0 and found.agg(F.max("width")).first()[0] > 4000


def test_isolation_trees_grow_on_the_whole_sample(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(600, 2)))] + [(600, 9.0, 9.0), (601, None, 0.0)]
    df = spark.createDataFrame(rows, "i int, a double, b double")
    score = {r["i"]: r["score"] for r in anomaly.isolation_forest(df, "i", ["a", "b"]).collect()}
    assert len(score) == 602 and max((v, k) for k, v in score.items() if k != 601)[1] == 600
    # Normalised by c(256): one tree's scores are those of depths 1 to 8 and what a leaf's rows add.
    c = lambda m: 0.0 if m < 2 else 2 * (math.log(m - 1) + 0.5772156649) - 2 * (m - 1) / m
    one = anomaly.isolation_forest(df, "i", ["a", "b"], trees=1).toPandas()["score"].to_numpy()
    depths = -np.log2(one) * c(256)
    allowed = np.array([d + c(m) for d in range(9) for m in range(257)])
    assert np.abs(depths[:, None] - allowed[None]).min(1).max() < 1e-9 and depths.max() >= 8


def test_smote_evens_all_classes_despite_copies(spark):
    rows = [(i, 0, [float(i), 0.0]) for i in range(40)]
    rows += [(100 + i, 1, [float(i // 8), 1.0]) for i in range(16)] + [(200 + i, 2, [float(i), 2.0]) for i in range(7)] + [(300 + i, 3, [5.0, 5.0]) for i in range(3)]
    df = spark.createDataFrame(rows, "i long, y int, v array<double>")
    made = sampling.smote(df, "y", "i", "v").collect()
    assert sorted((c, sum(r["source"] // 100 == c for r in made)) for c in range(4)) == [(0, 0), (1, 24), (2, 33), (3, 0)]
    at = {i: v for i, _, v in rows}
    assert all(r["source"] // 100 == r["near"] // 100 and at[r["source"]] != at[r["near"]] and min(at[r["source"]][0], at[r["near"]][0]) <= r["v"][0] <= max(at[r["source"]][0], at[r["near"]][0]) for r in made)
    assert len({r["source"] for r in made if r["source"] < 200}) == 16
    assert {r["source"] // 100 for r in sampling.smote(df, "y", "i", "v", minority=2).collect()} == {2}


def test_means_are_exact_in_any_order(spark):
    from tablesmith.functions import sums

    inf, nan = float("inf"), float("nan")
    groups = {0: [0.1, 0.2, 0.3], 1: [0.3, 0.2, 0.1], 2: [1e16, 1.0, -1e16], 3: [None], 4: [inf, 1.0], 5: [inf, -inf], 6: [nan, 2.0], 7: [5e-324, 1e-300, -3.0], 8: [-0.1] * 7 + [1e300, -1e300], 9: [1.7e308, 1.7e308], 10: [0.0, None]}
    df = spark.createDataFrame([(g, v) for g, own in groups.items() for v in own], "g int, x double").repartition(5)
    got = {r.g: r.m for r in sums.means(df, ["g"], "x", "m").collect()}
    want = {g: math.fsum(own) / len(own) for g, own in groups.items() if g in (0, 1, 2, 7, 8)}
    assert {g: got[g] for g in want} == want and got[0] == got[1] and got[3] is None and got[4] == got[9] == inf and math.isnan(got[5]) and math.isnan(got[6]) and got[10] == 0
    assert sums.means(df.where("g = 3"), ["g"], "x", "m").collect()[0].m is None and sums.means(df.where("false"), ["g"], "x", "m").count() == 0


@pytest.mark.parametrize("name", ["median_pruner", "percentile_pruner"])
def test_trials_of_equal_values_are_pruned_alike(spark, tmp_path, name):
    import __spark_entry__ as entry

    rows = [(4 * (3 * t + i), t, v) for t, own in enumerate([(0.1, 0.2, 0.3), (0.3, 0.2, 0.1)] * 6 + [(9.0,), (None,), (None,), (float("nan"),)]) for i, v in enumerate(own)]
    spark.createDataFrame(rows, "event_id long, user_id long, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = {r.trial: (r.step, r.prune) for r in entry.queries()[name](spark, str(tmp_path)).collect()}
    assert got == {t: (0, False) for t in range(12)} | {12: (0, True), 13: (0, None), 14: (0, None), 15: (0, True)}


def test_pruned_counts_nulls(spark):
    scores = spark.createDataFrame([(0, 1, 2.0), (1, 1, None), (2, 1, None), (3, 2, 1.0), (4, 2, float("nan")), (5, 2, None), (6, None, 1.0)], "trial int, step int, score double")
    assert {r.trial: r.prune for r in choose.pruned(scores, 0.5).collect()} == {0: None, 1: None, 2: None, 3: False, 4: False, 5: None}

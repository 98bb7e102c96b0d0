"""Flattening, preparation, features, detectors, registry and streams."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterglass.operators import features, flatten, forests, hbos, lof, metrics, models, prep, quantiles, registry, svm, training
from meterglass.sources import io
from meterglass.streaming import scoring


@pytest.fixture
def messages(spark):
    rng = np.random.default_rng(3)
    rows = [(d * 1000 + i, d, float(rng.normal()), None if i % 9 == 0 else float(i % 5)) for d, n in ((1, 60), (2, 49), (3, 50)) for i in range(n)]
    return spark.createDataFrame(rows, "event_id long, user_id long, value double, k double")


def test_uplink_log_to_clean_table(spark, tmp_path):
    item = {"AppEUI": None, "DevAddr": "26012619", "FCnt": "0005", "CFList": "0011", "PHYPayload": "40AABB", "MIC": "zz", "chan": 1, "lsnr": 5.5, "rsig": [{"chan": 1, "lsnr": 5.5}, {"chan": 2, "lsnr": 1.0}], "codr": "4/5", "datr": "SF7BW125", "freq": 868.1, "rssi": -50, "size": 17, "stat": 1, "tmst": 12}
    lines = [{"rxpk": [item, {**item, "DevAddr": ""}]}, {"rxpk": []}, {"other": 1}]
    (tmp_path / "rxpk_1.log").write_text("\n".join(map(json.dumps, lines)) + "\n{broken")
    rows = flatten.etl(io.read_logs(spark, str(tmp_path), "rxpk"), "rxpk").collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.chan, r.chan2, r.lsnr, r.lsnr2, r.SF, r.BW, r.codr, int(r.FCnt), int(r.MIC), int(r.CFList), int(r.CFListType), r.PHYPayloadLen, r.intrusion) == (1, 2, 5.5, 1.0, 7, 125, 0.8, 5, -1, 0, 17, 6, 0)


def test_downlink_log_to_clean_table(spark, tmp_path):
    (tmp_path / "txpk_1.log").write_text(json.dumps({"DevAddr": "01", "FCtrl": "20", "PHYPayload": "60AA", "txpk": {"codr": "4/5", "datr": "FSK", "powe": 14, "ipol": True, "modu": "LORA", "data": "x"}}))
    r = flatten.etl(io.read_logs(spark, str(tmp_path), "txpk"), "txpk").first()
    assert (r.powe, r.SF, r.codr, int(r.FCtrl)) == (14, -1, 0.8, 32) and "ipol" not in r.asDict() and "data" not in r.asDict()


def test_streamed_message_equals_its_fields(spark):
    text = json.dumps({"rxpk": [{"chan": 3, "codr": "4/5", "data": "QBkmASYABQABqrvM3REiM0Q=", "datr": "SF9BW125", "freq": 868.1}]})
    df = spark.createDataFrame([(text,), ("{bad",), ('{"rxpk":[]}',), ("",)], "message string")
    rows = flatten.clean(flatten.flatten_stream(df)).collect()
    assert len(rows) == 1 and (rows[0].DevAddr, int(rows[0].FCnt), rows[0].SF, rows[0].PHYPayloadLen) == ("26012619", 5, 9, 34)


def test_gate_and_imputation(messages):
    gated = prep.size_gate(messages, "user_id")
    assert {r.user_id for r in gated.select("user_id").distinct().collect()} == {1, 3}
    filled = prep.mean_impute(gated, "user_id", ["value", "k"])
    assert filled.filter("k is null").isEmpty()
    want = messages.filter("user_id = 1").agg(F.avg("k")).first()[0]
    assert filled.filter("event_id = 1000").first().k == pytest.approx(want)
    assert prep.null_census(messages, ["k"]).first().k == messages.filter("k is not null").count()


def test_attacks_conserve_rows_and_use_unseen_values(messages):
    rows = training.prepare(messages, "user_id", "event_id", ["value", "k"])
    train, test = rows.filter("training"), rows.filter("not training")
    pools = {"k": [0.0, 1.0, 77.0], "value": [500.0]}
    out = prep.attack_inject(train, test, "user_id", "event_id", pools)
    assert out.count() == test.count()
    for d in (1, 3):
        n = test.filter(F.col("user_id") == d).count()
        hit = out.filter((F.col("user_id") == d) & (F.col("intrusion") == 1)).collect()
        assert len(hit) == max(1, min(round(0.2 * n), 30))
        assert all(r.k == 77.0 or r.value == 500.0 for r in hit)


def test_scaling_and_reduction(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(200, 2)) @ rng.normal(size=(2, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "i int, v array<double>")
    mean, parts = features.reduction(df, "v", centred=True)
    assert parts.shape == (5, 2) and np.allclose(mean, base.mean(axis=0))
    got = np.array([r.projected for r in features.project(df, "v", mean, parts).orderBy("i").collect()])
    assert np.allclose(got @ parts.T + mean, base)
    same = spark.createDataFrame([(1, 5.0), (1, 5.0)], "d int, x double")
    assert {r.x for r in features.standard_scale(same, "d", ["x"]).collect()} == {0.0}


def test_small_singular_values_survive(spark, monkeypatch):
    monkeypatch.setattr(features, "FAN", 2)
    rng = np.random.default_rng(5)
    q, _ = np.linalg.qr(rng.normal(size=(6, 6)))
    want = np.array([1.0, 1e-2, 1e-4, 1e-7, 1e-10, 1e-12])
    base = np.linalg.qr(rng.normal(size=(300, 6)))[0] * want @ q.T
    df = spark.createDataFrame([(i % 2, v.tolist()) for i, v in enumerate(base)], "d int, v array<double>").repartition(7)
    values, vectors = features.spectrum(features.factor(df, "v", np.zeros(6)), 2.0)
    # the Gramian's least eigenvalue is rounding noise here, 1e-16 of the largest and not 1e-24
    assert np.allclose(np.sqrt(values), want, rtol=1e-3) and np.allclose(np.abs(vectors.T @ q), np.eye(6), atol=1e-3)
    own = {r.d: np.array(r._r).reshape(-1, 6) for r in features.factors(df, "d", "v", 6).collect()}
    for d, r in own.items():
        assert np.allclose(np.linalg.svd(r)[1], np.linalg.svd(base[d::2])[1], rtol=1e-3, atol=1e-15)


def test_hbos_ranks_rare_values_higher_and_ignores_row_order(messages):
    rows = prep.mean_impute(messages, "user_id", ["value", "k"])
    a = hbos.train_and_label(rows, "user_id", "event_id", ["value", "k"])
    b = hbos.train_and_label(rows.orderBy(F.desc("event_id")), "user_id", "event_id", ["k", "value"])
    assert sorted(a.collect()) == sorted(b.select(a.columns).collect())
    model = hbos.fit(rows, "user_id", "event_id", ["value"])
    far = rows.limit(1).withColumn("value", F.lit(1e6))
    top = hbos.score(rows, model, "user_id", "event_id", ["value"]).agg(F.max("score")).first()[0]
    assert hbos.score(far, model, "user_id", "event_id", ["value"]).first().score >= top - 1e-9


def test_constant_feature_has_one_bin_of_mass(spark):
    df = spark.createDataFrame([(1, i, 4.0) for i in range(50)], "d int, i int, x double")
    row = hbos.fit(df, "d", "i", ["x"]).first()
    assert sum(v > 0 for v in row.density) == 1 and row.lo == 3.5 and row.hi == 4.5


@pytest.mark.parametrize("algorithm", ["if_sklearn", "if_custom", "ocsvm", "hbos", "lof"])
def test_detectors_find_a_far_point(spark, algorithm):
    rng = np.random.default_rng(5)
    rows = [(1, i, float(x), float(y), True) for i, (x, y) in enumerate(rng.normal(size=(120, 2)))] + [(1, 999, 40.0, 40.0, False), (1, 1000, 0.1, 0.2, False)]
    df = spark.createDataFrame(rows, "d int, i int, x double, y double, training boolean")
    train, test = df.filter("training"), df.filter("not training")
    found = models.score(test, models.fit(train, algorithm, "d", "i", ["x", "y"]), algorithm, "d", "i", ["x", "y"])
    by = {r.i: r.prediction for r in found.filter("i >= 999").collect()}
    assert by[999] == 1
    if algorithm != "ocsvm":  # nu = 1/3 calls a third of all training rows outliers, some of them in the middle
        assert by[1000] == 0


def test_metrics_with_zero_division(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "l int, p int")
    report = {r["class"]: r for r in metrics.class_report(metrics.confusion(df, "l", "p")).collect()}
    assert report["1"].precision == 0.0 and report["0"].f1 == 1.0 and report["macro"].recall == 0.5


def test_registry_keeps_versions_and_loads_the_latest(spark, tmp_path):
    r = registry.Registry(spark, str(tmp_path / "models"))
    assert r.load().isEmpty()
    frame = lambda p: spark.createDataFrame([("d1", "rxpk", "hbos", p)], "device string, msg_type string, algorithm string, params string")
    r.store(frame("old"), 1)
    r.store(frame("new"), 2)
    r.store(frame("new"), 2)
    assert r.latest("rxpk", "hbos", 1).first().params == "old" and r.latest("txpk", "hbos").isEmpty()
    assert r.all().count() == 2 and r.find("d1", "rxpk", "hbos").first().params == "new"


def test_stream_scoring_equals_batch_and_repeats_are_harmless(spark, messages, tmp_path):
    rows = messages.select("event_id", "user_id", "value").persist()
    scorer = scoring.Scorer(spark, str(tmp_path / "s"), "user_id", "event_id", ["value"], 50)
    scorer.seed(rows)
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    scoring.run_available(stream, scorer.batch, str(tmp_path / "c"))
    first = sorted(map(tuple, scorer.scored().select("event_id", "score", "prediction").collect()))
    scorer.batch(rows, 0)
    again = sorted(map(tuple, scorer.scored().select("event_id", "score", "prediction").collect()))
    want = {r.event_id: r.prediction for r in hbos.train_and_label(prep.size_gate(rows, "user_id"), "user_id", "event_id", ["value"]).collect()}
    assert first == again and {e: p for e, _, p in first if p is not None} == want


def test_stream_models_are_fitted_on_the_whole_history(spark, tmp_path):
    # the rows of a hot device with the least keys differ from all others
    rows = spark.range(101_000).selectExpr("'d' as user_id", "id as event_id", "cast(if(id < 900, 1000 + id, id % 97) as double) as value").persist()
    scorer = scoring.Scorer(spark, str(tmp_path / "s"), "user_id", "event_id", ["value"], 50)
    scorer.seed(rows)
    scorer.batch(rows.filter("event_id % 100 = 0"), 0)
    want = hbos.train_and_label(rows, "user_id", "event_id", ["value"]).filter("event_id % 100 = 0")
    pick = lambda df: sorted(map(tuple, df.select("event_id", "score", "prediction").collect()))
    assert pick(scorer.scored()) == pick(want)


def test_retention_is_by_time_and_counts_the_whole_history(spark, tmp_path):
    with pytest.raises(ValueError, match="time"):
        scoring.Scorer(spark, str(tmp_path / "n"), "user_id", "event_id", ["value"], 50, keep=10)
    rows = spark.range(100).selectExpr("'d' as user_id", "id as event_id", "cast(id % 7 as double) as value", "-id as at")
    scorer = scoring.Scorer(spark, str(tmp_path / "s"), "user_id", "event_id", ["value"], 50, keep=20, time="at")
    scorer.seed(rows)
    scorer.batch(rows, 0)
    train = rows.filter("event_id < 20")
    model = hbos.fit(train, "user_id", "event_id", ["value"])
    want = {r.event_id: r.score for r in hbos.score(rows, model, "user_id", "event_id", ["value"]).collect()}
    assert {r.event_id: r.score for r in scorer.scored().collect()} == want


def test_pools_are_the_same_for_a_seed():
    a = prep.attack_pools(1)
    assert a == prep.attack_pools(1) != prep.attack_pools(2) and len(a) == 15
    assert all(-130 <= v <= -20 for v in a["rssi"]) and a["SF"] == [7, 8, 9, 10, 11, 12]


def test_attacks_leave_out_what_a_device_never_has(spark):
    rows = [(d, i, float(i % 3), float(i) if d == 1 else None, i < 40) for d in (1, 2) for i in range(60)]
    df = spark.createDataFrame(rows, "d int, i int, x double, y double, training boolean")
    out = prep.attack_inject(df.filter("training"), df.filter("not training"), "d", "i", {"x": [0.0, 9.0], "y": [500.0]}).collect()
    hit = [r for r in out if r.intrusion]
    assert len(out) == 40 and [(r.d, r.i, r.x, r.y) for r in sorted(hit)] == [(1, 40, 9.0, 40.0), (1, 41, 2.0, 500.0), (1, 42, 9.0, 42.0), (1, 43, 1.0, 500.0), (2, 40, 9.0, None), (2, 41, 9.0, None), (2, 42, 9.0, None), (2, 43, 9.0, None)]
    # all pools used up: the whole pools stand; a counter is set back to its least value
    used = prep.attack_inject(df.filter("training"), df.filter("not training"), "d", "i", {"x": [0.0, 1.0]}).filter("intrusion = 1 and d = 2").orderBy("i").collect()
    assert [r.x for r in used] == [0.0, 1.0, 0.0, 1.0]
    back = prep.attack_inject(df.filter("training"), df.filter("not training"), "d", "i", {}, ("y",)).filter("intrusion = 1").collect()
    assert [(r.d, r.y) for r in back] == [(1, 0.0)] * 4


def test_used_up_pools_are_refilled_with_unseen_values(spark):
    rows = [(d, i, float(i % 2), float(200 + i) if d == 1 else None, i < 60) for d in (1, 2) for i in range(90)]
    df = spark.createDataFrame(rows, "d int, i int, codr double, size double, training boolean")
    train, test = df.filter("training"), df.filter("not training")
    hit = prep.attack_inject(train, test, "d", "i", {"codr": [0.0, 1.0], "size": [200.0, 210.0]}).filter("intrusion = 1").collect()
    new = [r.size for r in hit if r.d == 1]
    assert len(new) == 6 and all(260 <= v <= 10000 for v in new) and len(set(new)) == 6 and all(r.codr == float(r.i % 2) for r in hit if r.d == 1)
    # nothing to refill: the whole pool stands
    assert [r.codr for r in sorted(hit) if r.d == 2] == [0.0, 1.0] * 3


@pytest.mark.parametrize("reduction", [None, "PCA", "SVD"])
def test_transforms_by_device_equal_numpy(spark, reduction):
    rng = np.random.default_rng(6)
    data = {d: rng.normal(size=(80, 4)) @ rng.normal(size=(4, 4)) + d for d in (1, 2)}
    data[2][:, 3] = np.nan  # a column that the device never has
    data[1][:, 1] = 7.0  # one that never changes
    rows = [(d, i, *(None if np.isnan(v) else float(v) for v in x)) for d, m in data.items() for i, x in enumerate(m)]
    df = spark.createDataFrame(rows, "d int, i int, a double, b double, c double, e double")
    fitted = features.fit_transforms(df, "d", ["e", "c", "b", "a"], True, reduction)
    out, names = features.apply_transforms(df, fitted, "d", ["a", "b", "c", "e"])
    assert names == ["z00", "z01", "z02", "z03"] and {r.d: r.features for r in fitted.collect()} == {1: ["a", "b", "c", "e"], 2: ["a", "b", "c"]}
    for d, m in data.items():
        x = m[:, :3] if d == 2 else m
        sd = x.std(axis=0, ddof=1)
        want = np.divide(x - x.mean(axis=0), sd, out=np.zeros(x.shape), where=sd > 1e-9)
        if reduction:
            values, vectors = np.linalg.eigh(want.T @ want)
            values, vectors = values[::-1], vectors[:, ::-1]
            k = int(np.flatnonzero(np.cumsum(values) >= 0.99 * values.sum())[0]) + 1
            sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])
            want = want @ (vectors * sign)[:, :k]
        got = np.array([[v for v in r[2:] if v is not None] for r in out.filter(f"d = {d}").orderBy("i").collect()])
        assert np.allclose(got, want)


def brute_lof(train, rows, keys, k):
    """LOF of rows (each with whether it is training row i, else -1) by whole matrices."""

    def near(x, own):
        d = np.round(np.sqrt(((train - x) ** 2).sum(axis=1)), 9)
        if own >= 0:
            d[own] = np.inf
        order = np.lexsort((keys, d))[:k]
        return order, d[order]

    own = [near(x, i) for i, x in enumerate(train)]
    kd = np.array([d[-1] for _, d in own])
    lrd = np.array([1 / (np.maximum(d, kd[o]).mean() + 1e-10) for o, d in own])
    found = [near(x, -1) for x in rows]
    return [round(lrd[o].mean() * (np.maximum(d, kd[o]).mean() + 1e-10), 6) for o, d in found]


@pytest.mark.parametrize("sizes", [{}, {"cell_rows": 16, "block_train": 8, "block_rows": 20}])
def test_lof_by_cells_equals_whole_matrices(spark, sizes):
    rng = np.random.default_rng(9)
    rows = [(d, i, float(x), float(y), i % 4 > 0) for d, n in ((1, 240), (2, 40)) for i, (x, y) in enumerate(np.round(rng.normal(size=(n, 2)), 1))]
    rows += [(1, 1000 + i, 0.5, 0.5, i % 4 > 0) for i in range(120)]  # a third of all are copies
    df = spark.createDataFrame(rows, "d int, i int, x double, y double, training boolean")
    train, test = df.filter("training"), df.filter("not training")
    got = {(r.d, r.i): r.lof for r in lof.lof(train, test, "d", "i", ["x", "y"], **sizes).collect()}
    for d in (1, 2):
        known = [r for r in rows if r[0] == d and r[4]]
        asked = [r for r in rows if r[0] == d and not r[4]]
        x = np.array([r[2:4] for r in known])
        want = brute_lof(x, np.array([r[2:4] for r in asked]), np.array([r[1] for r in known]), max(5, min(round(0.01 * len(known)), 15)))
        assert [got[d, r[1]] for r in asked] == pytest.approx(want, abs=2e-6)
    if not sizes:
        stored = models.score(test, models.fit(train, "lof", "d", "i", ["x", "y"]), "lof", "d", "i", ["x", "y"])
        assert {(r.d, r.i): r.score for r in stored.collect()} == pytest.approx(got, abs=2e-6)
        # keys that are no numbers: distances decide alone, so scores agree where no ties are left out
        text = lambda x: x.withColumn("i", F.concat(F.lit("k"), F.format_string("%05d", "i")))
        named = models.score(text(test), models.fit(text(train), "lof", "d", "i", ["x", "y"]), "lof", "d", "i", ["x", "y"]).collect()
        assert len(named) == len(got) and all(r.score is not None for r in named)


def test_cells_are_few_that_a_row_is_compared_with(spark):
    from meterglass.operators.knn import Search

    n = 60_000
    rows = spark.range(n).selectExpr("1 as d", "id as i", "array(rand(3) * 100, rand(4) * 100) as v").persist()
    k = spark.createDataFrame([(1, 15)], "d int, _k int")
    seen = Search(rows, "d", "i").census(rows.withColumn("own", F.lit(True)), k).first()
    assert seen.rows == n and seen.cells > 40 and seen.compared < seen.cells / 4


def test_small_devices_are_compared_many_a_task(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(d, i, float(x), float(y), i % 4 > 0) for d in range(30) for i, (x, y) in enumerate(np.round(rng.normal(size=(36, 2)), 1))]
    df = spark.createDataFrame(rows, "d int, i int, x double, y double, training boolean")
    monkeypatch.setattr(lof, "Search", None)  # a group for each device
    got = {(r.d, r.i): r.lof for r in lof.lof(df.filter("training"), df.filter("not training"), "d", "i", ["x", "y"]).collect()}
    for d in range(30):
        known, asked = ([r for r in rows if r[0] == d and r[4] == t] for t in (True, False))
        want = brute_lof(np.array([r[2:4] for r in known]), np.array([r[2:4] for r in asked]), np.array([r[1] for r in known]), 5)
        assert [got[d, r[1]] for r in asked] == pytest.approx(want, abs=2e-6)


def test_devices_of_more_rows_than_two_cells_hold_have_several(spark):
    from meterglass.operators.knn import Search

    rows = spark.range(200 * 53).selectExpr("cast(id % 200 as int) as d", "id as i", "array(rand(3) * 100, rand(4) * 100) as v").persist()
    cells = Search(rows, "d", "i", cell_rows=16).cells.groupBy("d").agg(F.count("*").alias("n"))
    assert cells.count() == 200 and cells.filter("n < 2").isEmpty()


@pytest.mark.parametrize("algorithm", models.ALGORITHMS)
def test_all_null_and_partly_null_features_lose_no_device(spark, algorithm):
    rng = np.random.default_rng(4)
    rows = [(d, i, float(rng.normal()), None if d == 1 or i % 7 == 0 else float(rng.normal()), None) for d in (1, 2) for i in range(70)]
    df = spark.createDataFrame(rows, "d int, i int, x double, y double, z double")
    found = training.evaluate(df, algorithm, "d", "i", ["x", "y", "z"], {"x": [50.0], "y": [70.0]})
    by = {r.d: r for r in training.by_device(found, "d").collect()}
    assert {d: sum(r[1:]) for d, r in by.items()} == {r.d: r.n for r in training.prepare(df, "d", "i", ["x"]).filter("not training").groupBy("d").agg(F.count("*").alias("n")).collect()}
    assert found.filter("prediction is null").isEmpty() and all(r.tp for r in by.values())


def test_forests_are_the_same_whatever_the_partitions(spark):
    rng = np.random.default_rng(2)
    rows = [(d, i, float(a), float(b)) for d, n in ((1, 700), (2, 60)) for i, (a, b) in enumerate(rng.normal(size=(n, 2)))]
    df = spark.createDataFrame(rows, "d int, i int, x double, y double")
    for algorithm in ("if_sklearn", "if_custom"):
        score = lambda x, a=algorithm: sorted(map(tuple, models.score(x, models.fit(x, a, "d", "i", ["x", "y"]), a, "d", "i", ["x", "y"]).collect()))
        assert score(df) == score(df.repartition(7, "x"))
    fitted = models.fit(df, "if_custom", "d", "i", ["x", "y"])
    nodes = models.nodes(fitted, "d")
    trees = {r.d: (r.n, r.t) for r in nodes.groupBy("d").agg(F.count("tree").alias("n"), F.count("feature").alias("t")).collect()}
    assert trees[1][0] == 100 + 700 // 3 and trees[2][0] == 120 and nodes.filter("feature is null").count() == sum(a + b for a, b in trees.values())


@pytest.mark.parametrize("algorithm", ["if_sklearn", "if_custom"])
def test_trees_score_where_they_are_grown_as_stored_ones_do(spark, monkeypatch, algorithm):
    rng = np.random.default_rng(2)
    rows = [(d, i, float(a), float(b) if d < 3 else None, i % 3 > 0) for d, n in ((1, 900), (2, 60), (3, 70)) for i, (a, b) in enumerate(rng.normal(size=(n, 2)))]
    rows.append((2, 99, 1.0, None, False))
    df = spark.createDataFrame(rows, "d int, i int, x double, y double, training boolean")
    train, test = df.filter("training"), df.filter("not training")
    want = sorted(map(tuple, models.score(df, models.fit(train, algorithm, "d", "i", ["x", "y"]), algorithm, "d", "i", ["x", "y"]).collect()), key=str)
    held, seen = forests.fit, []
    monkeypatch.setattr(forests, "fit", lambda *a, **k: seen.append(a) or held(*a, **k))
    got = models.learned_scores(train, test, algorithm, "d", "i", ["x", "y"], True)
    assert sorted(map(tuple, got.collect()), key=str) == want
    tested = {(r.d, r.i) for r in test.collect()}
    assert sorted(map(tuple, models.learned_scores(train, test, algorithm, "d", "i", ["x", "y"]).collect()), key=str) == [r for r in want if r[:2] in tested]
    assert not seen  # no nodes were written or shuffled
    # blocks, and parts of a few trees
    vector = lambda x, learned: x.filter("y is not null").select("d", "i", F.array("x", "y").alias("v"), F.lit(learned).alias("learned"))
    sums = lambda **sizes: {(r.d, r.i): r["_value"] for r in forests.grown_sums(vector(train, True), vector(test, False), algorithm, "d", "i", **sizes).collect()}
    small = sums(block_rows=8, nodes=20_000)
    assert small == pytest.approx(sums(nodes=20_000)) and len(small) == len([t for t in tested if t[0] < 3]) - 1


@pytest.mark.parametrize(("algorithm", "sizes"), [("if_custom", {"nodes": 4000}), ("if_sklearn", {"nodes": 2048, "pool": 280})])
def test_rows_are_dealt_to_forests_once_a_share_and_not_once_a_part(spark, monkeypatch, algorithm, sizes):
    rng = np.random.default_rng(8)
    rows = [(d, i, rng.normal(size=2).tolist(), i % 2 > 0) for d in range(6) for i in range(600)]
    df = spark.createDataFrame(rows, "d int, i int, v array<double>, learned boolean").persist()
    train, asked = df.filter("learned").drop("learned"), df.filter("not learned")
    held, dealt = forests.bundled, []
    monkeypatch.setattr(forests, "bundled", lambda some, *a: dealt.append(some.count()) or held(some, *a))
    got = {(r.d, r.i): r["_value"] for r in forests.grown_sums(train, asked, algorithm, "d", "i", **sizes).collect()}
    # 15 parts a device or more: 3,600 rows, in two shares at most
    assert dealt[0] <= 2 * 3600
    # the sums of stored parts
    fitted = forests.fit(train, algorithm, "d", "i", **sizes).collect()
    assert len(fitted) > 6 * 15 and len(got) == 1800
    x = {d: [(i, v) for e, i, v, own in rows if e == d and not own] for d in range(3)}
    for d in x:
        parts = [{k: np.array(v) for k, v in r.arrays.items()} for r in fitted if r.d == d]
        want = sum(forests.depths(p, np.array([v for _, v in x[d]])) for p in parts)
        assert [got[d, i] for i, _ in x[d]] == pytest.approx(want.tolist())


def test_imputed_means_do_not_depend_on_how_rows_are_shuffled(spark):
    x = np.round(np.random.default_rng(5).uniform(0, 90, size=(2, 71)), 2)
    rows = [(d, i, float(x[d, i]) if i < 71 else None) for d in (0, 1) for i in range(74)]
    df = spark.createDataFrame(rows, "d int, i int, x double")
    want = {d: float(np.cumsum(x[d])[-1]) / 71 for d in (0, 1)}  # summed by key
    for some in (df, df.repartition(7, "x"), df.orderBy(F.desc("x"))):
        got = training.prepare(some, "d", "i", ["x"]).filter("i > 70").collect()
        assert len(got) == 6 and all(r.x == want[r.d] for r in got)
    larger = prep.mean_impute(df, "d", ["x"], "i", ordered=20).filter("i > 70").collect()
    assert len(larger) == 6 and all(r.x == pytest.approx(want[r.d]) for r in larger)


def test_a_mean_that_is_one_of_the_values_is_that_value(spark):
    rng, rows = np.random.default_rng(6), []
    for d in range(40):
        cents = rng.integers(0, 3000, 60).tolist()
        cents += [4135, 61 * 4135 - sum(cents)]  # the mean of 62 values is one of them
        rows += [(d, i, c / 100) for i, c in enumerate(cents)] + [(d, 62, None)]
    rows += [(40, i, x) for i, x in enumerate([1e30, 1.0, 1 / 3, None])] + [(41, i, x) for i, x in enumerate([0.1, 0.25, float("nan")])] + [(42, 0, None)]
    df = spark.createDataFrame(rows, "d int, i int, x double")
    assert sum(np.cumsum([x for e, _, x in rows if e == d and x is not None])[-1] / 62 != 41.35 for d in range(40)) > 10
    for some in (df, df.repartition(7, "x")):
        got = {r.d: r.x for r in prep.mean_impute(some, "d", ["x"], "i").orderBy("i").collect()}  # of the last row of each
        assert [got[d] for d in range(40)] == [41.35] * 40
        assert got[40] == pytest.approx(1e30 / 3) and got[41] == 0.175 and got[42] is None


def test_a_mean_that_is_a_tie_of_its_rounding_is_rounded_as_one(spark):
    cents = np.random.default_rng(7).integers(0, 30000, (40, 64))
    cents[:, 0] += (2 - cents.sum(axis=1)) % 4  # means of 64 values whose seventh and last decimal is a 5
    df = spark.createDataFrame([(d, c / 100) for d in range(40) for c in cents[d].tolist()], "d int, x double")
    want = [(15625 * int(c.sum()) + 50) // 100 / 1e6 for c in cents]
    for some in (df, df.repartition(7, "x"), df.orderBy(F.desc("x"))):
        got = features.fit_transforms(some, "d", ["x"], scale=True).select("d", F.round(F.get("shift", F.lit(0)), 6).alias("m")).orderBy("d").collect()
        assert [r.m for r in got] == want


def test_scaling_does_not_depend_on_how_rows_are_shuffled(spark):
    x = np.random.default_rng(9).uniform(0, 300, (8, 67))
    df = spark.createDataFrame([(d, i, float(v)) for d in range(8) for i, v in enumerate(x[d])], "d int, i int, x double")
    got = [sorted((r.d, *r["shift"], *r.factor) for r in training.fit(some, "hbos", "d", "i", ["x"], scale=True).collect()) for some in (df, df.repartition(7, "x"), df.orderBy(F.desc("x")))]
    assert len(got[0]) == 8 and got[0] == got[1] == got[2]
    assert [m for _, m, _ in got[0]] == [float(np.cumsum(x[d])[-1]) / 67 for d in range(8)]  # summed by key
    blocks = prep.in_order(df, "d", ["i"], ordered=20)
    assert sorted(map(tuple, blocks.collect())) == sorted(map(tuple, df.collect()))


def test_a_cut_that_is_rounded_to_the_least_value_leaves_its_left_side_empty():
    a = 41.35
    x, trees = np.array([[np.nextafter(a, 0)], [a]]), np.arange(200)
    lots = forests.unit(forests.SEED, trees, 1, 0)
    for t in trees:
        made = forests.fit_part(x, np.arange(2), trees[t : t + 1], 2)
        cut = x[0, 0] + (a - x[0, 0]) * lots[t]
        assert made["cut"][0] == cut and forests.depths(made, x).tolist() == ([2, 2] if cut == x[0, 0] else [1, 1])
        assert forests.depths(made, np.array([[0.0]])).tolist() == [1]
    assert 0 < sum(x[0, 0] + (a - x[0, 0]) * lots == x[0, 0]) < 200


def test_a_part_draws_from_its_share_of_a_large_device(spark):
    rows = spark.range(6000).selectExpr("1 as d", "id as i", "array(rand(3), rand(4)) as v").persist()
    seen = forests.fit(rows, "if_sklearn", "d", "i", pool=600, nodes=51200)
    parts = seen.select("part", "trees", "sample", F.size(F.element_at("arrays", "roots")).alias("n")).orderBy("part").collect()
    assert [r.part for r in parts] == list(range(13)) and sum(r.n for r in parts) == parts[0].trees == 1300 and parts[0].sample == 256
    x = np.random.default_rng(2).normal(size=(300, 3))
    made = forests.fit_part(x, np.arange(300), np.arange(60), 64)
    depth = forests.depths(made, np.vstack([x, [[30, 30, 30]]]))
    leaf = made["feature"] < 0
    assert depth.argmin() == 300 and made["cut"].size == 60 + 2 * (~leaf).sum() and (made["left"][~leaf] > 0).all()


def kkt(rows, alpha, nu=1 / 3):
    """The largest violation of the optimality conditions of the one-class dual, in numpy."""
    gamma = 1 / (rows.shape[1] * rows.var())
    g = np.exp(-gamma * ((rows[:, None] - rows[None]) ** 2).sum(axis=2)) @ alpha
    most = 1 / (nu * len(rows))
    assert alpha.min() >= 0 and alpha.max() <= most * (1 + 1e-9) and alpha.sum() == pytest.approx(1)
    return (g[alpha > most * 1e-9].max() - g[alpha < most * (1 - 1e-9)].min()) * nu * len(rows)


def test_svm_across_tasks_is_optimal(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(size=(500, 2)), rng.normal(size=(60, 2)) + 6])
    df = spark.createDataFrame([(1, i, v.tolist()) for i, v in enumerate(x)], "d int, i int, v array<double>")
    whole, parts = (svm.solution(df, "d", "i", **named)[0].orderBy("i").collect() for named in ({}, {"chunk": 120, "working": 80}))
    assert kkt(x, np.array([r.a for r in whole])) < 1e-9 and kkt(x, np.array([r.a for r in parts])) < 2e-7
    assert np.allclose([r.g for r in whole], [r.g for r in parts], atol=1e-8)
    model = svm.fit(df, "d", "i").first()
    f = np.array([r.g for r in whole]) - model.rho
    assert model.gap < 1e-9 and abs((f < -1e-9).mean() - 1 / 3) < 0.05


def test_quantiles_equal_sorting(spark):
    rng = np.random.default_rng(3)
    groups = {1: rng.normal(size=900), 2: np.full(500, 7.0), 3: np.concatenate([rng.random(400), [1e300, -1e9]]), 4: np.repeat([1.0, 2.0, 5.0], [300, 1, 300]), 5: np.array([4.0]), 6: np.exp(rng.normal(size=500) * 9)}
    df = spark.createDataFrame([(g, float(v)) for g, x in groups.items() for v in x] + [(1, None), (7, None), (2, float("nan"))], "g int, x double")
    for share in (0.0, 2 / 3, 0.5, 0.82, 1.0):
        for held in (10, 20_000):
            got = {r.g: r.value for r in quantiles.quantile(df, "g", "x", share, bins=8, held=held).collect()}
            assert got == pytest.approx({g: float(np.quantile(x, share)) for g, x in groups.items()})


def test_two_writers_of_one_store_lose_nothing(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    known = registry.Registry(spark, str(tmp_path / "r"))
    frame = lambda n: spark.createDataFrame([(f"d{n}", "rxpk", "hbos", str(n)), ("all", "rxpk", "hbos", str(n))], "device string, msg_type string, algorithm string, params string")
    with ThreadPoolExecutor(4) as pool:
        versions = list(pool.map(lambda n: known.next(frame(n), "rxpk-hbos"), range(8)))
    assert sorted(versions) == list(range(8)) and known.all().count() == 16 and known.load().count() == 9
    assert known.find("all", "rxpk", "hbos").first().params == str(versions.index(7))
    assert not known.store(frame(9), 8, "rxpk-hbos", expected=3) and known.all().count() == 16


def test_an_interrupted_compaction_changes_nothing(spark, tmp_path, monkeypatch):
    from meterglass.sources.store import Store

    held = Store(spark, str(tmp_path / "s"), "d string, x int", by="d")
    for n in range(5):
        held.write(spark.range(40).selectExpr(f"cast(id % 5 as string) as d", f"cast(id + {100 * n} as int) as x"), f"batch/{n}", n)
    held.write(spark.createDataFrame([("7", 1)], "d string, x int"), "batch/4", 4)  # a batch that runs again
    rows = lambda **named: sorted(map(tuple, held.read(**named).collect()))
    before = rows()
    assert len(before) == 161
    monkeypatch.setattr(Store, "_put", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        held.compact(4)
    monkeypatch.undo()
    assert rows() == before and held.vacuum(1) == 2
    assert held.compact(4) and rows() == before and [e["v"] for e in held.entries()] == [3, 4]
    own = {r.b for r in spark.sql("select pmod(xxhash64('3'), 64) as b").collect()}
    assert {r for r in rows(buckets=own) if r[0] == "3"} == {r for r in before if r[0] == "3"} and len(rows(buckets=own)) < 120
    held.vacuum(1)
    assert rows() == before and not held.compact(4)


def test_histories_of_a_batch_s_devices_alone_are_read_and_compacted(spark, tmp_path):
    scorer = scoring.Scorer(spark, str(tmp_path / "s"), "user_id", "event_id", ["value"], 50, compact=3)
    rows = spark.range(600).selectExpr("id % 4 as user_id", "id as event_id", "cast(id * 7919 % 101 as double) as value")
    scorer.seed(rows)
    for n in range(4):
        scorer.batch(rows.filter(f"user_id = {n % 2} and event_id < 40").unionByName(rows.filter("event_id = 0")), n)
    versions = {(r.device, r.version) for r in scorer.registry.load().select("device", "version").distinct().collect()}
    assert versions == {("0", 4), ("1", 4), ("2", 0), ("3", 0)}  # the others keep their first models; device 0 is in each batch
    assert len(scorer.past.entries()) == 3 and scorer.scored().count() == 44 and scorer.history(99).count() <= 644
    # the message that comes twice in a batch is scored twice
    assert scorer.spark.read.parquet(f"{scorer.folder}/scored/batch=0").filter("event_id = 0").count() == 2


@pytest.mark.parametrize("algorithm", ["if_custom", "ocsvm", "lof"])
def test_streams_are_scored_by_all_models(spark, messages, tmp_path, algorithm):
    scorer = scoring.Scorer(spark, str(tmp_path / "s"), "user_id", "event_id", ["value", "k"], 50, "batch", algorithm=algorithm, scale=True, reduction="SVD")
    scorer.seed(messages)
    late = messages.filter("event_id % 10 < 3").withColumn("event_id", F.col("event_id") + 100).withColumn("value", F.when(F.col("event_id") % 10 == 0, 1e6).otherwise(F.col("value")))
    scorer.batch(late, 0)
    scorer.batch(late.limit(0), 1)
    rows = scorer.scored().collect()
    assert len(rows) == late.count() and all((r.score is None) == (r.user_id == 2) for r in rows)
    assert all(r.prediction == 1 for r in rows if r.event_id % 10 == 0 and r.user_id != 2)
    # no device has enough normal rows in the batch: the seeded models stay
    assert scorer.models(1, "int").select("user_id").distinct().count() == 2 and scorer.registry.all().filter("version = 1").isEmpty()


def test_commands_from_log_to_scored_stream(spark, tmp_path):
    from meterglass import cli

    rng = np.random.default_rng(7)
    (tmp_path / "logs").mkdir()
    item = lambda i, d: {"DevAddr": d, "FCnt": f"{i:04X}", "MIC": f"{i * 7919 % 65536:08X}", "MHDR": "40", "FPort": "01", "PHYPayload": "40" * 17, "chan": int(rng.integers(0, 3)), "lsnr": float(rng.normal()), "codr": "4/5", "datr": f"SF{rng.integers(7, 9)}BW125", "freq": 868.1, "rssi": int(rng.integers(-90, -60)), "size": 17, "tmst": i}
    lines = [{"rxpk": [item(i, "26012619"), item(i, "26012620")]} for i in range(70)]
    (tmp_path / "logs" / "rxpk_1.log").write_text("\n".join(map(json.dumps, lines)))
    (tmp_path / "logs" / "txpk_1.log").write_text("\n".join(json.dumps({"DevAddr": "01", "PHYPayload": "60AA", "txpk": {"codr": "4/5", "datr": "FSK", "powe": 14 + i % 3}}) for i in range(60)))
    args = lambda *a: cli.parser().parse_args([*a, "--logs", str(tmp_path / "logs"), "--out", str(tmp_path / "out")])
    for algorithm in ("hbos", "if_sklearn"):
        report = cli.train(spark, args("train", "--ml_algorithm", algorithm, "--scaling", "true", "--with_feature_reduction", "PCA"), "rxpk").collect()
        assert {r["class"] for r in report} == {"0", "1", "macro", "weighted"}
    assert len(cli.train(spark, args("train"), "txpk").collect()) == 4
    known = registry.Registry(spark, str(tmp_path / "out" / "models"))
    assert known.metrics().select(F.sum(F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))).first()[0] > 20
    assert {(r.device, r.msg_type, r.algorithm) for r in known.load().collect()} == {("26012619", "rxpk", "if_sklearn"), ("26012620", "rxpk", "if_sklearn"), ("01", "txpk", "hbos")} | {("26012619", "rxpk", "hbos"), ("26012620", "rxpk", "hbos")}
    (tmp_path / "in").mkdir()
    frame = '{"rxpk":[{"chan":1,"codr":"4/5","data":"QBkmASYABQABqrvM3REiM0Q=","datr":"SF9BW125","freq":868.1,"lsnr":99.0,"rssi":-10,"size":17,"tmst":5}]}'
    (tmp_path / "in" / "1.txt").write_text("head" + frame + '\nhead{"stat":{}}\n')
    scorer = cli.stream(spark, args("stream", "--messages", str(tmp_path / "in"), "--ml_algorithm", "if_sklearn", "--available_now", "--least_rows", "50", "--scaling", "true"))
    (row,) = scorer.scored().collect()
    assert row.DevAddr == "26012619" and row.score is not None


def test_datagrams_of_a_new_start_keep_the_earlier_ones(tmp_path):
    import socket
    import threading
    import time

    for n in (1, 2):
        with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as free:
            free.bind(("127.0.0.1", 0))
            port = free.getsockname()[1]
        t = threading.Thread(target=io.forward_datagrams, args=(port, str(tmp_path), 2))
        t.start()
        with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
            for _ in range(200):
                s.sendto(b"", ("127.0.0.1", port))
                s.sendto(f"message {n}".encode(), ("127.0.0.1", port))
                time.sleep(0.02)
                if not t.is_alive():
                    break
        t.join()
        assert len(list(tmp_path.glob("*.txt"))) == 2 * n


def test_datagrams_are_read_again_after_a_batch_that_failed(spark, tmp_path):
    import socket
    import threading
    import time

    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as free:
        free.bind(("127.0.0.1", 0))
        port = free.getsockname()[1]
    message = lambda n: json.dumps({"rxpk": [{"chan": n, "data": "QBkmASYABQABqrvM3REiM0Q=", "datr": "SF9BW125", "tmst": n}]})
    ended = threading.Event()

    def send():
        with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
            n = 0
            while not ended.is_set():
                s.sendto(b"\x02head" + message(n).encode(), ("127.0.0.1", port))
                n += 1
                time.sleep(0.01)

    seen, failed = {}, []

    def each(df, number):
        rows = [r.tmst for r in df.collect()]
        if rows and not failed:
            failed.append((number, rows))
            raise RuntimeError("killed between fetch and commit")
        if rows:
            seen[number] = rows

    def run(until):
        stream = flatten.clean(flatten.flatten_stream(io.datagram_messages(spark, port, str(tmp_path / "spool"), "127.0.0.1")))
        query = stream.select("tmst", "DevAddr").writeStream.foreachBatch(each).option("checkpointLocation", str(tmp_path / "c")).start()
        began = time.time()
        while time.time() - began < 90 and not until(query):
            time.sleep(0.2)
        query.stop()

    sender = threading.Thread(target=send)
    sender.start()
    try:
        run(lambda q: not q.isActive)
        run(lambda q: len(seen) >= 3)
    finally:
        ended.set()
        sender.join()
    (number, rows), batches = failed[0], [seen[n] for n in sorted(seen)]
    assert seen[number] == rows  # the uncommitted batch, row by row
    every = [t for b in batches for t in b]
    assert len(every) == len(set(every)) and every == sorted(every) and len(batches) >= 3


def test_scratch_paths_belong_to_those_who_made_them(spark):
    from concurrent.futures import ThreadPoolExecutor

    from meterglass.runtime import holding, keep_only, settled

    with holding() as own:
        first = settled(spark.range(5), "mine")
        with ThreadPoolExecutor(1) as pool:
            other = pool.submit(settled, spark.range(7), "theirs").result()
        second = settled(first.selectExpr("id + 1 as id"), "mine")
        keep_only(second, own)
        assert own == [second.settled_at]
    assert other.count() == 7 and second.count() == 5 and not io.exists(spark, first.settled_at)


def test_booleans_at_any_depth(spark):
    df = spark.sql("select true as a, named_struct('b', false, 'c', array(named_struct('d', true, 'e', 'x'), null)) as s, cast(null as struct<f: boolean>) as n")
    row = flatten.booleans_to_int(df).first()
    assert (row.a, row.s.b, row.s.c[0].d, row.s.c[0].e, row.s.c[1], row.n) == (1, 0, 1, "x", None, None)


def test_materialise_skips_what_is_there(spark, tmp_path):
    path = str(tmp_path / "t")
    io.materialise(spark, path, lambda: spark.range(3))
    assert io.materialise(spark, path, lambda: spark.range(9)).count() == 3
    assert io.materialise(spark, path, lambda: spark.range(9), skip_if_exists=False).count() == 9


def test_small_devices_are_solved_many_a_task(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(d, i, [float(a), float(b)]) for d in range(20) for i, (a, b) in enumerate(rng.normal(size=(30, 2)))], "d int, i int, v array<double>")
    monkeypatch.setattr(svm, "spread_out", None)  # a group for each device
    fitted = svm.fit(rows, "d", "i").collect()
    assert len(fitted) == 20 and all(r.gap < 1e-6 and sum(r.arrays["a"]) == pytest.approx(1) for r in fitted)


def test_thresholds_read_their_scores_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    scores = spark.range(100).selectExpr("1 as d", "double(id) as score").mapInArrow(counted, "d int, score double")
    assert hbos.thresholds(scores, "d").first().threshold == pytest.approx(66) and seen.value == 100

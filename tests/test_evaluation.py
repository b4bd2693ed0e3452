"""Metrics, splits, sources and models on literals."""

import math

import pytest
from pyspark.sql import functions as F

from millrace.operators import baseline, metrics, models, splits
from millrace.sources import readers


def test_severity_table(spark):
    rows = [("fault", "fault", 1), ("fault", "healthy", 1), ("fault", "fault", 3), ("fault", "other", 3), ("healthy", "healthy", None)]
    got = metrics.by_severity(spark.createDataFrame(rows, "y string, p string, s int"), "y", "p", "s").orderBy("s").collect()
    assert [tuple(r) for r in got] == [(1, 2, 0.5, 0.5), (3, 2, 1.0, 0.5)]


def test_recall_at_budget_ties(spark):
    rows = [(1, 0.9), (0, 0.8), (1, 0.7), (1, 0.7), (0, 0.6), (1, 0.5), (0, 0.5), (0, 0.1)]
    df = spark.createDataFrame(rows, "y int, s double")
    got = metrics.recall_at_far(df, F.col("y") == 1, F.col("s"), [0.0, 0.25, 1.0]).collect()
    assert [(r["recall"], r["threshold"]) for r in got] == [(0.25, 0.9), (0.75, 0.7), (1.0, 0.1)]
    none = metrics.recall_at_far(spark.createDataFrame([(0, 0.9)], "y int, s double"), F.col("y") == 1, F.col("s"), [0.0]).first()
    assert none["recall"] == 0 and none["threshold"] == float("inf")


def test_mcnemar(spark):
    rows = [("a", "a", "b")] * 6 + [("a", "b", "a")] * 1 + [("a", "a", "a")] * 3
    got = metrics.mcnemar(spark.createDataFrame(rows, "y string, a string, b string"), "y", "a", "b").first()
    assert (got["n01"], got["n10"]) == (1, 6) and got["p"] == pytest.approx(2 * sum(math.comb(7, k) for k in (0, 1)) / 2**7)
    same = metrics.mcnemar(spark.createDataFrame([("a", "a", "a")], "y string, a string, b string"), "y", "a", "b").first()
    assert same["p"] == 1.0


def test_splits_do_not_leak(spark):
    df = spark.range(400).select(F.col("id").alias("row"), (F.col("id") % 13).alias("machine"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("label"), F.col("id").cast("double").alias("x"))
    folds = splits.group_folds(df, "machine", most=5)
    roles = splits.fold_roles(df, folds, "machine")
    both = roles.groupBy("fold", "machine").agg(F.countDistinct("role").alias("k")).where("k > 1")
    assert both.isEmpty() and roles.count() == 5 * 400
    assert splits.random_split(df, "row", 0.3).groupBy("role").count().collect() is not None
    assert splits.random_split(df, "row", 0.3).where("role = 'test'").count() == 120
    assert splits.random_split(df.limit(1), "row", 0.3).where("role = 'test'").count() == 1
    with pytest.raises(Exception, match="two groups"):
        splits.group_folds(df.where("machine = 1"), "machine").collect()
    inner = splits.inner_folds(roles, "machine", 3)
    assert inner.join(roles.where("role = 'test'").select("fold", "machine").distinct(), ["fold", "machine"]).isEmpty()


def test_baseline_sizes_and_distance(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("machine"), F.sin("id").alias("x"), F.cos(F.col("id") * 2).alias("y"))
    fit = baseline.fit(df, ["machine"], ["x", "y"])
    assert {r["status"] for r in fit.collect()} == {"ok"}
    assert {r["status"] for r in baseline.fit(df.limit(10), ["machine"], ["x", "y"]).collect()} == {"short"}
    import numpy as np

    rows = np.array([[r["x"], r["y"]] for r in df.where("machine = 0").orderBy("x").collect()])
    inv = np.linalg.inv(np.cov(rows.T) + 1e-6 * np.eye(2))
    want = [float((v - rows.mean(0)) @ inv @ (v - rows.mean(0))) for v in rows]
    got = [r["d2"] for r in baseline.scored(df.where("machine = 0"), fit, ["machine"], ["x", "y"]).orderBy("x").collect()]
    assert got == pytest.approx(want)


def test_order_records(spark, tmp_path):
    head = "id;esp_id;label;median(8,13);rms(98,102);median(98,102);peak1x;peak2x;a;b"
    labels = ["Normal"] * 6 + ["Unbalance"] * 3 + ["Faulty sensor"] * 3
    (tmp_path / "features.csv").write_text("\n".join([head, *(f"{i};{i % 3};{v};1;2;3;4;5;6;7" for i, v in enumerate(labels))]) + "\n")
    (tmp_path / "spectrum.csv").write_text("\n".join(";".join(["1.0" if j == i else "0.5" for j in range(20)]) + ";" for i in range(12)) + "\n")
    out = readers.order_records(spark, str(tmp_path / "features.csv"), str(tmp_path / "spectrum.csv"))
    rows = out.orderBy("row").collect()
    assert len(rows) == 12 and rows[3]["machine"] == "esp_00" and rows[3]["spectrum"][3] == pytest.approx(25.4) and len(rows[0]["spectrum"]) == 20
    assert readers.order_records(spark, str(tmp_path / "features.csv"), str(tmp_path / "spectrum.csv"), True).count() == 9
    assert {r["label"]: r["n"] for r in readers.describe(out).collect()} == {"healthy": 6, "unbalance": 3, "faulty_sensor": 3}
    (tmp_path / "short.csv").write_text("1;2;\n")
    with pytest.raises(ValueError, match="rows"):
        readers.order_records(spark, str(tmp_path / "features.csv"), str(tmp_path / "short.csv"))
    with pytest.raises(FileNotFoundError):
        readers.order_records(spark, str(tmp_path / "no.csv"), str(tmp_path / "no.csv"))


def test_telemetry_dialects(spark, tmp_path):
    names = [f"A_{c}" for c in readers.CHANNELS]
    comma, semi, bad = tmp_path / "a.csv", tmp_path / "b.csv", tmp_path / "c.csv"
    comma.write_text(",".join(["Timestamp", *names, "Barometer"]) + "\n" + "\n".join(f"2024-01-01T0{i}:00:00Z," + ",".join(["0.5"] * 8) + ",1" for i in range(2)) + "\n\n")
    semi.write_text(";".join(["Timestamp", *names]) + "\n2024-01-01T00:00:00Z;" + ";".join(["0,5"] * 7 + [""]) + "\n2024-01-01T01:00:00Z;" + ";".join(["0,6"] * 8) + "\n")
    bad.write_text(",".join(["Timestamp", *names]) + "\n2024-01-01T00:00:00Z," + ",".join(["19.194.183.349.609.300"] + ["0.5"] * 7) + "\n")
    assert readers.telemetry_file(spark, str(comma)).count() == 2
    got = readers.telemetry_file(spark, str(semi)).orderBy("ts").collect()
    assert [got[0]["Pres_PV"], got[0]["Temp_PV"], got[1]["Temp_PV"]] == [0.5, None, 0.6]
    with pytest.raises(Exception, match="corrupt"):
        readers.telemetry(spark, [str(bad)], skip_corrupted=False)
    with pytest.warns(UserWarning, match="skipped"):
        assert readers.telemetry(spark, [str(comma), str(bad), str(semi)]).count() == 4
    with pytest.warns(UserWarning), pytest.raises(ValueError, match="no telemetry"):
        readers.telemetry(spark, [str(bad)])


def test_condition_bursts_and_cache(spark, tmp_path):
    for motor, speed, cond in (("Motor-2", "100", "healthy"), ("Motor-2", "100", "bearing bpfo 3"), ("Motor-2", "all", "healthy")):
        d = tmp_path / "Vibration" / motor / speed / cond
        d.mkdir(parents=True)
        (d / "x-ch1.csv").write_text("time,1,2,3\n" + "\n".join(f"{i / 1000},{i},{2 * i},{3 * i}" for i in range(50)) + "\n")
    out = readers.condition_bursts(spark, str(tmp_path), "Vibration", most=2).orderBy("condition", "burst").collect()
    assert len(out) == 4 and out[0]["label"] == "bearing_outer" and out[0]["severity"] == 3 and out[0]["rpm"] == 1480.0
    assert out[1]["wave"][:3] == [0.0, 2.0, 4.0] and out[0]["fs"] == pytest.approx(1000)
    calls = []

    def parse():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert readers.parse_once(spark, str(tmp_path / "cache"), parse).count() == 3
    assert len(calls) == 1
    with pytest.raises(FileNotFoundError):
        readers.load_results(spark, str(tmp_path / "none"))
    readers.save_results(spark.range(1).withColumn("_hidden", F.lit(1)), str(tmp_path / "results"))
    assert readers.load_results(spark, str(tmp_path / "results")).columns == ["id"]


def test_models_over_folds(spark):
    df = spark.range(240).select(F.col("id").alias("row"), (F.col("id") % 4).alias("machine"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("label"))
    shift = F.when(F.col("label") == "a", 3.0).otherwise(0.0)
    df = df.withColumns({"x": shift + F.sin("row"), "y": F.cos("row")})
    roles = splits.fold_roles(df, splits.group_folds(df, "machine", most=2), "machine")
    for name, least in (("majority", 0.6), ("logistic", 0.85), ("context", 0.85)):
        got = models.evaluate(roles, models.ZOO[name], ["x", "y"], "label")
        assert got.count() == 240
        assert metrics.report(got).first()["accuracy"] >= least, name
    assert models.tuned(df, models.ZOO["logistic"], [{"reg": 0.01}], ["x", "y"], "label") == {"reg": 0.01}
    unsure = models.abstaining(spark.createDataFrame([("a", 0.3), ("b", 0.9)], "y_pred string, confidence double"))
    assert [r["y_pred"] for r in unsure.collect()] == ["ABSTAIN", "b"]


def test_null_predictions_are_wrong_ones(spark):
    df = spark.createDataFrame([("a", "a"), ("a", None), ("b", "b"), ("b", "ABSTAIN")], "y_true string, y_pred string")
    got = metrics.report(df).first()
    assert (got["accuracy"], got["coverage"], got["n_abstained"]) == (pytest.approx(2 / 3), 0.75, 1)
    assert got["macro_f1"] == pytest.approx((2 / 3 + 1) / 2)


def test_channels_are_merged_by_key_and_paired_by_burst(spark):
    key = "motor string, speed_pct int, condition string, burst int, wave array<double>, fs double"
    v = spark.createDataFrame([("m", 50, "x", i, [1.0 + i], 10.0) for i in range(3)] + [("m", 60, "x", 0, [5.0], 10.0)], key)
    c = spark.createDataFrame([("m", 50, "x", i, [-1.0 - i], 20.0) for i in range(2)] + [("m", 70, "x", i, [9.0], 20.0) for i in range(2)], key)
    rows = lambda pair: sorted((r["speed_pct"], r["burst"], r["vibration"], r["current"], r["fs"]) for r in readers.paired_channels(v, c, pair).collect())
    alone = [(60, 0, [5.0], None, 10.0)]
    assert rows(True) == [(50, 0, [1.0], [-1.0], 10.0), (50, 1, [2.0], [-2.0], 10.0), *alone, (70, 0, None, [9.0], 20.0), (70, 1, None, [9.0], 20.0)]
    assert rows(False) == [*((50, i, [1.0 + i], None, 10.0) for i in range(3)), *alone, (70, 0, None, None, 20.0), (70, 1, None, None, 20.0)]


def test_sampling_rate_is_of_the_median_step(spark, tmp_path):
    at = [0.0, 0.001, 0.002, 0.003, 0.5]
    d = tmp_path / "Vibration" / "Motor-2" / "100" / "healthy"
    d.mkdir(parents=True)
    (d / "x-ch1.csv").write_text("time,1\n" + "\n".join(f"{t},{i}" for i, t in enumerate(at)) + "\n")
    assert readers.condition_bursts(spark, str(tmp_path), "Vibration").first()["fs"] == pytest.approx(1000)
    df = spark.createDataFrame([("a", t) for t in at] + [("b", 1.0)], "k string, t double")
    assert {r["k"]: r["fs"] for r in readers.sampling_rate(df, "t", ["k"]).collect()} == {"a": pytest.approx(1000), "b": 20_000.0}
    steps = spark.createDataFrame([([],), ([1.0],), ([1.0, 2.0, 5.0],), (None,)], "t array<double>").select(readers.median_step(F.col("t")).alias("m"))
    assert [r["m"] for r in steps.collect()] == [None, None, 2.0, None]


def test_converted_bearings(spark, tmp_path):
    wave = lambda n: [float(i) for i in range(n)]
    rows = [(f"N15_M07_F10_K001_{i}", wave(12), wave(12 if i % 2 else 3)) for i in range(1, 5)]
    rows += [("N15_M07_F10_KA04_1", wave(4), wave(12)), ("N15_M07_F10_KA04_x", wave(12), None), ("N15_M07_F10_XX99_1", wave(12), None), ("odd", wave(12), None), ("N09_M07_F10_KI04_2", None, None)]
    path = str(tmp_path / "bearings")
    spark.createDataFrame(rows, "name string, vibration array<double>, current array<double>").write.parquet(path)
    got = {r["session_id"]: r for r in readers.converted_bearings(spark, path, most=3, window_s=1.0, fs=10.0).collect()}
    assert set(got) == {*(f"N15_M07_F10_K001_{i}" for i in (1, 2, 3)), "N15_M07_F10_KA04_0"}
    assert got["N15_M07_F10_K001_1"]["vibration"] == wave(10) == got["N15_M07_F10_K001_1"]["current"] and got["N15_M07_F10_K001_2"]["current"] is None
    assert got["N15_M07_F10_KA04_0"]["label"] == "outer_race" and got["N15_M07_F10_KA04_0"]["rpm"] == 1500.0
    with pytest.raises(FileNotFoundError):
        readers.converted_bearings(spark, path, window_s=9.0, fs=10.0)
    with pytest.raises(FileNotFoundError):
        readers.converted_bearings(spark, path + "_none")


def test_projection_matches_singular_vectors(spark):
    import numpy as np

    x = np.array([[i, 3 * i + (i * 7) % 5, (i * i) % 11, 2.0] for i in range(40)], float)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double, same double")
    got = np.array([(r["pc1"], r["pc2"]) for r in models.projection(df, ["a", "b", "c", "same"]).orderBy("id").collect()])
    z = (x[:, :3] - x[:, :3].mean(0)) / x[:, :3].std(0)
    v = np.linalg.svd(z, full_matrices=False)[2][:2]
    v *= np.sign(v[np.arange(2), abs(v).argmax(1)])[:, None]
    assert np.allclose(got, z @ v.T)


def test_manifest_and_sessions(spark, tmp_path):
    path = tmp_path / "records.json"
    path.write_text('[{"record_id": "a", "rpm": 900}, {"record_id": "b"}]')
    got = {r["record_id"]: (r["rpm"], r["fs_vib"]) for r in readers.manifest(spark, str(path)).collect()}
    assert got == {"a": (900.0, 20_000.0), "b": (1470.0, 20_000.0)}
    folder = str(tmp_path / "sessions")
    with pytest.raises(FileNotFoundError):
        readers.load_sessions(spark, folder)
    df = spark.createDataFrame([("s1", [1.0, 2.0]), ("s2", None)], "session_id string, wave array<double>")
    for session in ("s1", "s2"):
        readers.save_sessions(df.where(F.col("session_id") == session), folder)
    assert readers.load_sessions(spark, folder).count() == 2
    assert readers.load_sessions(spark, folder, "s2").first()["wave"] is None

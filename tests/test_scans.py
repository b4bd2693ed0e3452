"""Scans in blocks against windows and plain loops, curves on continuous scores, and the exact test."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import arrays, metrics, protocols, scans, splits, waveforms
from millrace.operators import sequential as seq

KEY, ORDER = ["m"], ["t", "i"]


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(11)
    rows = [(m if m < 4 else None, float(t), i, float(v) if v > -2 else None) for m, n in enumerate((700, 3, 1, 40, 50)) for i, (t, v) in enumerate(zip(rng.integers(0, 300, n), rng.normal(0, 1, n), strict=True))]
    return spark.createDataFrame(rows, "m int, t double, i int, x double").cache()


def same(a, b, *names):
    rows = lambda df: sorted((str(r["m"]), r["t"], r["i"], *[round(r[c], 9) if isinstance(r[c], float) else r[c] for c in names]) for r in df.collect())
    assert rows(a) == rows(b)


def test_blocks_give_what_windows_give(series):
    filled = series.fillna(0.0, ["x"])
    cusum = lambda b: seq.cusum(filled, KEY, ORDER, F.col("x"), 0.1, 0.9, 0.2, 1.0, True, blocks=b)
    same(cusum(0), cusum(7), "s_neg", "s_pos", "score", "hit")
    state = lambda b: seq.run_state(series, KEY, ORDER, "x", 0.4, -0.3, 3, blocks=b)
    same(state(0), state(9), "state")
    runs = lambda b: seq.runs(series, KEY, ORDER, F.col("x") > -1, blocks=b)
    same(runs(0), runs(5), "run_length")
    ewma = lambda b: seq.ewma(series, KEY, ORDER, "x", 0.25, 0.2, blocks=b)
    same(ewma(0), ewma(6), "z")
    trips = lambda b: seq.trips(filled, KEY, ORDER, "x", 0.0, 1.0, 0.1, 1.0, 0.2, 2, blocks=b)
    same(trips(0), trips(8), "tripped")


def loops(series):
    by = {}
    for r in sorted(series.collect(), key=lambda r: (r["t"], r["i"])):
        by.setdefault(r["m"], []).append(r)
    return by


@pytest.mark.parametrize("weight", [0.01, 0.2, 0.9, 1.0])
def test_ewma_is_the_recursion(series, weight):
    got = {(r["m"], r["t"], r["i"]): r["z"] for r in seq.ewma(series, KEY, ORDER, "x", 0.25, weight).collect()}
    for m, rows in loops(series).items():
        z = 0.25
        for r in rows:
            z = z if r["x"] is None else weight * r["x"] + (1 - weight) * z
            assert got[m, r["t"], r["i"]] == pytest.approx(z, abs=1e-9)


def test_run_state_is_the_recursion(series):
    got = {(r["m"], r["t"], r["i"]): r["state"] for r in seq.run_state(series, KEY, ORDER, "x", 0.4, -0.3, 2, blocks=4).collect()}
    for m, rows in loops(series).items():
        held, asked, count = 0, None, 0
        for r in rows:
            x = r["x"]
            if x is not None:
                asks = 1 if x >= 0.4 else 0 if x <= -0.3 else -1
                asked, count = asks, count + 1 if asks == asked else 1
                if asks != -1 and count >= 2:
                    held = asks
            assert got[m, r["t"], r["i"]] == ("unknown" if x is None else "running" if held else "off")


@pytest.mark.parametrize(("k", "n"), [(1, 1), (1, 4), (2, 2), (3, 5), (4, 40)])
def test_rearmed_alarms_are_the_recursion(series, monkeypatch, k, n):
    monkeypatch.setattr(seq, "CHUNK", 7)
    df = series.withColumn("flag", F.col("x") > 0.3)
    got = {r["m"]: r["alarms"] for r in seq.rearmed_alarms(df, KEY, ORDER, "flag", k, n, blocks=5).collect()}
    want = {}
    for m, rows in loops(series).items():
        buffer, alarms = [], 0
        for r in rows:
            buffer = [*buffer, int(r["x"] is not None and r["x"] > 0.3)][-n:]
            if sum(buffer) >= k:
                alarms, buffer = alarms + 1, []
        want[m] = alarms
    assert got == want


def test_as_of_of_many_readings_is_linear(spark):
    n = 100_000
    samples = spark.range(n).select(F.lit(1).alias("m"), (F.col("id") * 2.0).alias("t"), F.col("id").cast("double").alias("v"))
    grid = spark.range(n).select(F.lit(1).alias("m"), (F.col("id") * 2.0 - 1).alias("t"))
    began = time.time()
    got = seq.as_of(grid, samples, ["m"], "t", "v").agg(F.count("v"), F.sum(F.abs(F.col("v") - F.greatest((F.col("t") - 1) / 2, F.lit(0.0))))).first()
    assert got == (n, 0.0) and time.time() - began < 60


def test_as_of_edges(spark):
    samples = spark.createDataFrame([("a", 2.0, 1.0), ("a", 2.0, 5.0), ("a", 4.0, None), ("a", 6.0, 2.0), (None, 1.0, 7.0)], "m string, t double, v double")
    grid = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 5.0), ("a", 6.0), (None, 0.0), ("b", 3.0)], "m string, t double")
    got = {(r["m"], r["t"]): r["v"] for r in seq.as_of(grid, samples, ["m"], "t", "v").collect()}
    assert got == {("a", 1.0): 5.0, ("a", 2.0): 5.0, ("a", 5.0): 5.0, ("a", 6.0): 2.0, (None, 0.0): 7.0, ("b", 3.0): None}


def scored(spark, n, seed=2):
    rng = np.random.default_rng(seed)
    s = np.where(rng.random(n) < 0.2, 0.5, rng.random(n))
    y = rng.random(n) < s
    return spark.createDataFrame([(i, float(a), bool(b)) for i, (a, b) in enumerate(zip(s, y, strict=True))], "id long, score double, hit boolean"), s, y


def test_curves_of_continuous_scores(spark):
    df, s, y = scored(spark, 3000)
    rows = df.select(F.when(F.col("hit"), "a").otherwise("b").alias("y_true"), F.array("score", 1 - F.col("score")).alias("proba"))
    order = np.argsort(-s, kind="stable")
    values = sorted(set(s), reverse=True)
    tp, fp = [int(y[s >= v].sum()) for v in values], [int((~y)[s >= v].sum()) for v in values]
    steps = np.diff([0, *tp]) / y.sum()
    ap = float(sum(d * t / (t + f) for d, t, f in zip(steps, tp, fp, strict=True)))
    auc = float((s[y][:, None] > s[~y]).mean() + 0.5 * (s[y][:, None] == s[~y]).mean())
    assert {r["class"]: r["ap"] for r in metrics.average_precision(rows, ["a", "b"]).collect()}["a"] == pytest.approx(ap, abs=1e-12)
    assert {r["class"]: r["auc"] for r in metrics.roc_auc(rows, ["a", "b"]).collect()}["a"] == pytest.approx(auc, abs=1e-12)
    plan = metrics.by_score(df, F.col("hit"), F.col("score"))._jdf.queryExecution().executedPlan().toString()
    assert "__block" in plan
    got = sorted((r["coverage"], r["risk"]) for r in metrics.risk_coverage(df, "score", F.col("hit"), "id").collect())
    wrong = np.cumsum(~y[np.lexsort((np.arange(len(s)), -s))])
    ranks = [math.floor(1 + (len(s) - 1) * i / 19) for i in range(20)]
    assert got == [(k / len(s), pytest.approx(wrong[k - 1] / k)) for k in ranks] and len(order) == 3000


def test_exact_test_of_any_size(spark):
    cases = [(0, 0), (0, 1), (3, 3), (1, 9), (0, 60), (40, 61), (480, 520), (4900, 5100), (499_000, 501_000)]
    df = spark.createDataFrame(cases, "k long, m long")
    got = [r["p"] for r in df.select("k", "m", (2 * metrics.binomial_tail(F.col("k") + F.col("m"), F.col("k"))).alias("p")).orderBy("m").collect()]
    for (k, m), p in zip(sorted(cases, key=lambda c: c[1]), got, strict=True):
        n = k + m
        if n == 0:
            continue
        if n <= 10_000:
            top = 1
            want, term = 0, 1
            for i in range(k + 1):
                want += term
                term = term * (n - i) // (i + 1)
            assert p == pytest.approx(2 * float(want * 10**40 // 2**n) / 1e40 * top, rel=1e-9)
        else:
            z = (k + 0.5 - n / 2) / (n / 4) ** 0.5
            assert p == pytest.approx(math.erfc(-z / 2**0.5), rel=1e-4)
    big = spark.range(1).select((2 * metrics.binomial_tail(F.lit(10**9), F.lit(5 * 10**8 - 30_000))).alias("p")).first()["p"]
    assert big == pytest.approx(math.erfc((30_000 - 0.5) / (10**9 / 4) ** 0.5 / 2**0.5), rel=1e-5)


def test_blocks_of_a_hot_key(spark):
    df = spark.range(20_000).select(F.lit("a").alias("m"), F.col("id").alias("t"))
    sizes = [r["count"] for r in scans.in_blocks(df, ["m"], "t", 20).groupBy("__block").count().collect()]
    assert len(sizes) == 20 and max(sizes) < 1400


@pytest.mark.parametrize("most", [0, 3])
@pytest.mark.parametrize("strategy", ["train_pooled", "unsupervised_per_machine"])
def test_folds_by_subtraction(spark, most, strategy):
    df = spark.range(200).select("id", (F.col("id") % 7).alias("machine"), (F.floor(F.col("id") / 5) % 4).alias("part"), F.when(F.col("id") % 7 == 1, "a").when(F.col("id") % 3 == 0, "b").otherwise("c").alias("label"), (F.col("id") * F.col("id") % 37).cast("double").alias("x"))
    for group in ("machine", "part"):
        folds = splits.group_folds(df, group, most=most)
        roles = splits.fold_roles(df, folds, group)
        rows = lambda out: sorted((r["fold"], r["id"], r["role"], round(r["x"], 8)) for r in out.collect())
        assert rows(splits.normalised_folds(df, folds, group, ["x"], strategy)) == rows(splits.normalised(roles, ["x"], strategy))
        table = lambda out: sorted(tuple(map(str, r.asDict().values())) for r in out.select(sorted(out.columns)).collect())
        assert table(splits.fold_coverage(df, folds, group, "label")) == table(splits.label_coverage(roles, "label"))
        assert table(splits.describe_group_folds(df, folds, group, "label")) == table(splits.describe_folds(roles, group, "label"))


def test_trajectory_is_the_waveforms(spark):
    for n in (3, 4, 7, 10):
        x = [(-1.0) ** i * 0.3 + i * 0.2 - 0.9 for i in range(n)]
        got = arrays.current_trajectory(spark.createDataFrame([(x,)], "x array<double>"), "x", 5.0).first()["current"]
        want = {k: v for k, v in waveforms.trajectory(np.array(x), 5.0).items() if k.startswith("current_traj_")}
        assert (got is None) == (not want) and (not want or got.asDict() == pytest.approx(want))


def test_gate_features_find_order_features(spark):
    out = arrays.order_features(spark.createDataFrame([([1.0] * 200,)], "s array<double>"), "s", 0.05).select("orders.*")
    assert protocols.gate_features(out.columns) == protocols.GATE_SETS["order_spectrum"]

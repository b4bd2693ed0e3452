"""The commissioning and per-machine gate protocols against plain loops over machines."""

import math
from collections import defaultdict

import numpy as np
import pytest

from millrace.operators import baseline, protocols
from millrace.operators import sequential as seq


def escalations(fitted, judged, current=None):
    """A composite gate in NumPy, a row at a time: reasons of each."""
    fitted, p = np.asarray(fitted, float), len(fitted[0])
    mu, sd = fitted.mean(0), fitted.std(0) + 1e-12
    far = len(fitted) > 10 * p
    inverse = np.linalg.inv(np.cov(fitted.T).reshape(p, p) + 1e-6 * np.eye(p)) if far else None
    z, s, out = mu.copy(), 0.0, []
    for x in np.asarray(judged, float):
        z = 0.2 * x + 0.8 * z
        why = ["ewma"] if (np.abs(z - mu) / (sd * math.sqrt(0.2 / 1.8)) > baseline.ewma_sigmas(p)).any() else []
        if current is not None:
            s = max(0.0, s - (x[current] - mu[current]) / (sd[current] + 1e-12) - 0.5)
            why += ["cusum_current"] if s >= 5 else []
        if far and (x - mu) @ inverse @ (x - mu) > baseline.chi2_quantile(0.99, p):
            why.append("mahalanobis")
        out.append(why)
    return out


def alarms(flags, k, n):
    fired, last = 0, []
    for f in flags:
        last = [*last, f][-n:]
        if sum(last) >= k:
            fired, last = fired + 1, []
    return fired


def test_alarms_of_several_rules(spark):
    rng = np.random.default_rng(3)
    flags = {m: rng.random(60) < share for m, share in (("a", 0.2), ("b", 0.6), (None, 0.9), ("none", 0.0))}
    df = spark.createDataFrame([(m, i, bool(f)) for m, fs in flags.items() for i, f in enumerate(fs)] + [("b", 60, None)], "m string, i int, f boolean")
    for blocks in (0, 4):
        got = {(r["m"], r["k"], r["n"]): r["alarms"] for r in seq.alarms_of_rules(df, ["m"], ["i"], "f", protocols.RULES, blocks).collect()}
        assert got == {(m, k, n): alarms(f, k, n) for m, f in flags.items() for k, n in protocols.RULES}


@pytest.fixture(scope="module")
def plant(spark):
    """Windows of six machines over three days: (m, d, i, load, x, y)."""
    rng, rows = np.random.default_rng(5), []
    for m in range(6):
        for d in range(1, 4):
            for i in range(40):
                on = {0: i >= 5, 1: False, 2: i % 2 == 0, 3: 5 <= i < (30 if d == 2 else 39), 4: i >= 5 if d == 3 else i > 30, 5: True}[m]
                load = 1.0 if m == 1 else rng.normal(5.0, 1.0) if m == 5 else (40.0 if on else 0.5) + rng.random()
                shift = 6.0 * (d - 1) if m == 0 and i > 20 else 0.0
                rows.append((m, d, i, load, float(rng.normal(3.0, 1.0) + shift), float(rng.normal(0.0, 1.0))))
    return rows, spark.createDataFrame(rows, "machine int, d int, i int, load double, x double, y double").repartition(5)


def test_commissioning_against_a_plain_loop(spark, plant):
    rows, df = plant
    levels = {r["machine"]: r for r in seq.run_thresholds(seq.otsu(df, ["machine"], "load"), least=0.75).collect()}
    got = {r["machine"]: r for r in protocols.commissioning_protocol(df, ["machine"], "d", ["i"], "load", ["x", "y"], "x").collect()}
    assert len(got) == 6 and got[1]["status"] == "never runs" and levels[5]["status"] == "one mode"
    statuses = {m: r["status"] for m, r in got.items()}
    assert statuses[0] == "commissioned" and statuses[2] == "uncommissionable" and statuses[3] == "commissioned" and statuses[4] == "no later rows"
    for m, r in got.items():
        if statuses[m] in ("never runs", "one mode"):
            assert r["n_evaluated"] is None and r["verdict"] is None and r["best"] == 0
            continue
        on, off, running = *((levels[m]["on"], levels[m]["off"]) if levels[m]["on"] is not None else (None, None)), defaultdict(list)
        if on is None:
            continue  # judged by looser levels than the test's
        for d in (1, 2, 3):
            state, asked, n = 0, None, 0
            for _, _, _, load, x, y in sorted(t for t in rows if t[:2] == (m, d)):
                asks = 1 if load >= on else 0 if load <= off else -1
                n = n + 1 if asks == asked else 1
                asked = asks
                state = asks if asks != -1 and n >= 2 else state
                if state:
                    running[d].append((x, y))
        first = next((d for d in sorted(running) if len(running[d]) >= 30), None)
        assert (r["commissioned_on"], r["best"], r["required"]) == (first, max(map(len, running.values()), default=0), 30)
        later = [w for d in sorted(running) if first and d > first for w in running[d]]
        if not later:
            continue
        flags = [bool(why) for why in escalations(running[first], later)]
        assert r["n_evaluated"] == len(later) and r["escalation_rate"] == pytest.approx(np.mean(flags)) and r["hours"] == pytest.approx(len(later) / 60)
        for k, n in protocols.RULES:
            assert r[f"alarms_{k}of{n}"] == alarms(flags, k, n)
            assert r[f"per_month_{k}of{n}"] == pytest.approx(alarms(flags, k, n) / (len(later) / 60) * 90)
        growth = np.median([w[0] for w in running[max(running)]]) / np.median([w[0] for w in running[min(running)]])
        assert r["growth"] == pytest.approx(growth) and r["verdict"] == ("undecidable" if growth > 2 else "upper bound")
    assert got[0]["alarms_1of1"] > got[0]["alarms_5of10"] > 0 and got[0]["verdict"] == "undecidable" and got[3]["verdict"] == "upper bound"


def test_commissioning_of_nothing_and_of_rows_without_a_machine(spark, plant):
    _, df = plant
    args = (["machine"], "d", ["i"], "load", ["x", "y"], "x")
    assert protocols.commissioning_protocol(df.where("false"), *args).collect() == []
    extra = df.where("machine = 0").selectExpr("cast(null as int) AS machine", "d", "i", "load", "x", "y", "'z' AS verdict")
    both = df.where("machine = 0").selectExpr("*", "'z' AS verdict").unionByName(extra)
    assert [r["machine"] for r in protocols.commissioning_protocol(both, *args).collect()] == [0]


def test_per_machine_gate_against_a_plain_loop(spark):
    rng, rows = np.random.default_rng(9), []
    for m, healthy, faulty in ((0, 80, 20), (1, 24, 5), (2, 6, 9), (3, 60, 0)):
        for i in range(healthy + faulty):
            label = "healthy" if i < healthy else "worn"
            rows.append((m, 1000 * m + i, label, float(rng.normal(5.0, 2.0) - (9.0 if label == "worn" else 0.0)), float(rng.normal(0.0, 3.0)), 7.0))
    df = spark.createDataFrame(rows, "machine int, row long, label string, x double, y double, flat double").repartition(4)
    names = ["x", "y"]
    got = {r["machine"]: r for r in protocols.per_machine_gate(df, ["machine"], ["row"], names, "label", "healthy", "row", current="x").collect()}
    assert {m: r["status"] for m, r in got.items()} == {0: "ok", 1: "short", 2: "few healthy", 3: "ok"}
    assert got[2]["n_fit"] is None and got[2]["field"] is None
    roles = {r["row"]: r["role"] for r in baseline.half_for_baseline(df, ["machine"], "label", "healthy", "row").collect()}
    for m in (0, 1, 3):
        fitted = np.array([t[3:5] for t in rows if t[0] == m and roles[t[1]] == "fit"])
        rest = sorted((t for t in rows if t[0] == m and roles[t[1]] == "evaluate"), key=lambda t: (t[2] != "healthy", t[1]))
        mu, sd = fitted.mean(0), fitted.std(0)
        whys = escalations((fitted - mu) / sd, (np.array([t[3:5] for t in rest]) - mu) / sd, current=0)
        hit = {w: [bool(y) for y, t in zip(whys, rest, strict=True) if (t[2] == "healthy") == w] for w in (True, False)}
        r = got[m]
        assert (r["n_fit"], r["adequate"], r["required"], r["n"]) == (len(fitted), len(fitted) >= 30, 30, len(rest))
        assert r["healthy_rate"] == pytest.approx(np.mean(hit[True])) and (r["fault_rate"] is None if not hit[False] else r["fault_rate"] == pytest.approx(np.mean(hit[False])))
        for reason in ("ewma", "cusum_current", "mahalanobis"):
            assert r[f"by_{reason}"] == sum(reason in y for y in whys)
    flat = protocols.per_machine_gate(df.where("machine = 0"), ["machine"], ["row"], ["x", "flat"], "label", "healthy", "row").first()
    assert flat["status"] == "ok" and flat["fault_rate"] > 0.9

"""Windows against plain loops, and streams against both."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import sequential as seq
from millrace.plans import base
from millrace.streaming import processors

KEY, ORDER = ["machine"], ["ts", "event_id"]
SCHEMA = "machine long, ts timestamp, event_id long, load double"


@pytest.fixture(scope="module")
def rows():
    from datetime import datetime, timedelta

    r, t = random.Random(4), datetime(2024, 1, 1)
    return [(m, t + timedelta(seconds=i // 2), m * 1000 + i, None if r.random() < 0.15 else float("nan") if r.random() < 0.03 else r.choice([5.0, 20.0, 20.0, 8.0, 10.0, 0.0])) for m in range(4) for i in range(120)]


def ordered(rows):
    for m in sorted({r[0] for r in rows}):
        yield m, sorted((r for r in rows if r[0] == m), key=lambda r: (r[1], r[2]))


def loop_states(rows, on, off, dwell):
    out = {}
    for _, own in ordered(rows):
        state, pending, n = "off", None, 0
        for _, _, i, x in own:
            if x is None or x != x:
                out[i] = "unknown"
                continue
            asks = "running" if x >= on else "off" if x <= off else None
            n = n + 1 if asks == pending else 1
            pending = asks
            if asks and n >= dwell:
                state = asks
            out[i] = state
    return out


@pytest.mark.parametrize("dwell", [1, 2, 3])
def test_run_state(spark, rows, dwell):
    got = {r["event_id"]: r["state"] for r in seq.run_state(spark.createDataFrame(rows, SCHEMA), KEY, ORDER, "load", 10.0, 5.0, dwell).collect()}
    want = loop_states(rows, 10.0, 5.0, dwell)
    assert got == want and len(set(want.values())) == 3


def test_cusum_trip_and_alarms(spark, rows):
    known = [r for r in rows if r[3] is not None and r[3] == r[3]]
    df = spark.createDataFrame(known, SCHEMA)
    got = {r["event_id"]: r for r in seq.trips(df, KEY, ORDER, "load", 12.0, 5.0, 0.1, 1.0, 9.0, 2).collect()}
    trips = 0
    for _, own in ordered(known):
        s, n = 0.0, 0
        for _, _, i, x in own:
            s = max(0.0, s - (x - 12.0) / (5.0 + 1e-12) - 0.1)
            n = n + 1 if s >= 1.0 and x < 9.0 else 0
            assert got[i]["s_neg"] == pytest.approx(s, abs=1e-9) and got[i]["tripped"] == (n >= 2)
            trips += n >= 2
    assert trips > 5
    alarms = {r["machine"]: r["alarms"] for r in seq.rearmed_alarms(df.withColumn("high", F.col("load") >= 10), KEY, ORDER, "high", 3, 5).collect()}
    for m, own in ordered(known):
        buffer, count = [], 0
        for *_, x in own:
            buffer = [*buffer, x >= 10][-5:]
            if sum(buffer) >= 3:
                count, buffer = count + 1, []
        assert alarms[m] == count > 0


def test_ewma_long_series(spark):
    n = 1500
    df = spark.range(n).select(F.lit(1).alias("machine"), F.col("id").alias("ts"), (F.col("id") * 7919 % 1000).cast("double").alias("x"))
    got = [r["z"] for r in seq.ewma(df, KEY, ["ts"], "x", 100.0, 0.2).orderBy("ts").collect()]
    z = 100.0
    for i in range(n):
        z = 0.2 * (i * 7919 % 1000) + 0.8 * z
        assert got[i] == pytest.approx(z, rel=1e-12)


def test_thresholds_refuse(spark):
    flat = spark.createDataFrame([(1, 0.4)] * 100, "machine long, load double")
    assert seq.run_thresholds(seq.otsu(flat, ["machine"], "load")).first()["status"] == "never runs"
    duty = spark.createDataFrame([(1, 0.4)] * 90 + [(1, 40.0)] * 10, "machine long, load double")
    t = seq.run_thresholds(seq.otsu(duty, ["machine"], "load")).first()
    assert t["status"] == "ok" and 0.4 < t["off"] < t["on"] < 40.0


def test_interlock_and_moving_rms(spark):
    df = spark.createDataFrame([(1, i, 20.0, 0.25, float(i)) for i in range(20)], "machine long, ts long, temp double, s double, x double")
    kept = seq.interlocked(df, KEY, ["ts"], "temp", "s", 80.0, 2.0).collect()
    assert len(kept) == 8 and [r["breach"] for r in kept] == [False] * 7 + [True]
    hot = seq.interlocked(df, KEY, ["ts"], "temp", "s", 10.0, 99.0).collect()
    assert len(hot) == 1
    got = [r["rms"] for r in seq.moving_rms(df, KEY, ["ts"], "x", 3).orderBy("ts").collect()]
    assert got[0] == pytest.approx(((0 + 1) / 3) ** 0.5) and got[5] == pytest.approx(((16 + 25 + 36) / 3) ** 0.5)


def test_as_of(spark):
    samples = spark.createDataFrame([(1, 10, 1.0), (1, 20, 2.0)], "machine long, t long, v double")
    grid = spark.createDataFrame([(1, t) for t in (5, 10, 15, 20, 99)], "machine long, t long")
    assert [r["v"] for r in seq.as_of(grid, samples, KEY, "t", "v").orderBy("t").collect()] == [1.0, 1.0, 1.0, 2.0, 2.0]


def streamed(spark, tmp_path, rows, processor):
    """Several micro-batches, split in time."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src = tmp_path / "in"
    df = spark.createDataFrame(rows, SCHEMA)
    half = sorted(r[1] for r in rows)[len(rows) // 2]
    name = type(processor).__name__.lower()
    out = []
    for part in (df.where(F.col("ts") < F.lit(half)), df.where(F.col("ts") >= F.lit(half))):
        part.coalesce(1).write.mode("append").parquet(str(src))
        q = processors.apply(spark.readStream.schema(SCHEMA).parquet(str(src)), processor).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).queryName(name).start()
        q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    return {r["event_id"]: r for r in out}


def test_stream_of_run_states_goes_on_over_batches(spark, rows, tmp_path):
    got = streamed(spark, tmp_path, rows, processors.RunState(10.0, 5.0, 2))
    assert {i: r["state"] for i, r in got.items()} == loop_states(rows, 10.0, 5.0, 2)


@pytest.mark.parametrize("make", [lambda: processors.Trip(12.0, 5.0, 0.1, 1.0, 9.0, 2), lambda: processors.Cusum(12.0, 5.0), lambda: processors.Ewma(12.0, 5.0), lambda: processors.Rearmed(10.0, 3, 5), lambda: processors.Interlock(0.25, 80.0, 9.0)])
def test_steps_are_folds(make):
    """Restarting from a stored value gives what one run gives."""
    r = random.Random(3)
    loads = [r.choice([None, 5.0, 8.0, 20.0]) for _ in range(200)]
    p = make()
    state, one = p.start, []
    for x in loads:
        state, row = p.step(state, x)
        one.append(row)
    q, state, two = make(), p.start, []
    for x in loads:
        state, row = q.step(tuple(state), x)
        two.append(row)
        assert len(row) == len(q.out)
    assert one == two


def test_registered_tables(spark):
    assert base.telemetry(spark, "/root/testdata/sf0.001").where("load is null").count() > 0

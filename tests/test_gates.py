"""Gates on machines of few healthy rows, against their SQL."""

from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from millrace.plans.base import r as rounding

HEALTHY = {1: 1, 2: 4, 3: 12, 4: 19, 5: 20, 6: 21, 7: 30}  # healthy rows by machine


@pytest.fixture(scope="module")
def few(spark, tmp_path_factory):
    root, rows, t = tmp_path_factory.mktemp("few"), [], datetime(2024, 1, 1)
    for machine, n in HEALTHY.items():
        for i in range(n + 8):
            j = len(rows)
            kind = ("error", "purchase")[i % 2] if i >= n else ("view", "click", "signup")[i % 3]
            rows.append((j, t + timedelta(seconds=j * 7919 % 5000), machine, kind, round((j * 37.77 + i * i * 3.1) % 90, 2)))
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    df.coalesce(1).write.parquet(str(root / "events.parquet"))
    return str(root)


def both(spark, path, name):
    """Rows of a query and of its SQL, by column order of the SQL."""
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW events AS SELECT * FROM '{path}/events.parquet/*.parquet'")
        want = db.sql(entry.oracle_sql()[name])
        columns, want = want.columns, want.fetchall()
    key = lambda r: tuple(map(str, r[:2]))
    return sorted(map(tuple, entry.queries()[name](spark, path).select(*columns).collect()), key=key), sorted(want, key=key)


def test_every_machine_with_a_covariance_has_distances(spark, few):
    got, want = both(spark, few, "w8_mahalanobis")
    assert [r[:2] + r[3:] for r in got] == [r[:2] + r[3:] for r in want]
    assert [r[2] for r in got] == [x if x is None else pytest.approx(x, abs=1e-5) for x in (r[2] for r in want)]
    assert {r[0] for r in got if r[2] is None} == {1}  # one row has no covariance


def test_the_composite_gate_judges_every_machine(spark, few):
    got, want = both(spark, few, "w9_composite_gate")
    assert got == want
    assert {r[0] for r in got if "mahalanobis" in r[3]} == set(HEALTHY) - {1}


def test_gate_rates_of_every_machine(spark, few):
    got, want = both(spark, few, "w11_gate_rates")
    assert got == want and len(got) == len(HEALTHY)


def test_rates_are_rounded_as_in_sql(spark):
    ties = spark.createDataFrame([(i, i / 20 * 0.99 + j / 32 * 0.01) for i in range(21) for j in range(33)] + [(99, x) for x in (1e305, -1e-9, 2.5e-7, float("inf"))], "i long, x double").repartition(1)
    rows = [(r["x"], r["y"]) for r in ties.withColumn("y", rounding(F.col("x"))).collect()]
    with duckdb.connect() as db:
        want = [db.execute("SELECT round(?::DOUBLE, 6) + 0.0", [x]).fetchall()[0][0] for x, _ in rows]
    assert [y for _, y in rows] == want


def test_gate_summary_of_every_machine(spark, few):
    got, want = both(spark, few, "w20_gate_summary")
    assert got == want and got[0][4] == 0

"""Queries over whole tables: every row enters, and the SQL says the same."""

import inspect
import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from millrace.operators import metrics, models

KINDS = ["click", "error", "purchase", "signup", "view"]
NAMES = ["l5_label_coverage", "l8_nth_of_class", "l11_stratified_context", "l15_lomo_feasible", "j1_j2_channel_merge", "p2_collapse_labels", "e12_mcnemar"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    events = spark.range(480).select(F.col("id").alias("event_id"), (F.col("id") * 7 % 36).alias("user_id"), F.element_at(F.array(*map(F.lit, KINDS)), (F.col("id") % 5 + 1).cast("int")).alias("event_type"), (F.col("id") % 90).cast("double").alias("value"))
    events.write.parquet(f"{at}/events.parquet")
    spark.range(200).select(F.col("id").alias("p_partkey")).write.parquet(f"{at}/part.parquet")
    return at


def told(rows):
    return sorted(map(str, rows))


@pytest.mark.parametrize("name", NAMES)
def test_whole_queries_match_sql(spark, tables, name):
    con = duckdb.connect()
    for t in ("events", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tables}/{t}.parquet/*.parquet')")
    got = entry.queries()[name](spark, tables)
    want = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert told(tuple(r[c] for c in columns) for r in got.collect()) == told(want.fetchall())


def test_every_row_enters(spark, tables):
    run = lambda name: entry.queries()[name](spark, tables).collect()
    folds = run("l5_label_coverage")
    assert sum(r["n_test"] for r in folds) == 480 and len(folds) == 12
    assert [r["missing"] for r in folds if r["n_lost"]] == [["error"]]
    assert len(run("l11_stratified_context")) == 480  # below the cap of 500
    assert run("l15_lomo_feasible")[0]["machines"] == 12
    assert sum((r["vibration"] or 0) + (r["current"] or 0) for r in run("j1_j2_channel_merge")) == 480
    assert sum(r["n"] for r in run("p2_collapse_labels")) == 200


def test_mcnemar_of_many_rows(spark):
    n = spark.createDataFrame([(0, 0), (30, 0), (30, 11), (5001, 2450), (200_001, 99_900)], "n long, k long")
    for r in n.select("n", "k", metrics.binomial_tail(F.col("n"), F.col("k")).alias("p")).collect():
        if r["n"] < 10_000:
            want = sum(math.comb(r["n"], i) for i in range(r["k"] + 1)) / 2 ** r["n"] if r["n"] < 1000 else float(sum(math.comb(r["n"], i) for i in range(r["k"] + 1)) * 10**12 // 2 ** r["n"]) / 1e12
            assert r["p"] == pytest.approx(want, rel=1e-7)
        else:
            assert 0.3 < r["p"] < 0.35


def test_studies_run_at_the_operators_defaults(spark, tables, monkeypatch):
    assert inspect.signature(entry.queries()["w18_seasonal_drift"]).parameters["p"].default == 20
    seen, real = [], models.InContext.__init__
    monkeypatch.setattr(models.InContext, "__init__", lambda self, *a, **k: (real(self, *a, **k), seen.append(self.context))[0])
    entry.queries()["m4_context_folds"](spark, tables)
    assert set(seen) == {models.CONTEXT_ROWS}

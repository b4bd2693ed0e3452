"""Abstention, repeated runs, the machine probe, ties, and late rows of streams."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import models
from millrace.streaming import processors


@pytest.fixture(scope="module")
def rows(spark):
    r = lambda seed: F.rand(seed)
    df = spark.range(240).select(F.col("id").alias("row"), (F.col("id") % 6).cast("int").alias("machine"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("label"), r(1).alias("x"), r(2).alias("y"))
    return df.withColumn("x", F.col("x") + F.when(F.col("label") == "a", 3.0).otherwise(0.0)).cache()


def test_rows_out_of_range_are_abstained(spark, rows):
    test = spark.createDataFrame([(1, 3.5, 0.5, "a"), (2, 0.5, 0.5, "b"), (3, 500.0, 0.5, "a"), (4, 0.5, -90.0, "b")], "row long, x double, y double, label string")
    got = {r["row"]: r["y_pred"] for r in models.ZOO["context_abstain"]().fit_predict(rows, test, ["x", "y"], "label").collect()}
    assert got == {1: "a", 2: "b", 3: "ABSTAIN", 4: "ABSTAIN"}
    assert "ABSTAIN" not in {r["y_pred"] for r in models.ZOO["context"]().fit_predict(rows, test, ["x", "y"], "label").collect()}


def test_repeated_runs_with_a_report_by_fold(spark, rows):
    got = models.evaluate_repeated(rows, models.ZOO["context"], "machine", ["x", "y"], "label", seeds=(0, 1), most=3)
    assert got.groupBy("seed", "row").count().where("count = 1").count() == 480
    reports = models.fold_reports(got).collect()
    assert len(reports) == 6 and sum(r["n_test"] for r in reports) == 480 and all(r["accuracy"] > 0.95 for r in reports)
    spread = {r["metric"]: r for r in models.seed_reports(got).collect()}
    assert spread["accuracy"]["least"] <= spread["accuracy"]["mean"] <= spread["accuracy"]["most"] and spread["coverage"]["std"] == 0


def test_machine_probe(spark, rows):
    blind = models.machine_probe(rows, ["x", "y"], "machine", "row").first()
    assert blind["chance"] == pytest.approx(1 / 6) and not blind["encodes_machine"]
    told = models.machine_probe(rows.withColumn("x", F.col("machine") * 10.0 + F.col("y")), ["x", "y"], "machine", "row").first()
    assert told["accuracy"] > 0.95 and told["encodes_machine"]
    assert models.machine_probe(rows.where("machine = 1"), ["x"], "machine", "row").first()["accuracy"] == 0.0


def test_top_k_breaks_ties(spark):
    df = spark.createDataFrame([("a", 1.0, i, str(i % 3)) for i in (5, 3, 9, 1)], "k string, v double, i int, s string").repartition(3)
    assert sorted(r["i"] for r in models.top_k(df, ["k"], "v", 2).collect()) == [1, 3]
    assert sorted(r["i"] for r in models.top_k(df, ["k"], "v", 2, ["s", "i"]).collect()) == [3, 9]


def test_late_rows_come_out_flagged(spark, tmp_path):
    from datetime import datetime, timedelta

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    t, schema = datetime(2024, 1, 1), "machine long, ts timestamp, event_id long, load double"
    batches = [[(1, t + timedelta(seconds=i), i, 20.0) for i in (0, 1, 4)], [(1, t + timedelta(seconds=i), i, 20.0) for i in (2, 3, 5, 4)] + [(2, t, 9, None)]]
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = processors.apply(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), processors.Cusum(0.0, 1.0)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).queryName(f"late{i}").start()
        q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(out) == 8
    assert sorted(r["event_id"] for r in out if r["late"]) == [2, 3, 4] and all(r["s_pos"] is None and r["hit"] is None for r in out if r["late"])
    assert {r["event_id"]: r["s_pos"] for r in out if not r["late"] and r["machine"] == 1} == pytest.approx({0: 19.5, 1: 39.0, 4: 58.5, 5: 78.0})

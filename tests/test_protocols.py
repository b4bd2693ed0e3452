"""Feature choice, ladders, intervals and the simulated rig."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import protocols, sequential, splits
from millrace.sources.simulated import simulated


def test_gate_features_and_profiles(spark):
    assert protocols.gate_features(["peak1x", "peak2x", "vib_rms"]) == ["peak1x", "peak2x"]
    assert protocols.gate_features(["vib_rms", "x"], kind="waveform") == ["vib_rms"]
    with pytest.raises(ValueError):
        protocols.gate_features(["x"])
    assert protocols.profile(spark.createDataFrame([(1, 2)], "vib_rms int, mcsa int"), "ct_only").columns == ["mcsa"]


def test_ladder_and_confounds(spark):
    df = spark.range(60).select("id", (F.col("id") % 3).cast("string").alias("machine"), F.lit("").alias("component"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("label"))
    assert list(protocols.ladder(df, {"component": "component", "machine": "machine", "gone": "nothing"})) == ["machine"]
    with pytest.raises(ValueError, match="confounded"):
        protocols.assert_not_confounded(splits.contingency(df, "label", "machine"), "label", "machine")
    mixed = df.withColumn("label", F.when((F.col("id") / 3).cast("int") % 2 == 0, "a").otherwise("b"))
    protocols.assert_not_confounded(splits.contingency(mixed, "label", "machine"), "label", "machine")


def test_bootstrap_covers_the_mean(spark):
    got = protocols.bootstrap(spark.range(400).select((F.col("id") % 10).cast("double").alias("v")), "v", 200).first()
    assert got["low"] < 4.5 < got["high"] and got["high"] - got["low"] == pytest.approx(2 * 1.96 * 2.872 / 20, rel=0.35)


def test_interlocked_rig(spark):
    rig = simulated(spark, sessions=2, blocks=60, heating=10)
    kept = sequential.interlocked(rig, ["session"], ["block"], "seal_temp_c", "seconds", 80.0, 20.0)
    assert kept.groupBy("session").agg(F.max("seal_temp_c").alias("t")).first()["t"] == 80.0
    cold = sequential.interlocked(simulated(spark, condition="healthy", blocks=60), ["session"], ["block"], "seal_temp_c", "seconds", 80.0, 20.0)
    assert cold.count() == 60
    assert protocols.markdown(cold.select("block").orderBy("block").limit(1)).count("|") == 6


def test_ablation(spark):
    df = spark.range(300).select(F.col("id").alias("row"), F.lit(1).alias("machine"), F.when(F.col("id") % 5 == 0, "fault").otherwise("healthy").alias("label"))
    df = df.withColumns({"x": F.sin(F.col("row") * 1.7) + F.when(F.col("label") == "fault", 20.0).otherwise(0.0), "y": F.cos(F.col("row") * 2.3)})
    got = {r["features"]: r["mean_ceiling"] for r in protocols.gate_ablation(df, ["machine"], ["x", "y"], "label", "healthy", "row").collect()}
    assert got["x"] == got["x,y"] == 1.0 and got["y"] < 0.3

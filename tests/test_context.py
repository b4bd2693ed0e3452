"""The in-context vote over many rows: brute force, ties, missing features, and rows spread over tasks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import models, splits


def brute(train, test, k, mu, sd):
    """Votes of the k nearest training rows, of equal distances the first class, of equal votes the last."""
    points, out = (np.array([r[1:3] for r in train]) - mu) / sd, {}
    for row, *q, _ in test:
        near = sorted((float((((np.array(q) - mu) / sd - p) ** 2).sum()), r[3]) for p, r in zip(points, train, strict=True))[:k]
        votes = {c: sum(1 / (d + 1e-9) for d, y in near if y == c) for c in sorted({r[3] for r in train})}
        best = max(votes, key=lambda c: (votes[c], c))
        out[row] = (best, votes[best] / sum(votes.values()))
    return out


@pytest.mark.parametrize("k", [1, 5, 999])
def test_votes_are_those_of_brute_force(spark, k):
    rng = np.random.default_rng(3)
    train = [(i, float(rng.integers(0, 8)), float(rng.integers(0, 8)), "abc"[int(rng.integers(0, 3))]) for i in range(150)]  # a grid, so that distances tie
    test = [(1000 + i, float(rng.integers(0, 16)) / 2, float(rng.integers(0, 16)) / 2, "a") for i in range(300)]
    schema = "row long, x double, y double, label string"
    table = spark.createDataFrame(train, schema)
    got = models.InContext(k=k).fit_predict(table, spark.createDataFrame(test, schema), ["x", "y"], "label")
    at = table.agg(F.avg("x"), F.avg("y"), F.stddev_pop("x"), F.stddev_pop("y")).first()  # to the last bit, so that ties stay ties
    want, got = brute(train, test, k, np.array(at[:2]), np.array(at[2:])), {r["row"]: (r["y_pred"], r["confidence"]) for r in got.collect()}
    assert set(got) == set(want)
    for row, (y, sure) in want.items():
        assert got[row] == (y, pytest.approx(sure, rel=1e-9))


def test_rows_without_a_feature_have_no_prediction(spark):
    train = spark.range(60).select(F.col("id").alias("row"), (F.col("id") * 1.0).alias("x"), (F.col("id") % 7 * 1.0).alias("y"), F.when(F.col("id") < 30, "a").otherwise("b").alias("label"))
    test = spark.createDataFrame([(1, 2.0, 3.0, "a"), (2, None, 3.0, "b"), (3, 55.0, float("nan"), "b"), (4, 55.0, 3.0, "b")], "row long, x double, y double, label string")
    for abstain in (False, True):
        got = {r["row"]: (r["y_pred"], r["confidence"]) for r in models.InContext(abstain=abstain).fit_predict(train, test, ["x", "y"], "label").collect()}
        assert got[1][0] == "a" and got[4][0] == "b" and got[2] == got[3] == (None, None)


def test_rows_of_a_fold_are_spread_over_tasks(spark):
    df = spark.range(4000).repartition(4).select(F.col("id").alias("row"), (F.col("id") % 3).alias("machine"), (F.col("id") * 1.0).alias("x"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("label"))
    roles = splits.fold_roles(df, splits.group_folds(df, "machine", most=3), "machine")
    part = splits.normalised(roles, ["x"], "train_pooled").where("fold = 0 and role = 'test'")
    sizes = [r["count"] for r in part.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) == 4 and sum(sizes) in (1333, 1334)


def test_context_ranks_few_rows_of_a_class(spark):
    df = spark.range(50_000).select(F.col("id").alias("row"), F.when(F.col("id") % 10 == 0, "a").otherwise("b").alias("label"))
    got = splits.stratified_context(df, "label", "row", 400)
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()
    assert {r["label"]: r["count"] for r in got.groupBy("label").count().collect()} == {"a": 200, "b": 200}

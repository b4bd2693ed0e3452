"""Curves, simulations and tables of studies: A17, E16, E20, E21, W14, W18, A9, S13 and the model harness."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import physics, radio
from ..operators import baseline, metrics, models, sequential, splits, waveforms
from ..tables import table
from .base import query, r, rounded
from .evaluation import rows as event_rows
from .scalars import BEAT, FULL


@query("e21_battery_by_rate", f"""WITH g AS (SELECT i / 40.0::DOUBLE AS rate, 30.0 AS x FROM (SELECT unnest(range(41)) AS i)), t AS (SELECT rate, 1.8 * 3 * 3600 + 5.95 + 45 * (rate * {FULL} + 18 * {BEAT}) + 0.84 * (rate + 18) + 0.0014 * (86400 - 3 * 3600) AS q FROM g)
SELECT round(rate, 6) AS rate, round(2400 / (q / 3600) / 365.25, 6) AS years FROM t""")
def battery_by_rate(spark, sf_dir):
    """Battery life at 41 escalation rates."""
    g = spark.range(41).select((F.col("id") / 40).alias("rate"))
    return g.select(r(F.col("rate")).alias("rate"), r(radio.event_triggered(rate=F.col("rate"))["battery_years"]).alias("years"))


@query("e16_normalisation_gap", "WITH s AS (SELECT event_type AS model, CASE WHEN event_id % 2 = 0 THEN 'pooled' ELSE 'per_machine' END AS strategy, value FROM events) SELECT model, round(avg(value) FILTER (strategy = 'pooled'), 6) AS pooled, round(avg(value) FILTER (strategy = 'per_machine'), 6) AS per_machine, round(avg(value) FILTER (strategy = 'pooled') - avg(value) FILTER (strategy = 'per_machine'), 6) AS gap FROM s GROUP BY model")
def normalisation_gap(spark, sf_dir):
    """Scores by model and strategy, and their gap."""
    s = table(spark, sf_dir, "events").select(F.col("event_type").alias("model"), F.when(F.col("event_id") % 2 == 0, "pooled").otherwise("per_machine").alias("strategy"), "value")
    out = s.groupBy("model").pivot("strategy", ["pooled", "per_machine"]).avg("value")
    return rounded(out.withColumn("gap", F.col("pooled") - F.col("per_machine")), "pooled", "per_machine", "gap")


@query("w14_trip_simulation")
def trip_simulation(spark, sf_dir, trials: int = 40, noise: float = 0.8, seed: int = 0):
    """Monte Carlo of dry runs, closed valves and healthy runs: rates and median delay."""
    grid = spark.range(trials).withColumnRenamed("id", "trial").withColumn("condition", F.explode(F.array(*map(F.lit, physics.SETTLES))))
    grid = grid.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(159)))).withColumn("t", F.col("step") * 0.05)
    grid = grid.withColumn("onset", 2.0 + (F.col("trial") % 10) / 10)
    current = physics.dry_run_current(F.col("t"), F.col("onset"), F.col("condition"), noise=F.randn(seed) * noise / 4)
    out = sequential.trips(grid.withColumn("i", current), ["trial", "condition"], ["step"], "i", 10.0, 0.5, 0.5, 5.0, 6.0, 3)
    first = out.groupBy("trial", "condition").agg(F.min(F.when(F.col("tripped"), F.col("t"))).alias("detected_at"), F.first("onset").alias("onset"))
    judged = sequential.trip_outcome(first, F.col("onset"), F.col("condition") == "dry_run")
    return judged.groupBy("condition").agg(F.avg(F.col("detected").cast("double")).alias("detected"), F.avg(F.col("false_trip").cast("double")).alias("false_trips"), F.expr("percentile(delay, 0.5)").alias("median_delay"))


@query("w18_seasonal_drift")
def seasonal_drift(spark, sf_dir, p: int = 20, days: int = 180, per_day: int = 20, drift: float = 0.01, seed: int = 0):
    """False alarms of a fixed baseline under a slow drift, by ten days."""
    names = [f"f{i}" for i in range(p)]
    fit = baseline.fit(spark.range(400).select(F.lit(1).alias("machine"), *[F.randn(seed + i).alias(n) for i, n in enumerate(names)]), ["machine"], names)
    rows = spark.range(days * per_day).select(F.lit(1).alias("machine"), (F.col("id") / per_day).cast("int").alias("day"), *[(F.randn(seed + 100 + i) + (F.col("id") / per_day).cast("int") * drift).alias(n) for i, n in enumerate(names)])
    hit = baseline.scored(rows, fit, ["machine"], names)
    return hit.groupBy((F.col("day") / 10).cast("int").alias("decade")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("hit").cast("int")).alias("alarms"), F.avg("d2").alias("d2"))


@query("a9_synthetic_features")
def synthetic_features(spark, sf_dir):
    """Features of seeded records, in long form."""
    records = waveforms.synthetic(spark, 4, 3)
    return waveforms.extracted(records, ["record", "condition"]).select("record", "condition", F.explode("features").alias("feature", "value"))


@query("m2_logistic_folds")
def logistic_folds(spark, sf_dir):
    """Accuracy and F1 of a logistic model on held-out machines, binned to three folds."""
    df = event_rows(spark, sf_dir).withColumn("label", F.when(F.col("x") > 80, "high").otherwise("low"))
    roles = splits.fold_roles(df, splits.group_folds(df, "machine", most=3), "machine")
    return metrics.report(models.evaluate(roles, models.ZOO["logistic"], ["x", "y"], "label"))


@query("m4_context_folds")
def context_folds(spark, sf_dir):
    """The same of the in-context vote with abstention."""
    df = event_rows(spark, sf_dir).withColumn("label", F.when(F.col("x") > 80, "high").otherwise("low"))
    roles = splits.fold_roles(df, splits.group_folds(df, "machine", most=3), "machine")
    return metrics.report(models.evaluate(roles, lambda seed=0: models.InContext(seed, abstain=True), ["x", "y"], "label"))


@query("e20_leakage_entries", """WITH s AS (SELECT event_type AS dataset, event_id % 3 AS rank, CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 1 + event_id % 2 ELSE event_id // 3 % 4 END AS level, avg(value) AS score FROM events GROUP BY ALL),
p AS (SELECT dataset, rank, max(score) FILTER (level = 0) AS invalid, arg_max(score, level) FILTER (level > 0) AS honest FROM s GROUP BY dataset, rank),
f AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY rank) AS i FROM p WHERE invalid IS NOT NULL AND honest IS NOT NULL)
SELECT dataset, round(invalid, 6) AS invalid, round(honest, 6) AS honest, round(invalid / honest, 6) AS inflation FROM f WHERE i = 1""")
def leakage_entries(spark, sf_dir):
    """Invalid and honest scores of each data set; the first results of one have no invalid score."""
    rank, even = F.col("event_id") % 3, F.col("event_id") % 2
    level = F.when((F.col("event_type") == "error") & (rank == 0), 1 + even).otherwise(F.expr("event_id div 3 % 4"))
    s = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("dataset"), rank.alias("rank"), level.alias("level")).agg(F.avg("value").alias("score"))
    return rounded(metrics.leakage_entries(s, "dataset", "rank", "level", "score"), "invalid", "honest", "inflation")


@query("a17_projection")
def projection(spark, sf_dir):
    """All order lines, with their flag and supplier, by two principal components of quantity, price, discount and tax."""
    features = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_suppkey", *[F.col(c).cast("double").alias(c) for c in features])
    return models.projection(rows, features).drop(*features)

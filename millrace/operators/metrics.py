"""Evaluation of predictions as aggregations.

Curves are made from one row a distinct score, in blocks of scores that are summed up on their
own (``scans``), so that continuous scores, of which there are as many as predictions, are
spread over many tasks too.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scans import carried, in_blocks, running_counts, within

ABSTAIN = "ABSTAIN"


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is."""
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def confusion(df: DataFrame, true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """(true, pred, n), without what the model abstained from; a null prediction is a wrong one."""
    return df.where(~F.col(pred).eqNullSafe(ABSTAIN)).groupBy(F.col(true).alias("true"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def per_class(counts: DataFrame) -> DataFrame:
    """True and false positives, false negatives and F1 of each class of a confusion table."""
    t = counts.select(F.col("true").alias("class"), F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("fp"), F.when(~F.col("true").eqNullSafe(F.col("pred")), F.col("n")).otherwise(0).alias("fn"))
    p = counts.where("pred is not null").select(F.col("pred").alias("class"), F.lit(0).cast("long").alias("tp"), F.when(F.col("true") != F.col("pred"), F.col("n")).otherwise(0).alias("fp"), F.lit(0).cast("long").alias("fn"))
    out = t.unionByName(p).groupBy("class").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return out.withColumns({"precision": precision, "recall": recall, "f1": f1, "support": F.col("tp") + F.col("fn")})


def report(df: DataFrame, true: str = "y_true", pred: str = "y_pred", key: Sequence[str] = ()) -> DataFrame:
    """One row, or one a key: accuracy, macro and weighted F1, coverage and abstentions (E1), all from one count by class and prediction."""
    counts = df.groupBy(*key, F.col(true).alias("true"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    gone, n = F.col("pred").eqNullSafe(ABSTAIN), F.col("n")
    same = F.col("true") == F.col("pred")
    own = F.struct(F.col("true").alias("class"), F.when(same, n).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("fp"), F.when(~F.coalesce(same, F.lit(False)), n).otherwise(0).alias("fn"), n.alias("rows"), F.lit(0).cast("long").alias("gone"))
    other = F.struct(F.col("pred").alias("class"), F.lit(0).cast("long").alias("tp"), n.alias("fp"), F.lit(0).cast("long").alias("fn"), F.lit(0).cast("long").alias("rows"), F.lit(0).cast("long").alias("gone"))
    left = F.struct(F.lit(ABSTAIN).alias("class"), *[F.lit(0).cast("long").alias(c) for c in ("tp", "fp", "fn")], n.alias("rows"), n.alias("gone"))
    parts = F.when(gone, F.array(left)).when(F.col("pred").isNull() | same, F.array(own)).otherwise(F.array(own, other))
    per = counts.select(*key, F.inline(parts)).groupBy(*key, "class").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "rows", "gone")])
    support, judged = F.col("tp") + F.col("fn"), (F.col("tp") + F.col("fp") + F.col("fn")) > 0
    f1 = F.when(judged, ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))
    total = per.groupBy(*key).agg(F.sum("tp").alias("right"), F.sum(support).alias("n"), F.avg(f1).alias("macro_f1"), F.sum(f1 * support).alias("weighted"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("gone"), F.lit(0)).alias("n_abstained"))
    return total.select(*key, ratio(F.col("right"), F.col("n")).alias("accuracy"), "macro_f1", ratio(F.col("weighted"), F.col("n")).alias("weighted_f1"), ratio(F.col("rows") - F.col("n_abstained"), F.col("rows")).alias("coverage"), "n_abstained")


def by_score(df: DataFrame, hit: Column, score: Column, key: list[str] | None = None) -> DataFrame:
    """Counts at each distinct score, and of all scores from it upwards."""
    key = key or []
    per = df.select(*key, score.alias("score"), hit.cast("int").alias("hit")).groupBy(*key, "score").agg(F.sum("hit").alias("p"), F.sum(1 - F.col("hit")).alias("q"))
    return running_counts(per, key, "score", ["p", "q"]).withColumnsRenamed({"p_upto": "tp", "q_upto": "fp", "p_all": "pos", "q_all": "neg"})


def one_vs_rest(df: DataFrame, classes: list[str], true: str, proba: str) -> DataFrame:
    """(class, hit, score), a row for each class of each prediction."""
    rows = F.array(*[F.struct(F.lit(c).alias("class"), (F.col(true) == c).alias("hit"), F.get(F.col(proba), F.lit(i)).alias("score")) for i, c in enumerate(classes)])
    return df.select(F.inline(rows))


def average_precision(df: DataFrame, classes: list[str], true: str = "y_true", proba: str = "proba") -> DataFrame:
    """Stepwise average precision of each class (E2); a class with no or only positives is left out."""
    at = by_score(one_vs_rest(df, classes, true, proba), F.col("hit"), F.col("score"), ["class"]).where("pos > 0 and neg > 0")
    return at.groupBy("class").agg(F.sum(F.col("p") / F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("ap"))


def roc_auc(df: DataFrame, classes: list[str], true: str = "y_true", proba: str = "proba") -> DataFrame:
    """Area under the ROC curve of each class by ranks, ties half."""
    at = by_score(one_vs_rest(df, classes, true, proba), F.col("hit"), F.col("score"), ["class"]).where("pos > 0 and neg > 0")
    below = F.col("neg") - F.col("fp")
    return at.groupBy("class").agg((F.sum(F.col("p") * (below + F.col("q") / 2)) / F.first(F.col("pos") * F.col("neg"))).alias("auc"))


def calibration_bins(df: DataFrame, confidence: Column, right: Column, bins: int = 10) -> DataFrame:
    """Confidence and accuracy of each of the bins (lo, hi], empty ones too (E5)."""
    index = reduce(lambda a, i: a + (F.col("c") > i / bins).cast("int"), range(1, bins), F.lit(0))
    rows = df.select(confidence.alias("c"), right.cast("double").alias("r")).where("c > 0").withColumn("bin", index)
    per = rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("c").alias("confidence"), F.avg("r").alias("accuracy"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(per, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def calibration_error(bins: DataFrame) -> DataFrame:
    """Expected calibration error of calibration bins."""
    gap = F.coalesce(F.abs(F.col("confidence") - F.col("accuracy")), F.lit(0.0))
    return bins.agg(ratio(F.sum(F.col("n") * gap), F.sum("n")).alias("ece"))


def brier(df: DataFrame, classes: list[str], true: str = "y_true", proba: str = "proba") -> DataFrame:
    """Multiclass Brier score (E6); null if a label is unknown."""
    one = F.array(*[(F.col(true) == c).cast("double") for c in classes])
    miss = F.aggregate(F.zip_with(proba, one, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x)
    known = F.min(F.col(true).isin(classes).cast("int"))
    return df.agg(F.when(known == 1, F.avg(miss)).alias("brier"))


def risk_coverage(df: DataFrame, confidence: str, right: Column, tie: str, cuts: int = 20) -> DataFrame:
    """Coverage and risk of the most confident predictions (E7), ties by ``tie``, of equal ties the right ones first.

    The confidence that holds each point's rank is found from running counts by confidence;
    only its rows are then counted by tie, both in blocks.
    """
    rows = df.select(F.col(confidence).alias("c"), F.col(tie).alias("t"), (~right).cast("long").alias("e"))
    per = running_counts(rows.groupBy("c").agg(F.count(F.lit(1)).alias("k"), F.sum("e").alias("e")), [], "c", ["k", "e"])
    n = F.col("k_all")
    ranks = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(cuts - 1)), lambda i: F.floor(1 + (n - 1) * i / (cuts - 1)).cast("long")))
    before = F.col("k_upto") - F.col("k")
    points = per.select("c", n.alias("n"), (F.col("e_upto") - F.col("e")).alias("earlier"), before.alias("before"), F.explode(F.filter(ranks, lambda r: (r > before) & (r <= F.col("k_upto")))).alias("rank"))  # a row a cut
    tied = rows.join(F.broadcast(points.select("c").distinct()), "c").groupBy("c", "t").agg(F.count(F.lit(1)).alias("k"), F.sum("e").alias("e"))
    tied = carried(in_blocks(tied, ["c"], "t"), ["c"], {"__k": F.sum("k"), "__e": F.sum("e")}, {"k0": F.sum("__k"), "e0": F.sum("__e")})
    run = within(["c"], ["t"])
    tied = tied.select("c", "k", "e", (F.coalesce("k0", F.lit(0)) + F.sum("k").over(run)).alias("upto"), (F.coalesce("e0", F.lit(0)) + F.sum("e").over(run)).alias("wrong"))
    own = F.col("rank") - F.col("before")
    held = tied.join(F.broadcast(points), "c").where((own <= F.col("upto")) & (own > F.col("upto") - F.col("k")))
    wrong = F.col("earlier") + F.col("wrong") - F.least("e", F.col("upto") - own)
    return held.select((F.col("rank") / F.col("n")).alias("coverage"), (wrong / F.col("rank")).alias("risk"))


def recall_at_far(df: DataFrame, hit: Column, score: Column, budgets: list[float]) -> DataFrame:
    """Best recall within each false-alarm budget, and its lowest threshold."""
    at = by_score(df, hit, score)
    far, recall = F.col("fp") / F.greatest("neg", F.lit(1)), F.col("tp") / F.greatest("pos", F.lit(1))
    at = at.select("score", far.alias("far"), recall.alias("recall"))
    best = at.agg(*[F.max(F.when(F.col("far") <= b, F.struct("recall", (-F.col("score")).alias("s"), "far"))).alias(f"b{i}") for i, b in enumerate(budgets)])
    rows = [F.struct(F.lit(b).alias("max_far"), F.coalesce(F.col(f"b{i}.recall"), F.lit(0.0)).alias("recall"), F.coalesce(F.col(f"b{i}.far"), F.lit(0.0)).alias("far"), F.coalesce(-F.col(f"b{i}.s"), F.lit(float("inf"))).alias("threshold")) for i, b in enumerate(budgets)]
    return best.select(F.inline(F.array(*rows)))


def stirling_error(x: Column) -> Column:
    """What Stirling's formula of ln(x!) lacks, for whole x > 0: exact ones of small x, else five terms of the series."""
    small = [math.lgamma(i + 1) - (i + 0.5) * math.log(i) + i - 0.5 * math.log(2 * math.pi) for i in range(1, 16)]
    y = x.cast("double")
    series = (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - 1 / 1188 / y / y) / y / y) / y / y) / y / y) / y
    return F.when(x < 16, F.get(F.array(*map(F.lit, small)), (x - 1).cast("int"))).otherwise(series)


def binomial_tail(n: Column, k: Column) -> Column:
    """P(X <= k) of n fair coins, for k <= n / 2.

    The largest term, by Stirling's formula and its error, times the sum of the others'
    ratios to it; beyond 8 sqrt(n) of them they are below a double's precision.
    """
    d = (n - 2 * k) / n
    bent = n / 2 * ((1 + d) * F.log1p(d) + (1 - d) * F.log1p(-d))
    logarithm = stirling_error(n) - stirling_error(k) - stirling_error(n - k) - bent + F.ln(n / (2 * math.pi * k * (n - k))) / 2
    top = F.when(k == 0, F.exp(-n * math.log(2))).otherwise(F.exp(logarithm))
    terms = F.least(k, (8 * F.sqrt(n) + 64).cast("long"))
    ks = F.when(terms > 0, F.sequence(F.lit(1).cast("long"), terms)).otherwise(F.array().cast("array<bigint>"))
    start = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))

    def step(s: Column, i: Column) -> Column:
        t = s["t"] * (k - i + 1) / (n - k + i)
        return F.struct(t.alias("t"), (s["s"] + t).alias("s"))

    return top * F.aggregate(ks, start, step, lambda s: s["s"])


def mcnemar(df: DataFrame, true: str, a: str, b: str) -> DataFrame:
    """Exact test of two models on the same rows (E12): n01, n10 and p."""
    right = lambda c: F.col(c) == F.col(true)
    n = df.agg(F.count(F.when(~right(a) & right(b), 1)).alias("n01"), F.count(F.when(right(a) & ~right(b), 1)).alias("n10"))
    n = n.withColumns({"n": F.col("n01") + F.col("n10"), "k": F.least("n01", "n10")})
    tail = binomial_tail(F.col("n"), F.col("k"))
    return n.select("n01", "n10", F.when(F.col("n") == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail)).alias("p"))


def by_severity(df: DataFrame, true: str, pred: str, severity: str, healthy: str = "healthy") -> DataFrame:
    """Detection and right class of faults by severity (E14); abstaining is not detecting."""
    faults = df.where((F.col(true) != healthy) & F.col(severity).isNotNull())
    found = (F.col(pred) != healthy) & (F.col(pred) != ABSTAIN)
    return faults.groupBy(severity).agg(F.count(F.lit(1)).alias("n"), F.avg(found.cast("double")).alias("detected"), F.avg((F.col(pred) == F.col(true)).cast("double")).alias("right_class"))


def seed_spread(df: DataFrame, key: list[str], metric: str) -> DataFrame:
    """Mean, population deviation and range over seeds."""
    return df.groupBy(*key).agg(F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("std"), F.min(metric).alias("least"), F.max(metric).alias("most"))


def leakage_inflation(df: DataFrame, key: list[str], level: str, metric: str) -> DataFrame:
    """Score at level 0 over that at the strictest level."""
    return df.groupBy(*key).agg((F.max(F.when(F.col(level) == 0, F.col(metric))) / F.max_by(metric, F.when(F.col(level) > 0, F.col(level)))).alias("inflation"))


def leakage_entries(df: DataFrame, dataset: str, rank: str, level: str, metric: str) -> DataFrame:
    """Score at level 0, at the strictest level and their quotient of each data set (E20), from its first result that has both."""
    pair = df.groupBy(dataset, rank).agg(F.max(F.when(F.col(level) == 0, F.col(metric))).alias("invalid"), F.max_by(metric, F.when((F.col(level) > 0) & F.col(metric).isNotNull(), F.col(level))).alias("honest"))
    first = F.min_by(F.struct("invalid", "honest"), rank).alias("z")
    return pair.where("invalid is not null and honest is not null").groupBy(dataset).agg(first).select(dataset, "z.*", (F.col("z.invalid") / F.col("z.honest")).alias("inflation"))


def majority(df: DataFrame, key: list[str], label: str) -> DataFrame:
    """Most frequent label of each key, the first of equals (M1)."""
    per = df.groupBy(*key, label).agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col(label).alias("l"))).alias("b")
    return per.groupBy(*key).agg(best, F.sum("n").alias("n_rows")).select(*key, F.col("b.l").alias("label"), (-F.col("b.n") / F.col("n_rows")).alias("share"))

"""Classifiers, their registry, tuning and evaluation over folds (M1-M9).

Gradient boosting here is Spark's, one tree ensemble a class; the in-context classifier is a
distance-weighted vote of a small reference table. Neither claims another library's scores.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.feature import PCA, IndexToString, StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import baseline, metrics, splits

ABSTAIN = metrics.ABSTAIN
CONTEXT_ROWS, MAX_CLASSES, LEAST_CONFIDENCE = 1000, 10, 0.45


def projection(df: DataFrame, features: list[str]) -> DataFrame:
    """df with pc1 and pc2, the first two principal components of its standardised features (A17), to be seen by class and by machine.

    Deviations are those of the population, a constant feature adds nothing, and the largest
    loading of a component is positive. Null features raise.
    """
    pairs = [(F.avg(c).alias(f"m{i}"), F.stddev_pop(c).alias(f"s{i}")) for i, c in enumerate(features)]
    at = df.agg(*[x for pair in pairs for x in pair]).first()
    scaled = df.select("*", *[((F.col(c) - at[f"m{i}"]) / (at[f"s{i}"] or 1.0)).alias(f"__f{i}") for i, c in enumerate(features)])
    whole = VectorAssembler(inputCols=[f"__f{i}" for i in range(len(features))], outputCol="__v").transform(scaled)
    model = PCA(k=2, inputCol="__v", outputCol="__p").fit(whole)
    loads = model.pc.toArray()
    sign = [1.0 if x[abs(x).argmax()] > 0 else -1.0 for x in loads.T]
    out, p = model.transform(whole), vector_to_array("__p")
    return out.select(*df.columns, *[(p[i] * sign[i]).alias(f"pc{i + 1}") for i in range(2)])


class Majority:
    """The most frequent class of the training rows (M1)."""

    def __init__(self, seed: int = 0):
        self.seed = seed

    def fit_predict(self, train: DataFrame, test: DataFrame, features: list[str], label: str) -> DataFrame:
        best = metrics.majority(train.withColumn("__one", F.lit(1)), ["__one"], label).select(F.col("label").alias("y_pred"))
        return test.crossJoin(F.broadcast(best)).withColumn("confidence", F.lit(1.0))  # one row


class Estimator:
    """A Spark estimator after scaling (M2, M3)."""

    def __init__(self, make: Callable[[int], object], seed: int = 0, **params):
        self.make, self.seed, self.params = make, seed, params

    def fit_predict(self, train: DataFrame, test: DataFrame, features: list[str], label: str) -> DataFrame:
        index = StringIndexer(inputCol=label, outputCol="__y", stringOrderType="alphabetAsc").fit(train)
        stages = [VectorAssembler(inputCols=features, outputCol="__v"), StandardScaler(inputCol="__v", outputCol="__x", withMean=True), self.make(self.seed, **self.params)]
        model = Pipeline(stages=stages).fit(index.transform(train))
        out = IndexToString(inputCol="prediction", outputCol="y_pred", labels=index.labels).transform(model.transform(test))
        sure = F.array_max(vector_to_array("probability")) if "probability" in out.columns else F.lit(1.0)
        return out.withColumn("confidence", sure).drop("__y", "__v", "__x", "rawPrediction", "probability", "prediction")


class InContext:
    """Distance-weighted vote of the nearest rows of a bounded reference table (M4, M5).

    With ``abstain``, unsure predictions are abstentions, and so are those of rows whose
    Mahalanobis distance to the reference rows has a chance below alpha; with fewer than ten
    reference rows a feature no distance is taken. Each batch of rows meets the table as
    blocks of distances; a row that lacks a feature has no vote and no prediction.
    """

    def __init__(self, seed: int = 0, context: int = CONTEXT_ROWS, k: int = 15, abstain: bool = False, alpha: float = 0.01):
        self.seed, self.context, self.k, self.abstain, self.alpha = seed, context, k, abstain, alpha

    def fit_predict(self, train: DataFrame, test: DataFrame, features: list[str], label: str, row: str = "row") -> DataFrame:
        stats = train.agg(*[x for f in features for x in (F.avg(f).alias(f"m_{f}"), F.stddev_pop(f).alias(f"s_{f}"))]).first()
        z = lambda f: (F.col(f) - (stats[f"m_{f}"] or 0.0)) / (stats[f"s_{f}"] or 1.0)
        ref = splits.stratified_context(train.select(row, label, *features), label, row, self.context, self.seed).select(F.col(label).alias("c"), F.array(*map(z, features)).alias("v"))
        held = ref.collect()  # at most `context` rows, by construction
        classes = sorted({r["c"] for r in held})
        if len(classes) > MAX_CLASSES:
            raise ValueError(f"more than {MAX_CLASSES} classes")
        points, codes = np.array([r["v"] for r in held], float), np.array([classes.index(r["c"]) for r in held])
        k, n = min(self.k, len(held)), len(classes)
        mu = inverse = threshold = None
        if self.abstain:
            near_context = train.sparkSession.createDataFrame([tuple(r["v"]) for r in held], ", ".join(f"`{f}` double" for f in features))
            base = baseline.fit(near_context, [], features, self.alpha).first()  # the one row of no key
            if base["factor"] is not None:
                mu, inverse, threshold = np.array(base["mu"]), np.array(base["factor"]), base["threshold"]

        @F.pandas_udf("confidence double, best int, far boolean")
        def vote(*columns: pd.Series) -> pd.DataFrame:
            q, votes = np.column_stack([c.to_numpy(float) for c in columns]), np.zeros((len(columns[0]), n))
            for at in range(0, len(q), 64):  # a block's distances fit in a core's cache
                part = q[at : at + 64]
                d = np.zeros((len(part), len(points)))
                for j in range(points.shape[1]):
                    apart = points[:, j] - part[:, j : j + 1]
                    apart *= apart
                    d += apart
                rows, refs = np.divmod(np.flatnonzero(d <= np.partition(d, k - 1, axis=1)[:, k - 1 : k]), len(points))
                far, own = d[rows, refs], codes[refs]
                order = np.lexsort((own, far, rows))  # of equal distances the first class
                rows, far, own = rows[order], far[order], own[order]
                near = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
                votes[at : at + 64] = np.bincount(rows[near] * n + own[near], 1 / (far[near] + 1e-9), len(part) * n).reshape(-1, n)
            total = votes.sum(axis=1)
            voted = total > 0  # not so where a feature is missing
            best = n - 1 - votes[:, ::-1].argmax(axis=1)  # of equal votes the last class
            sure = np.where(voted, votes.max(axis=1) / np.where(voted, total, 1.0), np.nan)
            outside = (((q - mu) @ inverse.T) ** 2).sum(axis=1) > threshold if inverse is not None else np.zeros(len(q), bool)
            return pd.DataFrame({"confidence": sure, "best": pd.Series(best).where(voted).astype("Int32"), "far": outside})

        out = test.withColumn("__vote", vote(*map(z, features)))
        out = out.withColumns({"confidence": F.col("__vote.confidence"), "y_pred": F.get(F.array(*map(F.lit, classes)), F.col("__vote.best")), "__far": F.col("__vote.far")}).drop("__vote")
        return (abstaining(out, far="__far") if self.abstain else out).drop("__far")


def abstaining(df: DataFrame, least: float = LEAST_CONFIDENCE, far: str | None = None) -> DataFrame:
    """Unsure or far-off predictions as abstentions (M5)."""
    unsure = F.col("confidence") < least
    if far:
        unsure |= F.coalesce(F.col(far), F.lit(False))
    return df.withColumn("y_pred", F.when(unsure, ABSTAIN).otherwise(F.col("y_pred")))


def _logistic(seed: int, reg: float = 0.01):
    return LogisticRegression(featuresCol="__x", labelCol="__y", family="multinomial", regParam=reg, elasticNetParam=0.0, standardization=False, maxIter=100)


def _forest(seed: int, trees: int = 50, depth: int = 6):
    return RandomForestClassifier(featuresCol="__x", labelCol="__y", numTrees=trees, maxDepth=depth, seed=seed)


def _gbt_ovr(seed: int, trees: int = 10, depth: int = 4):
    return OneVsRest(classifier=GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed), featuresCol="__x", labelCol="__y")


#: Factories by name, each of a seed (M7).
ZOO: dict[str, Callable] = {
    "majority": Majority,
    "logistic": lambda seed=0, **p: Estimator(_logistic, seed, **p),
    "forest": lambda seed=0, **p: Estimator(_forest, seed, **p),
    "gbt_ovr": lambda seed=0, **p: Estimator(_gbt_ovr, seed, **p),
    "context": InContext,
    "context_abstain": lambda seed=0, **p: InContext(seed, abstain=True, **p),
}


def evaluate(roles: DataFrame, factory: Callable, features: list[str], label: str, seed: int = 0, strategy: str = "train_pooled") -> DataFrame:
    """Predictions over all folds (M6, M9). Folds are few and each is a distributed fit."""
    scaled = splits.normalised(roles, features, strategy)
    out = None
    for fold in sorted(r["fold"] for r in roles.select("fold").distinct().collect()):
        part = scaled.where(F.col("fold") == fold)
        got = factory(seed=seed).fit_predict(part.where("role = 'train'"), part.where("role = 'test'"), features, label)
        got = got.select("fold", "row", F.col(label).alias("y_true"), "y_pred", "confidence")
        out = got if out is None else out.unionByName(got)
    return out


def evaluate_repeated(df: DataFrame, factory: Callable, group: str, features: list[str], label: str, seeds: Sequence[int] = (0, 1, 2), strategy: str = "train_pooled", most: int = 10) -> DataFrame:
    """Predictions over the folds of every seed (M9): seed, fold, row, y_true, y_pred, confidence. Seeds are few."""
    out = None
    for seed in seeds:
        folds = splits.group_folds(df, group, seed, most)
        scaled = splits.normalised_folds(df, folds, group, features, strategy, group).persist()
        for fold in sorted(r["fold"] for r in folds.select("fold").distinct().collect()):
            part = scaled.where(F.col("fold") == fold)
            got = factory(seed=seed).fit_predict(part.where("role = 'train'"), part.where("role = 'test'"), features, label)
            got = got.select(F.lit(seed).alias("seed"), "fold", "row", F.col(label).alias("y_true"), "y_pred", "confidence")
            out = got if out is None else out.unionByName(got)
    return out


def fold_reports(predictions: DataFrame) -> DataFrame:
    """Report of each seed and fold (M9), with the rows that it tests."""
    n = predictions.groupBy("seed", "fold").agg(F.count(F.lit(1)).alias("n_test"))
    return metrics.report(predictions, key=["seed", "fold"]).join(n, ["seed", "fold"])


def seed_reports(predictions: DataFrame) -> DataFrame:
    """Mean, deviation and range over seeds of each seed's report on all its folds (M9)."""
    per = metrics.report(predictions, key=["seed"])
    long = per.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("accuracy", "macro_f1", "weighted_f1", "coverage")])))
    return metrics.seed_spread(long, ["metric"], "value")


def machine_probe(df: DataFrame, features: list[str], machine: str, row: str, margin: float = 0.25, seed: int = 0) -> DataFrame:
    """Whether features tell machines apart (L13): one row of accuracy out of fold, chance and encodes.

    A forest predicts the machine in three folds, or as many as the smallest machine has rows;
    each machine's rows are dealt evenly to the folds by their hash. Below 20 rows, or with one
    machine, nothing is fitted and accuracy is 0.
    """
    sizes = df.groupBy(machine).agg(F.count(F.lit(1)).alias("k")).agg(F.count(F.lit(1)).alias("machines"), F.sum("k").alias("n"), F.min("k").alias("least")).first()
    folds, chance = min(3, sizes["least"] or 0), 1 / max(sizes["machines"], 1)
    correct = None
    if sizes["machines"] > 1 and sizes["n"] >= 20 and folds >= 2:
        by = F.row_number().over(Window.partitionBy(machine).orderBy(splits.portable_hash(F.col(row), seed), row))
        dealt = df.select(F.col(machine).cast("string").alias("__machine"), *features, (by % folds).alias("__fold")).persist()
        for f in range(folds):
            model = Estimator(_forest, seed)
            got = model.fit_predict(dealt.where(F.col("__fold") != f), dealt.where(F.col("__fold") == f), features, "__machine")
            own = got.agg(F.avg((F.col("y_pred") == F.col("__machine")).cast("double")).alias("accuracy"))
            correct = own if correct is None else correct.unionByName(own)
    else:
        correct = df.sparkSession.range(1).select(F.lit(0.0).alias("accuracy"))
    return correct.agg(F.avg("accuracy").alias("accuracy")).select("accuracy", F.lit(chance).alias("chance"), (F.col("accuracy") >= chance + margin).alias("encodes_machine"))


def tuned(train: DataFrame, factory: Callable, grid: list[dict], features: list[str], label: str, machine: str = "machine", k: int = 3, seed: int = 0) -> dict:
    """The grid point with the best macro F1 over inner folds of machines (M8); the first of equals, no search without a choice."""
    roles = splits.inner_folds(train.withColumns({"fold": F.lit(0), "role": F.lit("train")}), machine, k, seed)
    if len(grid) <= 1 or roles.isEmpty():
        return grid[0] if grid else {}
    inner = roles.select(F.col(machine).alias("group"), F.col("inner").alias("fold"))
    parts = splits.fold_roles(train, inner, machine).persist()
    best, score = grid[0], float("-inf")
    for params in grid:
        got = evaluate(parts, lambda seed=seed, p=params: factory(seed=seed, **p), features, label, seed)
        f1 = metrics.report(got).first()["macro_f1"]
        if f1 is not None and f1 > score + 1e-12:
            best, score = params, f1
    parts.unpersist()
    return best


def model_pairs(names: list[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]


def top_k(df: DataFrame, key: list[str], by: str, k: int, tie: Sequence[str] = ()) -> DataFrame:
    """The k highest rows of each key (J10), of equals the first by ``tie``, or by all columns that can be ordered."""
    tie = list(tie) or [c for c, kind in df.dtypes if c not in (*key, by) and not kind.startswith("map")]
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(by), *tie))).where(F.col("__r") <= k).drop("__r")

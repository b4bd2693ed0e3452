"""Healthy baselines and the gates that use them.

A baseline is one row a machine: means, deviations, the inverse Cholesky factor of the
covariance and the thresholds. Sums of products are aggregated in one pass; only those
rows, one a machine and of at most p squared numbers, meet Python, in an Arrow UDF that
factors them where they are.
"""

from __future__ import annotations

from math import exp, lgamma, log, sqrt
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import sequential as seq

RIDGE = 1e-6


def gamma_cdf(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function, by series or continued fraction."""
    if x <= 0:
        return 0.0
    front = exp(a * log(x) - x - lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-17 * total:
            n += 1
            term *= x / n
            total += term
        return front * total
    tiny, b = 1e-300, x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 1000):
        k = -i * (i - a)
        b += 2
        d, c = 1 / (k * d + b or tiny), b + k / (c or tiny)
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return 1 - front * h


def chi2_quantile(p: float, df: int) -> float:
    """By bisection; accurate to the last digits of a double."""
    lo, hi = 0.0, max(10.0, 4.0 * df)
    while gamma_cdf(df / 2, hi / 2) < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if gamma_cdf(df / 2, mid / 2) < p else (lo, mid)
    return (lo + hi) / 2


def ewma_sigmas(p: int, alpha: float = 0.01) -> float:
    """Two-sided quantile with a family rate of alpha over p features."""
    return NormalDist().inv_cdf(1 - alpha / (2 * p))


def fit(df: DataFrame, key: list[str], features: list[str], alpha: float = 0.01, least_per_feature: int = 10, strict: bool = False) -> DataFrame:
    """One baseline a key: n, mu, sigma (population), factor (rows of the inverse Cholesky factor), threshold, status.

    The covariance is the sample's with a small ridge. ``status`` is 'ok' from
    10 rows a feature (more than that if strict), else 'short', without a factor. With
    ``least_per_feature=0`` no key is short, but one row has no covariance and no factor.
    """
    p = len(features)
    pairs = [(i, j) for i in range(p) for j in range(i + 1)]
    sums = df.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.avg(f) for f in features]).alias("mu"),
        F.array(*[F.stddev_pop(f) + 1e-12 for f in features]).alias("sigma"),
        F.array(*[F.covar_samp(features[i], features[j]) for i, j in pairs]).alias("cov"),
    )
    need = least_per_feature * p

    @F.pandas_udf("array<array<double>>")
    def factor(cov: pd.Series) -> pd.Series:
        def one(c):
            if c is None or np.isnan(np.asarray(c, float)).any():
                return None
            m = np.zeros((p, p))
            for (i, j), v in zip(pairs, c, strict=True):
                m[i, j] = m[j, i] = v
            m += RIDGE * np.eye(p)
            try:
                return np.linalg.inv(np.linalg.cholesky(m)).tolist()
            except np.linalg.LinAlgError:  # rounding may leave the covariance of two or three rows indefinite
                w, v = np.linalg.eigh(m)
                return (v / np.sqrt(np.maximum(w, RIDGE))).T.tolist()

        return cov.map(one)

    enough = F.col("n") > need if strict else F.col("n") >= need
    out = sums.withColumn("status", F.when(enough, "ok").otherwise("short"))
    out = out.withColumn("factor", F.when(F.col("status") == "ok", factor("cov")))
    return out.withColumn("threshold", F.lit(chi2_quantile(1 - alpha, p))).drop("cov")


def fit_subsets(df: DataFrame, key: list[str], features: list[str], subsets: list[tuple[int, ...]], least_per_feature: int = 10) -> DataFrame:
    """mu and, for each subset of features, the inverse Cholesky factor of its part of one covariance; null where rows are too few for it."""
    p = len(features)
    pairs = [(i, j) for i in range(p) for j in range(i + 1)]
    sums = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.avg(f) for f in features]).alias("mu"), F.array(*[F.covar_samp(features[i], features[j]) for i, j in pairs]).alias("cov"))

    @F.pandas_udf("array<array<array<double>>>")
    def factors(n: pd.Series, cov: pd.Series) -> pd.Series:
        def all_of(k, c):
            m = np.zeros((p, p))
            for (i, j), v in zip(pairs, np.asarray(c, float), strict=True):
                m[i, j] = m[j, i] = v
            parts = [(k >= least_per_feature * len(s), m[np.ix_(s, s)]) for s in subsets]
            return [np.linalg.inv(np.linalg.cholesky(q + RIDGE * np.eye(len(q)))).tolist() if enough and not np.isnan(q).any() else None for enough, q in parts]

        return pd.Series([all_of(k, c) for k, c in zip(n, cov, strict=True)], dtype=object)

    return sums.select(*key, "mu", factors("n", "cov").alias("factors"))


def distance(features: list[str], mu: Column, factor: Column) -> Column:
    """Squared Mahalanobis distance: the length of the factored difference."""
    d = F.zip_with(F.array(*[F.col(f).cast("double") for f in features]), mu, lambda a, b: a - b)
    dot = lambda row: F.aggregate(F.zip_with(row, d, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return F.aggregate(F.transform(factor, lambda row: dot(row) * dot(row)), F.lit(0.0), lambda s, v: s + v)


def scored(df: DataFrame, base: DataFrame, key: list[str], features: list[str]) -> DataFrame:
    """df with d2 and hit; rows of keys without a factor have neither."""
    out = df.join(base.select(*key, "mu", "factor", "threshold", "status"), key)
    out = out.withColumn("d2", F.when(F.col("status") == "ok", distance(features, F.col("mu"), F.col("factor"))))
    return out.withColumn("hit", F.col("d2") > F.col("threshold")).drop("mu", "factor", "threshold", "status")


def composite(df: DataFrame, base: DataFrame, key: list[str], order: list[str], features: list[str], current: str | None = None, state: str | None = None, weight: float = 0.2, k: float = 0.5, h: float = 5.0, alpha: float = 0.01) -> DataFrame:
    """Any of EWMA, CUSUM of the current and Mahalanobis (W9): escalate and reasons in that order.

    Where a state is given, rows that don't run escalate nothing and move no gate: they
    are left out of the sums and joined to their reason by a union. Where a key that is
    judged has no factor, escalate is null unless another gate says so.
    """
    rows = df.join(base.select(*key, "mu", "sigma", "factor", "threshold", "status"), key)
    rest = None
    if state:
        rest, rows = rows.where(F.col(state) != "running"), rows.where(F.col(state) == "running")
    n_sigma, over = ewma_sigmas(len(features), alpha), F.lit(False)
    for i, f in enumerate(features):
        rows = rows.withColumns({"__m": F.get("mu", F.lit(i)), "__s": F.get("sigma", F.lit(i))})
        rows = seq.ewma(rows, key, order, f, F.col("__m"), weight, f"__z{i}")
        rows = rows.withColumn(f"__e{i}", seq.ewma_score(F.col(f"__z{i}"), F.col("__m"), F.col("__s"), weight) > n_sigma)
        over |= F.col(f"__e{i}")
    rows = rows.withColumn("__ewma", over)
    if current in features:
        i = features.index(current)
        rows = rows.withColumns({"__m": F.get("mu", F.lit(i)), "__s": F.get("sigma", F.lit(i))})
        rows = seq.cusum(rows, key, order, F.col(current), F.col("__m"), F.col("__s"), k, h).withColumn("__cusum", F.col("hit")).drop("s_neg", "s_pos", "score", "hit")
    else:
        rows = rows.withColumn("__cusum", F.lit(False))
    far = F.when(F.col("factor").isNotNull(), F.coalesce(distance(features, F.col("mu"), F.col("factor")) > F.col("threshold"), F.lit(False)))
    rows = rows.withColumn("__far", F.when(F.col("status") == "ok", far).otherwise(F.lit(False)))
    named = F.array(*[F.when(F.col(c), F.lit(n)) for c, n in (("__ewma", "ewma"), ("__cusum", "cusum_current"), ("__far", "mahalanobis"))])
    rows = rows.withColumns({"escalate": F.col("__ewma") | F.col("__cusum") | F.col("__far"), "reasons": F.filter(named, lambda x: x.isNotNull())}).select(*df.columns, "escalate", "reasons")
    if rest is None:
        return rows
    why = F.when(F.col(state) == "unknown", "run_state_unknown").otherwise("not_running")
    return rows.unionByName(rest.select(*df.columns, F.lit(False).alias("escalate"), F.array(why).alias("reasons")))


def gate_rates(df: DataFrame, key: list[str], label: str, healthy: str, prevalence: float = 0.01) -> DataFrame:
    """Escalation of all, healthy and faulty rows and in the field."""
    hit, well = F.col("escalate").cast("double"), F.col(label) == healthy
    out = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("overall"), F.avg(F.when(well, hit)).alias("healthy_rate"), F.avg(F.when(~well, hit)).alias("fault_rate"), F.count(F.when(~well, 1)).alias("n_faults"))
    return out.withColumn("field", F.coalesce(F.col("healthy_rate"), F.lit(0.0)) * (1 - prevalence) + F.coalesce(F.col("fault_rate"), F.lit(0.0)) * prevalence)


def half_for_baseline(df: DataFrame, key: list[str], label: str, healthy: str, row: str, least: int = 10, seed: int = 0) -> DataFrame:
    """Role fit for half of each machine's healthy rows by hash order, else evaluate (W19); machines with few are left out."""
    from .splits import portable_hash

    well = F.col(label) == healthy
    per = Window.partitionBy(*key)
    out = df.withColumn("__n", F.count(F.when(well, 1)).over(per)).where(F.col("__n") >= least)
    rank = F.row_number().over(Window.partitionBy(*key, well).orderBy(portable_hash(F.col(row), seed), row))
    out = out.withColumn("__r", rank)
    return out.withColumn("role", F.when(well & (F.col("__r") <= F.floor(F.col("__n") / 2)), "fit").otherwise("evaluate")).drop("__n", "__r")


def summary(rates: DataFrame) -> DataFrame:
    """Mean, fault-weighted and worst recall ceiling over machines with faults, and how many have none."""
    has = F.col("n_faults") > 0
    return rates.agg(F.avg("field").alias("field"), F.avg(F.when(has, F.col("fault_rate"))).alias("mean_ceiling"), (F.sum(F.when(has, F.col("fault_rate") * F.col("n_faults"))) / F.sum("n_faults")).alias("pooled_ceiling"),
                     F.min(F.when(has, F.col("fault_rate"))).alias("worst_ceiling"), F.count(F.when(~has, 1)).alias("without_faults"))


def sigma_of_weighted_mean(sigma: float, weight: float) -> float:
    return sigma * sqrt(weight / (2 - weight))

"""What ties the operators together: feature choice, ladders of splits, intervals, ablations and tables."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import baseline, sequential, splits
from .scans import kept, meet

#: Features that a gate may use, by kind of data.
GATE_SETS = {
    "waveform": ["iso_vel_rms_mm_s", "vib_rms", "vib_kurtosis", "order_1x", "order_2x", "band_1_2k", "current_rms_ratio", "mcsa_sb_1x_sum"],
    "published": ["peak1x", "peak2x", "rms(98,102)", "median(98,102)", "median(8,13)"],
    "order_spectrum": ["overall_level_mm_s", "order_1p0x", "order_2p0x", "band_sub_synchronous", "band_above_2x", "ratio_2x_1x", "spectral_entropy"],
}
VIBRATION = ("vib_", "order_", "vpf", "envelope_", "spectral_", "band_", "iso_")


def gate_features(columns: list[str], wanted: list[str] | None = None, kind: str | None = None) -> list[str]:
    """Features of a gate (P5): the wanted, those of a kind, or those of the set with most hits, the first of equals."""
    if wanted is None:
        wanted = GATE_SETS[kind] if kind else max(GATE_SETS.values(), key=lambda s: sum(f in columns for f in s))
    found = [f for f in wanted if f in columns]
    if not found:
        raise ValueError(f"no gate features among {sorted(columns)[:5]}")
    return found


def profile(df: DataFrame, kind: str = "full") -> DataFrame:
    """All features, or only those of the current."""
    return df if kind == "full" else df.select(*[c for c in df.columns if not c.startswith(VIBRATION)])


def ladder(df: DataFrame, keys: dict[str, str], seed: int = 0) -> dict[str, DataFrame]:
    """Folds by rung (L4): a rung is left out where its key is missing, single-valued or has an empty value."""
    out = {}
    for rung, key in keys.items():
        if key not in df.columns:
            continue
        found = df.agg(F.countDistinct(key).alias("n"), F.count(F.when(F.col(key).isNull() | (F.col(key).cast("string") == ""), 1)).alias("bad")).first()
        if found["n"] >= 2 and not found["bad"]:
            out[rung] = splits.group_folds(df, key, seed, 0 if rung == "machine" else 10)
    return out


def assert_not_confounded(table: DataFrame, label: str, group: str, most: float = 0.5) -> None:
    """Raise where a class lives on one group or class and group tell each other."""
    if table.select(group).distinct().count() < 2:
        return
    alone = [r[label] for r in splits.single_group_classes(table, label, group).collect()]
    told = splits.mutual_information(table, label, group).first()["nmi"]
    if alone or told >= most:
        raise ValueError(f"confounded: classes on one group {alone}, mutual information {told:.3f}")


def fault_score(proba: Column, classes: list[str], healthy: str = "healthy") -> Column:
    """1 - P(healthy), and 1 where that class is absent."""
    return 1 - F.get(proba, F.lit(classes.index(healthy))) if healthy in classes else F.lit(1.0)


#: Poisson(1) by inversion: how often a number from 0 to 1 exceeds these.
POISSON_STEPS = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(8)])


def draws_of(rows: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """How often each replicate draws each row: a hash of both that any engine computes, taken as a number from 0 to 1."""
    word = np.uint64(0xFFFFFFFF)
    x = (rows.astype(np.int64).astype(np.uint64)[:, None] * np.uint64(2654435761) + np.arange(replicates, dtype=np.uint64) * np.uint64(40503) + np.uint64(seed)) & word
    for shift, times in ((16, 2246822519), (13, 3266489917)):
        x ^= x >> np.uint64(shift)
        x = (x * np.uint64(times)) & word
    x ^= x >> np.uint64(16)
    return np.searchsorted(POISSON_STEPS, x.astype(np.float64) / 4294967296.0, side="left")


def bootstrap(df: DataFrame, value: str, draws: int = 1000, alpha: float = 0.05, seed: int = 0, row: str | None = None) -> DataFrame:
    """Percentile interval of the mean (E13): each row is drawn Poisson(1) times in each replicate.

    A task keeps two arrays of sums, a number a replicate, whatever its rows, and only these
    meet. ``row`` is a whole number of each row, below 2^31, that makes reruns equal; without
    one a row's place is taken. Rows without a value count for nothing.
    """
    rows = df.select(F.col(value).cast("double").alias("v"), (F.pmod(F.col(row).cast("long"), F.lit(1 << 31)) if row else F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 31))).alias("k"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, times = np.zeros(draws), np.zeros(draws, np.int64)
        for batch in batches:
            v, k = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for at in range(0, len(v), 1000):
                w = draws_of(k[at : at + 1000], draws, seed)
                sums += v[at : at + 1000] @ w
                times += w.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(draws), pa.int32()), pa.array(sums), pa.array(times)], ["b", "s", "t"])

    parts = rows.where("v is not null and k is not null").mapInArrow(run, "b int, s double, t long")
    means = parts.groupBy("b").agg((F.sum("s") / F.nullif(F.sum("t"), F.lit(0))).alias("m"))
    return means.agg(F.expr(f"percentile(m, {alpha / 2})").alias("low"), F.expr(f"percentile(m, {1 - alpha / 2})").alias("high"), F.avg("m").alias("mean"))


def gate_ablation(df: DataFrame, key: list[str], features: list[str], label: str, healthy: str, row: str, least: int = 1) -> DataFrame:
    """Mean and worst recall ceiling of every subset of features.

    One scan fits the means and the covariance of all features for each machine; a subset's
    inverse factor comes from its part of that covariance, so that each row is scored by all
    subsets where it lies. Subsets are at most 2^p - 1 of few features.
    """
    subsets = [s for k in range(least, len(features) + 1) for s in combinations(range(len(features)), k)]
    parts = baseline.half_for_baseline(df, key, label, healthy, row)
    fits = baseline.fit_subsets(parts.where("role = 'fit'"), key, features, subsets)
    rows = meet(parts.where("role = 'evaluate'"), fits, key)
    well = (F.col(label) == healthy).alias("well")
    hits = []
    for i, s in enumerate(subsets):
        names = [features[j] for j in s]
        mu = F.array(*[F.get("mu", F.lit(j)) for j in s])
        factor = F.get("factors", F.lit(i))
        far = baseline.distance(names, mu, factor) > baseline.chi2_quantile(0.99, len(s))
        hits.append(F.struct(F.lit(len(s)).alias("size"), F.lit(",".join(names)).alias("features"), F.when(factor.isNotNull(), far).alias("escalate")))
    out = rows.select(*key, well, F.inline(F.array(*hits)))
    hit = F.col("escalate").cast("double")
    rates = out.groupBy("size", "features", *key).agg(F.avg(F.when(F.col("well"), hit)).alias("healthy_rate"), F.avg(F.when(~F.col("well"), hit)).alias("fault_rate"), F.count(F.when(~F.col("well"), 1)).alias("n_faults"))
    field = F.coalesce("healthy_rate", F.lit(0.0)) * 0.99 + F.coalesce("fault_rate", F.lit(0.0)) * 0.01
    ceiling = F.when(F.col("n_faults") > 0, F.col("fault_rate"))
    return rates.groupBy("size", "features").agg(F.avg(ceiling).alias("mean_ceiling"), F.min(ceiling).alias("worst_ceiling"), F.avg(field).alias("field"))


def per_machine_gate(df: DataFrame, key: list[str], order: list[str], features: list[str], label: str, healthy: str, row: str, current: str | None = None, prevalence: float = 0.01, safety: float = 1.5) -> DataFrame:
    """Each machine's composite gate, commissioned on half of its healthy rows and judged on the rest and all faults.

    Features are z-scores by the commissioning rows (deviations below 1e-9 count as 1). Kept healthy
    rows pass the gate first and faults after them, each in ``order``, as EWMA and CUSUM carry state.
    One row a machine: status, n_fit, required, adequate, the rates of ``gate_rates``, and how many
    rows each reason stood for. Machines with fewer than 10 healthy rows have the status ``few healthy``
    and nulls; up to 10 rows a feature the distance is left out of the gate (``short``), which the other two still make.
    """
    need = math.ceil(10 * len(features) * safety)
    known = df.select(*key).distinct()
    parts = baseline.half_for_baseline(df, key, label, healthy, row)
    per, fits = Window.partitionBy(*key), F.col("role") == "fit"
    stats = {f"__{n}_{c}": of(F.when(fits, F.col(c))).over(per) for c in features for n, of in (("m", F.avg), ("s", F.stddev_pop))}
    z = {c: (F.col(c) - F.col(f"__m_{c}")) / F.when(F.col(f"__s_{c}") < 1e-9, 1.0).otherwise(F.col(f"__s_{c}")) for c in features}
    parts = parts.withColumns(stats).withColumns(z).withColumn("__fault", F.coalesce((F.col(label) != healthy).cast("int"), F.lit(1))).drop(*stats)
    base = baseline.fit(parts.where(fits), key, features, strict=True)
    judged = kept(baseline.composite(parts.where("role = 'evaluate'"), base, key, ["__fault", *order], features, current).select(*key, label, "escalate", "reasons"))
    rates = baseline.gate_rates(judged, key, label, healthy, prevalence)
    reasons = judged.groupBy(*key).agg(*[F.count(F.when(F.array_contains("reasons", r), 1)).alias(f"by_{r}") for r in ("ewma", "cusum_current", "mahalanobis")])
    out = meet(meet(meet(known, base.select(*key, "status", F.col("n").alias("n_fit")), key), rates, key), reasons, key)
    return out.withColumns({"status": F.coalesce("status", F.lit("few healthy")), "required": F.lit(need), "adequate": F.col("n_fit") >= need})


#: Alarm rules of k of the last n windows.
RULES = ((1, 1), (2, 3), (3, 5), (5, 10))


def commissioning_protocol(windows: DataFrame, key: list[str], day: str, order: list[str], load: str, features: list[str], vibration: str, window_s: float = 60.0, rules: tuple = RULES, current: str | None = None, dwell: int = 2,
                           safety: float = 1.5, hours_per_day: float = 3.0, most_growth: float = 2.0) -> DataFrame:
    """Commission each machine of unlabelled plant data and count what it would have alarmed (W21), one row a machine.

    ``windows`` are means of blocks of readings (``sequential.blocks``), read three times; running windows
    and their escalations are checkpointed, as several branches read them. On and off levels come from all of a machine's loads, run states start
    anew each day, the first day with enough running windows of its own commissions the composite gate,
    and only strictly later days are judged, through which the gate's state carries on. Each rule's
    alarms forget on firing; ``per_month_*`` are at ``hours_per_day``. Every escalation counts as a false
    one, an upper bound that ``verdict`` calls undecidable where the median of ``vibration`` grew more
    than ``most_growth`` times from the first running day to the last.

    status: ``never runs`` or ``one mode`` (no levels), ``uncommissionable`` (no day has enough), ``no
    later rows`` (nothing ran after it), else ``commissioned``. Rows without a machine or day are left out.
    """
    need = math.ceil(10 * len(features) * safety)
    rows = windows.dropna(subset=[*key, day])
    levels = sequential.run_thresholds(sequential.otsu(rows, key, load)).select(*key, "status", "on", "off")
    loaded = rows.join(levels.where("status = 'ok'").select(*key, "on", "off"), key)
    states = sequential.run_state(loaded, [*key, day], order, load, F.col("on"), F.col("off"), dwell, "__state")
    running = kept(states.where("__state = 'running'").select(*dict.fromkeys([*key, day, *order, *features, vibration])))
    days = running.groupBy(*key, day).agg(F.count(F.lit(1)).alias("__n"), F.percentile(vibration, F.lit(0.5)).alias("__m"))
    enough, of_day = F.min(F.when(F.col("__n") >= need, F.struct(F.col(day).alias("day"), F.col("__n").alias("n")))), F.struct(F.col(day).alias("day"), F.col("__m").alias("m"))
    chosen = days.groupBy(*key).agg(enough.alias("__c"), F.max("__n").alias("best"), F.min(of_day).alias("__d0"), F.max(of_day).alias("__d1"))
    growth = F.when((F.col("__d0.day") < F.col("__d1.day")) & (F.col("__d0.m") != 0), F.col("__d1.m") / F.col("__d0.m"))
    chosen = chosen.select(*key, F.col("__c.day").alias("commissioned_on"), F.col("__c.n").alias("n_commissioning"), "best", growth.alias("growth"))

    since = running.join(chosen.where("commissioned_on is not null").select(*key, F.col("commissioned_on").alias("__on")), key)
    base = baseline.fit(since.where(F.col(day) == F.col("__on")), key, features, strict=True)
    judged = baseline.composite(since.where(F.col(day) > F.col("__on")), base, key, [day, *order], features, current)
    judged = kept(judged.select(*key, day, *order, "escalate"))
    rates = judged.groupBy(*key).agg(F.count(F.lit(1)).alias("n_evaluated"), F.avg(F.col("escalate").cast("double")).alias("escalation_rate"))
    fired = sequential.alarms_of_rules(judged, key, [day, *order], "escalate", rules, blocks=0)
    fired = fired.groupBy(*key).agg(*[F.max(F.when((F.col("k") == k) & (F.col("n") == n), F.col("alarms"))).alias(f"alarms_{k}of{n}") for k, n in rules])
    out = meet(meet(meet(meet(rows.select(*key).distinct(), levels, key), chosen, key), rates, key), fired, key)
    seen = F.col("n_evaluated").isNotNull()
    status = F.when(F.col("status") != "ok", F.col("status")).when(F.col("status").isNull(), "never runs").when(F.col("commissioned_on").isNull(), "uncommissionable").when(~seen, "no later rows").otherwise("commissioned")
    out = out.withColumns({"status": status, "required": F.lit(need), "best": F.coalesce("best", F.lit(0)), "hours": F.col("n_evaluated") * window_s / 3600})
    monthly = {f"per_month_{k}of{n}": F.col(f"alarms_{k}of{n}") / F.col("hours") * (hours_per_day * 30) for k, n in rules}
    return out.withColumns(monthly | {"verdict": F.when(seen, F.when(F.col("growth") > most_growth, "undecidable").otherwise("upper bound"))}).drop("on", "off")


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A report table (E17); reports have a few rows, and more than ``most`` raise."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("a report has too many rows")
    show = lambda v: "" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns), *("| " + " | ".join(map(show, r)) + " |" for r in rows)])

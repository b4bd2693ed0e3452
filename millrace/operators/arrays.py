"""Waveforms and spectra as array expressions (A1-A5, A7, A10-A12), and the shaft peak.

Arrays stay in their row: a window of samples is one value, and every feature is a fold over
it. Folds that several features share are made once, as columns.
"""

from __future__ import annotations

from functools import reduce
from math import cos, pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TINY = 1e-30
LEAST_CURRENT = 1e-12


def total(x: Column, f=lambda v: v) -> Column:
    return F.aggregate(F.transform(x, lambda v: f(v.cast("double"))), F.lit(0.0), lambda a, v: a + v)


def mean(x: Column, f=lambda v: v) -> Column:
    return total(x, f) / F.size(x)


def time_features(df: DataFrame, x: str) -> DataFrame:
    """Struct ``time`` of a waveform's moments and shape factors (A1); population moments, excess kurtosis."""
    w = F.col(x)
    base = F.struct(mean(w).alias("mean"), F.sqrt(mean(w, lambda v: v * v)).alias("rms"), mean(w, F.abs).alias("size"), mean(w, lambda v: F.sqrt(F.abs(v))).alias("root"),
                    F.array_max(F.transform(w, lambda v: F.abs(v.cast("double")))).alias("peak"), (F.array_max(w).cast("double") - F.array_min(w).cast("double")).alias("pp"))
    df = df.withColumn("__b", base)
    m = F.col("__b.mean")
    sd = F.sqrt(mean(w, lambda v: (v - m) * (v - m))) + 1e-12
    df = df.withColumn("__sd", sd)
    b = lambda n: F.col(f"__b.{n}")
    z = lambda p: mean(w, lambda v: F.pow((v - m) / F.col("__sd"), F.lit(p)))
    out = F.struct(b("rms").alias("rms"), b("peak").alias("peak"), b("pp").alias("peak_to_peak"), F.col("__sd").alias("std"), (z(4.0) - 3).alias("kurtosis"), z(3.0).alias("skewness"),
                   (b("peak") / (b("rms") + TINY)).alias("crest"), (b("rms") / (b("size") + TINY)).alias("shape"), (b("peak") / (b("size") + TINY)).alias("impulse"), (b("peak") / (b("root") * b("root") + TINY)).alias("clearance"))
    return df.withColumn("time", out).drop("__b", "__sd")


def power_spectrum(x: Column, n: int) -> Column:
    """Power of the Hann-windowed transform of n samples, n div 2 + 1 bins (A2).

    Written out over the samples, which beats a Python worker for short windows; the table
    of angles is a literal. Longer windows take ``operators.waveforms``.
    """
    hann = F.array(*[F.lit(0.5 - 0.5 * cos(2 * pi * i / (n - 1))) for i in range(n)])
    w = F.zip_with(F.transform(x, lambda v: v.cast("double")), hann, lambda a, b: a * b)

    def power(k: Column) -> Column:
        part = lambda f: F.aggregate(F.transform(w, lambda v, i: v * f(k * i * (2 * pi / n))), F.lit(0.0), lambda a, v: a + v)
        re, im = part(F.cos), part(F.sin)
        return re * re + im * im

    return F.transform(F.sequence(F.lit(0), F.lit(n // 2)), power)


def band_power(spectrum: Column, lo: float, hi: float, step: float) -> Column:
    """Sum of the bins in [lo, hi) (A3); the bin i is at i times step."""
    return F.aggregate(F.filter(F.transform(spectrum, lambda v, i: F.when((i * step >= lo) & (i * step < hi), v)), lambda v: v.isNotNull()), F.lit(0.0), lambda a, v: a + v)


def near_power(spectrum: Column, at: float, step: float, width: float = 1.0) -> Column:
    """Power in [at - width, at + width) (A4)."""
    return band_power(spectrum, at - width, at + width, step)


def velocity_rms(spectrum: Column, step: float, n: int, fs: float, lo: float = 10.0, hi: float = 1000.0, to_mm: float = 9806.65) -> Column:
    """ISO velocity in mm/s from an acceleration power spectrum in g (A5), band inclusive.

    The window's power gain is taken out; every bin but those at the ends counts twice.
    """
    gain = sum((0.5 - 0.5 * cos(2 * pi * i / (n - 1))) ** 2 for i in range(n))
    bins = n // 2 + 1

    def part(v: Column, i: Column) -> Column:
        f = i * step
        twice = F.when((i == 0) | ((i == bins - 1) & F.lit(n % 2 == 0)), 1.0).otherwise(2.0)
        return F.when((f >= lo) & (f <= hi) & (i > 0), twice * v / (n * gain) * F.pow(to_mm / (2 * pi * f), F.lit(2.0))).otherwise(F.lit(0.0))

    return F.sqrt(F.aggregate(F.transform(spectrum, part), F.lit(0.0), lambda a, v: a + v))


def current_trajectory(df: DataFrame, x: str, rated: float | None = None) -> DataFrame:
    """Struct ``current`` of how a current changes over a window (A7); null for fewer than 4 values.

    The first quarter is floor(n / 4) values, the last one rounded up. Tail, change by the
    fitted line over the window and minimum are relative to the head's absolute value.
    """
    w, n = F.col(x), F.size(F.col(x))
    q, t = F.greatest(F.lit(1), F.floor(n / 4)).cast("int"), F.greatest(F.lit(1), F.ceil(n / 4)).cast("int")
    df = df.withColumns({"__head": F.abs(mean(F.slice(w, F.lit(1), q))) + LEAST_CURRENT, "__tail": mean(F.slice(w, F.greatest(n - t + 1, F.lit(1)), t)), "__mean": mean(w)})
    mid = (n - 1) / 2
    slope = F.aggregate(F.transform(w, lambda v, i: (i - mid) * v.cast("double")), F.lit(0.0), lambda a, v: a + v) / F.aggregate(F.transform(w, lambda v, i: (i - mid) * (i - mid)), F.lit(0.0), lambda a, v: a + v)
    head, low = F.col("__head"), F.array_min(w).cast("double")
    spread = F.sqrt(mean(w, lambda v: (v - F.col("__mean")) * (v - F.col("__mean"))))
    fields = {"drop_ratio": F.col("__tail") / head, "slope": slope * n / head, "cv": spread / (mean(w, lambda v: F.abs(v.cast("double"))) + LEAST_CURRENT), "min_ratio": low / head}
    if rated is not None and rated > 0:
        fields["min_vs_rated"] = low / rated
    return df.withColumn("current", F.when(n >= 4, F.struct(*[c.alias(f"current_traj_{k}") for k, c in fields.items()]))).drop("__head", "__tail", "__mean")


def shaft_peak(df: DataFrame, spectrum: str, step: float, lo: float = 10.0, hi: float = 60.0) -> DataFrame:
    """Struct ``shaft`` of the strongest line in [lo, hi] and its confidence (A11); the lowest of equal lines."""
    lines = F.filter(F.transform(spectrum, lambda v, i: F.struct(F.sqrt(v.cast("double")).alias("a"), (-i * step).alias("g"))), lambda s: (-s["g"] >= lo) & (-s["g"] <= hi))
    df = df.withColumn("__l", F.sort_array(lines))
    n = F.size("__l")
    at = lambda i: F.get("__l", i.cast("int"))["a"]
    median = (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2
    best = F.get("__l", n - 1)
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (best["a"] / (median + 1e-12) - 1) / 10))
    return df.withColumn("shaft", F.when(n > 0, F.struct((-best["g"]).alias("hz"), confidence.alias("confidence")))).drop("__l")


#: Orders of interest and order bands.
ORDERS = (0.5, 1.0, 2.0, 3.0, 4.0)
BANDS = {"sub_synchronous": (0.05, 0.9), "around_1x": (0.9, 1.1), "around_2x": (1.9, 2.1), "inter_1x_2x": (1.1, 1.9), "above_2x": (2.1, 4.0)}


def order_features(df: DataFrame, spectrum: str, step: float, width: float = 0.02, bands: dict | None = None) -> DataFrame:
    """Struct ``orders`` of an order spectrum (A12): all but the level are shares, so gain doesn't matter."""
    bands, s = bands or BANDS, F.col(spectrum)
    df = df.withColumn("__t", total(s) + TINY)
    t = F.col("__t")
    top = lambda o: F.coalesce(F.array_max(F.filter(F.transform(s, lambda v, i: F.when((i * step >= o - width) & (i * step <= o + width), v.cast("double"))), lambda v: v.isNotNull())), F.lit(0.0))
    band = lambda lo, hi: band_power(F.transform(s, lambda v: v.cast("double")), lo, hi, step)
    one = top(1.0) + TINY
    share = lambda v: v.cast("double") / t
    fields = {"overall_level_mm_s": F.sqrt(total(s, lambda v: v * v))} | {f"order_{str(o).replace('.', 'p')}x": top(o) / t for o in ORDERS} | {f"band_{k}": band(*v) / t for k, v in bands.items()}
    fields |= {"ratio_2x_1x": top(2.0) / one, "ratio_sub_1x": band(0.05, 0.9) / one,
               "spectral_centroid_order": F.aggregate(F.transform(s, lambda v, i: share(v) * (i * step)), F.lit(0.0), lambda a, v: a + v),
               "spectral_entropy": -F.aggregate(F.transform(s, lambda v: share(v) * F.ln(share(v) + TINY)), F.lit(0.0), lambda a, v: a + v)}
    return df.withColumn("orders", F.struct(*[c.alias(k) for k, c in fields.items()])).drop("__t")


def feature_matrix(frames: list[DataFrame], key: list[str]) -> DataFrame:
    """One wide table of features that are there in some of the frames, missing ones 0 (A10)."""
    wide = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    names = sorted(c for c in wide.columns if c not in key)
    return wide.select(*key, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names])

"""Queries over arrays: embeddings as bursts of 64 samples at 64 Hz."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import arrays
from ..tables import table
from .base import query, rounded

N = 64
BURSTS = "e AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS w FROM embeddings)"
SPECTRA = f"""{BURSTS}, h AS (SELECT vec_id, list_transform(w, lambda v, i: v * (0.5 - 0.5 * cos(2 * pi() * (i - 1) / {N - 1}))) AS w FROM e),
s AS (SELECT vec_id, list_transform(range(0, {N // 2 + 1}), lambda k: list_sum(list_transform(w, lambda v, i: v * cos(k * (i - 1) * (2 * pi() / {N})))) ** 2 + list_sum(list_transform(w, lambda v, i: v * sin(k * (i - 1) * (2 * pi() / {N})))) ** 2) AS p FROM h)"""


def bursts(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("w"))


def spectra(spark, sf_dir):
    return bursts(spark, sf_dir).select("vec_id", arrays.power_spectrum(F.col("w"), N).alias("p"))


TIME = ["rms", "peak", "peak_to_peak", "std", "kurtosis", "skewness", "crest", "shape", "impulse", "clearance"]


@query("a1_time_features", f"""WITH {BURSTS}, m AS (SELECT *, list_avg(w) AS m, sqrt(list_avg(list_transform(w, lambda v: v * v))) AS rms, list_max(list_transform(w, lambda v: abs(v))) AS pk, list_avg(list_transform(w, lambda v: abs(v))) AS ab, list_avg(list_transform(w, lambda v: sqrt(abs(v)))) AS rt FROM e),
d AS (SELECT *, sqrt(list_avg(list_transform(w, lambda v: (v - m) ** 2))) + 1e-12 AS sd FROM m)
SELECT vec_id, round(rms, 6) AS rms, round(pk, 6) AS peak, round(list_max(w) - list_min(w), 6) AS peak_to_peak, round(sd, 6) AS std, round(list_avg(list_transform(w, lambda v: ((v - m) / sd) ** 4)) - 3, 6) AS kurtosis, round(list_avg(list_transform(w, lambda v: ((v - m) / sd) ** 3)), 6) AS skewness,
       round(pk / rms, 6) AS crest, round(rms / ab, 6) AS shape, round(pk / ab, 6) AS impulse, round(pk / (rt * rt), 6) AS clearance FROM d""")
def time_features(spark, sf_dir):
    """Moments and shape factors of each burst."""
    return rounded(arrays.time_features(bursts(spark, sf_dir), "w").select("vec_id", "time.*"), *TIME)


@query("a2_power_spectrum", f"WITH {SPECTRA} SELECT vec_id, unnest(range(0, {N // 2 + 1}))::INT AS bin, round(unnest(p), 6) AS power FROM s")
def power_spectrum(spark, sf_dir):
    """Power of each bin of each burst."""
    return rounded(spectra(spark, sf_dir).select("vec_id", F.posexplode("p").alias("bin", "power")), "power")


@query("a3_a5_band_power", f"""WITH {SPECTRA} SELECT vec_id, round(list_sum(p[5:12]), 6) AS low, round(list_sum(p[13:31]), 6) AS high, round(list_sum(p[8:9]), 6) AS near_8,
       round(sqrt(list_sum(list_transform(p, lambda v, i: CASE WHEN i - 1 >= 4 AND i - 1 <= 30 THEN 2 * v / (64 * 23.625) * (9806.65 / (2 * pi() * (i - 1))) ** 2 ELSE 0 END))), 4) AS velocity FROM s""")
def band_power(spark, sf_dir):
    """Power of bands, near a line, and velocity."""
    p = F.col("p")
    out = spectra(spark, sf_dir).select("vec_id", arrays.band_power(p, 4, 12, 1.0).alias("low"), arrays.band_power(p, 12, 31, 1.0).alias("high"), arrays.near_power(p, 8.0, 1.0).alias("near_8"), arrays.velocity_rms(p, 1.0, N, 64.0, 4.0, 30.0).alias("velocity"))
    return rounded(rounded(out, "low", "high", "near_8"), "velocity", places=4)


TRAJECTORY = ["drop_ratio", "slope", "cv", "min_ratio", "min_vs_rated"]


@query("a7_current_trajectory", f"""WITH {BURSTS}, c AS (SELECT vec_id, list_transform(w, lambda v: (vec_id % 3 - 1) * 0.2 + v) AS w FROM e), n AS (SELECT *, len(w) AS n FROM c),
q AS (SELECT *, abs(list_avg(w[1:n // 4])) + 1e-12 AS hd, list_avg(w[n - (n + 3) // 4 + 1:n]) AS tl, list_avg(w) AS m FROM n)
SELECT vec_id, round(tl / hd, 6) AS current_traj_drop_ratio, round(list_sum(list_transform(w, lambda v, i: (i - (n + 1) / 2) * v)) / list_sum(list_transform(w, lambda v, i: (i - (n + 1) / 2) ** 2)) * n / hd, 6) AS current_traj_slope,
       round(sqrt(list_avg(list_transform(w, lambda v: (v - m) ** 2))) / (list_avg(list_transform(w, lambda v: abs(v))) + 1e-12), 6) AS current_traj_cv, round(list_min(w) / hd, 6) AS current_traj_min_ratio, round(list_min(w) / 10, 6) AS current_traj_min_vs_rated FROM q""")
def current_trajectory(spark, sf_dir):
    """How each burst changes as a current, on both sides of zero."""
    c = bursts(spark, sf_dir).select("vec_id", F.transform("w", lambda v: v + (F.col("vec_id") % 3 - 1) * 0.2).alias("w"))
    return rounded(arrays.current_trajectory(c, "w", 10.0).select("vec_id", "current.*"), *[f"current_traj_{k}" for k in TRAJECTORY])


@query("a11_shaft_peak", f"WITH {SPECTRA}, l AS (SELECT vec_id, list_transform(p[5:31], lambda v: sqrt(v)) AS a FROM s) SELECT vec_id, (list_position(a, list_max(a)) + 3)::DOUBLE AS hz, round(greatest(0, least(1, (list_max(a) / (list_median(a) + 1e-12) - 1) / 10)), 6) AS confidence FROM l")
def shaft_peak(spark, sf_dir):
    """Strongest line from 4 to 30 Hz."""
    return rounded(arrays.shaft_peak(spectra(spark, sf_dir), "p", 1.0, 4.0, 30.0).select("vec_id", "shaft.*"), "hz", "confidence")


def _band(lo, hi):
    return f"list_sum(list_transform(p, lambda v, i: CASE WHEN (i - 1) * 0.25 >= {lo} AND (i - 1) * 0.25 < {hi} THEN v ELSE 0 END))"


def _at(o):
    return f"p[{int(o / 0.25) + 1}]"


ORDER_NAMES = ["overall_level_mm_s", *[f"order_{str(o).replace('.', 'p')}x" for o in arrays.ORDERS], *[f"band_{b}" for b in arrays.BANDS], "ratio_2x_1x", "ratio_sub_1x", "spectral_centroid_order", "spectral_entropy"]


@query("a12_order_features", f"WITH {SPECTRA}, t AS (SELECT *, list_sum(p) AS t FROM s) SELECT vec_id, round(sqrt(list_sum(list_transform(p, lambda v: v * v))), 6) AS overall_level_mm_s, "
       + ", ".join(f"round({_at(o)} / t, 6) AS order_{str(o).replace('.', 'p')}x" for o in arrays.ORDERS) + ", " + ", ".join(f"round({_band(*v)} / t, 6) AS band_{k}" for k, v in arrays.BANDS.items())
       + f", round({_at(2.0)} / {_at(1.0)}, 4) AS ratio_2x_1x, round({_band(0.05, 0.9)} / {_at(1.0)}, 4) AS ratio_sub_1x, round(list_sum(list_transform(p, lambda v, i: v / t * (i - 1) * 0.25)), 6) AS spectral_centroid_order, round(-list_sum(list_transform(p, lambda v: v / t * ln(v / t + 1e-30))), 6) AS spectral_entropy FROM t")
def order_features(spark, sf_dir):
    """Order features of each spectrum, a quarter order a bin."""
    out = arrays.order_features(spectra(spark, sf_dir), "p", 0.25).select("vec_id", "orders.*")
    return rounded(rounded(out, "ratio_2x_1x", "ratio_sub_1x", places=4), *[n for n in ORDER_NAMES if not n.startswith("ratio")])


@query("a10_feature_matrix", f"WITH {BURSTS} SELECT vec_id, round(CASE WHEN vec_id % 2 = 0 THEN list_sum(w) ELSE 0 END, 6) AS even_sum, round(CASE WHEN vec_id % 2 = 1 THEN list_max(w) ELSE 0 END, 6) AS odd_max FROM e")
def feature_matrix(spark, sf_dir):
    """Features of two kinds of records in one table."""
    b = bursts(spark, sf_dir)
    even = b.where("vec_id % 2 = 0").select("vec_id", arrays.total(F.col("w")).alias("even_sum"))
    odd = b.where("vec_id % 2 = 1").select("vec_id", F.array_max("w").alias("odd_max"))
    return rounded(arrays.feature_matrix([even, odd], ["vec_id"]), "even_sum", "odd_max")

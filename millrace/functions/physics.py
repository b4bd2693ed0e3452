"""Pump physics as column expressions (F1-F12). Invalid inputs raise when the row is evaluated."""

from __future__ import annotations

from math import exp, log10

from pyspark.sql import Column
from pyspark.sql import functions as F

GRAVITY = 9.80665

Num = Column | float | int


def col(x: Num) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), x))


def demand(ok: Column, value: Column, message: str) -> Column:
    """value where ok, else an error that names the rule."""
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)))


def shaft_hz(rpm: Num) -> Column:
    r = col(rpm)
    return demand(r > 0, r / 60.0, "rpm must be positive")


def vane_pass_hz(rpm: Num, vanes: Num) -> Column:
    z = col(vanes)
    return demand(z >= 1, z * shaft_hz(rpm), "vanes must be 1 or more")


def bearing_hz(rpm: Num, balls: Num, ball_mm: Num, pitch_mm: Num, angle_deg: Num = 0.0) -> dict[str, Column]:
    """Outer race, inner race, ball spin and cage frequencies."""
    n, d, p = col(balls), col(ball_mm), col(pitch_mm)
    ratio = d / p * F.cos(F.radians(col(angle_deg)))
    f = demand((n >= 1) & (d > 0) & (d < p), shaft_hz(rpm), "bearing needs balls smaller than its pitch circle")
    return {"bpfo": n * f / 2 * (1 - ratio), "bpfi": n * f / 2 * (1 + ratio), "bsf": p / d * f / 2 * (1 - ratio * ratio), "ftf": f / 2 * (1 - ratio)}


def npsh_available(suction_pa: Num, vapour_pa: Num, density: Num, speed: Num = 0.0, g: float = GRAVITY) -> Column:
    rho, v = col(density), col(speed)
    return demand(rho > 0, (col(suction_pa) - col(vapour_pa)) / (rho * g) + v * v / (2 * g), "density must be positive")


def cavitation_from_npsh(available: Num, required: Num) -> Column:
    r = col(required)
    return demand(r > 0, clip((1.5 - F.greatest(col(available), F.lit(0.0)) / r) / 1.5, 0, 1), "required NPSH must be positive")


def cavitation_intensity(severity: Num) -> Column:
    """Rises to 1 at 0.4 and falls to a quarter at 1."""
    s = clip(col(severity), 0, 1)
    return F.when(s <= 0.4, F.pow(s / 0.4, F.lit(1.2))).otherwise(1 - 0.75 * F.pow(F.greatest(s - 0.4, F.lit(0.0)) / 0.6, F.lit(1.5)))


def cavitation_band_energy(severity: Num, lo: float = 1000.0, hi: float = 2000.0, base: float = 0.05) -> Column:
    away = (log10(max((lo + hi) / 2, 1.0)) - log10(1500.0)) / 0.4
    return base + cavitation_intensity(severity) * exp(-away * away / 2)


#: Share of the rated current that each condition settles at.
SETTLES = {"healthy": 1.0, "dry_run": 0.45, "closed_valve": 0.70}


def dry_run_current(t: Num, onset: Num, condition: Column, rated: float = 10.0, transition_s: float = 0.5, noise: Num = 0.0) -> Column:
    """Current through a dry run or a closed valve; noise is in ampere, zero for none."""
    share = F.create_map(*[F.lit(x) for kv in SETTLES.items() for x in kv])[condition]
    share = demand(share.isNotNull(), share, "unknown condition")
    since = F.greatest(col(t) - col(onset), F.lit(0.0))
    return F.greatest(rated * (1 + (share - 1) * (1 - F.exp(-since / max(transition_s, 1e-3)))) + col(noise), F.lit(0.0))


def dry_run_vane_amplitude(t: Num, onset: Num, healthy: float = 1.0, floor: float = 0.05, transition_s: float = 0.8) -> Column:
    since = F.greatest(col(t) - col(onset), F.lit(0.0))
    return healthy * (floor + (1 - floor) * F.exp(-since / max(transition_s, 1e-3)))


def motor_slip(load: Num, full: float = 0.03) -> Column:
    return clip(col(load), 0, 1.5) * full


def rotor_bar_hz(line: Num, slip: Num) -> Column:
    """Positive sidebands, ascending."""
    f, s = col(line), col(slip)
    return F.sort_array(F.filter(F.array(f * (1 - 2 * s), f * (1 + 2 * s)), lambda x: x > 0))


def impeller_sidebands(damage: Num, amplitude: Num = 1.0) -> dict[str, Column]:
    d, a = clip(col(damage), 0, 1), col(amplitude)
    return {"vpf": a * (1 - 0.3 * d), "lower": a * 0.45 * d, "upper": a * 0.45 * d}


def aliased_hz(f: Num, fs: Num) -> Column:
    """Where a frequency appears after sampling."""
    r = F.pmod(F.abs(col(f)), col(fs))
    return F.least(r, col(fs) - r)

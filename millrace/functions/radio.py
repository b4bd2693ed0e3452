"""LoRa airtime, node energy, duty cycle and commissioning (F13-F24) as column expressions."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from .physics import Num, clip, col, demand

#: Currents in mA and times in seconds of the node's phases.
SAMPLE_MA, COMPUTE_MA, TX_MA, RX_MA, SLEEP_MA, WAKE_MA, CUSUM_MA = 2.6, 1.5, 45.0, 4.2, 0.010, 0.0014, 1.8
SAMPLE_S, COMPUTE_S, RX_S = 2.0, 0.5, 0.2


def symbol_seconds(sf: Num, bandwidth: Num = 125_000) -> Column:
    return F.pow(F.lit(2.0), col(sf)) / col(bandwidth)


def payload_symbols(size: Num, sf: Num, cr: Num = 1, explicit: bool = True, slow: Column | bool = False, crc: bool = True) -> Column:
    s, c, low = col(sf), col(cr), col(slow).cast("int") if isinstance(slow, Column) else F.lit(int(slow))
    bits = 8 * col(size) - 4 * s + 28 + 16 * int(crc) - 20 * int(not explicit)
    out = 8 + F.greatest(F.ceil(bits / (4 * (s - 2 * low))) * (c + 4), F.lit(0))
    return demand(s.between(7, 12) & c.between(1, 4), out.cast("long"), "SF must be 7 to 12 and CR 1 to 4")


def airtime_seconds(size: Num, sf: Num = 9, cr: Num = 1, bandwidth: Num = 125_000, preamble: int = 8) -> Column:
    """Low-rate optimisation is on from SF 11."""
    return (preamble + 4.25 + payload_symbols(size, sf, cr, slow=col(sf) >= 11)) * symbol_seconds(sf, bandwidth)


def vector_bytes(features: Num, each: int = 4, header: int = 8) -> Column:
    return header + col(features) * each


def heartbeat_bytes(header: int = 8) -> Column:
    return F.lit(header + 4)


def _results(parts: dict[str, Column], sends: Column, battery: float) -> dict[str, Column]:
    """Per-day figures from charges in mA seconds a day."""
    total = sum(parts.values(), F.lit(0.0))
    per_day = total / 3600
    return {"mah_per_day": per_day, "battery_years": battery / per_day / 365.25, "tx_fraction": parts["tx"] / total, "tx_per_day": sends} | {f"{k}_mah": v / 3600 for k, v in parts.items()}


def fixed_schedule(interval_s: Num = 900.0, features: Num = 30, rate: Num = 1.0, battery: float = 2400.0) -> dict[str, Column]:
    """A node that wakes every interval."""
    every, r = col(interval_s), col(rate)
    day, tx = F.lit(86400.0) / every, r * airtime_seconds(vector_bytes(features)) + (1 - r) * airtime_seconds(heartbeat_bytes())
    asleep = F.greatest(every - (SAMPLE_S + COMPUTE_S + RX_S + tx), F.lit(0.0))
    parts = {"sample": F.lit(SAMPLE_MA * SAMPLE_S), "compute": F.lit(COMPUTE_MA * COMPUTE_S), "tx": TX_MA * tx, "rx": F.lit(RX_MA * RX_S), "sleep": SLEEP_MA * asleep}
    return _results({k: v * day for k, v in parts.items()}, day * r, battery)


def event_triggered(hours: Num = 3.0, features: Num = 30, sends_per_hour: Num = 2.0, beats_per_hour: Num = 6.0, windows_per_hour: Num = 1 / 3, rate: Num | None = None, battery: float = 2400.0) -> dict[str, Column]:
    """A node that wakes with its pump (F16). A rate sends that share of the feature windows."""
    h = col(hours)
    h = demand(h <= 24, h, "a day has 24 hours")
    windows, beats = col(windows_per_hour) * h, col(beats_per_hour) * h
    sends = windows * clip(col(rate), 0, 1) if rate is not None else col(sends_per_hour) * h
    parts = {
        "cusum": CUSUM_MA * h * 3600,
        "features": windows * (SAMPLE_MA * SAMPLE_S + COMPUTE_MA * COMPUTE_S),
        "tx": TX_MA * (sends * airtime_seconds(vector_bytes(features)) + beats * airtime_seconds(heartbeat_bytes())),
        "rx": RX_MA * RX_S * (sends + beats),
        "wake": WAKE_MA * (86400 - h * 3600),
    }
    return _results(parts, sends, battery)


@dataclass(frozen=True)
class Duty:
    """Sampling schedule: dense while learning, sparse while deciding."""

    learning_per_hour: float = 12.0
    deciding_per_hour: float = 1 / 3
    hours_per_day: float = 3.0
    days_per_month: float = 30.0

    def __post_init__(self):
        if min(self.learning_per_hour, self.deciding_per_hour, self.hours_per_day, self.days_per_month) <= 0:
            raise ValueError("a duty cycle is made of positive numbers")

    @property
    def per_day(self) -> float:
        return self.deciding_per_hour * self.hours_per_day

    @property
    def per_month(self) -> float:
        return self.per_day * self.days_per_month

    @property
    def hours_between(self) -> float:
        return 24 / self.per_day

    def false_alarm_rate(self, alarms: float = 1.0) -> float:
        """Of a decision, so that a month has that many alarms."""
        return alarms / self.per_month

    def deciding(self, per_month: float) -> Duty:
        """The same schedule at another number of decisions a month."""
        if per_month <= 0:
            raise ValueError("decisions per month must be positive")
        return replace(self, deciding_per_hour=per_month / (self.hours_per_day * self.days_per_month))


def duty_columns(per_hour: Num, hours: Num, days: Num = 30.0, alarms: Num = 1.0) -> dict[str, Column]:
    """F18 and F20 of columns."""
    a, h, d = col(per_hour), col(hours), col(days)
    day = demand((a > 0) & (h > 0) & (d > 0), a * h, "a duty cycle is made of positive numbers")
    return {"per_day": day, "per_month": day * d, "hours_between": 24.0 / day, "far": col(alarms) / (day * d)}


def commissioning(features: Num, per_hour: Num = 12.0, hours: Num = 3.0, safety: float = 1.5) -> dict[str, Column]:
    """Windows and days that a baseline takes."""
    need, day = F.ceil(10 * col(features) * safety).cast("long"), col(per_hour) * col(hours)
    return {"required": need, "days": demand(day > 0, need / day, "samples a day must be positive")}


def progress(observed: Num, features: Num, safety: float = 1.5) -> dict[str, Column]:
    """Whether the windows seen suffice."""
    need, seen = F.ceil(10 * col(features) * safety).cast("long"), col(observed)
    return {"required": need, "commissioned": seen >= need, "fraction": F.when(need > 0, seen / need).otherwise(F.lit(0.0)),
            "note": F.concat(seen.cast("string"), F.lit("/"), need.cast("string"), F.when(seen >= need, "").otherwise(" not commissioned"))}


def should_update(age_days: Num, new_healthy: Num, max_age: float = 30.0, enough: int = 100) -> Column:
    """Whether a baseline is to be learned anew."""
    return (col(age_days) >= max_age) | (col(new_healthy) >= enough)


def nemenyi_allowed(n: Num) -> Column:
    """Whether there are groups enough for a rank test."""
    return col(n) >= 5

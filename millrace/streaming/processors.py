"""Stateful operators on streams: run state, CUSUM, dry-run trip, re-armed alarms, interlock.

Each processor keeps one small value a machine and emits the row of the batch operator. Rows
of a machine are put in event-time order within a micro-batch. Late rows (at or before the
last one that the machine's state has seen) can't be put in their place: they leave the state
as it is and come out flagged ``late``, without results, so that every row that goes in comes
out once and a batch run over the late ones' machines can set them right.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


class Ordered(StatefulProcessor):
    """A fold over a machine's rows in order of (ts, event_id)."""

    state_fields = ""
    start: tuple = ()
    out: tuple[str, ...] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("value", f"last_ts timestamp, last_id long, {self.state_fields}")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        frame = pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable")
        now = self.value.get() if self.value.exists() else (pd.Timestamp(0), -1, *self.start)
        last, state, out = (pd.Timestamp(now[0]), now[1]), tuple(now[2:]), []
        for ts, event_id, load in zip(frame["ts"], frame["event_id"], frame["load"], strict=True):
            if (ts, event_id) <= last:
                out.append((key[0], event_id, True, *[None] * len(self.out)))
                continue
            state, row = self.step(state, None if pd.isna(load) else float(load))
            last = (ts, event_id)
            out.append((key[0], event_id, False, *row))
        self.value.update((last[0].to_pydatetime(), int(last[1]), *state))
        if out:
            yield pd.DataFrame(out, columns=["machine", "event_id", "late", *self.out], dtype=object)

    def step(self, state: tuple, load: float | None) -> tuple[tuple, tuple]:
        raise NotImplementedError

    def close(self) -> None:
        pass


class RunState(Ordered):
    """off, running, unknown."""

    state_fields, start, out = "running int, pending int, n int", (0, -1, 0), ("state",)

    def __init__(self, on: float, off: float, dwell: int = 2):
        self.on, self.off, self.dwell = on, off, dwell

    def step(self, state, load):
        running, pending, n = state
        if load is None:
            return state, ("unknown",)
        asks = 1 if load >= self.on else 0 if load <= self.off else -1
        n = n + 1 if asks == pending else 1
        if asks >= 0 and n >= self.dwell:
            running = asks
        return (running, asks, n), ("running" if running else "off",)


class Cusum(Ordered):
    """Downward and upward sums (W6); missing readings leave them."""

    state_fields, start, out = "s_neg double, s_pos double", (0.0, 0.0), ("s_neg", "s_pos", "hit")

    def __init__(self, mu: float, sigma: float, k: float = 0.5, h: float = 5.0):
        self.mu, self.sigma, self.k, self.h = mu, sigma + 1e-12, k, h

    def step(self, state, load):
        if load is not None:
            z = (load - self.mu) / self.sigma
            state = max(0.0, state[0] - z - self.k), max(0.0, state[1] + z - self.k)
        return state, (*state, max(state) >= self.h)


class Ewma(Ordered):
    """Weighted mean."""

    state_fields, out = "z double", ("z", "score")

    def __init__(self, mu: float, sigma: float, weight: float = 0.2):
        self.mu, self.spread, self.weight, self.start = mu, sigma * (weight / (2 - weight)) ** 0.5, weight, (mu,)

    def step(self, state, load):
        z = state[0] if load is None else self.weight * load + (1 - self.weight) * state[0]
        return (z,), (z, abs(z - self.mu) / self.spread)


class Trip(Ordered):
    """CUSUM hit and a low current for ``persist`` readings."""

    state_fields, start, out = "s double, n int", (0.0, 0), ("tripped",)

    def __init__(self, mu: float, sigma: float, k: float = 0.5, h: float = 5.0, floor: float = 0.6, persist: int = 2, both: bool = True):
        self.mu, self.sigma, self.k, self.h, self.floor, self.persist, self.both = mu, sigma + 1e-12, k, h, floor, persist, both

    def step(self, state, load):
        if load is None:
            return state, (state[1] >= self.persist,)
        s = max(0.0, state[0] - (load - self.mu) / self.sigma - self.k)
        hit, low = s >= self.h, load < self.floor
        n = state[1] + 1 if ((hit and low) if self.both else (hit or low)) else 0
        return (s, n), (n >= self.persist,)


class Rearmed(Ordered):
    """k of the last n readings at or above a level, forgetting on each alarm."""

    state_fields, start, out = "bits string, alarms long", ("", 0), ("alarms",)

    def __init__(self, level: float, k: int, n: int):
        self.level, self.k, self.n = level, k, n

    def step(self, state, load):
        bits = (state[0] + ("1" if load is not None and load >= self.level else "0"))[-self.n :]
        fires = bits.count("1") >= self.k
        alarms = state[1] + fires
        return ("" if fires else bits, alarms), (alarms,)


class Interlock(Ordered):
    """Blocks until the first breach of temperature or exposure."""

    state_fields, start, out = "exposure double, peak double, stopped int", (0.0, float("-inf"), 0), ("exposure", "peak", "kept", "breach")

    def __init__(self, seconds: float, hot: float = 80.0, limit: float = 20.0):
        self.seconds, self.hot, self.limit = seconds, hot, limit

    def step(self, state, load):
        exposure, peak, stopped = state
        if stopped:
            return state, (exposure, peak, False, False)
        exposure, peak = exposure + self.seconds, max(peak, load if load is not None else peak)
        breach = (load is not None and load >= self.hot) or exposure >= self.limit
        return (exposure, peak, int(breach)), (exposure, peak, True, breach)


#: Type of each output column.
TYPES = {"state": "string", "s_neg": "double", "s_pos": "double", "hit": "boolean", "z": "double", "score": "double", "tripped": "boolean", "alarms": "long", "exposure": "double", "peak": "double", "kept": "boolean", "breach": "boolean"}


def apply(stream: DataFrame, processor: Ordered) -> DataFrame:
    """The processor over a stream of (machine, ts, event_id, load); needs the RocksDB state store."""
    schema = "machine long, event_id long, late boolean, " + ", ".join(f"{c} {TYPES[c]}" for c in processor.out)
    return stream.groupBy("machine").transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="append", timeMode="none")


def tumbling(stream: DataFrame, width: str = "30 seconds", late: str = "1 minute") -> DataFrame:
    """Means of tumbling event-time windows with a watermark; unlike blocks of rows, gaps shorten them."""
    from pyspark.sql import functions as F

    return stream.withWatermark("ts", late).groupBy("machine", F.window("ts", width)).agg(F.avg("load").alias("load"), F.count("load").alias("n"))

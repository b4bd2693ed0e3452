"""Ordered, stateful operators in closed form over windows.

Every function takes the key columns of a machine and the columns that order its rows, adds
columns and keeps the rows. All windows of a chain share one partitioning and one order, so
a plan has one exchange and one sort; ``blocks`` spreads the rows of one machine over tasks
instead (``scans``), with the same results. A column for a parameter may come from a joined
table.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scans import BLOCKS, Scan, last_value, meet

Names = Sequence[str]
HOLD = -1


def _order(key: Names, order: Names):
    return Window.partitionBy(*key).orderBy(*order)


def _so_far(key: Names, order: Names):
    return _order(key, order).rowsBetween(Window.unboundedPreceding, 0)


def finite(x: Column) -> Column:
    """x, null where it is NaN or infinite."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def blocks(df: DataFrame, key: Names, order: Names, channels: Names, rows: int) -> DataFrame:
    """Means of blocks of ``rows`` rows (W1): a partial last block goes, as does one with a channel without values."""
    numbered = df.withColumn("block", F.floor((F.row_number().over(_order(key, order)) - 1) / rows).cast("long"))
    means = [F.avg(finite(F.col(c))).alias(c) for c in channels]
    out = numbered.groupBy(*key, "block").agg(F.min(order[0]).alias("start"), F.count(F.lit(1)).alias("n_rows"), *means)
    full = F.col("n_rows") == rows
    for c in channels:
        full &= F.col(c).isNotNull()
    return out.where(full).drop("n_rows")


def otsu(df: DataFrame, key: Names, x: str, bins: int = 256) -> DataFrame:
    """Threshold between two modes and how well it separates (W2), one row a key.

    Of thresholds with the same between-class variance the middle one stands. Only the
    bins of a key are gathered, whatever its rows.
    """
    per = Window.partitionBy(*key)
    rows = df.select(*key, finite(F.col(x)).alias("x")).where("x is not null")
    span = rows.groupBy(*key).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("variance"))
    wide = (F.col("hi") - F.col("lo")) / bins
    binned = rows.join(span.select(*key, "lo", "hi"), list(key)) if key else rows.crossJoin(F.broadcast(span.select("lo", "hi")))  # span is one row
    binned = binned.where("hi > lo").withColumn("bin", F.least(F.floor((F.col("x") - F.col("lo")) / wide), F.lit(bins - 1)).cast("int"))
    counts = binned.groupBy(*key, "bin").agg(F.count(F.lit(1)).alias("c"))
    grid = span.where("hi > lo").withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    dense = grid.join(counts, [*key, "bin"], "left").withColumn("c", F.coalesce("c", F.lit(0)).cast("double"))
    centre = F.col("lo") + (F.col("bin") + 0.5) * wide
    upto = per.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    dense = dense.withColumns({"w0": F.sum("c").over(upto), "m0": F.sum(F.col("c") * centre).over(upto), "all": F.sum("c").over(per), "m": F.sum(F.col("c") * centre).over(per)})
    w1 = F.col("all") - F.col("w0")
    apart = F.col("m0") / F.col("w0") - (F.col("m") - F.col("m0")) / w1
    between = F.when((F.col("w0") > 0) & (w1 > 0), F.col("w0") / F.col("all") * w1 / F.col("all") * apart * apart)
    dense = dense.withColumn("between", F.round(between, 9)).withColumn("best", F.max("between").over(per))
    tied = dense.where("between = best").groupBy(*key).agg(F.sort_array(F.collect_list(centre)).alias("t"), F.first("best").alias("best"), F.first("variance").alias("variance"))
    middle = F.get("t", F.expr("cast(size(t) div 2 as int)"))
    found = tied.select(*key, middle.alias("threshold"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("best") / F.col("variance"))).alias("separability"))
    if not key:
        return span.select("lo", "hi", "n").join(found, how="left")
    return span.select(*key, "lo", "hi", "n").join(found, list(key), "left")


def run_thresholds(modes: DataFrame, share: float = 0.25, least: float = 0.5) -> DataFrame:
    """On and off levels from ``otsu`` rows (W3); status says why a key has none."""
    t, lo, hi = F.col("threshold"), F.col("lo"), F.col("hi")
    band = share * F.least(t - lo, hi - t)
    status = F.when(hi == lo, "never runs").when(F.col("separability") < least, "one mode").otherwise("ok")
    out = modes.withColumn("status", status)
    ok = F.col("status") == "ok"
    return out.withColumns({"on": F.when(ok, t + band), "off": F.when(ok, t - band)})


def run_state(df: DataFrame, key: Names, order: Names, load: str, on: Column | float, off: Column | float, dwell: Column | int = 2, out: str = "state", blocks: int = 0) -> DataFrame:
    """off, running or unknown with hysteresis and dwell.

    A state is taken after ``dwell`` readings in a row that ask for it; readings between the
    levels hold and start the count again, unknown ones leave it as it is. With ``blocks`` a
    machine's rows are spread over that many tasks.
    """
    x, scan = finite(F.col(load)), Scan(key, order, blocks)
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    asks = F.when(x >= lit(on), 1).when(x <= lit(off), 0).when(x.isNotNull(), HOLD)
    df = scan.begin(df.withColumn("__asks", asks))
    df = scan.fold(df, "__last", "last", F.col("__asks"), before=True)
    df = scan.fold(df, "__n", "sum", F.col("__asks").isNotNull().cast("long"))
    turn = F.col("__asks").isNotNull() & (F.col("__last").isNull() | (F.col("__asks") != F.col("__last")))
    df = scan.fold(df, "__from", "max", F.when(turn, F.col("__n")))
    taken = F.when((F.col("__asks") != HOLD) & (F.col("__n") - F.col("__from") + 1 >= lit(dwell)), F.col("__asks"))
    df = scan.fold(df, "__held", "last", taken)
    state = F.when(F.col("__asks").isNull(), "unknown").when(F.col("__held") == 1, "running").otherwise("off")
    return scan.end(df.withColumn(out, state), "__asks", "__last", "__n", "__from", "__held")


def cusum(df: DataFrame, key: Names, order: Names, x: Column, mu: Column | float, sigma: Column | float, k: float = 0.5, h: float = 5.0, two_sided: bool = False, blocks: int = 0) -> DataFrame:
    """Cumulative sums that never fall below zero (W6): s_neg, s_pos, score and hit.

    The recursion max(0, s + step) is the prefix sum less its running minimum or zero; with
    ``blocks`` both are carried over blocks of a machine's rows.
    """
    scan = Scan(key, order, blocks)

    def sums(df: DataFrame, step: Column, out: str) -> DataFrame:
        df = scan.fold(df, "__sum", "sum", step)
        df = scan.fold(df, "__low", "min", F.col("__sum"))
        return df.withColumn(out, F.col("__sum") - F.least(F.lit(0.0), "__low")).drop("__sum", "__low")

    df = scan.begin(df.withColumn("__z", (x - mu) / (sigma + F.lit(1e-12))))
    df = sums(df, -F.col("__z") - k, "s_neg")
    df = sums(df, F.col("__z") - k, "s_pos") if two_sided else df.withColumn("s_pos", F.lit(0.0))
    score = F.greatest("s_neg", "s_pos")
    return scan.end(df.withColumn("score", score).withColumn("hit", score >= h), "__z")


def ewma(df: DataFrame, key: Names, order: Names, x: str, mu: Column | float, weight: float = 0.2, out: str = "z", blocks: int = 0) -> DataFrame:
    """Exponentially weighted mean that starts at mu (W7); rows without a value keep the mean.

    A key's values are cut into stretches within which the weights stay within a double's
    precision, so that a stretch's mean is a running sum. What the few stretches before it
    add, beyond which weights fall below precision, is handed on from each one's last value
    to the next, once for every one of them. ``mu`` is one a key.
    """
    keep = 1 - weight
    size = max(1, int(log(1e6) / -log(keep))) if weight < 1 else 1
    reach = ceil(log(1e-19) / log(keep) / size) + 1 if weight < 1 else 0
    scan, power = Scan(key, order, blocks), lambda e: F.pow(F.lit(keep), e)
    df = df.withColumns({"__v": F.col(x).cast("double"), "__mu": (mu if isinstance(mu, Column) else F.lit(float(mu))).cast("double")})
    df = scan.begin(df)
    if weight >= 1:
        return scan.end(scan.fold(df, "__z", "last", F.col("__v")).withColumn(out, F.coalesce("__z", "__mu")), "__v", "__mu", "__z")
    df = scan.fold(df, "__n", "sum", F.col("__v").isNotNull().cast("long"))
    df = df.withColumn("__stretch", F.floor((F.col("__n") - F.col("__v").isNotNull().cast("int")) / size).cast("long"))  # rows without a value after a stretch's last are in the next
    df = df.withColumn("__r", F.col("__n") - F.col("__stretch") * size)
    run = Window.partitionBy(*key, "__stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("__own", F.coalesce(F.sum(F.col("__v") * weight * power(-F.col("__r"))).over(run), F.lit(0.0)) * power(F.col("__r")))
    df = df.withColumn("__earlier", F.lit(0.0))
    for _ in range(reach):
        handed = F.when(F.col("__r") == size, F.col("__own") + keep**size * F.col("__earlier"))
        df = scan.fold(df, "__next", "last", handed, before=True).withColumn("__earlier", F.coalesce("__next", F.lit(0.0))).drop("__next")
    z = F.col("__own") + F.col("__earlier") * power(F.col("__r")) + F.col("__mu") * power(F.col("__n"))
    return scan.end(df.withColumn(out, z), "__v", "__mu", "__n", "__stretch", "__r", "__own", "__earlier")


def ewma_score(z: Column, mu: Column, sigma: Column, weight: float = 0.2) -> Column:
    """How many of its own standard deviations the mean is away."""
    return F.abs(z - mu) / (sigma * (weight / (2 - weight)) ** 0.5)


def runs(df: DataFrame, key: Names, order: Names, flag: Column, out: str = "run_length", blocks: int = 0) -> DataFrame:
    """How many rows in a row the flag has held, this one included: the row's number less that of the last row without it."""
    scan = Scan(key, order, blocks)
    df = scan.fold(scan.begin(df.withColumn("__flag", F.coalesce(flag, F.lit(False)))), "__n", "sum", F.lit(1))
    df = scan.fold(df, "__gap", "max", F.when(~F.col("__flag"), F.col("__n")))
    return scan.end(df.withColumn(out, F.col("__n") - F.coalesce("__gap", F.lit(0))), "__flag", "__n", "__gap")


def trips(df: DataFrame, key: Names, order: Names, current: str, mu: Column | float, sigma: Column | float, k: float = 0.5, h: float = 5.0, floor: Column | float = 0.6, persist: int = 2, both: bool = True, blocks: int = 0) -> DataFrame:
    """Dry-run trip (W12): hit and below the floor (or either), for ``persist`` rows; adds ``tripped``."""
    out = cusum(df, key, order, F.col(current), mu, sigma, k, h, blocks=blocks)
    low = F.col(current) < floor
    out = runs(out, key, order, (F.col("hit") & low) if both else (F.col("hit") | low), blocks=blocks)
    return out.withColumn("tripped", F.col("run_length") >= persist)


def first_trip(tripped: DataFrame, key: Names, at: str, delay_s: float = 0.05) -> DataFrame:
    """The time of the first trip of each key, null if it never trips."""
    first = F.min(F.when(F.col("tripped"), F.col(at)))
    return tripped.groupBy(*key).agg(first.alias("detected_at"), F.count(F.lit(1)).alias("n_rows")).withColumn("trip_at", F.col("detected_at") + F.expr(f"interval {int(delay_s * 1e6)} microsecond"))


def trip_outcome(first: DataFrame, onset: Column, expected: Column) -> DataFrame:
    """Delay and false trips of first trips in seconds."""
    t = F.col("detected_at")
    return first.withColumns({"delay": F.when(expected & (t >= onset), t - onset), "false_trip": t.isNotNull() & (~expected | (t < onset)), "detected": t.isNotNull() & expected & (t >= onset)})


def trip_sweep(df: DataFrame, key: Names, order: Names, current: str, at: str, mu: Column | float, sigma: Column | float, floors: Sequence[float], persists: Sequence[int], levels: Sequence[float], k: float = 0.5) -> DataFrame:
    """First trip of each key at every floor, persistence and level (W15): key, floor, persist, h, detected_at.

    The cumulative sums are made once. A run's length is the row number less that of the last
    row whose flag fails, so the runs of all floors and levels share one window.
    """
    run, pairs = _so_far(key, order), [(h, f) for h in levels for f in floors]
    df = cusum(df, key, order, F.col(current), mu, sigma, k).withColumn("__n", F.row_number().over(_order(key, order)))
    flag = lambda h, f: F.coalesce((F.col("score") >= h) & (F.col(current) < f), F.lit(False))
    df = df.withColumns({f"__r{i}": F.col("__n") - F.coalesce(F.max(F.when(~flag(h, f), F.col("__n"))).over(run), F.lit(0)) for i, (h, f) in enumerate(pairs)})
    points = [(i, h, f, p) for i, (h, f) in enumerate(pairs) for p in persists]
    first = df.groupBy(*key).agg(*[F.min(F.when(F.col(f"__r{i}") >= p, F.col(at))).alias(f"__t{i}_{p}") for i, _, _, p in points])
    rows = F.array(*[F.struct(F.lit(float(f)).alias("floor"), F.lit(p).alias("persist"), F.lit(float(h)).alias("h"), F.col(f"__t{i}_{p}").alias("detected_at")) for i, h, f, p in points])
    return first.select(*key, F.inline(rows))


def operating_points(first: DataFrame, kind: Column, onset: Column) -> DataFrame:
    """Rates of every operating point over trials that are dry_run, closed_valve or healthy.

    A dry run counts as detected from its onset on; any trip of the others is a false one.
    """
    t = F.col("detected_at")
    hit = (kind == "dry_run") & (t >= onset)
    rate = lambda of, what: F.avg(F.when(kind == of, F.coalesce(what, F.lit(False)).cast("double")))
    return first.groupBy("floor", "persist", "h").agg(
        rate("dry_run", hit).alias("detection_rate"), rate("closed_valve", t.isNotNull()).alias("closed_valve_rate"), rate("healthy", t.isNotNull()).alias("healthy_rate"),
        F.percentile(F.when(hit, t - onset), F.lit(0.5)).alias("median_delay"))


def select_operating_point(points: DataFrame, most_false: float = 0.02, most_delay: float = 30.0) -> DataFrame:
    """The point that detects most, of these the fastest, within the budgets of false trips and delay; no row if none is."""
    fits = (F.greatest("closed_valve_rate", "healthy_rate") <= most_false) & (F.col("median_delay") <= most_delay)
    return points.where(fits).orderBy(F.desc("detection_rate"), "median_delay", "floor", "persist", "h").limit(1)


def kth_largest(df: DataFrame, key: Names, order: Names, score: str, k: int, n: int, out: str = "kth") -> DataFrame:
    """k-th largest of the last n scores; minus infinity before there are k."""
    frame = _order(key, order).rowsBetween(1 - n, 0)
    best = F.get(F.sort_array(F.collect_list(score).over(frame), False), F.lit(k - 1))
    return df.withColumn(out, F.coalesce(best, F.lit(float("-inf"))))


CHUNK = 4096  # of rows, or of tables, that are folded in one row


def rearmed_alarms(df: DataFrame, key: Names, order: Names, flag: str, k: int, n: int, blocks: int = BLOCKS) -> DataFrame:
    """Alarms of a k-of-the-last-n rule that forgets on firing (W16), one row a key; a null flag is none."""
    return alarms_of_rules(df, key, order, flag, [(k, n)], blocks).select(*key, "alarms")


def alarms_of_rules(df: DataFrame, key: Names, order: Names, flag: str, rules: Sequence[tuple[int, int]], blocks: int = BLOCKS) -> DataFrame:
    """``rearmed_alarms`` of several (k, n), one row a key and rule: key, k, n, alarms.

    A rule can only fire at a row with the flag, if the k-th flag before it is less than n
    rows away and not used up by the last alarm. So among a key's flags the state is how many
    of the next ones can't be first of an alarm's k, and a stretch of flags is a table from each
    of the k states to the state after it and its alarms. Tables of bounded stretches are made
    in parallel and composed; all rules go through one scan, with the largest k's states.
    """
    scan, one, by = Scan(key, order, blocks), F.coalesce(F.col(flag).cast("int"), F.lit(0)), [*key, "__k", "__of"]
    each = F.array(*[F.struct(F.lit(k).alias("__k"), F.lit(n).alias("__of")) for k, n in rules])
    df = scan.fold(scan.begin(df.withColumn("__f", one)), "__n", "sum", F.lit(1))
    rows = scan.end(scan.fold(df, "__i", "sum", F.col("__f"))).where("__f = 1").select(*key, F.col("__i").cast("long").alias("__i"), F.col("__n").alias("__at"), F.inline(each))
    last = rows.select(*by, (F.col("__i") - (F.col("__k") - 1)).alias("__i"), F.col("__at").alias("__end"))
    first = meet(rows, last, [*by, "__i"]).withColumn("__ok", F.coalesce(F.col("__end") - F.col("__at") < F.col("__of"), F.lit(False)))

    def over(table: Column, ok: Column) -> Column:  # one more flag: (blocked, alarms) of each starting state
        return F.transform(table, lambda s: F.struct(F.when(s["b"] > 0, s["b"] - 1).when(ok, F.col("__k") - 1).otherwise(0).alias("b"), (s["a"] + ((s["b"] == 0) & ok).cast("long")).alias("a")))

    def after(table: Column, then: Column) -> Column:
        return F.transform(table, lambda s: F.struct(F.get(then, s["b"])["b"].alias("b"), (s["a"] + F.get(then, s["b"])["a"]).alias("a")))

    same = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(0).cast("long").alias("a")) for b in range(max(k for k, _ in rules))])
    in_order = lambda column: F.transform(F.sort_array(F.collect_list(F.struct("__i", column))), lambda x: x[column])
    chunk = F.floor(F.col("__i") / CHUNK).alias("__i")
    tables = first.groupBy(*by, chunk).agg(F.aggregate(in_order("__ok"), same, over).alias("__t"))
    tables = tables.groupBy(*by, chunk).agg(F.aggregate(in_order("__t"), same, after).alias("__t"))
    total = tables.groupBy(*by).agg(F.aggregate(in_order("__t"), same, after, lambda t: F.get(t, F.lit(0))["a"]).alias("__alarms"))
    whole = df.select(*key).distinct().select(*key, F.inline(each))
    return meet(whole, total, by).select(*key, F.col("__k").alias("k"), F.col("__of").alias("n"), F.coalesce("__alarms", F.lit(0)).cast("int").alias("alarms"))


def as_of(grid: DataFrame, samples: DataFrame, key: Names, at: str, value: str) -> DataFrame:
    """The latest sample at or before each grid time, else the first sample (J4); of samples of one time the largest.

    Both are unioned and scanned once, in blocks of time: a grid row takes the last sample of
    its block up to it, or else that of the earlier blocks. A key without samples gives null.
    """
    both = grid.select(*key, at, F.lit(1).alias("__grid"), F.lit(None).cast("double").alias("__v")).unionByName(samples.select(*key, at, F.lit(0).alias("__grid"), F.col(value).cast("double").alias("__v")))
    out = last_value(both, key, [at, "__grid", "__v"], "__v", value).where("__grid = 1").drop("__grid", "__v")
    first = samples.where(F.col(value).isNotNull()).groupBy(*key).agg(F.min(F.struct(F.col(at).alias("at"), (-F.col(value).cast("double")).alias("v"))).alias("__first"))
    return meet(out, first, key).withColumn(value, F.coalesce(value, -F.col("__first.v"))).drop("__first")


def moving_rms(df: DataFrame, key: Names, order: Names, x: str, n: int, out: str = "rms") -> DataFrame:
    """Centred root mean square of n rows, with zeros beyond the ends."""
    frame = _order(key, order).rowsBetween(-(n // 2), (n - 1) // 2)
    return df.withColumn(out, F.sqrt(F.sum(F.col(x) * F.col(x)).over(frame) / n))


def interlocked(df: DataFrame, key: Names, order: Names, temperature: str, seconds: str, hot: float = 80.0, exposure: float = 20.0) -> DataFrame:
    """Blocks up to the first breach of temperature or exposure, that one included."""
    run, before = _so_far(key, order), _order(key, order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns({"exposure": F.sum(seconds).over(run), "peak": F.max(temperature).over(run)})
    df = df.withColumn("breach", (F.col(temperature) >= hot) | (F.col("exposure") >= exposure))
    df = df.withColumn("__over", F.max(F.col("breach").cast("int")).over(before))
    return df.where("__over is null or __over = 0").drop("__over")

"""Queries over telemetry: S17, P8, J4 and W1-W17."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sequential as seq
from .base import KEY, ORDER, READINGS, TELEMETRY, query, readings, rounded, telemetry

STATE_SQL = f"""
t AS ({TELEMETRY}), a AS (
  SELECT *, CASE WHEN load >= 60 THEN 1 WHEN load <= 30 THEN 0 WHEN load IS NOT NULL THEN -1 END AS asks FROM t
), k AS (
  SELECT *, CASE WHEN asks IS DISTINCT FROM lag(asks) OVER o THEN 1 ELSE 0 END AS turn FROM a WHERE asks IS NOT NULL WINDOW o AS (PARTITION BY machine ORDER BY ts, event_id)
), i AS (
  SELECT *, sum(turn) OVER (PARTITION BY machine ORDER BY ts, event_id) AS run FROM k
), l AS (
  SELECT *, row_number() OVER (PARTITION BY machine, run ORDER BY ts, event_id) AS n FROM i
), h AS (
  SELECT machine, event_id, coalesce(last_value(CASE WHEN asks <> -1 AND n >= 2 THEN asks END IGNORE NULLS) OVER (PARTITION BY machine ORDER BY ts, event_id), 0) AS held FROM l
), s AS (
  SELECT a.machine, a.ts, a.event_id, a.load, CASE WHEN a.asks IS NULL THEN 'unknown' WHEN held = 1 THEN 'running' ELSE 'off' END AS state FROM a LEFT JOIN h USING (machine, event_id)
)"""


def states(spark, sf_dir):
    return seq.run_state(telemetry(spark, sf_dir), KEY, ORDER, "load", 60.0, 30.0, 2)


@query("w1_block_windows", f"""
WITH t AS ({TELEMETRY}), n AS (SELECT *, (row_number() OVER (PARTITION BY machine ORDER BY ts, event_id) - 1) // 8 AS block FROM t)
SELECT machine, block::BIGINT AS block, round(avg(load), 6) AS load FROM n GROUP BY machine, block HAVING count(*) = 8 AND count(load) > 0""")
def block_windows(spark, sf_dir):
    """Means of eight readings."""
    return rounded(seq.blocks(telemetry(spark, sf_dir), KEY, ORDER, ["load"], 8).select("machine", "block", "load"), "load")


OTSU_SQL = """
b AS (SELECT machine, min(x) AS lo, max(x) AS hi, count(*) AS n, var_pop(x) AS variance FROM v GROUP BY machine),
c AS (SELECT v.machine, least(floor((x - lo) / ((hi - lo) / 256)), 255)::INT AS bin, count(*)::DOUBLE AS c FROM v JOIN b USING (machine) WHERE hi > lo GROUP BY ALL),
g AS (SELECT b.*, unnest(range(256))::INT AS bin FROM b WHERE hi > lo),
d AS (SELECT g.*, coalesce(c, 0) AS c, lo + (bin + 0.5) * ((hi - lo) / 256) AS centre FROM g LEFT JOIN c USING (machine, bin)),
w AS (SELECT *, sum(c) OVER o AS w0, sum(c * centre) OVER o AS m0, sum(c) OVER p AS a, sum(c * centre) OVER p AS m FROM d
      WINDOW o AS (PARTITION BY machine ORDER BY bin), p AS (PARTITION BY machine)),
x AS (SELECT *, CASE WHEN w0 > 0 AND a - w0 > 0 THEN round(w0 / a * (a - w0) / a * (m0 / w0 - (m - m0) / (a - w0)) * (m0 / w0 - (m - m0) / (a - w0)), 9) END AS q FROM w),
y AS (SELECT *, max(q) OVER (PARTITION BY machine) AS top FROM x),
z AS (SELECT machine, list_sort(list(centre)) AS t, min(top) AS top, min(variance) AS variance FROM y WHERE q = top GROUP BY machine),
f AS (SELECT b.machine, lo, hi, n, t[len(t) // 2 + 1] AS threshold, greatest(0, least(1, top / z.variance)) AS separability FROM b LEFT JOIN z USING (machine))"""


@query("w2_otsu_threshold", f"WITH v AS (SELECT user_id AS machine, value AS x FROM events), {OTSU_SQL} SELECT machine, n, round(threshold, 6) AS threshold, round(separability, 6) AS separability FROM f")
def otsu_threshold(spark, sf_dir):
    """Threshold between two modes of each machine."""
    out = seq.otsu(readings(spark, sf_dir), KEY, "value")
    return rounded(out.select("machine", "n", "threshold", "separability"), "threshold", "separability")


@query("w3_run_thresholds", f"""WITH v AS (SELECT user_id AS machine, value AS x FROM events), {OTSU_SQL}
SELECT machine, CASE WHEN hi = lo THEN 'never runs' WHEN separability < 0.7 THEN 'one mode' ELSE 'ok' END AS status,
       CASE WHEN hi > lo AND separability >= 0.7 THEN round(threshold + 0.25 * least(threshold - lo, hi - threshold), 6) END AS "on",
       CASE WHEN hi > lo AND separability >= 0.7 THEN round(threshold - 0.25 * least(threshold - lo, hi - threshold), 6) END AS "off" FROM f""")
def run_thresholds(spark, sf_dir):
    """On and off levels of each machine, with a status where there are none."""
    out = seq.run_thresholds(seq.otsu(readings(spark, sf_dir), KEY, "value"), least=0.7)
    return rounded(out.select("machine", "status", "on", "off"), "on", "off")


@query("w4_run_state", f"WITH {STATE_SQL} SELECT machine, event_id, state FROM s")
def run_state(spark, sf_dir):
    """State of every reading."""
    return states(spark, sf_dir).select("machine", "event_id", "state")


@query("w4_run_state_counts", f"WITH {STATE_SQL} SELECT state, count(*)::BIGINT AS n FROM s GROUP BY state")
def run_state_counts(spark, sf_dir):
    """Readings by state."""
    return states(spark, sf_dir).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("w5_running_mask", f"WITH {STATE_SQL} SELECT machine, count(*) FILTER (state = 'running')::BIGINT AS n_running, round(avg(load) FILTER (state = 'running'), 6) AS mean_load FROM s GROUP BY machine")
def running_mask(spark, sf_dir):
    """Running readings and their mean load by machine."""
    on = F.col("state") == "running"
    return rounded(states(spark, sf_dir).groupBy("machine").agg(F.count(F.when(on, 1)).alias("n_running"), F.avg(F.when(on, F.col("load"))).alias("mean_load")), "mean_load")


CUSUM_SQL = f"""
e AS ({READINGS}), m AS (SELECT avg(value) AS mu, stddev_pop(value) AS sd FROM e),
z AS (SELECT e.*, (value - mu) / (sd + 1e-12) AS z FROM e, m),
c AS (SELECT *, sum(-z - 0.5) OVER o AS cn, sum(z - 0.5) OVER o AS cp FROM z WINDOW o AS (PARTITION BY machine ORDER BY ts, event_id)),
s AS (SELECT *, cn - least(0, min(cn) OVER o) AS s_neg, cp - least(0, min(cp) OVER o) AS s_pos FROM c WINDOW o AS (PARTITION BY machine ORDER BY ts, event_id))"""


def with_baseline(spark, sf_dir):
    """Readings beside the mean and deviation of all, which is one row."""
    e = readings(spark, sf_dir)
    return e.crossJoin(F.broadcast(e.agg(F.avg("value").alias("mu"), F.stddev_pop("value").alias("sd"))))


@query("w6_cusum_down", f"WITH {CUSUM_SQL} SELECT machine, event_id, round(s_neg, 6) AS score, s_neg >= 1 AS hit FROM s")
def cusum_down(spark, sf_dir):
    """Downward cumulative sums of every reading."""
    out = seq.cusum(with_baseline(spark, sf_dir), KEY, ORDER, F.col("value"), F.col("mu"), F.col("sd"), 0.5, 1.0)
    return rounded(out.select("machine", "event_id", "score", "hit"), "score")


@query("w6_cusum_two_sided", f"WITH {CUSUM_SQL} SELECT machine, event_id, round(s_neg, 6) AS s_neg, round(s_pos, 6) AS s_pos, round(greatest(s_neg, s_pos), 6) AS score FROM s")
def cusum_two_sided(spark, sf_dir):
    """Both cumulative sums of every reading."""
    out = seq.cusum(with_baseline(spark, sf_dir), KEY, ORDER, F.col("value"), F.col("mu"), F.col("sd"), 0.5, 5.0, two_sided=True)
    return rounded(out.select("machine", "event_id", "s_neg", "s_pos", "score"), "s_neg", "s_pos", "score")


@query("w7_ewma_scores", f"""
WITH e AS ({READINGS}), m AS (SELECT avg(value) AS mu, stddev_pop(value) AS sd FROM e),
l AS (SELECT machine, event_id, list(value) OVER (PARTITION BY machine ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM e),
z AS (SELECT l.*, mu, sd, list_reduce(list_prepend(mu, v), lambda a, b: b * 0.2 + a * 0.8) AS z FROM l, m)
SELECT machine, event_id, round(z, 6) AS z, round(abs(z - mu) / (sd * sqrt(0.2 / 1.8)), 6) AS score FROM z""")
def ewma_scores(spark, sf_dir):
    """Weighted mean and its score at every reading."""
    out = seq.ewma(with_baseline(spark, sf_dir), KEY, ORDER, "value", F.col("mu"), 0.2)
    out = out.withColumn("score", seq.ewma_score(F.col("z"), F.col("mu"), F.col("sd"), 0.2))
    return rounded(out.select("machine", "event_id", "z", "score"), "z", "score")


TRIP_SQL = f"""
{CUSUM_SQL}, f AS (SELECT *, (s_neg >= 1 AND value < 20)::INT AS flag FROM s),
g AS (SELECT *, sum(1 - flag) OVER (PARTITION BY machine ORDER BY ts, event_id) AS gap FROM f),
q AS (SELECT *, sum(flag) OVER (PARTITION BY machine, gap ORDER BY ts, event_id) >= 2 AS tripped FROM g)"""


def tripped(spark, sf_dir):
    return seq.trips(with_baseline(spark, sf_dir), KEY, ORDER, "value", F.col("mu"), F.col("sd"), 0.5, 1.0, F.lit(20.0), 2)


@query("w12_first_trip", f"WITH {TRIP_SQL} SELECT machine, min(ts) FILTER (tripped) AS detected_at, count(*)::BIGINT AS n_rows, min(ts) FILTER (tripped) + INTERVAL 50000 MICROSECOND AS trip_at FROM q GROUP BY machine")
def first_trip(spark, sf_dir):
    """First dry-run trip of each machine, null for those that never trip."""
    return seq.first_trip(tripped(spark, sf_dir), KEY, "ts")


@query("w13_trip_outcomes", f"""
WITH {TRIP_SQL}, t AS (SELECT machine, epoch_us(min(ts) FILTER (tripped)) / 1e6 AS t, epoch_us(min(ts)) / 1e6 AS t0 FROM q GROUP BY machine), d AS (SELECT *, t0 + 86400.0 * 5 AS onset, machine % 3 <> 0 AS expected FROM t)
SELECT machine, round(CASE WHEN expected AND t >= onset THEN t - onset END, 3) AS delay, t IS NOT NULL AND (NOT expected OR t < onset) AS false_trip, t IS NOT NULL AND expected AND t >= onset AS detected FROM d""")
def trip_outcomes(spark, sf_dir):
    """Delay and false trips, with a fault five days in on two machines of three."""
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    first = tripped(spark, sf_dir).withColumn("t", seconds).groupBy("machine").agg(F.min(F.when(F.col("tripped"), F.col("t"))).alias("detected_at"), F.min("t").alias("t0"))
    out = seq.trip_outcome(first, F.col("t0") + 86400.0 * 5, F.col("machine") % 3 != 0)
    return rounded(out.select("machine", "delay", "false_trip", "detected"), "delay", places=3)


@query("w15_operating_points", f"""
WITH e AS ({READINGS}), m AS (SELECT avg(value) AS mu, stddev_pop(value) AS sd FROM e),
p AS (SELECT h, fl FROM (VALUES (0.5), (1.0), (1.5)) a(h), (VALUES (10.0), (20.0), (40.0)) b(fl)),
z AS (SELECT e.*, -(value - mu) / (sd + 1e-12) - 0.5 AS i FROM e, m), c AS (SELECT *, sum(i) OVER (PARTITION BY machine ORDER BY ts, event_id) AS c FROM z),
s AS (SELECT *, c - least(0, min(c) OVER (PARTITION BY machine ORDER BY ts, event_id)) AS s FROM c)
SELECT h::DOUBLE AS h, fl::DOUBLE AS floor, count(DISTINCT machine) FILTER (s >= h AND value < fl)::BIGINT AS n_tripped FROM s, p GROUP BY h, fl""")
def operating_points(spark, sf_dir):
    """Machines that trip at each pair of level and floor; the sums are made once."""
    scored = seq.cusum(with_baseline(spark, sf_dir), KEY, ORDER, F.col("value"), F.col("mu"), F.col("sd"), 0.5)
    points = [(h, f) for h in (0.5, 1.0, 1.5) for f in (10.0, 20.0, 40.0)]
    per = scored.groupBy("machine").agg(*[F.max(((F.col("score") >= h) & (F.col("value") < f)).cast("int")).alias(f"p{i}") for i, (h, f) in enumerate(points)])
    sums = per.agg(*[F.sum(f"p{i}").alias(f"p{i}") for i in range(len(points))])
    rows = F.array(*[F.struct(F.lit(h).alias("h"), F.lit(f).alias("floor"), F.col(f"p{i}").cast("long").alias("n_tripped")) for i, (h, f) in enumerate(points)])
    return sums.select(F.inline(rows))


FLOORS, PERSISTS, LEVELS = [10.0, 15.0, 20.0, 25.0, 30.0, 40.0, 60.0], [1, 2, 3, 5, 8], [0.5, 1.0, 2.0]
KINDS = ["dry_run", "closed_valve", "healthy"]
SWEEP = f"""{CUSUM_SQL}, g AS (SELECT unnest({LEVELS})::DOUBLE AS h), fl AS (SELECT unnest({FLOORS})::DOUBLE AS floor), pe AS (SELECT unnest({PERSISTS})::INT AS persist),
q AS (SELECT machine, epoch_us(ts) / 1e6 AS t, event_id, h, floor, s_neg >= h AND value < floor AS flag, row_number() OVER (PARTITION BY machine, h, floor ORDER BY ts, event_id) AS n FROM s, g, fl),
ru AS (SELECT *, n - coalesce(max(CASE WHEN NOT flag THEN n END) OVER (PARTITION BY machine, h, floor ORDER BY t, event_id), 0) AS run FROM q),
o AS (SELECT machine, {KINDS}[machine % 3 + 1] AS kind, min(epoch_us(ts)) / 1e6 + 86400.0 * 5 AS onset FROM e GROUP BY machine),
fi AS (SELECT ru.machine, h, floor, persist, min(t) FILTER (run >= persist) AS t FROM ru, pe GROUP BY ALL),
pt AS (SELECT floor, persist, h, avg((coalesce(t >= onset, false))::INT) FILTER (kind = 'dry_run') AS detection_rate, avg((t IS NOT NULL)::INT) FILTER (kind = 'closed_valve') AS closed_valve_rate,
       avg((t IS NOT NULL)::INT) FILTER (kind = 'healthy') AS healthy_rate, quantile_cont(t - onset, 0.5) FILTER (kind = 'dry_run' AND t >= onset) AS median_delay FROM fi JOIN o USING (machine) GROUP BY floor, persist, h)"""


def swept(spark, sf_dir):
    """All points of the sweep; machines are dry runs, closed valves and healthy ones in turn, five days in."""
    e = with_baseline(spark, sf_dir).withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    first = seq.trip_sweep(e, KEY, ORDER, "value", "t", F.col("mu"), F.col("sd"), FLOORS, PERSISTS, LEVELS)
    kinds = e.groupBy("machine").agg((F.min("t") + 86400.0 * 5).alias("onset")).withColumn("kind", F.get(F.array(*map(F.lit, KINDS)), (F.col("machine") % 3).cast("int")))
    return seq.operating_points(first.join(kinds, "machine"), F.col("kind"), F.col("onset"))


@query("w15_trip_sweep", f"WITH {SWEEP} SELECT floor, persist, h, round(detection_rate, 6) AS detection_rate, round(closed_valve_rate, 6) AS closed_valve_rate, round(healthy_rate, 6) AS healthy_rate, round(median_delay, 3) AS median_delay FROM pt")
def trip_sweep(spark, sf_dir):
    """Rates and delay of 105 operating points."""
    return rounded(rounded(swept(spark, sf_dir), "detection_rate", "closed_valve_rate", "healthy_rate"), "median_delay", places=3)


@query("w15_selected_point", f"WITH {SWEEP} SELECT floor, persist, h, round(detection_rate, 6) AS detection_rate FROM pt WHERE greatest(closed_valve_rate, healthy_rate) <= 0.6 AND median_delay <= 86400.0 * 30 ORDER BY pt.detection_rate DESC, median_delay, floor, persist, h LIMIT 1")
def selected_point(spark, sf_dir):
    """The chosen point of the sweep."""
    return rounded(seq.select_operating_point(swept(spark, sf_dir), 0.6, 86400.0 * 30).select("floor", "persist", "h", "detection_rate"), "detection_rate")


@query("w16_rearmed_alarms", f"""
WITH RECURSIVE e AS (SELECT user_id AS machine, list((value >= 60)::INT ORDER BY ts, event_id) AS f FROM events GROUP BY user_id),
s AS (SELECT machine, f, 0 AS i, 0 AS alarms, []::INT[] AS b FROM e
  UNION ALL SELECT machine, f, i + 1, alarms + (CASE WHEN list_sum(list_prepend(f[i + 1], b)[1:5]) >= 3 THEN 1 ELSE 0 END),
    CASE WHEN list_sum(list_prepend(f[i + 1], b)[1:5]) >= 3 THEN []::INT[] ELSE list_prepend(f[i + 1], b)[1:5] END FROM s WHERE i < len(f))
SELECT machine, max(alarms)::INT AS alarms FROM s GROUP BY machine""")
def rearmed_alarms(spark, sf_dir):
    """Alarms of three of the last five readings, forgetting on each."""
    return seq.rearmed_alarms(readings(spark, sf_dir).withColumn("high", F.col("value") >= 60), KEY, ORDER, "high", 3, 5)


@query("w17_kth_largest", f"""
WITH e AS ({READINGS}), l AS (SELECT machine, event_id, list_reverse_sort(list(value) OVER (PARTITION BY machine ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) AS v FROM e)
SELECT machine, event_id, CASE WHEN len(v) >= 3 THEN v[3] END AS kth FROM l""")
def kth_largest(spark, sf_dir):
    """Third largest of the last five readings, null before there are three."""
    out = seq.kth_largest(readings(spark, sf_dir), KEY, ORDER, "value", 3, 5)
    return out.select("machine", "event_id", F.when(F.col("kth") > float("-inf"), F.col("kth")).alias("kth"))


@query("j4_as_of", """
WITH s AS (SELECT user_id AS machine, ts AS t, max(value) AS value FROM events GROUP BY ALL), b AS (SELECT machine, min(t) AS t0, max(t) AS t1, arg_min(value, t) AS v0 FROM s GROUP BY machine),
g AS (SELECT machine, v0, unnest(generate_series(t0, t1, INTERVAL 1 DAY)) AS at FROM b)
SELECT g.machine, g.at, coalesce(s.value, v0) AS value FROM g ASOF LEFT JOIN s ON g.machine = s.machine AND g.at >= s.t""")
def as_of(spark, sf_dir):
    """Daily resampling by the latest reading."""
    s = readings(spark, sf_dir).groupBy("machine", F.col("ts").alias("at")).agg(F.max("value").alias("value"))
    grid = s.groupBy("machine").agg(F.min("at").alias("a"), F.max("at").alias("b")).select("machine", F.explode(F.expr("sequence(a, b, interval 1 day)")).alias("at"))
    return seq.as_of(grid, s, KEY, "at", "value")


@query("p8_moving_rms", f"WITH e AS ({READINGS}) SELECT machine, event_id, round(sqrt(sum(value * value) OVER (PARTITION BY machine ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) / 4), 6) AS rms FROM e")
def moving_rms(spark, sf_dir):
    """Centred root mean square of four readings."""
    return rounded(seq.moving_rms(readings(spark, sf_dir), KEY, ORDER, "value", 4).select("machine", "event_id", "rms"), "rms")


@query("s17_interlock", f"""
WITH e AS ({READINGS}), x AS (SELECT *, sum(0.25) OVER o AS exposure, max(value) OVER o AS peak FROM e WINDOW o AS (PARTITION BY machine ORDER BY ts, event_id)),
b AS (SELECT *, (value >= 180 OR exposure >= 12)::INT AS breach FROM x), y AS (SELECT *, coalesce(max(breach) OVER (PARTITION BY machine ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b)
SELECT machine, count(*)::BIGINT AS n_blocks, max(peak) AS peak, max(breach) = 1 AS aborted FROM y WHERE before = 0 GROUP BY machine""")
def interlock(spark, sf_dir):
    """Blocks kept by an acquisition that stops at its first breach."""
    out = seq.interlocked(readings(spark, sf_dir).withColumn("s", F.lit(0.25)), KEY, ORDER, "value", "s", 180.0, 12.0)
    return out.groupBy("machine").agg(F.count(F.lit(1)).alias("n_blocks"), F.max("peak").alias("peak"), (F.max(F.col("breach").cast("int")) == 1).alias("aborted"))

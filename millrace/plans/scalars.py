"""Queries of the scalar functions: P1-P4, P9 and F1-F26 over table columns as grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lookups, physics, radio
from ..tables import table
from .base import query, r, rounded


def parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"), (F.col("p_partkey") % 6 + 7).cast("int").alias("sf"), (F.col("p_partkey") % 4 + 1).cast("int").alias("cr"))


PARTS = "p AS (SELECT p_partkey, p_size::DOUBLE AS x, p_retailprice AS y, (p_partkey % 6 + 7)::INT AS sf, (p_partkey % 4 + 1)::INT AS cr FROM part)"


def scalar(name: str, columns: str):
    """Register a query of p_partkey and columns; ``columns`` are SQL, rounded on both sides."""
    pairs = [c.split(":=") for c in columns.strip().split(";\n")]
    names = [a.strip() for a, _ in pairs]
    sql = f"WITH {PARTS} SELECT p_partkey, " + ", ".join(f"round(({b.strip()})::DOUBLE, 6) AS {a.strip()}" for a, b in pairs) + " FROM p"

    def add(f):
        def run(spark, sf_dir):
            return rounded(parts(spark, sf_dir).select("p_partkey", *[c.alias(n) for n, c in f(F.col("x"), F.col("y")).items()]), *names).select("p_partkey", *names)

        run.__doc__ = f.__doc__
        query(name, sql)(run)
        return f

    return add


@scalar("f1_f2_speeds", "shaft := (x + 700) / 60.0;\nvane := (x % 9 + 1) * (x + 700) / 60.0")
def speeds(x, y):
    """Shaft and vane-pass frequencies."""
    return {"shaft": physics.shaft_hz(x + 700), "vane": physics.vane_pass_hz(x + 700, x % 9 + 1)}


@scalar("f3_bearing_frequencies", """bpfo := 4 * (x + 900) / 60.0 * (1 - 7.9 / (x + 30) * cos(radians(15)));
bpfi := 4 * (x + 900) / 60.0 * (1 + 7.9 / (x + 30) * cos(radians(15)));
bsf := (x + 30) / 7.9 * (x + 900) / 120.0 * (1 - (7.9 / (x + 30) * cos(radians(15))) ** 2);
ftf := (x + 900) / 120.0 * (1 - 7.9 / (x + 30) * cos(radians(15)))""")
def bearings(x, y):
    """Outer race, inner race, ball and cage frequencies."""
    return physics.bearing_hz(x + 900, 8, 7.9, x + 30, 15.0)


@scalar("f4_f5_npsh", """available := (y * 100 - 2339) / (998.0 * 9.80665) + (x / 10) ** 2 / (2 * 9.80665);
severity := greatest(0.0, least(1.0, (1.5 - greatest((y * 100 - 2339) / (998.0 * 9.80665), 0.0) / (x / 5 + 1)) / 1.5))""")
def npsh(x, y):
    """Net positive suction head and the severity that follows."""
    return {"available": physics.npsh_available(y * 100, 2339.0, 998.0, x / 10), "severity": physics.cavitation_from_npsh(physics.npsh_available(y * 100, 2339.0, 998.0), x / 5 + 1)}


@scalar("f6_f7_cavitation", """intensity := CASE WHEN x / 50 <= 0.4 THEN pow(x / 50 / 0.4, 1.2) ELSE 1 - 0.75 * pow((least(x / 50, 1.0) - 0.4) / 0.6, 1.5) END;
energy := 0.05 + (CASE WHEN x / 50 <= 0.4 THEN pow(x / 50 / 0.4, 1.2) ELSE 1 - 0.75 * pow((least(x / 50, 1.0) - 0.4) / 0.6, 1.5) END) * exp(-0.5 * ((log10(3000.0) - log10(1500.0)) / 0.4) ** 2)""")
def cavitation(x, y):
    """Broadband intensity and energy from 2 to 4 kHz."""
    return {"intensity": physics.cavitation_intensity(x / 50), "energy": physics.cavitation_band_energy(x / 50, 2000.0, 4000.0)}


@scalar("f8_f9_dry_run", """dry := greatest(0.0, 10 * (1 + (0.45 - 1) * (1 - exp(-greatest(x / 10 - 1, 0.0) / 0.5))));
closed := greatest(0.0, 10 * (1 + (0.70 - 1) * (1 - exp(-greatest(x / 10 - 1, 0.0) / 0.5))));
vane := 0.05 + 0.95 * exp(-greatest(x / 10 - 1, 0.0) / 0.8)""")
def dry_run(x, y):
    """Currents and vane-pass amplitude through an onset at one second."""
    return {"dry": physics.dry_run_current(x / 10, 1.0, F.lit("dry_run")), "closed": physics.dry_run_current(x / 10, 1.0, F.lit("closed_valve")), "vane": physics.dry_run_vane_amplitude(x / 10, 1.0)}


@scalar("f10_f12_sidebands", """slip := least(x / 25, 1.5) * 0.03;
low := 50 * (1 - 2 * least(x / 25, 1.5) * 0.03);
high := 50 * (1 + 2 * least(x / 25, 1.5) * 0.03);
vpf := 1 - 0.3 * least(x / 40, 1.0);
side := 0.45 * least(x / 40, 1.0)""")
def sidebands(x, y):
    """Slip, rotor-bar sidebands and impeller sidebands."""
    s = physics.motor_slip(x / 25)
    bars, imp = physics.rotor_bar_hz(50.0, s), physics.impeller_sidebands(x / 40)
    return {"slip": s, "low": F.get(bars, F.lit(0)), "high": F.get(bars, F.lit(1)), "vpf": imp["vpf"], "side": imp["upper"]}


AIR = "(12.25 + 8 + greatest(ceil((8 * {b} - 4 * {sf} + 28 + 16) / (4.0 * ({sf} - 2 * ({sf} >= 11)::INT))) * ({cr} + 4), 0)) * pow(2, {sf}) / 125000"
FULL, BEAT = AIR.format(b="(8 + 4 * x)", sf="9", cr="1"), AIR.format(b="12", sf="9", cr="1")


@query("f13_f14_airtime", f"WITH {PARTS} SELECT p_partkey, (8 + 4 * x)::BIGINT AS size, round({AIR.format(b='(8 + 4 * x)', sf='sf', cr='cr')}, 6) AS seconds FROM p")
def airtime(spark, sf_dir):
    """Payload and time on air at all spreading factors and coding rates."""
    size = radio.vector_bytes(F.col("x"))
    return parts(spark, sf_dir).select("p_partkey", size.cast("long").alias("size"), r(radio.airtime_seconds(size, F.col("sf"), F.col("cr"))).alias("seconds"))


FIXED = f"((2.6 * 2 + 1.5 * 0.5 + 45 * (y % 1 * {FULL} + (1 - y % 1) * {BEAT}) + 4.2 * 0.2 + 0.01 * greatest(x * 20 + 100 - (2.7 + y % 1 * {FULL} + (1 - y % 1) * {BEAT}), 0)) * 86400 / (x * 20 + 100))"


@scalar("f15_fixed_schedule", f"""mah_per_day := {FIXED} / 3600;
battery_years := 2400 / ({FIXED} / 3600) / 365.25;
tx_fraction := 45 * (y % 1 * {FULL} + (1 - y % 1) * {BEAT}) * 86400 / (x * 20 + 100) / {FIXED};
tx_per_day := 86400 / (x * 20 + 100) * (y % 1)""")
def fixed(x, y):
    """Battery of a node that wakes every interval."""
    out = radio.fixed_schedule(x * 20 + 100, x, y % 1)
    return {k: out[k] for k in ("mah_per_day", "battery_years", "tx_fraction", "tx_per_day")}


EVENT = f"(1.8 * (x % 24) * 3600 + 4 * (x % 24) * 5.95 + 45 * (4 * (x % 24) * (y % 1) * {FULL} + 6 * (x % 24) * {BEAT}) + 0.84 * (4 * (x % 24) * (y % 1) + 6 * (x % 24)) + 0.0014 * (86400 - (x % 24) * 3600))"


@scalar("f16_event_triggered", f"""mah_per_day := {EVENT} / 3600;
battery_years := 2400 / ({EVENT} / 3600) / 365.25;
tx_per_day := 4 * (x % 24) * (y % 1);
cusum_mah := 1.8 * (x % 24);
wake_mah := 0.0014 * (86400 - (x % 24) * 3600) / 3600""")
def event(x, y):
    """Battery of a node that wakes with its pump."""
    out = radio.event_triggered(x % 24, x, beats_per_hour=6.0, windows_per_hour=4.0, rate=y % 1)
    return {k: out[k] for k in ("mah_per_day", "battery_years", "tx_per_day", "cusum_mah", "wake_mah")}


@scalar("f18_f20_duty", "per_day := x / 10 * 3;\nper_month := x / 10 * 3 * 30;\nhours_between := 24 / (x / 10 * 3);\nfar := 1 / (x / 10 * 3 * 30)")
def duty(x, y):
    """Decisions, latency and false-alarm budget of a schedule."""
    return radio.duty_columns(x / 10, 3.0)


@scalar("f21_f22_commissioning", "required := ceil(10 * x * 1.5);\ndays := ceil(10 * x * 1.5) / 36;\ncommissioned := (y >= ceil(10 * x * 1.5))::INT;\nfraction := y / ceil(10 * x * 1.5)")
def commissioning(x, y):
    """Windows a baseline takes, and progress towards it."""
    plan, seen = radio.commissioning(x), radio.progress(y, x)
    return plan | {"commissioned": seen["commissioned"].cast("int"), "fraction": seen["fraction"]}


@scalar("f23_f26_policies", "renew := (x >= 30 OR y >= 1200)::INT;\nalias := least((y * 10) % 1670, 1670 - (y * 10) % 1670);\nranked := (x >= 5)::INT")
def policies(x, y):
    """Baseline renewal, aliasing and the rank test's least number of groups."""
    return {"renew": radio.should_update(x, y, enough=1200).cast("int"), "alias": physics.aliased_hz(y * 10, 1670.0), "ranked": radio.nemenyi_allowed(x).cast("int")}


PLAN = {"fs_hi": 26_700.0, "n_hi": 4096, "decimation": 16, "n_lo": 4096}


@query("f24_acquisition_plan", f"WITH {PARTS} SELECT p_partkey, round((600 + x * 20) / 60, 6) AS shaft, round(y * 10, 6) AS f, (600 + x * 20) / 60 >= 10 * 26700.0 / 16 / 4096 AS resolves, y * 10 < 13350 AS reaches FROM p")
def acquisition(spark, sf_dir):
    """Whether the low rate resolves sidebands and the high rate reaches a frequency."""
    shaft, f = (600 + F.col("x") * 20) / 60, F.col("y") * 10
    bin_lo = PLAN["fs_hi"] / PLAN["decimation"] / PLAN["n_lo"]
    return parts(spark, sf_dir).select("p_partkey", r(shaft).alias("shaft"), r(f).alias("f"), (shaft >= 10 * bin_lo).alias("resolves"), (f < PLAN["fs_hi"] / 2).alias("reaches"))


FOLDERS = "/".join(f"{name}{tail}" for name in lookups.CONDITIONS for tail in ("", " 3", " 2b"))
PAIRS = "UNION ALL ".join(f"SELECT '{k}' AS family, '{v}' AS label " for k, v in lookups.CONDITIONS.items())
COLLAPSED = "UNION ALL ".join(f"SELECT '{k}' AS label, '{v}' AS class " for k, v in lookups.CLASSES.items())
FOLDER_SQL = f"""
f AS (SELECT p_partkey, string_split('{FOLDERS}', '/')[(p_partkey % {len(lookups.CONDITIONS) * 3} + 1)::INT] AS folder FROM part),
s AS (SELECT *, regexp_extract(lower(trim(folder)), '\\s+(\\d+[a-z]?)$', 1) AS tail FROM f),
d AS (SELECT p_partkey, folder, regexp_replace(lower(trim(folder)), '\\s+\\d+[a-z]?$', '') AS family, TRY_CAST(regexp_replace(tail, '[a-z]', '') AS INT) AS severity FROM s),
c AS ({PAIRS}), k AS ({COLLAPSED})"""


def folders(spark, sf_dir):
    names = F.split(F.lit(FOLDERS), "/")
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.get(names, (F.col("p_partkey") % (len(lookups.CONDITIONS) * 3)).cast("int")).alias("folder"))


@query("p1_parse_condition", f"WITH {FOLDER_SQL} SELECT p_partkey, folder, family, severity, label FROM d JOIN c USING (family)")
def parse_condition(spark, sf_dir):
    """Label, family and severity of condition folders."""
    return lookups.parse_condition(folders(spark, sf_dir), "folder")


@query("p2_collapse_labels", f"WITH {FOLDER_SQL}, w AS (SELECT CASE WHEN label = 'bearing_pump' THEN 'bearing_outer' ELSE label END AS label FROM d JOIN c USING (family)) SELECT class, count(*)::BIGINT AS n FROM w JOIN k USING (label) GROUP BY class")
def collapse(spark, sf_dir):
    """Rows by class of all fault families; the one without a class is relabelled as an outer-race fault."""
    label = F.when(F.col("label") == "bearing_pump", "bearing_outer").otherwise(F.col("label"))
    rows = lookups.parse_condition(folders(spark, sf_dir), "folder").withColumn("label", label)
    return lookups.collapse_labels(rows, "label").groupBy("class").agg(F.count(F.lit(1)).alias("n"))


@query("p4_session_ids", f"WITH {FOLDER_SQL} SELECT p_partkey, 'NK80-250_' || family || '_' || coalesce(severity::VARCHAR, 'None') || '_100' AS session_id FROM d")
def session_ids(spark, sf_dir):
    """Session keys from pump, condition, severity and speed."""
    rows = folders(spark, sf_dir).withColumns(lookups.condition_parts(F.col("folder")))
    return rows.select("p_partkey", lookups.session_id(F.lit("NK80-250"), F.col("family"), F.col("severity"), F.lit(100)).alias("session_id"))


RESULT_KEY = "CASE event_id % 4 WHEN 0 THEN 'ladder__' || event_id % 3 || '_rung__' || event_type WHEN 1 THEN event_type || '__pooled' WHEN 2 THEN event_type || '__per_machine__' || event_id % 2 ELSE event_type END"


@query("p9_result_keys", rf"WITH k AS (SELECT {RESULT_KEY} AS key FROM events), m AS (SELECT regexp_extract(key, '^ladder__(.*?)__(.*)$', ['rung', 'model']) AS l, regexp_extract(key, '^(.*?)__(.*)$', ['model', 'strategy']) AS p, starts_with(key, 'ladder__') AS is_l, contains(key, '__') AS is_p FROM k) SELECT CASE WHEN is_l THEN l.rung END AS rung, CASE WHEN is_l THEN l.model WHEN is_p THEN p.model END AS model, CASE WHEN is_p AND NOT is_l THEN p.strategy END AS strategy, count(*)::BIGINT AS n FROM m GROUP BY ALL")
def result_keys(spark, sf_dir):
    """Results by rung, model and strategy of their keys."""
    keys = table(spark, sf_dir, "events").select(F.expr(RESULT_KEY).alias("key"))
    return keys.select(*[c.alias(n) for n, c in lookups.result_key(F.col("key")).items()]).groupBy("rung", "model", "strategy").agg(F.count(F.lit(1)).alias("n"))

"""Scalar functions against literal values."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import lookups, physics, radio
from millrace.operators import baseline


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_speeds(spark):
    assert value(spark, physics.shaft_hz(1440)) == 24.0
    assert value(spark, physics.vane_pass_hz(1440, 6)) == 144.0
    assert value(spark, physics.vane_pass_hz(2880, 6)) == 288.0
    with pytest.raises(Exception, match="rpm"):
        value(spark, physics.shaft_hz(0))


def test_bearing_identities(spark):
    f = physics.bearing_hz(1500, 8, 7.9, 34.5, 10.0)
    got = spark.range(1).select(*[c.alias(k) for k, c in f.items()]).first()
    assert got["bpfo"] + got["bpfi"] == pytest.approx(8 * 25.0)
    assert got["bpfo"] == pytest.approx(8 * got["ftf"])


def test_cavitation_is_not_monotonic(spark):
    at = lambda s: value(spark, physics.cavitation_intensity(s))
    assert at(0.0) == 0 and at(0.4) == pytest.approx(1.0) and at(1.0) == pytest.approx(0.25) and at(0.7) < at(0.4)
    assert value(spark, physics.cavitation_from_npsh(3.0, 2.0)) == 0.0


def test_radio_and_energy(spark):
    assert value(spark, radio.symbol_seconds(9)) == pytest.approx(0.004096)
    assert value(spark, radio.vector_bytes(30)) == 128
    with pytest.raises(Exception, match="SF"):
        value(spark, radio.airtime_seconds(10, 13))
    rates = [value(spark, radio.event_triggered(rate=r)["battery_years"]) for r in (0.0, 0.5, 1.0, 2.0)]
    assert rates[0] > rates[1] > rates[2] == rates[3]
    parts = radio.event_triggered()
    got = spark.range(1).select(*[c.alias(k) for k, c in parts.items()]).first()
    assert got["mah_per_day"] == pytest.approx(sum(got[f"{k}_mah"] for k in ("cusum", "features", "tx", "rx", "wake")))


def test_duty_and_commissioning(spark):
    d = radio.Duty()
    assert d.per_day == pytest.approx(1) and d.per_month == pytest.approx(30) and d.false_alarm_rate() == pytest.approx(1 / 30)
    for n in (1080, 90, 30, 12):
        other = d.deciding(n)
        assert other.per_month == pytest.approx(n) and other.learning_per_hour == d.learning_per_hour
    with pytest.raises(ValueError):
        radio.Duty(hours_per_day=0)
    p = radio.progress(55, 8)
    assert value(spark, p["required"]) == 120 and value(spark, p["commissioned"]) is False
    assert value(spark, radio.commissioning(10)["required"]) == 150
    assert [value(spark, radio.should_update(*x)) for x in ((31, 0), (1, 100), (1, 10))] == [True, True, False]


def test_conditions(spark):
    rows = [("bearing bpfo 3", "bearing_outer", "bearing bpfo", 3), (" Impeller ", "impeller_damage", "impeller", None), ("soft foot 2b", "soft_foot", "soft foot", 2), ("healthy", "healthy", "healthy", None)]
    got = lookups.parse_condition(spark.createDataFrame([(r[0],) for r in rows], "folder string"), "folder").select("label", "family", "severity").collect()
    assert [tuple(g) for g in got] == [r[1:] for r in rows]
    with pytest.raises(Exception, match="no label"):
        lookups.parse_condition(spark.createDataFrame([("gremlins 3",)], "folder string"), "folder").collect()
    assert value(spark, lookups.session_id(F.lit("A"), F.lit("x"), F.lit(None).cast("int"), F.lit(50))) == "A_x_None_50"


def test_quantiles():
    assert baseline.chi2_quantile(0.99, 2) == pytest.approx(9.210340371976182, abs=1e-10)
    assert baseline.chi2_quantile(0.95, 10) == pytest.approx(18.307038053275146, abs=1e-9)
    assert baseline.ewma_sigmas(1, 0.05) == pytest.approx(1.959963984540054)
    assert baseline.sigma_of_weighted_mean(2.0, 0.2) == pytest.approx(2 * (0.2 / 1.8) ** 0.5)

"""The list of registered queries and the tables that they start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and its SQL twin."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def r(x: Column, places: int = 6) -> Column:
    """Rounded as the SQL rounds: the scaled double, not its shortest decimal, so that both take the same side of a tie. Without a negative zero."""
    scaled = x.cast("double") * 10.0**places
    near = F.round(scaled) / 10.0**places
    return F.when(F.abs(scaled) == float("inf"), x.cast("double")).otherwise(near) + F.lit(0.0)


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({n: r(F.col(n), places) for n in names})


KEY, ORDER = ["machine"], ["ts", "event_id"]


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as telemetry of machines: one reading in seven is missing."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("machine"), "ts", "event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("load"), F.col("event_type").alias("kind"))


TELEMETRY = "SELECT user_id AS machine, ts, event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS load, event_type AS kind FROM events"


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry without gaps."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("machine"), "ts", "event_id", "value", F.col("event_type").alias("kind"))


READINGS = "SELECT user_id AS machine, ts, event_id, value, event_type AS kind FROM events"

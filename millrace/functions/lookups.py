"""Lookup tables and the string functions that go with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Condition folder without its index, and label.
CONDITIONS = {
    "healthy": "healthy",
    "healthy noise": "healthy",
    "new motor": "healthy",
    "bearing bpfo": "bearing_outer",
    "bearing bpfi": "bearing_inner",
    "bearing bsf": "bearing_ball",
    "bearing contaminated": "bearing_contamination",
    "bearing pump": "bearing_pump",
    "impeller": "impeller_damage",
    "cavitation suction": "cavitation",
    "cavitation discharge": "cavitation",
    "align angular": "misalignment",
    "align parallel": "misalignment",
    "align combination": "misalignment",
    "unbalance motor": "unbalance",
    "unbalance pump": "unbalance",
    "loose foot motor": "loose_foot",
    "loose foot pump": "loose_foot",
    "soft foot": "soft_foot",
    "bent shaft": "bent_shaft",
    "coupling": "coupling",
    "broken rotor bar": "broken_rotor_bar",
    "stator short": "stator_short",
}
#: Fault family and class.
CLASSES = {
    "healthy": "healthy",
    "bearing_outer": "bearing",
    "bearing_inner": "bearing",
    "bearing_ball": "bearing",
    "bearing_contamination": "bearing",
    "impeller_damage": "impeller_damage",
    "cavitation": "cavitation",
    "misalignment": "misalignment",
    "unbalance": "unbalance",
    "loose_foot": "looseness",
    "soft_foot": "looseness",
    "bent_shaft": "shaft",
    "coupling": "shaft",
    "broken_rotor_bar": "electrical",
    "stator_short": "electrical",
}
#: Motor and speed setting in percent, and rpm.
SPEEDS = {("Motor-2", 50): 740.0, ("Motor-2", 75): 1110.0, ("Motor-2", 100): 1480.0, ("Motor-4", 70): 2075.0}
PUMPS = {"Motor-2": "NK80-250", "Motor-4": "NK80-160"}
#: Bearing and damage, operating point and rpm, torque, force.
BEARINGS = {
    "K001": "healthy", "K002": "healthy", "K003": "healthy", "K004": "healthy", "K005": "healthy", "K006": "healthy",
    "KA04": "outer_race", "KA15": "outer_race", "KA16": "outer_race", "KA22": "outer_race", "KA30": "outer_race",
    "KI04": "inner_race", "KI14": "inner_race", "KI16": "inner_race", "KI17": "inner_race", "KI18": "inner_race", "KI21": "inner_race",
}
OPERATING_POINTS = {"N15_M07_F10": (1500.0, 0.7, 1000.0), "N09_M07_F10": (900.0, 0.7, 1000.0), "N15_M01_F10": (1500.0, 0.1, 1000.0), "N15_M07_F04": (1500.0, 0.7, 400.0)}
MAX_CLASSES = 10


def look_up(x: Column, table: dict[str, str]) -> Column:
    """The value of a small fixed table; null for others."""
    return F.create_map(*[F.lit(v) for kv in table.items() for v in kv])[x]


def refused(x: Column, table: dict[str, str], what: str) -> Column:
    """The value of a fixed table; an unknown key raises."""
    found = look_up(x, table)
    return F.when(found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit(f"no {what} for "), F.coalesce(x, F.lit("null")))))


def condition_parts(folder: Column) -> dict[str, Column]:
    """Family and severity of a condition folder (P1): the severity is a trailing number with letters."""
    name = F.lower(F.trim(folder))
    tail = F.regexp_extract(name, r"\s+(\d+[a-z]?)$", 1)
    family = F.when(tail != "", F.trim(F.regexp_replace(name, r"\s+\d+[a-z]?$", ""))).otherwise(name)
    return {"family": family, "severity": F.regexp_replace(tail, "[a-z]", "").try_cast("int")}


def parse_condition(df: DataFrame, folder: str) -> DataFrame:
    """df with label, family and severity; a folder without a label raises."""
    df = df.withColumns(condition_parts(F.col(folder)))
    return df.withColumn("label", refused(F.col("family"), CONDITIONS, "label"))


def collapse_labels(df: DataFrame, label: str, table: dict[str, str] | None = None, most: int = MAX_CLASSES) -> DataFrame:
    """df with class (P2); an unknown label raises when its row is read, too many classes at once."""
    table = table or CLASSES
    out = df.withColumn("class", refused(F.col(label), table, "class"))
    if len(set(table.values())) > most:
        found = out.select("class").distinct().limit(most + 1).count()
        if found > most:
            raise ValueError(f"more than {most} classes")
    return out


def session_id(pump: Column, condition: Column, severity: Column, speed: Column) -> Column:
    """Pump, condition, severity and speed (P4); a missing severity reads None."""
    return F.concat_ws("_", pump, condition, F.coalesce(severity.cast("string"), F.lit("None")), speed.cast("string"))


def result_key(key: Column) -> dict[str, Column]:
    """Rung, model and strategy of a result's key (P9): ladder__rung__model or model__strategy; other keys have none."""
    after = lambda x, head: F.substring(x, F.length(head) + 3, F.length(x))
    first, second = F.split_part(key, F.lit("__"), F.lit(1)), F.split_part(key, F.lit("__"), F.lit(2))
    rest = after(key, first)
    ladder = (first == "ladder") & F.contains(rest, F.lit("__"))
    plain = (first != "ladder") & F.contains(key, F.lit("__"))
    return {"rung": F.when(ladder, second), "model": F.when(ladder, after(rest, second)).when(plain, first), "strategy": F.when(plain, rest)}

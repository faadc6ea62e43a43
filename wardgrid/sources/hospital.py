"""What sources share that keep unit stays inside hospital admissions, with items by number and times as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardgrid.functions import clean
from wardgrid.functions.source_rules import age_at
from wardgrid.operators.derive import attach_to_stays, star_join
from wardgrid.operators.timegrid import HOUR, micros
from wardgrid.sources.tables import canonical

LAB_HOURS = 168  # laboratory values count from so long before a stay
ADMISSION = ["subject_id", "hadm_id"]
Conversion = tuple[str, str, float, float]


def when(name: str) -> Column:
    return F.try_to_timestamp(F.col(name))


def named(prefix: str, name: str) -> Column:
    """The id with the source's prefix; null if there is none."""
    return F.concat(F.lit(f"{prefix}_"), F.col(name).cast("string"))


def unit_stays(icustays: DataFrame) -> DataFrame:
    return icustays.select(*ADMISSION, "stay_id", when("intime").alias("intime"), when("outtime").alias("outtime"))


def first_measured(chart: DataFrame, factors: dict[int, float], low: float, high: float, name: str) -> DataFrame:
    """(stay_id, name): the earliest value of the items, each by its factor, that lies in a range."""
    value = F.lit(None).cast("double")
    item = F.col("itemid").try_cast("long")
    for number, factor in factors.items():
        value = F.when(item == number, F.col("valuenum").try_cast("double") * factor).otherwise(value)
    rows = chart.where(item.isin(*factors)).select("stay_id", when("charttime").alias("_t"), value.cast("float").alias("_v")).where(F.col("_v").between(low, high))
    return rows.groupBy("stay_id").agg(F.min_by("_v", F.struct(F.coalesce(micros("_t"), F.lit(2**62)), "_v")).alias(name))


def stays(prefix: str, icustays: DataFrame, admissions: DataFrame, patients: DataFrame, dimensions: list[tuple[DataFrame, list[str]]], died_in_unit: Column, died_in_hospital: Column) -> DataFrame:
    """Canonical stays: a star of the stays with their admission, patient and further dimensions (weight and height among them).

    died_in_unit and died_in_hospital are read from the joined row, where times have been parsed; unknown is false.
    """
    times = {"admittime", "dischtime", "deathtime", "dod"}
    parsed = lambda t: t.select(*[when(c).alias(c) if c in times else F.col(c) for c in t.columns])
    met = star_join(unit_stays(icustays).join(icustays.select("stay_id", "los"), "stay_id"), (parsed(admissions), ADMISSION), (parsed(patients), ["subject_id"]), *dimensions)
    false = F.lit(False)
    out = met.select(
        named(prefix, "subject_id").alias("patient_id"), F.col("subject_id").cast("string").alias("_subject"), named(prefix, "stay_id").alias("_stay"), F.lit(prefix).alias("dataset"),
        F.lit(None).alias("hospital_id"), age_at(F.col("anchor_age").try_cast("int"), F.col("anchor_year").try_cast("int"), F.col("admittime")).alias("age"), F.col("gender").alias("sex"),
        F.col("race").alias("ethnicity"), "weight", "height", F.col("intime").alias("admit_time"), F.col("outtime").alias("discharge_time"),
        (F.col("los").try_cast("float") * 24.0).alias("los_hours"), F.coalesce(died_in_unit, false).alias("mortality_in_icu"), F.coalesce(died_in_hospital, false).alias("mortality_in_hospital"),
        F.coalesce(micros("dod") <= micros("admittime") + 30 * 24 * HOUR, false).alias("mortality_30day"), F.lit(None).alias("admission_diagnosis"),
    )
    return canonical(out.withColumnRenamed("_subject", "subject_id").withColumnRenamed("_stay", "stay_id"), "stays")


def chosen(rows: DataFrame, items: dict[int, str], wanted: list[str] | None) -> DataFrame:
    """(subject_id, stay_id or hadm_id, charttime, item, concept, v, valueuom) of the wanted items, chosen at the scan."""
    known = {i: c for i, c in items.items() if wanted is None or c in wanted}
    names = F.create_map(*[F.lit(x) for pair in known.items() for x in pair]) if known else F.create_map().cast("map<int,string>")
    keys = [c for c in ("subject_id", "hadm_id", "stay_id") if c in rows.columns]
    read = rows.select(*keys, when("charttime").alias("charttime"), F.col("itemid").try_cast("int").alias("item"), F.col("valuenum").try_cast("double").alias("v"), "valueuom")
    return read.where(F.col("item").isin(*known) if known else F.lit(False)).withColumn("concept", F.try_element_at(names, F.col("item")))


def at_stays(rows: DataFrame, icustays: DataFrame, before_h: int = 0) -> DataFrame:
    """Rows of an admission at the stays that hold their charttime, or come at most before_h after it."""
    return attach_to_stays(rows, unit_stays(icustays), ADMISSION, before_h)


def of_stays(rows: DataFrame, icustays: DataFrame, how: str = "inner") -> DataFrame:
    """Rows of an admission once for each of its stays."""
    return rows.join(icustays.select(*ADMISSION, "stay_id"), ADMISSION, how)


def canonical_events(rows: DataFrame, prefix: str, concepts: DataFrame, conversions: dict[int, Conversion], clip: bool = False, sentinel: float | None = None) -> DataFrame:
    """Canonical events of chosen rows. conversions: item -> (source unit, unit, what is taken off, factor)."""
    value, unit, source = F.col("v"), F.col("valueuom"), F.col("valueuom")
    for item, (given, made, off, factor) in conversions.items():
        here = F.col("item") == item
        value = F.when(here, (F.col("v") - off) * factor).otherwise(value)
        unit, source = F.when(here, made).otherwise(unit), F.when(here, given).otherwise(source)
    raw = rows.select(named(prefix, "subject_id").alias("patient_id"), named(prefix, "stay_id").alias("stay_id"), "charttime", "concept", value.cast("float").alias("value"), unit.alias("unit"), source.alias("unit_source"))
    return canonical(clean.canonical_units(raw, concepts, clip, sentinel), "events_long")


def interventions(rows: DataFrame, prefix: str, items: dict[int, str]) -> DataFrame:
    """Canonical interventions of the items of (subject_id, stay_id, starttime, endtime, itemid)."""
    item = F.col("itemid").try_cast("int")
    names = F.create_map(*[F.lit(x) for pair in items.items() for x in pair])
    out = rows.where(item.isin(*items)).select(named(prefix, "subject_id").alias("patient_id"), named(prefix, "stay_id").alias("stay_id"), when("starttime").alias("starttime"), when("endtime").alias("endtime"), F.try_element_at(names, item).alias("intervention"))
    return canonical(out, "interventions")


def diagnoses(rows: DataFrame, icustays: DataFrame, prefix: str, first: int = 1) -> DataFrame:
    """Canonical diagnoses; an admission without a unit stay keeps its rows, without a stay. first: how the source counts from."""
    met = of_stays(rows, icustays, "left")
    out = met.select(named(prefix, "subject_id").alias("patient_id"), named(prefix, "stay_id").alias("stay_id"), F.col("icd_code"), F.col("icd_version"), (F.col("seq_num").try_cast("int") + 1 - first).alias("diagnosis_position"))
    return canonical(out, "diagnoses")

"""Reader of a source like that of hospital.py whose medications are administrations and orders, and whose missing values are a number.

Administrations that were not given are left out; each one is laid at every stay of its admission, as are orders. Missing values
are given as 9999999, so numbers from SENTINEL on are missing, and others are moved to the ends of their concept's range. The
source has no notes and no cultures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardgrid.functions import clean
from wardgrid.functions.source_rules import DRUG_HINTS, end_or_none, is_antibiotic
from wardgrid.sources import hospital
from wardgrid.sources.hospital import named, when
from wardgrid.sources.tables import SCHEMAS, canonical, empty, read_csv, read_csv_or_empty, require_codes

PREFIX = "nwicu"
SENTINEL = 1e6
#: Items of the chart.
CHART = {320045: "hr", 320277: "o2sat", 320210: "resp", 320179: "sbp", 320180: "dbp", 320050: "sbp", 320051: "dbp", 323761: "temp", 326531: "weight", 326707: "height"}
#: Laboratory items.
LABS = {
    100021: "alb", 100158: "alb", 100200: "alb", 100033: "alp", 100042: "alt", 100032: "ast", 100013: "bicar", 100020: "bili", 100250: "bili",
    100308: "bili", 100355: "bili", 100049: "bili_dir", 100358: "bnd", 100004: "bun", 100106: "bun", 100273: "bun", 100003: "ca", 100044: "cai",
    100085: "ck", 100099: "ckmb", 100012: "cl", 100152: "cl", 100002: "crea", 100097: "crea", 100189: "crea", 100209: "crea", 100053: "crp", 100048: "fgn",
    100001: "glu", 100045: "glu", 100062: "glu", 100121: "glu", 100007: "hgb", 100339: "ph", 100030: "inr_pt", 100011: "k", 100047: "k", 100160: "k",
    100031: "lact", 100055: "lact", 100224: "lact", 100230: "lact", 100023: "lymph", 100037: "lymph", 100005: "mch", 100018: "mchc", 100017: "mcv",
    100009: "mg", 100277: "mg", 100010: "na", 100050: "na", 100098: "na", 100022: "neut", 100038: "neut", 100015: "phos", 100326: "phos", 100327: "phos",
    100014: "plt", 100029: "po2", 100109: "po2", 100046: "ptt", 100057: "tnt", 100059: "tnt", 100016: "wbc", 100083: "wbc", 100155: "wbc",
}
#: Laboratory items that every copy of the source has to have.
LOCKED = [100085, 100099, 100029, 100057, 100059]
#: Items in other units: source unit, unit, what is taken off, factor.
CONVERSIONS = {323761: ("°F", "°C", 32.0, 5.0 / 9.0), 326531: ("oz", "kg", 0.0, 28.3495 / 1000.0), 326707: ("in", "cm", 0.0, 2.54)}
#: Procedures that are interventions.
PROCEDURES = {787541: "mech_vent", 792843: "niv", 704890: "rrt", 772042: "rrt", 798351: "rrt", 724671: "rrt", 736876: "ecmo"}
#: What became of an administration, where it was given.
GIVEN = ["Applied", "Confirmed"]
TABLES = {
    "icu/icustays": ["subject_id", "hadm_id", "stay_id", "intime", "outtime", "los"],
    "hosp/admissions": ["subject_id", "hadm_id", "admittime", "dischtime", "deathtime", "discharge_location", "hospital_expire_flag", "race"],
    "hosp/patients": ["subject_id", "gender", "anchor_age", "anchor_year", "dod"],
    "icu/chartevents": ["subject_id", "stay_id", "charttime", "itemid", "valuenum", "valueuom"],
    "hosp/labevents": ["subject_id", "hadm_id", "charttime", "itemid", "valuenum", "valueuom"],
    "hosp/d_labitems": ["itemid"],
    "icu/procedureevents": ["subject_id", "stay_id", "starttime", "endtime", "itemid"],
}
OPTIONAL = {
    "hosp/emar": ["subject_id", "hadm_id", "charttime", "medication", "event_txt"],
    "hosp/prescriptions": ["subject_id", "hadm_id", "starttime", "stoptime", "drug", "route"],
    "hosp/diagnoses_icd": ["subject_id", "hadm_id", "seq_num", "icd_code", "icd_version"],
}


def stays(icustays: DataFrame, admissions: DataFrame, patients: DataFrame, chartevents: DataFrame) -> DataFrame:
    """Canonical stays of adults. A patient died in the unit if they died while they were in it."""
    weights = hospital.first_measured(chartevents, {326531: 0.0283495}, 20.0, 300.0, "weight")
    heights = hospital.first_measured(chartevents, {326707: 2.54}, 50.0, 250.0, "height")
    in_unit = F.col("deathtime").between(F.col("intime"), F.col("outtime"))
    in_hospital = F.coalesce(F.col("hospital_expire_flag").try_cast("int") == 1, F.lit(False)) | F.coalesce(F.col("discharge_location") == "EXPIRED", F.lit(False))
    return hospital.stays(PREFIX, icustays, admissions, patients, [(weights, ["stay_id"]), (heights, ["stay_id"])], in_unit, in_hospital).where("age >= 18")


def require_locked(d_labitems: DataFrame) -> None:
    """Fail if one of the locked laboratory items is not in the source's dictionary."""
    have = d_labitems.select(F.col("itemid").try_cast("long").alias("itemid"))
    require_codes(have, d_labitems.sparkSession.createDataFrame([(i,) for i in LOCKED], "itemid long"), "itemid")


def events(chartevents: DataFrame, labevents: DataFrame, icustays: DataFrame, concepts: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """Canonical events of the wanted concepts (all if None)."""
    charted = hospital.canonical_events(hospital.chosen(chartevents, CHART, wanted), PREFIX, concepts, CONVERSIONS, True, SENTINEL)
    labs = hospital.at_stays(hospital.chosen(labevents, LABS, wanted), icustays, hospital.LAB_HOURS)
    return charted.unionByName(hospital.canonical_events(labs, PREFIX, concepts, {}, True, SENTINEL))


def given(emar: DataFrame) -> DataFrame:
    """Administrations that took place."""
    return emar.where(F.col("event_txt").isin(GIVEN) & F.col("medication").isNotNull())


def _drug(name: str) -> Column:
    """The first word of the drug's text, in lower case."""
    return F.coalesce(F.nullif(F.regexp_extract(F.lower(name), r"^([a-z][a-z\-]+)", 1), F.lit("")), F.lit("unknown")).alias("drug")


def meds(emar: DataFrame, prescriptions: DataFrame, icustays: DataFrame) -> DataFrame:
    """Canonical medications: administrations, which have no end, and orders, which may be of the same drug. Doses are not charted."""
    keys = [named(PREFIX, "subject_id").alias("patient_id"), named(PREFIX, "stay_id").alias("stay_id")]
    none = [F.lit(None).cast("float").alias("dose"), F.lit(None).cast("string").alias("dose_unit")]
    kind = lambda name: clean.first_class(F.col(name), DRUG_HINTS).alias("drug_class")
    done = hospital.of_stays(given(emar), icustays).select(*keys, when("charttime").alias("starttime"), F.lit(None).cast("timestamp").alias("endtime"), _drug("medication"), *none, F.lit(None).cast("string").alias("route"), kind("medication"))
    ordered = hospital.of_stays(prescriptions, icustays).select(*keys, when("starttime").alias("starttime"), when("stoptime").alias("endtime"), _drug("drug"), *none, F.lower("route").alias("route"), kind("drug"))
    return canonical(done.unionByName(ordered), "meds")


def abx_duration(emar: DataFrame, prescriptions: DataFrame, icustays: DataFrame) -> DataFrame:
    """Antibiotics: orders as long as they last, without an end where it lies before the start; administrations as one minute."""
    stay = named(PREFIX, "stay_id").alias("stay_id")
    orders = hospital.of_stays(prescriptions.where(is_antibiotic(F.col("drug"), PREFIX)), icustays)
    ordered = orders.select(stay, when("starttime").alias("starttime"), end_or_none(when("starttime"), when("stoptime")).alias("endtime"))
    doses = hospital.of_stays(given(emar).where(is_antibiotic(F.col("medication"), PREFIX)), icustays)
    done = doses.select(stay, when("charttime").alias("starttime"), (when("charttime") + F.expr("interval 1 minute")).alias("endtime"))
    return canonical(ordered.unionByName(done), "abx_duration")


def read(spark: SparkSession, root: str, concepts: DataFrame) -> dict[str, DataFrame]:
    """All canonical tables of the files <root>/<folder>/<table>.csv.gz; a missing locked item is an error."""
    raw = {name: read_csv(spark, f"{root}/{name}.csv.gz", columns) for name, columns in TABLES.items()}
    raw |= {name: read_csv_or_empty(spark, f"{root}/{name}.csv.gz", columns) for name, columns in OPTIONAL.items()}
    require_locked(raw["hosp/d_labitems"])
    icu, chart = raw["icu/icustays"], raw["icu/chartevents"]
    out = {
        "stays": stays(icu, raw["hosp/admissions"], raw["hosp/patients"], chart),
        "events_long": events(chart, raw["hosp/labevents"], icu, concepts),
        "meds": meds(raw["hosp/emar"], raw["hosp/prescriptions"], icu),
        "interventions": hospital.interventions(raw["icu/procedureevents"], PREFIX, PROCEDURES),
        "diagnoses": hospital.diagnoses(raw["hosp/diagnoses_icd"], icu, PREFIX, first=0),
        "abx_duration": abx_duration(raw["hosp/emar"], raw["hosp/prescriptions"], icu),
    }
    return {table: out[table] if table in out else empty(spark, table) for table in SCHEMAS}

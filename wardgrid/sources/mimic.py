"""Reader of a source with hospital admissions, unit stays, and items by number in several charts.

Each function takes raw tables, all text, and returns a canonical one; read() loads the files. Charts are filtered by item at
the scan; laboratory values and cultures, which know their admission only, are laid at the stays that hold them. A stay's death in
the unit is told by the last ward of its admission, which has to be a unit of at least WARD_STAYS stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardgrid.functions import clean
from wardgrid.functions.source_rules import DRUG_HINTS, time_or_noon
from wardgrid.operators.derive import large_units, last_wards
from wardgrid.operators.streams import end_expiratory_pressures
from wardgrid.sources import hospital
from wardgrid.sources.hospital import ADMISSION, named, when
from wardgrid.sources.tables import SCHEMAS, canonical, read_csv, read_csv_or_empty

PREFIX = "miiv"
WARD_STAYS = 100
#: Items of the chart.
CHART = {
    50817: "o2sat", 220045: "hr", 220050: "sbp", 220051: "dbp", 220052: "map", 220179: "sbp", 220180: "dbp", 220181: "map", 220210: "resp", 220277: "o2sat",
    223761: "temp", 223762: "temp", 223835: "fio2", 224027: "temp", 224688: "resp", 224689: "resp", 224690: "resp", 225312: "map", 226253: "o2sat",
    224639: "weight", 226512: "weight", 226531: "weight", 226707: "height", 226730: "height", 226755: "gcs", 220739: "gcs", 223900: "gcs", 223901: "gcs",
}
#: Laboratory items.
LABS = {
    50802: "be", 50808: "cai", 50809: "glu", 50813: "lact", 50816: "fio2", 50818: "pco2", 50820: "ph", 50821: "po2", 50861: "alt", 50862: "alb",
    50863: "alp", 50878: "ast", 50882: "bicar", 50883: "bili_dir", 50885: "bili", 50889: "crp", 50893: "ca", 50902: "cl", 50910: "ck", 50911: "ckmb",
    50912: "crea", 50814: "methb", 52144: "methb", 50931: "glu", 50960: "mg", 50970: "phos", 50971: "k", 50983: "na", 51003: "tnt", 51006: "bun",
    51144: "bnd", 51214: "fgn", 51222: "hgb", 51237: "inr_pt", 51244: "lymph", 51248: "mch", 51249: "mchc", 51250: "mcv", 51256: "neut", 51265: "plt",
    51275: "ptt", 51301: "wbc", 53085: "alb", 53086: "alp", 53089: "bili",
}
#: Items of urine.
OUTPUTS = dict.fromkeys([226557, 226558, 226559, 226560, 226561, 226563, 226564, 226565, 226566, 226567, 226584, 227510], "urine")
#: Items in other units: source unit, unit, what is taken off, factor.
CONVERSIONS = {223761: ("°F", "°C", 32.0, 5.0 / 9.0), 226707: ("in", "cm", 0.0, 2.54), 226531: ("lb", "kg", 0.0, 0.453592)}
#: Items of weight and height with their factor.
WEIGHTS, HEIGHTS = {226512: 1.0}, {226707: 2.54, 226730: 1.0}
#: Procedures, and infusions, that are interventions.
PROCEDURES = {225792: "mech_vent", 225794: "niv", 225802: "rrt", 225803: "rrt", 225805: "rrt", 224270: "ecmo"}
PRESSORS = dict.fromkeys([221906, 221289, 222315, 221662, 221749, 221653], "vasopressor")
#: Infusions that are antibiotics.
ANTIBIOTICS = [
    225798, 225837, 225838, 225840, 225842, 225843, 225844, 225845, 225847, 225848, 225850, 225851, 225853, 225855, 225857, 225859, 225860, 225862,
    225863, 225865, 225866, 225868, 225869, 225871, 225873, 225875, 225876, 225877, 225879, 225881, 225882, 225883, 225884, 225885, 225886, 225888,
    225889, 225890, 225892, 225893, 225895, 225896, 225897, 225898, 225899, 225900, 225902, 225903, 225905, 227691, 228003,
]
#: Settings of the ventilator.
PRESSURE = [220339, 224700]
CHARTED = ["subject_id", "stay_id", "charttime", "itemid", "valuenum", "valueuom"]
#: Columns that are read of each table that every copy of the source has, and of those that may be absent.
TABLES = {
    "icu/icustays": ["subject_id", "hadm_id", "stay_id", "first_careunit", "intime", "outtime", "los"],
    "hosp/admissions": ["subject_id", "hadm_id", "admittime", "dischtime", "deathtime", "hospital_expire_flag", "race"],
    "hosp/patients": ["subject_id", "gender", "anchor_age", "anchor_year", "dod"],
    "hosp/transfers": ["subject_id", "hadm_id", "eventtype", "careunit", "intime"],
    "icu/chartevents": CHARTED,
    "hosp/labevents": ["subject_id", "hadm_id", "charttime", "itemid", "valuenum", "valueuom"],
    "icu/outputevents": ["subject_id", "stay_id", "charttime", "itemid", "value", "valueuom"],
    "icu/inputevents": ["subject_id", "stay_id", "starttime", "endtime", "itemid", "amount", "amountuom", "rate", "rateuom"],
    "icu/d_items": ["itemid", "label"],
    "icu/procedureevents": ["subject_id", "stay_id", "starttime", "endtime", "itemid"],
    "hosp/diagnoses_icd": ["subject_id", "hadm_id", "seq_num", "icd_code", "icd_version"],
}
OPTIONAL = {
    "hosp/prescriptions": ["subject_id", "hadm_id", "starttime", "stoptime", "drug", "dose_val_rx", "dose_unit_rx", "route"],
    "hosp/microbiologyevents": ["subject_id", "hadm_id", "chartdate", "charttime", "spec_type_desc", "org_name"],
}
NOTE = ["subject_id", "hadm_id", "charttime", "text"]


def stays(icustays: DataFrame, admissions: DataFrame, patients: DataFrame, transfers: DataFrame, chartevents: DataFrame) -> DataFrame:
    """Canonical stays; those without times or an age are left out. A patient died in the unit if they died in the hospital and the
    last ward of the admission is a unit."""
    wards = large_units(icustays.select(F.col("first_careunit").alias("careunit")).where("careunit is not null"), WARD_STAYS).distinct()
    moves = transfers.where("hadm_id is not null").withColumn("intime", when("intime"))
    in_unit = last_wards(moves, ADMISSION).join(wards.select(F.col("careunit").alias("last_ward")), "last_ward", "left_semi").select(*ADMISSION, F.lit(True).alias("in_unit"))
    weights = hospital.first_measured(chartevents, WEIGHTS, 20.0, 300.0, "weight")
    heights = hospital.first_measured(chartevents, HEIGHTS, 50.0, 250.0, "height")
    died = F.col("hospital_expire_flag").try_cast("int") == 1
    return hospital.stays(PREFIX, icustays, admissions, patients, [(weights, ["stay_id"]), (heights, ["stay_id"]), (in_unit, ADMISSION)], died & F.col("in_unit"), died)


def events(chartevents: DataFrame, labevents: DataFrame, outputevents: DataFrame, icustays: DataFrame, concepts: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """Canonical events of the wanted concepts (all if None). Parts of the coma score at one time are one score. concepts is
    (concept, canonical_unit, low, high)."""
    charted = hospital.canonical_events(hospital.chosen(chartevents, CHART, wanted), PREFIX, concepts, CONVERSIONS)
    parts, rest = charted.where("concept = 'gcs'"), charted.where("concept <> 'gcs'")
    whole = parts.groupBy("patient_id", "stay_id", "charttime", "concept").agg(F.sum("value").cast("float").alias("value"), F.min("unit").alias("unit"), F.min("unit_source").alias("unit_source"))
    labs = hospital.at_stays(hospital.chosen(labevents, LABS, wanted), icustays, hospital.LAB_HOURS)
    urine = hospital.chosen(outputevents.withColumnRenamed("value", "valuenum"), OUTPUTS, wanted)
    for rows in (whole, hospital.canonical_events(labs, PREFIX, concepts, {}), hospital.canonical_events(urine, PREFIX, concepts, {})):
        rest = rest.unionByName(rows)
    return canonical(rest, "events_long")


def meds(inputevents: DataFrame, d_items: DataFrame, prescriptions: DataFrame, icustays: DataFrame) -> DataFrame:
    """Canonical medications: infusions under the label of their item, with the rate, or the amount, as dose; and prescriptions at
    each stay of their admission, but for antibiotics, whose orders do not say that they were given."""
    low = lambda name: F.coalesce(F.lower(name), F.lit("unknown")).alias("drug")
    common = lambda end: [named(PREFIX, "subject_id").alias("patient_id"), named(PREFIX, "stay_id").alias("stay_id"), when("starttime").alias("starttime"), when(end).alias("endtime")]
    infused = inputevents.join(d_items.select("itemid", F.col("label")), "itemid", "left").select(
        *common("endtime"), low("label"), F.coalesce(F.col("rate").try_cast("float"), F.col("amount").try_cast("float")).alias("dose"), F.coalesce("rateuom", "amountuom").alias("dose_unit"), F.lit("iv").alias("route"),
    )
    ordered = hospital.of_stays(prescriptions, icustays).select(*common("stoptime"), low("drug"), F.col("dose_val_rx").try_cast("float").alias("dose"), F.col("dose_unit_rx").alias("dose_unit"), F.lower("route").alias("route"))
    of = clean.first_class(F.col("drug"), DRUG_HINTS).alias("drug_class")
    return canonical(infused.select("*", of).unionByName(ordered.select("*", of).where("drug_class <> 'antibiotic'")), "meds")


def interventions(procedureevents: DataFrame, inputevents: DataFrame) -> DataFrame:
    return hospital.interventions(procedureevents, PREFIX, PROCEDURES).unionByName(hospital.interventions(inputevents, PREFIX, PRESSORS))


def notes(rows: DataFrame, kind: str, icustays: DataFrame) -> DataFrame:
    """Canonical notes of one kind, at each stay of their admission; without one they keep no stay."""
    met = hospital.of_stays(rows, icustays, "left")
    return canonical(met.select(named(PREFIX, "subject_id").alias("patient_id"), named(PREFIX, "stay_id").alias("stay_id"), when("charttime").alias("charttime"), F.lit(kind).alias("note_type"), "text"), "notes")


def microbio(microbiologyevents: DataFrame, icustays: DataFrame) -> DataFrame:
    """Cultures at the stay that holds their time; one with a date alone was taken at noon."""
    timed = microbiologyevents.withColumn("charttime", time_or_noon(F.col("charttime"), F.col("chartdate")))
    met = hospital.at_stays(timed, icustays)
    return canonical(met.select(named(PREFIX, "subject_id").alias("patient_id"), named(PREFIX, "stay_id").alias("stay_id"), "charttime", F.col("spec_type_desc").alias("specimen_type"), F.col("org_name").alias("organism")), "microbio")


def abx_duration(inputevents: DataFrame) -> DataFrame:
    """Antibiotic infusions as long as they last."""
    rows = inputevents.where(F.col("itemid").try_cast("int").isin(ANTIBIOTICS))
    return canonical(rows.select(named(PREFIX, "stay_id").alias("stay_id"), when("starttime").alias("starttime"), when("endtime").alias("endtime")), "abx_duration")


def raw_treatments(chartevents: DataFrame) -> DataFrame:
    """Settings of end-expiratory pressure, as a stream of treatments."""
    rows = chartevents.where(F.col("itemid").try_cast("int").isin(PRESSURE))
    return end_expiratory_pressures(rows.select(named(PREFIX, "subject_id").alias("patient_id"), named(PREFIX, "stay_id").alias("stay_id"), when("charttime").alias("charttime"), F.col("valuenum").alias("value")), PREFIX)


def read(spark: SparkSession, root: str, concepts: DataFrame, note_root: str | None = None) -> dict[str, DataFrame]:
    """All canonical tables of the files <root>/<folder>/<table>.csv.gz, and of the notes under note_root. A compressed file is read
    by one task, so large tables are better kept as folders of parts of that name."""
    raw = {name: read_csv(spark, f"{root}/{name}.csv.gz", columns) for name, columns in TABLES.items()}
    raw |= {name: read_csv_or_empty(spark, f"{root}/{name}.csv.gz", columns) for name, columns in OPTIONAL.items()}
    icu, chart, inputs = raw["icu/icustays"], raw["icu/chartevents"], raw["icu/inputevents"]
    written = None
    for kind in ("discharge", "radiology"):
        of = spark.createDataFrame([], ", ".join(f"{c} string" for c in NOTE)) if note_root is None else _note_file(spark, f"{note_root}/note/{kind}.csv.gz")
        some = notes(of, kind, icu)
        written = some if written is None else written.unionByName(some)
    out = {
        "stays": stays(icu, raw["hosp/admissions"], raw["hosp/patients"], raw["hosp/transfers"], chart),
        "events_long": events(chart, raw["hosp/labevents"], raw["icu/outputevents"], icu, concepts),
        "meds": meds(inputs, raw["icu/d_items"], raw["hosp/prescriptions"], icu),
        "interventions": interventions(raw["icu/procedureevents"], inputs),
        "notes": written,
        "diagnoses": hospital.diagnoses(raw["hosp/diagnoses_icd"], icu, PREFIX),
        "microbio": microbio(raw["hosp/microbiologyevents"], icu),
        "abx_duration": abx_duration(inputs),
    }
    return {table: out[table] for table in SCHEMAS}


def _note_file(spark: SparkSession, path: str) -> DataFrame:
    """Notes are quoted texts of many lines."""
    from wardgrid.sources.tables import exists

    if not exists(spark, path):
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in NOTE))
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).select(*NOTE)

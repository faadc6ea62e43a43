"""Reader of a source of many hospitals whose times are minutes from the admission to the unit.

Every stay begins at the anchor, so times of different stays do not compare. Rows know their unit stay; the patient comes from
the stays, which are small beside the charts. Charts are filtered by column or label at the scan, and read once for each kind
of value that they hold.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardgrid.functions import clean
from wardgrid.functions.source_rules import DRUG_HINTS, end_or_none, icd_priority, is_antibiotic, note_type, sex
from wardgrid.operators.derive import infusion_ends, long_vitals
from wardgrid.operators.streams import end_expiratory_pressures
from wardgrid.sources.tables import SCHEMAS, canonical, exists, read_csv, read_csv_or_empty

#: The anchor (2014-01-01 UTC, in seconds) and the age that stands for more than 89.
ANCHOR, OLDEST = 1388534400, 90
#: Columns of the periodic and of the aperiodic vital signs: concept and unit.
VITALS = {"heartrate": ("hr", "bpm"), "sao2": ("o2sat", "%"), "respiration": ("resp", "breaths/min"), "systemicsystolic": ("sbp", "mmHg"), "systemicdiastolic": ("dbp", "mmHg"), "systemicmean": ("map", "mmHg"), "temperature": ("temp", "°C")}
CUFF = {"noninvasivesystolic": ("sbp", "mmHg"), "noninvasivediastolic": ("dbp", "mmHg"), "noninvasivemean": ("map", "mmHg")}
#: Names of laboratory values.
LABS = {
    "albumin": "alb", "alkaline phos.": "alp", "ALT (SGPT)": "alt", "AST (SGOT)": "ast", "Base Excess": "be", "bicarbonate": "bicar",
    "total bilirubin": "bili", "direct bilirubin": "bili_dir", "-bands": "bnd", "BUN": "bun", "calcium": "ca", "ionized calcium": "cai", "CPK-MB": "ckmb",
    "CPK": "ck", "Methemoglobin": "methb", "chloride": "cl", "creatinine": "crea", "CRP": "crp", "CRP-hs": "crp", "fibrinogen": "fgn", "FiO2": "fio2",
    "glucose": "glu", "bedside glucose": "glu", "Hgb": "hgb", "PT - INR": "inr_pt", "potassium": "k", "lactate": "lact", "-lymphs": "lymph",
    "MCH": "mch", "MCHC": "mchc", "MCV": "mcv", "magnesium": "mg", "sodium": "na", "-polys": "neut", "paCO2": "pco2", "pH": "ph", "phosphate": "phos",
    "platelets x 1000": "plt", "paO2": "po2", "PTT": "ptt", "troponin - T": "tnt", "WBC x 1000": "wbc",
}
#: Laboratory values that may come in another unit, and its factor.
CONVERSIONS = {"CRP": ("mg/dL", 10.0), "CRP-hs": ("mg/dL", 10.0), "ionized calcium": ("mg/dL", 1.0 / 4.008)}
#: Labels and names of nurses' charts: concept, unit, what is taken off, factor.
NURSED = {
    ("Glasgow coma score", "GCS Total"): ("gcs", "points", 0.0, 1.0),
    ("Temperature", "Temperature (C)"): ("temp", "°C", 0.0, 1.0),
    ("Temperature", "Temperature (F)"): ("temp", "°C", 32.0, 5.0 / 9.0),
    ("Respiratory Rate", "Respiratory Rate"): ("resp", "/min", 0.0, 1.0),
}
#: Labels of urine.
URINE, URINE_PATTERN = ["Urine", "URINE CATHETER"], r"catheter.+output|output.+catheter"
#: What names interventions, first match counts.
TREATMENTS = [
    (r"dialysis|crrt|cvvh|hemofilt|renal replacement", "rrt"),
    (r"mechanical ventilation|intubation|invasive ventilation", "mech_vent"),
    (r"cpap|peep therapy|bipap|non-invasive ventilation", "niv"),
    (r"vasopressor|norepinephrine|epinephrine|dopamine|vasopressin|phenylephrine|inotropic", "vasopressor"),
]
TABLES = {
    "patient": ["patientunitstayid", "uniquepid", "hospitalid", "gender", "age", "ethnicity", "admissionheight", "admissionweight", "unitdischargeoffset", "unitdischargestatus", "hospitaldischargestatus"],
    "vitalPeriodic": ["patientunitstayid", "observationoffset", *VITALS],
    "vitalAperiodic": ["patientunitstayid", "observationoffset", *CUFF],
    "lab": ["patientunitstayid", "labresultoffset", "labname", "labresult", "labmeasurenameinterface"],
    "nurseCharting": ["patientunitstayid", "nursingchartoffset", "nursingchartcelltypevallabel", "nursingchartcelltypevalname", "nursingchartvalue"],
    "respiratoryCharting": ["patientunitstayid", "respchartoffset", "respchartvaluelabel", "respchartvalue"],
    "intakeOutput": ["patientunitstayid", "intakeoutputoffset", "celllabel", "cellvaluenumeric"],
}
OPTIONAL = {
    "infusionDrug": ["patientunitstayid", "infusionoffset", "drugname", "drugrate", "patientweight"],
    "medication": ["patientunitstayid", "drugstartoffset", "drugstopoffset", "drugname", "routeadmin"],
    "treatment": ["patientunitstayid", "treatmentoffset", "treatmentstring"],
    "diagnosis": ["patientunitstayid", "icd9code", "diagnosispriority"],
    "microLab": ["patientunitstayid", "culturetakenoffset", "culturesite", "organism"],
}
NOTE = ["patientunitstayid", "noteoffset", "notetype", "notetext"]
STAY = "patientunitstayid"


def _time(offset: str) -> Column:
    return clean.offset_time(F.timestamp_seconds(F.lit(ANCHOR)), F.col(offset).try_cast("long"), "min")


def _number(name: str) -> Column:
    return F.trim(name).try_cast("double")


def keyed(rows: DataFrame, patient: DataFrame) -> DataFrame:
    """rows with patient_id and stay_id: the crosswalk from unit stays to patients. Rows of an unknown stay have no patient."""
    name = lambda c, to: F.concat(F.lit("eicu_"), F.col(c).cast("string")).alias(to)
    cross = patient.select(STAY, name("uniquepid", "patient_id")).groupBy(STAY).agg(F.min("patient_id").alias("patient_id"))
    return rows.join(cross, STAY, "left").withColumn("stay_id", name(STAY, "stay_id"))


def stays(patient: DataFrame) -> DataFrame:
    """Canonical stays; those without an age are left out. Patients above 89 are OLDEST."""
    years = F.when(F.col("age") == "> 89", OLDEST).otherwise(F.col("age").try_cast("int"))
    expired = lambda c: F.coalesce(F.col(c) == "Expired", F.lit(False))
    out = keyed(patient, patient).select(
        "patient_id", F.col("uniquepid").alias("subject_id"), "stay_id", F.lit("eicu").alias("dataset"), F.col("hospitalid").alias("hospital_id"), years.cast("float").alias("age"),
        sex(F.col("gender"), "eicu").alias("sex"), "ethnicity", clean.within(_number("admissionweight"), 20.0, 300.0).alias("weight"), clean.within(_number("admissionheight"), 50.0, 250.0).alias("height"),
        F.timestamp_seconds(F.lit(ANCHOR)).alias("admit_time"), _time("unitdischargeoffset").alias("discharge_time"), (F.col("unitdischargeoffset").try_cast("float") / 60.0).alias("los_hours"),
        expired("unitdischargestatus").alias("mortality_in_icu"), expired("hospitaldischargestatus").alias("mortality_in_hospital"), F.lit(None).alias("mortality_30day"), F.lit(None).alias("admission_diagnosis"),
    )
    return canonical(out, "stays")


def _vitals(rows: DataFrame, columns: dict[str, tuple[str, str]], wanted: set[str]) -> DataFrame:
    """(stay, _at, concept, value, unit, unit_source) of the columns that hold a wanted concept."""
    kept = [c for c, (concept, _) in columns.items() if concept in wanted]
    if not kept:
        return rows.limit(0).select(STAY, F.col("observationoffset").alias("_at"), *[F.lit(None).cast(t).alias(n) for n, t in (("concept", "string"), ("value", "double"), ("unit", "string"), ("unit_source", "string"))])
    pick = lambda i: F.try_element_at(F.create_map(*[F.lit(x) for c in kept for x in (c, columns[c][i])]), F.col("_column"))
    typed = rows.select(STAY, F.col("observationoffset").alias("_at"), *[_number(c).alias(c) for c in kept])
    long = long_vitals(typed, [STAY, "_at"], kept).withColumnRenamed("concept", "_column")
    return long.select(STAY, "_at", pick(0).alias("concept"), "value", pick(1).alias("unit"), F.lit(None).cast("string").alias("unit_source"))


def _labs(lab: DataFrame, wanted: set[str]) -> DataFrame:
    of = lambda values: F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col("labname"))
    given, factor = of({n: u for n, (u, _) in CONVERSIONS.items()}), of({n: f for n, (_, f) in CONVERSIONS.items()})
    alike = F.lower(F.trim("labmeasurenameinterface")) == F.lower(given)
    value = _number("labresult") * F.when(F.coalesce(alike, F.lit(False)), factor).otherwise(1.0)
    names = [n for n, concept in LABS.items() if concept in wanted]
    return lab.where(F.col("labname").isin(names)).select(STAY, F.col("labresultoffset").alias("_at"), of(LABS).alias("concept"), value.alias("value"), F.col("labmeasurenameinterface").alias("unit"), F.coalesce(given, F.col("labmeasurenameinterface")).alias("unit_source"))


def _nursed(charting: DataFrame, wanted: set[str]) -> DataFrame:
    """All kinds of the nurses' chart in one pass: each is told by a label and a name."""
    concept, unit, value = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("double")
    for (label, name), (of, made, off, factor) in NURSED.items():
        if of in wanted:
            here = (F.col("nursingchartcelltypevallabel") == label) & (F.col("nursingchartcelltypevalname") == name)
            concept, unit = F.when(here, of).otherwise(concept), F.when(here, made).otherwise(unit)
            value = F.when(here, (_number("nursingchartvalue") - off) * factor).otherwise(value)
    labels = sorted({label for label, _ in NURSED})
    rows = charting.where(F.col("nursingchartcelltypevallabel").isin(labels))
    return rows.select(STAY, F.col("nursingchartoffset").alias("_at"), concept.alias("concept"), value.alias("value"), unit.alias("unit"), F.lit(None).cast("string").alias("unit_source"))


def _single(rows: DataFrame, at: str, concept: str, value: Column, unit: str) -> DataFrame:
    return rows.select(STAY, F.col(at).alias("_at"), F.lit(concept).alias("concept"), value.alias("value"), F.lit(unit).alias("unit"), F.lit(None).cast("string").alias("unit_source"))


def events(raw: dict[str, DataFrame], concepts: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """Canonical events of the wanted concepts (all if None); raw holds the tables of TABLES. Shares of oxygen up to 1 are fractions."""
    asked = set(wanted) if wanted is not None else {c for c, _ in [*VITALS.values(), *CUFF.values()]} | set(LABS.values()) | {of for of, *_ in NURSED.values()} | {"fio2", "urine"}
    arms = [_vitals(raw["vitalPeriodic"], VITALS, asked), _vitals(raw["vitalAperiodic"], CUFF, asked), _labs(raw["lab"], asked), _nursed(raw["nurseCharting"], asked)]
    if "fio2" in asked:
        share = F.regexp_replace(F.trim("respchartvalue"), "%+$", "").try_cast("double")
        arms.append(_single(raw["respiratoryCharting"].where("respchartvaluelabel = 'FiO2'"), "respchartoffset", "fio2", F.when(share <= 1.0, share * 100.0).otherwise(share), "%"))
    if "urine" in asked:
        rows = raw["intakeOutput"].where(F.col("celllabel").isin(URINE) | F.lower("celllabel").rlike(URINE_PATTERN))
        arms.append(_single(rows, "intakeoutputoffset", "urine", _number("cellvaluenumeric"), "mL").where("value >= 0"))
    every = reduce(DataFrame.unionByName, arms).where("concept is not null and value is not null")
    met = keyed(every, raw["patient"]).withColumn("charttime", _time("_at")).withColumn("value", F.col("value").cast("float"))
    return canonical(clean.canonical_units(met.select("patient_id", "stay_id", "charttime", "concept", "value", "unit", "unit_source"), concepts), "events_long")


def meds(infusion: DataFrame, medication: DataFrame, patient: DataFrame) -> DataFrame:
    """Canonical medications. An infusion lasts to the next start of its drug in the stay, an hour if there is none, 168 hours at most;
    its rate is by weight, the pump's or else the stay's. An order that ends before it starts has no end."""
    first = F.coalesce(F.nullif(F.regexp_extract(F.lower("drugname"), r"^([a-z][a-z\-]+)", 1), F.lit("")), F.lit("unknown")).alias("drug")
    kind = clean.first_class(F.col("drugname"), DRUG_HINTS).alias("drug_class")
    weights = stays(patient).select("stay_id", "weight")
    pumps = keyed(infusion, patient).join(weights, "stay_id", "left")
    unit, rate = clean.unit_suffix(F.col("drugname")), F.col("drugrate").try_cast("double")
    weight = F.coalesce(F.col("patientweight").try_cast("double"), F.col("weight").cast("double"))
    dose = F.when(unit == "mcg/kg/min", rate).when((unit == "mcg/min") & (weight > 0), rate / weight)
    by_weight = (unit == "mcg/kg/min") | ((unit == "mcg/min") & (weight > 0))
    infused = infusion_ends(pumps.select("patient_id", "stay_id", _time("infusionoffset").alias("starttime"), first, dose.cast("float").alias("dose"), F.when(by_weight, "mcg/kg/min").alias("dose_unit"), F.lit("iv").alias("route"), kind))
    start, end = _time("drugstartoffset"), _time("drugstopoffset")
    ordered = keyed(medication, patient).select("patient_id", "stay_id", start.alias("starttime"), end_or_none(start, end).alias("endtime"), first, F.lit(None).cast("float").alias("dose"), F.lit(None).cast("string").alias("dose_unit"), F.lower("routeadmin").alias("route"), kind)
    return canonical(infused.unionByName(ordered), "meds")


def abx_duration(infusion: DataFrame, medication: DataFrame, patient: DataFrame) -> DataFrame:
    """Antibiotics: infusions as one minute, orders as long as they last."""
    start = _time("infusionoffset")
    pumps = keyed(infusion.where(is_antibiotic(F.col("drugname"), "eicu_infusion")), patient).select("stay_id", start.alias("starttime"), (start + F.expr("interval 1 minute")).alias("endtime"))
    begin = _time("drugstartoffset")
    orders = keyed(medication.where(is_antibiotic(F.col("drugname"), "eicu_medication")), patient).select("stay_id", begin.alias("starttime"), end_or_none(begin, _time("drugstopoffset")).alias("endtime"))
    return canonical(pumps.unionByName(orders), "abx_duration")


def interventions(treatment: DataFrame, patient: DataFrame) -> DataFrame:
    named = treatment.withColumn("intervention", clean.first_regex(F.col("treatmentstring"), TREATMENTS)).where("intervention is not null")
    return canonical(keyed(named, patient).select("patient_id", "stay_id", _time("treatmentoffset").alias("starttime"), F.lit(None).cast("timestamp").alias("endtime"), "intervention"), "interventions")


def notes(note: DataFrame, patient: DataFrame) -> DataFrame:
    met = keyed(note, patient)
    return canonical(met.select("patient_id", "stay_id", _time("noteoffset").alias("charttime"), note_type(F.col("notetype")).alias("note_type"), F.coalesce("notetext", F.lit("")).alias("text")), "notes")


def diagnoses(diagnosis: DataFrame, patient: DataFrame) -> DataFrame:
    """The first code of each list; codes that open with a letter are of the tenth revision."""
    code = clean.icd_first(F.col("icd9code"))
    version = F.when(code.rlike("^[A-Z]"), "10").otherwise("9")
    met = keyed(diagnosis.where("icd9code is not null"), patient)
    return canonical(met.select("patient_id", "stay_id", code.alias("icd_code"), version.alias("icd_version"), icd_priority(F.col("diagnosispriority")).alias("diagnosis_position")), "diagnoses")


def microbio(cultures: DataFrame, patient: DataFrame) -> DataFrame:
    return canonical(keyed(cultures, patient).select("patient_id", "stay_id", _time("culturetakenoffset").alias("charttime"), F.col("culturesite").alias("specimen_type"), "organism"), "microbio")


def raw_treatments(respiratory: DataFrame, patient: DataFrame) -> DataFrame:
    """Settings of end-expiratory pressure, as a stream of treatments."""
    rows = keyed(respiratory.where("respchartvaluelabel = 'PEEP'"), patient)
    return end_expiratory_pressures(rows.select("patient_id", "stay_id", _time("respchartoffset").alias("charttime"), F.col("respchartvalue").alias("value")), "eicu")


def read(spark: SparkSession, root: str, concepts: DataFrame) -> dict[str, DataFrame]:
    """All canonical tables of the files <root>/<table>.csv.gz."""
    raw = {name: read_csv(spark, f"{root}/{name}.csv.gz", columns) for name, columns in TABLES.items()}
    raw |= {name: read_csv_or_empty(spark, f"{root}/{name}.csv.gz", columns) for name, columns in OPTIONAL.items()}
    who = raw["patient"]
    path = f"{root}/note.csv.gz"
    written = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).select(*NOTE) if exists(spark, path) else spark.createDataFrame([], ", ".join(f"{c} string" for c in NOTE))
    out = {
        "stays": stays(who),
        "events_long": events(raw, concepts),
        "meds": meds(raw["infusionDrug"], raw["medication"], who),
        "interventions": interventions(raw["treatment"], who),
        "notes": notes(written, who),
        "diagnoses": diagnoses(raw["diagnosis"], who),
        "microbio": microbio(raw["microLab"], who),
        "abx_duration": abx_duration(raw["infusionDrug"], raw["medication"], who),
    }
    return {table: out[table] for table in SCHEMAS}

"""Reader of a source whose times are whole seconds from an anchor and whose items are ids of one reference table.

Each function takes raw tables, all of them text or typed, and returns a canonical one; read() loads the files. A stay
begins at ICUOffset, as second 0 is an operation before it; rows outside [ICUOffset, TimeOfStay], or without a time, a
stay or a number where one is needed, are left out. Only stays and the reference table are joined: both are small beside
the events, which are read once and never sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardgrid.functions import clean
from wardgrid.functions.source_rules import sex
from wardgrid.operators import streams
from wardgrid.sources.tables import SCHEMAS, empty, read_csv, schema_of

#: The anchor (2013-01-01 UTC, in seconds), and the codes of death in the unit and in the hospital.
ANCHOR, DEAD_IN_UNIT, DEAD_IN_HOSPITAL = 1356998400, 2215, 3130
#: Ids of laboratory items; twins of other body fluids are not among them.
LABS = {
    367: "crea", 355: "bun", 469: "na", 686: "na", 463: "k", 685: "k", 450: "cl", 683: "cl", 457: "ca", 655: "cai", 468: "mg", 471: "phos",
    301: "wbc", 314: "plt", 289: "hgb", 658: "hgb", 566: "mch", 290: "mchc", 286: "mcv", 656: "glu", 657: "lact", 348: "glu", 465: "lact",
    666: "bicar", 688: "ph", 689: "po2", 687: "pco2", 668: "be", 341: "crp", 344: "fgn", 597: "ptt", 3128: "inr_pt", 661: "methb", 287: "alb",
    609: "alp", 617: "alt", 616: "ast", 333: "bili", 332: "bili_dir", 240: "bnd", 611: "ck", 253: "ckmb", 481: "tnt", 223: "lymph", 230: "neut",
}
#: Ids of hourly signals.
SIGNALS = {
    707: "hr", 708: "hr", 724: "hr", 710: "o2sat", 709: "temp", 701: "sbp", 704: "sbp", 702: "dbp", 705: "dbp", 703: "map", 706: "map",
    2274: "resp", 719: "resp", 2280: "resp", 725: "urine", 2283: "fio2",
}
#: Factors by concept and the source's unit in lower case.
FACTORS = {("bun", "mg/dl"): 1.0 / 2.1435, ("ca", "mmol/l"): 4.008, ("mg", "mmol/l"): 2.4305, ("phos", "mmol/l"): 3.0974, ("tnt", "ng/l"): 0.001, ("crp", "mg/dl"): 10.0}
#: Parts of drug names by class, first match counts.
DRUG_PARTS = {
    "vasopressor": ["norepinephr", "phenylephr", "epinephr", "vasopressin", "dobutamin", "dopamin", "terlipressin", "cafedrin"],
    "antibiotic": [
        "piperacillin", "ampicillin", "amoxicillin", "flucloxacillin", "penicillin", "cefepim", "cefotaxim", "ceftazidim", "ceftriaxon", "cefuroxim",
        "cefazolin", "meropenem", "imipenem", "ertapenem", "aztreonam", "vancomycin", "teicoplanin", "linezolid", "clindamycin", "ciprofloxacin",
        "levofloxacin", "moxifloxacin", "ofloxacin", "metronidazol", "colistin", "tigecyclin", "doxycyclin", "fosfomycin", "gentamyc", "amikacin",
        "daptomycin", "erythromycin", "azithromycin", "clarithromycin", "rifampicin", "sulfametoxazol", "caspofungin", "anidulafungin", "micafungin",
        "fluconazol", "voriconazol", "posaconazol", "amphotericin",
    ],
    "sedative": ["propofol", "remifentanil", "midazolam", "fentanyl", "piritramid", "sufentanil"],
    "diuretic": ["furosemid"],
    "anticoagulant": ["heparin", "enoxaparin"],
    "insulin": ["insulin"],
}
#: Ids of ranges that are mechanical ventilation.
VENTILATION = [720, 3041]
#: Hourly signals of treatments: flow of blood through a filter, end-expiratory pressure, norepinephrine in g/kg/h.
DIALYSIS, PRESSURE, NOREPINEPHRINE = 723, 2278, 773
TABLES = ["cases", "laboratory", "data_float_h", "medication", "data_range", "d_references"]


def _time(seconds: Column) -> Column:
    return clean.offset_time(F.timestamp_seconds(F.lit(ANCHOR)), seconds, "s")


def _whole(name: str) -> Column:
    return F.col(name).try_cast("long")


def _positive(name: str) -> Column:
    value = F.col(name).try_cast("double")
    return F.when(value > 0, value)


def stays(cases: DataFrame) -> DataFrame:
    """Canonical stays; weights are in grams, unknown states are no deaths."""
    died = lambda name, code: F.coalesce(_whole(name) == code, F.lit(False))
    los = (_whole("TimeOfStay") - _whole("ICUOffset")) / 3600.0
    named = {
        "patient_id": F.concat(F.lit("sicdb_"), F.col("PatientID").cast("string")), "subject_id": F.col("PatientID"),
        "stay_id": F.concat(F.lit("sicdb_"), F.col("CaseID").cast("string")), "dataset": F.lit("sicdb"), "hospital_id": F.lit("sicdb"),
        "age": F.col("AgeOnAdmission").try_cast("float"), "sex": sex(F.col("Sex"), "sicdb"), "ethnicity": F.lit(None),
        "weight": _positive("WeightOnAdmission") / 1000.0, "height": _positive("HeightOnAdmission"),
        "admit_time": _time(_whole("ICUOffset")), "discharge_time": _time(_whole("TimeOfStay")), "los_hours": F.greatest(los, F.lit(0.0)),
        "mortality_in_icu": died("DischargeState", DEAD_IN_UNIT), "mortality_in_hospital": died("HospitalDischargeType", DEAD_IN_HOSPITAL),
        "mortality_30day": F.lit(None), "admission_diagnosis": F.col("ICD10MainText"),
    }
    return cases.select(*[named[f.name].cast(f.dataType).alias(f.name) for f in schema_of("stays")])


def _keys(cases: DataFrame) -> DataFrame:
    text = lambda name: F.concat(F.lit("sicdb_"), F.col(name).cast("string"))
    return cases.select(_whole("CaseID").alias("_case"), text("PatientID").alias("patient_id"), text("CaseID").alias("stay_id"), _whole("ICUOffset").alias("_from"), _whole("TimeOfStay").alias("_to"))


def _references(d_references: DataFrame) -> DataFrame:
    return d_references.select(_whole("ReferenceGlobalID").alias("_id"), F.col("ReferenceValue").alias("_name"), F.col("ReferenceUnit").alias("_unit"))


def _within_stay(rows: DataFrame, cases: DataFrame) -> DataFrame:
    """Rows (_case, _at, ...) of a known stay, from its start to its end."""
    return rows.join(_keys(cases), "_case").where(F.col("_at").between(F.col("_from"), F.col("_to")))


def _measured(rows: DataFrame, item: str, value: str, concepts: dict[int, str]) -> DataFrame:
    """(_case, _id, _at, concept, value) of the known items, chosen by id at the scan."""
    named = F.create_map(*[F.lit(x) for pair in concepts.items() for x in pair])
    known = rows.select(_whole("CaseID").alias("_case"), _whole(item).alias("_id"), _whole("Offset").alias("_at"), F.col(value).try_cast("double").alias("value"))
    return known.where(F.col("_id").isin(*concepts) & F.col("value").isNotNull()).withColumn("concept", F.try_element_at(named, F.col("_id").cast("int")))


def events(cases: DataFrame, laboratory: DataFrame, data_float_h: DataFrame, d_references: DataFrame, concepts: DataFrame) -> DataFrame:
    """Canonical events in canonical units; values out of their concept's range are dropped. The unit of a concept without one is
    'unknown'. concepts is (concept, canonical_unit, low, high)."""
    rows = _measured(laboratory, "LaboratoryID", "LaboratoryValue", LABS).unionByName(_measured(data_float_h, "DataID", "Val", SIGNALS))
    met = _within_stay(rows, cases).join(_references(d_references), "_id", "left")
    factors = F.create_map(*[F.lit(x) for (concept, unit), factor in FACTORS.items() for x in (f"{concept} {unit}", factor)])
    scaled = F.col("value") * F.coalesce(F.try_element_at(factors, F.concat_ws(" ", "concept", F.lower("_unit"))), F.lit(1.0))
    raw = met.select("patient_id", "stay_id", _time(F.col("_at")).alias("charttime"), "concept", scaled.alias("value"), F.lit("unknown").alias("unit"), F.col("_unit").alias("unit_source"))
    return clean.canonical_units(raw, concepts).withColumn("value", F.col("value").cast("float"))


def meds(cases: DataFrame, medication: DataFrame, d_references: DataFrame) -> DataFrame:
    """Canonical medications, by their start; the drug and its unit are the reference table's."""
    rows = medication.select(_whole("CaseID").alias("_case"), _whole("DrugID").alias("_id"), _whole("Offset").alias("_at"), _whole("OffsetDrugEnd").alias("_end"), F.col("Amount").try_cast("float").alias("dose"))
    met = _within_stay(rows, cases).join(_references(d_references), "_id", "left")
    hints = [(part, kind) for kind, parts in DRUG_PARTS.items() for part in parts]
    return met.select(
        "patient_id", "stay_id", _time(F.col("_at")).alias("starttime"), _time(F.col("_end")).alias("endtime"), F.col("_name").alias("drug"), "dose",
        F.col("_unit").alias("dose_unit"), F.lit(None).cast("string").alias("route"), clean.first_class(F.col("_name"), hints).alias("drug_class"),
    )


def interventions(cases: DataFrame, data_range: DataFrame) -> DataFrame:
    rows = data_range.select(_whole("CaseID").alias("_case"), _whole("DataID").alias("_id"), _whole("Offset").alias("_at"), _whole("OffsetEnd").alias("_end")).where(F.col("_id").isin(VENTILATION))
    return _within_stay(rows, cases).select("patient_id", "stay_id", _time(F.col("_at")).alias("starttime"), _time(F.col("_end")).alias("endtime"), F.lit("mech_vent").alias("intervention"))


def diagnoses(cases: DataFrame) -> DataFrame:
    """The main diagnosis of each stay that has one."""
    text = lambda name: F.concat(F.lit("sicdb_"), F.col(name).cast("string"))
    return cases.where("ICD10Main is not null").select(text("PatientID").alias("patient_id"), text("CaseID").alias("stay_id"), F.col("ICD10Main").cast("string").alias("icd_code"), F.lit("10").alias("icd_version"), F.lit(1).alias("diagnosis_position"))


def abx_duration(medications: DataFrame) -> DataFrame:
    return medications.where("drug_class = 'antibiotic'").select("stay_id", "starttime", "endtime")


def raw_treatments(cases: DataFrame, data_float_h: DataFrame) -> DataFrame:
    """Renal replacement, end-expiratory pressure and norepinephrine equivalents, as a stream of treatments."""
    signals = {DIALYSIS: "rrt", PRESSURE: "peep", NOREPINEPHRINE: "nee"}
    met = _within_stay(_measured(data_float_h, "DataID", "Val", signals), cases).withColumn("charttime", _time(F.col("_at")))
    of = lambda name: met.where(F.col("concept") == name)
    runs = of("rrt").where("value > 0").withColumn("starttime", F.col("charttime")).withColumn("endtime", F.col("charttime"))
    out = streams.renal_replacement(runs, "sicdb").unionByName(streams.end_expiratory_pressures(of("peep"), "sicdb"))
    return out.unionByName(streams.charted_equivalents(of("nee"), "sicdb"))


def read(spark: SparkSession, root: str, concepts: DataFrame) -> dict[str, DataFrame]:
    """All canonical tables of the files <root>/<table>.csv.gz (or folders of parts of that name). A compressed file is read by one
    task, so a large table is better kept as many parts. Notes and cultures are not in this source: empty tables."""
    raw = {name: read_csv(spark, f"{root}/{name}.csv.gz") for name in TABLES}
    drugs = meds(raw["cases"], raw["medication"], raw["d_references"])
    out = {
        "stays": stays(raw["cases"]),
        "events_long": events(raw["cases"], raw["laboratory"], raw["data_float_h"], raw["d_references"], concepts),
        "meds": drugs,
        "interventions": interventions(raw["cases"], raw["data_range"]),
        "diagnoses": diagnoses(raw["cases"]),
        "abx_duration": abx_duration(drugs),
    }
    return {table: out[table] if table in out else empty(spark, table) for table in SCHEMAS}

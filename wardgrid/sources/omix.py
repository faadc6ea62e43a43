"""Reader of a source of one hospital whose times are days from the admission to it, with a key of patient and admission.

A stay lies between the first entry to and the last exit from a unit, as the transfers tell; where one of them is missing, the
hospital's admission or discharge stands for it, and where both are, or contradict each other, the first and the last value that
was charted. Admissions whose key is not unique are left out. Item names are partly Chinese: files may be UTF-8 or, with
encoding="GB18030" and spark.sql.legacy.javaCharsets set, as they were delivered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardgrid.functions import clean
from wardgrid.functions.source_rules import DRUG_HINTS, age_of_band, icd_roots, sex, two_part_key
from wardgrid.operators.derive import single_keys
from wardgrid.operators.streams import renal_replacement
from wardgrid.sources.tables import SCHEMAS, canonical, empty, read_csv_or_empty

#: The anchor (2012-01-01 UTC, in seconds).
ANCHOR = 1325376000
#: Names of laboratory values, of vital signs, of charted vital signs and of outputs.
LABS = {
    "hemoglobin": "hgb", "platelet count": "plt", "White blood cell count": "wbc", "Classification of neutrophils": "neut", "Lymphocyte classification": "lymph",
    "creatinine": "crea", "urea": "bun", "glucose": "glu", "total bilirubin": "bili", "Direct bilirubin": "bili_dir", "albumin": "alb", "calcium": "ca",
    "Standard ion calcium": "cai", "phosphorus": "phos", "Alanine aminotransferase": "alt", "Aspartate aminotransferase": "ast", "alkaline phosphatase": "alp",
    "creatine kinase": "ck", "lactic acid": "lact", "PH": "ph", "Blood oxygen partial pressure": "po2", "Partial pressure of carbon dioxide": "pco2",
    "Standard bicarbonate": "bicar", "Actual bicarbonate": "bicar", "Inhalation oxygen concentration": "fio2", "Blood oxygen saturation": "o2sat",
    "International standardization ratio": "inr_pt", "Partial thromboplastin time": "ptt", "Hypersensitivity C-reactive protein": "crp",
    "Cardiac troponin I": "tnt", "Troponin T (POCT)": "tnt", "Troponin (POCT)": "tnt",
}
VITALS = {
    "Respiratory rate": "resp", "Temperature": "temp", "Heart Rate": "hr", "Pulse rate": "hr", "Systolic Blood pressure": "sbp",
    "Diastolic Blood pressure": "dbp", "Oxygen saturation (Pulse Oxymetry)": "o2sat",
}
CHART = {
    "心率": "hr", "脉率": "hr", "SpO2": "o2sat", "无创收缩压": "sbp", "无创舒张压": "dbp", "有创动脉收缩压": "sbp", "有创动脉舒张压": "dbp",
    "呼吸频率(测)": "resp", "体温": "temp", "氧浓度": "fio2",
}
OUTPUTS = {"小便": "urine"}
#: Settings of the ventilator.
VENTILATED = ["呼吸机模式", "呼气末正压", "气道峰压", "分钟通气量", "呼吸频率(设)"]
#: Departments that are units, and the route of drugs given in renal replacement.
UNITS, DIALYSIS = ["ICU", "Department of critical medicine"], "For CRRT"
#: Parts of drug names of this source, which come before the common ones.
OWN_HINTS = [
    ("adrenaline", "vasopressor"), ("deoxyepinephrine", "vasopressor"), ("metaraminol", "vasopressor"), ("posterior pituitary", "vasopressor"),
    ("cefoperazone", "antibiotic"), ("sulbactam", "antibiotic"), ("cefuroxime", "antibiotic"), ("teicoplanin", "antibiotic"), ("linezolid", "antibiotic"),
    ("moxifloxacin", "antibiotic"), ("colistin", "antibiotic"), ("polymyxin", "antibiotic"), ("daptomycin", "antibiotic"), ("fluconazole", "antibiotic"),
    ("caspofungin", "antibiotic"), ("shupu deep needle", "antibiotic"), ("tagasi", "antibiotic"), ("tezhixing", "antibiotic"),
    ("stable and reliable needle", "antibiotic"), ("cola bituo", "antibiotic"), ("meiping", "antibiotic"), ("taineng", "antibiotic"), ("dafukang", "antibiotic"),
]
#: Factors by concept and the source's unit in lower case.
FACTORS = {
    ("crea", "umol/l"): 0.011312, ("bun", "mmol/l"): 2.8014, ("glu", "mmol/l"): 18.0156, ("bili", "umol/l"): 0.058467, ("bili_dir", "umol/l"): 0.058467,
    ("alb", "g/l"): 0.1, ("hgb", "g/l"): 0.1, ("ca", "mmol/l"): 4.008, ("phos", "mmol/l"): 3.0974,
}
KEY = ["patient_SN", "Hospital_ID"]
TABLES = {
    "PtAdmiTable": [*KEY, "Age_cut", "Sex", "StatusOnDischarge", "Discharge_DateTime"],
    "HospitalTransfer": [*KEY, "TransferTo_Dept_Eng", "TransferIn_DateTime", "TransferFrom_Dept_Eng", "TransferOut_DateTime"],
    "Lab": [*KEY, "Lab_itemName_Eng", "Lab_results", "Lab_DateTime", "Unit_measure"],
    "VitalSign": [*KEY, "VitalSign_DESC", "VitalSign_value", "VitalSign_DateTime", "VitalSign_unit"],
    "NursingChart_VitalSign": [*KEY, "NursingEvent_item", "NursingEvent_val", "Event_DateTime", "NursingEvent_Unit"],
    "NursingChart_IO": [*KEY, "NursingIO_item", "NursingIO_val", "Event_DateTime", "NursingIO_Unit"],
    "Medication": [*KEY, "Med_DESC_Eng", "Med_startTime", "Med_stopTime", "SingleDose", "Med_unit", "Med_route_Eng"],
    "MicrobiologyCulture": [*KEY, "MicrobiologyCulture_sample_Eng", "MicrobiologyCulture_DateTime"],
    "Diagnosis": [*KEY, "ICD10_code"],
}
#: The charts whose times tell where a stay lies, if the transfers do not.
CHARTED = {"Lab": "Lab_DateTime", "VitalSign": "VitalSign_DateTime", "NursingChart_VitalSign": "Event_DateTime", "NursingChart_IO": "Event_DateTime"}


def _time(days: str | Column) -> Column:
    days = F.col(days) if isinstance(days, str) else days
    return clean.offset_time(F.timestamp_seconds(F.lit(ANCHOR)), days.try_cast("double"), "day")


def _number(name: str) -> Column:
    return F.col(name).try_cast("double")


def windows(raw: dict[str, DataFrame]) -> DataFrame:
    """The admissions whose key is unique, with patient_id, stay_id and the days _from and _to of their stay.

    Entries and exits are coalesced by a full join, as an admission may have one without the other.
    """
    moves = raw["HospitalTransfer"]
    entered = moves.where(F.col("TransferTo_Dept_Eng").isin(UNITS)).groupBy(*KEY).agg(F.min(_number("TransferIn_DateTime")).alias("_in"))
    left = moves.where(F.col("TransferFrom_Dept_Eng").isin(UNITS)).groupBy(*KEY).agg(F.max(_number("TransferOut_DateTime")).alias("_out"))
    times = reduce(DataFrame.unionByName, [raw[name].select(*KEY, _number(at).alias("_t")) for name, at in CHARTED.items()])
    seen = times.where("_t >= 0").groupBy(*KEY).agg(F.min("_t").alias("_first"), F.max("_t").alias("_last"))
    whole = single_keys(raw["PtAdmiTable"], KEY).withColumn("_end", _number("Discharge_DateTime")).where("_end is not null")
    met = whole.join(entered.join(left, KEY, "full"), KEY, "left").join(seen, KEY, "left")
    both, entry, exit_ = F.col("_out") > F.col("_in"), F.col("_in").isNotNull(), F.col("_out").isNotNull()
    begin = F.when(both | (entry & ~exit_), F.col("_in")).when(~entry & exit_, F.lit(0.0)).otherwise(F.coalesce("_first", F.lit(0.0)))
    end = F.when(both | (~entry & exit_), F.col("_out")).when(entry & ~exit_, F.col("_end")).otherwise(F.least(F.coalesce("_last", "_end"), "_end"))
    keys = [F.concat(F.lit("omix_"), F.col(KEY[0])).alias("patient_id"), two_part_key("omix", F.col(KEY[0]), F.col(KEY[1])).alias("stay_id")]
    return met.select(*raw["PtAdmiTable"].columns, *keys, begin.alias("_from"), end.alias("_to"))


def stays(where: DataFrame) -> DataFrame:
    """Canonical stays of windows(). The source has the columns of the sexes the wrong way round."""
    dead = F.coalesce(F.col("StatusOnDischarge") == "Dead", F.lit(False))
    none = F.lit(None)
    out = where.select(
        "patient_id", F.col(KEY[0]).alias("subject_id"), "stay_id", F.lit("omix").alias("dataset"), F.col(KEY[1]).alias("hospital_id"), age_of_band(F.col("Age_cut")).alias("age"),
        sex(F.col("Sex"), "omix").alias("sex"), none.alias("ethnicity"), none.alias("weight"), none.alias("height"), _time("_from").alias("admit_time"), _time("_to").alias("discharge_time"),
        ((F.col("_to") - F.col("_from")) * 24.0).alias("los_hours"), dead.alias("mortality_in_icu"), dead.alias("mortality_in_hospital"), none.alias("mortality_30day"), none.alias("admission_diagnosis"),
    )
    return canonical(out, "stays")


def _inside(rows: DataFrame, where: DataFrame) -> DataFrame:
    """Rows (key, _t in days, ...) of a known stay, from its start to its end."""
    return rows.join(where.select(*KEY, "patient_id", "stay_id", "_from", "_to"), KEY).where(F.col("_t").between(F.col("_from"), F.col("_to"))).drop("_from", "_to")


def _arm(rows: DataFrame, item: str, names: dict[str, str], value: Column, at: str, unit: str) -> DataFrame:
    of = F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.col(item))
    return rows.where(F.col(item).isin(*names)).select(*KEY, _number(at).alias("_t"), of.alias("concept"), value.alias("value"), F.col(unit).alias("unit_source"))


def events(raw: dict[str, DataFrame], where: DataFrame, concepts: DataFrame) -> DataFrame:
    """Canonical events of all charts. A concept without a unit is 'unknown'; concepts is (concept, canonical_unit, low, high)."""
    arms = [
        _arm(raw["Lab"], "Lab_itemName_Eng", LABS, _number("Lab_results"), "Lab_DateTime", "Unit_measure"),
        _arm(raw["VitalSign"], "VitalSign_DESC", VITALS, _number("VitalSign_value"), "VitalSign_DateTime", "VitalSign_unit"),
        _arm(raw["NursingChart_VitalSign"], "NursingEvent_item", CHART, _number("NursingEvent_val"), "Event_DateTime", "NursingEvent_Unit"),
        _arm(raw["NursingChart_IO"], "NursingIO_item", OUTPUTS, clean.leading_number(F.col("NursingIO_val")), "Event_DateTime", "NursingIO_Unit"),
    ]
    met = _inside(reduce(DataFrame.unionByName, arms).where("value is not null"), where)
    factors = F.create_map(*[F.lit(x) for (concept, unit), factor in FACTORS.items() for x in (f"{concept} {unit}", factor)])
    scaled = F.col("value") * F.coalesce(F.try_element_at(factors, F.concat("concept", F.lit(" "), F.lower("unit_source"))), F.lit(1.0))
    rows = met.select("patient_id", "stay_id", _time("_t").alias("charttime"), "concept", scaled.alias("value"), F.lit("unknown").alias("unit"), "unit_source")
    return canonical(clean.canonical_units(rows, concepts), "events_long")


def meds(medication: DataFrame, where: DataFrame) -> DataFrame:
    named = medication.where("Med_DESC_Eng is not null").withColumn("_t", _number("Med_startTime"))
    hints = OWN_HINTS + [h for h in DRUG_HINTS if h[0] not in dict(OWN_HINTS)]
    met = _inside(named, where).select(
        "patient_id", "stay_id", _time("_t").alias("starttime"), _time("Med_stopTime").alias("endtime"), F.col("Med_DESC_Eng").alias("drug"), F.col("SingleDose").try_cast("float").alias("dose"),
        F.col("Med_unit").alias("dose_unit"), F.col("Med_route_Eng").alias("route"), clean.first_class(F.col("Med_DESC_Eng"), hints).alias("drug_class"),
    )
    return canonical(met, "meds")


def microbio(cultures: DataFrame, where: DataFrame) -> DataFrame:
    """When samples were taken; what grew is not decoded."""
    rows = _inside(cultures.withColumn("_t", _number("MicrobiologyCulture_DateTime")), where)
    return canonical(rows.select("patient_id", "stay_id", _time("_t").alias("charttime"), F.col("MicrobiologyCulture_sample_Eng").alias("specimen_type"), F.lit(None).alias("organism")), "microbio")


def interventions(chart: DataFrame, where: DataFrame) -> DataFrame:
    """Ventilation wherever a setting of the ventilator is charted."""
    rows = _inside(chart.where(F.col("NursingEvent_item").isin(VENTILATED)).withColumn("_t", _number("Event_DateTime")), where)
    return canonical(rows.select("patient_id", "stay_id", _time("_t").alias("starttime"), F.lit(None).alias("endtime"), F.lit("mech_vent").alias("intervention")), "interventions")


def diagnoses(listed: DataFrame, where: DataFrame) -> DataFrame:
    """The roots of each list, numbered from 1 within a stay by list and place in it, as rows of the source have no order."""
    met = listed.where("ICD10_code is not null").join(where.select(*KEY, "patient_id", "stay_id"), KEY)
    each = met.select("patient_id", "stay_id", "ICD10_code", F.posexplode(icd_roots(F.col("ICD10_code"))).alias("_i", "icd_code"))
    place = F.row_number().over(Window.partitionBy("stay_id").orderBy("ICD10_code", "_i"))
    return canonical(each.select("patient_id", "stay_id", "icd_code", F.lit("10").alias("icd_version"), place.alias("diagnosis_position")), "diagnoses")


def abx_duration(medications: DataFrame) -> DataFrame:
    return canonical(medications.where("drug_class = 'antibiotic'"), "abx_duration")


def raw_treatments(medication: DataFrame, where: DataFrame) -> DataFrame:
    """Renal replacement, as long as drugs for it are given, as a stream of treatments."""
    rows = _inside(medication.where(F.col("Med_route_Eng") == DIALYSIS).withColumn("_t", _number("Med_startTime")), where)
    return renal_replacement(rows.select("patient_id", "stay_id", _time("_t").alias("starttime"), _time("Med_stopTime").alias("endtime")), "omix")


def load(spark: SparkSession, root: str, encoding: str = "UTF-8") -> dict[str, DataFrame]:
    """The raw tables of the files <root>/<table>.csv; those that are absent are empty."""
    return {name: read_csv_or_empty(spark, f"{root}/{name}.csv", columns, encoding) for name, columns in TABLES.items()}


def read(spark: SparkSession, root: str, concepts: DataFrame, encoding: str = "UTF-8") -> dict[str, DataFrame]:
    """All canonical tables. Notes are not in this source."""
    raw = load(spark, root, encoding)
    where = windows(raw)
    drugs = meds(raw["Medication"], where)
    out = {
        "stays": stays(where),
        "events_long": events(raw, where, concepts),
        "meds": drugs,
        "interventions": interventions(raw["NursingChart_VitalSign"], where),
        "diagnoses": diagnoses(raw["Diagnosis"], where),
        "microbio": microbio(raw["MicrobiologyCulture"], where),
        "abx_duration": abx_duration(drugs),
    }
    return {table: out[table] if table in out else empty(spark, table) for table in SCHEMAS}

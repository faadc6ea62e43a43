"""Reader of a source of one hospital whose times are hours from the admission to it, with two kinds of keys.

Charts know the admission (INP_NO), drugs the patient (PATIENT_ID) alone; the baseline table is the crosswalk, in which one may
stand for several of the other. Rows are laid at every stay of their key whose time holds them, so none is lost, and crosswalk()
counts the keys that are not one to one. A stay begins with its first hour in a unit, or at 0, and ends where the baseline says.
The nurses' chart is wide and quoted, with a free text of many lines: ragged lines are errors, and that text is not kept.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardgrid.functions import clean
from wardgrid.functions.source_rules import is_morphology
from wardgrid.operators.derive import long_vitals
from wardgrid.operators.streams import renal_replacement
from wardgrid.sources.tables import SCHEMAS, canonical, empty, exists, read_csv_or_empty

#: The anchor (2019-01-01 UTC, in seconds) and the oldest age.
ANCHOR, OLDEST = 1546300800, 120.0
#: Names of laboratory values.
LABS = {
    "Creatinine (enzymatic method) (CRE)": "crea", "Urea (urea)": "bun", "Glucose (Glu)": "glu", "Glucose concentration (cglu)": "glu", "Potassium (k)": "k",
    "Potassium ion (K +)": "k", "Potassium ion concentration (CK +)": "k", "Sodium (NA)": "na", "Sodium ion (Na +)": "na",
    "Sodium ion concentration (CNA +)": "na", "Chlorine (CL)": "cl", "Chloride ion (Cl -)": "cl", "Chloride ion concentration (CCL -)": "cl",
    "Calcium (CA)": "ca", "Free calcium (Ca + +)": "cai", "Calcium ion concentration (caca2 +)": "cai", "Serum magnesium (mg)": "mg",
    "Inorganic phosphorus (P)": "phos", "Albumin (ALB)": "alb", "Total bilirubin (TBIL)": "bili", "Direct bilirubin (DBIL)": "bili_dir",
    "Alanine aminotransferase (ALT)": "alt", "Aspartate aminotransferase (AST)": "ast", "Alkaline phosphatase (ALP)": "alp", "Creatine kinase (CK)": "ck",
    "Creatine kinase isoenzyme (CK-MB)": "ckmb", "Hemoglobin (Hgb)": "hgb", "White blood cell (WBC)": "wbc", "Platelet (PLT)": "plt",
    "Mean corpuscular volume (MCV)": "mcv", "Mean hemoglobin (MCH)": "mch", "Mean hemoglobin concentration (MCHC)": "mchc", "Neutrophil ratio (neu%)": "neut",
    "Lymphocyte ratio (lym%)": "lymph", "Methemoglobin (fmethb)": "methb", "International normalized ratio (INR)": "inr_pt",
    "Activated partial thromboplastin time (APTT)": "ptt", "Fibrinogen (FIB)": "fgn", "Lactic acid (LAC)": "lact", "Lactic acid concentration (CLAC)": "lact",
    "PH (PH)": "ph", "Oxygen partial pressure (PO2)": "po2", "Arterial oxygen partial pressure (PO2)": "po2", "Carbon dioxide partial pressure (PCO2)": "pco2",
    "Arterial partial pressure of carbon dioxide (PCO2)": "pco2", "Standard residual base (be (ECF))": "be", "Measured residual alkali (be (b))": "be",
    "Measured bicarbonate (hco3act)": "bicar", "Standard bicarbonate (hco3std)": "bicar", "HCO3 - measured bicarbonate (HCO3 -)": "bicar",
    "Oxygen saturation (SO2)": "o2sat", "C-reactive protein (CRP)": "crp", "High sensitivity troponin I (tn-i)": "tnt", "Body temperature (Temp)": "temp",
    "Patient temperature (T)": "temp",
}
#: Columns of the nurses' chart, and the unit of the one that is in another than its concept's.
CHART = {
    "temperature": "temp", "heart_rate": "hr", "breathing": "resp", "Blood_oxygen_saturation": "o2sat", "Blood_pressure_high": "sbp",
    "Blood_pressure_low": "dbp", "Invasive_SBP": "sbp", "Invasive_diastolic_blood_pressure": "dbp", "blood_sugar": "glu", "Urine_volume": "urine",
}
CHART_UNITS = {"blood_sugar": "mmol/L"}
#: Factors by concept and the source's unit in lower case; shares of cells without a unit are fractions.
FACTORS = {
    ("crea", "umol/l"): 0.011312, ("bun", "mmol/l"): 2.8014, ("glu", "mmol/l"): 18.0156, ("bili", "umol/l"): 0.058467, ("bili_dir", "umol/l"): 0.058467,
    ("alb", "g/l"): 0.1, ("hgb", "g/l"): 0.1, ("mchc", "g/l"): 0.1, ("ca", "mmol/l"): 4.008, ("mg", "mmol/l"): 2.4305, ("phos", "mmol/l"): 3.0974,
    ("fgn", "g/l"): 100.0, ("neut", ""): 100.0, ("lymph", ""): 100.0,
}
#: Parts of drug names by class, first match counts.
DRUG_PARTS = {
    "vasopressor": [
        "norepinephrine", "noradrenaline", "epinephrine", "adrenaline", "dopamine", "dobutamine", "phenylephrine", "deoxyepinephrine", "metaraminol",
        "vasopressin", "posterior pituitary", "pituitrin", "terlipressin",
    ],
    "antibiotic": [
        "penicillin", "piperacillin", "tazobactam", "ampicillin", "amoxicillin", "sulbactam", "cefazolin", "cefuroxime", "cefoperazone", "cefotaxime",
        "ceftazidime", "ceftriaxone", "cefepime", "cefoxitin", "cefraxone", "cephalosporin", "meropenem", "imipenem", "cilastatin", "ertapenem",
        "biapenem", "panipenem", "aztreonam", "vancomycin", "teicoplanin", "linezolid", "clindamycin", "ciprofloxacin", "levofloxacin", "moxifloxacin",
        "ofloxacin", "norfloxacin", "metronidazole", "ornidazole", "tinidazole", "colistin", "polymyxin", "tigecycline", "doxycycline", "minocycline",
        "fosfomycin", "gentamicin", "gentamycin", "amikacin", "etimicin", "daptomycin", "erythromycin", "azithromycin", "clarithromycin", "rifampicin",
        "isoniazid", "sulfamethoxazole", "sulfametoxazol", "trimethoprim", "caspofungin", "micafungin", "anidulafungin", "fluconazole", "voriconazole",
        "itraconazole", "posaconazole", "amphotericin",
    ],
    "sedative": ["propofol", "midazolam", "remifentanil", "sufentanil", "fentanyl", "dexmedetomidine", "diazepam"],
    "diuretic": ["furosemide", "torasemide"],
    "anticoagulant": ["heparin", "enoxaparin", "nadroparin"],
    "insulin": ["insulin"],
}
#: Departments that are units, and those of the emergency department.
UNITS = [
    "Intensive care unit (ICU)", "Intensive care unit (ICU) ward a", "Intensive care unit (ICU) ward B", "Neurosurgery severe NICU",
    "Department of Neurology critical NICU", "Respiratory intensive care unit RICU", "Respiratory and critical illness ward a",
    "Respiratory and critical illness ward B", "Vascular Surgery ICU",
]
EMERGENCY_UNITS = ["EICU", "EICU headquarters", "EICU Huidong", "Eicu-b ward", "Emergency department ward (EICU)"]
#: Columns that are filled while a patient is ventilated, of the parts of the coma score, and of dialysis.
VENTILATED = ["Breathing_pattern", "Endotracheal_intubation"]
EYES, MOTION, SPEECH = "open_one's_eyes", "motion", "language"
DIALYSIS, FREE_TEXT = "Hemodialysis_tube", "NURSING_DESC"
TABLES = {
    "dtBaseline": ["PATIENT_ID", "INP_NO", "SEX", "Age", "InfectionSite", "ICU_discharge_time"],
    "dtTransfer": ["INP_NO", "TransferDept", "StartTime"],
    "dtICD": ["INP_NO", "ICD_Code", "Diagnosis_seq", "Status_Discharge"],
    "dtLab": ["INP_NO", "Item", "LabValue", "Unit", "LabTime"],
    "dtDrugs": ["PATIENT_ID", "DrugName", "Drug_time"],
}


def _time(hours: str) -> Column:
    return clean.offset_time(F.timestamp_seconds(F.lit(ANCHOR)), F.col(hours).try_cast("double"), "hour")


def _id(name: str) -> Column:
    return F.concat(F.lit("zigong_"), F.col(name).cast("string"))


def windows(baseline: DataFrame, transfer: DataFrame, emergency: bool = True) -> DataFrame:
    """baseline with patient_id, stay_id and the hours _from and _to of each admission; PATIENT_ID is _patient here, as names of
    columns do not differ by case."""
    units = UNITS + (EMERGENCY_UNITS if emergency else [])
    begun = transfer.where(F.col("TransferDept").isin(units)).groupBy("INP_NO").agg(F.min(F.col("StartTime").try_cast("double")).alias("_unit"))
    met = baseline.join(begun, "INP_NO", "left")
    ids = [F.col("PATIENT_ID").alias("_patient"), _id("PATIENT_ID").alias("patient_id"), _id("INP_NO").alias("stay_id")]
    return met.select("INP_NO", "SEX", "Age", "InfectionSite", *ids, F.coalesce("_unit", F.lit(0.0)).alias("_from"), F.col("ICU_discharge_time").try_cast("double").alias("_to"))


def crosswalk(baseline: DataFrame) -> DataFrame:
    """(key, n_keys, n_ambiguous, n_rows): how many keys of each kind stand for more than one of the other, and their rows."""
    pairs = baseline.where("PATIENT_ID is not null and INP_NO is not null").groupBy("PATIENT_ID", "INP_NO").agg(F.count("*").alias("n"))
    out = None
    for key in ("PATIENT_ID", "INP_NO"):
        per = pairs.groupBy(key).agg(F.count("*").alias("m"), F.sum("n").alias("n"))
        row = per.agg(F.lit(key).alias("key"), F.count("*").alias("n_keys"), F.count_if(F.col("m") > 1).alias("n_ambiguous"), F.coalesce(F.sum(F.when(F.col("m") > 1, F.col("n"))), F.lit(0)).alias("n_rows"))
        out = row if out is None else out.unionByName(row)
    return out


def stays(where: DataFrame, icd: DataFrame) -> DataFrame:
    """Canonical stays of windows(); those without an end, a sex or an age are left out. Deaths are those before discharge."""
    dead = icd.where("Status_Discharge = 'Dead'").select("INP_NO", F.lit(True).alias("_dead")).distinct()
    sex = F.upper(F.substring("SEX", 1, 1))
    died = F.coalesce("_dead", F.lit(False))
    out = where.join(dead, "INP_NO", "left").select(
        "patient_id", F.col("_patient").alias("subject_id"), "stay_id", F.lit("zigong").alias("dataset"), F.lit("zigong").alias("hospital_id"),
        F.when(F.col("Age").try_cast("double").isNotNull(), F.greatest(F.lit(0.0), F.least(F.col("Age").try_cast("double"), F.lit(OLDEST)))).alias("age"),
        F.when(sex.isin("M", "F"), sex).alias("sex"), F.lit(None).alias("ethnicity"), F.lit(None).alias("weight"), F.lit(None).alias("height"), _time("_from").alias("admit_time"),
        _time("_to").alias("discharge_time"), F.greatest(F.col("_to") - F.col("_from"), F.lit(0.0)).alias("los_hours"), died.alias("mortality_in_icu"), died.alias("mortality_in_hospital"),
        F.lit(None).alias("mortality_30day"), F.col("InfectionSite").alias("admission_diagnosis"),
    )
    return canonical(out, "stays")


def _inside(rows: DataFrame, where: DataFrame, key: str) -> DataFrame:
    """Rows (key, _t in hours, ...) at every stay of their key whose hours hold them."""
    at = where.select(key, "patient_id", "stay_id", "_from", "_to")
    return rows.join(at, key).where(F.col("_t").between(F.col("_from"), F.col("_to"))).drop("_from", "_to")


def _measured(lab: DataFrame, chart: DataFrame, where: DataFrame) -> DataFrame:
    """(patient_id, stay_id, charttime, concept, value, unit_source) of laboratory and charted values, in the source's units."""
    names = lambda values: F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    labs = lab.where(F.col("Item").isin(*LABS)).select("INP_NO", F.col("LabTime").try_cast("double").alias("_t"), F.try_element_at(names(LABS), F.col("Item")).alias("concept"), clean.number(F.col("LabValue")).alias("value"), F.col("Unit").alias("unit_source"))
    present = [c for c in CHART if c in chart.columns]
    every = labs
    if present:
        typed = chart.select("INP_NO", F.col("ChartTime").try_cast("double").alias("_t"), *[clean.number(F.col(c)).alias(c) for c in present])
        long = long_vitals(typed, ["INP_NO", "_t"], present)
        every = labs.unionByName(long.select("INP_NO", "_t", F.try_element_at(names(CHART), F.col("concept")).alias("concept"), "value", F.try_element_at(names(CHART_UNITS), F.col("concept")).alias("unit_source")))
    if {EYES, MOTION, SPEECH} <= set(chart.columns):
        parts = [F.split(F.col(f"`{c}`"), "→")[0] for c in (EYES, MOTION, SPEECH)]
        coma = chart.select("INP_NO", F.col("ChartTime").try_cast("double").alias("_t"), F.lit("gcs").alias("concept"), clean.gcs_total(*parts).alias("value"), F.lit(None).cast("string").alias("unit_source"))
        every = every.unionByName(coma)
    return _inside(every.where("value is not null"), where, "INP_NO").select("patient_id", "stay_id", _time("_t").alias("charttime"), "concept", "value", "unit_source")


def events(lab: DataFrame, chart: DataFrame, where: DataFrame, concepts: DataFrame) -> DataFrame:
    """Canonical events, mean pressures from systolic and diastolic ones of one time among them. A concept without a unit is
    'unknown'; concepts is (concept, canonical_unit, low, high)."""
    rows = _measured(lab, chart, where)
    pressures = _measured(lab.limit(0), chart, where).where("concept in ('sbp', 'dbp')")
    of = lambda name: F.avg(F.when(F.col("concept") == name, F.col("value")))
    both = pressures.groupBy("patient_id", "stay_id", "charttime").agg(of("sbp").alias("s"), of("dbp").alias("d")).where("s is not null and d is not null")
    means = both.select("patient_id", "stay_id", "charttime", F.lit("map").alias("concept"), ((F.col("s") + 2.0 * F.col("d")) / 3.0).alias("value"), F.lit(None).cast("string").alias("unit_source"))
    factors = F.create_map(*[F.lit(x) for (concept, unit), factor in FACTORS.items() for x in (f"{concept} {unit}", factor)])
    key = F.concat("concept", F.lit(" "), F.lower(F.coalesce(F.trim("unit_source"), F.lit(""))))
    scaled = rows.unionByName(means).withColumn("value", F.col("value") * F.coalesce(F.try_element_at(factors, key), F.lit(1.0))).withColumn("unit", F.lit("unknown"))
    return canonical(clean.canonical_units(scaled, concepts), "events_long")


def meds(drugs: DataFrame, where: DataFrame) -> DataFrame:
    """Canonical medications: points without doses, at every stay of their patient that holds them."""
    hints = [(part, kind) for kind, parts in DRUG_PARTS.items() for part in parts]
    rows = drugs.where("DrugName is not null").select(F.col("PATIENT_ID").alias("_patient"), "DrugName", F.col("Drug_time").try_cast("double").alias("_t"))
    none = lambda t, n: F.lit(None).cast(t).alias(n)
    met = _inside(rows, where, "_patient").select("patient_id", "stay_id", _time("_t").alias("starttime"), none("timestamp", "endtime"), F.col("DrugName").alias("drug"), none("float", "dose"), none("string", "dose_unit"), none("string", "route"), clean.first_class(F.col("DrugName"), hints).alias("drug_class"))
    return canonical(met, "meds")


def _charted(chart: DataFrame, where: DataFrame, filled: Column) -> DataFrame:
    rows = chart.where(filled).select("INP_NO", F.col("ChartTime").try_cast("double").alias("_t"))
    return _inside(rows, where, "INP_NO").select("patient_id", "stay_id", _time("_t").alias("starttime"))


def interventions(chart: DataFrame, where: DataFrame) -> DataFrame:
    """Ventilation wherever one of its columns is filled."""
    present = [c for c in VENTILATED if c in chart.columns]
    filled = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in present], F.lit(False))
    return canonical(_charted(chart, where, filled).select("*", F.lit(None).alias("endtime"), F.lit("mech_vent").alias("intervention")), "interventions")


def diagnoses(icd: DataFrame, where: DataFrame) -> DataFrame:
    """Three-character roots; codes of tumour morphology are left out."""
    code = F.nullif(F.regexp_extract("ICD_Code", r"^([A-Za-z]\d{2})", 1), F.lit(""))
    rows = icd.where(~is_morphology(F.col("ICD_Code"))).select("INP_NO", code.alias("icd_code"), F.lit("10").alias("icd_version"), F.col("Diagnosis_seq").try_cast("int").alias("diagnosis_position"))
    return canonical(rows.join(where.select("INP_NO", "patient_id", "stay_id"), "INP_NO"), "diagnoses")


def abx_duration(medications: DataFrame) -> DataFrame:
    return canonical(medications.where("drug_class = 'antibiotic'"), "abx_duration")


def raw_treatments(chart: DataFrame, where: DataFrame) -> DataFrame:
    """Renal replacement wherever its tube is charted, as a stream of treatments."""
    if DIALYSIS not in chart.columns:
        chart = chart.withColumn(DIALYSIS, F.lit(None).cast("string"))
    tube = F.trim(DIALYSIS)
    return renal_replacement(_charted(chart, where, tube.isNotNull() & ~tube.isin("", "NA")).withColumn("endtime", F.col("starttime")), "zigong")


def read_chart(spark: SparkSession, path: str) -> DataFrame:
    """The nurses' chart, all text, without its free text; an empty one if there is none."""
    if not exists(spark, path):
        return spark.createDataFrame([], "INP_NO string, ChartTime string")
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("mode", "FAILFAST").csv(path).drop(FREE_TEXT)
    return raw.select(*[clean.null_tokens(F.col(f"`{c}`")).alias(c) for c in raw.columns])


def read(spark: SparkSession, root: str, concepts: DataFrame, emergency: bool = True) -> dict[str, DataFrame]:
    """All canonical tables of the files <root>/<table>.csv. emergency: whether emergency units count. Quoted texts of many lines
    cannot be cut, so the nurses' chart is read by one task a file: keep a large one as a folder of parts."""
    raw = {name: read_csv_or_empty(spark, f"{root}/{name}.csv", columns) for name, columns in TABLES.items()}
    chart = read_chart(spark, f"{root}/dtNursingChart.csv")
    where = windows(raw["dtBaseline"], raw["dtTransfer"], emergency)
    drugs = meds(raw["dtDrugs"], where)
    out = {
        "stays": stays(where, raw["dtICD"]),
        "events_long": events(raw["dtLab"], chart, where, concepts),
        "meds": drugs,
        "interventions": interventions(chart, where),
        "diagnoses": diagnoses(raw["dtICD"], where),
        "abx_duration": abx_duration(drugs),
    }
    return {table: out[table] if table in out else empty(spark, table) for table in SCHEMAS}

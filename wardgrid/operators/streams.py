"""Timed streams of treatments, diagnoses and notes: one row per fact, with the time from which it can be known.

Streams are narrow projections of the canonical tables and never change them. Rows of a stay-bound dataset carry
bound_stay_id and join that stay alone; the others join every stay of their patient. Rows without a time are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardgrid.functions import clean
from wardgrid.functions.source_rules import exam_text, icd_roots, plausible_offset
from wardgrid.operators.timegrid import micros

#: Datasets whose rows belong to one stay.
STAY_BOUND = {"eicu", "omix"}
TREATMENT_COLUMNS = ["patient_id", "bound_stay_id", "source_admission_id", "treatment", "start_time", "end_time", "dose", "dose_unit", "knowable_time", "origin"]
DIAGNOSIS_COLUMNS = ["patient_id", "bound_stay_id", "source_admission_id", "code", "code_system", "knowable_time", "origin"]
#: Treatments by drug class, and the interventions that are treatments.
CLASS_TREATMENTS = {"vasopressor": "vasopressor", "sedative": "sedation"}
INTERVENTIONS = ["mech_vent", "niv", "rrt"]
#: Potency against norepinephrine; the two inotropes have none.
POTENCY = {"norepinephrine": 1.0, "epinephrine": 1.0, "dopamine": 1.0 / 100.0, "phenylephrine": 1.0 / 10.0, "vasopressin": 1.0}
#: Stems of drug names, first match counts.
STEMS = [("norepinephrin", "norepinephrine"), ("epinephrin", "epinephrine"), ("phenylephrin", "phenylephrine"), ("dobutamin", "dobutamine"), ("dopamin", "dopamine"), ("vasopressin", "vasopressin")]
#: Pharmacy ids of one source that has no drug names.
PHARMA_IDS = {1000462: "norepinephrine", 1000656: "norepinephrine", 1000657: "norepinephrine", 1000658: "norepinephrine", 71: "epinephrine", 1000649: "epinephrine", 1000650: "epinephrine", 1000655: "epinephrine", 1000750: "epinephrine", 426: "dobutamine", 112: "vasopressin", 113: "vasopressin"}
#: Units of rates.
BY_WEIGHT, BY_MINUTE, UNITS_AN_HOUR, UNITS_A_MINUTE = ["ug/kg/min", "mcg/kg/min"], ["ug/min", "mcg/min"], ["u/hr", "u/h", "units/hr", "units/h"], ["u/min", "units/min"]
VASOPRESSIN_UNIT = 2.5  # ug/kg/min of norepinephrine for a unit a minute
MOST_NEE = 5.0
#: Settings of end-expiratory pressure that can be, and units of mass in ug.
PEEP_RANGE = (0.0, 25.0)
MASSES = {"mg": 1000.0, "µg": 1.0, "ug": 1.0, "mcg": 1.0}
#: Labels and values of a charting program that say nothing of the patient.
UI_LEAVES = ["Obtain Options", "View Options", "Copies", "Print", "Save Options", "Performed - Structured"]


def _keys(dataset: str) -> list[Column]:
    stay = F.col("stay_id").cast("string")
    bound = stay if dataset in STAY_BOUND else F.lit(None).cast("string")
    return [F.col("patient_id").cast("string").alias("patient_id"), bound.alias("bound_stay_id"), stay.alias("source_admission_id")]


def _treatments(rows: DataFrame, keys: list[Column], treatment: Column, origin: str, dose: Column | None = None, unit: Column | None = None) -> DataFrame:
    """Rows in the columns of a treatment stream; where a dose is asked for, only those that have one."""
    none = F.lit(None)
    out = rows.select(
        *keys, treatment.alias("treatment"), F.col("starttime").alias("start_time"), F.col("endtime").alias("end_time"),
        (none if dose is None else dose).cast("float").alias("dose"), (none if unit is None else unit).cast("string").alias("dose_unit"),
        F.col("starttime").alias("knowable_time"), F.lit(origin).alias("origin"),
    ).where("knowable_time is not null")
    return out if dose is None else out.where("dose is not null")


def drug_treatments(meds: DataFrame, dataset: str) -> DataFrame:
    """Vasopressors and sedatives as intervals without doses."""
    treatment = F.lit(None).cast("string")
    for kind, name in CLASS_TREATMENTS.items():
        treatment = F.when(F.col("drug_class") == kind, name).otherwise(treatment)
    return _treatments(meds.where(F.col("drug_class").isin(*CLASS_TREATMENTS)), _keys(dataset), treatment, "meds")


def intervention_treatments(interventions: DataFrame, dataset: str) -> DataFrame:
    return _treatments(interventions.where(F.col("intervention").isin(INTERVENTIONS)), _keys(dataset), F.col("intervention"), "interventions")


def antibiotic_treatments(abx: DataFrame) -> DataFrame:
    """Antibiotic intervals know their stay only, so they are bound to it in every dataset."""
    stay = F.col("stay_id").cast("string")
    keys = [F.lit(None).cast("string").alias("patient_id"), stay.alias("bound_stay_id"), stay.alias("source_admission_id")]
    return _treatments(abx, keys, F.lit("antibiotic"), "abx")


def sedation_rates(meds: DataFrame, dataset: str) -> DataFrame:
    """Sedatives with the charted rate, as it stands."""
    return _treatments(meds.where("drug_class = 'sedative'"), _keys(dataset), F.lit("sedation_rate"), "meds", F.col("dose"), F.col("dose_unit"))


def insulin_doses(meds: DataFrame, dataset: str) -> DataFrame:
    """Drugs whose name holds 'insulin', with the charted dose."""
    return _treatments(meds.where(F.lower("drug").contains("insulin")), _keys(dataset), F.lit("insulin"), "meds", F.col("dose"), F.col("dose_unit"))


def pressor_name(drug: Column, dataset: str) -> Column:
    """The generic name: by pharmacy id for the source without names, else by the first stem in the name, else the name."""
    low = F.lower(F.trim(drug))
    if dataset == "hirid":
        number, out = F.regexp_extract(low, r"pharmaid_(\d+)", 1).try_cast("long"), F.lit(None).cast("string")
        for code, name in PHARMA_IDS.items():
            out = F.when(number == code, name).otherwise(out)
        return out
    out = low
    for stem, name in reversed(STEMS):
        out = F.when(low.contains(stem), name).otherwise(out)
    return out


def pressor_rate(name: Column, rate: Column, unit: Column, weight: Column) -> Column:
    """The rate in ug/kg/min; vasopressin also from units an hour or a minute. Null for other units, or where weight is missing."""
    u, vaso = F.lower(F.trim(unit)), name == "vasopressin"
    return (
        F.when(u.isin(BY_WEIGHT), rate)
        .when(u.isin(BY_MINUTE), F.try_divide(rate, weight))
        .when(vaso & u.isin(UNITS_AN_HOUR), rate / 60.0 * VASOPRESSIN_UNIT)
        .when(vaso & u.isin(UNITS_A_MINUTE), rate * VASOPRESSIN_UNIT)
    )


def norepinephrine_equivalents(meds: DataFrame, stays: DataFrame, dataset: str) -> DataFrame:
    """Vasopressors as rates of norepinephrine of the same potency. Rows without a usable rate, above 0 and at most MOST_NEE, are
    left out: a rate beyond is an artefact, not a 5."""
    name, factor = F.col("_name"), F.lit(None).cast("double")
    for drug, potency in POTENCY.items():
        factor = F.when(name == drug, potency).otherwise(factor)
    named = meds.withColumn("_name", pressor_name(F.col("drug"), dataset)).where(name.isin(*POTENCY))
    weighed = named.join(stays.select("stay_id", F.col("weight").cast("double").alias("_weight")), "stay_id", "left")
    rate = pressor_rate(name, F.col("dose").cast("double"), F.col("dose_unit"), F.col("_weight")) * factor
    nee = F.when((rate > 0) & (rate <= MOST_NEE), rate)
    return _treatments(weighed, _keys(dataset), F.lit("vasopressor_nee"), "meds", nee, F.lit("ug/kg/min"))


def renal_replacement(rows: DataFrame, dataset: str) -> DataFrame:
    """Raw signs (patient_id, stay_id, starttime, endtime) that renal replacement runs, as treatments."""
    return _treatments(rows, _keys(dataset), F.lit("rrt"), "rrt_raw")


def _points(rows: DataFrame, dataset: str, treatment: str, origin: str, dose: Column, unit: str) -> DataFrame:
    """Measured doses (patient_id, stay_id, charttime) as treatments that start and end where they are charted."""
    at = rows.withColumn("starttime", F.col("charttime")).withColumn("endtime", F.col("charttime"))
    return _treatments(at, _keys(dataset), F.lit(treatment), origin, dose, F.lit(unit))


def end_expiratory_pressures(rows: DataFrame, dataset: str) -> DataFrame:
    """Ventilator settings (patient_id, stay_id, charttime, value) in cmH2O. Values out of PEEP_RANGE stand for something else, so
    they are left out and not moved to its ends."""
    value = F.trim(F.col("value").cast("string")).try_cast("double")
    return _points(rows, dataset, "peep", "peep_raw", clean.within(value, *PEEP_RANGE), "cmH2O")


def infusion_sessions(rows: DataFrame, keys: list[str], gap_min: float, at: str = "charttime") -> DataFrame:
    """rows with infusion, the number within keys of the run they belong to: a run goes on while the next row comes within gap_min.

    For sources that chart what was given but not which infusion it belongs to. Rows without a time have no infusion.
    """
    order = Window.partitionBy(*keys).orderBy(micros(at).asc_nulls_first())
    step = micros(at) - F.lag(micros(at)).over(order)
    opens = F.when(micros(at).isNull() | (step <= int(gap_min * 60_000_000)), 0).otherwise(1)
    return rows.withColumn("_open", opens).withColumn("infusion", F.when(F.col(at).isNotNull(), F.sum("_open").over(order.rowsBetween(Window.unboundedPreceding, 0)))).drop("_open")


def infused_rates(records: DataFrame, keys: list[str]) -> DataFrame:
    """records (charttime, given) with rate, what was given since the record before it within keys, by the minute.

    The first record of an infusion has no rate, and records of one time share what they gave: the sum over the time since the
    last earlier one.
    """
    once = records.where(F.col("charttime").isNotNull()).groupBy(*keys, "charttime").agg(F.sum("given").alias("given"))
    minutes = (micros("charttime") - F.lag(micros("charttime")).over(Window.partitionBy(*keys).orderBy(micros("charttime")))) / 60_000_000.0
    return once.withColumn("rate", F.when(minutes > 0, F.col("given") / minutes)).where("rate is not null")


def infused_equivalents(records: DataFrame, weights: DataFrame, dataset: str) -> DataFrame:
    """Norepinephrine equivalents of what pumps gave: records (patient_id, stay_id, infusion, drug, charttime, given, unit), amounts
    since the record before it in the same infusion; weights is (stay_id, weight).

    Masses count in ug, units of vasopressin by VASOPRESSIN_UNIT; the rate is that by minute and kilogram. Drugs without a potency,
    other units, first records, stays without a weight, and rates that are not in (0, MOST_NEE], give no row.
    """
    drug, unit = F.col("drug"), F.lower(F.trim("unit"))
    mass, potency = F.lit(None).cast("double"), F.lit(None).cast("double")
    for name, factor in MASSES.items():
        mass = F.when(unit == name, factor).otherwise(mass)
    for name, factor in POTENCY.items():
        potency = F.when(drug == name, factor).otherwise(potency)
    amount = F.col("given").cast("double") * F.when(drug == "vasopressin", VASOPRESSIN_UNIT).otherwise(mass) * potency
    keys = ["patient_id", "stay_id", "infusion"]
    rated = infused_rates(records.withColumn("given", amount).where(drug.isin(*POTENCY)), keys)
    met = rated.join(weights.select("stay_id", F.col("weight").cast("double").alias("_weight")).where("_weight > 0"), "stay_id")
    rate = F.col("rate") / F.col("_weight")
    return _points(met, dataset, "vasopressor_nee", "nee_raw", F.when((rate > 0) & (rate <= MOST_NEE), rate), "ug/kg/min")


def charted_equivalents(rows: DataFrame, dataset: str) -> DataFrame:
    """Norepinephrine by weight and hour (patient_id, stay_id, charttime, value in g/kg/h), where it runs, in ug/kg/min."""
    rate = F.col("value").cast("double") * 1.0e6 / 60.0
    return _points(rows, dataset, "vasopressor_nee", "nee_raw", F.when((rate > 0) & (rate <= MOST_NEE), rate), "ug/kg/min")


def billing_diagnoses(codes: DataFrame, admissions: DataFrame, prefix: str) -> DataFrame:
    """Codes (subject_id, hadm_id, icd_code, icd_version), known at the discharge (hadm_id, dischtime) they are billed at."""
    met = codes.where("icd_code is not null").join(admissions.select("hadm_id", "dischtime"), "hadm_id")
    system = F.when(F.col("icd_version").cast("string") == "9", "icd9").otherwise("icd10")
    return met.select(
        F.concat(F.lit(f"{prefix}_"), F.col("subject_id").cast("string")).alias("patient_id"), F.lit(None).cast("string").alias("bound_stay_id"),
        F.concat(F.lit(f"{prefix}_hadm_"), F.col("hadm_id").cast("string")).alias("source_admission_id"),
        F.col("icd_code").cast("string").alias("code"), system.alias("code_system"), F.col("dischtime").cast("timestamp").alias("knowable_time"), F.lit("billing").alias("origin"),
    ).where("knowable_time is not null")


def active_diagnoses(rows: DataFrame, anchor: Column) -> DataFrame:
    """Codes (patient_id, stay_id, icd9code, diagnosisoffset) charted by admission; the first of each list of codes."""
    code = clean.icd_first(F.col("icd9code"))
    system = F.when(code.rlike("^[A-Z]"), "icd10").otherwise("icd9")
    known = clean.offset_time(anchor, F.col("diagnosisoffset"), "min")
    met = rows.where("diagnosisoffset <= 0").select("patient_id", F.col("stay_id").alias("bound_stay_id"), F.col("stay_id").alias("source_admission_id"), code.alias("code"), system.alias("code_system"), known.alias("knowable_time"), F.lit("active").alias("origin"))
    return met.where("code is not null")


def anchored_diagnoses(rows: DataFrame, code: str, system: str, origin: str, anchor: Column) -> DataFrame:
    """Admission diagnoses and past history: known at the anchor."""
    met = rows.where(F.col(code).isNotNull())
    return met.select("patient_id", F.col("stay_id").alias("bound_stay_id"), F.col("stay_id").alias("source_admission_id"), F.col(code).cast("string").alias("code"), F.lit(system).alias("code_system"), anchor.alias("knowable_time"), F.lit(origin).alias("origin"))


def day_stamped_diagnoses(rows: DataFrame, stays: DataFrame, anchor: Column) -> DataFrame:
    """Lists of codes (hospital_id, ICD10_code, Diagnosis_DateTime in days) of stays; without a time they are known at discharge."""
    keys = stays.select(F.col("hospital_id").cast("string").alias("hospital_id"), "patient_id", "stay_id", "discharge_time")
    met = rows.select(F.col("hospital_id").cast("string").alias("hospital_id"), F.explode(icd_roots(F.col("ICD10_code"), True)).alias("code"), F.col("Diagnosis_DateTime").cast("double").alias("_day")).join(keys, "hospital_id")
    known = F.coalesce(clean.offset_time(anchor, F.col("_day"), "day"), F.col("discharge_time").cast("timestamp"))
    origin = F.when(F.col("_day").isNotNull(), "active").otherwise("billing")
    out = met.select("patient_id", F.col("stay_id").alias("bound_stay_id"), F.col("stay_id").alias("source_admission_id"), "code", F.lit("icd10").alias("code_system"), known.alias("knowable_time"), origin.alias("origin"))
    return out.where("knowable_time is not null")


def serialised_rows(rows: DataFrame, note_type: str) -> DataFrame:
    """(stay_id, hour, label, value) as one text '<label>: <value>; ...' per stay and hour, by label, without UI_LEAVES."""
    leaf = F.lit(False)
    for part in UI_LEAVES:
        leaf = leaf | F.col("label").contains(part)
    kept = rows.where(~leaf & ~F.col("value").isin(UI_LEAVES) & (F.length("value") > 0))
    lines = F.array_sort(F.collect_list(F.struct("label", "value")))
    text = F.array_join(F.transform(lines, lambda x: F.concat(x["label"], F.lit(": "), x["value"])), "; ")
    return kept.groupBy("stay_id", "hour").agg(text.alias("text")).withColumn("note_type", F.lit(note_type))


NOTE_COLUMNS = ["patient_id", "bound_stay_id", "source_admission_id", "hadm_id", "note_id", "note_type", "origin", "language", "text", "knowable_time"]


def _note_rows(rows: DataFrame, named: dict[str, Column]) -> DataFrame:
    none = F.lit(None).cast("string")
    return rows.select(*[named.get(c, none).alias(c) for c in NOTE_COLUMNS]).where("knowable_time is not null")


def prose_notes(rows: DataFrame, prefix: str) -> DataFrame:
    """Discharge summaries (note_type DS) and radiology reports (note_id, subject_id, hadm_id, note_type, storetime, text), known when
    they are stored. Of equal texts of a patient and type the last stored is kept, then the least id."""
    kind = F.when(F.col("note_type") == "DS", "discharge").otherwise("radiology")
    text = F.coalesce(clean.clean_note(F.col("text")), F.lit(""))
    out = _note_rows(rows, {
        "patient_id": F.concat(F.lit(f"{prefix}_"), F.col("subject_id").cast("string")), "source_admission_id": F.col("note_id").cast("string"), "hadm_id": F.col("hadm_id").cast("string"),
        "note_id": F.col("note_id").cast("string"), "note_type": kind, "origin": kind, "language": F.lit("en"), "text": text, "knowable_time": F.try_to_timestamp("storetime"),
    })
    rest = [c for c in NOTE_COLUMNS if c not in ("patient_id", "note_type", "text")]
    last = F.min_by(F.struct(*rest), F.struct(-micros("knowable_time"), "note_id"))
    return out.groupBy("patient_id", "note_type", "text").agg(last.alias("_r")).select("patient_id", "note_type", "text", "_r.*").select(*NOTE_COLUMNS)


def exam_report_notes(rows: DataFrame, stays: DataFrame, anchor: Column, prefix: str = "omix") -> DataFrame:
    """Reports (hospital_id, day, category, item, described, finding) of stays, known at their day after the anchor, numbered from 0 in
    the order of their parts among those of one admission and time. Of stays with one hospital_id the least counts."""
    keys = stays.groupBy(F.col("hospital_id").cast("string").alias("hospital_id")).agg(F.min(F.struct("stay_id", "patient_id")).alias("_s")).select("hospital_id", "_s.*")
    met = rows.withColumn("hospital_id", F.col("hospital_id").cast("string")).join(keys, "hospital_id").withColumn("text", exam_text(F.col("category"), F.col("item"), F.col("described"), F.col("finding")))
    place = F.row_number().over(Window.partitionBy("hospital_id", "day").orderBy("category", "item", "text")) - 1
    kind = F.lit("exam_report")
    return _note_rows(met.withColumn("_seq", place), {
        "patient_id": F.col("patient_id"), "bound_stay_id": F.col("stay_id"), "source_admission_id": F.col("stay_id"), "note_type": kind, "origin": kind, "language": F.lit("zh"), "text": F.col("text"),
        "note_id": F.concat_ws("_", F.lit(prefix), F.lit("exam"), "hospital_id", F.col("day").cast("string"), F.col("_seq").cast("string")), "knowable_time": clean.offset_time(anchor, F.col("day").cast("double"), "day"),
    })


def charted_notes(rows: DataFrame, patients: DataFrame, anchor: Column, note_type: str, source: str) -> DataFrame:
    """Charted labels and values (stay_id, offset in minutes, label, value) as one note per stay and hour, known at the first of them;
    rows more than 30 days before admission are left out. patients is (stay_id, patient_id)."""
    kept = rows.where(F.col("offset").isNotNull() & plausible_offset(F.col("offset"))).withColumn("hour", F.floor(F.col("offset") / 60))
    first = kept.groupBy("stay_id", "hour").agg(F.min("offset").alias("_first"))
    met = serialised_rows(kept, note_type).join(first, ["stay_id", "hour"]).join(patients.select("stay_id", "patient_id"), "stay_id", "left")
    return _note_rows(met, {
        "patient_id": F.col("patient_id"), "bound_stay_id": F.col("stay_id"), "source_admission_id": F.col("stay_id"), "note_id": F.concat_ws("_", "stay_id", F.col("hour").cast("string"), F.lit(source)),
        "note_type": F.col("note_type"), "origin": F.col("note_type"), "language": F.lit("en"), "text": F.col("text"), "knowable_time": clean.offset_time(anchor, F.col("_first"), "min"),
    })


def exam_notes(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Exam reports (category, item, described, finding) with their text and a number from 1 within `by`, in the given order."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("text", exam_text(F.col("category"), F.col("item"), F.col("described"), F.col("finding"))).withColumn("seq", place)


def with_split(aligned: DataFrame, splits: DataFrame, dataset: str) -> DataFrame:
    """An aligned stream with the split of its stay; both sides' ids take the dataset's prefix, where it is absent."""
    named = splits.select(clean.stay_key(F.col("stay_id"), dataset).alias("stay_id"), "split")
    return aligned.withColumn("stay_id", clean.stay_key(F.col("stay_id"), dataset)).join(named, "stay_id")


def with_patient(cohort: DataFrame, stays: DataFrame, dataset: str) -> DataFrame:
    """cohort with the patient of each stay, whose ids may lack the prefix; a stay without a patient is an error."""
    known = stays.select(clean.stay_key(F.col("stay_id"), dataset).alias("_key"), "patient_id")
    met = cohort.withColumn("_key", clean.stay_key(F.col("stay_id"), dataset)).join(known, "_key", "left").drop("_key")
    gone = met.where("patient_id is null").count()
    if gone:
        raise ValueError(f"{dataset}: {gone} stays without a patient")
    return met

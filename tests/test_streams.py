"""Source rules and timed streams against literal rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from wardgrid.functions import source_rules as rules
from wardgrid.operators import streams

T = dt.datetime(2020, 1, 1, 6)
MEDS = "patient_id string, stay_id string, starttime timestamp, endtime timestamp, drug string, dose double, dose_unit string, drug_class string"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("column", "want"), [
    (lambda: rules.two_part_key("omix", F.lit(7), F.lit("h1")), "omix_7__h1"),
    (lambda: rules.two_part_key("omix", F.lit(7), F.lit(None)), None),
    (lambda: rules.time_or_noon(F.lit("2020-01-01 06:00:00"), F.lit("2020-01-01")), T),
    (lambda: rules.time_or_noon(F.lit(None).cast("string"), F.lit("2020-01-01")), dt.datetime(2020, 1, 1, 12)),
    (lambda: rules.age_of_band(F.lit("(80,90]")), 85.0),
    (lambda: rules.age_of_band(F.lit("old")), None),
    (lambda: rules.age_at(F.lit(60), F.lit(2018), F.lit("2021-05-01").cast("timestamp")), 63.0),
    (lambda: rules.sex(F.lit("Male"), "omix"), "F"),
    (lambda: rules.sex(F.lit("Male"), "eicu"), "M"),
    (lambda: rules.sex(F.lit("other"), "eicu"), "U"),
    (lambda: rules.sex(F.lit(736), "sicdb"), "F"),
    (lambda: rules.sex(F.lit(1), "sicdb"), None),
    (lambda: rules.note_type(F.lit("Nursing Discharge")), "discharge"),
    (lambda: rules.note_type(F.lit("Nurse Note")), "nursing"),
    (lambda: rules.note_type(F.lit(None).cast("string")), "other"),
    (lambda: rules.icd_priority(F.lit("Major")), 2),
    (lambda: rules.icd_priority(F.lit(None).cast("string")), 99),
    (lambda: rules.is_morphology(F.lit("M8140/3")), True),
    (lambda: rules.is_morphology(F.lit("I10/x")), False),
    (lambda: rules.icd_roots(F.lit("I10.x;bad;E11.9")), ["I10", "E11"]),
    (lambda: rules.icd_roots(F.lit("I10.x;bad;E11.9"), True), ["I10", "E11.9"]),
    (lambda: rules.exam_text(F.lit("CT"), F.lit("Chest"), F.lit(None).cast("string"), F.lit("clear\n lungs")), "CT | Chest: clear lungs"),
    (lambda: rules.plausible_offset(F.lit(-43200)), True),
    (lambda: rules.plausible_offset(F.lit(-43201)), False),
])
def test_rules(spark, column, want):
    assert one(spark, column()) == want


def test_norepinephrine_equivalents(spark):
    given = [
        ("Norepinephrin 5mg", 0.2, "ug/kg/min"),
        ("dopamine", 700.0, "mcg/min "),
        ("Vasopressin", 2.4, "U/h"),
        ("vasopressin", 0.04, "units/min"),
        ("Phenylephrine", 1.0, "ug/kg/min"),
        ("epinephrine", 13.0, "ug/kg/min"),  # an artefact
        ("epinephrine", 0.0, "ug/kg/min"),
        ("norepinephrine", 4.0, "mg"),  # no rate
        ("dobutamin", 3.0, "ug/kg/min"),  # no equivalent
    ]
    meds = spark.createDataFrame([("p", "s", T, None, drug, dose, unit, "vasopressor") for drug, dose, unit in given], MEDS)
    found = streams.norepinephrine_equivalents(meds, spark.createDataFrame([("s", 70.0)], "stay_id string, weight double"), "miiv").collect()
    assert sorted(round(r["dose"], 5) for r in found) == [0.1, 0.1, 0.1, 0.1, 0.2]
    light = streams.norepinephrine_equivalents(meds, spark.createDataFrame([], "stay_id string, weight double"), "miiv")
    assert light.count() == 4  # the rate by minute has no weight
    coded = spark.createDataFrame([("p", "s", T, None, "pharmaid_71", 0.3, "ug/kg/min", None), ("p", "s", T, None, "pharmaid_9", 0.3, "ug/kg/min", None)], MEDS)
    assert [round(r["dose"], 5) for r in streams.norepinephrine_equivalents(coded, light.select(F.lit("s").alias("stay_id"), F.lit(None).alias("weight")).distinct(), "hirid").collect()] == [0.3]


def test_treatment_streams_have_one_shape(spark):
    meds = spark.createDataFrame([("p", "s", T, None, "Insulin regular", 4.0, "U", "other"), ("p", "s", T, None, "propofol", None, None, "sedative"), ("p", "s", None, None, "propofol", 1.0, "x", "sedative"), ("p", "s", T, None, None, 1.0, "x", None)], MEDS)
    acts = spark.createDataFrame([("p", "s", T, None, "niv"), ("p", "s", T, None, "bath")], "patient_id string, stay_id string, starttime timestamp, endtime timestamp, intervention string")
    made = {
        "drugs": streams.drug_treatments(meds, "eicu"), "acts": streams.intervention_treatments(acts, "miiv"), "abx": streams.antibiotic_treatments(acts.limit(1)),
        "insulin": streams.insulin_doses(meds, "miiv"), "sedation": streams.sedation_rates(meds, "miiv"),
    }
    assert all(m.columns == streams.TREATMENT_COLUMNS for m in made.values())
    rows = {k: [(r["treatment"], r["patient_id"], r["bound_stay_id"], r["dose"]) for r in m.collect()] for k, m in made.items()}
    assert rows == {"drugs": [("sedation", "p", "s", None)], "acts": [("niv", "p", None, None)], "abx": [("antibiotic", None, "s", None)], "insulin": [("insulin", "p", None, 4.0)], "sedation": []}


def test_diagnosis_streams(spark):
    anchor = F.lit("2015-01-01").cast("timestamp")
    billed = streams.billing_diagnoses(
        spark.createDataFrame([(1, 2, "I10", 10), (1, 3, "4019", 9), (1, 4, "I11", 10), (1, 2, None, 10)], "subject_id long, hadm_id long, icd_code string, icd_version int"),
        spark.createDataFrame([(2, T), (3, T), (4, None)], "hadm_id long, dischtime timestamp"), "miiv",
    )
    assert sorted((r["source_admission_id"], r["code"], r["code_system"]) for r in billed.collect()) == [("miiv_hadm_2", "I10", "icd10"), ("miiv_hadm_3", "4019", "icd9")]
    rows = spark.createDataFrame([("p", "s", "I10, I11", -60), ("p", "s", "401.9", 0), ("p", "s", "428.0", 5), ("p", "s", None, -1)], "patient_id string, stay_id string, icd9code string, diagnosisoffset int")
    active = streams.active_diagnoses(rows, anchor)
    assert sorted((r["code"], r["code_system"], r["knowable_time"]) for r in active.collect()) == [("401.9", "icd9", dt.datetime(2015, 1, 1)), ("I10", "icd10", dt.datetime(2014, 12, 31, 23))]
    past = streams.anchored_diagnoses(rows, "icd9code", "past_history", "past_history", anchor)
    stamped = streams.day_stamped_diagnoses(
        spark.createDataFrame([("h", "I10;E11.9", 0.5), ("h", "J18", None), ("other", "J18", 1.0)], "hospital_id string, ICD10_code string, Diagnosis_DateTime double"),
        spark.createDataFrame([("h", "p", "s", T)], "hospital_id string, patient_id string, stay_id string, discharge_time timestamp"), anchor,
    )
    assert sorted((r["code"], r["origin"], r["knowable_time"]) for r in stamped.collect()) == [("E11.9", "active", dt.datetime(2015, 1, 1, 12)), ("I10", "active", dt.datetime(2015, 1, 1, 12)), ("J18", "billing", T)]
    assert all(s.columns == streams.DIAGNOSIS_COLUMNS for s in (billed, active, past, stamped)) and past.count() == 3


def test_texts_of_rows_and_exams(spark):
    rows = spark.createDataFrame([("s", 1, "b", "2"), ("s", 1, "a", "1"), ("s", 1, "Print", "x"), ("s", 1, "c", "Copies"), ("s", 1, "d", ""), ("s", 2, "e", None)], "stay_id string, hour int, label string, value string")
    assert [tuple(r) for r in streams.serialised_rows(rows, "nursing").collect()] == [("s", 1, "a: 1; b: 2", "nursing")]
    exams = spark.createDataFrame([("s", 2, "CT", "Chest", "d", "f"), ("s", 1, "MR", "Head", None, None)], "stay_id string, at int, category string, item string, described string, finding string")
    assert sorted((r["seq"], r["text"]) for r in streams.exam_notes(exams, ["stay_id"], ["at"]).collect()) == [(1, "MR | Head:"), (2, "CT | Chest: d f")]


def test_splits_and_patients_are_met_by_any_form_of_id(spark):
    stays = spark.createDataFrame([("eicu_1", "p1"), ("eicu_2", "p2")], "stay_id string, patient_id string")
    cohort = spark.createDataFrame([(1,), (2,)], "stay_id long")
    assert sorted(tuple(r) for r in streams.with_patient(cohort, stays, "eicu").collect()) == [(1, "p1"), (2, "p2")]
    with pytest.raises(ValueError, match="1 stays"):
        streams.with_patient(spark.createDataFrame([(1,), (9,)], "stay_id long"), stays, "eicu")
    met = streams.with_split(spark.createDataFrame([("eicu_1", 3), ("eicu_9", 4)], "stay_id string, n int"), cohort.withColumn("split", F.lit("train")), "eicu")
    assert [tuple(r) for r in met.collect()] == [("eicu_1", 3, "train")]

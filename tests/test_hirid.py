"""A source with one stay per patient, on small files against literal rows."""

import datetime as dt

import pytest

from wardgrid.sources import hirid
from wardgrid.sources.tables import SCHEMAS, validate

CONCEPTS = [("crea", "mg/dL", 0.0, 20.0), ("hr", "bpm", 0.0, 300.0), ("urine", "mL", 0.0, 5000.0), ("neut", "%", 0.0, 100.0), ("wbc", "G/l", 0.0, 500.0), ("weight", "kg", 1.0, 400.0)]


def at(hours):
    return dt.datetime(2100, 1, 1) + dt.timedelta(hours=hours)


OBSERVED = [
    (1, 200, at(1), 80.0), (1, 200, at(2), 900.0), (1, 200, at(3), None), (1, 10000400, at(2), 71.0), (1, 10000400, at(1), 70.0), (1, 10000400, at(0), 0.0),
    (1, 20000600, at(1), 88.42), (1, 30005110, at(1), 100.0), (1, 30005110, at(2), 160.0), (1, 30005110, at(3), 20.0), (1, 24000550, at(4), 3.0),
    (1, 20000700, at(5), 10.0), (1, 20000700, at(1), 0.0), (1, 3845, at(1), 2.0), (1, 999, at(1), 1.0), (2, 24000550, at(1), 3.0), (2, 20000300, at(1), 7.4),
]
GIVEN = [(1, 1000274, at(6), 2.0, "g", "IV"), (1, 5, at(1), None, None, None), (2, 1000273, at(1), 1.0, "g", "iv")]


@pytest.fixture(scope="module")
def read(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    (root / "general_table.csv").write_text("patientid,admissiontime,sex,age,discharge_status\n1,2100-01-01 00:00:00,M,60,dead\n2,2100-01-01 00:00:00,F,50,NA\n3,2100-01-01 00:00:00,F,50,alive\n")
    spark.createDataFrame(OBSERVED, "patientid int, variableid int, datetime timestamp, value double").write.parquet(str(root / "raw_stage/observation_tables/parquet"))
    spark.createDataFrame(GIVEN, "patientid int, pharmaid int, givenat timestamp, givendose double, doseunit string, route string").write.parquet(str(root / "raw_stage/pharma_records/parquet"))
    return hirid.read(spark, str(root), spark.createDataFrame(CONCEPTS, "concept string, canonical_unit string, low double, high double"))


def test_stays(read):
    a, b = read["stays"].orderBy("stay_id").collect()  # the third has neither observations nor medications
    assert (a["stay_id"], a["weight"], a["height"], a["discharge_time"], a["los_hours"], a["mortality_in_icu"]) == ("hirid_1", 70.0, None, at(6), 6.0, True)
    assert (b["stay_id"], b["weight"], b["los_hours"], b["mortality_in_icu"], b["mortality_in_hospital"]) == ("hirid_2", None, 1.0, False, None)


def test_events(read):
    got = sorted((r["stay_id"], r["concept"], r["charttime"], round(r["value"], 4), r["unit"], r["unit_source"]) for r in read["events_long"].collect())
    assert got == [
        ("hirid_1", "crea", at(1), 1.0, "mg/dL", "umol/L"),
        ("hirid_1", "hr", at(1), 80.0, "bpm", None),
        ("hirid_1", "neut", at(4), 30.0, "%", None),
        ("hirid_1", "urine", at(1), 100.0, "mL", None),
        ("hirid_1", "urine", at(2), 60.0, "mL", None),
        ("hirid_1", "urine", at(3), 0.0, "mL", None),
        ("hirid_1", "wbc", at(1), 0.0, "G/l", None),
        ("hirid_1", "wbc", at(5), 10.0, "G/l", None),
        ("hirid_1", "weight", at(1), 70.0, "kg", None),
        ("hirid_1", "weight", at(2), 71.0, "kg", None),
    ]


def test_wanted(spark, read):
    rows = spark.createDataFrame(OBSERVED, "patientid int, variableid int, datetime timestamp, value double")
    ranges = spark.createDataFrame(CONCEPTS, "concept string, canonical_unit string, low double, high double")
    assert {r["concept"] for r in hirid.events(rows, ranges, ["neut"]).collect()} == {"neut"}
    assert hirid.events(rows, ranges, []).isEmpty() and hirid.events(rows.limit(0), ranges).isEmpty()


def test_meds_and_intervals(read):
    got = {(r["stay_id"], r["drug"], r["dose"], r["route"], r["drug_class"]) for r in read["meds"].collect()}
    assert got == {("hirid_1", "pharmaid_1000274", 2.0, "iv", "antibiotic"), ("hirid_1", "pharmaid_5", None, None, "other"), ("hirid_2", "pharmaid_1000273", 1.0, "iv", "other")}
    assert {tuple(r) for r in read["abx_duration"].collect()} == {("hirid_1", at(6), at(6) + dt.timedelta(minutes=1)), ("hirid_2", at(1), at(1) + dt.timedelta(minutes=1))}
    assert [(r["stay_id"], r["starttime"], r["intervention"]) for r in read["interventions"].collect()] == [("hirid_1", at(1), "mech_vent")]
    assert set(read) == set(SCHEMAS) and read["diagnoses"].isEmpty()
    for table in ("stays", "events_long", "meds", "interventions", "abx_duration"):
        validate(read[table], table)


def test_two_rows_of_a_patient(spark):
    general = spark.createDataFrame([(1, "2100-01-01", "M", 1, None)] * 2, "patientid int, admissiontime string, sex string, age int, discharge_status string")
    with pytest.raises(ValueError, match="not unique"):
        hirid.stays(general, spark.createDataFrame([], "patientid int, variableid int, datetime timestamp, value double"), spark.createDataFrame([], "patientid int, givenat timestamp"))

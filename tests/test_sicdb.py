"""A source with times in seconds, on small files against literal rows."""

import datetime as dt
import gzip

import pytest

from wardgrid.sources import sicdb
from wardgrid.sources.tables import SCHEMAS, schema_of, validate

FILES = {
    "cases": "CaseID,PatientID,ICUOffset,TimeOfStay,AgeOnAdmission,Sex,WeightOnAdmission,HeightOnAdmission,DischargeState,HospitalDischargeType,ICD10Main,ICD10MainText\n"
    "1,10,3600,93600,61,735,80000,180,2215,3130,I21.0,infarct\n2,10,0,7200,44,736,0,NA,NA,1,NA,NA\n3,11,7200,3600,50,1,70000,170,1,1,J18,pneumonia\n",
    "laboratory": "CaseID,LaboratoryID,Offset,LaboratoryValue\n1,367,3600,1.5\n1,367,3599,1.6\n1,367,93600,1.7\n1,367,93601,1.8\n1,457,7200,2\n1,999,7200,5\n1,355,7200,x\n9,367,7200,1\n2,688,100,7.4\n1,367,7200,900\n1,367,NA,1\n",
    "data_float_h": "CaseID,DataID,Offset,Val\n1,708,7200,90\n1,725,7200,120\n",
    "medication": "CaseID,DrugID,Offset,OffsetDrugEnd,Amount\n1,1001,7200,10800,2.5\n1,1002,7200,NA,1\n1,1003,7200,7300,1\n1,1001,0,100,1\n",
    "data_range": "CaseID,DataID,Offset,OffsetEnd\n1,720,7200,10800\n1,721,7200,10800\n2,3041,7201,7300\n",
    "d_references": "ReferenceGlobalID,ReferenceValue,ReferenceUnit\n367,Kreatinin,mg/dL\n457,Calcium,MMOL/L\n688,pH,\n708,HF,/min\n1001,Meropenem 1g,g\n1002,Norepinephrin,mg\n",
}
CONCEPTS = [("crea", "mg/dL", 0.0, 20.0), ("ca", "mg/dL", 2.0, 20.0), ("hr", "bpm", 0.0, 300.0), ("urine", "mL", None, None)]


def at(seconds):
    return dt.datetime(2013, 1, 1) + dt.timedelta(seconds=seconds)


@pytest.fixture(scope="module")
def read(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    for name, text in FILES.items():
        with gzip.open(root / f"{name}.csv.gz", "wt") as f:
            f.write(text)
    return sicdb.read(spark, str(root), spark.createDataFrame(CONCEPTS, "concept string, canonical_unit string, low double, high double"))


def test_stays(read):
    a, b, c = read["stays"].orderBy("stay_id").collect()
    assert (a["patient_id"], a["stay_id"], a["weight"], a["height"], a["sex"], a["los_hours"]) == ("sicdb_10", "sicdb_1", 80.0, 180.0, "M", 25.0)
    assert (a["admit_time"], a["discharge_time"], a["mortality_in_icu"], a["mortality_in_hospital"], a["mortality_30day"]) == (at(3600), at(93600), True, True, None)
    assert (b["weight"], b["height"], b["sex"], b["mortality_in_icu"], b["mortality_in_hospital"]) == (None, None, "F", False, False)
    assert (c["los_hours"], c["sex"]) == (0.0, None)


def test_events(read):
    got = {(r["stay_id"], r["charttime"], r["concept"], round(r["value"], 3), r["unit"], r["unit_source"]) for r in read["events_long"].collect()}
    assert got == {
        ("sicdb_1", at(3600), "crea", 1.5, "mg/dL", "mg/dL"),
        ("sicdb_1", at(93600), "crea", 1.7, "mg/dL", "mg/dL"),
        ("sicdb_1", at(7200), "ca", 8.016, "mg/dL", "MMOL/L"),
        ("sicdb_1", at(7200), "hr", 90.0, "bpm", "/min"),
        ("sicdb_1", at(7200), "urine", 120.0, "mL", None),
        ("sicdb_2", at(100), "ph", 7.4, "unknown", None),
    }
    assert read["events_long"].count() == 6


def test_meds_and_intervals(read):
    got = {(r["drug"], r["starttime"], r["endtime"], r["dose"], r["dose_unit"], r["drug_class"]) for r in read["meds"].collect()}
    assert got == {("Meropenem 1g", at(7200), at(10800), 2.5, "g", "antibiotic"), ("Norepinephrin", at(7200), None, 1.0, "mg", "vasopressor"), (None, at(7200), at(7300), 1.0, None, "other")}
    assert [tuple(r) for r in read["abx_duration"].collect()] == [("sicdb_1", at(7200), at(10800))]
    assert [tuple(r) for r in read["interventions"].collect()] == [("sicdb_10", "sicdb_1", at(7200), at(10800), "mech_vent")]


def test_diagnoses_and_tables(read):
    assert {tuple(r) for r in read["diagnoses"].collect()} == {("sicdb_10", "sicdb_1", "I21.0", "10", 1), ("sicdb_11", "sicdb_3", "J18", "10", 1)}
    assert set(read) == set(SCHEMAS)
    assert read["notes"].isEmpty() and read["microbio"].isEmpty()
    for table in ("events_long", "interventions", "diagnoses", "abx_duration"):
        assert read[table].columns == schema_of(table).names
        validate(read[table], table)


def test_empty_tables(spark, read):
    none = spark.createDataFrame([], "CaseID string, PatientID string, ICUOffset string, TimeOfStay string, AgeOnAdmission string, Sex string, WeightOnAdmission string, HeightOnAdmission string, DischargeState string, HospitalDischargeType string, ICD10Main string, ICD10MainText string")
    assert sicdb.stays(none).isEmpty() and sicdb.diagnoses(none).isEmpty()

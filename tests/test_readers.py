"""Sources on small files against literal rows."""

import datetime as dt
import gzip

import pytest

from wardgrid.operators.derive import last_wards, star_join
from wardgrid.sources import eicu, mimic, nwicu, omix, zigong
from wardgrid.sources.tables import SCHEMAS, read_csv_or_empty, schema_of, validate

CONCEPTS = [
    ("hr", "bpm", 0.0, 300.0), ("temp", "°C", 25.0, 45.0), ("crea", "mg/dL", 0.0, 20.0), ("gcs", "points", 3.0, 15.0), ("urine", "mL", 0.0, 5000.0), ("map", "mmHg", 10.0, 200.0),
    ("sbp", "mmHg", 20.0, 300.0), ("dbp", "mmHg", 5.0, 200.0), ("ph", None, 6.0, 8.0), ("crp", "mg/L", 0.0, 1000.0), ("fio2", "%", 21.0, 100.0), ("resp", "breaths/min", 0.0, 80.0),
    ("weight", "kg", 1.0, 500.0), ("neut", "%", 0.0, 100.0), ("glu", "mg/dL", 0.0, 2000.0), ("o2sat", "%", 0.0, 100.0), ("cai", "mmol/L", 0.1, 5.0),
]


@pytest.fixture(scope="module")
def concepts(spark):
    return spark.createDataFrame(CONCEPTS, "concept string, canonical_unit string, low double, high double")


def write(root, files, zipped=True, encoding="utf-8"):
    for name, text in files.items():
        path = root / (f"{name}.csv.gz" if zipped else f"{name}.csv")
        path.parent.mkdir(parents=True, exist_ok=True)
        with gzip.open(path, "wt") if zipped else open(path, "w", encoding=encoding) as f:
            f.write(text)
    return str(root)


def day(text):
    return dt.datetime.fromisoformat(text)


def check_tables(tables):
    assert set(tables) == set(SCHEMAS)
    for name, rows in tables.items():
        assert rows.columns == schema_of(name).names
        validate(rows, name)


def event_rows(rows):
    return sorted((r.stay_id, str(r.charttime), r.concept, round(r.value, 2), r.unit, r.unit_source) for r in rows.collect())


MIMIC = {
    "icu/icustays": "subject_id,hadm_id,stay_id,first_careunit,last_careunit,intime,outtime,los\n1,10,100,MICU,MICU,2150-01-01 12:00:00,2150-01-03 12:00:00,2.0\n1,10,101,MICU,MICU,2150-01-05 00:00:00,2150-01-06 00:00:00,1.0\n2,20,200,SICU,SICU,2160-05-01 00:00:00,2160-05-02 00:00:00,1.0\n3,30,300,MICU,MICU,,2160-05-02 00:00:00,1.0\n",
    "hosp/admissions": "subject_id,hadm_id,admittime,dischtime,deathtime,hospital_expire_flag,race\n1,10,2150-01-01 00:00:00,2150-01-07 00:00:00,2150-01-07 00:00:00,1,WHITE\n2,20,2160-04-30 00:00:00,2160-05-09 00:00:00,,0,NA\n3,30,2160-04-30 00:00:00,,,1,\n",
    "hosp/patients": "subject_id,gender,anchor_age,anchor_year,dod\n1,F,60,2148,2150-01-07\n2,M,50,2160,2160-06-20\n3,M,50,2160,\n",
    "hosp/transfers": "subject_id,hadm_id,eventtype,careunit,intime\n1,10,admit,ED,2150-01-01 00:00:00\n1,10,transfer,MICU,2150-01-05 00:00:00\n1,10,discharge,,2150-01-07 00:00:00\n2,20,transfer,Ward,2160-05-02 00:00:00\n2,20,discharge,,2160-05-09 00:00:00\n1,,ED,ED,2149-01-01 00:00:00\n",
    "icu/chartevents": "subject_id,stay_id,charttime,itemid,valuenum,valueuom\n1,100,2150-01-01 13:00:00,220045,88,bpm\n1,100,2150-01-01 13:00:00,223761,98.6,°F\n1,100,2150-01-01 14:00:00,226512,900,kg\n1,100,2150-01-01 15:00:00,226512,80,kg\n1,100,2150-01-01 16:00:00,226512,81,kg\n1,100,2150-01-01 13:00:00,226707,70,Inch\n1,100,2150-01-01 13:00:00,220739,4,\n1,100,2150-01-01 13:00:00,223900,5,\n1,100,2150-01-01 13:00:00,223901,6,\n1,100,2150-01-01 13:00:00,220045,900,bpm\n1,100,,220045,70,bpm\n1,100,2150-01-01 13:30:00,220339,8,cmH2O\n1,100,2150-01-01 13:40:00,224700,32000000000,cmH2O\n1,100,2150-01-01 13:00:00,999,1,x\n1,100,2150-01-01 17:00:00,226531,200,lb\n",
    "hosp/labevents": "subject_id,hadm_id,charttime,itemid,valuenum,valueuom\n1,10,2149-12-26 12:00:00,50912,1.1,mg/dL\n1,10,2149-12-25 11:00:00,50912,1.2,mg/dL\n1,10,2150-01-02 00:00:00,50912,1.3,mg/dL\n1,10,2150-01-02 00:00:00,50912,,mg/dL\n2,20,2160-05-01 01:00:00,50820,7.4,units\n2,,2160-05-01 01:00:00,50912,1.4,mg/dL\n",
    "icu/outputevents": "subject_id,stay_id,charttime,itemid,value,valueuom\n2,200,2160-05-01 02:00:00,226559,150,ml\n2,200,2160-05-01 02:00:00,226000,150,ml\n",
    "icu/inputevents": "subject_id,stay_id,starttime,endtime,itemid,amount,amountuom,rate,rateuom\n1,100,2150-01-01 13:00:00,2150-01-01 15:00:00,221906,5,mg,0.1,mcg/kg/min\n1,100,2150-01-01 13:00:00,2150-01-01 14:00:00,225798,1,dose,,\n1,100,,2150-01-01 14:00:00,225798,1,dose,,\n1,100,2150-01-01 18:00:00,,777,2,mL,,\n",
    "icu/d_items": "itemid,label\n221906,Norepinephrine\n225798,Vancomycin\n",
    "icu/procedureevents": "subject_id,stay_id,starttime,endtime,itemid\n1,100,2150-01-01 13:00:00,2150-01-02 13:00:00,225792\n1,100,2150-01-01 13:00:00,2150-01-02 13:00:00,1\n1,100,,2150-01-02 13:00:00,225802\n",
    "hosp/diagnoses_icd": "subject_id,hadm_id,seq_num,icd_code,icd_version\n1,10,1,A419,10\n2,20,1,5849,9\n9,90,2,I10,10\n",
    "hosp/prescriptions": "subject_id,hadm_id,starttime,stoptime,drug,dose_val_rx,dose_unit_rx,route\n2,20,2160-05-01 00:00:00,2160-05-03 00:00:00,Heparin,5000,UNIT,SC\n2,20,2160-05-01 00:00:00,2160-05-03 00:00:00,Vancomycin,1-2,g,IV\n2,20,2160-05-01 06:00:00,,,x,,PO\n",
    "hosp/microbiologyevents": "subject_id,hadm_id,chartdate,charttime,spec_type_desc,org_name\n1,10,2150-01-02 00:00:00,,BLOOD,E. COLI\n1,10,2150-01-01 00:00:00,,URINE,\n1,10,2150-01-05 00:00:00,2150-01-05 03:00:00,SPUTUM,\n1,10,2150-01-04 00:00:00,2150-01-04 03:00:00,SPUTUM,\n",
}
DISCHARGE = 'subject_id,hadm_id,charttime,text\n1,10,2150-01-07 00:00:00,"Line one\nsaid ""well"", and so on"\n9,90,2150-01-07 00:00:00,other\n1,10,,untimed\n'


@pytest.fixture(scope="module")
def mimic_tables(spark, tmp_path_factory, concepts):
    mimic.WARD_STAYS, before = 2, mimic.WARD_STAYS
    root = tmp_path_factory.mktemp("m")
    write(root / "notes", {"note/discharge": DISCHARGE})
    tables = mimic.read(spark, write(root / "raw", MIMIC), concepts, str(root / "notes"))
    mimic.WARD_STAYS = before
    return tables


def test_mimic_stays(mimic_tables):
    check_tables(mimic_tables)
    a, b, c = mimic_tables["stays"].orderBy("stay_id").collect()
    assert (a.patient_id, a.subject_id, a.stay_id, a.age, a.sex, a.ethnicity, a.weight, round(a.height, 1), a.los_hours) == ("miiv_1", "1", "miiv_100", 62.0, "F", "WHITE", 80.0, 177.8, 48.0)
    assert (a.admit_time, a.mortality_in_icu, a.mortality_in_hospital, a.mortality_30day) == (day("2150-01-01 12:00"), True, True, True)
    assert (b.stay_id, b.weight, b.mortality_in_icu) == ("miiv_101", None, True)  # the last ward is one of the admission
    assert (c.stay_id, c.ethnicity, c.mortality_in_icu, c.mortality_in_hospital, c.mortality_30day) == ("miiv_200", None, False, False, False)


def test_mimic_events(mimic_tables):
    at = "2150-01-01 13:00:00"
    assert event_rows(mimic_tables["events_long"]) == sorted([
        ("miiv_100", at, "hr", 88.0, "bpm", "bpm"), ("miiv_100", at, "temp", 37.0, "°C", "°F"), ("miiv_100", at, "gcs", 15.0, "points", None), ("miiv_100", at, "height", 177.8, "cm", "in"),
        ("miiv_100", "2150-01-01 15:00:00", "weight", 80.0, "kg", "kg"), ("miiv_100", "2150-01-01 16:00:00", "weight", 81.0, "kg", "kg"), ("miiv_100", "2150-01-01 17:00:00", "weight", 90.72, "kg", "lb"),
        ("miiv_100", "2149-12-26 12:00:00", "crea", 1.1, "mg/dL", "mg/dL"), ("miiv_100", "2150-01-02 00:00:00", "crea", 1.3, "mg/dL", "mg/dL"), ("miiv_101", "2150-01-02 00:00:00", "crea", 1.3, "mg/dL", "mg/dL"),
        ("miiv_200", "2160-05-01 01:00:00", "ph", 7.4, "units", "units"), ("miiv_200", "2160-05-01 02:00:00", "urine", 150.0, "mL", "ml"),
    ])


def test_mimic_other_tables(spark, mimic_tables):
    got = sorted((r.stay_id, r.drug, r.dose, r.dose_unit, r.route, r.drug_class, r.endtime) for r in mimic_tables["meds"].collect())
    assert got == sorted([
        ("miiv_100", "norepinephrine", pytest.approx(0.1), "mcg/kg/min", "iv", "vasopressor", day("2150-01-01 15:00")), ("miiv_100", "vancomycin", 1.0, "dose", "iv", "antibiotic", day("2150-01-01 14:00")),
        ("miiv_100", "unknown", 2.0, "mL", "iv", "other", None), ("miiv_200", "heparin", 5000.0, "UNIT", "sc", "anticoagulant", day("2160-05-03 00:00")), ("miiv_200", "unknown", None, None, "po", "other", None),
    ], key=lambda r: (r[0], r[1]))
    assert sorted((r.stay_id, r.intervention) for r in mimic_tables["interventions"].collect()) == [("miiv_100", "mech_vent"), ("miiv_100", "vasopressor")]
    assert sorted((r.stay_id, r.note_type, r.text) for r in mimic_tables["notes"].where("stay_id is not null").collect()) == [("miiv_100", "discharge", 'Line one\nsaid "well", and so on'), ("miiv_101", "discharge", 'Line one\nsaid "well", and so on')]
    assert mimic_tables["notes"].count() == 3
    assert sorted(((r.stay_id or ""), r.icd_code, r.icd_version, r.diagnosis_position) for r in mimic_tables["diagnoses"].collect()) == [("", "I10", "10", 2), ("miiv_100", "A419", "10", 1), ("miiv_101", "A419", "10", 1), ("miiv_200", "5849", "9", 1)]
    assert sorted((r.stay_id, r.charttime, r.specimen_type, r.organism) for r in mimic_tables["microbio"].collect()) == [("miiv_100", day("2150-01-01 12:00"), "URINE", None), ("miiv_100", day("2150-01-02 12:00"), "BLOOD", "E. COLI"), ("miiv_101", day("2150-01-05 03:00"), "SPUTUM", None)]
    assert [tuple(r) for r in mimic_tables["abx_duration"].collect()] == [("miiv_100", day("2150-01-01 13:00"), day("2150-01-01 14:00"))]


def test_mimic_without_optional_files(spark, tmp_path, concepts):
    some = {k: (v if k in ("icu/icustays", "hosp/admissions", "hosp/patients") else v.split("\n")[0] + "\n") for k, v in MIMIC.items() if k not in mimic.OPTIONAL}
    tables = mimic.read(spark, write(tmp_path, some), concepts)
    check_tables(tables)
    assert tables["stays"].count() == 3 and all(tables[t].isEmpty() for t in SCHEMAS if t != "stays")


def test_mimic_pressure(spark, tmp_path):
    chart = read_csv_or_empty(spark, write(tmp_path, MIMIC) + "/icu/chartevents.csv.gz", mimic.CHARTED)
    assert [(r.patient_id, r.bound_stay_id, r.source_admission_id, r.start_time, r.dose, r.dose_unit, r.origin) for r in mimic.raw_treatments(chart).collect()] == [("miiv_1", None, "miiv_100", day("2150-01-01 13:30"), 8.0, "cmH2O", "peep_raw")]


def test_star_join_and_last_ward(spark):
    fact = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "k long, v string")
    once = spark.createDataFrame([(1, 5), (None, 7)], "k long, w int")
    assert sorted(tuple(r) for r in star_join(fact, (once, ["k"])).where("k is not null").collect()) == [(1, "x", 5), (2, "y", None)]
    with pytest.raises(Exception, match="more than one row"):
        star_join(fact, (once.unionByName(once), ["k"])).collect()
    chain = spark.createDataFrame([(1, "admit", "A", "2020-01-01"), (1, "transfer", "B", "2020-01-02"), (1, "discharge", None, "2020-01-02"), (2, "admit", "C", "2020-01-01")], "k long, eventtype string, careunit string, intime string")
    chain = chain.selectExpr("k", "eventtype", "careunit", "cast(intime as timestamp) as intime")
    assert [tuple(r) for r in last_wards(chain, ["k"]).collect()] == [(1, "B")]  # 2 has not been discharged


NWICU = {
    "icu/icustays": "subject_id,hadm_id,stay_id,intime,outtime,los\n1,10,100,2150-01-01 12:00:00,2150-01-03 12:00:00,2.0\n2,20,200,2160-05-01 00:00:00,2160-05-02 00:00:00,1.0\n3,30,300,2160-05-01 00:00:00,2160-05-02 00:00:00,1.0\n",
    "hosp/admissions": "subject_id,hadm_id,admittime,dischtime,deathtime,discharge_location,hospital_expire_flag,race\n1,10,2150-01-01 00:00:00,2150-01-07 00:00:00,2150-01-03 11:00:00,HOME,1,A\n2,20,2160-04-30 00:00:00,2160-05-09 00:00:00,2160-05-08 00:00:00,EXPIRED,0,B\n3,30,2160-04-30 00:00:00,,,HOME,0,C\n",
    "hosp/patients": "subject_id,gender,anchor_age,anchor_year,dod\n1,F,60,2148,2150-01-03\n2,M,50,2160,2160-05-30\n3,M,17,2160,\n",
    "icu/chartevents": "subject_id,stay_id,charttime,itemid,valuenum,valueuom\n1,100,2150-01-01 13:00:00,320045,88,bpm\n1,100,2150-01-01 14:00:00,320045,9999999,bpm\n1,100,2150-01-01 15:00:00,320045,400,bpm\n1,100,2150-01-01 13:00:00,323761,98.6,\n1,100,2150-01-01 13:00:00,326531,2822,oz\n",
    "hosp/labevents": "subject_id,hadm_id,charttime,itemid,valuenum,valueuom\n1,10,2150-01-02 00:00:00,100002,1.3,mg/dL\n1,10,2150-01-04 00:00:00,100002,1.4,mg/dL\n",
    "hosp/d_labitems": "itemid,label\n100085,CK\n100099,CKMB\n100029,PO2\n100057,T\n100059,T\n",
    "icu/procedureevents": "subject_id,stay_id,starttime,endtime,itemid\n1,100,2150-01-01 13:00:00,2150-01-02 13:00:00,704890\n",
    "hosp/emar": "subject_id,hadm_id,charttime,medication,event_txt\n1,10,2150-01-02 00:00:00,VANCOMYCIN 1 G IV,Confirmed\n1,10,2150-01-02 00:00:00,HEPARIN 5000,Not Given\n1,10,2150-01-02 01:00:00,,Applied\n1,10,2150-01-02 01:00:00,5% DEXTROSE,Applied\n",
    "hosp/prescriptions": "subject_id,hadm_id,starttime,stoptime,drug,route\n1,10,2150-01-02 00:00:00,2150-01-01 00:00:00,Zosyn 3.375 g,IV\n2,20,2160-05-01 00:00:00,2160-05-03 00:00:00,Heparin,SC\n",
    "hosp/diagnoses_icd": "subject_id,hadm_id,seq_num,icd_code,icd_version\n1,10,0,A419,10\n",
}


def test_nwicu(spark, tmp_path, concepts):
    tables = nwicu.read(spark, write(tmp_path, NWICU), concepts)
    check_tables(tables)
    a, b = tables["stays"].orderBy("stay_id").collect()
    assert (a.stay_id, a.age, round(a.weight, 1), a.mortality_in_icu, a.mortality_in_hospital, a.mortality_30day) == ("nwicu_100", 62.0, 80.0, True, True, True)
    assert (b.stay_id, b.mortality_in_icu, b.mortality_in_hospital, b.mortality_30day) == ("nwicu_200", False, True, True)
    at = "2150-01-01 13:00:00"
    assert event_rows(tables["events_long"]) == sorted([
        ("nwicu_100", at, "hr", 88.0, "bpm", "bpm"), ("nwicu_100", "2150-01-01 15:00:00", "hr", 300.0, "bpm", "bpm"), ("nwicu_100", at, "temp", 37.0, "°C", "°F"),
        ("nwicu_100", at, "weight", 80.0, "kg", "oz"), ("nwicu_100", "2150-01-02 00:00:00", "crea", 1.3, "mg/dL", "mg/dL"),
    ])
    assert sorted((r.stay_id, r.drug, r.drug_class, r.route, r.endtime) for r in tables["meds"].collect()) == [
        ("nwicu_100", "unknown", "other", None, None), ("nwicu_100", "vancomycin", "antibiotic", None, None), ("nwicu_100", "zosyn", "antibiotic", "iv", day("2150-01-01 00:00")), ("nwicu_200", "heparin", "anticoagulant", "sc", day("2160-05-03 00:00")),
    ]
    assert sorted((r.starttime, r.endtime) for r in tables["abx_duration"].collect() if r.endtime) == [(day("2150-01-02 00:00"), day("2150-01-02 00:01"))]
    assert tables["abx_duration"].where("endtime is null").count() == 1  # an order that ends before it starts
    assert [(r.intervention, r.stay_id) for r in tables["interventions"].collect()] == [("rrt", "nwicu_100")]
    assert [r.diagnosis_position for r in tables["diagnoses"].collect()] == [1]
    with pytest.raises(ValueError, match="missing from the source"):
        nwicu.require_locked(spark.createDataFrame([("100085",)], "itemid string"))


EICU = {
    "patient": "patientunitstayid,uniquepid,hospitalid,gender,age,ethnicity,admissionheight,admissionweight,unitdischargeoffset,unitdischargestatus,hospitaldischargestatus\n7,p1,73,Female,> 89,Asian,170,80,2880,Expired,Expired\n8,p1,73,,45,,20,500,60,Alive,Expired\n9,p2,73,Male,,,170,80,60,Alive,\n",
    "vitalPeriodic": "patientunitstayid,observationoffset,temperature,sao2,heartrate,respiration,systemicsystolic,systemicdiastolic,systemicmean\n7,5,,98,88,12,120,,\n8,10,37.5,,999,,,,\n",
    "vitalAperiodic": "patientunitstayid,observationoffset,noninvasivesystolic,noninvasivediastolic,noninvasivemean\n7,6,110,60,\n",
    "lab": "patientunitstayid,labresultoffset,labname,labresult,labmeasurenameinterface\n7,-10,creatinine,1.3,mg/dL\n7,20,CRP,2, MG/dl \n7,21,CRP,20,mg/L\n7,22,ionized calcium,1.2,mmol/L\n7,22,unknown,1,x\n7,23,pH,7.3,\n",
    "nurseCharting": "patientunitstayid,nursingchartoffset,nursingchartcelltypevallabel,nursingchartcelltypevalname,nursingchartvalue\n7,30,Glasgow coma score,GCS Total,14\n7,30,Glasgow coma score,Eyes,4\n7,31,Temperature,Temperature (F),98.6\n7,32,Temperature,Temperature (C),36.6\n7,33,Respiratory Rate,Respiratory Rate,18\n7,34,Temperature,Temperature (C),warm\n",
    "respiratoryCharting": "patientunitstayid,respchartoffset,respchartvaluelabel,respchartvalue\n7,40,FiO2,40%\n7,41,FiO2,0.5\n7,42,PEEP, 8 \n7,43,PEEP,400\n",
    "intakeOutput": "patientunitstayid,intakeoutputoffset,celllabel,cellvaluenumeric\n7,50,Urine,200\n7,51,Indwelling Catheter Output,100\n7,52,Urine,-5\n7,53,Oral,100\n",
    "infusionDrug": "patientunitstayid,infusionoffset,drugname,drugrate,patientweight\n7,60,Norepinephrine (mcg/min),8,\n7,90,Norepinephrine (mcg/kg/min),0.2,\n7,20000,Norepinephrine (mcg/min),5,50\n7,60,Vancomycin (ml/hr),100,\n8,60,Norepinephrine (mcg/min),8,\n7,60,,OFF,\n",
    "medication": "patientunitstayid,drugstartoffset,drugstopoffset,drugname,routeadmin\n7,100,50,PIPERACILLIN 3.375 G,IV\n7,100,500,Heparin 5000,SubQ\n7,100,200,Cefazolin,IV\n",
    "treatment": "patientunitstayid,treatmentoffset,treatmentstring\n7,10,pulmonary|ventilation|Mechanical Ventilation\n7,11,renal|dialysis|hemodialysis\n7,12,other\n7,13,pulmonary|CPAP\n",
    "diagnosis": "patientunitstayid,icd9code,diagnosispriority\n7,\"038.9, A41.9\",Primary\n7,\"A41.9, 038.9\",Major\n7,,Other\n7,5,Odd\n",
    "microLab": "patientunitstayid,culturetakenoffset,culturesite,organism\n7,15,Blood,none\n",
    "note": "patientunitstayid,noteoffset,notetype,notetext\n7,16,Nursing Note,\"a\nb\"\n7,17,Discharge summary,\n",
}


def minute(n):
    return dt.datetime(2014, 1, 1) + dt.timedelta(minutes=n)


@pytest.fixture(scope="module")
def eicu_tables(spark, tmp_path_factory, concepts):
    return eicu.read(spark, write(tmp_path_factory.mktemp("e"), EICU), concepts)


def test_eicu_stays_and_events(eicu_tables):
    check_tables(eicu_tables)
    a, b = eicu_tables["stays"].orderBy("stay_id").collect()
    assert (a.patient_id, a.stay_id, a.age, a.sex, a.weight, a.height, a.los_hours, a.mortality_in_icu, a.discharge_time) == ("eicu_p1", "eicu_7", 90.0, "F", 80.0, 170.0, 48.0, True, minute(2880))
    assert (b.stay_id, b.sex, b.weight, b.height, b.mortality_in_icu, b.mortality_in_hospital) == ("eicu_8", "U", None, None, False, True)
    want = [
        (7, 5, "o2sat", 98.0, "%", None), (7, 5, "hr", 88.0, "bpm", None), (7, 5, "resp", 12.0, "breaths/min", None), (7, 5, "sbp", 120.0, "mmHg", None), (8, 10, "temp", 37.5, "°C", None),
        (7, 6, "sbp", 110.0, "mmHg", None), (7, 6, "dbp", 60.0, "mmHg", None), (7, -10, "crea", 1.3, "mg/dL", "mg/dL"), (7, 20, "crp", 20.0, "mg/L", "mg/dL"), (7, 21, "crp", 20.0, "mg/L", "mg/dL"),
        (7, 22, "cai", 1.2, "mmol/L", "mg/dL"), (7, 30, "gcs", 14.0, "points", None), (7, 31, "temp", 37.0, "°C", None), (7, 32, "temp", 36.6, "°C", None), (7, 33, "resp", 18.0, "breaths/min", None),
        (7, 40, "fio2", 40.0, "%", None), (7, 41, "fio2", 50.0, "%", None), (7, 50, "urine", 200.0, "mL", None), (7, 51, "urine", 100.0, "mL", None),
    ]
    assert event_rows(eicu_tables["events_long"]) == sorted((f"eicu_{s}", str(minute(t)), *rest) for s, t, *rest in want)


def test_eicu_medications(eicu_tables):
    got = sorted((r.stay_id, r.drug, r.starttime, r.endtime, None if r.dose is None else round(r.dose, 3), r.dose_unit, r.drug_class) for r in eicu_tables["meds"].where("route = 'iv' and dose_unit is not null or drug = 'norepinephrine'").collect())
    assert got == [
        ("eicu_7", "norepinephrine", minute(60), minute(90), 0.1, "mcg/kg/min", "vasopressor"),  # by the stay's weight
        ("eicu_7", "norepinephrine", minute(90), minute(90 + 168 * 60), 0.2, "mcg/kg/min", "vasopressor"),  # the next start is too far
        ("eicu_7", "norepinephrine", minute(20000), minute(20060), 0.1, "mcg/kg/min", "vasopressor"),  # by the pump's weight
        ("eicu_8", "norepinephrine", minute(60), minute(120), None, None, "vasopressor"),
    ]
    orders = {(r.drug, r.endtime, r.route) for r in eicu_tables["meds"].where(f"starttime = '{minute(100)}'").collect()}
    assert orders == {("piperacillin", None, "iv"), ("heparin", minute(500), "subq"), ("cefazolin", minute(200), "iv")}
    assert {(r.starttime, r.endtime) for r in eicu_tables["abx_duration"].collect()} == {(minute(60), minute(61)), (minute(100), None), (minute(100), minute(200))}


def test_eicu_other_tables(spark, tmp_path, eicu_tables):
    assert sorted((r.starttime, r.intervention) for r in eicu_tables["interventions"].collect()) == [(minute(10), "mech_vent"), (minute(11), "rrt"), (minute(13), "niv")]
    assert sorted((r.icd_code, r.icd_version, r.diagnosis_position) for r in eicu_tables["diagnoses"].collect()) == [("038.9", "9", 1), ("5", "9", 99), ("A41.9", "10", 2)]
    assert [(r.stay_id, r.charttime, r.specimen_type, r.organism) for r in eicu_tables["microbio"].collect()] == [("eicu_7", minute(15), "Blood", "none")]
    assert sorted((r.note_type, r.text) for r in eicu_tables["notes"].collect()) == [("discharge", ""), ("nursing", "a\nb")]
    root = write(tmp_path, EICU)
    rows = eicu.raw_treatments(read_csv_or_empty(spark, f"{root}/respiratoryCharting.csv.gz", eicu.TABLES["respiratoryCharting"]), read_csv_or_empty(spark, f"{root}/patient.csv.gz", eicu.TABLES["patient"]))
    assert [(r.patient_id, r.bound_stay_id, r.start_time, r.dose) for r in rows.collect()] == [("eicu_p1", "eicu_7", minute(42), 8.0)]


ZIGONG = {
    "dtBaseline": "PATIENT_ID,INP_NO,SEX,Age,InfectionSite,ICU_discharge_time,DISCHARGE_DATE_TIME\n1,11,Male,130,lung,100,200\n1,12,male,45,NA,50,60\n2,21,Female,30,blood,NA,90\n3,31,F,20,,10,20\n4,31,F,20,,10,20\n",
    "dtTransfer": "INP_NO,TransferDept,StartTime\n11,Intensive care unit (ICU),10\n11,EICU,4\n11,Ward,0\n",
    "dtICD": "INP_NO,ICD_Code,Diagnosis_seq,Status_Discharge\n11,J32.000X001,1,Dead\n11,M8140/3,2,Dead\n11,x,3,\n12,a41,1,Alive\n",
    "dtLab": "INP_NO,Item,LabValue,Unit,LabTime\n11,Creatinine (enzymatic method) (CRE),?100,umol/L,20\n11,Neutrophil ratio (neu%),0.8,,21\n11,Neutrophil ratio (neu%),80,%,22\n11,PH (PH),7.4,,23\n11,Creatinine (enzymatic method) (CRE),100,umol/L,3\n11,Creatinine (enzymatic method) (CRE),100,umol/L,101\n11,Other,1,,20\n",
    "dtDrugs": "PATIENT_ID,DrugName,Drug_time\n1,Meropenem for injection,20\n1,Norepinephrine,60\n3,Insulin,5\n1,,30\n",
    "dtNursingChart": "INP_NO,ChartTime,temperature,heart_rate,Blood_pressure_high,Blood_pressure_low,blood_sugar,open_one's_eyes,motion,language,Breathing_pattern,Hemodialysis_tube,NURSING_DESC\n11,30,36.5,?90,120,60,5,4→spont,6→obeys,5→oriented,SIMV,left,\"line, one\nline \"\"two\"\"\"\n11,31,NA,,,,,4→spont,9→odd,5→oriented,,NA,x\n12,2,37,,,,,,,,,,\"y\nz\"\n",
}


def hour(n):
    return dt.datetime(2019, 1, 1) + dt.timedelta(hours=n)


def test_zigong(spark, tmp_path, concepts):
    root = write(tmp_path, ZIGONG, zipped=False)
    tables = zigong.read(spark, root, concepts)
    check_tables(tables)
    rows = {r.stay_id: r for r in tables["stays"].where("patient_id <> 'zigong_4'").collect()}
    assert set(rows) == {"zigong_11", "zigong_12", "zigong_31"}
    a = rows["zigong_11"]
    assert (a.patient_id, a.age, a.sex, a.admit_time, a.discharge_time, a.los_hours, a.mortality_in_icu, a.admission_diagnosis) == ("zigong_1", 120.0, "M", hour(4), hour(100), 96.0, True, "lung")
    assert zigong.read(spark, root, concepts, emergency=False)["stays"].where("stay_id = 'zigong_11'").first().admit_time == hour(10)
    want = [
        (11, 20, "crea", 1.13, "mg/dL", "umol/L"), (11, 21, "neut", 80.0, "%", None), (11, 22, "neut", 80.0, "%", "%"), (11, 23, "ph", 7.4, "unknown", None), (11, 30, "temp", 36.5, "°C", None),
        (11, 30, "hr", 90.0, "bpm", None), (11, 30, "sbp", 120.0, "mmHg", None), (11, 30, "dbp", 60.0, "mmHg", None), (11, 30, "glu", 90.08, "mg/dL", "mmol/L"), (11, 30, "map", 80.0, "mmHg", None),
        (11, 30, "gcs", 15.0, "points", None), (12, 2, "temp", 37.0, "°C", None),
    ]
    assert event_rows(tables["events_long"]) == sorted((f"zigong_{s}", str(hour(t)), *rest) for s, t, *rest in want)
    # a drug knows its patient alone: every stay that holds its hour has it
    assert sorted((r.stay_id, r.drug, r.drug_class, r.starttime) for r in tables["meds"].collect()) == [
        ("zigong_11", "Meropenem for injection", "antibiotic", hour(20)), ("zigong_11", "Norepinephrine", "vasopressor", hour(60)), ("zigong_12", "Meropenem for injection", "antibiotic", hour(20)), ("zigong_31", "Insulin", "insulin", hour(5)),
    ]
    assert [(r.stay_id, r.starttime) for r in tables["interventions"].collect()] == [("zigong_11", hour(30))]
    assert sorted((r.stay_id, r.icd_code, r.diagnosis_position) for r in tables["diagnoses"].collect()) == [("zigong_11", "J32", 1), ("zigong_12", "a41", 1)]
    assert tables["abx_duration"].count() == 2
    baseline, transfer = (read_csv_or_empty(spark, f"{root}/{n}.csv", zigong.TABLES[n]) for n in ("dtBaseline", "dtTransfer"))
    assert sorted(tuple(r) for r in zigong.crosswalk(baseline).collect()) == [("INP_NO", 4, 1, 2), ("PATIENT_ID", 4, 1, 2)]
    chart = zigong.read_chart(spark, f"{root}/dtNursingChart.csv")
    assert "NURSING_DESC" not in chart.columns
    assert [(r.patient_id, r.treatment, r.start_time, r.origin) for r in zigong.raw_treatments(chart, zigong.windows(baseline, transfer)).collect()] == [("zigong_1", "rrt", hour(30), "rrt_raw")]


def test_zigong_without_files(spark, tmp_path, concepts):
    tables = zigong.read(spark, str(tmp_path), concepts)
    check_tables(tables)
    assert all(t.isEmpty() for t in tables.values())
    (tmp_path / "dtNursingChart.csv").write_text('INP_NO,ChartTime,temperature\n1,2,3\n1,"2\n')
    assert zigong.read_chart(spark, str(tmp_path / "dtNursingChart.csv")).columns == ["INP_NO", "ChartTime", "temperature"]


OMIX = {
    "PtAdmiTable": ",patient_SN,Hospital_ID,Age_cut,Sex,StatusOnDischarge,Discharge_DateTime\n1,a,1,\"(60,70]\",Male,Dead,10\n2,a,2,\"(18,30]\",Female,Alive,5\n3,b,3,odd,Male,,8\n4,c,4,\"(0,18]\",Other,Alive,6\n5,c,4,\"(0,18]\",Other,Alive,6\n6,d,5,\"(60,70]\",Female,Alive,NA\n7,e,6,\"(40,50]\",Female,Alive,4\n",
    "HospitalTransfer": ",patient_SN,Hospital_ID,TransferTo_Dept_Eng,TransferIn_DateTime,TransferFrom_Dept_Eng,TransferOut_DateTime\n1,a,1,ICU,1.5,Ward,1.5\n2,a,1,Ward,3.5,ICU,3.5\n3,a,2,ICU,2,Ward,2\n4,e,6,Ward,3,Department of critical medicine,3\n",
    "Lab": ",patient_SN,Hospital_ID,Lab_itemName_Eng,Lab_results,Lab_DateTime,Unit_measure\n1,a,1,creatinine,100,2,umol/L\n2,a,1,creatinine,100,1,umol/L\n3,a,1,PH,7.4,3.5,\n4,b,3,creatinine,90,2,UMOL/L\n5,b,3,creatinine,x,3,umol/L\n",
    "VitalSign": ",patient_SN,Hospital_ID,VitalSign_DESC,VitalSign_value,VitalSign_DateTime,VitalSign_unit\n1,a,1,Heart Rate,80,2,bpm\n2,b,3,Pulse rate,82,4,\n",
    "NursingChart_VitalSign": ",patient_SN,Hospital_ID,NursingEvent_item,NursingEvent_val,Event_DateTime,NursingEvent_Unit\n1,a,1,心率,85,2.25,次/分\n2,a,1,呼吸机模式,SIMV,2.5,\n3,a,1,瞳孔,3,2.5,\n",
    "NursingChart_IO": ",patient_SN,Hospital_ID,NursingIO_item,NursingIO_val,Event_DateTime,NursingIO_Unit\n1,a,1,小便,200ml,2.5,ml\n",
    "Medication": ",patient_SN,Hospital_ID,Med_DESC_Eng,Med_startTime,Med_stopTime,SingleDose,Med_unit,Med_route_Eng\n1,a,1,Norepinephrine bitartrate,2,2.5,4,mg,IV\n2,a,1,Meiping injection,2,NA,1,g,IV\n3,a,1,Heparin,2,3,1,ml,For CRRT\n4,a,1,Heparin,0.5,3,1,ml,For CRRT\n",
    "MicrobiologyCulture": ",patient_SN,Hospital_ID,MicrobiologyCulture_sample_Eng,MicrobiologyCulture_DateTime\n1,a,1,blood,2\n",
    "Diagnosis": ",patient_SN,Hospital_ID,ICD10_code\n1,a,1,J18.900;A41.9;x\n2,a,1,I10\n",
}


def days(n):
    return dt.datetime(2012, 1, 1) + dt.timedelta(days=n)


@pytest.fixture
def charsets(spark):
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    yield
    spark.conf.unset("spark.sql.legacy.javaCharsets")


@pytest.mark.parametrize("encoding", ["utf-8", "GB18030"])
def test_omix(spark, tmp_path, concepts, charsets, encoding):
    root = write(tmp_path, OMIX, zipped=False, encoding=encoding)
    tables = omix.read(spark, root, concepts, encoding)
    events = event_rows(tables["events_long"])
    check_tables(tables)
    ventilated = [(r.stay_id, r.starttime, r.intervention) for r in tables["interventions"].collect()]
    where = {r.stay_id: (r._from, r._to) for r in omix.windows(omix.load(spark, root, encoding)).collect()}
    # both ends, an entry alone, an exit alone, neither: what was charted; a double key and one without a discharge are out
    assert where == {"omix_a__1": (1.5, 3.5), "omix_a__2": (2.0, 5.0), "omix_e__6": (0.0, 3.0), "omix_b__3": (2.0, 4.0)}
    a = tables["stays"].where("stay_id = 'omix_a__1'").first()
    assert (a.patient_id, a.subject_id, a.hospital_id, a.age, a.sex, a.admit_time, a.los_hours, a.mortality_in_icu) == ("omix_a", "a", "1", 65.0, "F", days(1.5), 48.0, True)
    assert {r.stay_id for r in tables["stays"].collect()} == {"omix_a__1", "omix_a__2", "omix_e__6"}  # b has no age
    assert events == sorted([
        ("omix_a__1", str(days(2)), "crea", 1.13, "mg/dL", "umol/L"), ("omix_a__1", str(days(3.5)), "ph", 7.4, "unknown", None), ("omix_b__3", str(days(2)), "crea", 1.02, "mg/dL", "UMOL/L"),
        ("omix_a__1", str(days(2)), "hr", 80.0, "bpm", "bpm"), ("omix_b__3", str(days(4)), "hr", 82.0, "bpm", None), ("omix_a__1", str(days(2.25)), "hr", 85.0, "bpm", "次/分"), ("omix_a__1", str(days(2.5)), "urine", 200.0, "mL", "ml"),
    ])
    assert ventilated == [("omix_a__1", days(2.5), "mech_vent")]
    assert sorted((r.drug, r.drug_class, r.endtime) for r in tables["meds"].collect()) == [("Heparin", "anticoagulant", days(3)), ("Meiping injection", "antibiotic", None), ("Norepinephrine bitartrate", "vasopressor", days(2.5))]
    assert [(r.stay_id, r.starttime) for r in tables["abx_duration"].collect()] == [("omix_a__1", days(2))]
    assert [(r.charttime, r.specimen_type, r.organism) for r in tables["microbio"].collect()] == [(days(2), "blood", None)]
    assert sorted((r.diagnosis_position, r.icd_code) for r in tables["diagnoses"].collect()) == [(1, "I10"), (2, "J18"), (3, "A41")]
    raw = omix.load(spark, root, encoding)
    assert [(r.bound_stay_id, r.start_time, r.end_time, r.origin) for r in omix.raw_treatments(raw["Medication"], omix.windows(raw)).collect()] == [("omix_a__1", days(2), days(3), "rrt_raw")]

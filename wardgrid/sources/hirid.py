"""Reader of a source with one stay per patient, observations by variable id and medications by pharmacy id.

Each function takes raw tables and returns a canonical one; read() loads the files. A stay ends at its last observation or
medication; one without either is left out. Weight and height are the first positive ones observed. The observations are
read by id, so the rest is filtered at the scan; only running counters of urine and the cells that are shares of the white
count are put in order, by stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardgrid.functions import clean
from wardgrid.operators import streams
from wardgrid.operators.derive import counter_to_amounts
from wardgrid.operators.timegrid import micros, nearest
from wardgrid.sources.tables import SCHEMAS, empty, read_csv, require_unique, schema_of

WEIGHT, HEIGHT = 10000400, 10000450
#: Variables of renal replacement (1 is yes) and of the setting of end-expiratory pressure.
DIALYSIS, PRESSURE = 10002508, 2600
#: Variable ids by concept.
VARIABLES = {
    "hr": [200], "sbp": [100], "dbp": [120], "map": [110, 610], "resp": [300, 310, 320], "o2sat": [4000, 8280, 20000800], "temp": [400, 410, 7100],
    "fio2": [2010], "weight": [10000400], "height": [10000450], "urine": [30005110], "urine_rate": [10020000], "alb": [24000605], "alp": [20002700],
    "alt": [20002600], "ast": [24000330], "be": [20001300], "bicar": [20004200], "bili": [20004300], "ca": [20005100], "cai": [24000522],
    "ck": [24000210], "ckmb": [24000220], "cl": [24000439, 24000521], "crea": [20000600, 24000572, 24000573], "crp": [20002200], "fgn": [24000536],
    "glu": [20005110, 24000523, 24000585, 24000400], "hgb": [24000548, 20000900], "bili_dir": [24000560], "methb": [24000549], "inr_pt": [24000567],
    "k": [20000500, 24000520, 24000833, 24000867], "lact": [24000524, 24000732, 24000485, 24000564], "lymph": [24000480], "mch": [24000160],
    "mchc": [24000170], "mcv": [24000150], "mg": [24000230], "na": [20000400, 24000519, 24000658, 24000835], "neut": [24000550], "bnd": [24000557],
    "pco2": [20001200], "ph": [20000300, 24000608, 24000741], "phos": [20002500], "plt": [20000110], "po2": [20000200], "ptt": [20004410],
    "tnt": [24000538, 24000806], "wbc": [20000700], "bun": [20004100],
}
#: Source unit and factor of variables that are not in canonical units.
FACTORS = {
    20000600: ("umol/L", 1.0 / 88.42), 24000572: ("umol/L", 1.0 / 88.42), 24000573: ("umol/L", 1.0 / 88.42), 20005110: ("mmol/L", 18.018),
    24000400: ("mmol/L", 18.018), 24000523: ("mmol/L", 18.018), 24000585: ("mmol/L", 18.018), 20004100: ("mmol/L", 2.801), 20004300: ("umol/L", 0.05848),
    24000560: ("umol/L", 0.05848), 20005100: ("mmol/L", 4.008), 24000230: ("mmol/L", 2.43), 20002500: ("mmol/L", 3.097), 24000605: ("g/L", 0.1),
    24000170: ("g/L", 0.1), 24000536: ("g/L", 100.0), 24000538: ("ng/L", 0.001), 24000806: ("ng/L", 0.001), 24000548: ("g/L", 0.1), 20000900: ("g/L", 0.1),
}
#: Variables that show mechanical ventilation.
VENTILATION = [3845, 320, 15001552]
#: Pharmacy ids by drug class.
DRUGS = {
    "analgesic": [1000684, 1000932, 1000659, 1000444, 1000862, 1000605, 1000858, 1000632, 1000716, 1000489, 1000490, 1000329, 1000809, 1000859],
    "antibiotic": [
        1000274, 1000812, 1000781, 1000549, 1000272, 1001193, 1001198, 1000507, 1000508, 1000825, 176, 1000894, 1000315, 1000893, 1001170, 1001168,
        1001169, 1001097, 1001098, 1001096, 1001095, 1000829, 1000320, 1000321, 1000322, 1000437, 1000352, 1000670, 1000302, 1000830, 163, 1000363,
        1000318, 1000317, 1001086, 1001084, 181, 300, 1000233, 1000284, 1000837, 1001068, 1001173, 186, 1000797, 351, 1000648, 1000838, 1000304,
        1000365, 1000408, 1000407, 405, 1000483, 1000518, 189, 331, 1000305, 1000234,
    ],
    "anticoagulant": [1000863, 1000864, 1000895, 1000865, 1001016, 1000373, 107, 1000476],
    "sedative": [
        246, 1000691, 1000491, 1001053, 1001050, 208, 1001052, 1000699, 1000700, 1001054, 251, 252, 1001051, 1000902, 1000692, 1000251, 1000741,
        1000621, 1001194, 1000400, 1000857, 1000843, 1000771, 1000418, 1000988, 1000239, 1000705, 245, 1000978, 1000977,
    ],
    "vasopressor": [71, 1000655, 1000750, 1000650, 1000649, 426, 1000658, 1000656, 1000462, 1000657, 113, 112],
}
#: Pharmacy ids of antibiotics for suspected infection.
ANTIBIOTICS = [
    163, 176, 181, 186, 189, 300, 326, 331, 351, 405, 1000234, 1000272, 1000273, 1000274, 1000284, 1000299, 1000300, 1000302, 1000304, 1000305,
    1000306, 1000315, 1000317, 1000318, 1000320, 1000321, 1000322, 1000335, 1000348, 1000352, 1000363, 1000365, 1000390, 1000407, 1000408, 1000424,
    1000425, 1000426, 1000437, 1000483, 1000507, 1000508, 1000518, 1000519, 1000549, 1000601, 1000648, 1000666, 1000670, 1000671, 1000760, 1000781,
    1000791, 1000797, 1000812, 1000825, 1000829, 1000830, 1000837, 1000838, 1000854, 1000855, 1000893, 1000894, 1001005, 1001068, 1001075, 1001079,
    1001084, 1001086, 1001095, 1001096, 1001097, 1001098, 1001168, 1001169, 1001170, 1001171, 1001173, 1001193, 1001198,
]
SHARES = ["neut", "lymph"]  # counted, and given as per cent of the white cells


def _id(name: str) -> Column:
    return F.concat(F.lit("hirid_"), F.col("patientid").cast("string")).alias(name)


def _by_id(c: Column, names: dict) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), c.cast("int"))


def stays(general: DataFrame, observations: DataFrame, pharma: DataFrame) -> DataFrame:
    """Canonical stays. More than one row of a patient is an error, as ids of stays are those of patients."""
    require_unique(general, "patientid")
    value = F.col("value").try_cast("double")
    first = lambda variable: F.min_by(F.when((F.col("variableid") == variable) & (value > 0), value), F.when((F.col("variableid") == variable) & (value > 0), F.struct(micros("datetime"), value)))
    seen = observations.groupBy("patientid").agg(F.max("datetime").alias("_seen"), first(WEIGHT).alias("_weight"), first(HEIGHT).alias("_height"))
    given = pharma.groupBy("patientid").agg(F.max("givenat").alias("_given"))
    met = general.select(F.col("patientid").cast("long").alias("patientid"), "admissiontime", "sex", "age", "discharge_status").join(seen, "patientid", "left").join(given, "patientid", "left")
    met = met.withColumn("_from", F.try_to_timestamp(F.col("admissiontime").cast("string"))).withColumn("_to", F.greatest("_seen", "_given")).where("_to is not null")
    named = {
        "patient_id": _id("patient_id"), "subject_id": F.col("patientid"), "stay_id": _id("stay_id"), "dataset": F.lit("hirid"), "age": F.col("age").try_cast("float"),
        "sex": F.col("sex"), "weight": F.col("_weight"), "height": F.col("_height"), "admit_time": F.col("_from"), "discharge_time": F.col("_to"),
        "los_hours": F.floor((micros("_to") - micros("_from")) / 1_000_000) / 3600.0, "mortality_in_icu": F.coalesce(F.col("discharge_status") == "dead", F.lit(False)),
    }
    return met.select(*[named.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema_of("stays")])


def events(observations: DataFrame, concepts: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """Canonical events of the wanted concepts (all if None). Urine is given as differences of its counter, neutrophils and
    lymphocytes as per cent of the nearest white count above 0; without one they are left out. concepts is (concept,
    canonical_unit, low, high); a concept without a unit there keeps none and is left out, as the unit is required."""
    asked = set(VARIABLES if wanted is None else wanted)
    read = asked | ({"wbc"} if asked & set(SHARES) else set())
    names = {i: concept for concept, ids in VARIABLES.items() if concept in read for i in ids}
    spark = observations.sparkSession
    if not names:
        return empty(spark, "events_long")
    factor = F.coalesce(_by_id(F.col("variableid"), {i: f for i, (_, f) in FACTORS.items()}), F.lit(1.0))
    source = _by_id(F.col("variableid"), {i: u for i, (u, _) in FACTORS.items()})
    known = observations.where(F.col("variableid").isin(*names)).select(
        _id("patient_id"), _id("stay_id"), F.col("datetime").cast("timestamp").alias("charttime"), _by_id(F.col("variableid"), names).alias("concept"),
        (F.col("value").try_cast("double") * factor).alias("value"), F.lit(None).cast("string").alias("unit"), source.alias("unit_source"),
    )
    out = known.where(~F.col("concept").isin("urine", *SHARES) & F.col("concept").isin(*asked))
    if "urine" in asked:
        out = out.unionByName(counter_to_amounts(known.where("concept = 'urine'")).withColumn("unit", F.lit("mL")))
    if asked & set(SHARES):
        white = known.where("concept = 'wbc' and value > 0").select("stay_id", "charttime", F.col("value").alias("white"))
        cells = known.where(F.col("concept").isin(*(asked & set(SHARES))))
        near = nearest(cells, white, "stay_id", "charttime", "white")
        out = out.unionByName(near.withColumn("value", 100.0 * F.col("value") / F.col("near_value")).withColumn("unit", F.lit("%")).drop("near_value", "near_t"))
    return clean.canonical_units(out, concepts).where("unit is not null and charttime is not null").withColumn("value", F.col("value").cast("float"))


def meds(pharma: DataFrame) -> DataFrame:
    """Canonical medications; they have a time of giving but no end."""
    kind = _by_id(F.col("pharmaid"), {i: kind for kind, ids in DRUGS.items() for i in ids})
    return pharma.select(
        _id("patient_id"), _id("stay_id"), F.col("givenat").cast("timestamp").alias("starttime"), F.lit(None).cast("timestamp").alias("endtime"),
        F.concat(F.lit("pharmaid_"), F.col("pharmaid").cast("string")).alias("drug"), F.col("givendose").try_cast("float").alias("dose"),
        F.col("doseunit").alias("dose_unit"), F.lower("route").alias("route"), F.coalesce(kind, F.lit("other")).alias("drug_class"),
    )


def interventions(observations: DataFrame) -> DataFrame:
    rows = observations.where(F.col("variableid").isin(VENTILATION) & F.col("value").isNotNull())
    return rows.select(_id("patient_id"), _id("stay_id"), F.col("datetime").cast("timestamp").alias("starttime"), F.lit(None).cast("timestamp").alias("endtime"), F.lit("mech_vent").alias("intervention"))


def abx_duration(pharma: DataFrame) -> DataFrame:
    """Antibiotics as points of one minute."""
    start = F.col("givenat").cast("timestamp")
    return pharma.where(F.col("pharmaid").isin(ANTIBIOTICS)).select(_id("stay_id"), start.alias("starttime"), (start + F.expr("interval 1 minute")).alias("endtime"))


def raw_treatments(observations: DataFrame, pharma: DataFrame) -> DataFrame:
    """Renal replacement, end-expiratory pressure and norepinephrine equivalents, as a stream of treatments. A pump's record says what
    was given since the one before it in its infusion; weight is the first positive one observed."""
    at = F.col("datetime").cast("timestamp")
    value = F.col("value").try_cast("double")
    signs = observations.where((F.col("variableid") == DIALYSIS) & (value == 1.0)).select(_id("patient_id"), _id("stay_id"), at.alias("starttime"), at.alias("endtime"))
    pressure = observations.where(F.col("variableid") == PRESSURE).select(_id("patient_id"), _id("stay_id"), at.alias("charttime"), "value")
    weighed = observations.where((F.col("variableid") == WEIGHT) & (value > 0)).groupBy(_id("stay_id")).agg(F.min_by(value, F.struct(micros("datetime"), value)).alias("weight"))
    name = F.concat(F.lit("pharmaid_"), F.col("pharmaid").cast("string"))
    pumps = pharma.select(
        _id("patient_id"), _id("stay_id"), F.col("infusionid").alias("infusion"), streams.pressor_name(name, "hirid").alias("drug"),
        F.col("givenat").cast("timestamp").alias("charttime"), F.col("givendose").try_cast("double").alias("given"), F.col("doseunit").alias("unit"),
    )
    out = streams.renal_replacement(signs, "hirid").unionByName(streams.end_expiratory_pressures(pressure, "hirid"))
    return out.unionByName(streams.infused_equivalents(pumps, weighed, "hirid"))


def read(spark: SparkSession, root: str, concepts: DataFrame) -> dict[str, DataFrame]:
    """All canonical tables of a folder with general_table.csv and the Parquet folders of the raw stage; those that the source lacks
    are empty."""
    observations = spark.read.parquet(f"{root}/raw_stage/observation_tables/parquet")
    pharma = spark.read.parquet(f"{root}/raw_stage/pharma_records/parquet")
    out = {
        "stays": stays(read_csv(spark, f"{root}/general_table.csv"), observations, pharma),
        "events_long": events(observations, concepts),
        "meds": meds(pharma),
        "interventions": interventions(observations),
        "abx_duration": abx_duration(pharma),
    }
    return {table: out[table] if table in out else empty(spark, table) for table in SCHEMAS}

"""Registered queries of rules for source values, timed streams, views, folds and checks, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardgrid.functions import clean, source_rules
from wardgrid.operators import align, blocks, derive, labels, metrics, prep, sofa, splits, streams, views
from wardgrid.operators import timegrid as tg
from wardgrid.plans.adapters import events, intervals, order_stays, r6, scored, stays, table
from wardgrid.sources.eicu import TREATMENTS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
DRUGS = ["Norepinephrine Bitartrate", "ZOSYN 3.375 g", "heparin (units/hr)", "Vancomycin-HCl", "5% dextrose", "Levaquin in NS (mcg/kg/min)"]
SAID = ["pulmonary|ventilation|CPAP", "renal|Hemodialysis", "mechanical ventilation|peep therapy", "none", "cardio|Vasopressin|dopamine"]
CODES = ["038.9, A41.9", "J32.000X001", "m8140/3", "A41.9;J18;x;B20.1", "i10"]
AGES = ["> 89", "45", "130", "x", "0.5"]


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def us(name: str) -> Column:
    return tg.micros(name).alias(f"{name}_us")


def _pick(key: str, values: list[str]) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), (F.col(key) % len(values)).cast("int"))


@query
def number_rules(s: SparkSession, d: str) -> DataFrame:
    """Marked numbers, numbers with a tail, ranges, and times from offsets in all units."""
    rows = table(s, d, "lineitem").withColumn("q", F.col("l_quantity").cast("int").cast("string"))
    anchor = F.timestamp_seconds(F.lit(1_356_998_400))
    marked, tailed = F.concat(F.lit(" ?>="), F.col("q"), F.lit(" %")), F.concat("q", F.lit(".5 ml of "), "q")
    times = [tg.micros(clean.offset_time(anchor, F.col("l_quantity") / 7, unit)).alias(f"{unit}_us") for unit in ("s", "min", "hour", "day")]
    kept = clean.within(F.col("l_quantity").cast("double"), 20.0, 30.0)
    return rows.select("l_orderkey", "l_linenumber", clean.number(marked).alias("number"), clean.leading_number(tailed).alias("leading"), kept.alias("kept"), *times)


@query
def name_rules(s: SparkSession, d: str) -> DataFrame:
    """Ids with and without their prefix, ages, sexes, kinds of notes, drugs, units and classes of parts' names."""
    id_ = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("miiv_"), F.col("p_partkey").cast("string"))).otherwise(F.col("p_partkey").cast("string"))
    drug, said = _pick("p_partkey", DRUGS), _pick("p_partkey", SAID)
    return table(s, d, "part").select(
        "p_partkey", clean.stay_key(id_, "mimic_iv").alias("stay_id"), clean.age(_pick("p_partkey", AGES)).alias("age"), source_rules.sex(_pick("p_partkey", ["Male", "Female", ""]), "omix").alias("sex"),
        clean.sex_male(_pick("p_partkey", ["m", " F", "x"])).cast("double").alias("male"), source_rules.note_type(F.concat(_pick("p_partkey", ["Nursing ", "DISCHARGE ", "Progress ", "other "]), "p_name")).alias("note_type"),
        clean.drug_token(drug).alias("token"), clean.unit_suffix(drug).alias("unit"), clean.first_class(drug, source_rules.DRUG_HINTS).alias("drug_class"),
        source_rules.is_antibiotic(drug, "nwicu").alias("antibiotic"), clean.first_regex(said, TREATMENTS).alias("intervention"), source_rules.two_part_key("omix", F.col("p_partkey"), F.col("p_brand")).alias("key"),
    )


@query
def code_rules(s: SparkSession, d: str) -> DataFrame:
    """First codes, versions, roots, lists, morphology, priorities and coma scores of coded texts."""
    code = _pick("p_partkey", CODES)
    coma = [F.concat(((F.col("p_partkey") + i) % 7).cast("string"), F.lit(" said so")) for i in range(3)]
    return table(s, d, "part").select(
        "p_partkey", clean.icd_first(code).alias("first"), clean.icd_version(code).alias("version"), clean.icd_root(code).alias("root"), source_rules.is_morphology(code).alias("morphology"),
        F.array_join(source_rules.icd_roots(code), ",").alias("roots"), F.array_join(source_rules.icd_roots(code, True), ",").alias("full"), source_rules.icd_priority(_pick("p_partkey", ["Primary", "Other", "odd", "Major"])).alias("priority"),
        clean.gcs_total(*coma).alias("gcs"), source_rules.exam_text(F.col("p_brand"), F.col("p_name"), F.when(F.col("p_size") > 9, F.lit("a\n b")), F.lit("c")).alias("text"), clean.stream_code(F.lit("vital"), F.col("p_brand")).alias("code"),
    )


@query
def timed_treatments(s: SparkSession, d: str) -> DataFrame:
    """Drugs, interventions and antibiotics as one stream of treatments."""
    iv = intervals(s, d).withColumn("patient_id", F.col("stay_id") % 100)
    kind = F.when(F.col("drug") == "purchase", "vasopressor").when(F.col("stay_id") % 2 == 0, "sedative").otherwise("other")
    drugs = streams.drug_treatments(iv.withColumn("drug_class", kind), "eicu")
    vents = streams.intervention_treatments(iv.withColumn("intervention", F.when(F.col("drug") == "signup", "niv").otherwise("ecmo")), "miiv")
    rows = drugs.unionByName(vents).unionByName(streams.antibiotic_treatments(iv.where("drug = 'signup'")))
    return rows.groupBy("patient_id", "bound_stay_id", "source_admission_id", "treatment", "origin").agg(F.count("*").alias("n"), F.min(tg.micros("start_time")).alias("first_us"), F.max(tg.micros("end_time")).alias("last_us"))


@query
def timed_diagnoses(s: SparkSession, d: str) -> DataFrame:
    """Codes known at the end of their admission, and codes known at its start."""
    o = table(s, d, "orders")
    codes = o.select(F.col("o_custkey").alias("subject_id"), F.col("o_orderkey").alias("hadm_id"), F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderpriority")).alias("icd_code"), (F.col("o_orderkey") % 2 + 9).alias("icd_version"))
    ends = o.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("hadm_id"), F.col("o_orderdate").alias("dischtime"))
    billed = streams.billing_diagnoses(codes, ends, "miiv")
    charted = o.select(F.col("o_custkey").cast("string").alias("patient_id"), F.col("o_orderkey").cast("string").alias("stay_id"), F.concat("o_orderpriority", F.lit(", x")).alias("icd9code"), (F.col("o_orderkey") % 5 - 2).alias("diagnosisoffset"))
    active = streams.active_diagnoses(charted, F.timestamp_seconds(F.lit(1_388_534_400)))
    return billed.unionByName(active).select("patient_id", "bound_stay_id", "source_admission_id", "code", "code_system", "origin", us("knowable_time"))


@query
def aligned_notes(s: SparkSession, d: str) -> DataFrame:
    """Orders as notes of a customer, seen from each order as a stay of thirty days."""
    o = table(s, d, "orders")
    stream = o.select(F.col("o_custkey").alias("patient_id"), F.lit(None).cast("bigint").alias("bound_stay_id"), F.col("o_orderkey").alias("source_admission_id"), F.when(F.col("o_orderstatus") == "F", "discharge_summary").otherwise("radiology").alias("note_type"), F.col("o_orderdate").cast("timestamp").alias("knowable_time"))
    st = order_stays(s, d).withColumn("outtime", F.col("intime") + F.expr("interval 30 days")).withColumn("hadm_id", F.col("stay_id"))
    return align.align_notes(stream, st).select("stay_id", "source_admission_id", "note_type", r6("delta_h_signed").alias("delta_h"), "within_window", "prior_visit_idx")


@query
def codes_view_coverage(s: SparkSession, d: str) -> DataFrame:
    """How much of the stays with a split the codes known at admission cover."""
    o = table(s, d, "orders")
    text = lambda c: F.concat(F.lit("miiv_"), F.col(c).cast("string"))
    at = F.col("o_orderdate").cast("timestamp")
    st = o.select(text("o_custkey").alias("patient_id"), text("o_orderkey").alias("stay_id"), at.alias("admit_time"), at.alias("discharge_time"))
    stream = o.select(text("o_custkey").alias("patient_id"), F.when(F.col("o_orderkey") % 3 == 0, text("o_orderkey")).alias("bound_stay_id"), text("o_orderkey").alias("source_admission_id"), F.col("o_orderpriority").alias("code"), F.lit("icd10").alias("code_system"), F.when(F.col("o_orderstatus") == "F", "billing").otherwise("active").alias("origin"), at.alias("knowable_time"))
    split = o.where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").cast("string").alias("stay_id"), F.lit("train").alias("split"))
    row = views.coverage_report(views.aligned_view(stream, st, split, "mimic_iv", "diagnoses"), split, "aki", "miiv", ["origin", "code"], depth="prior_visit_idx")
    told = lambda c: F.array_join(F.transform(F.map_entries(c), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ";")
    return row.select("task", "dataset", "n_cohort", "n_stays", r6("share").alias("share"), "n_rows", r6("mean_rows").alias("mean_rows"), r6("mean_depth").alias("mean_depth"), told("by_origin").alias("origins"), told("by_code").alias("codes"))


def _hours(s: SparkSession, d: str) -> DataFrame:
    return tg.build_dyn(stays(s, d), events(s, d), ["click", "view"], tg.los_horizon())


@query
def labelled_sequences(s: SparkSession, d: str) -> DataFrame:
    """Sequences whose hours with an even number have a label."""
    outc = labels.onset_labels(stays(s, d), events(s, d).where("concept = 'signup'").groupBy("stay_id").agg(F.min("charttime").alias("onset")))
    rows = views.pack_labelled(_hours(s, d), outc.where("hour % 2 = 0").select("stay_id", "hour", F.col("label_value").alias("label")), ["click", "view"], 169)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return rows.select("stay_id", F.size("vectors").alias("length"), total("labels").alias("labels"), total("mask").alias("known"), r6(F.aggregate("vectors", F.lit(0.0), lambda a, v: a + v[1])).alias("views"))


@query
def flat_rows(s: SparkSession, d: str) -> DataFrame:
    """The last values of each stay beside its death."""
    died = stays(s, d).select("stay_id", F.col("mortality_in_icu").cast("int").alias("label"))
    return views.flat_matrix(_hours(s, d), died, ["click", "view"]).select("stay_id", r6("click").alias("click"), r6("view").alias("view"), "label")


@query
def merged_block(s: SparkSession, d: str) -> DataFrame:
    """Hours with a block that only some stays have."""
    block = events(s, d).where("concept = 'purchase'").groupBy("stay_id").agg(F.max("value").alias("most"))
    out = blocks.merge_block(_hours(s, d).select("stay_id", "hour"), block, ["stay_id"], "bought")
    return out.select("stay_id", "hour", r6("most").alias("most"), "bought_present")


@query
def last_doses(s: SparkSession, d: str) -> DataFrame:
    """The last value of each concept in the first day of a stay."""
    met = events(s, d).join(stays(s, d).select("stay_id", "admit_time"), "stay_id")
    aligned = met.select("stay_id", F.col("concept").alias("treatment"), F.col("value").alias("dose"), align.hours_since("charttime", "admit_time").alias("delta_h"))
    return blocks.last_dose(aligned, 24.0).select("stay_id", "treatment", r6("dose").alias("dose"))


@query
def stay_bounds(s: SparkSession, d: str) -> DataFrame:
    """First and last times over two kinds of events."""
    e = events(s, d)
    return derive.time_bounds(e.where("concept = 'click'"), e.where("concept = 'error'")).select("stay_id", us("first"), us("last"))


@query
def serialised_lines(s: SparkSession, d: str) -> DataFrame:
    """Turns of conversations as charted rows, one text for each two turns."""
    rows = table(s, d, "conversations").select(F.col("conv_id").alias("stay_id"), F.floor(F.col("turn") / 2).alias("hour"), F.col("role").alias("label"), F.col("text").alias("value"))
    return streams.serialised_rows(rows.where("label is not null and value is not null"), "note").select("stay_id", "hour", "text", "note_type")


@query
def encoded_texts(s: SparkSession, d: str) -> DataFrame:
    """Turns of conversations, encoded by hashes of their words."""
    turns = table(s, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("note_id"), "text")
    out = blocks.encode_texts(turns).select("note_id", "n_tokens", F.posexplode("embedding").alias("pos", "x"))
    return out.select("note_id", "n_tokens", "pos", F.round(F.col("x").cast("double"), 3).alias("value"))


@query
def antibiotic_episodes(s: SparkSession, d: str) -> DataFrame:
    """Starts of treatment that goes on for three days, or until death forty hours after admission in every fifth stay."""
    end = F.timestamp_micros(tg.micros("charttime") + (F.floor(F.col("value") * 600) * 1_000_000).cast("long"))
    meds = events(s, d).select("stay_id", F.col("charttime").alias("starttime"), end.alias("endtime"), F.lit("antibiotic").alias("drug_class"))
    death = stays(s, d).where("stay_id % 5 = 0").select("stay_id", F.timestamp_micros(tg.micros("admit_time") + 40 * tg.HOUR).alias("death_time"))
    return labels.antibiotic_episodes(meds, death).select("stay_id", us("starttime"))


@query
def folds_by_label(s: SparkSession, d: str) -> DataFrame:
    """Two repeats of five folds of customers, even over their label."""
    st = order_stays(s, d)
    own = splits.patient_labels(st)
    return splits.stratified_folds(st.select("patient_id", "stay_id"), own, 5, 2).groupBy("rep", "fold").agg(F.count("*").alias("n"), F.sum(F.crc32(F.col("stay_id").cast("string")) % 1000).alias("check"))


@query
def stay_level_splits(s: SparkSession, d: str) -> DataFrame:
    """Splits of orders that do not look at customers: their sizes and who is where."""
    return splits.stay_manifest(order_stays(s, d))


@query
def exact_medians(s: SparkSession, d: str) -> DataFrame:
    found = prep.medians(table(s, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return s.createDataFrame([(name, value) for name, value in found.items()], "name string, median double").select("name", r6("median").alias("median"))


@query
def missing_weights(s: SparkSession, d: str) -> DataFrame:
    st = stays(s, d).select("stay_id", F.concat(F.lit("h"), F.col("hospital_id").cast("string")).alias("dataset"), F.when(F.col("stay_id") % 3 > 0, F.lit(80.0)).alias("weight"))
    return views.weight_deviations(st.where("dataset <> 'h0' or weight is not null"), "aki")


@query
def benchmark_outcomes(s: SparkSession, d: str) -> DataFrame:
    st = stays(s, d).withColumn("sex", F.when(F.col("stay_id") % 2 == 0, "F").otherwise("Male"))
    outc = labels.onset_labels(st, events(s, d).where("concept = 'signup'").groupBy("stay_id").agg(F.min("charttime").alias("onset")))
    sta, _, out = views.benchmark_layout(st.select("stay_id", "los_hours"), outc, outc, st)
    return out.join(sta, "stay_id").select("stay_id", "time", "label", "sex", r6("los_hours").alias("los_hours"))


@query
def run_grid(s: SparkSession, d: str) -> DataFrame:
    """Events as runs of models: means, deviations and scaled means of cells."""
    e = events(s, d)
    task = F.when(F.col("concept") == "click", "los").when(F.col("concept") == "view", "kidney_function").otherwise(F.col("concept"))
    runs = e.select(task.alias("task"), F.concat(F.lit("d"), (F.col("stay_id") % 2).cast("string")).alias("dataset"), F.concat(F.lit("m"), (F.col("stay_id") % 3).cast("string"), _pick("stay_id", ["", "__icd", "__abl_x", "-ft"])).alias("model"), (F.col("stay_id") % 5).alias("seed"), "value", F.lit("f").alias("fold_sha"))
    report = metrics.grid_report(runs)
    return report.select("task", "dataset", "model", *[r6(c).alias(c) for c in ("mean", "std", "scaled_mean", "scaled_std")], "n", "under_seeded", "n_fold_shas")


@query
def flat_run_grid(s: SparkSession, d: str) -> DataFrame:
    """The cells of run_grid that are compared, under their labels."""
    return metrics.flat_grid(run_grid(s, d)).select("task", "dataset", "label", "metric", r6("seed_mean").alias("seed_mean"), "n_seeds")


@query
def top_two_accuracy(s: SparkSession, d: str) -> DataFrame:
    rows = scored(s, d).select(F.col("y").cast("int").alias("y"), F.array(1 - F.col("score"), F.col("score"), F.lit(0.5)).alias("scores"))
    return metrics.top_k_accuracy(rows, 2).select("n", r6("accuracy").alias("accuracy"))


PRESSORS = ["Norepinephrine", "Dopamine HCl", "epinephrine", "Dobutamine"]
MEASURED = [{"click": "plt", "error": "bili", "view": "urine", "purchase": "po2", "signup": "fio2"}, {"click": "tgcs", "error": "crea", "view": "map", "purchase": "po2", "signup": "fio2"}]


def _pressors(s: SparkSession, d: str) -> DataFrame:
    """Purchases as one of four drugs with a rate, signups as open vasopressin without one."""
    dose = F.floor(tg.micros("starttime") / F.lit(1_000_000)) % 100 / 400.0
    bought = F.col("drug") == "purchase"
    return intervals(s, d).select("stay_id", "starttime", "endtime", F.when(bought, _pick("stay_id", PRESSORS)).otherwise("vasopressin").alias("drug"), F.lit("vasopressor").alias("drug_class"), dose.alias("dose"), F.when(bought, "mcg/kg/min").otherwise("mg").alias("dose_unit"))


@query
def pressor_rates_by_hour(s: SparkSession, d: str) -> DataFrame:
    """All rates of vasopressors in each hour, and which kind runs."""
    rates = ["dopamine", "norepinephrine", "epinephrine", "dobutamine_rate"]
    return sofa.pressors_by_hour(_pressors(s, d), stays(s, d), tg.los_horizon()).select("stay_id", "hour", *[r6(c).alias(c) for c in rates], "strong", "dobutamine")


@query
def sofa_inputs_whole(s: SparkSession, d: str) -> DataFrame:
    """Everything that the score takes, by stay and hour; what an event measures depends on the stay."""
    named = [F.element_at(F.create_map(*[F.lit(x) for pair in m.items() for x in pair]), F.col("concept")) for m in MEASURED]
    measured = events(s, d).withColumn("concept", F.when(F.col("stay_id") % 2 == 0, named[0]).otherwise(named[1]))
    vents = intervals(s, d).where("drug = 'purchase'").select("stay_id", "starttime", "endtime", F.lit("mech_vent").alias("intervention"))
    out = sofa.sofa_inputs(stays(s, d), measured, _pressors(s, d), vents, tg.los_horizon())
    return out.select(*[c if t in ("boolean", "int", "bigint") else r6(c).alias(c) for c, t in out.dtypes])


_EV = "ev as (select user_id as stay_id, ts as charttime, epoch_us(ts) as t, event_type as concept, value from events), st as (select stay_id, min(t) as a, max(t) as z, (max(t) - min(t)) / 3600000000.0 as los_hours, cast(floor(least((max(t) - min(t)) / 3600000000.0, 168)) as int) as mh from ev group by 1)"
_GRID = f"{_EV}, grid as (select stay_id, a, unnest(range(0, mh + 1))::int as hour from st)"
_DYN = f"{_GRID}, med as (select stay_id, cast(floor((t - a) / 3600000000.0) as int) as hour, median(value) filter (concept = 'click') as click, median(value) filter (concept = 'view') as view from ev join st using (stay_id) group by 1, 2), dyn as (select grid.stay_id, grid.hour, click, view from grid left join med using (stay_id, hour))"
_IV = f"{_EV}, iv as (select stay_id, t as s, case when concept = 'purchase' then t + cast(floor(value * 60) as bigint) * 1000000 end as e, concept as drug from ev where concept in ('purchase', 'signup'))"
_ONSET = f"{_GRID}, o as (select stay_id, min(t) as o from ev where concept = 'signup' group by 1), lab as (select grid.stay_id, grid.hour, coalesce((abs(grid.hour - floor((o - a) / 3600000000.0)) <= 6)::int, 0) as label from grid left join o using (stay_id))"
_ORD = "os as (select o_custkey as patient_id, o_orderkey as stay_id, epoch_us(o_orderdate) as t, o_orderstatus, o_orderpriority, (first_value(o_orderstatus) over (partition by o_custkey order by o_orderkey) = 'F')::int as label from orders)"


def _at(key: str, values: list[str]) -> str:
    told = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"([{told}])[({key} % {len(values)}) + 1]"


def _class(name: str, hints: list[tuple[str, str]], test: str) -> str:
    return "case " + " ".join(f"when {test.format(name=name, hint=h)} then '{k}'" for h, k in hints) + " {0} end"


_DRUG, _CODE, _SAID = _at("p_partkey", DRUGS), _at("p_partkey", CODES), _at("p_partkey", SAID)
_RATED = f"""{_IV}, grid as (select stay_id, a, unnest(range(0, mh + 1))::int as hour from st), md as (select stay_id, s, e, case when drug = 'purchase' then {_at("stay_id", ["norepi", "dopa", "epi", "dobu"])} else 'other' end as kind, case when drug = 'purchase' then (s // 1000000 % 100) / 400.0 end as rate from iv),
    run as (select g.stay_id, g.hour, kind, rate from grid g join md m on m.stay_id = g.stay_id and m.s < g.a + (g.hour + 1) * 3600000000::bigint and (m.e is null or m.e > g.a + g.hour * 3600000000::bigint)),
    pr as (select stay_id, hour, max(rate) filter (kind = 'dopa') as dopamine, max(rate) filter (kind = 'norepi') as norepinephrine, max(rate) filter (kind = 'epi') as epinephrine, max(rate) filter (kind = 'dobu') as dobutamine_rate, bool_or(kind <> 'dobu') as strong, bool_or(kind = 'dobu') as dobutamine from run group by 1, 2)"""


def _carried(concept: str) -> str:
    return f"(select arg_max(value, (t, value)) from me where me.stay_id = g.stay_id and c = '{concept}' and t < g.a + (g.hour + 1) * 3600000000::bigint)"


def _measured() -> str:
    told = ["case concept " + " ".join(f"when '{a}' then '{b}'" for a, b in m.items()) + " end" for m in MEASURED]
    return f"me as (select stay_id, t, value, case when stay_id % 2 = 0 then {told[0]} else {told[1]} end as c from ev)"


_GRIDRUN = """c as (select case event_type when 'click' then 'los' when 'view' then 'kidney_function' else event_type end as task, 'd' || user_id % 2 as dataset, 'm' || user_id % 3 || (['', '__icd', '__abl_x', '-ft'])[user_id % 4 + 1] as model, value from events),
    g as (select task, dataset, model, avg(value) as mean, coalesce(stddev_samp(value), 0) as std, count(*) as n, case task when 'los' then 168.0 when 'kidney_function' then 15.0 end as k from c group by 1, 2, 3)"""


def _round_robin(seed: str, key: str, who: str, k: int, by: str) -> str:
    return f"(row_number() over (partition by {by} order by md5('{seed}:' || {key}), {key}) - 1) % {k}"


ORACLE_SQL: dict[str, str] = {
    "number_rules": """select l_orderkey, l_linenumber, l_quantity::int::double as number, (l_quantity::int || '.5')::double as leading, case when l_quantity between 20 and 30 then l_quantity::double end as kept,
        1356998400000000 + round(l_quantity / 7)::bigint * 1000000 as s_us, 1356998400000000 + round(l_quantity / 7)::bigint * 60000000 as min_us, 1356998400000000 + round(l_quantity / 7 * 60)::bigint * 60000000 as hour_us, 1356998400000000 + round(l_quantity / 7 * 1440)::bigint * 60000000 as day_us from lineitem""",
    "name_rules": f"""select p_partkey, 'miiv_' || p_partkey as stay_id, ([90.0, 45.0, 120.0, null, 0.5])[(p_partkey % 5) + 1]::double as age, (['F', 'M', null])[(p_partkey % 3) + 1] as sex, ([1.0, 0.0, 0.5])[(p_partkey % 3) + 1]::double as male,
        case when lower((['Nursing ', 'DISCHARGE ', 'Progress ', 'other '])[(p_partkey % 4) + 1] || p_name) like '%discharge%' then 'discharge' when lower(p_name) like '%radiology%' then 'radiology' when p_partkey % 4 = 2 then 'progress' when p_partkey % 4 = 0 then 'nursing' else 'other' end as note_type,
        nullif(regexp_extract(lower(trim({_DRUG})), '^([a-z][a-z\\-]+)', 1), '') as token, nullif(regexp_extract({_DRUG}, '\\(([^)]+)\\)\\s*$', 1), '') as unit,
        {_class(f"lower({_DRUG})", source_rules.DRUG_HINTS, "contains({name}, '{hint}')").format("else 'other'")} as drug_class, regexp_matches(lower({_DRUG}), '{source_rules.ANTIBIOTIC_NAMES["nwicu"]}') as antibiotic,
        {_class(f"lower({_SAID})", TREATMENTS, "regexp_matches({name}, '{hint}')").format("")} as intervention, 'omix_' || p_partkey || '__' || p_brand as key from part""",
    "code_rules": f"""with p as (select *, {_CODE} as c, p_partkey % 7 as e, (p_partkey + 1) % 7 as m, (p_partkey + 2) % 7 as v from part)
        select p_partkey, nullif(trim(split_part(c, ',', 1)), '') as first, case when regexp_matches(c, '^[A-Za-z]') then '10' else '9' end as version, upper(substring(replace(c, '.', ''), 1, 3)) as root, regexp_matches(c, '^[A-Za-z][0-9]{{3,}}/') as morphology,
        array_to_string(list_filter(list_transform(string_split(c, ';'), lambda x: regexp_extract(x, '^([A-Z][0-9]{{2}})', 1)), lambda x: x <> ''), ',') as roots,
        array_to_string(list_filter(list_transform(string_split(c, ';'), lambda x: regexp_extract(x, '^([A-Z][0-9]{{2}}(\\.[0-9]+)?)', 1)), lambda x: x <> ''), ',') as full,
        ([1, 3, 99, 2])[(p_partkey % 4) + 1]::int as priority, case when e between 1 and 4 and m between 1 and 6 and v between 1 and 5 then (e + m + v)::double end as gcs,
        p_brand || ' | ' || p_name || ': ' || case when p_size > 9 then 'a b ' else '' end || 'c' as text, 'VITAL//' || p_brand as code from p""",
    "timed_treatments": f"""with {_IV}, r as (select (stay_id % 100)::varchar as patient_id, stay_id::varchar as bound_stay_id, stay_id::varchar as source_admission_id, case when drug = 'purchase' then 'vasopressor' else 'sedation' end as treatment, 'meds' as origin, s, e from iv where drug = 'purchase' or stay_id % 2 = 0
        union all select (stay_id % 100)::varchar, null, stay_id::varchar, 'niv', 'interventions', s, e from iv where drug = 'signup' union all select null, stay_id::varchar, stay_id::varchar, 'antibiotic', 'abx', s, e from iv where drug = 'signup')
        select patient_id, bound_stay_id, source_admission_id, treatment, origin, count(*) as n, min(s) as first_us, max(e) as last_us from r group by all""",
    "timed_diagnoses": """select 'miiv_' || o_custkey as patient_id, null as bound_stay_id, 'miiv_hadm_' || o_orderkey as source_admission_id, o_orderpriority as code, case when o_orderkey % 2 = 0 then 'icd9' else 'icd10' end as code_system, 'billing' as origin, epoch_us(o_orderdate) as knowable_time_us from orders where o_orderkey % 9 <> 0 and o_orderstatus <> 'P'
        union all select o_custkey::varchar, o_orderkey::varchar, o_orderkey::varchar, o_orderpriority, case when regexp_matches(o_orderpriority, '^[A-Z]') then 'icd10' else 'icd9' end, 'active', 1388534400000000 + (o_orderkey % 5 - 2) * 60000000 from orders where o_orderkey % 5 - 2 <= 0""",
    "aligned_notes": f"""with {_ORD}, m as (select s.stay_id, n.stay_id as source_admission_id, case when n.o_orderstatus = 'F' then 'discharge_summary' else 'radiology' end as note_type, n.t as k, s.t as a from os n join os s using (patient_id)),
        f as (select * from m where (k < a or (k >= a and k <= a + 2592000000000 and note_type <> 'discharge_summary')) and not (source_admission_id = stay_id and note_type = 'discharge_summary'))
        select stay_id, source_admission_id, note_type, round((k - a) / 3600000000.0, 6) as delta_h, k >= a as within_window, (dense_rank() over (partition by stay_id order by k) - 1)::int as prior_visit_idx from f""",
    "codes_view_coverage": f"""with {_ORD}, m as (select s.stay_id, n.stay_id as src, n.o_orderpriority as code, case when n.o_orderstatus = 'F' then 'billing' else 'active' end as origin, n.t as k, s.t as a from os n join os s on case when n.stay_id % 3 = 0 then n.stay_id = s.stay_id else n.patient_id = s.patient_id end),
        f as (select *, dense_rank() over (partition by stay_id order by k) as visits from m where k <= a), v as (select * from f where stay_id % 7 <> 0), per as (select stay_id, count(*) as n, max(visits) as d from v group by 1)
        select 'aki' as task, 'miiv' as dataset, (select count(*) from os where stay_id % 7 <> 0) as n_cohort, count(*) as n_stays, round(count(*) / (select count(*) from os where stay_id % 7 <> 0)::double, 6) as share, sum(n)::bigint as n_rows, round(avg(n), 6) as mean_rows, round(avg(d), 6) as mean_depth,
        (select string_agg(origin || '=' || n, ';' order by origin) from (select origin, count(*) as n from v group by 1)) as origins, (select string_agg(code || '=' || n, ';' order by code) from (select code, count(*) as n from v group by 1)) as codes from per""",
    "labelled_sequences": f"with {_ONSET}, med as (select stay_id, cast(floor((t - a) / 3600000000.0) as int) as hour, median(value) as v from ev join st using (stay_id) where concept = 'view' group by 1, 2) select lab.stay_id, 169 as length, sum(case when hour % 2 = 0 then label else -1 end)::double as labels, sum((hour % 2 = 0)::int)::double as known, round(sum(coalesce(v, 0)), 6) as views from lab left join med using (stay_id, hour) group by 1",
    "flat_rows": f"with {_DYN} select stay_id, round(arg_max(click, hour) filter (click is not null), 6) as click, round(arg_max(view, hour) filter (view is not null), 6) as view, (stay_id % 5 = 0)::int as label from dyn group by 1",
    "merged_block": f"with {_GRID}, b as (select stay_id, max(value) as most from ev where concept = 'purchase' group by 1) select grid.stay_id, hour, round(coalesce(most, 0), 6) as most, (most is not null)::int as bought_present from grid left join b using (stay_id)",
    "last_doses": f"with {_EV} select stay_id, concept as treatment, round(arg_max(value, (t, value)), 6) as dose from ev join st using (stay_id) where t - a <= 86400000000 and value is not null group by 1, 2",
    "stay_bounds": f"with {_EV} select stay_id, min(t) as first_us, max(t) as last_us from ev where concept in ('click', 'error') group by 1",
    "serialised_lines": """with l as (select conv_id as stay_id, turn // 2 as hour, role, text from conversations where role is not null and text is not null and length(text) > 0
        and not regexp_matches(role, 'Obtain Options|View Options|Copies|Print|Save Options|Performed - Structured') and text not in ('Obtain Options', 'View Options', 'Copies', 'Print', 'Save Options', 'Performed - Structured'))
        select stay_id, hour, string_agg(role || ': ' || text, '; ' order by role, text) as text, 'note' as note_type from l group by 1, 2""",
    "encoded_texts": """with w as (select conv_id || '-' || turn as note_id, row_number() over () as nr, list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '') as ws from conversations),
        p as (select unnest(range(0, 8)) as pos), x as (select nr, unnest(ws) as word from w), v as (select nr, pos, sum(('0x' || sha256(word)[2 * pos + 1 : 2 * pos + 2])::int / 127.5 - 1) as x from x, p group by 1, 2),
        n as (select nr, sqrt(sum(x * x)) as len from v group by 1)
        select note_id, len(ws)::bigint as n_tokens, p.pos::int as pos, round(coalesce(x / case when n.len = 0 then 1 else n.len end, 0)::float::double, 3) as value from w cross join p left join v on v.nr = w.nr and v.pos = p.pos left join n on n.nr = w.nr""",
    "antibiotic_episodes": f"""with {_EV}, x as (select stay_id, t as s, max(greatest(t, t + cast(floor(value * 600) as bigint) * 1000000)) as e, count(*) as n from ev group by 1, 2),
        p as (select a.stay_id, a.s as anchor, c.s, max(c.e) over (partition by a.stay_id, a.s order by c.s) as cum, lead(c.s) over (partition by a.stay_id, a.s order by c.s) as nxt from x a join x c on a.stay_id = c.stay_id and c.s between a.s and a.s + 259200000000),
        g as (select p.stay_id, anchor, max(coalesce(nxt, least(anchor + 259200000000, case when p.stay_id % 5 = 0 then a + 144000000000 end)) - cum) as gap from p join st using (stay_id) group by 1, 2)
        select g.stay_id, anchor as starttime_us from g join x on x.stay_id = g.stay_id and x.s = g.anchor, range(n) where gap <= 86400000000""",
    "folds_by_label": f"""with {_ORD}, who as (select patient_id, max(label) as label from os group by 1), r as (select unnest(range(0, 2))::int as rep),
        f as (select rep, patient_id, ((row_number() over (partition by rep, label order by md5('42:' || rep || ':' || patient_id), patient_id) - 1) % 5)::int as fold from who, r),
        step as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))) as tab),
        crc as (select stay_id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(stay_id::varchar, ''), lambda x: ascii(x)::bigint)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) as h from os, step)
        select rep, fold, count(*) as n, sum(h % 1000)::bigint as check from f join os using (patient_id) join crc using (stay_id) group by 1, 2""",
    "stay_level_splits": f"""with {_ORD}, o as (select stay_id, label, (row_number() over (partition by label order by md5('42:outer:' || stay_id), stay_id) - 1) % 5 as o from os),
        k as (select o.*, r.rep, (row_number() over (partition by r.rep, label order by md5('42:inner:' || stay_id), stay_id) - 1) % 5 as i from o, (select unnest(range(0, 5))::int as rep) r where o.o <> r.rep), f as (select unnest(range(0, 5))::int as fold),
        sp as (select stay_id, rep, fold, case when i = fold then 'val' else 'train' end as split from k, f union all select stay_id, o::int, fold, 'test' from o, f)
        select rep, fold, count(*) filter (split = 'train') as n_train, count(*) filter (split = 'val') as n_val, count(*) filter (split = 'test') as n_test, sum(('0x' || md5(stay_id || ':' || split)[1:15])::hugeint)::varchar as digest from sp group by 1, 2""",
    "exact_medians": "select 'l_quantity' as name, round(median(l_quantity::double), 6) as median from lineitem union all select 'l_extendedprice', round(median(l_extendedprice::double), 6) from lineitem union all select 'l_discount', round(median(l_discount::double), 6) from lineitem",
    "missing_weights": f"with {_EV}, s as (select 'h' || stay_id % 7 as dataset, stay_id % 3 = 0 as gone from st) select 'aki' as task, dataset, count(*) filter (gone) as n_missing, count(*) as n_stays, count(*) filter (gone) || '/' || count(*) || ' stays had no weight; 75 kg was used' as detail from s where dataset <> 'h0' or not gone group by 2 having count(*) filter (gone) > 0",
    "benchmark_outcomes": f"with {_ONSET} select lab.stay_id, hour as time, label = 1 as label, case when lab.stay_id % 2 = 0 then 'F' else 'Male' end as sex, round(los_hours, 6) as los_hours from lab join st using (stay_id)",
    "run_grid": f"with {_GRIDRUN} select task, dataset, model, round(mean, 6) as mean, round(std, 6) as std, round(mean / k, 6) as scaled_mean, round(std / k, 6) as scaled_std, n, n < (select max(n) from g) as under_seeded, 1::bigint as n_fold_shas from g",
    "flat_run_grid": f"with {_GRIDRUN} select task, dataset, replace(model, '__', '+') as label, 'MAE' as metric, round(mean, 6) as seed_mean, n as n_seeds from g where not contains(model, '-ft') and not contains(model, 'abl')",
    "top_two_accuracy": "with s as (select quality as y, round(least(n_chars / 4000.0, 1.0), 2) as p from labels join documents using (doc_id)), r as (select y, [1 - p, p, 0.5] as s from s) select count(*) as n, round(avg((len(list_filter(range(1, 4), lambda i: s[i] > s[y + 1] or (s[i] = s[y + 1] and i < y + 1))) < 2)::int), 6) as accuracy from r where y is not null",
    "pressor_rates_by_hour": f"with {_RATED} select stay_id, hour, round(dopamine, 6) as dopamine, round(norepinephrine, 6) as norepinephrine, round(epinephrine, 6) as epinephrine, round(dobutamine_rate, 6) as dobutamine_rate, strong, dobutamine from pr",
    "sofa_inputs_whole": f"""with {_RATED}, {_measured()}, c as (select g.stay_id, g.hour, g.a, {_carried("plt")} as platelets, {_carried("bili")} as bilirubin, {_carried("tgcs")} as gcs, {_carried("crea")} as creatinine, {_carried("map")} as mean_pressure, {_carried("po2")} as po2, {_carried("fio2")} as fio2,
        (select sum(value) from me where me.stay_id = g.stay_id and c = 'urine' and floor((t - g.a) / 3600000000.0) between greatest(g.hour - 23, 0) and g.hour) as urine24,
        exists (select 1 from iv where iv.stay_id = g.stay_id and drug = 'purchase' and s < g.a + (g.hour + 1) * 3600000000::bigint and e > g.a + g.hour * 3600000000::bigint) as ventilated from grid g)
        select c.stay_id, c.hour, round(platelets, 6) as platelets, round(bilirubin, 6) as bilirubin, round(gcs, 6) as gcs, round(creatinine, 6) as creatinine, round(mean_pressure, 6) as mean_pressure, round(case when fio2 > 0 then po2 / (fio2 / 100.0) end, 6) as pafi, ventilated, round(urine24, 6) as urine24,
        round(dopamine, 6) as dopamine, round(norepinephrine, 6) as norepinephrine, round(epinephrine, 6) as epinephrine, coalesce(strong, false) as strong, coalesce(dobutamine, false) or dobutamine_rate is not null as dobutamine from c left join pr using (stay_id, hour)""",
    "table_fingerprint": """with r as (select [coalesce(strlen(o_custkey::varchar) || ':' || o_custkey, '-1:'), coalesce(strlen(o_orderdate::date::varchar) || ':' || o_orderdate::date, '-1:'), coalesce(strlen(o_orderkey::varchar) || ':' || o_orderkey, '-1:'), coalesce(strlen(o_orderpriority) || ':' || o_orderpriority, '-1:'), coalesce(strlen(o_orderstatus) || ':' || o_orderstatus, '-1:'), coalesce(strlen(o_totalprice::decimal(18, 2)::varchar) || ':' || o_totalprice::decimal(18, 2), '-1:')] as c from orders)
        select count(*) as n_rows, coalesce(sum(('0x' || md5(array_to_string(c, ''))[1:15])::hugeint), 0)::varchar as digest from r""",
    "cohort_findings": f"""with {_DYN}, o as (select stay_id, min(t) as o from ev where concept = 'signup' group by 1), outc as (select g.stay_id, (coalesce(abs(g.hour - floor((o - a) / 3600000000.0)) <= 6, false))::int as v from grid g left join o using (stay_id) where g.stay_id % 10 <> 3),
        n as (select (select count(*) from st) as s, (select count(*) from dyn) as d, (select count(*) from outc) as k)
        select 'warning' as severity, 'all_null' as check, 'weight' as detail from n where s >= 10
        union all select 'warning', 'constant', 'los_hours' from n where s >= 10 and (select count(distinct los_hours) from st) = 1
        union all select 'warning', 'constant', 'flat' from n where d >= 500
        union all select 'warning', case when (select count(click) from dyn) = 0 then 'all_null' else 'constant' end, 'click' from n where d >= 500 and (select count(distinct click) from dyn) <= 1
        union all select 'warning', case when (select count(view) from dyn) = 0 then 'all_null' else 'constant' end, 'view' from n where d >= 500 and (select count(distinct view) from dyn) <= 1
        union all select 'error', 'label_empty', k::varchar from n where k = 0
        union all select 'error', 'label_constant', k::varchar from n where (select count(distinct v) from outc) = 1
        union all select 'error', 'label_no_positive', k::varchar from n where (select max(v) from outc) = 0
        union all select 'error', 'sta_not_outc', m::varchar from (select count(*) as m from st where stay_id not in (select stay_id from outc)) where m > 0
        union all select 'error', 'dyn_not_outc', m::varchar from (select count(distinct stay_id) as m from dyn where stay_id not in (select stay_id from outc)) where m > 0""",
}

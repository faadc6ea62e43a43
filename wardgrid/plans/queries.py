"""Registered queries of the library's own operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardgrid.functions import clean
from wardgrid.operators import align, blocks, checks, cohort, derive, labels, metrics, models, prep, sofa, splits, streams
from wardgrid.operators import timegrid as tg
from wardgrid.plans import fusion_queries, view_queries
from wardgrid.plans.adapters import CONCEPTS, codes, day_events, day_stays, events, intervals, order_stays, r6, scored, stays, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = fusion_queries.QUERIES | view_queries.QUERIES
HINTS = [("red", "warm"), ("ring", "round"), ("small", "little"), ("widget", "gadget")]
HOW = {"click": "sum", "error": "any", "purchase": "first", "signup": "last", "view": "mode"}
RANGES = [("click", "u1", 10.0, 40.0), ("error", "u2", 5.0, 60.0), ("view", None, None, 30.0)]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def us(name: str) -> object:
    return tg.micros(name).alias(f"{name}_us")


@query
def dyn_hourly_grid(s: SparkSession, d: str) -> DataFrame:
    out = tg.build_dyn(stays(s, d), events(s, d), CONCEPTS, tg.los_horizon())
    return out.select("stay_id", "hour", *[r6(c).alias(c) for c in CONCEPTS])


@query
def base_cohort_attrition(s: SparkSession, d: str) -> DataFrame:
    return cohort.attrition(cohort.gated(day_stays(s, d), day_events(s, d)))


@query
def base_cohort(s: SparkSession, d: str) -> DataFrame:
    return cohort.base_cohort(day_stays(s, d), day_events(s, d)).select("stay_id", r6("los_hours").alias("los_hours"), "age")


@query
def longest_gap(s: SparkSession, d: str) -> DataFrame:
    measured = events(s, d).join(stays(s, d).select("stay_id", "admit_time"), "stay_id").select("stay_id", tg.hour_index("charttime", "admit_time").alias("hour"))
    return tg.longest_gap(measured, stays(s, d), tg.los_cap())


@query
def rolling_min_onset(s: SparkSession, d: str) -> DataFrame:
    risen = events(s, d).where("concept = 'error'").withColumn("value", F.col("value") / 10)
    return labels.creatinine_onset(risen).select("stay_id", us("onset"))


@query
def rolling_sum_rate(s: SparkSession, d: str) -> DataFrame:
    return labels.urine_onset(events(s, d).withColumn("value", F.col("value") * 20), stays(s, d)).select("stay_id", us("onset"))


@query
def asof_carry_forward(s: SparkSession, d: str) -> DataFrame:
    grid = tg.hour_grid(stays(s, d), tg.los_horizon())
    return tg.carry_forward(grid, events(s, d).where("concept = 'click'"), stays(s, d)).select("stay_id", "hour", r6("carried").alias("carried"))


@query
def asof_nearest(s: SparkSession, d: str) -> DataFrame:
    e = events(s, d)
    return tg.nearest(e.where("concept = 'error'"), e.where("concept = 'click'").drop("concept"), "stay_id", "charttime", "value").select("stay_id", us("charttime"), r6("near_value").alias("near_value"), us("near_t"))


@query
def asof_vector(s: SparkSession, d: str) -> DataFrame:
    grid = tg.hour_grid(stays(s, d), tg.los_horizon())
    out = tg.carry_forward(grid, events(s, d).where("concept = 'purchase'"), stays(s, d)).where("carried is not null")
    return out.groupBy("hour").agg(F.count("*").alias("n"), r6(F.sum("carried")).alias("total"))


@query
def interval_hour_overlap(s: SparkSession, d: str) -> DataFrame:
    return tg.interval_hours(intervals(s, d), stays(s, d), tg.los_horizon()).groupBy("stay_id", "hour", "drug").agg(F.count("*").alias("n"))


@query
def null_end_consolidate(s: SparkSession, d: str) -> DataFrame:
    return tg.consolidate_open(intervals(s, d), ["stay_id", "drug"]).select("stay_id", "drug", us("starttime"), F.coalesce(tg.micros("endtime"), F.lit(0)).alias("endtime_us"))


@query
def occupancy_by_hour(s: SparkSession, d: str) -> DataFrame:
    at = intervals(s, d).join(stays(s, d).select("stay_id", "admit_time"), "stay_id").withColumn("delta_h", align.hours_since("starttime", "admit_time")).withColumn("end_delta_h", align.hours_since("endtime", "admit_time"))
    return tg.occupancy_hours(at).groupBy("stay_id", "hour").agg(F.count("*").alias("n"))


def _onsets(s: SparkSession, d: str) -> DataFrame:
    return events(s, d).where("concept = 'signup'").groupBy("stay_id").agg(F.min("charttime").alias("onset"))


@query
def onset_window_label(s: SparkSession, d: str) -> DataFrame:
    return labels.onset_labels(stays(s, d), _onsets(s, d))


@query
def onset_exclusions(s: SparkSession, d: str) -> DataFrame:
    kept = labels.hospitals_with_cases(stays(s, d), _onsets(s, d))
    kept = labels.exclude_early(kept, _onsets(s, d), 48.0)
    return labels.exclude_high_baseline(kept, events(s, d).where("concept = 'error'"), 40.0).select("stay_id")


@query
def remaining_los(s: SparkSession, d: str) -> DataFrame:
    return labels.remaining_los(stays(s, d)).select("stay_id", "hour", F.round(F.col("label_value").cast("double"), 3).alias("label_value"))


@query
def median_window_label(s: SparkSession, d: str) -> DataFrame:
    return labels.kidney_function(stays(s, d), events(s, d)).select("stay_id", r6("label_value").alias("label_value"))


@query
def mortality_label(s: SparkSession, d: str) -> DataFrame:
    return labels.mortality24(stays(s, d)).select("patient_id", "stay_id", us("label_time"), F.col("label_value").cast("int").alias("label_value"))


def _episodes(s: SparkSession, d: str) -> DataFrame:
    end = F.timestamp_micros(tg.micros("charttime") + (F.floor(F.col("value") * 600) * 1_000_000).cast("long"))
    return labels.continuous_episodes(events(s, d).select("stay_id", F.col("charttime").alias("starttime"), end.alias("endtime")))


@query
def continuous_episode(s: SparkSession, d: str) -> DataFrame:
    return _episodes(s, d).select("stay_id", us("starttime"))


def _suspected(s: SparkSession, d: str) -> DataFrame:
    e = events(s, d)
    return labels.suspected_infection(e.where("concept = 'click'").select("stay_id", F.col("charttime").alias("starttime")), e.where("concept = 'error'"))


@query
def suspected_pair(s: SparkSession, d: str) -> DataFrame:
    return _suspected(s, d).select("stay_id", us("si"))


@query
def delta_cummin(s: SparkSession, d: str) -> DataFrame:
    grid = tg.hour_grid(stays(s, d), tg.los_horizon())
    score = tg.carry_forward(grid, events(s, d).where("concept = 'view'"), stays(s, d)).select("stay_id", "hour", F.floor(F.coalesce("carried", F.lit(0.0)) / 10).cast("int").alias("sofa"))
    return labels.sepsis_onset(_suspected(s, d), score, stays(s, d)).select("stay_id", us("onset"))


@query
def sofa_like_score(s: SparkSession, d: str) -> DataFrame:
    dyn = tg.build_dyn(stays(s, d), events(s, d), CONCEPTS, tg.los_horizon())
    c = F.col
    inputs = dyn.select("stay_id", "hour", (c("click") * 5).alias("platelets"), (c("error") / 5).alias("bilirubin"), (c("view") / 5).alias("gcs"), (c("click") * 10).alias("pafi"), (c("error") > 20).alias("ventilated"), (c("purchase") / 10).alias("creatinine"), sofa.urine_of_day("signup").alias("urine24"), (c("view") * 3).alias("mean_pressure"), (c("purchase") / 4).alias("dopamine"), (c("signup") / 400).alias("norepinephrine"), F.lit(None).cast("double").alias("epinephrine"), (c("click") > 60).alias("strong"), (c("view") > 60).alias("dobutamine"))
    return sofa.sofa_per_hour(inputs)


@query
def unit_canonicalise(s: SparkSession, d: str) -> DataFrame:
    concepts = s.createDataFrame(RANGES, "concept string, canonical_unit string, low double, high double")
    out = clean.canonical_units(events(s, d).withColumn("unit", F.lit("raw")), concepts, sentinel=55.0)
    return out.groupBy("concept", "unit").agg(F.count("*").alias("n"), r6(F.sum("value")).alias("total"))


@query
def first_match_class(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select("p_partkey", clean.first_class(F.col("p_name"), HINTS).alias("kind"))


@query
def historical_agg(s: SparkSession, d: str) -> DataFrame:
    return prep.historical(events(s, d), HOW).select("stay_id", us("hour_start"), "concept", r6("value").alias("value"))


def _stream(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders")
    return o.select(F.col("o_custkey").alias("patient_id"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey")).alias("bound_stay_id"), F.col("o_orderkey").alias("source_admission_id"), F.col("o_orderpriority").alias("code"), F.lit("icd10").alias("code_system"), F.lit("billing").alias("origin"), F.col("o_orderdate").cast("timestamp").alias("knowable_time"))


@query
def dual_binding_align(s: SparkSession, d: str) -> DataFrame:
    return align.align_diagnoses(_stream(s, d), order_stays(s, d)).select("stay_id", "code", r6("delta_h").alias("delta_h"), "prior_visit_idx")


@query
def prior_visit_rank(s: SparkSession, d: str) -> DataFrame:
    stream = _stream(s, d).withColumnRenamed("knowable_time", "start_time").withColumn("knowable_time", F.col("start_time")).withColumn("end_time", F.lit(None).cast("timestamp"))
    return align.align_treatments(stream, order_stays(s, d)).groupBy("stay_id").agg(F.max("prior_visit_idx").alias("visits"), F.count("*").alias("n"))


@query
def note_clean_dedup(s: SparkSession, d: str) -> DataFrame:
    notes = table(s, d, "documents").select("doc_id", "source", "lang", clean.clean_note(F.col("text")).alias("text"))
    last = Window.partitionBy("source", "lang", F.md5("text")).orderBy(F.desc("doc_id"))
    return notes.withColumn("k", F.row_number().over(last)).where("k = 1").select("doc_id", "source", "lang", F.length("text").cast("long").alias("length"))


@query
def note_serialise(s: SparkSession, d: str) -> DataFrame:
    lines = table(s, d, "conversations").select("conv_id", "turn", F.concat("role", F.lit(": "), "text").alias("line"))
    return lines.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "; ").alias("text"))


@query
def note_visibility(s: SparkSession, d: str) -> DataFrame:
    notes = events(s, d).where("concept = 'error'").join(stays(s, d).select("stay_id", "admit_time"), "stay_id").select("stay_id", align.hours_since("charttime", "admit_time").alias("delta_h_signed"))
    return align.visible(tg.hour_grid(stays(s, d), tg.los_horizon()), notes).groupBy("stay_id", "hour").agg(F.count("*").alias("n"))


def _train(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("stay_id"))


@query
def topk_vocab(s: SparkSession, d: str) -> DataFrame:
    return blocks.vocabulary(codes(s, d), _train(s, d), 0.01, 10)


@query
def icd_multihot(s: SparkSession, d: str) -> DataFrame:
    return blocks.multihot(codes(s, d), ["Brand#1", "Brand#2", "Brand#3"]).select("stay_id", *[F.col(f"`Brand#{k}`").cast("int").alias(f"b{k}") for k in (1, 2, 3)])


@query
def icd_tfidf(s: SparkSession, d: str) -> DataFrame:
    return blocks.tfidf(codes(s, d), blocks.vocabulary(codes(s, d), _train(s, d))).select("stay_id", "code", "tf", r6("weight").alias("weight"))


@query
def vector_mean_pool(s: SparkSession, d: str) -> DataFrame:
    return blocks.mean_pool(table(s, d, "embeddings"), "label").select("label", "pos", r6("value").alias("value"))


@query
def recency_pool(s: SparkSession, d: str) -> DataFrame:
    return blocks.mean_pool(table(s, d, "embeddings"), "label", at="vec_id", half_life=50.0).select("label", "pos", r6("value").alias("value"))


@query
def running_recency_pool(s: SparkSession, d: str) -> DataFrame:
    out = blocks.running_pool(table(s, d, "embeddings").withColumn("k", F.col("vec_id") % 50), "k", "vec_id", 50.0)
    return out.select("k", F.col("at").cast("long").alias("upto"), F.posexplode("pooled").alias("pos", "value")).select("k", "upto", "pos", r6("value").alias("value"))


def _dyn(s: SparkSession, d: str) -> DataFrame:
    return tg.build_dyn(stays(s, d), events(s, d), ["click", "view"], tg.los_horizon())


def _dyn_train(s: SparkSession, d: str) -> DataFrame:
    return stays(s, d).where("stay_id % 4 <> 0").select("stay_id")


@query
def missing_mask(s: SparkSession, d: str) -> DataFrame:
    return prep.missing_mask(_dyn(s, d), ["click", "view"]).groupBy("hour").agg(F.sum("click_is_null").alias("click_nulls"), F.sum("view_is_null").alias("view_nulls"))


@query
def ffill_impute_minmax(s: SparkSession, d: str) -> DataFrame:
    out = prep.preprocess(_dyn(s, d), _dyn_train(s, d), ["click", "view"])
    return out.select("stay_id", "hour", r6("click").alias("click"), r6("view").alias("view"), "click_is_null")


@query
def history_features(s: SparkSession, d: str) -> DataFrame:
    out = prep.preprocess(_dyn(s, d), _dyn_train(s, d), ["click"], history=True)
    return out.select("stay_id", "hour", *[r6(f"click_{k}").alias(f"click_{k}") for k in ("max", "min", "mean")], "click_count")


@query
def standard_scale(s: SparkSession, d: str) -> DataFrame:
    stats = prep.train_stats(_dyn(s, d), _dyn_train(s, d), ["click"])
    out = prep.standard_scale(prep.impute(_dyn(s, d).select("stay_id", "hour", "click"), stats, ["click"]), stats, ["click"])
    return out.select("stay_id", "hour", r6("click").alias("click"))


@query
def last_rows(s: SparkSession, d: str) -> DataFrame:
    return prep.last_rows(_dyn(s, d), ["click", "view"]).select("stay_id", r6("click").alias("click"), r6("view").alias("view"))


@query
def sequence_pack(s: SparkSession, d: str) -> DataFrame:
    out = prep.pack_sequences(_dyn(s, d), ["click", "view"], 169)
    return out.select("stay_id", F.aggregate("mask", F.lit(0), lambda a, x: a + x).alias("length"), F.size("vectors").alias("padded"), r6(F.aggregate("vectors", F.lit(0.0), lambda a, v: a + v[0])).alias("total"))


@query
def class_weights(s: SparkSession, d: str) -> DataFrame:
    return prep.class_weights(scored(s, d).withColumnRenamed("y", "label")).groupBy("label").agg(F.count("*").alias("n"), r6(F.max("weight")).alias("weight"))


@query
def patient_splits(s: SparkSession, d: str) -> DataFrame:
    return splits.manifest(splits.nested_splits(order_stays(s, d)))


@query
def patient_split_check(s: SparkSession, d: str) -> DataFrame:
    st = order_stays(s, d)
    parts = splits.nested_splits(st)
    leaks = splits.leaking_patients(parts, st, (5, 5)).agg(F.count("*").alias("n_leaking"))
    return splits.unsplit_stays(parts, st, (5, 5)).join(F.broadcast(leaks))


@query
def cohort_findings(s: SparkSession, d: str) -> DataFrame:
    st = stays(s, d)
    outc = labels.onset_labels(st.where("stay_id % 10 <> 3"), _onsets(s, d))
    return checks.cohort_findings(st.select("stay_id", "patient_id", "los_hours", "weight"), _dyn(s, d).withColumn("flat", F.lit(1.0)), outc, ["click", "view", "flat"])


@query
def table_fingerprint(s: SparkSession, d: str) -> DataFrame:
    return checks.fingerprint(table(s, d, "orders").withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)")).withColumn("o_orderdate", F.col("o_orderdate").cast("date")))


@query
def auroc_rank(s: SparkSession, d: str) -> DataFrame:
    return metrics.auroc(scored(s, d)).select("n", "n_pos", r6("auroc").alias("auroc"))


@query
def average_precision(s: SparkSession, d: str) -> DataFrame:
    return metrics.average_precision(scored(s, d)).select("n_pos", r6("average_precision").alias("average_precision"))


@query
def calibration_bins(s: SparkSession, d: str) -> DataFrame:
    return metrics.calibration(scored(s, d)).select("bin", "n", r6("mean_score").alias("mean_score"), r6("share").alias("share"))


@query
def regression_metrics(s: SparkSession, d: str) -> DataFrame:
    return metrics.regression(scored(s, d)).select("n", *[r6(c).alias(c) for c in ("mae", "mse", "rmse", "r2")])


@query
def accuracy_metrics(s: SparkSession, d: str) -> DataFrame:
    return metrics.accuracy(scored(s, d)).select(*[r6(c).alias(c) for c in ("accuracy", "balanced_accuracy")])


@query
def js_divergence(s: SparkSession, d: str) -> DataFrame:
    side = lambda name: events(s, d).where(F.col("concept") == name).groupBy(F.floor("value").alias("key")).agg(F.count("*").cast("double").alias("w"))
    return metrics.js_divergence(side("click"), side("view")).select(r6("jsd").alias("jsd"))


@query
def grid_summary(s: SparkSession, d: str) -> DataFrame:
    runs = events(s, d).select("concept", (F.col("stay_id") % 3).alias("seed"), (F.col("stay_id") % 4).alias("cell"), "value")
    return metrics.grid_summary(runs, ["concept", "cell"], 4).select("concept", "cell", r6("mean").alias("mean"), r6("std").alias("std"), "n", "under_seeded")


@query
def baseline_logistic(s: SparkSession, d: str) -> DataFrame:
    rows = scored(s, d).select("doc_id", F.col("toxic").alias("label"), "score").withColumnRenamed("score", "x")
    fitted = models.fit_baseline(rows.where("doc_id % 5 <> 0"), ["x"], "logistic")
    return models.predict(fitted, rows.where("doc_id % 5 = 0")).select("doc_id", "y", "score")


@query
def attrition_report(s: SparkSession, d: str) -> DataFrame:
    return cohort.attrition_report(cohort.gated(day_stays(s, d), day_events(s, d)))


@query
def unit_convert(s: SparkSession, d: str) -> DataFrame:
    each = F.array(*[F.struct(F.lit(a).alias("source"), F.lit(b).alias("target"), clean.convert_unit(F.col("value"), a, b).alias("v")) for a, b in clean.CONVERSIONS])
    return events(s, d).select(F.explode(each).alias("x")).select("x.*").groupBy("source", "target").agg(F.count("*").alias("n"), F.round(F.sum("v"), 4).alias("total"))


def _meds(s: SparkSession, d: str) -> DataFrame:
    """Purchases as norepinephrine with a rate, signups as dobutamine without one."""
    dose = F.floor(tg.micros("starttime") / F.lit(1_000_000)) % 100 / 400.0
    bought = F.col("drug") == "purchase"
    return intervals(s, d).select("stay_id", "starttime", "endtime", F.when(bought, "Norepinephrine").otherwise("dobutamine").alias("drug"), F.lit("vasopressor").alias("drug_class"), dose.alias("dose"), F.when(bought, "mcg/kg/min").otherwise("mg").alias("dose_unit"))


def _renamed(s: SparkSession, d: str) -> DataFrame:
    of = {"click": "po2", "error": "fio2", "view": "urine"}
    return events(s, d).withColumn("concept", F.coalesce(*[F.when(F.col("concept") == a, b) for a, b in of.items()], F.col("concept")))


@query
def urine_by_hour(s: SparkSession, d: str) -> DataFrame:
    return sofa.urine_by_hour(_renamed(s, d), stays(s, d)).select("stay_id", "hour", r6("urine").alias("urine"))


@query
def pressors_by_hour(s: SparkSession, d: str) -> DataFrame:
    return sofa.pressors_by_hour(_meds(s, d), stays(s, d), tg.los_horizon()).select("stay_id", "hour", r6("norepinephrine").alias("norepinephrine"), "strong", "dobutamine")


@query
def sofa_inputs(s: SparkSession, d: str) -> DataFrame:
    vents = intervals(s, d).select("stay_id", "starttime", "endtime", F.lit("mech_vent").alias("intervention"))
    out = sofa.sofa_inputs(stays(s, d), _renamed(s, d), _meds(s, d), vents, tg.los_horizon())
    return out.select("stay_id", "hour", r6("pafi").alias("pafi"), r6("urine24").alias("urine24"), r6("norepinephrine").alias("norepinephrine"), "strong", "dobutamine")


@query
def antibiotic_span(s: SparkSession, d: str) -> DataFrame:
    meds = intervals(s, d).withColumn("drug_class", F.lit("antibiotic"))
    return labels.antibiotic_span(meds).select("stay_id", us("first"), r6("span_h").alias("span_h"), "long")


@query
def task_build(s: SparkSession, d: str) -> DataFrame:
    st = stays(s, d).select("*", F.lit(60.0).alias("age"), F.lit("Other").alias("sex"), F.lit(None).cast("float").alias("height"))
    outc = labels.kidney_function(st, events(s, d).where("concept = 'click'"))
    sta, dyn, outc = labels.build_task(st, outc, events(s, d), CONCEPTS, tg.los_horizon())
    per = dyn.groupBy("stay_id").agg(F.count("*").alias("n_hours"), r6(F.sum("click")).alias("click"))
    return sta.join(per, "stay_id").join(outc.select("stay_id"), "stay_id", "left_semi").select("stay_id", "n_hours", "click", F.col("sex_male").cast("double").alias("sex_male"), F.col("age").isNotNull().alias("ok"))


@query
def attach_rows_to_stays(s: SparkSession, d: str) -> DataFrame:
    spans = stays(s, d).select("patient_id", "stay_id", F.col("admit_time").alias("intime"), F.timestamp_micros(tg.micros("admit_time") + 100 * tg.HOUR).alias("outtime"))
    rows = events(s, d).select((F.col("stay_id") % 100).alias("patient_id"), "charttime", "value")
    return derive.attach_to_stays(rows, spans, ["patient_id"], 24).groupBy("stay_id").agg(F.count("*").alias("n"), r6(F.sum("value")).alias("total"))


@query
def single_key_rows(s: SparkSession, d: str) -> DataFrame:
    return derive.single_keys(table(s, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber"), ["l_orderkey", "l_suppkey"])


@query
def first_order_per_customer(s: SparkSession, d: str) -> DataFrame:
    return derive.one_per_key(table(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], ["o_orderkey"])


@query
def large_care_units(s: SparkSession, d: str) -> DataFrame:
    return derive.large_units(table(s, d, "supplier").select(F.col("s_nationkey").alias("careunit"), "s_suppkey"), 4)


@query
def unpivot_vitals(s: SparkSession, d: str) -> DataFrame:
    wide = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return derive.long_vitals(wide, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount"])


@query
def score_sum(s: SparkSession, d: str) -> DataFrame:
    e = events(s, d).withColumn("charttime", F.date_trunc("day", "charttime"))
    return derive.sum_parts(e, ["click", "view"], "score").groupBy("stay_id", "concept").agg(F.count("*").alias("n"), r6(F.sum("value")).alias("total"))


@query
def derived_mean_pressure(s: SparkSession, d: str) -> DataFrame:
    e = events(s, d).withColumn("charttime", F.date_trunc("day", "charttime"))
    return derive.mean_pressure(e, "click", "view").select("stay_id", us("charttime"), r6("value").alias("value"))


@query
def counter_differences(s: SparkSession, d: str) -> DataFrame:
    return derive.counter_to_amounts(events(s, d)).select("stay_id", "concept", us("charttime"), r6("value").alias("value"))


@query
def infusion_intervals(s: SparkSession, d: str) -> DataFrame:
    return derive.infusion_ends(intervals(s, d).select("stay_id", "drug", "starttime"), 48).select("stay_id", "drug", us("starttime"), us("endtime"))


@query
def code_groups(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "part").select("p_partkey", F.col("p_brand").alias("code"))
    groups = table(s, d, "part").where("p_size > 40").select(F.upper("p_brand").alias("code"), F.upper("p_brand").alias("group")).distinct()
    return derive.group_codes(rows, groups)


@query
def code_coverage(s: SparkSession, d: str) -> DataFrame:
    all_stays = table(s, d, "orders").select(F.col("o_orderkey").alias("stay_id"))
    return derive.coverage(codes(s, d), all_stays, "code").select("code", "n_rows", "n_stays", r6("share").alias("share"))


@query
def pressor_equivalents(s: SparkSession, d: str) -> DataFrame:
    """Line items as charted infusions of the orders."""
    pick = lambda c, xs: F.get(F.array(*[F.lit(x) for x in xs]), (F.col(c) % len(xs)).cast("int"))
    drug = pick("l_suppkey", ["Norepinephrin", "Dopamine ", "Vasopressin", "Phenylephrin", "Heparin"])
    unit = pick("l_linenumber", ["ug/kg/min", "mcg/min", "U/h", "mg"])
    meds = table(s, d, "lineitem").select(F.lit(None).cast("string").alias("patient_id"), F.col("l_orderkey").alias("stay_id"), F.col("l_shipdate").alias("starttime"), F.lit(None).cast("timestamp").alias("endtime"), drug.alias("drug"), unit.alias("dose_unit"), (F.col("l_quantity") / 10).alias("dose"))
    weights = table(s, d, "orders").select(F.col("o_orderkey").alias("stay_id"), F.when(F.col("o_orderkey") % 7 != 0, 50.0 + F.col("o_orderkey") % 50).alias("weight"))
    found = streams.norepinephrine_equivalents(meds, weights, "miiv")
    return found.groupBy(F.col("source_admission_id").alias("stay_id")).agg(F.count("*").alias("n"), F.round(F.max("dose").cast("double"), 4).alias("most"))

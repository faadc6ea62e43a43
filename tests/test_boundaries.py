"""Boundary rows of each operator, on literal frames."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wardgrid.functions import clean
from wardgrid.operators import align, checks, labels, metrics, prep, sofa, splits
from wardgrid.operators import timegrid as tg
from wardgrid.sources import tables

T0 = datetime(2024, 1, 1)
H, US = timedelta(hours=1), timedelta(microseconds=1)


def stays(spark, *los):
    return spark.createDataFrame([(i, T0, x) for i, x in enumerate(los)], "stay_id long, admit_time timestamp, los_hours double")


def test_hour_index_and_grid(spark):
    df = spark.createDataFrame([(T0, T0), (T0 + H, T0), (T0 + H - US, T0), (T0 - US, T0)], "t timestamp, a timestamp").select(tg.hour_index("t", "a").alias("h"))
    assert [r.h for r in df.collect()] == [0, 1, 0, -1]
    grid = tg.hour_grid(stays(spark, 2.0, 0.5, None, 500.0), tg.los_horizon()).groupBy("stay_id").count().collect()
    assert {r.stay_id: r["count"] for r in grid} == {0: 3, 1: 1, 3: 169}


def test_trailing_window_is_open_left(spark):
    df = spark.createDataFrame([(1, T0, 5.0), (1, T0 + 48 * H, 9.0), (1, T0 + 48 * H, 7.0), (1, T0 + 49 * H, None)], "stay_id int, charttime timestamp, value double")
    low = df.withColumn("low", F.min("value").over(tg.trailing(["stay_id"], "charttime", 48))).orderBy("charttime").collect()
    assert [r.low for r in low] == [5.0, 7.0, 7.0, 7.0]


def test_carry_forward(spark):
    ev = spark.createDataFrame([(0, T0 - H, 1.0), (0, T0 + H - US, 2.0), (0, T0 + H, 3.0), (0, T0 + H, 4.0), (0, T0 + 2 * H, None)], "stay_id long, charttime timestamp, value double")
    st = stays(spark, 3.0, 1.0)
    out = tg.carry_forward(tg.hour_grid(st, tg.los_horizon()), ev, st).collect()
    assert {(r.stay_id, r.hour): r.carried for r in out} == {(0, 0): 2.0, (0, 1): 4.0, (0, 2): 4.0, (0, 3): 4.0, (1, 0): None, (1, 1): None}


def test_nearest_ties_and_other_keys(spark):
    left = spark.createDataFrame([(1, T0), (2, T0)], "stay_id int, charttime timestamp")
    right = spark.createDataFrame([(1, T0 - H, 1.0), (1, T0 + H, 2.0), (3, T0, 9.0)], "stay_id int, charttime timestamp, value double")
    out = {r.stay_id: r.near_value for r in tg.nearest(left, right, "stay_id", "charttime", "value").collect()}
    assert out == {1: 1.0, 2: None}


@pytest.mark.parametrize("start,end,hours", [(0.5, None, [0, 1, 2, 3]), (1.0, 1.0, []), (1.25, 1.25, [1]), (1.5, 1.25, [1]), (2.5, 1.25, []), (-2.0, 0.5, [0]), (2.5, 99.0, [2, 3]), (1.0, 2.0, [1])])
def test_interval_hours(spark, start, end, hours):
    iv = spark.createDataFrame([(0, T0 + start * H, None if end is None else T0 + end * H)], "stay_id long, starttime timestamp, endtime timestamp")
    assert sorted(r.hour for r in tg.interval_hours(iv, stays(spark, 3.0), tg.los_horizon()).collect()) == hours


def test_occupancy(spark):
    rows = spark.createDataFrame([(1, 5.0, None), (2, 5.3, None), (3, 1.2, 3.0)], "stay_id int, delta_h double, end_delta_h double")
    got = sorted((r.stay_id, r.hour) for r in tg.occupancy_hours(rows).collect())
    assert got == [(1, 5), (3, 2), (3, 3)]


@pytest.mark.parametrize("rows,starts", [([(0, 72)], [0]), ([(0, 1), (25, 72)], [0]), ([(0, 1), (25.01, 72)], []), ([(0, 60), (72, 73)], [0]), ([(5, 2)], []), ([(0, 10), (0, 60)], [0])])
def test_episodes(spark, rows, starts):
    abx = spark.createDataFrame([(1, T0 + s * H, T0 + e * H) for s, e in rows], "stay_id int, starttime timestamp, endtime timestamp")
    got = sorted((r.starttime - T0) / H for r in labels.continuous_episodes(abx).collect())
    assert [round(x, 2) for x in got] == starts


def test_episode_death_cuts_window(spark):
    abx = spark.createDataFrame([(1, T0, T0 + 10 * H), (1, T0 + 40 * H, T0 + 41 * H)], "stay_id int, starttime timestamp, endtime timestamp")
    death = spark.createDataFrame([(1, T0 + 30 * H)], "stay_id int, death_time timestamp")
    assert [r.starttime for r in labels.continuous_episodes(abx, death).collect()] == [T0]


@pytest.mark.parametrize("apart,kept", [(timedelta(hours=-72), True), (timedelta(hours=24), True), (timedelta(hours=24) + US, False), (timedelta(hours=-72) - US, False)])
def test_suspected_pair(spark, apart, kept):
    ep = spark.createDataFrame([(1, T0)], "stay_id int, starttime timestamp")
    sample = spark.createDataFrame([(1, T0 + apart)], "stay_id int, charttime timestamp")
    assert (labels.suspected_infection(ep, sample).count() == 1) == kept


def test_sofa_components(spark):
    row = spark.range(1).select(
        sofa.coagulation(F.lit(None).cast("double")).alias("none"), sofa.coagulation(F.lit(50.0)).alias("coag"), sofa.liver(F.lit(1.2)).alias("liver"),
        sofa.respiration(F.lit(90.0), F.lit(False)).alias("resp"), sofa.respiration(F.lit(90.0), F.lit(True)).alias("vent"), sofa.renal(F.lit(1.0), F.lit(150.0)).alias("renal"),
        sofa.cardiovascular(F.lit(65.0), *[F.lit(None).cast("double")] * 3, F.lit(False), F.lit(True)).alias("dobu"),
    ).first()
    assert tuple(row) == (0, 2, 1, 2, 4, 4, 2)


def test_kidney_window(spark):
    st = stays(spark, 48.0, 47.9)
    ev = spark.createDataFrame([(0, T0 + 24 * H, 99.0), (0, T0 + 48 * H, 1.0), (0, T0 + 30 * H, 4.0), (1, T0 + 30 * H, 4.0)], "stay_id long, charttime timestamp, value double")
    assert [(r.stay_id, r.label_value) for r in labels.kidney_function(st, ev).collect()] == [(0, 2.5)]


def test_clean(spark):
    df = spark.createDataFrame([("?>12.5", "norepinephrine 4 mg", " > 89", "4 spont"), ("97 %", None, "abc", "9")], "n string, drug string, age string, e string")
    hints = [("norepinephrine", "nor"), ("epinephrine", "epi")]
    out = df.select(clean.number(F.col("n")).alias("n"), clean.first_class(F.col("drug"), hints).alias("k"), clean.age(F.col("age")).alias("a"), clean.gcs_total(F.col("e"), F.lit("6"), F.lit("5")).alias("g")).collect()
    assert [tuple(r) for r in out] == [(12.5, "nor", 90.0, 15.0), (97.0, "other", None, None)]
    with pytest.raises(KeyError):
        clean.convert_unit(F.lit(1.0), "x", "y")


def test_units(spark):
    dim = spark.createDataFrame([("a", "u", 1.0, 5.0)], "concept string, canonical_unit string, low double, high double")
    ev = spark.createDataFrame([("a", None, 1.0), ("a", "z", 5.0), ("a", "z", 5.1), ("a", "z", 1e6), ("b", "z", 7.0)], "concept string, unit string, value double")
    got = sorted((r.concept, r.unit, r.value) for r in clean.canonical_units(ev, dim, sentinel=1e6).collect())
    assert got == [("a", "u", 1.0), ("a", "u", 5.0), ("b", "z", 7.0)]
    assert sorted(r.value for r in clean.canonical_units(ev, dim, clip=True, sentinel=1e6).collect()) == [1.0, 5.0, 5.0, 7.0]


def test_alignment(spark):
    st = spark.createDataFrame([(1, 10, 100, T0, T0 + 5 * H), (2, 10, 200, T0 + 9 * H, T0 + 20 * H)], "stay_id int, patient_id int, hadm_id int, intime timestamp, outtime timestamp")
    dx = spark.createDataFrame([(10, None, 7, "a", "icd", "b", T0), (None, 1, 8, "c", "icd", "b", T0 + H)], "patient_id int, bound_stay_id int, source_admission_id int, code string, code_system string, origin string, knowable_time timestamp")
    assert sorted((r.stay_id, r.code) for r in align.align_diagnoses(dx, st).collect()) == [(1, "a"), (2, "a")]
    notes = spark.createDataFrame([(10, None, 100, "discharge_summary", T0 - H), (10, None, None, "radiology", T0 + 2 * H)], "patient_id int, bound_stay_id int, source_admission_id int, note_type string, knowable_time timestamp")
    got = sorted((r.stay_id, r.note_type) for r in align.align_notes(notes, st).collect())
    assert got == [(1, "radiology"), (2, "discharge_summary"), (2, "radiology")]


def test_fit_is_train_only(spark):
    rows = spark.createDataFrame([(1, 0, 1.0, 5.0, None), (1, 1, 3.0, 5.0, None), (2, 0, 9.0, 5.0, 4.0)], "stay_id int, hour int, a double, b double, c double")
    train = rows.where("stay_id = 1").select("stay_id")
    stats = prep.train_stats(rows, train, ["a", "b", "c"])
    out = {(r.stay_id, r.hour): (r.a, r.b, r.c) for r in prep.minmax_scale(rows, stats, ["a", "b"]).collect()}
    assert out == {(1, 0): (0.0, 0.0, None), (1, 1): (1.0, 0.0, None), (2, 0): (4.0, 0.0, 4.0)}
    assert stats.first()["c_mean"] is None


def test_auroc_edges(spark):
    of = lambda *r: metrics.auroc(spark.createDataFrame(list(r), "y int, score double")).first().auroc
    assert of((1, 0.5), (0, 0.5)) == 0.5
    assert of((1, 0.9), (0, 0.1)) == 1.0
    assert of((1, 0.9), (1, 0.1)) is None


def test_splits_hold_invariants(spark):
    st = spark.createDataFrame([(p, 10 * p + k, (p + k) % 2) for p in range(30) for k in range(p % 3 + 1)], "patient_id long, stay_id long, label int")
    parts = splits.nested_splits(st)
    assert splits.leaking_patients(parts, st).isEmpty()
    assert {(r.n_missing, r.n_foreign) for r in splits.unsplit_stays(parts, st).collect()} == {(0, 0)}
    with pytest.raises(ValueError):
        splits.nested_splits(st, outer=1)


def test_splits_are_spread_behind_their_joins(spark):
    st = spark.createDataFrame([(p, 10 * p, p % 2) for p in range(30)], "patient_id long, stay_id long, label int")
    for rows in (splits.nested_splits(st), splits.stay_splits(st)):
        plan = rows._jdf.queryExecution().executedPlan().toString().split("Generate")
        assert len(plan) == 2 and "Exchange" not in plan[0]  # what is above the only one in the tree


def test_leaks_and_gaps_are_found_at_their_fold(spark):
    st = spark.createDataFrame([(1, 10), (1, 11), (2, 20), (3, 30)], "patient_id long, stay_id long")
    held = {70: [(10, "train"), (11, "test"), (20, "val"), (99, "val")], 3: [(10, "val"), (11, "val"), (20, "test"), (30, "train")]}
    rows = [(cell // 10, cell % 10, stay, split) for cell, found in held.items() for stay, split in found]
    parts = spark.createDataFrame(rows, "rep int, fold int, stay_id long, split string")
    for shape in (None, (8, 10)):  # 80 folds are more than one word has bits
        assert [tuple(r) for r in splits.leaking_patients(parts, st, shape).collect()] == [(7, 0, 1)]
        assert sorted(tuple(r) for r in splits.unsplit_stays(parts, st, shape).collect()) == [(0, 3, 0, 0), (7, 0, 1, 1)]
    with pytest.raises(Exception, match="unknown rep, fold or split"):
        splits.leaking_patients(parts, st, (2, 5)).collect()


def test_findings_and_fingerprint(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 1.0), (2, 1.0)], "stay_id int, x double")
    assert [r.check for r in checks.key_findings(a, ["stay_id"], "sta").collect()] == ["duplicate_sta"]
    assert [r.check for r in checks.column_findings(a, ["x"], 2).collect()] == ["constant"]
    assert checks.fingerprint(a).first() == checks.fingerprint(a.orderBy(F.desc("stay_id"))).first()


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,v\n1,NA\n2,"3"\n')
    assert [tuple(r) for r in tables.read_csv(spark, str(tmp_path / "a.csv")).collect()] == [("1", None), ("2", "3")]
    row = spark.createDataFrame([("s", T0, None)], "stay_id string, starttime timestamp, endtime timestamp")
    tables.write_canonical(row, "abx_duration", str(tmp_path / "w"))
    assert spark.read.parquet(str(tmp_path / "w")).count() == 1
    with pytest.raises(ValueError):
        tables.validate(row.drop("endtime"), "abx_duration")
    tables.append_new(row, str(tmp_path / "n"), "stay_id")
    tables.append_new(row, str(tmp_path / "n"), "stay_id")
    assert spark.read.parquet(str(tmp_path / "n")).count() == 1


def test_gap_ends_at_the_whole_hours_of_a_stay(spark):
    """24 h, measured in hours 0 to 11: the gap is 12, not 13, and the stay is kept."""
    from wardgrid.operators import cohort

    st = spark.createDataFrame([(1, T0, T0 + 24 * H, 24.0, 50.0), (2, T0, T0 + 24 * H, 24.0, 50.0)], "stay_id int, admit_time timestamp, discharge_time timestamp, los_hours double, age double")
    ev = spark.createDataFrame([(1, T0 + h * H, "hr", 1.0) for h in range(12)] + [(2, T0 + h * H, "zzz", None) for h in range(24)], "stay_id int, charttime timestamp, concept string, value double")
    hours = ev.select("stay_id", tg.hour_index("charttime", F.lit(T0)).alias("hour"))
    assert {r.stay_id: (r.n_hours, r.gap) for r in tg.longest_gap(hours.where("stay_id = 1"), st.where("stay_id = 1"), tg.los_cap()).collect()} == {1: (12, 12)}
    tagged = {r.stay_id: r.failed_at for r in cohort.gated(st, ev, concepts=["hr"]).collect()}
    assert tagged == {1: None, 2: 2}
    report = {r.criterion: (r.n_before, r.n_after, r.pct_dropped) for r in cohort.attrition_report(cohort.gated(st, ev)).collect()}
    assert report["measured_hours"] == (2, 1, 50.0) and report["final"] == (2, 1, 50.0)


def test_urine_arm_sums_rates(spark):
    """60 ml every 2 h at 70 kg is 30 ml/h; three such rates in 6 h make 90 / 70, which is not low."""
    st = spark.createDataFrame([(1, T0, 70.0), (2, T0, 70.0)], "stay_id int, admit_time timestamp, weight double")
    rows = [(1, T0 + 2 * k * H, 60.0) for k in range(1, 13)] + [(2, T0 + 2 * k * H, 10.0) for k in range(1, 13)]
    ur = spark.createDataFrame(rows, "stay_id int, charttime timestamp, value double")
    assert {r.stay_id: r.onset for r in labels.urine_onset(ur, st).collect()} == {2: T0 + 6 * H}
    # charted rates are taken as they are
    assert {r.stay_id: r.onset for r in labels.urine_onset(ur, st, rates=True).collect()} == {2: T0 + 6 * H}
    assert labels.urine_onset(ur.withColumn("value", F.lit(2001.0)), st, rates=True).isEmpty()


def test_charted_rates_of_zero_count(spark):
    none, no = F.lit(None).cast("double"), F.lit(False)
    row = spark.range(1).select(
        sofa.cardiovascular(F.lit(80.0), none, F.lit(0.0), none, no, no).alias("norepi"), sofa.cardiovascular(F.lit(80.0), F.lit(0.0), none, none, no, no).alias("dopa"),
        sofa.cardiovascular(F.lit(80.0), none, F.lit(0.11), none, no, no).alias("high"), sofa.cardiovascular(F.lit(69.0), none, none, none, no, no).alias("map"),
    ).first()
    assert tuple(row) == (3, 2, 4, 1)


@pytest.mark.parametrize("source,target,value", [("F", "C", 37.777777777777779), ("oz", "g", 2834.95), ("lb", "kg", 45.35924), ("mg/dL_crea", "μmol/L_crea", 8840.0), ("mmol/L_glu", "mg/dL_glu", 1801.82), ("cm", "cm", 100.0)])
def test_unit_pairs(spark, source, target, value):
    assert abs(spark.range(1).select(clean.convert_unit(F.lit(100.0), source, target).alias("v")).first().v - value) < 1e-9


def test_half_life_of_zero_takes_the_last(spark):
    from wardgrid.operators import blocks

    v = spark.createDataFrame([(1, 0, [1.0]), (1, 5, [3.0])], "k int, t int, embedding array<double>")
    assert [r.value for r in blocks.mean_pool(v, "k", at="t", half_life=0.0).collect()] == [3.0]


def test_standardised_skips_groups_without_variance(spark):
    from wardgrid.operators import blocks

    rows = spark.createDataFrame([(1, "a", 5.0), (2, "a", 5.0), (1, "b", 1.0), (2, "b", 3.0)], "stay_id int, treatment string, dose double")
    got = {(r.stay_id, r.treatment): r.scaled for r in blocks.standardised(rows, rows, "dose", "treatment").collect()}
    assert got == {(1, "a"): 5.0, (2, "a"): 5.0, (1, "b"): -1.0, (2, "b"): 1.0}


def test_a_table_is_replaced_whole(spark, tmp_path):
    path = str(tmp_path / "t")
    good = spark.createDataFrame([("s", T0, None)], "stay_id string, starttime timestamp, endtime timestamp")
    tables.write_canonical(good, "abx_duration", path)
    with pytest.raises(ValueError):
        tables.write_canonical(good.withColumn("starttime", F.lit(None).cast("timestamp")), "abx_duration", path)
    assert spark.read.parquet(path).count() == 1
    tables.write_canonical(good.unionByName(good), "abx_duration", path)
    assert spark.read.parquet(path).count() == 2 and [p.name for p in tmp_path.iterdir()] == ["t"]


def test_grouped_folds(spark):
    st = spark.createDataFrame([(p, 10 * p + k, p % 2) for p in range(20) for k in range(2)], "patient_id long, stay_id long, label int")
    got = splits.grouped_folds(st, 5, repeats=2)
    assert got.count() == 80 and got.groupBy("rep", F.floor(F.col("stay_id") / 10)).agg(F.count_distinct("fold").alias("n")).where("n > 1").isEmpty()
    assert {r["count"] for r in got.where("rep = 0").groupBy("fold").count().collect()} == {8}
    for bad in (st.withColumn("label", F.lit(2)), st.limit(4), st.withColumn("label", F.lit(1)).withColumn("patient_id", F.lit(1))):
        with pytest.raises(ValueError):
            splits.grouped_folds(bad, 5)


def test_sepsis_routing(spark):
    st = spark.createDataFrame([(1, 1, T0, 100.0)], "patient_id int, stay_id int, admit_time timestamp, los_hours double")
    abx = spark.createDataFrame([(1, T0 + 20 * H, T0 + 90 * H)], "stay_id int, starttime timestamp, endtime timestamp")
    score = spark.createDataFrame([(1, h, 0 if h < 18 else 3) for h in range(100)], "stay_id int, hour int, sofa int")
    got = labels.sepsis_labels(st, abx, score, None).where("label_value = 1").collect()
    assert sorted(r.hour for r in got) == list(range(14, 27))
    far = spark.createDataFrame([(1, T0 + 60 * H)], "stay_id int, charttime timestamp")
    assert labels.sepsis_labels(st, abx, score, far).where("label_value = 1").isEmpty()


def test_no_plan_holds_all_scores_in_one_task(spark):
    scored = spark.range(1000).selectExpr("cast(id % 2 as int) as y", "id / 7 as score")
    plan = metrics.auroc(scored)._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if " Window " in line]
    assert windows and all("_b#" in line for line in windows)
    assert metrics.auroc(scored).first().n == 1000

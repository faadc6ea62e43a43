"""Views, sequences, exports, splits, published tables, medians and note streams on literal rows."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from wardgrid.operators import blocks, checks, labels, metrics, prep, splits, streams, views
from wardgrid.sources import publish, tables

T0 = dt.datetime(2020, 1, 1)
H = dt.timedelta(hours=1)


@pytest.fixture
def stays(spark):
    rows = [("p1", "miiv_1", T0, T0 + 48 * H, "F"), ("p1", "miiv_2", T0 + 100 * H, T0 + 148 * H, "M"), ("p2", "miiv_3", T0, T0 + 24 * H, "f"), ("p3", "miiv_4", T0, T0 + 24 * H, None)]
    return spark.createDataFrame(rows, "patient_id string, stay_id string, admit_time timestamp, discharge_time timestamp, sex string")


@pytest.fixture
def split(spark):
    return spark.createDataFrame([("1", "train"), ("miiv_2", "test"), ("3", "val")], "stay_id string, split string")


def test_admissions(spark, stays):
    known = spark.createDataFrame([(1, 10), (2, 20), (2, 21)], "stay_id long, hadm_id long")
    assert sorted((r.stay_id, r.hadm_id) for r in views.with_admission(stays, known, "mimic_iv").collect()) == [("miiv_1", "10"), ("miiv_2", "20"), ("miiv_3", None), ("miiv_4", None)]
    assert {r.hadm_id for r in views.with_admission(stays, known, "eicu").collect()} == {None}


def test_view_of_diagnoses_and_its_coverage(spark, stays, split):
    code = lambda who, bound, src, code, h, origin: (who, bound, src, code, "icd10", T0 + h * H, origin)
    rows = [code("p1", None, "a", "I10", -5, "billing"), code("p1", None, "b", "J18", 99, "billing"), code("p1", None, "b", "J19", 101, "billing"), code(None, "miiv_3", "c", "A41", 0, "active"), code("p3", None, "d", "A41", -1, "active")]
    stream = spark.createDataFrame(rows, "patient_id string, bound_stay_id string, source_admission_id string, code string, code_system string, knowable_time timestamp, origin string")
    view = views.aligned_view(stream, stays, split, "miiv", "diagnoses")
    got = sorted((r.stay_id, r.code, r.prior_visit_idx, r.split) for r in view.collect())
    assert got == [("miiv_1", "I10", 0, "train"), ("miiv_2", "I10", 0, "test"), ("miiv_2", "J18", 1, "test"), ("miiv_3", "A41", 0, "val")]  # miiv_4 has no split
    row = views.coverage_report(view, split, "aki", "miiv", ["origin", "code"], depth="prior_visit_idx").first()
    assert (row.task, row.dataset, row.n_cohort, row.n_stays, row.share, row.n_rows) == ("aki", "miiv", 3, 3, 1.0, 4)
    assert row.mean_rows == pytest.approx(4 / 3) and row.mean_depth == pytest.approx((1 + 2 + 1) / 3)
    assert row.by_origin == {"active": 1, "billing": 3} and row.by_code == {"A41": 1, "I10": 2, "J18": 1}
    none = views.coverage_report(view.limit(0), split, "aki", "miiv", ["origin"], depth="prior_visit_idx").first()
    assert (none.n_stays, none.share, none.n_rows, none.mean_rows, none.mean_depth, none.by_origin) == (0, 0.0, 0, 0.0, 0.0, {})


def test_view_of_notes(spark, stays, split):
    note = lambda src, hadm, kind, h: ("p1", None, src, hadm, kind, "t", T0 + h * H)
    rows = [note("n1", "10", "radiology", 5), note("n2", "10", "discharge_summary", 60), note("n3", "20", "discharge_summary", 150), note("n4", "20", "radiology", 200)]
    stream = spark.createDataFrame(rows, "patient_id string, bound_stay_id string, source_admission_id string, hadm_id string, note_type string, text string, knowable_time timestamp")
    known = views.with_admission(stays, spark.createDataFrame([(1, 10), (2, 20)], "stay_id long, hadm_id long"), "miiv")
    view = views.aligned_view(stream, known, split, "miiv", "notes")
    assert sorted((r.stay_id, r.source_admission_id, r.within_window) for r in view.collect()) == [("miiv_1", "n1", True), ("miiv_2", "n1", False), ("miiv_2", "n2", False)]
    assert views.coverage_report(view, split, "los", "miiv", ["note_type"], flag="within_window").first().n_flagged == 1


def test_labelled_sequences(spark):
    rows = spark.createDataFrame([("a", h, float(h), None) for h in (2, 0, 1)] + [("b", 0, 5.0, 1.0)], "stay_id string, hour int, x double, y double")
    hourly = spark.createDataFrame([("a", 0, 1.0), ("a", 2, None)], "stay_id string, hour int, label double")
    got = {r.stay_id: (r.vectors, r.labels, r.mask) for r in views.pack_labelled(rows, hourly, ["x", "y"], 4).collect()}
    assert got["a"] == ([[0.0, 0.0], [1.0, 0.0], [2.0, 0.0], [0.0, 0.0]], [1.0, -1.0, -1.0, 0.0], [1, 0, 0, 0])
    assert got["b"] == ([[5.0, 1.0]] + [[0.0, 0.0]] * 3, [-1.0, 0.0, 0.0, 0.0], [0, 0, 0, 0])
    single = spark.createDataFrame([("a", 1.0)], "stay_id string, label double")
    got = {r.stay_id: (r.labels, r.mask) for r in views.pack_labelled(rows, single, ["x"], 3).collect()}
    assert got == {"a": ([-1.0, -1.0, 1.0], [0, 0, 1]), "b": ([-1.0, 0.0, 0.0], [0, 0, 0])}
    with pytest.raises(Exception, match="longer than 2"):
        views.pack_labelled(rows, single, ["x"], 2).collect()


def test_flat_matrix(spark):
    rows = spark.createDataFrame([("a", 0, 1.0), ("a", 1, None), ("b", 0, 3.0), ("c", 0, 4.0)], "stay_id string, hour int, x double")
    single = spark.createDataFrame([("a", 1), ("b", 0), ("z", 0)], "stay_id string, label int")
    assert sorted(tuple(r) for r in views.flat_matrix(rows, single, ["x"]).collect()) == [("a", 1.0, 1), ("b", 3.0, 0)]
    hourly = spark.createDataFrame([("a", 1, 1), ("b", 0, 0)], "stay_id string, hour int, label int")
    assert sorted(views.flat_matrix(rows, hourly, ["x"]).collect()) == [("a", 1, None, 1), ("b", 0, 3.0, 0)]


def test_blocks_are_merged_by_strategy(spark):
    rows = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 2.0), ("b", 0, 3.0)], "stay_id string, hour int, x double")
    icd = spark.createDataFrame([("a", 1.0, 1.0)], "stay_id string, icd__I10 double, icd_present double")
    notes = spark.createDataFrame([("a", 1, 0.5, 1.0)], "stay_id string, hour int, note__0 double, notes_present double")
    both = {"icd": icd, "notes": notes}
    merged = views.STRATEGIES["feature_augmentation"](rows, both).select("stay_id", "hour", "x", "icd__I10", "icd_present", "note__0", "notes_present")
    assert sorted(tuple(r) for r in merged.collect()) == [("a", 0, 1.0, 1.0, 1.0, 0.0, 0.0), ("a", 1, 2.0, 1.0, 1.0, 0.5, 1.0), ("b", 0, 3.0, 0.0, 0.0, 0.0, 0.0)]
    assert views.STRATEGIES["icd_only"](rows, both).columns == ["stay_id", "hour", "icd__I10", "icd_present"]
    assert views.STRATEGIES["icd_only"](rows, {"notes": notes}).columns == rows.columns
    plain = blocks.merge_block(rows, icd.drop("icd_present"), ["stay_id"], "icd")
    assert {(r.stay_id, r.icd_present) for r in plain.collect()} == {("a", 1), ("b", 0)}
    with pytest.raises(Exception, match="more than one row"):
        blocks.merge_block(rows, icd.unionByName(icd), ["stay_id"], "icd").collect()


def test_labels_by_name(spark):
    @views.register_labels("test_task")
    def build(given, dataset):
        return given["stays"].select("stay_id", F.lit(dataset == "miiv").cast("int").alias("label_value"))

    one = {"stays": spark.createDataFrame([("a",)], "stay_id string")}
    assert views.labels_of("test_task", one, "miiv").first().label_value == 1
    with pytest.raises(ValueError, match="already"):
        views.register_labels("test_task")(build)
    with pytest.raises(KeyError, match="known"):
        views.labels_of("other", one, "miiv")
    views.LABELS["test_bad"] = lambda given, dataset: given["stays"]
    with pytest.raises(ValueError, match="label_value"):
        views.labels_of("test_bad", one, "miiv")
    del views.LABELS["test_task"], views.LABELS["test_bad"]


def test_deviations_and_layout(spark, stays):
    weighed = stays.select("stay_id", F.when(F.col("stay_id") == "miiv_1", F.lit(80.0)).alias("weight"), F.when(F.col("stay_id") < "miiv_3", "miiv").otherwise("eicu").alias("dataset"))
    assert sorted(tuple(r) for r in views.weight_deviations(weighed, "aki").collect()) == [("aki", "eicu", 2, 2, "2/2 stays had no weight; 75 kg was used"), ("aki", "miiv", 1, 2, "1/2 stays had no weight; 75 kg was used")]
    sta = spark.createDataFrame([("p1", "miiv_1", 60.0, 0.0)], "patient_id string, stay_id string, age double, sex_male double")
    dyn = spark.createDataFrame([("miiv_1", 0, 88.0)], "stay_id string, hour int, hr double")
    a, b, c = views.benchmark_layout(sta, dyn, spark.createDataFrame([("miiv_1", 0, 1)], "stay_id string, hour int, label_value int"), stays)
    assert a.first().asDict() == {"stay_id": "miiv_1", "age": 60.0, "sex": "F"} and b.columns == ["stay_id", "time", "hr"] and c.first().asDict() == {"stay_id": "miiv_1", "time": 0, "label": True}
    late = spark.createDataFrame([("miiv_1", T0, 3.5)], "stay_id string, label_time timestamp, label_value double")
    assert views.benchmark_layout(sta, dyn, late, stays)[2].first().asDict() == {"stay_id": "miiv_1", "time": T0, "label": 3.5}


def test_folds_by_labels_of_their_own(spark):
    st = spark.createDataFrame([(p, 10 * p + k) for p in range(20) for k in range(2)], "patient_id long, stay_id long")
    own = spark.createDataFrame([(p, p % 2) for p in range(20)], "patient_id long, label int")
    got = splits.stratified_folds(st, own, 5, 2)
    assert got.count() == 80 and got.groupBy("rep", "stay_id").count().where("count > 1").isEmpty()
    for bad in (own.unionByName(own.limit(1)), own.where("patient_id <> 3"), own.unionByName(spark.createDataFrame([(99, 0)], own.schema)), own.withColumn("label", F.lit(7))):
        with pytest.raises(ValueError):
            splits.stratified_folds(st, bad, 5, 2)


def test_stay_splits_and_their_manifest(spark):
    st = spark.createDataFrame([(i, h, int(i % 4 == 0)) for i in range(60) for h in range(2)], "stay_id long, hour int, label int")
    got = splits.stay_splits(st)
    assert got.count() == 60 * 25 and got.groupBy("rep", "fold", "stay_id").count().where("count > 1").isEmpty()
    tested = got.where("split = 'test'").groupBy("rep").agg(F.count_distinct("stay_id").alias("n"), F.count_distinct(F.when(F.col("stay_id") % 4 == 0, F.col("stay_id"))).alias("p")).collect()
    assert {(r.n, r.p) for r in tested} == {(12, 3)}
    m = splits.fold_manifest(got).collect()
    assert len(m) == 25 and all(r.n_train + r.n_val + r.n_test == 60 for r in m) and len({r.digest for r in m}) == 25
    again = {(r.rep, r.fold, r.digest) for r in splits.fold_manifest(got.orderBy(F.rand())).collect()}
    assert again == {(r.rep, r.fold, r.digest) for r in m}


def test_published_tables_are_whole_at_every_step(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/t"
    good = spark.createDataFrame([("s", T0, None)], "stay_id string, starttime timestamp, endtime timestamp")
    with pytest.raises(FileNotFoundError):
        tables.read_table(spark, "abx_duration", root)
    assert tables.publish_table(good, "abx_duration", root) == 0
    whole = publish.publish
    for step in ("before", "after"):

        def crash(*args, step=step):
            if step == "after":
                # the draft is written, its name is not there yet
                draft = tmp_path / "t" / "versions" / ".draft"
                draft.write_text("torn")
            raise RuntimeError("crash")

        monkeypatch.setattr(publish, "publish", crash)
        with pytest.raises(RuntimeError):
            tables.publish_table(good.unionByName(good), "abx_duration", root)
        monkeypatch.setattr(publish, "publish", whole)
        assert tables.read_table(spark, "abx_duration", root).count() == 1
    with pytest.raises(ValueError):
        tables.publish_table(good.withColumn("starttime", F.lit(None).cast("timestamp")), "abx_duration", root)
    assert tables.publish_table(good.unionByName(good), "abx_duration", root) == 1
    assert tables.read_table(spark, "abx_duration", root).count() == 2 and tables.read_table(spark, "abx_duration", root, 0).count() == 1
    with pytest.raises(FileExistsError):
        publish.publish(spark, f"{root}/versions", "000000001", "other")
    assert publish.names(spark, f"{root}/versions") == ["000000000", "000000001"] and "other" not in publish.content_of(spark, f"{root}/versions", "000000001")
    # another writer takes the number first: this one gets the next
    seen = publish.names
    monkeypatch.setattr(publish, "names", lambda s, f: seen(s, f)[:1] if not getattr(test_published_tables_are_whole_at_every_step, "late", False) and not setattr(test_published_tables_are_whole_at_every_step, "late", True) else seen(s, f))
    assert tables.publish_table(good, "abx_duration", root) == 2


def test_append_keeps_one_row_of_a_key_in_a_batch(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string")
    tables.append_new(rows, str(tmp_path / "n"), "k")
    tables.append_new(rows.unionByName(spark.createDataFrame([(3, "c")], rows.schema)), str(tmp_path / "n"), "k")
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "n")).collect()) == [1, 2, 3]


def test_parquet_parts_and_vectors_by_name(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(i, [1.0], "x")], "note_id int, emb array<double>, more string").coalesce(1).write.parquet(f"{tmp_path}/part-{i}.parquet")
    assert sorted(r.note_id for r in tables.read_parquet_parts(spark, f"{tmp_path}/part-*.parquet", ["note_id"]).collect()) == [0, 1, 2]
    wanted = spark.createDataFrame([(1,), (1,), (9,)], "note_id int")
    assert [tuple(r) for r in tables.read_embeddings(spark, f"{tmp_path}/part-*.parquet", wanted).collect()] == [(1, [1.0])]
    spark.createDataFrame([(1, 2)], "note_id int, x int").write.parquet(f"{tmp_path}/none")
    with pytest.raises(ValueError, match="no column"):
        tables.read_embeddings(spark, f"{tmp_path}/none", wanted)


@pytest.mark.parametrize("exact", [200_000, 40])
def test_medians(spark, monkeypatch, exact):
    monkeypatch.setattr(prep, "EXACT", exact)
    monkeypatch.setattr(prep, "NEAR", 0.02)
    rng = random.Random(3)
    a = [rng.gauss(0, 1) for _ in range(3001)]
    b = [float(rng.randint(0, 3)) for _ in range(3001)]
    c = [None if i % 3 else rng.random() * 10**6 for i in range(3001)]
    frame = spark.createDataFrame([(x, y, z, None, 7.0) for x, y, z in zip(a, b, c, strict=True)], "a double, b double, c double, d double, e double").repartition(5)
    got = prep.medians(frame, ["a", "b", "c", "d", "e"])
    assert got == {"a": statistics.median(a), "b": statistics.median(b), "c": statistics.median([x for x in c if x is not None]), "d": None, "e": 7.0}
    assert prep.medians(frame, []) == {} and prep.medians(frame.limit(0), ["a"]) == {"a": None}


def test_train_statistics_have_no_global_percentile(spark):
    rows = spark.createDataFrame([(i, float(i * i % 11)) for i in range(50)], "stay_id int, x double")
    stats = prep.train_stats(rows, rows.where("stay_id < 30"), ["x"])
    plan = stats._jdf.queryExecution().executedPlan().toString()
    assert "median(" not in plan.lower() and "percentile" not in plan.lower()
    assert stats.first().x_median == statistics.median([i * i % 11 for i in range(30)])


def test_episodes_are_cut_at_death(spark):
    dose = lambda s, e: ("s", T0 + s * H, None if e is None else T0 + e * H, "antibiotic")
    table = lambda *rows: spark.createDataFrame(list(rows), "stay_id string, starttime timestamp, endtime timestamp, drug_class string")
    death = labels.deaths(spark.createDataFrame([("s", True, T0 + 36 * H), ("t", False, T0)], "stay_id string, mortality_in_icu boolean, discharge_time timestamp"))
    assert labels.antibiotic_episodes(table(dose(0, 34))).count() == 0
    assert labels.antibiotic_episodes(table(dose(0, 34)), death).count() == 1
    # what is charted after death is kept, and its gap counts
    assert sorted(r.starttime for r in labels.antibiotic_episodes(table(dose(0, 34), dose(70, 71)), death).collect()) == [T0 + 70 * H]
    # each row stands for itself
    assert labels.antibiotic_episodes(table(dose(0, 50), dose(0, 60), dose(0, None))).count() == 3
    assert labels.continuous_episodes(table(dose(0, 50), dose(0, 60)).drop("drug_class")).count() == 1


def test_suspected_infection_makes_no_pairs(spark):
    rng = random.Random(1)
    episodes = [(s, T0 + rng.randint(-200, 200) * H) for s in range(8) for _ in range(6)]
    samples = [(s, T0 + rng.randint(-300, 300) * H) for s in range(1, 9) for _ in range(6)] + [(1, None)]
    want = {}
    for s, a in episodes:
        for q, b in samples:
            if q == s and b is not None and -72 * H <= b - a <= 24 * H:
                want[s] = min(want.get(s, a), a, b)
    out = labels.suspected_infection(spark.createDataFrame(episodes, "stay_id int, starttime timestamp"), spark.createDataFrame(samples, "stay_id int, charttime timestamp"))
    assert {r.stay_id: r.si for r in out.collect()} == want
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_fingerprints_tell_columns_and_nulls_apart(spark):
    of = lambda *rows: checks.fingerprint(spark.createDataFrame(list(rows), "a string, b string")).first().digest
    assert len({of(("x", "y")), of(("xy", "")), of(("xy", None)), of(("", "xy")), of((None, "xy")), of(("x", "y"), ("x", "y"))}) == 6
    assert of(("x", "y"), ("p", None)) == of(("p", None), ("x", "y")) and of() == "0"


def test_grid_report_and_flat_grid(spark):
    run = lambda task, model, seed, value, sha="f": (task, "eicu", model, seed, value, sha)
    rows = [run("los", "GRU", 1, 84.0), run("los", "GRU", 2, 168.0, "g"), run("aki", "LGBM__icd", 1, 0.8), run("aki", "LGBM", 1, 0.7, ""), run("aki", "MOMENT-base", 1, 0.9), run("aki", "LGBM__abl_x", 1, 0.9), run("aki", "X-ft", 1, 0.9)]
    report = metrics.grid_report(spark.createDataFrame(rows, "task string, dataset string, model string, seed int, value double, fold_sha string"))
    got = {(r.task, r.model): r for r in report.collect()}
    los = got["los", "GRU"]
    assert (los.mean, los.n, los.scaled_mean, los.under_seeded, los.n_fold_shas) == (126.0, 2, 0.75, False, 2) and los.std == pytest.approx(statistics.stdev([84, 168])) and los.scaled_std == pytest.approx(los.std / 168)
    one = got["aki", "LGBM"]
    assert (one.std, one.scaled_mean, one.under_seeded, one.n_fold_shas) == (0.0, None, True, 0)
    assert sorted(tuple(r) for r in metrics.flat_grid(report).collect()) == [("aki", "eicu", "LGBM", "AUROC", 0.7, 1), ("aki", "eicu", "LGBM+icd", "AUROC", 0.8, 1), ("los", "eicu", "GRU", "MAE", 126.0, 2)]


def test_top_k_accuracy(spark):
    scored = spark.createDataFrame([(0, [0.5, 0.3, 0.2]), (1, [0.5, 0.3, 0.3]), (2, [0.5, 0.3, 0.3]), (None, [1.0, 0.0, 0.0])], "y int, scores array<double>")
    assert [metrics.top_k_accuracy(scored, k).first()[:] for k in (1, 2, 3)] == [(3, pytest.approx(1 / 3)), (3, pytest.approx(2 / 3)), (3, 1.0)]


def test_encoders(spark):
    notes = spark.createDataFrame([(1, "a b a"), (2, None), (3, "")], "note_id int, text string")
    got = {r.note_id: (r.embedding, r.n_tokens) for r in blocks.encode_texts(notes).collect()}
    assert got[1][1] == 3 and sum(x * x for x in got[1][0]) == pytest.approx(1, abs=1e-5) and got[2] == got[3] == ([0.0] * 8, 0)
    own = blocks.encode_texts(notes, encoder=lambda texts: ([[float(len(t)), 1.0] for t in texts], [len(t) for t in texts]), batch=2)
    assert {r.note_id: (r.embedding, r.n_tokens) for r in own.collect()} == {1: ([5.0, 1.0], 5), 2: ([0.0, 1.0], 0), 3: ([0.0, 1.0], 0)}


def test_prose_notes(spark):
    rows = [("n1", 1, 10, "DS", "2020-01-02 00:00:00", "a  [**Name**] b ___"), ("n2", 1, 10, "DS", "2020-01-03 00:00:00", "a b"), ("n3", 1, 10, "RR", "2020-01-03 00:00:00", "a b"), ("n4", 1, 10, "RR", "bad", "x"), ("n5", 1, 10, "DS", "2020-01-03 00:00:00", "a b"), ("n6", 2, None, "RR", "2020-01-03 00:00:00", None)]
    out = streams.prose_notes(spark.createDataFrame(rows, "note_id string, subject_id int, hadm_id int, note_type string, storetime string, text string"), "miiv")
    assert out.columns == streams.NOTE_COLUMNS
    assert sorted((r.note_id, r.patient_id, r.hadm_id, r.note_type, r.text, r.bound_stay_id) for r in out.collect()) == [("n2", "miiv_1", "10", "discharge", "a b", None), ("n3", "miiv_1", "10", "radiology", "a b", None), ("n6", "miiv_2", None, "radiology", "", None)]


def test_exam_report_notes(spark):
    st = spark.createDataFrame([("p", "omix_s", "7"), ("p", "omix_t", "7")], "patient_id string, stay_id string, hospital_id string")
    rows = [("7", 1.5, "CT", "chest", "clear", "none"), ("7", 1.5, "CT", "brain", None, "x"), ("7", None, "CT", "brain", None, "x"), ("8", 1.5, "CT", "chest", "clear", "none")]
    out = streams.exam_report_notes(spark.createDataFrame(rows, "hospital_id string, day double, category string, item string, described string, finding string"), st, F.lit(T0))
    assert sorted((r.note_id, r.bound_stay_id, r.text, r.knowable_time, r.language) for r in out.collect()) == [("omix_exam_7_1.5_0", "omix_s", "CT | brain: x", T0 + 36 * H, "zh"), ("omix_exam_7_1.5_1", "omix_s", "CT | chest: clear none", T0 + 36 * H, "zh")]


def test_charted_notes(spark):
    rows = [("eicu_1", 65, "b", "2"), ("eicu_1", 61, "a", "1"), ("eicu_1", 61, "Print", "1"), ("eicu_1", -43201, "a", "1"), ("eicu_1", -10, "c", "3"), ("eicu_2", None, "a", "1")]
    out = streams.charted_notes(spark.createDataFrame(rows, "stay_id string, offset int, label string, value string"), spark.createDataFrame([("eicu_1", "eicu_p")], "stay_id string, patient_id string"), F.lit(T0), "eicu_exam", "pexam")
    got = sorted((r.note_id, r.patient_id, r.text, r.knowable_time) for r in out.collect())
    assert got == [("eicu_1_-1_pexam", "eicu_p", "c: 3", T0 - dt.timedelta(minutes=10)), ("eicu_1_1_pexam", "eicu_p", "a: 1; b: 2", T0 + dt.timedelta(minutes=61))]


def test_raw_signals(spark):
    at = lambda h: T0 + h * H
    rows = spark.createDataFrame([("p", "s", at(0)), ("p", "s", at(1)), ("p", "s", at(8)), ("p", "t", at(9)), ("p", "s", None)], "patient_id string, stay_id string, charttime timestamp")
    assert sorted((r.stay_id, str(r.charttime), r.infusion) for r in streams.infusion_sessions(rows, ["stay_id"], 360.0).collect()) == [("s", "2020-01-01 00:00:00", 1), ("s", "2020-01-01 01:00:00", 1), ("s", "2020-01-01 08:00:00", 2), ("s", "None", None), ("t", "2020-01-01 09:00:00", 1)]
    pump = lambda stay, inf, drug, h, given, unit: ("p", stay, inf, drug, at(h), given, unit)
    records = [
        pump("s", 1, "norepinephrine", 0, 0.0, "mg"), pump("s", 1, "norepinephrine", 1, 0.48, "mg"), pump("s", 1, "norepinephrine", 2, 480.0, " UG "), pump("s", 2, "norepinephrine", 3, 0.48, "mg"),
        pump("s", 3, "vasopressin", 0, 0.0, "U"), pump("s", 3, "vasopressin", 1, 4.8, "U"), pump("s", 4, "dobutamine", 0, 0.0, "mg"), pump("s", 4, "dobutamine", 1, 1.0, "mg"),
        pump("s", 5, "epinephrine", 0, 0.0, "mg"), pump("s", 5, "epinephrine", 1, 48.0, "mg"), pump("u", 6, "epinephrine", 0, 0.0, "mg"), pump("u", 6, "epinephrine", 1, 1.0, "mg"),
    ]
    table = spark.createDataFrame(records, "patient_id string, stay_id string, infusion int, drug string, charttime timestamp, given double, unit string")
    weights = spark.createDataFrame([("s", 80.0), ("u", 0.0)], "stay_id string, weight double")
    got = sorted((r.source_admission_id, r.start_time, round(r.dose, 4), r.dose_unit, r.origin) for r in streams.infused_equivalents(table, weights, "hirid").collect())
    # 480 ug in 60 minutes at 80 kg; vasopressin by 2.5; a rate of 10 is an artefact; no weight, no rate
    assert got == [("s", at(1), 0.0025, "ug/kg/min", "nee_raw"), ("s", at(1), 0.1, "ug/kg/min", "nee_raw"), ("s", at(2), 0.1, "ug/kg/min", "nee_raw")]
    hourly = spark.createDataFrame([("p", "s", at(0), 6e-6), ("p", "s", at(1), 0.0), ("p", "s", at(2), 1.0)], "patient_id string, stay_id string, charttime timestamp, value double")
    assert [(r.start_time, round(r.dose, 4)) for r in streams.charted_equivalents(hourly, "sicdb").collect()] == [(at(0), 0.1)]
    settings = spark.createDataFrame([("p", "s", at(0), v) for v in ("5", " 0 ", "25", "25.1", "3.2e10", "x", None, "-1", "NaN")], "patient_id string, stay_id string, charttime timestamp, value string")
    assert sorted(r.dose for r in streams.end_expiratory_pressures(settings, "eicu").collect()) == [0.0, 5.0, 25.0]
    runs = spark.createDataFrame([("p", "s", at(0), None)], "patient_id string, stay_id string, starttime timestamp, endtime timestamp")
    assert [(r.treatment, r.bound_stay_id, r.dose, r.origin) for r in streams.renal_replacement(runs, "omix").collect()] == [("rrt", "s", None, "rrt_raw")]


def test_preprocess_with_static_columns(spark):
    rows = spark.createDataFrame([("a", 0, 1.0, None), ("a", 1, None, None), ("b", 0, 3.0, None), ("c", 0, 9.0, None)], "stay_id string, hour int, x double, never double")
    static = spark.createDataFrame([("a", 60.0, None), ("b", 80.0, 1.0), ("c", None, 0.0)], "stay_id string, age double, sex_male double")
    train = spark.createDataFrame([("a",), ("b",)], "stay_id string")
    got = {(r.stay_id, r.hour): r for r in prep.preprocess(rows, train, ["x", "never"], static=static).collect()}
    assert [got[k].x for k in sorted(got)] == [0.0, 0.0, 1.0, 4.0] and {r.never for r in got.values()} == {0.0} and {r.never_is_null for r in got.values()} == {1}
    assert [(got[k].age, got[k].sex_male) for k in sorted(got)] == [(0.0, 0.0), (0.0, 0.0), (1.0, 0.0), (0.5, -1.0)]


def test_historical_hours_by_default(spark):
    rows = [("a", T0 + m * H / 60, c, v) for m, c, v in [(1, "urine", 5.0), (2, "urine", 7.0), (3, "abx", 0.0), (4, "abx", 1.0), (5, "hr", 80.0), (6, "hr", 90.0)]]
    got = {r.concept: r.value for r in prep.historical(spark.createDataFrame(rows, "stay_id string, charttime timestamp, concept string, value double")).collect()}
    assert got == {"urine": 12.0, "abx": 1.0, "hr": 85.0}


def test_codes_are_mapped_forward_before_they_are_grouped(spark):
    from wardgrid.operators.derive import group_codes

    codes = spark.createDataFrame([("038.9",), ("A41.9",), ("zzz1",), ("585",)], "code string")
    groups = spark.createDataFrame([("A419", "SEP")], "code string, group string")
    forward = spark.createDataFrame([("0389", "A419"), ("585", "N189")], "code string, new_code string")
    assert sorted((r.code, r.group, r.group_source) for r in group_codes(codes, groups, forward).collect()) == [("038.9", "SEP", "map"), ("585", "N18", "root"), ("A41.9", "SEP", "map"), ("zzz1", "ZZZ", "root")]


def test_baseline_equals_a_plain_fit(spark):
    import numpy as np

    from wardgrid.operators import models

    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 2))
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.7 * x[:, 0] - 1.2 * x[:, 1] + 0.3)))).astype(float)
    rows = spark.createDataFrame([(int(i), float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))], "i int, a double, b double, label double")
    got = {r.i: r.score for r in models.predict(models.fit_baseline(rows, ["a", "b"], "logistic", maxIter=200, tol=1e-10), rows).collect()}
    design, w = np.hstack([x, np.ones((400, 1))]), np.zeros(3)
    for _ in range(30):  # Newton's steps
        p = 1 / (1 + np.exp(-design @ w))
        w += np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]), design.T @ (y - p))
    want = 1 / (1 + np.exp(-design @ w))
    assert max(abs(got[i] - want[i]) for i in range(400)) < 1e-4

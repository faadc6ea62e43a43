"""Dictionaries, code maps, metadata of runs, guards, merges and comparisons of tables."""

import json

import pytest
from pyspark.sql import functions as F

from wardgrid.functions import clean, source_rules
from wardgrid.operators import blocks, derive
from wardgrid.sources import staging, tables


def test_dictionary_with_comments(spark, tmp_path):
    path = tmp_path / "d.csv"
    path.write_text("# fixed\nname,low,high\nhr,0,300\n# more\nph,6.5,8\n")
    dim = tables.read_dictionary(spark, str(path), "name string, low double, high double", 2)
    assert sorted(tuple(r) for r in dim.collect()) == [("hr", 0.0, 300.0), ("ph", 6.5, 8.0)]
    with pytest.raises(ValueError, match="expected 3 rows"):
        tables.read_dictionary(spark, str(path), "name string, low double, high double", 3)


def test_code_map_has_one_row_per_code(spark, tmp_path):
    (tmp_path / "m.csv").write_text("'ICD','CCSR','text'\n'A419 ','INF002','x'\n'A419','INF003','y'\n' I10','CIR007','z'\n")
    assert sorted(tuple(r) for r in tables.read_code_map(spark, str(tmp_path / "m.csv")).collect()) == [("A419", "INF002"), ("I10", "CIR007")]


def test_run_metadata_is_named_by_its_folder(spark, tmp_path):
    for model, said in (("GRU", "GRU"), ("LGBM", "GBDT")):
        place = tmp_path / "aki" / "eicu" / model / "seed_1"
        place.mkdir(parents=True)
        (place / "metadata.json").write_text(json.dumps({"model": said, "test_metrics": {"auc": 0.8}}, indent=1))
    got = sorted((r.model_dir, r.model, r.agrees) for r in tables.read_run_metadata(spark, str(tmp_path)).collect())
    assert got == [("GRU", "GRU", True), ("LGBM", "GBDT", False)]


def test_guards(spark, tmp_path):
    have, locked = spark.createDataFrame([(1,), (2,)], "itemid int"), spark.createDataFrame([(2,), (3,)], "itemid int")
    tables.require_codes(have, have, "itemid")
    with pytest.raises(ValueError, match=r"\[3\]"):
        tables.require_codes(have, locked, "itemid")
    tables.require_unique(have, "itemid")
    with pytest.raises(ValueError, match="not unique"):
        tables.require_unique(have.unionByName(have.limit(1)), "itemid")
    (tmp_path / "a.csv").write_text("x,y\n1,NA\n")
    assert [tuple(r) for r in tables.read_csv_or_empty(spark, str(tmp_path / "a.csv"), ["x", "y"]).collect()] == [("1", None)]
    for path, columns in ((str(tmp_path / "none.csv"), ["x"]), (str(tmp_path / "a.csv"), ["x", "z"])):
        none = tables.read_csv_or_empty(spark, path, columns)
        assert none.isEmpty() and none.columns == columns


def test_strict_csv(spark, tmp_path):
    (tmp_path / "s.csv").write_text('a,b,t\n1,"x ""y""","line\nline"\n')
    assert [tuple(r) for r in tables.read_strict_csv(spark, str(tmp_path / "s.csv"), "a string, b string, t string", ("t",)).collect()] == [("1", 'x "y"')]
    (tmp_path / "r.csv").write_text("a,b\n1,2\n3\n")
    with pytest.raises(Exception, match="MALFORMED|Malformed|malformed"):
        tables.read_strict_csv(spark, str(tmp_path / "r.csv"), "a string, b string").collect()


def test_merge_and_compare(spark):
    old = spark.createDataFrame([("eicu", 1), ("miiv", 2)], "dataset string, n int")
    new = spark.createDataFrame([("eicu", 9, "x")], "dataset string, n int, more string")
    assert sorted((r.dataset, r.n) for r in tables.merge_by_dataset(old, new).collect()) == [("eicu", 9), ("miiv", 2)]
    assert tables.compare_exports(old, old) == []
    assert tables.compare_exports(old, new) == ["column more", "rows 2 and 1"]
    assert tables.compare_exports(old, old.withColumn("n", F.col("n").cast("long"))) == ["type of n"]


def test_canonical_rows_have_what_is_required(spark):
    rows = spark.createDataFrame([("s", "2020-01-01 00:00:00", None, 1), (None, "2020-01-01 00:00:00", None, 2), ("t", None, None, 3)], "stay_id string, starttime string, endtime string, extra int")
    got = tables.canonical(rows, "abx_duration")
    assert got.schema.simpleString() == "struct<stay_id:string,starttime:timestamp,endtime:timestamp>" and [r.stay_id for r in got.collect()] == ["s"]


def test_kept_tables_do_not_change(spark):
    once = staging.kept(spark.range(5).select("id", F.rand().alias("x")), "once")
    assert once.collect() == once.collect() and once.count() == 5


def test_small_rules(spark):
    row = spark.createDataFrame([("2020-01-01", "2020-01-01 05:00:00", None)], "day string, time string, none string")
    got = row.select(source_rules.time_or_noon(F.col("time"), F.col("day")).alias("a"), source_rules.time_or_noon(F.col("none"), F.col("day")).alias("b"), clean.lenient_time(F.col("none"), F.col("day")).alias("c"), source_rules.end_or_none(F.col("time"), F.col("day")).alias("d")).first()
    assert (str(got.a), str(got.b), str(got.c), got.d) == ("2020-01-01 05:00:00", "2020-01-01 12:00:00", "2020-01-01 00:00:00", None)
    assert spark.range(1).select(source_rules.age_at(F.lit(60), F.lit(2100), F.lit("2102-05-01").cast("timestamp")).alias("x"), source_rules.age_of_band(F.lit("(60,70]")).alias("y"), source_rules.plausible_offset(F.lit(-43201)).alias("z")).first()[:] == (62.0, 65.0, False)


def test_inadmissible_treatments_go(spark):
    rows = spark.createDataFrame([("a", "rrt"), ("a", "niv")], "stay_id string, treatment string")
    leaks = spark.createDataFrame([("aki", "rrt"), ("aki", "rrt"), ("sepsis", "niv")], "task string, concept string")
    assert [r.treatment for r in blocks.drop_inadmissible(rows, "aki", leaks).collect()] == ["niv"]
    assert blocks.drop_inadmissible(rows, "los", leaks).count() == 2


def test_death_flags(spark):
    row = spark.sql("select timestamp'2020-01-01' i, timestamp'2020-01-03' o, timestamp'2020-01-02' d, timestamp'2019-12-31' a, cast(null as timestamp) n, timestamp'2020-03-01' late")
    pick = lambda death: row.select(*derive.death_flags(F.col("i"), F.col("o"), F.col(death), F.col("a"))).first()[:]
    assert (pick("d"), pick("n"), pick("late")) == ((True, True), (False, False), (False, False))

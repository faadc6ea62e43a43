"""Derivations that the harmonised sources share: stays, derived measurements, medication intervals, code groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardgrid.operators.timegrid import HOUR, micros


def attach_to_stays(rows: DataFrame, stays: DataFrame, keys: list[str], before_h: int = 0) -> DataFrame:
    """Rows of an admission, at each stay whose [intime - before_h, outtime] holds them; a row may meet several stays."""
    at = stays.select(*keys, "stay_id", "intime", "outtime")
    met = rows.join(at, keys).where((micros("charttime") >= micros("intime") - before_h * HOUR) & (micros("charttime") <= micros("outtime")))
    return met.drop("intime", "outtime")


def single_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key occurs once. Counts are summed before the shuffle, so a heavy key costs nothing."""
    once = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n = 1").drop("_n")
    return rows.join(once, keys, "left_semi")


def one_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, by max-style aggregation rather than a sorted window."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    first = F.min(F.struct(*order, *rest)).alias("_r")
    return rows.groupBy(*keys).agg(first).select(*keys, "_r.*").select(*rows.columns)


def star_join(fact: DataFrame, *dimensions: tuple[DataFrame, list[str]]) -> DataFrame:
    """fact with the columns of each dimension (table, keys), by left joins. A key that occurs twice in a dimension is an error,
    raised where its rows are counted; whether a dimension is broadcast is left to Spark, which knows its size."""
    for table, keys in dimensions:
        rest = [c for c in table.columns if c not in keys]
        once = table.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in rest])
        checked = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit(f"more than one row for {keys}: "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys]))).cast("long")).otherwise(F.col("_n"))
        fact = fact.join(once.withColumn("_n", checked).where("_n is not null").drop("_n"), keys, "left")
    return fact


def large_units(stays: DataFrame, least: int = 100) -> DataFrame:
    """stays of care units with at least that many stays."""
    return stays.join(stays.groupBy("careunit").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select("careunit"), "careunit", "left_semi")


def long_vitals(rows: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    """One row per id and measured column."""
    return rows.unpivot(ids, columns, "concept", "value").where("value is not null")


def sum_parts(events: DataFrame, parts: list[str], name: str) -> DataFrame:
    """Component scores of one time summed under a new concept; other concepts pass."""
    whole = events.where(F.col("concept").isin(parts)).groupBy("stay_id", "charttime").agg(F.sum("value").alias("value")).withColumn("concept", F.lit(name))
    return events.where(~F.col("concept").isin(parts)).select("stay_id", "charttime", "concept", "value").unionByName(whole)


def mean_pressure(events: DataFrame, systolic: str = "sbp", diastolic: str = "dbp") -> DataFrame:
    """(systolic + 2 diastolic) / 3 wherever both are known at one time."""
    of = lambda name: F.avg(F.when(F.col("concept") == name, F.col("value")))
    both = events.where(F.col("concept").isin(systolic, diastolic)).groupBy("stay_id", "charttime").agg(of(systolic).alias("s"), of(diastolic).alias("d"))
    return both.where("s is not null and d is not null").select("stay_id", "charttime", F.lit("map").alias("concept"), ((F.col("s") + 2 * F.col("d")) / 3).alias("value"))


def counter_to_amounts(rows: DataFrame) -> DataFrame:
    """First differences of a running counter; the first reading stands, a reset counts as 0."""
    order = Window.partitionBy("stay_id", "concept").orderBy(micros("charttime"), "value")
    step = F.col("value") - F.lag("value").over(order)
    return rows.withColumn("value", F.when(step.isNull(), F.col("value")).otherwise(F.greatest(step, F.lit(0.0))))


def time_bounds(*sources: DataFrame) -> DataFrame:
    """(stay_id, first, last) over the times of several sources."""
    every = sources[0].select("stay_id", "charttime")
    for s in sources[1:]:
        every = every.unionByName(s.select("stay_id", "charttime"))
    return every.groupBy("stay_id").agg(F.min("charttime").alias("first"), F.max("charttime").alias("last"))


def last_wards(transfers: DataFrame, keys: list[str], ward: str = "careunit") -> DataFrame:
    """(keys, last_ward): where each admission was before it ended: the row whose next event, in time, is the discharge."""
    following = F.lead("eventtype").over(Window.partitionBy(*keys).orderBy(micros("intime"), F.when(F.col("eventtype") == "discharge", 1).otherwise(0)))
    ends = transfers.withColumn("_next", following).where("_next = 'discharge'")
    return ends.groupBy(*keys).agg(F.max_by(ward, micros("intime")).alias("last_ward"))


def infusion_ends(meds: DataFrame, cap_h: int = 168) -> DataFrame:
    """An infusion lasts until the next start of the same drug, an hour if there is none, and at most cap_h."""
    following = F.lead(micros("starttime")).over(Window.partitionBy("stay_id", "drug").orderBy(micros("starttime")))
    end = F.least(F.coalesce(following, micros("starttime") + HOUR), micros("starttime") + cap_h * HOUR)
    return meds.withColumn("endtime", F.timestamp_micros(end))


def death_flags(intime: Column, outtime: Column, death: Column, admit: Column) -> tuple[Column, Column]:
    """(died in the unit, died within 30 days of admission); unknown deaths are false."""
    inside = F.coalesce(death.between(intime, outtime), F.lit(False))
    return inside, F.coalesce(micros(death) <= micros(admit) + 30 * 24 * HOUR, F.lit(False))


def group_codes(codes: DataFrame, groups: DataFrame, forward: DataFrame | None = None) -> DataFrame:
    """codes with group and group_source: old codes are mapped forward, then grouped; else the three-character root.

    groups is (code, group), forward is (code, new_code): small caller-supplied maps, which Spark broadcasts by size.
    """
    plain = codes.withColumn("_c", F.upper(F.regexp_replace("code", r"\.", "")))
    if forward is not None:
        plain = plain.join(forward.select(F.col("code").alias("_c"), F.col("new_code").alias("_n")), "_c", "left").withColumn("_c", F.coalesce("_n", "_c")).drop("_n")
    met = plain.join(groups.select(F.col("code").alias("_c"), F.col("group").alias("_g")), "_c", "left")
    return met.withColumn("group", F.coalesce("_g", F.substring("_c", 1, 3))).withColumn("group_source", F.when(F.col("_g").isNotNull(), "map").otherwise("root")).drop("_c", "_g")


def coverage(aligned: DataFrame, stays: DataFrame, by: str) -> DataFrame:
    """(value of by, n_rows, n_stays, share of all stays)."""
    n = stays.agg(F.count_distinct("stay_id").alias("_all"))
    per = aligned.groupBy(by).agg(F.count("*").alias("n_rows"), F.count_distinct("stay_id").alias("n_stays"))
    return per.join(F.broadcast(n)).select(by, "n_rows", "n_stays", (F.col("n_stays") / F.col("_all")).alias("share"))  # one row

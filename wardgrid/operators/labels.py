"""Outcome labels: mortality, length of stay, kidney function, kidney injury and sepsis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardgrid.operators.timegrid import HOUR, build_dyn, hour_grid, hour_index, los_horizon, micros, trailing

WEIGHT_DEFAULT = 75.0


def mortality24(stays: DataFrame) -> DataFrame:
    """Stays of at least 30 h; the label is death in the unit, known 24 h after admission."""
    return stays.where("los_hours >= 30").select("patient_id", "stay_id", (F.col("admit_time").cast("timestamp") + F.expr("INTERVAL 24 HOURS")).alias("label_time"), F.col("mortality_in_icu").cast("tinyint").alias("label_value"))


def remaining_los(stays: DataFrame, cap: float = 168.0) -> DataFrame:
    """Per hour, the hours left, clipped to 0..cap."""
    left = F.greatest(F.lit(0.0), F.least(F.col("los_hours") - F.col("hour"), F.lit(cap)))
    return hour_grid(stays, los_horizon()).join(stays.select("stay_id", "los_hours"), "stay_id").select("stay_id", "hour", left.cast("float").alias("label_value"))


def kidney_function(stays: DataFrame, creatinine: DataFrame) -> DataFrame:
    """Median creatinine in (24 h, 48 h] of stays of at least 48 h, clipped to 0..15."""
    long = stays.where("los_hours >= 48").select("stay_id", "admit_time")
    since = micros("charttime") - micros("admit_time")
    return creatinine.join(long, "stay_id").where((since > 24 * HOUR) & (since <= 48 * HOUR)).groupBy("stay_id").agg(F.greatest(F.lit(0.0), F.least(F.lit(15.0), F.median(F.col("value").cast("double")))).alias("label_value"))


def creatinine_onset(creatinine: DataFrame) -> DataFrame:
    """(stay_id, onset): the first value 0.3 above the least of 48 h, or 1.5 times the least of 7 days."""
    low48, low7d = (F.min("value").over(trailing(["stay_id"], "charttime", h)) for h in (48, 168))
    risen = creatinine.where("value is not null").withColumn("a", low48).withColumn("b", low7d).where("value - a >= 0.3 or value >= 1.5 * b")
    return risen.groupBy("stay_id").agg(F.min("charttime").alias("onset"))


def urine_onset(urine: DataFrame, stays: DataFrame, rates: bool = False) -> DataFrame:
    """(stay_id, onset): first time that the output per kg is too low over 6, 12 or 24 h.

    urine is (stay_id, charttime, value): volumes in ml (0 to 5000), each made a rate by the hours since the last one, 1 h if
    that is unknown or above a day; or, with rates, charted rates in ml/h (0 to 2000). The rates in (t - w, t] are summed and
    divided by the weight alone.
    """
    order = Window.partitionBy("stay_id").orderBy(micros("charttime"))
    known = urine.where(f"value between 0 and {2000 if rates else 5000}").join(stays.select("stay_id", "admit_time", F.coalesce("weight", F.lit(WEIGHT_DEFAULT)).cast("double").alias("weight")), "stay_id")
    gap = (micros("charttime") - F.lag(micros("charttime")).over(order)) / F.lit(HOUR)
    # two volumes of one time have no gap to divide by: the second counts for 1 h
    hours = F.when(F.col("gap").isNull() | (F.col("gap") > 24) | (F.col("gap") <= 0), 1.0).otherwise(F.col("gap"))
    rated = known.withColumn("gap", gap).withColumn("rate", F.col("value").cast("double") if rates else F.col("value") / hours)
    for h in (6, 12, 24):
        rated = rated.withColumn(f"r{h}", F.sum("rate").over(trailing(["stay_id"], "charttime", h)) / F.col("weight"))
    since = (micros("charttime") - micros("admit_time")) / F.lit(HOUR)
    low = ((since >= 24) & (F.col("r24") < 0.3)) | ((since >= 12) & ((F.col("r12") == 0) | (F.col("r12") < 0.5))) | ((since >= 6) & (F.col("r6") < 0.5))
    return rated.where(low).groupBy("stay_id").agg(F.min("charttime").alias("onset"))


def first_onset(*arms: DataFrame) -> DataFrame:
    """The earliest onset of a stay over all arms."""
    every = arms[0]
    for arm in arms[1:]:
        every = every.unionByName(arm)
    return every.groupBy("stay_id").agg(F.min("onset").alias("onset"))


def exclude_high_baseline(stays: DataFrame, creatinine: DataFrame, limit: float = 4.0) -> DataFrame:
    """stays without those whose first creatinine (least value at the first time) is above the limit."""
    first = creatinine.where("value is not null").groupBy("stay_id").agg(F.min(F.struct("charttime", "value"))["value"].alias("base"))
    return stays.join(first.where(F.col("base") > limit), "stay_id", "left_anti")


def exclude_early(stays: DataFrame, onsets: DataFrame, hours: float = 6.0) -> DataFrame:
    """stays without those whose onset is less than `hours` after admission."""
    early = onsets.join(stays.select("stay_id", "admit_time"), "stay_id").where(micros("onset") - micros("admit_time") < int(hours * HOUR))
    return stays.join(early, "stay_id", "left_anti")


def hospitals_with_cases(stays: DataFrame, onsets: DataFrame) -> DataFrame:
    """stays of hospitals that have at least one case."""
    return stays.join(stays.join(onsets, "stay_id", "left_semi").select("hospital_id").distinct(), "hospital_id", "left_semi")


def onset_labels(stays: DataFrame, onsets: DataFrame, around: int = 6) -> DataFrame:
    """(stay_id, hour, label_value): 1 within `around` hours of the onset's hour."""
    at = stays.join(onsets, "stay_id", "left").select("stay_id", hour_index("onset", "admit_time").alias("onset_hour"))
    near = F.coalesce(F.abs(F.col("hour") - F.col("onset_hour")) <= around, F.lit(False))
    return hour_grid(stays, los_horizon()).join(at, "stay_id").select("stay_id", "hour", near.cast("int").alias("label_value"))


def deaths(stays: DataFrame) -> DataFrame:
    """(stay_id, death_time) of stays that end with death in the unit."""
    return stays.where("mortality_in_icu").select("stay_id", F.col("discharge_time").cast("timestamp").alias("death_time"))


def _episodes(rows: DataFrame, death: DataFrame | None, window_h: int, max_gap_h: int, drop_after_death: bool) -> DataFrame:
    """rows (stay_id, starttime, endtime, ...), unique in stay and start, from whose start treatment goes on for window_h, or to death,
    with no gap above max_gap_h. One window per stay, then a fold: no self-join."""
    one = rows.withColumn("s", micros("starttime")).withColumn("e", F.greatest(micros("starttime"), F.coalesce(micros("endtime"), micros("starttime"))))
    end = F.col("s") + window_h * HOUR
    if death is not None:
        one = one.join(death, "stay_id", "left")
        one = one.where("death_time is null or starttime <= death_time") if drop_after_death else one
        end = F.least(end, micros("death_time"))
    ahead = Window.partitionBy("stay_id").orderBy("s").rangeBetween(0, window_h * HOUR)
    met = one.withColumn("end", end).withColumn("x", F.array_sort(F.collect_list(F.struct("s", "e")).over(ahead)))
    inside = F.filter("x", lambda r: r["s"] <= F.col("end")) if drop_after_death else F.col("x")
    start = F.struct(F.col("s").alias("m"), F.lit(0).cast("bigint").alias("g"))
    step = lambda a, r: F.struct(F.greatest(a["m"], r["e"]).alias("m"), F.greatest(a["g"], r["s"] - a["m"]).alias("g"))
    done = F.aggregate(inside, start, step)
    gap = F.greatest(done["g"], F.col("end") - done["m"])
    return met.where(gap <= max_gap_h * HOUR).select(*rows.columns)


def continuous_episodes(abx: DataFrame, death: DataFrame | None = None, window_h: int = 72, max_gap_h: int = 24) -> DataFrame:
    """(stay_id, starttime) of every start from which treatment goes on for window_h with no gap above max_gap_h.

    Rows of one start collapse to the last end; an end before the start becomes the start; death (stay_id,
    death_time) drops later starts and cuts the window.
    """
    one = abx.groupBy("stay_id", "starttime").agg(F.max("endtime").alias("endtime"))
    return _episodes(one, death, window_h, max_gap_h, True).select("stay_id", "starttime")


def suspected_infection(episodes: DataFrame, samples: DataFrame | None) -> DataFrame:
    """(stay_id, si): the earliest time of a pair with sample - start in [-72 h, 24 h]; without samples, every start.

    Starts and samples are laid in one order per stay; the first sample within reach of a start makes its earliest pair, so no
    pairs are made.
    """
    if samples is None:
        return episodes.select("stay_id", F.col("starttime").alias("si")).distinct()
    none = F.lit(None).cast("timestamp")
    starts = episodes.select("stay_id", micros("starttime").alias("t"), F.col("starttime").cast("timestamp").alias("start"), none.alias("sample"))
    taken = samples.where("charttime is not null").select("stay_id", micros("charttime").alias("t"), none.alias("start"), F.col("charttime").cast("timestamp").alias("sample"))
    reach = Window.partitionBy("stay_id").orderBy("t").rangeBetween(-72 * HOUR, 24 * HOUR)
    met = starts.unionByName(taken).withColumn("first", F.min("sample").over(reach)).where("start is not null and first is not null")
    return met.groupBy("stay_id").agg(F.min(F.least("start", "first")).alias("si"))


def antibiotic_episodes(meds: DataFrame, death: DataFrame | None = None, window_h: int = 72, max_gap_h: int = 24) -> DataFrame:
    """(stay_id, starttime): the starts of antibiotics among meds from which treatment goes on, one row for each row of meds.

    death (stay_id, death_time) cuts the window at death, but leaves what was charted after it.
    """
    abx = meds.where("drug_class = 'antibiotic' and starttime is not null")
    one = abx.groupBy("stay_id", "starttime").agg(F.max("endtime").alias("endtime"), F.count("*").alias("n"))
    met = _episodes(one, death, window_h, max_gap_h, False)
    return met.select("stay_id", "starttime", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("_k")).drop("_k")


def antibiotic_span(meds: DataFrame, days: int = 3) -> DataFrame:
    """(stay_id, first, span_h, long): first antibiotic of a stay, hours from it to the last start or end, and whether they are
    `days` days or more."""
    of = meds.where("drug_class = 'antibiotic'").groupBy("stay_id").agg(F.min("starttime").alias("first"), F.max(F.greatest("starttime", "endtime")).alias("last"))
    span = (micros("last") - micros("first")) / F.lit(HOUR)
    return of.select("stay_id", "first", span.alias("span_h"), (span >= 24 * days).alias("long"))


def sepsis_labels(stays: DataFrame, abx: DataFrame, sofa: DataFrame, samples: DataFrame | None, death: DataFrame | None = None) -> DataFrame:
    """Hourly sepsis labels. samples: cultures, where the source has them; without, every episode start is a suspicion."""
    onset = sepsis_onset(suspected_infection(continuous_episodes(abx, death), samples), sofa, stays)
    kept = exclude_early(stays, onset)
    return onset_labels(kept, onset.join(kept.select("stay_id"), "stay_id", "left_semi"))


def build_task(stays: DataFrame, outc: DataFrame, events: DataFrame, concepts: list[str], max_hour: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sta, dyn, outc) of a task: the cohort is the stays with an outcome."""
    cohort = stays.join(outc.select("stay_id").distinct(), "stay_id", "left_semi")
    return build_sta(cohort), build_dyn(cohort, events, concepts, max_hour), outc


def build_sta(stays: DataFrame) -> DataFrame:
    """One row per stay: age, sex_male (1, 0, or 0.5 if unknown), weight, height."""
    sex = F.lower(F.trim("sex"))
    male = F.when(sex.isin("m", "male"), 1.0).when(sex.isin("f", "female"), 0.0).otherwise(0.5)
    return stays.select("patient_id", "stay_id", F.col("age").cast("float").alias("age"), male.cast("float").alias("sex_male"), F.col("weight").cast("float").alias("weight"), F.col("height").cast("float").alias("height"))


def sepsis_onset(si: DataFrame, sofa: DataFrame, stays: DataFrame, rise: int = 2) -> DataFrame:
    """(stay_id, onset): the earliest suspected time around which (48 h before, 24 h after) the score rises enough."""
    at = si.join(stays.select("stay_id", "admit_time"), "stay_id").select("stay_id", "si", hour_index("si", "admit_time").alias("si_hour"))
    hours = at.withColumn("hour", F.explode(F.sequence(F.col("si_hour") - 48, F.col("si_hour") + 24)))
    low = F.min("sofa").over(Window.partitionBy("stay_id", "si").orderBy("hour").rowsBetween(Window.unboundedPreceding, 0))
    up = hours.join(sofa.select("stay_id", "hour", "sofa"), ["stay_id", "hour"]).withColumn("up", F.col("sofa") - low)
    return up.where(F.col("up") >= rise).groupBy("stay_id").agg(F.min("si").alias("onset"))

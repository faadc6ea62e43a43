"""Hourly organ-failure score: six component scores, each the worst of the last 24 hours, summed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardgrid.operators.timegrid import consolidate_open, hour_grid, hour_index, interval_hours

#: Fixed values: (upper bound, exclusive; points), in order.
PLATELETS = [(20, 4), (50, 3), (100, 2), (150, 1)]
GCS = [(6, 4), (10, 3), (13, 2), (15, 1)]
PAFI = [(100, 4), (200, 3), (300, 2), (400, 1)]
URINE24 = [(200, 4), (500, 3)]
#: Fixed values: (lower bound, inclusive; points), in order.
BILIRUBIN = [(12, 4), (6, 3), (2, 2), (1.2, 1)]
CREATININE = [(5, 4), (3.5, 3), (2, 2), (1.2, 1)]
#: Concepts that are carried forward, with the inputs that they become.
CARRIED = {"plt": "platelets", "bili": "bilirubin", "tgcs": "gcs", "crea": "creatinine", "map": "mean_pressure", "po2": "po2", "fio2": "fio2"}
COMPONENTS = ["resp", "coag", "liver", "cardio", "cns", "renal"]


def _points(value: Column, steps: list[tuple[float, int]], below: bool) -> Column:
    out = F.lit(0)
    for bound, points in reversed(steps):
        out = F.when((value < bound) if below else (value >= bound), points).otherwise(out)
    return out


def coagulation(platelets: Column) -> Column:
    return _points(platelets, PLATELETS, True)


def liver(bilirubin: Column) -> Column:
    return _points(bilirubin, BILIRUBIN, False)


def nervous(gcs: Column) -> Column:
    return _points(gcs, GCS, True)


def respiration(pafi: Column, ventilated: Column) -> Column:
    """Below 200 without ventilation counts as 200."""
    return _points(F.when((pafi < 200) & ~F.coalesce(ventilated, F.lit(False)), 200.0).otherwise(pafi), PAFI, True)


def renal(creatinine: Column, urine24: Column) -> Column:
    return F.greatest(_points(creatinine, CREATININE, False), _points(urine24, URINE24, True))


def cardiovascular(mean_pressure: Column, dopamine: Column, norepinephrine: Column, epinephrine: Column, strong: Column, dobutamine: Column) -> Column:
    """Rates in ug/kg/min or null; a charted rate counts, even of 0. strong and dobutamine tell whether such a drug runs at all."""
    no_rate = dopamine.isNull() & norepinephrine.isNull() & epinephrine.isNull()
    on = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when((dopamine > 15) | (norepinephrine > 0.1) | (epinephrine > 0.1), 4)
        .when((dopamine > 5) | norepinephrine.isNotNull() | epinephrine.isNotNull() | (on(strong) & no_rate), 3)
        .when(dopamine.isNotNull() | on(dobutamine), 2)
        .when(mean_pressure < 70, 1)
        .otherwise(0)
    )


def last_day(column: str | Column) -> Column:
    """Over the 24 hourly rows up to this one."""
    return F.max(column).over(Window.partitionBy("stay_id").orderBy("hour").rowsBetween(-23, 0))


def urine_of_day(hourly: str = "urine") -> Column:
    """Sum over 24 hourly rows; null if none of them has a value."""
    return F.sum(hourly).over(Window.partitionBy("stay_id").orderBy("hour").rowsBetween(-23, 0))


def urine_by_hour(events: DataFrame, stays: DataFrame) -> DataFrame:
    """(stay_id, hour, urine): sums of each hour since admission."""
    at = events.where("concept = 'urine' and value is not null").join(stays.select("stay_id", "admit_time"), "stay_id")
    return at.groupBy("stay_id", hour_index("charttime", "admit_time").alias("hour")).agg(F.sum(F.col("value").cast("double")).alias("urine"))


def pressors_by_hour(meds: DataFrame, stays: DataFrame, max_hour: Column) -> DataFrame:
    """(stay_id, hour, dopamine, norepinephrine, epinephrine, dobutamine_rate, strong, dobutamine): largest rates in ug/kg/min,
    and whether any such drug runs. Open intervals are consolidated before they are spread over hours."""
    name = F.lower("drug")
    own = meds.where("drug_class = 'vasopressor'").withColumn("kind", F.when(name.contains("dobutamine"), "dobu").when(name.contains("dopamine"), "dopa").when(name.contains("norepinephrine"), "norepi").when(name.contains("epinephrine"), "epi").otherwise("other"))
    own = own.withColumn("rate", F.when(F.col("dose_unit") == "mcg/kg/min", F.col("dose").cast("double")))
    hours = interval_hours(consolidate_open(own, ["stay_id", "kind", "rate"]), stays, max_hour)
    most = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("rate")))
    return hours.groupBy("stay_id", "hour").agg(most("dopa").alias("dopamine"), most("norepi").alias("norepinephrine"), most("epi").alias("epinephrine"), most("dobu").alias("dobutamine_rate"), F.bool_or(F.col("kind") != "dobu").alias("strong"), F.bool_or(F.col("kind") == "dobu").alias("dobutamine"))


def sofa_inputs(stays: DataFrame, events: DataFrame, meds: DataFrame, interventions: DataFrame, max_hour: Column) -> DataFrame:
    """One row per stay and hour with what sofa_per_hour() takes: carried laboratory values and vital signs, PaO2 / FiO2 (FiO2
    in per cent), ventilation, urine of the last day, vasopressors."""
    grid = hour_grid(stays, max_hour)
    wide = hourly_last(events.where(F.col("concept").isin(*CARRIED)), stays, list(CARRIED))
    order = Window.partitionBy("stay_id").orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)
    carried = grid.join(wide, ["stay_id", "hour"], "left").select("stay_id", "hour", *[F.last(c, ignorenulls=True).over(order).alias(n) for c, n in CARRIED.items()])
    vents = interval_hours(consolidate_open(interventions.where("intervention = 'mech_vent'"), ["stay_id"]), stays, max_hour).select("stay_id", "hour", F.lit(True).alias("ventilated")).distinct()
    met = carried.join(vents, ["stay_id", "hour"], "left").join(urine_by_hour(events, stays), ["stay_id", "hour"], "left").join(pressors_by_hour(meds, stays, max_hour), ["stay_id", "hour"], "left")
    pafi = F.when(F.col("fio2") > 0, F.col("po2") / (F.col("fio2") / 100.0))
    return met.select("stay_id", "hour", "platelets", "bilirubin", "gcs", "creatinine", "mean_pressure", pafi.alias("pafi"), F.coalesce("ventilated", F.lit(False)).alias("ventilated"), urine_of_day("urine").alias("urine24"), "dopamine", "norepinephrine", "epinephrine", F.coalesce("strong", F.lit(False)).alias("strong"), (F.coalesce("dobutamine", F.lit(False)) | F.col("dobutamine_rate").isNotNull()).alias("dobutamine"))


def hourly_last(events: DataFrame, stays: DataFrame, concepts: list[str]) -> DataFrame:
    """The last value of each concept in each hour, one column per concept; before admission counts as hour 0."""
    hour = F.greatest(hour_index("charttime", "admit_time"), F.lit(0))
    at = events.where("value is not null").join(stays.select("stay_id", "admit_time"), "stay_id")
    of = lambda c: F.max_by(F.when(F.col("concept") == c, F.col("value").cast("double")), F.when(F.col("concept") == c, F.struct("charttime", "value")))
    return at.groupBy("stay_id", hour.alias("hour")).agg(*[of(c).alias(c) for c in concepts])


def sofa_per_hour(inputs: DataFrame) -> DataFrame:
    """(stay_id, hour, sofa, sofa_*) from one row per stay and hour of carried inputs: platelets, bilirubin, gcs, pafi,
    ventilated, creatinine, urine24, mean_pressure, dopamine, norepinephrine, epinephrine, strong, dobutamine."""
    c = F.col
    now = {
        "resp": respiration(c("pafi"), c("ventilated")),
        "coag": coagulation(c("platelets")),
        "liver": liver(c("bilirubin")),
        "cardio": cardiovascular(c("mean_pressure"), c("dopamine"), c("norepinephrine"), c("epinephrine"), c("strong"), c("dobutamine")),
        "cns": nervous(c("gcs")),
        "renal": renal(c("creatinine"), c("urine24")),
    }
    scored = inputs.select("stay_id", "hour", *[x.alias(f"_{k}") for k, x in now.items()]).select("stay_id", "hour", *[last_day(f"_{k}").cast("int").alias(f"sofa_{k}") for k in COMPONENTS])
    return scored.withColumn("sofa", reduce(lambda a, b: a + b, [c(f"sofa_{k}") for k in COMPONENTS]))

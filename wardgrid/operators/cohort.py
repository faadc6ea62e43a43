"""The base cohort: five gates in order, and what each dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardgrid.operators.timegrid import hour_index, longest_gap, los_cap, micros

#: Gates in their order.
GATES = ["valid_times", "los", "measured_hours", "gap", "age"]
MIN_LOS, MIN_HOURS, MAX_GAP, MIN_AGE = 6.0, 4, 12, 18.0


def gated(stays: DataFrame, events: DataFrame, max_gap: int = MAX_GAP, concepts: list[str] | None = None) -> DataFrame:
    """stays with failed_at: the number of the first gate that a stay fails (null: none). One pass tags them all.

    An hour is measured if it has a value, not null, of one of the dynamic concepts (all concepts, if none are given).
    """
    known = events.where("value is not null")
    known = known if concepts is None else known.where(F.col("concept").isin(concepts))
    measured = known.join(stays.select("stay_id", "admit_time"), "stay_id").select("stay_id", hour_index("charttime", "admit_time").alias("hour"))
    gaps = longest_gap(measured, stays, los_cap())
    tagged = stays.join(gaps, "stay_id", "left")
    passes: list[Column] = [
        micros("discharge_time") > micros("admit_time"),
        F.col("los_hours") >= MIN_LOS,
        F.coalesce("n_hours", F.lit(0)) >= MIN_HOURS,
        F.col("gap") <= max_gap,
        F.col("age") >= MIN_AGE,
    ]
    failed = F.lit(None).cast("int")
    for k in reversed(range(len(passes))):
        failed = F.when(F.coalesce(passes[k], F.lit(False)), failed).otherwise(F.lit(k))
    return tagged.withColumn("failed_at", failed.cast("int")).drop("n_hours", "gap")


def base_cohort(stays: DataFrame, events: DataFrame, max_gap: int = MAX_GAP, concepts: list[str] | None = None) -> DataFrame:
    return gated(stays, events, max_gap, concepts).where("failed_at is null").drop("failed_at")


def attrition(tagged: DataFrame) -> DataFrame:
    """(step, criterion, n_before, n_after, n_dropped): one row per gate, from the tags alone."""
    spark: SparkSession = tagged.sparkSession
    steps = spark.createDataFrame(list(enumerate(GATES)), "step int, criterion string")
    counts = tagged.agg(F.count("*").alias("n"), *[F.sum(F.when(F.col("failed_at") == k, 1).otherwise(0)).alias(f"d{k}") for k in range(len(GATES))])
    dropped = F.array(*[F.coalesce(F.col(f"d{k}"), F.lit(0)) for k in range(len(GATES))])
    before = F.col("n") - F.aggregate(F.slice(dropped, F.lit(1), F.col("step")), F.lit(0).cast("long"), lambda a, x: a + x)
    out = steps.join(F.broadcast(counts)).withColumn("n_before", before).withColumn("n_dropped", F.get(dropped, F.col("step")))  # one row of counts
    return out.select("step", "criterion", "n_before", (F.col("n_before") - F.col("n_dropped")).alias("n_after"), "n_dropped")


def attrition_report(tagged: DataFrame) -> DataFrame:
    """attrition() with pct_dropped, and a last row `final` for all gates together."""
    steps = attrition(tagged)
    share = lambda: F.round(F.when(F.col("n_before") > 0, 100.0 * F.col("n_dropped") / F.col("n_before")).otherwise(0.0), 2).alias("pct_dropped")
    whole = tagged.agg(F.count("*").alias("n_before"), F.count_if(F.col("failed_at").isNull()).alias("n_after")).withColumn("n_dropped", F.col("n_before") - F.col("n_after"))
    final = whole.select(F.lit(len(GATES)).alias("step"), F.lit("final").alias("criterion"), "n_before", "n_after", "n_dropped", share())
    return steps.select("step", "criterion", "n_before", "n_after", "n_dropped", share()).unionByName(final)

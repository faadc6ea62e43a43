"""The hourly kernel: grids, as-of and interval joins, rolling windows. Time is in microseconds where it is arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR = 3_600_000_000


def micros(t: str | Column) -> Column:
    """Microseconds since the epoch of a timestamp, with or without zone (session time zone UTC)."""
    return F.unix_micros((F.col(t) if isinstance(t, str) else t).cast("timestamp"))


def hour_index(t: str | Column, origin: str | Column) -> Column:
    """floor((t - origin) / 1 h); negative before the origin."""
    return F.floor((micros(t) - micros(origin)) / F.lit(HOUR)).cast("int")


def hour_grid(stays: DataFrame, max_hour: Column) -> DataFrame:
    """(stay_id, hour) for 0..max_hour; stays without a horizon, or a negative one, have no rows."""
    return stays.withColumn("_max", max_hour.cast("int")).where("_max >= 0").select("stay_id", F.explode(F.sequence(F.lit(0), F.col("_max"))).alias("hour"))


def los_horizon(cap: int = 168) -> Column:
    return F.when(F.col("los_hours").isNotNull(), F.floor(F.greatest(F.lit(0.0), F.least(F.col("los_hours"), F.lit(float(cap))))))  # least() skips nulls


def los_cap(cap: int = 168) -> Column:
    """Hours of a stay, at most cap; null if unknown."""
    return F.when(F.col("los_hours").isNotNull(), F.greatest(F.lit(0.0), F.least(F.col("los_hours").cast("double"), F.lit(float(cap)))))  # least() skips nulls


def hourly_median(events: DataFrame, stays: DataFrame, max_hour: Column) -> DataFrame:
    """Exact median of each (stay, hour, concept) inside the horizon, in double precision."""
    at = events.join(stays.withColumn("_max", max_hour.cast("int")).select("stay_id", "admit_time", "_max"), "stay_id").withColumn("hour", hour_index("charttime", "admit_time"))
    return at.where("hour >= 0 and hour <= _max").groupBy("stay_id", "hour", "concept").agg(F.median(F.col("value").cast("double")).alias("value"))


def widen(long: DataFrame, concepts: list[str]) -> DataFrame:
    """One column per concept of a fixed list; concepts without rows are null."""
    return long.groupBy("stay_id", "hour").pivot("concept", concepts).agg(F.first("value"))


def build_dyn(stays: DataFrame, events: DataFrame, concepts: list[str], max_hour: Column) -> DataFrame:
    """Every hour of every stay with the hourly medians of the concepts."""
    wide = widen(hourly_median(events.where(F.col("concept").isin(concepts)), stays, max_hour), concepts)
    return hour_grid(stays, max_hour).join(wide, ["stay_id", "hour"], "left")


def carry_forward(grid: DataFrame, events: DataFrame, stays: DataFrame, value: str = "value") -> DataFrame:
    """grid with `carried`: the latest value up to the end of each hour (exclusive). At one time the larger value counts.

    Observations before admission belong to hour 0. One shuffle by stay: hour buckets, then a running last value.
    """
    hour = F.greatest(hour_index("charttime", "admit_time"), F.lit(0))
    last = events.join(stays.select("stay_id", "admit_time"), "stay_id").where(F.col(value).isNotNull()).groupBy("stay_id", hour.alias("hour")).agg(F.max_by(value, F.struct("charttime", value)).alias("_v"))
    w = Window.partitionBy("stay_id").orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(last, ["stay_id", "hour"], "left").withColumn("carried", F.last("_v", ignorenulls=True).over(w)).drop("_v")


def nearest(left: DataFrame, right: DataFrame, key: str, t: str, value: str) -> DataFrame:
    """left with near_value and near_t of the row of right that is nearest in time; of two equally near, the earlier.

    At one time the larger value counts. No pairs are made: both sides are laid in one order per key.
    """
    kinds = left.withColumn("_r", F.lit(None).cast(right.schema[value].dataType)).withColumn("_side", F.lit(0))
    side = right.where(F.col(value).isNotNull()).groupBy(key, t).agg(F.max(value).alias("_r")).withColumn("_side", F.lit(1))
    both = kinds.unionByName(side, allowMissingColumns=True).withColumn("_t", F.when(F.col("_side") == 1, F.struct(micros(t).alias("at"), F.col("_r").alias("v"))))
    # a row at the very time counts as before
    order = Window.partitionBy(key).orderBy(micros(t), F.desc("_side"))
    before, after = F.last("_t", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.first("_t", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    met = both.withColumn("_b", before).withColumn("_a", after).where("_side = 0")
    now = micros(t)
    use_before = F.col("_a").isNull() | (F.col("_b").isNotNull() & (now - F.col("_b.at") <= F.col("_a.at") - now))
    pick = F.when(use_before, F.col("_b")).otherwise(F.col("_a"))
    return met.select(*left.columns, pick["v"].alias("near_value"), F.timestamp_micros(pick["at"]).alias("near_t"))


def interval_hours(intervals: DataFrame, stays: DataFrame, max_hour: Column) -> DataFrame:
    """intervals, one row for each hour that they overlap: start < end of hour and end (null: open) > start of hour.

    Hours are generated, so the join with a grid is an equi-join. Reversed intervals have no hours.
    """
    at = intervals.join(stays.withColumn("_max", max_hour.cast("int")).select("stay_id", "admit_time", "_max"), "stay_id")
    s, e = (micros("starttime") - micros("admit_time")) / F.lit(HOUR), (micros("endtime") - micros("admit_time")) / F.lit(HOUR)
    lo = F.greatest(F.floor(s), F.lit(0)).cast("int")
    hi = F.least(F.coalesce(F.ceil(e) - 1, F.col("_max")), F.col("_max")).cast("int")
    return at.withColumn("_lo", lo).withColumn("_hi", hi).where("_hi >= _lo").withColumn("hour", F.explode(F.sequence("_lo", "_hi"))).drop("_lo", "_hi", "_max", "admit_time")


def occupancy_hours(aligned: DataFrame) -> DataFrame:
    """Rows (delta_h, end_delta_h), one for each hour h >= 0 with delta_h <= h <= end_delta_h; without an end, the hour
    of the event alone, and only if delta_h is a whole hour (an event inside an hour is known at none of its grid points)."""
    lo = F.greatest(F.ceil("delta_h"), F.lit(0)).cast("int")
    hi = F.when(F.col("end_delta_h").isNull(), F.floor("delta_h")).otherwise(F.floor("end_delta_h")).cast("int")
    return aligned.withColumn("_lo", lo).withColumn("_hi", hi).where("_hi >= _lo").withColumn("hour", F.explode(F.sequence("_lo", "_hi"))).drop("_lo", "_hi")


def consolidate_open(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Intervals without an end become one per group, from the first start; those with an end stay as they are."""
    open_ = intervals.where("endtime is null").groupBy(*keys).agg(F.min("starttime").alias("starttime")).withColumn("endtime", F.lit(None).cast(intervals.schema["endtime"].dataType))
    return intervals.where("endtime is not null").select(*keys, "starttime", "endtime").unionByName(open_)


def trailing(keys: list[str], t: str, hours: int) -> Window:
    """The window (t - hours, t]: open on the left, with all rows of the same time."""
    return Window.partitionBy(*keys).orderBy(micros(t)).rangeBetween(-hours * HOUR + 1, 0)


def longest_gap(measured: DataFrame, stays: DataFrame, max_hour: Column) -> DataFrame:
    """(stay_id, n_hours, gap): distinct measured hours of a stay, and the longest run of hours without one.

    max_hour is the stay's length in hours, not rounded: measured hours are those below it, and its whole part stands as the
    end of the last run, as -1 does for the beginning of the first.
    """
    base = stays.withColumn("_cap", max_hour.cast("double")).where("_cap is not null").select("stay_id", "_cap")
    hours = measured.select("stay_id", "hour").distinct().join(base, "stay_id").where("hour >= 0 and hour < _cap").withColumn("real", F.lit(1))
    ends = base.select("stay_id", F.explode(F.array(F.lit(-1), F.floor("_cap").cast("int"))).alias("hour"), F.lit(0).alias("real"))
    w = Window.partitionBy("stay_id").orderBy("hour")
    gaps = hours.select("stay_id", "hour", "real").unionByName(ends).withColumn("gap", F.col("hour") - F.lag("hour").over(w) - 1)
    return gaps.groupBy("stay_id").agg(F.sum("real").cast("long").alias("n_hours"), F.greatest(F.max("gap"), F.lit(0)).cast("int").alias("gap"))

"""Train-fitted preprocessing: masks, imputation, scaling, history features, packed sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def in_order() -> WindowSpec:
    return Window.partitionBy("stay_id").orderBy("hour")


def so_far() -> WindowSpec:
    return in_order().rowsBetween(Window.unboundedPreceding, 0)


def missing_mask(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select("*", *[F.col(c).isNull().cast("int").alias(f"{c}_is_null") for c in columns])


EXACT = 200_000  # distinct values among which a median is looked up at last
NEAR = 0.001  # share of rows to either side of the middle that is kept at each step


def medians(rows: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """Exact medians of several columns without a task that holds all their values; None for a column without values.

    A sketch gives each column two bounds around its middle; the values below are counted, and the step is repeated with those
    between, until they are few distinct ones, whose counts are then added up in order. Nothing but bounds and counts reaches
    the driver.
    """
    of = rows.select(*[F.col(c).cast("double").alias(c) for c in columns])
    n = of.agg(*[F.count(c).alias(c) for c in columns]).first().asDict() if columns else {}
    # per column: values below the bounds so far, and the condition that holds between them
    below, inside = dict.fromkeys(columns, 0), {c: F.col(c).isNotNull() for c in columns}
    left, found = [c for c in columns if n[c]], {c: None for c in columns}
    while left:
        kept = {c: F.when(inside[c], F.col(c)) for c in left}
        facts = of.agg(*[F.struct(F.count(kept[c]).alias("n"), F.approx_count_distinct(kept[c]).alias("d")).alias(c) for c in left]).first().asDict()
        ready = [c for c in left if facts[c]["d"] <= EXACT]
        if ready:
            found |= _middle(of, {c: kept[c] for c in ready}, {c: ((n[c] - 1) // 2 - below[c], n[c] // 2 - below[c]) for c in ready})
        left = [c for c in left if c not in ready]
        if left:
            middle = {c: ((n[c] - 1) // 2 - below[c] + 0.5) / facts[c]["n"] for c in left}
            bounds = of.agg(*[F.percentile_approx(kept[c], [max(0.0, middle[c] - NEAR), min(1.0, middle[c] + NEAR)], 10_000).alias(c) for c in left]).first().asDict()
            less = of.agg(*[F.count_if(inside[c] & (F.col(c) < bounds[c][0])).alias(f"a{i}") for i, c in enumerate(left)], *[F.count_if(inside[c] & (F.col(c) <= bounds[c][1])).alias(f"b{i}") for i, c in enumerate(left)]).first()
            for i, c in enumerate(left):
                low, high = (n[c] - 1) // 2 - below[c], n[c] // 2 - below[c]
                if less[f"a{i}"] <= low:  # the middle is not below the lower bound: sketches may miss by a little
                    inside[c] = inside[c] & (F.col(c) >= bounds[c][0])
                    below[c] += less[f"a{i}"]
                if less[f"b{i}"] > high:
                    inside[c] = inside[c] & (F.col(c) <= bounds[c][1])
    return found


def _middle(of: DataFrame, kept: dict[str, Column], ranks: dict[str, tuple[int, int]]) -> dict[str, float]:
    """The mean of the values at two ranks (from 0) of each column; at most EXACT distinct values of each are in order in one task."""
    long = of.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), v.alias("v")) for c, v in kept.items()])).alias("x")).select("x.*").where("v is not null")
    upto = F.sum("n").over(Window.partitionBy("c").orderBy("v"))
    counts = long.groupBy("c", "v").agg(F.count("*").alias("n")).withColumn("upto", upto)
    at = F.create_map(*[x for c, (low, high) in ranks.items() for x in (F.lit(c), F.array(F.lit(low), F.lit(high)))])[F.col("c")]
    pick = counts.groupBy("c").agg(F.min(F.when(F.col("upto") > at[0], F.col("v"))).alias("a"), F.min(F.when(F.col("upto") > at[1], F.col("v"))).alias("b"))
    return {r.c: (r.a + r.b) / 2 for r in pick.collect()}


def train_stats(rows: DataFrame, train: DataFrame, columns: list[str], median: bool = True) -> DataFrame:
    """One row: mean, population deviation, least, most and, if asked, the exact median of each column over the train stays."""
    of = rows.join(train.select("stay_id").distinct(), "stay_id", "left_semi")
    each = [(F.avg, "mean"), (F.stddev_pop, "std"), (F.min, "min"), (F.max, "max")]
    stats = of.agg(*[f(F.col(c).cast("double")).alias(f"{c}_{name}") for c in columns for f, name in each])
    middle = medians(of, columns) if median else {}
    return stats.select("*", *[F.lit(v).cast("double").alias(f"{c}_median") for c, v in middle.items()])


def with_stats(rows: DataFrame, stats: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(stats))  # stats is one row


def impute(rows: DataFrame, stats: DataFrame, columns: list[str], fallback: str = "median") -> DataFrame:
    """Forward fill within a stay, then the train statistic."""
    filled = with_stats(rows, stats).select(*[c for c in rows.columns if c not in columns], *[F.coalesce(F.last(c, ignorenulls=True).over(so_far()).cast("double"), F.col(f"{c}_{fallback}")).alias(c) for c in columns])
    return filled.select(*rows.columns)


def _scaled(c: str, centre: Column, width: Column) -> Column:
    return ((F.col(c) - centre) / F.when(width > 0, width).otherwise(1.0)).alias(c)


def standard_scale(rows: DataFrame, stats: DataFrame, columns: list[str]) -> DataFrame:
    return with_stats(rows, stats).select(*[_scaled(c, F.col(f"{c}_mean"), F.col(f"{c}_std")) if c in columns else F.col(c) for c in rows.columns])


def minmax_scale(rows: DataFrame, stats: DataFrame, columns: list[str]) -> DataFrame:
    """Fitted on train values as measured, whose mean fill leaves both ends where they are."""
    return with_stats(rows, stats).select(*[_scaled(c, F.col(f"{c}_min"), F.col(f"{c}_max") - F.col(f"{c}_min")) if c in columns else F.col(c) for c in rows.columns])


def preprocess(rows: DataFrame, train: DataFrame, columns: list[str], history: bool = False, static: DataFrame | None = None, static_columns: list[str] | None = None) -> DataFrame:
    """Mask, forward fill, train mean, train min-max; then expanding statistics of the scaled values if asked, and the static columns
    (of static, one row per stay), filled and scaled alike. A column without train values is 0."""
    stats = train_stats(rows, train, columns, median=False).fillna(0.0)
    ready = minmax_scale(impute(missing_mask(rows, columns), stats, columns, "mean"), stats, columns)
    ready = history_features(ready, columns) if history else ready
    return ready if static is None else ready.join(scaled_static(static, train, static_columns or [c for c in static.columns if c != "stay_id"]), "stay_id", "left")


def scaled_static(static: DataFrame, train: DataFrame, columns: list[str]) -> DataFrame:
    """(stay_id, columns): train mean where missing, then train min-max."""
    stats = train_stats(static, train, columns, median=False).fillna(0.0)
    filled = with_stats(static, stats).select("stay_id", *[F.coalesce(F.col(c).cast("double"), F.col(f"{c}_mean")).alias(c) for c in columns])
    return minmax_scale(filled, stats, columns)


def history_features(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Expanding max, min, mean and row number of each column within a stay."""
    made = [(F.max, "max"), (F.min, "min"), (F.avg, "mean")]
    return rows.select("*", *[f(c).over(so_far()).alias(f"{c}_{n}") for c in columns for f, n in made], *[F.row_number().over(in_order()).alias(f"{c}_count") for c in columns])


#: Aggregates of concepts whose hours are no medians.
HOW = {"urine": "sum", "abx": "any"}


def historical(events: DataFrame, how: dict[str, str] | None = None, default: str = "median") -> DataFrame:
    """(stay_id, hour_start, concept, value): clock-aligned hours, each concept by its own aggregate (HOW if None)."""
    how = HOW if how is None else how
    v, by = F.col("value").cast("double"), F.struct("charttime", "value")
    made = {"median": F.median(v), "mean": F.avg(v), "sum": F.sum(v), "any": F.max((F.col("value") != 0).cast("double")), "max": F.max(v), "min": F.min(v), "count": F.count(v).cast("double"), "first": F.min_by(v, by), "last": F.max_by(v, by), "mode": F.mode(v, True)}
    groups = events.groupBy("stay_id", F.date_trunc("hour", F.col("charttime").cast("timestamp")).alias("hour_start"), "concept").agg(*[x.alias(f"_{n}") for n, x in made.items() if n in {*how.values(), default}])
    pick = F.col(f"_{default}")
    for concept, name in how.items():
        pick = F.when(F.col("concept") == concept, F.col(f"_{name}")).otherwise(pick)
    return groups.select("stay_id", "hour_start", "concept", pick.alias("value"))


def last_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row per stay: the last non-null value of each column."""
    return rows.groupBy("stay_id").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("hour"))).alias(c) for c in columns])


def pack_sequences(rows: DataFrame, columns: list[str], length: int) -> DataFrame:
    """(stay_id, vectors, mask): `length` hourly vectors per stay, padded with zeros; rows beyond are an error."""
    step = F.struct("hour", F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]).alias("v"))
    one = rows.groupBy("stay_id").agg(F.transform(F.array_sort(F.collect_list(step)), lambda s: s["v"]).alias("v"))
    n = F.size("v")
    fits = F.when(n <= length, n).otherwise(F.raise_error(F.lit(f"a stay is longer than {length}")).cast("int"))
    pad = F.array_repeat(F.array_repeat(F.lit(0.0), len(columns)), F.lit(length) - fits)
    return one.select("stay_id", F.concat("v", pad).alias("vectors"), F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(length) - n)).alias("mask"))


def class_weights(labels: DataFrame) -> DataFrame:
    """labels with weight n / (classes * count of its class)."""
    per = labels.groupBy("label").agg(F.count("*").alias("_n"))
    total = per.agg(F.sum("_n").alias("_all"), F.count("*").alias("_k"))
    return labels.join(per, "label").join(F.broadcast(total)).withColumn("weight", F.col("_all") / (F.col("_k") * F.col("_n"))).drop("_n", "_all", "_k")

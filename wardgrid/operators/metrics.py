"""Scores of predictions, and summaries over runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardgrid.sources.staging import kept

BUCKETS = 256


def _tied(scored: DataFrame) -> DataFrame:
    """(score, pos, neg): one row per distinct score, so ties are exact and later sorts are small."""
    return scored.where("y is not null and score is not null").groupBy("score").agg(F.sum(F.col("y").cast("long")).alias("pos"), F.sum(1 - F.col("y").cast("long")).alias("neg"))


def _running(tied: DataFrame, order: str) -> DataFrame:
    """tied with upto_pos and upto_neg: sums over all scores up to this one in the given order.

    Scores are cut into BUCKETS ranges by approximate quantiles; sums of whole buckets come first, then a window in each
    bucket, so no task holds all scores. tied is written once, as it is read three times.
    """
    tied = kept(tied, "tied")
    cuts = tied.agg(F.percentile_approx(order, [k / BUCKETS for k in range(1, BUCKETS)], 10_000).alias("_cuts"))  # one row
    at = tied.join(F.broadcast(cuts)).withColumn("_b", F.size(F.filter("_cuts", lambda c: c < F.col(order)))).drop("_cuts")
    earlier = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # BUCKETS rows
    sums = at.groupBy("_b").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).select("_b", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_{c}") for c in "pn"])
    inside = Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return at.join(F.broadcast(sums), "_b").select(*tied.columns, (F.col("_p") + F.sum("pos").over(inside)).alias("upto_pos"), (F.col("_n") + F.sum("neg").over(inside)).alias("upto_neg"))


def auroc(scored: DataFrame) -> DataFrame:
    """(n, n_pos, auroc) from (y, score): rank sum with tied ranks; null if one class is missing."""
    won = _running(_tied(scored), "score").withColumn("won", F.col("pos") * (F.col("upto_neg") - F.col("neg") / 2))
    pos, neg = F.sum("pos"), F.sum("neg")
    return won.agg((pos + neg).alias("n"), pos.alias("n_pos"), F.when((pos > 0) & (neg > 0), F.sum("won") / (pos * neg)).alias("auroc"))


def curve(scored: DataFrame) -> DataFrame:
    """(score, tp, fp): counts at or above each threshold, for ROC and precision-recall curves."""
    down = _running(_tied(scored).withColumn("down", -F.col("score").cast("double")), "down")
    return down.select("score", "pos", F.col("upto_pos").alias("tp"), F.col("upto_neg").alias("fp"))


def average_precision(scored: DataFrame) -> DataFrame:
    """(n_pos, average_precision): precision at each threshold, weighted by its gain in recall."""
    return curve(scored).agg(F.sum("pos").alias("n_pos"), (F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.when(F.sum("pos") > 0, F.sum("pos"))).alias("average_precision"))


def calibration(scored: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n, mean_score, share) over uniform, right-closed bins; empty bins are absent."""
    at = F.least(F.greatest(F.ceil(F.col("score") * bins) - 1, F.lit(0)), F.lit(bins - 1)).cast("int")
    return scored.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.avg(F.col("y").cast("double")).alias("share"))


def regression(scored: DataFrame) -> DataFrame:
    """(n, mae, mse, rmse, r2) from (y, score)."""
    e = F.col("y").cast("double") - F.col("score")
    return scored.agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.sum(e * e) / (F.var_pop("y") * F.count("*"))).alias("r2"))


def accuracy(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(accuracy, balanced_accuracy) of binary predictions."""
    hit, y = ((F.col("score") >= threshold).cast("int") == F.col("y")).cast("double"), F.col("y")
    return scored.agg(F.avg(hit).alias("accuracy"), ((F.avg(F.when(y == 1, hit)) + F.avg(F.when(y == 0, hit))) / 2).alias("balanced_accuracy"))


def js_divergence(p: DataFrame, q: DataFrame) -> DataFrame:
    """Jensen-Shannon divergence (nats) of two tables (key, w), each normalised to sum 1."""
    norm = lambda d, n: d.join(F.broadcast(d.agg(F.sum("w").alias("_s")))).select("key", (F.col("w") / F.col("_s")).alias(n))
    both = norm(p, "p").join(norm(q, "q"), "key", "full").fillna(0.0)
    m = (F.col("p") + F.col("q")) / 2
    half = lambda c: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / m)).otherwise(0.0)
    return both.agg((F.sum(half("p") + half("q")) / 2).alias("jsd"))


def grid_summary(runs: DataFrame, by: list[str], seeds: int = 3) -> DataFrame:
    """Mean, sample deviation and number of runs of each cell, and whether it has too few seeds."""
    return runs.groupBy(*by).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.count("*").alias("n"), (F.count_distinct("seed") < seeds).alias("under_seeded"))


#: What errors of the tasks that are regressions are divided by.
SCALES = {"los": 168.0, "kidney_function": 15.0}
#: Tasks that are classifications, rungs that are kept, and what names models that are not compared.
CLASSIFICATIONS, RUNGS = ["sepsis", "aki", "mortality24"], ["icd", "notes", "icd_notes"]
FOUNDATION = r"^(MOMENT|Mantis|Chronos|Toto|CM-EHR|ETHOS)|-probe|-ft"


def grid_report(runs: DataFrame) -> DataFrame:
    """Cells of runs (task, dataset, model, seed, value, fold_sha): mean, deviation (0 of one run), number, for regressions the mean and
    deviation by their scale, whether the cell has fewer runs than the best one, and how many fold hashes it has."""
    per = runs.groupBy("task", "dataset", "model").agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"), F.count("*").alias("n"), F.count_distinct(F.nullif("fold_sha", F.lit(""))).alias("n_fold_shas"))
    scale = F.lit(None).cast("double")
    for task, by in SCALES.items():
        scale = F.when(F.col("task") == task, by).otherwise(scale)
    most = per.agg(F.max("n").alias("_most"))  # one row
    return per.crossJoin(F.broadcast(most)).select("task", "dataset", "model", "mean", "std", "n", (F.col("mean") / scale).alias("scaled_mean"), (F.col("std") / scale).alias("scaled_std"), (F.col("n") < F.col("_most")).alias("under_seeded"), "n_fold_shas")


def flat_grid(report: DataFrame) -> DataFrame:
    """(task, dataset, label, metric, seed_mean, n_seeds) of a report whose models may carry a rung after '__': foundation models,
    ablations and other rungs are left out, a rung becomes '+rung', and of equal labels the first model counts."""
    parts = F.split("model", "__", 2)
    rung = F.get(parts, F.lit(1))
    named = report.withColumn("_model", parts[0]).withColumn("_rung", rung).where(~F.col("_model").rlike(FOUNDATION) & (F.col("_rung").isNull() | (F.col("_rung").isin(RUNGS) & ~F.col("_rung").contains("abl"))))
    label = F.concat("_model", F.coalesce(F.concat(F.lit("+"), "_rung"), F.lit("")))
    metric = F.when(F.col("task").isin(CLASSIFICATIONS), "AUROC").otherwise("MAE")
    first = lambda c: F.min_by(c, "model")
    return named.groupBy("task", "dataset", label.alias("label"), metric.alias("metric")).agg(first("mean").alias("seed_mean"), first("n").alias("n_seeds"))


def top_k_accuracy(scored: DataFrame, k: int) -> DataFrame:
    """(n, accuracy): how often the class y is among the k highest of scores, an array by class; of equal scores the lower class comes
    first."""
    mine = F.get("scores", F.col("y").cast("int"))
    above = F.size(F.filter(F.transform("scores", lambda s, i: (s > mine) | ((s == mine) & (i < F.col("y")))), lambda x: x))
    return scored.where("y is not null").agg(F.count("*").alias("n"), F.avg((above < k).cast("double")).alias("accuracy"))

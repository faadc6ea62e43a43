"""Aligned views of timed streams for a task, their coverage, labelled sequences, and exports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardgrid.functions import clean
from wardgrid.operators import align
from wardgrid.operators.blocks import merge_block
from wardgrid.operators.prep import last_rows
from wardgrid.operators.streams import STAY_BOUND, with_split

ALIGNMENTS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {"diagnoses": align.align_diagnoses, "notes": align.align_notes, "treatments": align.align_treatments}


def with_admission(stays: DataFrame, admissions: DataFrame, dataset: str) -> DataFrame:
    """stays with hadm_id, the hospital admission of each one, as text; null for datasets whose rows belong to one stay.

    admissions is (stay_id, hadm_id); ids of either side may lack the dataset's prefix.
    """
    if dataset in STAY_BOUND:
        return stays.withColumn("hadm_id", F.lit(None).cast("string"))
    own = admissions.select(clean.stay_key(F.col("stay_id"), dataset).alias("_key"), F.col("hadm_id").cast("string").alias("hadm_id")).groupBy("_key").agg(F.min("hadm_id").alias("hadm_id"))
    return stays.withColumn("_key", clean.stay_key(F.col("stay_id"), dataset)).join(own, "_key", "left").drop("_key")


def aligned_view(stream: DataFrame, stays: DataFrame, splits: DataFrame, dataset: str, kind: str) -> DataFrame:
    """The rows of a stream that a task may see, with the split of their stay; stays without a split are left out.

    kind is one of ALIGNMENTS; stays is canonical, for notes with hadm_id; splits is (stay_id, split).
    """
    extra = [c for c in ("hadm_id",) if c in stays.columns]
    cohort = stays.select("patient_id", "stay_id", F.col("admit_time").alias("intime"), F.col("discharge_time").alias("outtime"), *extra)
    typed = stream.withColumn("bound_stay_id", F.col("bound_stay_id").cast("string"))
    return with_split(ALIGNMENTS[kind](typed, cohort), splits, dataset)


def coverage_report(view: DataFrame, cohort: DataFrame, task: str, dataset: str, types: list[str], depth: str | None = None, flag: str | None = None) -> DataFrame:
    """One row: how many stays of the cohort a view covers, its rows and rows per covered stay, and the rows of each value of types
    (a map for each, such as origin or treatment). depth adds the mean over covered stays of 1 + its maximum (prior visits), flag
    the number of rows where it holds.
    """
    most = [F.max(depth).alias("_d")] if depth else []
    per = view.groupBy("stay_id").agg(F.count("*").alias("_n"), *most, *([F.count_if(F.col(flag)).alias("_f")] if flag else []))
    facts = per.agg(F.count("*").alias("n_stays"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), *([F.coalesce(F.avg(F.col("_d") + 1), F.lit(0.0)).alias("mean_depth")] if depth else []), *([F.coalesce(F.sum("_f"), F.lit(0)).alias("n_flagged")] if flag else []))
    out = facts.crossJoin(cohort.agg(F.count_distinct("stay_id").alias("n_cohort")))  # one row each
    for column in types:
        counts = view.groupBy(column).agg(F.count("*").alias("n")).where(F.col(column).isNotNull())
        out = out.crossJoin(counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "n")))).alias(f"by_{column}")))  # one entry a type
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return out.select(F.lit(task).alias("task"), F.lit(dataset).alias("dataset"), "n_cohort", "n_stays", ratio("n_stays", "n_cohort").alias("share"), "n_rows", ratio("n_rows", "n_stays").alias("mean_rows"), *[c for c in ("mean_depth", "n_flagged") if c in out.columns], *[f"by_{c}" for c in types])


def pack_labelled(rows: DataFrame, outcomes: DataFrame, columns: list[str], length: int) -> DataFrame:
    """(stay_id, vectors, labels, mask): `length` hourly vectors per stay with their labels; what is beyond is an error.

    outcomes is (stay_id, label), one for each stay, whose label stands at the last step; or (stay_id, hour, label). Steps without a
    label have -1 and no mask, padded ones zeros and no mask.
    """
    hourly = "hour" in outcomes.columns
    label = F.col("label").cast("double")
    met = rows.join(outcomes.select("stay_id", *(["hour"] if hourly else []), label.alias("_label")), ["stay_id", "hour"] if hourly else "stay_id", "left")
    step = F.struct("hour", F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]).alias("v"), F.col("_label").alias("label"))
    one = met.groupBy("stay_id").agg(F.array_sort(F.collect_list(step), lambda a, b: a["hour"] - b["hour"]).alias("s"))  # at most `length` entries
    n = F.size("s")
    known = F.transform("s", lambda x, i: F.when(F.lit(hourly) | (i == n - 1), x["label"]))
    fits = F.when(n <= length, n).otherwise(F.raise_error(F.lit(f"a stay is longer than {length}")).cast("int"))
    pad = F.lit(length) - fits
    return one.withColumn("k", known).select(
        "stay_id", F.concat(F.transform("s", lambda x: x["v"]), F.array_repeat(F.array_repeat(F.lit(0.0), len(columns)), pad)).alias("vectors"),
        F.concat(F.transform("k", lambda x: F.coalesce(x, F.lit(-1.0))), F.array_repeat(F.lit(0.0), pad)).alias("labels"),
        F.concat(F.transform("k", lambda x: x.isNotNull().cast("int")), F.array_repeat(F.lit(0), pad)).alias("mask"),
    )


def flat_matrix(features: DataFrame, outcomes: DataFrame, columns: list[str]) -> DataFrame:
    """(stay_id[, hour], columns, label): features beside their labels. With one outcome per stay, the last value of each column; with
    outcomes by hour, the rows of both."""
    if "hour" in outcomes.columns:
        return features.select("stay_id", "hour", *columns).join(outcomes.select("stay_id", "hour", "label"), ["stay_id", "hour"])
    return last_rows(features, columns).join(outcomes.select("stay_id", "label"), "stay_id")


def augment(features: DataFrame, blocks: dict[str, DataFrame]) -> DataFrame:
    """features with all blocks, each by (stay_id, hour) where it has hours, else by stay."""
    for name, block in blocks.items():
        features = merge_block(features, block, ["stay_id", "hour"] if "hour" in block.columns else ["stay_id"], name)
    return features


def codes_only(features: DataFrame, blocks: dict[str, DataFrame]) -> DataFrame:
    """The keys of features with the block of codes in place of all other columns; without that block, features."""
    return merge_block(features.select("stay_id", "hour"), blocks["icd"], ["stay_id"], "icd") if "icd" in blocks else features


#: Ways to lay blocks on features: name -> (features, blocks) -> features. Callers may add their own.
STRATEGIES: dict[str, Callable[[DataFrame, dict[str, DataFrame]], DataFrame]] = {"feature_augmentation": augment, "icd_only": codes_only}

#: Labels of tasks: name -> (tables) -> (patient_id, stay_id, label_time or hour, label_value). Callers add theirs by register_labels.
LABELS: dict[str, Callable[[dict[str, DataFrame], str], DataFrame]] = {}
LABEL_COLUMNS = ["stay_id", "label_value"]


def register_labels(name: str) -> Callable[[Callable[[dict[str, DataFrame], str], DataFrame]], Callable[[dict[str, DataFrame], str], DataFrame]]:
    """Adds a label builder (tables, dataset) -> labels under a name, which has to be new."""

    def add(build: Callable[[dict[str, DataFrame], str], DataFrame]) -> Callable[[dict[str, DataFrame], str], DataFrame]:
        if name in LABELS:
            raise ValueError(f"{name} has labels already")
        LABELS[name] = build
        return build

    return add


def labels_of(name: str, tables: dict[str, DataFrame], dataset: str) -> DataFrame:
    """The labels of a registered task; those that lack a column of LABEL_COLUMNS are an error."""
    if name not in LABELS:
        raise KeyError(f"no labels for {name}; known: {sorted(LABELS)}")
    out = LABELS[name](tables, dataset)
    gone = [c for c in LABEL_COLUMNS if c not in out.columns]
    if gone:
        raise ValueError(f"{name}: labels without {gone}")
    return out


def weight_deviations(stays: DataFrame, task: str, by: str = "dataset", default_kg: float = 75.0) -> DataFrame:
    """(task, by, n_missing, n_stays, detail) where stays lack a weight, for which the default stands."""
    per = stays.groupBy(by).agg(F.count_if(F.col("weight").isNull()).alias("n_missing"), F.count("*").alias("n_stays")).where("n_missing > 0")
    said = F.format_string(f"%d/%d stays had no weight; {default_kg:g} kg was used", F.col("n_missing"), F.col("n_stays"))
    return per.select(F.lit(task).alias("task"), by, "n_missing", "n_stays", said.alias("detail"))


def benchmark_layout(sta: DataFrame, dyn: DataFrame, outc: DataFrame, stays: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sta, dyn, outc) as a benchmark lays them out: sta with the sex as the source has it, dyn by time for hour, outc as
    (stay_id, time, label): the hour, or the label's time, and a label that is true or false where it is 0 or 1."""
    sex = stays.select("stay_id", F.col("sex").alias("sex"))
    out_sta = sta.drop("sex", "sex_male", "patient_id").join(sex, "stay_id", "left")
    out_dyn = dyn.withColumnRenamed("hour", "time")
    time: Column = F.col("hour") if "hour" in outc.columns else F.col("label_time")
    kind = outc.schema["label_value"].dataType.typeName()
    label = (F.col("label_value") == 1) if kind in ("byte", "short", "integer", "long", "boolean") else F.col("label_value")
    return out_sta, out_dyn, outc.select("stay_id", time.alias("time"), label.alias("label"))

"""Modality blocks to be joined to hourly features: codes, notes and treatments, all fitted on train stays alone.

Principal components are found from sums that Spark adds up (means, then products of centred vectors); only the matrix of
dimensions by dimensions, whose size no table changes, is decomposed on the driver. Vectors are reduced before they are laid on
hours, so wide vectors never meet the grid.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from wardgrid.operators.blocks import mean_pool, running_pool, vocabulary
from wardgrid.operators.timegrid import occupancy_hours

#: Treatments that are there or not, those with a dose, and those kept from a task as its label holds them.
OCCUPANCY = ["vasopressor", "mech_vent", "niv", "rrt", "sedation", "antibiotic"]
DOSES = ["vasopressor_nee", "sedation_rate", "peep", "insulin"]
WITHHELD = {"sepsis": ["antibiotic", "vasopressor", "vasopressor_nee", "mech_vent", "niv"], "aki": ["rrt"], "kidney_function": ["rrt"]}


@dataclass(frozen=True)
class Reduction:
    """A fitted linear map: (vector - mean) @ axes.T / scale. variance: what each axis explains; total: of all dimensions."""

    mean: np.ndarray
    axes: np.ndarray
    scale: np.ndarray
    variance: np.ndarray
    total: float
    rows: int


def _products(rows: DataFrame, vector: str, mean: np.ndarray) -> np.ndarray:
    """Sum of outer products of the centred vectors. Each task adds up its own; its rows are then added by their place, first
    within groups of tasks, so no task reads a matrix from every other."""
    shared = rows.sparkSession.sparkContext.broadcast(mean)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(shared.value), len(shared.value)))
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1) - shared.value
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "s"])

    def added(key: tuple, parts: pa.Table) -> pa.Table:
        s = parts.column("s").combine_chunks()
        return pa.table({"i": pa.array([key[0].as_py()], pa.int32()), "s": pa.array([s.flatten().to_numpy().reshape(len(s), -1).sum(0).tolist()], pa.list_(pa.float64()))})

    each = rows.select(F.col(vector).cast("array<double>")).mapInArrow(partial, "i int, s array<double>").withColumn("g", F.spark_partition_id() % 64)
    sums = each.groupBy("i", "g").applyInArrow(added, "i int, s array<double>").groupBy("i").applyInArrow(added, "i int, s array<double>")
    return np.array([r.s for r in sums.orderBy("i").collect()])  # dimensions by dimensions


def _sums(rows: DataFrame, vector: str) -> DataFrame:
    """(pos, n, s): how many vectors have each position, and their sum there. Each task adds up its own, one row a position."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(0, np.int64), np.zeros(0)
        for b in batches:
            if len(b):
                ends = b.column(0).offsets.to_numpy()
                place = np.arange(ends[-1] - ends[0]) - np.repeat(ends[:-1] - ends[0], np.diff(ends))
                most = max(int(np.diff(ends).max()), len(n))
                n, total = np.pad(n, (0, most - len(n))), np.pad(total, (0, most - len(total)))
                n += np.bincount(place, minlength=most)
                total += np.bincount(place, b.column(0).flatten().to_numpy(zero_copy_only=False), most)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n), dtype=np.int32)), pa.array(n), pa.array(total)], ["pos", "n", "s"])

    each = rows.select(F.col(vector).cast("array<double>")).mapInArrow(partial, "pos int, n long, s double")
    return each.groupBy("pos").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def fit_reduction(train: DataFrame, vector: str, components: int | None) -> Reduction:
    """Principal components of the vectors of train, each to be scaled to a deviation of 1; None: every dimension for itself.

    At most as many components as train has rows or dimensions. An axis points to where its largest part is positive, the first of equal ones. Rows
    without a vector are left out; no row is an error, as fitting on others would leak.
    """
    known = train.where(F.col(vector).isNotNull())
    sums = _sums(known, vector).orderBy("pos").collect()  # one row a dimension
    if not sums:
        raise ValueError("no train stay has a vector")
    if len({r.n for r in sums}) > 1:
        raise ValueError("vectors differ in length")
    n, mean = sums[0].n, np.array([r.s / r.n for r in sums])
    products = _products(known, vector, mean)
    spread = np.diag(products) / n
    if components is None:
        return Reduction(mean, np.eye(len(mean)), np.where(spread > 0, np.sqrt(spread), 1.0), spread, float(spread.sum()), n)
    values, vectors = np.linalg.eigh(products)
    keep = np.argsort(-values, kind="stable")[: max(1, min(components, n, len(mean)))]
    axes = vectors[:, keep].T
    size = np.abs(axes)
    largest = (size >= size.max(1, keepdims=True) * (1 - 1e-9)).argmax(1)  # the first of equal ones
    axes *= np.sign(axes[np.arange(len(axes)), largest])[:, None]
    values = np.maximum(values[keep], 0.0)
    deviation = np.sqrt(values / n)
    free = max(n - 1, 1)
    return Reduction(mean, axes, np.where(deviation > 1e-12 * max(deviation.max(), 1e-300), deviation, 1.0), values / free, float(np.trace(products) / free), n)


def reduced(rows: DataFrame, vector: str, fit: Reduction) -> DataFrame:
    """rows with their vectors in the fitted coordinates, in single precision; rows without a vector are left out."""
    shared = rows.sparkSession.sparkContext.broadcast(fit)
    others = [c for c in rows.columns if c != vector]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for b in batches:
            x = b.column(len(others)).flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1) if len(b) else np.zeros((0, len(f.mean)))
            y = ((x - f.mean) @ f.axes.T / f.scale).astype(np.float32)
            ends = pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(others)], pa.ListArray.from_arrays(ends, pa.array(y.ravel()))], [*others, vector])

    schema = StructType([*(rows.schema[c] for c in others), StructField(vector, ArrayType(FloatType()))])
    return rows.where(F.col(vector).isNotNull()).select(*others, F.col(vector).cast("array<double>")).mapInArrow(run, schema)


def _train_rows(rows: DataFrame, train: DataFrame) -> DataFrame:
    """rows of train stays; a warning if they are less than half, as ids of two kinds look like that."""
    chosen = rows.join(train.select("stay_id").distinct(), "stay_id", "left_semi")
    n, of = chosen.count(), rows.count()
    if n < 0.5 * of:
        warnings.warn(f"only {n} of {of} rows of the block are of train stays: do the ids of stays agree?", RuntimeWarning, stacklevel=3)
    return chosen


def _named(vector: str, names: list[str]) -> list[Column]:
    return [F.get(F.col(vector), F.lit(i)).alias(name) for i, name in enumerate(names)]


def notes_block(notes: DataFrame, embeddings: DataFrame, train: DataFrame, grid: DataFrame | None = None, cutoff: float | None = None, components: int | None = 64, half_life: float = float("inf")) -> DataFrame:
    """(stay_id[, hour], note__0.., notes_present): pooled vectors of the visible notes, reduced and scaled by train stays.

    notes (stay_id, delta_h, note_id) are visible from delta_h on; embeddings is (note_id, embedding). With grid (stay_id, hour)
    each hour has the state of all notes up to it, the later weighing more by half_life; hours before a stay's first note are
    left out. With cutoff each stay has one row, of the notes up to it. No visible note gives no row.
    """
    if (grid is None) == (cutoff is None):
        raise ValueError("give either a grid or a cutoff")
    met = notes.select("stay_id", F.col("delta_h").cast("double").alias("delta_h"), "note_id").where("delta_h is not null").join(embeddings.select("note_id", "embedding"), "note_id")
    if grid is None:
        fades = None if half_life == float("inf") else half_life
        cells = mean_pool(met.where(F.col("delta_h") <= cutoff), "stay_id", at="delta_h", half_life=fades)
        states = cells.groupBy("stay_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda c: c["value"]).alias("pooled"))  # one entry a dimension
    else:
        states = running_pool(met, "stay_id", "delta_h", half_life)
    if states.isEmpty():
        key = ["stay_id"] if grid is None else ["stay_id", "hour"]
        of = notes if grid is None else grid
        return of.select(*key, F.lit(1.0).cast("float").alias("notes_present")).limit(0)
    fit = fit_reduction(_train_rows(states, train), "pooled", components)
    small = reduced(states, "pooled", fit)
    names = [f"note__{i}" for i in range(len(fit.axes))]
    present = F.lit(1.0).cast("float").alias("notes_present")
    if grid is None:
        return small.select("stay_id", *_named("pooled", names), present)
    return as_of_hours(small.withColumnRenamed("at", "delta_h"), grid, "pooled").select("stay_id", "hour", *_named("pooled", names), present)


def as_of_hours(states: DataFrame, grid: DataFrame, value: str) -> DataFrame:
    """(stay_id, hour, value): the latest state with delta_h <= hour; hours before the first are left out. States are unique in
    (stay_id, delta_h). Both sides are laid in one order per stay, so no pairs are made."""
    hours = grid.select("stay_id", F.col("hour")).distinct().select("stay_id", F.col("hour").cast("double").alias("_t"), "hour", F.lit(1).alias("_side"), F.lit(None).cast(states.schema[value].dataType).alias("_v"))
    seen = states.select("stay_id", F.col("delta_h").cast("double").alias("_t"), F.lit(None).cast(grid.schema["hour"].dataType).alias("hour"), F.lit(0).alias("_side"), F.col(value).alias("_v"))
    order = Window.partitionBy("stay_id").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = hours.unionByName(seen).withColumn(value, F.last("_v", ignorenulls=True).over(order))
    return both.where(F.col("hour").isNotNull() & F.col(value).isNotNull()).select("stay_id", "hour", value)


def codes_block(codes: DataFrame, train: DataFrame, how: str = "multihot", least: int = 25, top_k: int | None = None, components: int | None = None) -> tuple[DataFrame, list[str]]:
    """((stay_id, icd__<code>.., icd_present), vocabulary): one row per stay with a code, over codes of at least `least` train stays.

    how: multihot, count or tfidf with ln(train stays / train stays with the code). top_k keeps the most frequent, ties by name.
    With components the columns are icd__pca_<i>, of the train stays' principal components. The vocabulary, collected here, is
    that of the coding system, and does not grow with the table.
    """
    if how not in ("multihot", "count", "tfidf"):
        raise ValueError(f"unknown representation {how!r}")
    known = codes.where(F.col("code").isNotNull()).select("stay_id", "code")
    found = vocabulary(known, train).where(F.col("n_stays") >= least)
    found = found if top_k is None else found.orderBy(F.desc("n_stays"), "code").limit(top_k)
    rows = sorted(found.collect())
    names = [r.code for r in rows]
    weight = F.count("*").cast("double") if how != "multihot" else F.lit(1.0)
    counted = known.groupBy("stay_id", "code").agg(F.count("*").alias("_n"))
    if how == "multihot":
        weight = F.lit(1.0)
    elif how == "count":
        weight = F.col("_n").cast("double")
    else:
        weight = F.col("_n") * F.log(F.col("n_train") / F.col("n_stays"))
    weighed = counted.join(found, "code", "left").withColumn("_w", weight)
    wanted = F.array(*[F.lit(n) for n in names]).cast("array<string>")
    held = F.map_from_entries(F.collect_list(F.when(F.col("n_stays").isNotNull(), F.struct("code", "_w"))))  # codes of the vocabulary
    vector = F.transform(wanted, lambda c: F.coalesce(F.try_element_at(F.col("_m"), c), F.lit(0.0)))
    block = weighed.groupBy("stay_id").agg(held.alias("_m")).select("stay_id", vector.alias("_v"))
    columns = [f"icd__{n}" for n in names]
    if components is not None and names:
        fit = fit_reduction(_train_rows(block, train), "_v", components)
        block, columns = reduced(block, "_v", fit), [f"icd__pca_{i}" for i in range(len(fit.axes))]
    return block.select("stay_id", *[c.cast("float").alias(name) for c, name in zip(_named("_v", columns), columns, strict=True)], F.lit(1.0).cast("float").alias("icd_present")), names


def treatments_block(aligned: DataFrame, train: DataFrame, task: str, grid: DataFrame | None = None, cutoff: float | None = None, doses: bool = False, scale: bool = False, gated: bool = True) -> DataFrame:
    """(stay_id[, hour], tx__<treatment>_active.., tx__<dose>.., treatments_present) of each stay with a treatment.

    aligned is (stay_id, treatment, dose, delta_h, end_delta_h). With grid (stay_id, hour, whole hours), an interval is active at
    the hours from delta_h to end_delta_h; without an end, at its own hour alone. A dose is the last one charted up to the hour.
    With cutoff, an interval counts if it begins by then, and a dose is the last by then. treatments_present is 1 from the first
    treatment that the block shows. Of two doses at one time the larger counts. gated leaves out what would leak the task's
    label; scale sets doses to the mean and deviation of the rows of train stays, before what is missing becomes 0.

    One aggregation per side by (stay, hour) serves all treatments; doses and the flag are carried in one window.
    """
    if (grid is None) == (cutoff is None):
        raise ValueError("give either a grid or a cutoff")
    out = WITHHELD.get(task, []) if gated else []
    active, dosed = [c for c in OCCUPANCY if c not in out], [c for c in DOSES if c not in out and doses]
    shown = aligned.where(F.col("treatment").isin(*active, *dosed) & F.col("delta_h").isNotNull())
    at = F.struct("delta_h", "dose")
    last = lambda c: F.max_by("dose", F.when((F.col("treatment") == c) & F.col("dose").isNotNull(), at)).cast("double").alias(f"tx__{c}")
    flag = lambda c: F.max(F.when(F.col("treatment") == c, 1.0)).alias(f"tx__{c}_active")
    stays = aligned.select("stay_id").distinct()
    if grid is None:
        seen = shown.where(F.col("delta_h") <= cutoff).groupBy("stay_id").agg(*map(flag, active), *map(last, dosed), F.lit(1.0).alias("treatments_present"))
        block, keys = stays.join(seen, "stay_id", "left"), ["stay_id"]
    else:
        keys = ["stay_id", "hour"]
        hours = grid.select(*keys).distinct().join(stays, "stay_id", "left_semi")
        held = occupancy_hours(shown.where(F.col("treatment").isin(active))).groupBy(*keys).agg(*map(flag, active))
        # what is charted between two hours is known at the second; what came before the grid, at its first hour
        begun = F.greatest(F.ceil("delta_h"), F.lit(0)).cast("int").alias("hour")
        seen = shown.groupBy("stay_id", begun).agg(*map(last, dosed), F.lit(1.0).alias("treatments_present"))
        order = Window.partitionBy("stay_id").orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)
        every = hours.withColumn("_asked", F.lit(True)).join(seen, keys, "full")  # a dose may be charted where the grid has a gap
        carried = every.select(*keys, "_asked", *[F.last(c, ignorenulls=True).over(order).alias(c) for c in [*(f"tx__{d}" for d in dosed), "treatments_present"]])
        block = carried.where("_asked").drop("_asked").join(held, keys, "left")
    if scale and dosed:
        fit = block.join(train.select("stay_id").distinct(), "stay_id", "left_semi").agg(*[f(f"tx__{d}").alias(f"_{n}_{d}") for d in dosed for f, n in ((F.avg, "m"), (F.stddev_pop, "s"))])
        met = block.crossJoin(F.broadcast(fit))  # one row
        block = met.select(*[c for c in block.columns if c not in {f"tx__{d}" for d in dosed}], *[F.when(F.col(f"_s_{d}") > 0, (F.col(f"tx__{d}") - F.col(f"_m_{d}")) / F.col(f"_s_{d}")).otherwise(F.col(f"tx__{d}")).alias(f"tx__{d}") for d in dosed])
    values = [*(f"tx__{c}_active" for c in active), *(f"tx__{d}" for d in dosed), "treatments_present"]
    return block.select(*keys, *[F.coalesce(F.col(v), F.lit(0.0)).cast("float").alias(v) for v in values])

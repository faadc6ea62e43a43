"""Patient-grouped, stratified, nested splits, and checks on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardgrid.sources.staging import kept

SPLITS = ("train", "val", "test")
BITS = 62  # folds of one word of a mask


def with_fold(patients: DataFrame, name: str, k: int, seed: str, by: list[str]) -> DataFrame:
    """patients with their fold: round robin in the order of a hash, within each stratum.

    A stratum is cut into 4,096 ranges of the hash; ranks go on from the counts of the ranges before, so no task holds a
    whole stratum.
    """
    at = patients.withColumn("_h", F.md5(F.concat_ws(":", F.lit(seed), F.col("patient_id").cast("string")))).withColumn("_r", F.substring("_h", 1, 3))
    earlier = Window.partitionBy(*by).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    before = at.groupBy(*by, "_r").agg(F.count("*").alias("_n")).select(*by, "_r", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy(*by, "_r").orderBy("_h", "patient_id")) - 1
    return at.withColumn("_rank", rank).join(before, [*by, "_r"]).withColumn(name, ((F.col("_before") + F.col("_rank")) % k).cast("int")).select(*patients.columns, name)


def patient_labels(stays: DataFrame) -> DataFrame:
    """A patient is positive if one stay is."""
    return stays.groupBy("patient_id").agg(F.max(F.col("label").cast("int")).alias("label"))


def inner_folds(at: DataFrame, outer: int, inner: int, seed: str) -> DataFrame:
    """(patient_id, o, i): at each rep, the inner fold among the patients whose outer fold o is another; null where it is the rep.

    The order of hashes is the same at all reps, so one sort counts for each of them: no patient is copied.
    """
    ranges = at.withColumn("_h", F.md5(F.concat_ws(":", F.lit(seed), F.col("patient_id").cast("string")))).withColumn("_r", F.substring("_h", 1, 3))
    earlier = Window.partitionBy("label").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("label", "_r").orderBy("_h", "patient_id").rowsBetween(Window.unboundedPreceding, 0)
    others = lambda rep: F.count_if(F.col("o") != rep)
    counts = ranges.groupBy("label", "_r").agg(*[others(rep).alias(f"_n{rep}") for rep in range(outer)])
    before = counts.select("label", "_r", *[F.coalesce(F.sum(f"_n{rep}").over(earlier), F.lit(0)).alias(f"_b{rep}") for rep in range(outer)])
    ranked = ranges.select("patient_id", "label", "o", "_r", *[others(rep).over(upto).alias(f"_c{rep}") for rep in range(outer)]).join(before, ["label", "_r"])
    place = [F.when(F.col("o") != rep, (F.col(f"_b{rep}") + F.col(f"_c{rep}") - 1) % inner).cast("int") for rep in range(outer)]
    return ranked.select("patient_id", "o", F.array(*place).alias("i"))


def nested_places(stays: DataFrame, outer: int = 5, inner: int = 5, seed: str = "42") -> DataFrame:
    """(stay_id, o, i): nested_splits() with one row per stay: its outer fold, and its inner fold at each rep."""
    if outer < 2 or inner < 2:
        raise ValueError("at least two folds")
    at = kept(with_fold(kept(patient_labels(stays), "patients"), "o", outer, f"{seed}:outer", ["label"]), "outer")
    return stays.select("patient_id", "stay_id").join(inner_folds(at, outer, inner, f"{seed}:inner"), "patient_id").select("stay_id", "o", "i")


def spread(places: DataFrame, outer: int, inner: int) -> DataFrame:
    """places with a row for each rep and fold, and the number of its split in SPLITS."""
    cells = F.array(*[F.struct(F.lit(rep).alias("rep"), F.lit(fold).alias("fold")) for rep in range(outer) for fold in range(inner)])
    split = F.when(F.col("o") == F.col("rep"), 2).when(F.get("i", F.col("rep")) == F.col("fold"), 1).otherwise(0)
    return places.select("*", F.inline(cells)).withColumn("_split", split)


def named(number: Column) -> Column:
    return F.get(F.array(*map(F.lit, SPLITS)), number)


def nested_splits(stays: DataFrame, outer: int = 5, inner: int = 5, seed: str = "42") -> DataFrame:
    """(rep, fold, stay_id, split): for each outer fold (test) and inner fold (val), the rest is train.

    stays is (patient_id, stay_id, label). Rows are spread over reps and folds last, behind all joins.
    """
    return spread(nested_places(stays, outer, inner, seed), outer, inner).select("rep", "fold", "stay_id", named(F.col("_split")).alias("split"))


def grouped_folds(stays: DataFrame, k: int = 5, repeats: int = 1, seed: str = "42", stratify: bool = True) -> DataFrame:
    """(rep, fold, stay_id): the fold in which a stay is tested, grouped by patient, repeated with other seeds.

    Fewer than two folds, fewer patients than folds, and, if stratified, labels that are missing or not 0 and 1, or a class
    with fewer patients than folds are errors.
    """
    if k < 2:
        raise ValueError("at least two folds")
    who = patient_labels(stays) if stratify else stays.select("patient_id").distinct().withColumn("label", F.lit(0))
    sizes = {r[0]: r[1] for r in who.groupBy("label").count().limit(3).collect()}
    if stratify and not set(sizes) <= {0, 1}:
        raise ValueError("labels are not 0 and 1")
    if sum(sizes.values()) < k or stratify and min(sizes.values(), default=0) < k:
        raise ValueError("fewer patients than folds")
    runs = [with_fold(who, "fold", k, f"{seed}:{rep}", ["label"]).select(F.lit(rep).alias("rep"), "patient_id", "fold") for rep in range(repeats)]
    return stays.select("patient_id", "stay_id").join(reduce(DataFrame.unionByName, runs), "patient_id").select("rep", "fold", "stay_id")


def stratified_folds(stays: DataFrame, labels: DataFrame, k: int = 5, repeats: int = 5, seed: str = "42") -> DataFrame:
    """grouped_folds() by labels of their own: labels is (patient_id, label). A patient with two rows there, and patients that one of the
    tables has and the other lacks, are errors."""
    double = labels.groupBy("patient_id").count().where("count > 1")
    if not double.isEmpty():
        raise ValueError("labels have more than one row for a patient")
    ours, theirs = stays.select("patient_id", F.lit(1).alias("_a")).distinct(), labels.select("patient_id", F.lit(1).alias("_b"))
    n = ours.join(theirs, "patient_id", "full").agg(F.count_if(F.col("_b").isNull()).alias("a"), F.count_if(F.col("_a").isNull()).alias("b")).first()
    if n.a or n.b:
        raise ValueError(f"{n.a} patients have no label, and {n.b} labels no stay")
    return grouped_folds(stays.select("patient_id", "stay_id").join(labels, "patient_id"), k, repeats, seed)


def one_a_stay(stays: DataFrame, stratify: bool) -> DataFrame:
    """Stays as patients of their own; of hourly labels the greatest counts."""
    label = F.max(F.col("label").cast("int")) if stratify else F.lit(0)
    one = stays.groupBy("stay_id").agg(label.alias("label"))
    return one.select(F.col("stay_id").alias("patient_id"), "stay_id", "label")


def stay_splits(stays: DataFrame, outer: int = 5, inner: int = 5, seed: str = "42", stratify: bool = True) -> DataFrame:
    """nested_splits() of stays instead of patients, for comparison with splits made so: a patient may be on both sides.

    stays is (stay_id, label), or hourly labels, of which the greatest counts; without stratify, labels are not looked at.
    """
    return nested_splits(one_a_stay(stays, stratify), outer, inner, seed)


def stay_manifest(stays: DataFrame, outer: int = 5, inner: int = 5, seed: str = "42", stratify: bool = True) -> DataFrame:
    """fold_manifest() of stay_splits(); a stay's three hashes are computed once, not at each rep and fold."""
    places = nested_places(kept(one_a_stay(stays, stratify), "stays"), outer, inner, seed)
    hashed = kept(places.withColumn("_who", F.array(*[_who(F.lit(name)) for name in SPLITS])), "places")
    return _sizes(spread(hashed, outer, inner).select("rep", "fold", named(F.col("_split")).alias("split"), F.get("_who", F.col("_split")).alias("_who")))


def partition(rows: DataFrame, splits: DataFrame, rep: int, fold: int) -> DataFrame:
    """rows with the split of their stay in one fold; stays of the fold without rows stay, as nulls."""
    return rows.join(splits.where((F.col("rep") == rep) & (F.col("fold") == fold)).select("stay_id", "split"), "stay_id", "right")


def stay_masks(splits: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """(stay_id, <split>_<word>..): for each split, the reps and folds that have the stay in it, as bits; shape is how many reps and folds
    there are. Rows of a stay that lie together meet before the shuffle. A rep, fold or split beyond what is known is an error."""
    reps, folds = shape
    cell = F.col("rep") * folds + F.col("fold")
    fits = F.col("rep").between(0, reps - 1) & F.col("fold").between(0, folds - 1) & F.col("split").isin(*SPLITS)
    cell = F.when(fits, cell).otherwise(F.raise_error(F.lit("unknown rep, fold or split")).cast("int"))
    rows = splits.select("stay_id", "split", cell.alias("_c")).withColumn("_bit", F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_c") % BITS))
    masks = [F.bit_or(F.when((F.col("split") == s) & (F.floor(F.col("_c") / BITS) == w), F.col("_bit")).otherwise(F.lit(0).cast("long"))).alias(f"{s}_{w}") for s in SPLITS for w in range(-(-reps * folds // BITS))]
    return rows.groupBy("stay_id").agg(*masks)


def shape_of(splits: DataFrame) -> tuple[int, int]:
    found = splits.agg(F.max("rep"), F.max("fold")).first()
    return (found[0] or 0) + 1, (found[1] or 0) + 1


def cells_of(masks: DataFrame, shape: tuple[int, int], *keys: str) -> DataFrame:
    """(keys, rep, fold) for each bit of the words _0, _1.. of masks."""
    cells = F.array(*[F.struct(F.lit(rep).alias("rep"), F.lit(fold).alias("fold"), F.lit((rep * shape[1] + fold) // BITS).alias("_w"), F.lit(1 << (rep * shape[1] + fold) % BITS).cast("long").alias("_bit")) for rep in range(shape[0]) for fold in range(shape[1])])
    word = F.get(F.array(*[f"_{w}" for w in range(-(-shape[0] * shape[1] // BITS))]), F.col("_w"))
    return masks.select("*", F.inline(cells)).where(word.bitwiseAND(F.col("_bit")) != 0).select(*keys, "rep", "fold")


def leaking_patients(splits: DataFrame, stays: DataFrame, shape: tuple[int, int] | None = None) -> DataFrame:
    """(rep, fold, patient_id) of patients in more than one split. shape, if known, is how many reps and folds there are."""
    shape = shape or shape_of(splits)
    words = range(-(-shape[0] * shape[1] // BITS))
    per = stay_masks(splits, shape).join(stays.select("stay_id", "patient_id"), "stay_id").groupBy("patient_id").agg(*[F.bit_or(f"{s}_{w}").alias(f"{s}_{w}") for s in SPLITS for w in words])
    both = lambda w, a, b: F.col(f"{a}_{w}").bitwiseAND(F.col(f"{b}_{w}"))
    met = [both(w, "train", "val").bitwiseOR(both(w, "train", "test")).bitwiseOR(both(w, "val", "test")).alias(f"_{w}") for w in words]
    return cells_of(per.select("patient_id", *met), shape, "patient_id").select("rep", "fold", "patient_id")


def unsplit_stays(splits: DataFrame, stays: DataFrame, shape: tuple[int, int] | None = None) -> DataFrame:
    """(rep, fold, n_missing, n_foreign): stays that a fold lacks, and those that it has beyond the cohort; shape as above."""
    shape = shape or shape_of(splits)
    any_ = [F.col(f"train_{w}").bitwiseOR(F.col(f"val_{w}")).bitwiseOR(F.col(f"test_{w}")).alias(f"_{w}") for w in range(-(-shape[0] * shape[1] // BITS))]
    known = stays.select("stay_id").distinct().withColumn("known", F.lit(1))
    met = stay_masks(splits, shape).select("stay_id", *any_).join(known, "stay_id", "left")
    own, foreign = F.col("known").isNotNull(), F.col("known").isNull() & F.col("stay_id").isNotNull()
    per = cells_of(met, shape, "stay_id", "known").groupBy("rep", "fold").agg(F.count_if(own).alias("have"), F.count_if(foreign).alias("n_foreign"))
    n = stays.agg(F.count_distinct("stay_id").alias("n"))
    return per.join(F.broadcast(n)).select("rep", "fold", (F.col("n") - F.col("have")).alias("n_missing"), "n_foreign")  # n is one row


def manifest(splits: DataFrame) -> DataFrame:
    return splits.groupBy("rep", "fold", "split").agg(F.count("*").alias("n_stays"))


def _who(split: Column) -> Column:
    """60 bits of a hash of a stay and its split."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.col("stay_id").cast("string"), split)), 1, 15), 16, 10).cast("long")


def _sizes(rows: DataFrame) -> DataFrame:
    """fold_manifest() of (rep, fold, split, _who). The halves of the hashes are summed as longs, which 2^33 rows do not pass."""
    half = 1 << 30
    sizes = [F.count_if(F.col("split") == s).alias(f"n_{s}") for s in SPLITS]
    per = rows.groupBy("rep", "fold").agg(*sizes, F.sum(F.shiftright("_who", 30)).alias("_high"), F.sum(F.col("_who").bitwiseAND(F.lit(half - 1).cast("long"))).alias("_low"))
    whole = (F.col("_high").cast("decimal(25,0)") * F.lit(half).cast("decimal(12,0)") + F.col("_low").cast("decimal(25,0)")).cast("decimal(38,0)")
    return per.select("rep", "fold", *[f"n_{s}" for s in SPLITS], whole.cast("string").alias("digest"))


def fold_manifest(splits: DataFrame) -> DataFrame:
    """(rep, fold, n_train, n_val, n_test, digest): the sizes of each fold, and a hash of who is where that no order of rows changes."""
    return _sizes(splits.select("rep", "fold", "split", _who(F.col("split")).alias("_who")))

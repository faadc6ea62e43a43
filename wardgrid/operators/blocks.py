"""Feature blocks: code vocabularies and their representations, pooled vectors, treatment occupancy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardgrid.operators.derive import star_join
from wardgrid.sources.staging import kept


def vocabulary(codes: DataFrame, train: DataFrame, min_prevalence: float = 0.0, top_k: int | None = None) -> DataFrame:
    """(code, n_stays, n_train): codes by the train stays that have them, above a share of all train stays."""
    n = train.select("stay_id").distinct().agg(F.count("*").alias("n_train"))
    seen = codes.join(train.select("stay_id").distinct(), "stay_id", "left_semi").groupBy("code").agg(F.count_distinct("stay_id").alias("n_stays"))
    kept = seen.join(F.broadcast(n)).where(F.col("n_stays") >= min_prevalence * F.col("n_train"))  # one row
    return kept if top_k is None else kept.orderBy(F.desc("n_stays"), "code").limit(top_k)


def multihot(codes: DataFrame, vocab: list[str], how: str = "binary") -> DataFrame:
    """One row per stay, one column per code: presence, or how often it occurs."""
    cell = F.count("*") if how == "count" else F.max(F.lit(1))
    wide = codes.where(F.col("code").isin(vocab)).groupBy("stay_id").pivot("code", vocab).agg(cell)
    return codes.select("stay_id").distinct().join(wide, "stay_id", "left").fillna(0)


def tfidf(codes: DataFrame, vocab: DataFrame) -> DataFrame:
    """(stay_id, code, tf, weight) with idf = ln(train stays / train stays that have the code)."""
    tf = codes.groupBy("stay_id", "code").agg(F.count("*").alias("tf"))
    return tf.join(vocab, "code").select("stay_id", "code", "tf", (F.col("tf") * F.log(F.col("n_train") / F.col("n_stays"))).alias("weight"))


def mean_pool(vectors: DataFrame, key: str, vector: str = "embedding", at: str | None = None, half_life: float | None = None) -> DataFrame:
    """(key, pos, value): mean vector of a group, weighted 2^((at - latest) / half_life) if a half-life is given; a half-life of
    0 takes the latest alone.

    Dimensions are exploded, so partial sums combine before the shuffle and no group is collected.
    """
    if half_life is None or at is None:
        weighted = vectors.withColumn("_w", F.lit(1.0))
    else:
        latest = vectors.groupBy(key).agg(F.max(at).alias("_latest"))
        fade = F.pow(F.lit(2.0), (F.col(at) - F.col("_latest")) / half_life) if half_life else (F.col(at) == F.col("_latest")).cast("double")
        weighted = vectors.join(latest, key).withColumn("_w", fade)
    cells = weighted.select(key, "_w", F.posexplode(vector).alias("pos", "x"))
    return cells.groupBy(key, "pos").agg((F.sum(F.col("_w") * F.col("x").cast("double")) / F.sum("_w")).alias("value"))


PART_ROWS = 20_000  # vectors of one task of a running pool at most, about
PART_NUMBERS = 320_000  # and components of these together: a task holds several copies of them in double precision
LANES = 64  # dimensions carried together between parts


def _fades(times: np.ndarray, half_life: float) -> np.ndarray:
    """What is left of a weight from one time to the next; rows of one time count together."""
    step = np.diff(times, prepend=times[:1])
    return np.where(step == 0, 1.0, 0.0) if half_life == 0 else np.exp2(-step / half_life)


def _decayed_sums(fade: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(running sums that fade before each row is added, product of the fades so far): a scan by doubling."""
    fade, total, step = fade.copy(), total.copy(), 1
    while step < len(fade):
        total[step:] += fade[step:, None] * total[:-step]
        fade[step:] *= fade[:-step].copy()
        step *= 2
    return total, fade


def running_pool(vectors: DataFrame, key: str, at: str, half_life: float, vector: str = "embedding") -> DataFrame:
    """(key, at, pooled): mean of all vectors of a key up to each time, weighted 2^((time - now) / half_life).

    A half-life of infinity is the plain running mean, of 0 the mean of the latest time alone. Rows of one time count together;
    those without a key, a time or a vector are left out. Rows are dealt to parts of about PART_ROWS, or of PART_NUMBERS components, by ranges of (key, time), so
    a key may be spread over many tasks: each part folds its first and last key to a sum and a weight, these are carried along
    the key's parts, LANES dimensions at a time, and each part then scans its rows with what came before.
    """
    kind = vectors.schema[key].dataType.simpleString()
    ready = vectors.where(F.col(key).isNotNull() & F.col(at).isNotNull() & F.col(vector).isNotNull()).select(key, F.col(at).cast("double").alias("_at"), F.col(vector).cast("array<double>").alias("_x"))
    n, wide = ready.agg(F.count("*"), F.max(F.size("_x"))).first()
    parts = max(1, -(-n // min(PART_ROWS, max(1, PART_NUMBERS // max(1, wide or 1)))))
    dealt = kept(ready.repartitionByRange(parts, key, "_at").withColumn("_part", F.spark_partition_id()), "ranges")

    def opened(rows: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """(keys, times, where a key begins, vectors with a weight of 1) in order."""
        rows = rows.sort_by([(key, "ascending"), ("_at", "ascending")])
        keys, times = rows.column(key).combine_chunks(), rows.column("_at").to_numpy()
        x = rows.column("_x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(keys), -1)
        first = np.append(True, pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False))
        return keys, times, first, np.hstack([x, np.ones((len(x), 1))])

    def fold(rows: pa.Table) -> pa.Table:
        keys, times, first, x = opened(rows)
        fade = _fades(times, half_life)
        fade[first] = 0.0
        total, _ = _decayed_sums(fade, x)
        ends = np.flatnonzero(np.append(first[1:], True))[[0, -1]]  # the first and the last key of the part
        ends = np.unique(ends)
        part = rows.column("_part")[0].as_py()
        lanes = [(k, part, lane, times[i], total[i, c : c + LANES].tolist()) for i in ends.tolist() for k in [keys[i]] for lane, c in enumerate(range(0, total.shape[1], LANES))]
        k, p, lane, t, s = zip(*lanes, strict=True)
        return pa.table({key: pa.array([v.as_py() for v in k], keys.type), "_part": pa.array(p, pa.int32()), "lane": pa.array(lane, pa.int32()), "_at": pa.array(t, pa.float64()), "s": pa.array(s, pa.list_(pa.float64()))})

    def carry(rows: pa.Table) -> pa.Table:
        """What each part of a key receives: the sums of the parts before it, as they are at the last time there."""
        rows = rows.sort_by("_part")
        times, s = rows.column("_at").to_numpy(), rows.column("s").combine_chunks()
        total, _ = _decayed_sums(_fades(times, half_life), s.flatten().to_numpy().reshape(len(s), -1))
        return pa.table({"_part": rows.column("_part")[1:], "lane": rows.column("lane")[1:], "_at": pa.array(times[:-1]), "s": pa.array(total[:-1].tolist(), pa.list_(pa.float64()))})

    def scan(rows: pa.Table, before: pa.Table) -> pa.Table:
        keys, times, first, x = opened(rows)
        fade = _fades(times, half_life)
        fade[first] = 0.0
        fade[0] = 1.0  # what comes before is of the first key
        total, left = _decayed_sums(fade, x)
        if before.num_rows:
            before = before.sort_by("lane")
            came = np.array(before.column("s").combine_chunks().flatten().to_numpy())
            total += left[:, None] * _fades(np.array([before.column("_at")[0].as_py(), times[0]]), half_life)[1] * came
        last = np.append(first[1:] | (times[1:] != times[:-1]), True)
        mean = total[last, :-1] / total[last, -1:]
        ends = pa.array(np.arange(len(mean) + 1, dtype=np.int32) * mean.shape[1])
        return pa.table({key: keys.filter(pa.array(last)), "at": times[last], "pooled": pa.ListArray.from_arrays(ends, pa.array(mean.ravel()))})

    folded = dealt.groupBy("_part").applyInArrow(fold, f"{key} {kind}, _part int, lane int, _at double, s array<double>")
    carried = folded.groupBy(key, "lane").applyInArrow(carry, "_part int, lane int, _at double, s array<double>")
    return dealt.groupBy("_part").cogroup(carried.groupBy("_part")).applyInArrow(scan, f"{key} {kind}, at double, pooled array<double>")


def last_dose(aligned: DataFrame, cutoff: float) -> DataFrame:
    """(stay_id, treatment, dose): the last dose up to the cutoff."""
    return aligned.where((F.col("delta_h") <= cutoff) & F.col("dose").isNotNull()).groupBy("stay_id", "treatment").agg(F.max_by("dose", F.struct("delta_h", "dose")).alias("dose"))


def standardised(rows: DataFrame, train: DataFrame, value: str, by: str) -> DataFrame:
    """value less the train mean over the train deviation (population), per group; groups without train values or variance keep their values."""
    fit = rows.join(train.select("stay_id").distinct(), "stay_id", "left_semi").groupBy(by).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    scaled = F.when(F.col("_s") > 0, (F.col(value) - F.col("_m")) / F.col("_s")).otherwise(F.col(value))
    return rows.join(fit, by, "left").withColumn("scaled", scaled).drop("_m", "_s")


def merge_block(features: DataFrame, block: DataFrame, on: list[str], name: str) -> DataFrame:
    """features with a block's columns, 0 where it has no row, and <name>_present, 1 where it has one unless the block says otherwise.
    A key that the block has twice is an error."""
    flag = f"{name}_present"
    values = [c for c in block.columns if c not in on]
    right = block if flag in values else block.withColumn(flag, F.lit(1))
    return star_join(features, (right, on)).fillna(0, subset=[*values, flag])


def drop_inadmissible(rows: DataFrame, task: str, leaks: DataFrame) -> DataFrame:
    """rows without those treatments that leak the task's label; leaks is (task, concept)."""
    return rows.join(leaks.where(F.col("task") == task).select(F.col("concept").alias("treatment")).distinct(), "treatment", "left_anti")


def hash_encoder(dim: int = 8) -> Callable[[list[str]], tuple[list[np.ndarray], list[int]]]:
    """An encoder of texts for tests: sums of vectors that are hashes of words, of length 1. A worker hashes each word once."""
    import hashlib

    known: dict[str, np.ndarray] = {}

    def of(word: str) -> np.ndarray:
        if word not in known:
            if len(known) >= 200_000:
                known.clear()
            known[word] = np.frombuffer(hashlib.sha256(word.encode()).digest()[:dim], np.uint8) / 127.5 - 1
        return known[word]

    def encode(texts: list[str]) -> tuple[list[np.ndarray], list[int]]:
        split = [text.split() for text in texts]
        sums = [np.sum([of(w) for w in words], axis=0) if words else np.zeros(dim) for words in split]
        return [v / (np.linalg.norm(v) or 1) for v in sums], [len(words) for words in split]

    return encode


def encode_texts(notes: DataFrame, dim: int = 8, encoder: Callable[[list[str]], tuple[list[np.ndarray], list[int]]] | None = None, batch: int = 256) -> DataFrame:
    """(note_id, embedding, n_tokens). encoder takes at most `batch` texts, null ones as empty, and gives a vector and a number of tokens
    for each; without one, hash_encoder(dim)."""
    kind = notes.schema["note_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder or hash_encoder(dim)
        for b in batches:
            for start in range(0, len(b), batch):
                part = b.slice(start, batch)
                vectors, n = encode([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([np.asarray(v, np.float32).tolist() for v in vectors], pa.list_(pa.float32())), pa.array(n, pa.int64())], ["note_id", "embedding", "n_tokens"])

    return notes.select("note_id", "text").mapInArrow(run, f"note_id {kind}, embedding array<float>, n_tokens long")

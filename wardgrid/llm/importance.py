"""Importance resampling of documents towards a target distribution.

Texts are lower-cased (A-Z only) and cut to words by a pre-tokeniser of the tokenizers library: an untrained split on what
lies between words, which returns the words with their offsets. A feature is a run of `low` to `high` words: the
offsets of its first and last word give the window of the text it is read from, and its bucket is the CRC-32 of its words,
joined by one space. Histograms over buckets of all documents and of all target texts give each bucket a gain, 1000 times
the logarithm of the smoothed ratio of shares; a document's weight is the floored mean of its features' gains. Gumbel noise
from a hash of doc_id turns the highest scores into a draw without replacement.

The texts are read once: the buckets of each document are written as binary and read again for the weights. What the driver
holds is the gain of each bucket and the number of documents of each score, both bounded by the parameters (scores are
thousandths of logarithms), whatever the corpus. Ranks are places within a score behind the counts of higher ones, so no
task sorts all documents; rows equal in score, doc_id, weight and features are counted first and dealt out again, so a third
of all rows under one doc_id is one group of one row.

Null texts have no features: weight 0. A null doc_id is hashed as the empty text and comes after all others in ties; rows
that share a doc_id are drawn apart. Empty tables give no rows; no target texts, gains against a flat target.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardgrid.llm.common import staged

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # what is no letter, digit or sign beyond ASCII
KEPT = 300_000  # windows whose bucket a Python worker keeps
WINDOW_CHARS = 64  # longer ones are not kept
CHUNK = 4096  # equal rows dealt out at once
BUCKET = np.dtype("<u4")


class _Buckets(dict):
    """Bucket of each window of a text, found when it is first asked for."""

    def __init__(self, split, buckets: int):
        super().__init__()
        self.split, self.buckets = split, buckets

    def __missing__(self, window: str) -> int:
        feature = " ".join(word for word, _ in self.split.pre_tokenize_str(window))
        bucket = zlib.crc32(feature.encode()) % self.buckets
        if len(window) <= WINDOW_CHARS:
            if len(self) >= KEPT:
                self.clear()
            self[window] = bucket
        return bucket


def hashed(docs: DataFrame, low: int, high: int, buckets: int) -> DataFrame:
    """(doc_id, n_words, n_features, found): the bucket of each feature of each row's text, as 32-bit integers."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Regex, pre_tokenizers

        split = pre_tokenizers.Split(Regex(BETWEEN), "removed")
        bucket_of = _Buckets(split, buckets)
        for b in batches:
            words, features, found = [], [], []
            for text in b.column(1):
                lowered = text.as_py().encode().lower().decode()
                spans = [span for _, span in split.pre_tokenize_str(lowered)]
                runs = [bucket_of[lowered[s:e]] for n in range(low, high + 1) for (s, _), (_, e) in zip(spans, spans[n - 1 :], strict=False)]
                words.append(len(spans))
                features.append(len(runs))
                found.append(np.array(runs, BUCKET).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.int64()), pa.array(features, pa.int64()), pa.array(found, pa.binary())], ["doc_id", "n_words", "n_features", "found"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, found binary")


def histogram(features: DataFrame, buckets: int, name: str) -> DataFrame:
    """(bucket, name): how often each bucket occurs; each task sums its own rows first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for found in b.column(0):
                total += np.bincount(np.frombuffer(found.as_py(), BUCKET), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    return features.select("found").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias(name))


def gains(documents: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of all buckets, from the features of both sides."""
    s, t = histogram(documents, buckets, "s"), histogram(target, buckets, "t")
    both = documents.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(s, "bucket", "left").join(t, "bucket", "left").na.fill(0)
    sums = s.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("all_s")).crossJoin(t.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("all_t")))  # one row each
    ratio = (F.col("t") + F.lit(1.0)) * (F.col("all_s") + F.lit(float(buckets))) / ((F.col("s") + F.lit(1.0)) * (F.col("all_t") + F.lit(float(buckets))))
    return both.crossJoin(F.broadcast(sums)).select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def noise(doc_id: Column | str, seed: int) -> Column:
    """Thousandths of Gumbel noise, fixed by seed and doc_id."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def weigh(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """features with weight, the floored mean of the gains of each row's features, in place of its buckets."""
    shared = features.sparkSession.sparkContext.broadcast(gain)
    kind = features.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = [int(shared.value[np.frombuffer(x.as_py(), BUCKET)].sum()) for x in b.column(3)]
            weights = [total // n if n else 0 for total, n in zip(sums, b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(weights, pa.int64())], ["doc_id", "n_words", "n_features", "weight"])

    return features.select("doc_id", "n_words", "n_features", "found").mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def draw(scored: DataFrame, eligible: Column, percent: int) -> DataFrame:
    """scored (doc_id, n_features, weight, score, ...) with the rank of the percent highest scores among eligible rows."""
    spark = scored.sparkSession
    per_score = sorted(((r.score, r.n) for r in scored.where(eligible).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    wanted, before, seen = sum(n for _, n in per_score) * percent // 100, [], 0
    for score, n in per_score:
        if seen >= wanted:
            break
        before.append((score, seen))
        seen += n
    columns = ["doc_id", "n_features", "weight", "score"]
    if not before:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    lowest = before[-1][0]
    in_reach = eligible & (F.col("score") >= lowest)
    alike = scored.where(in_reach).groupBy(*columns).agg(F.count("*").alias("copies"))
    order = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features", "weight")
    alike = alike.join(F.broadcast(spark.createDataFrame(before, "score long, above long")), "score")  # at most one row a score
    placed = alike.withColumn("first", F.col("above") + F.sum("copies").over(order) - F.col("copies"))
    chunks = placed.select(*columns, "first", "copies", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(CHUNK).cast("long"))).alias("done"))
    # copies of one row are dealt to tasks before they become rows again
    dealt = chunks.repartition("score", "doc_id", "done").select(*columns, "first", F.explode(F.sequence(F.col("done"), F.least(F.col("done") + CHUNK, F.col("copies")) - 1)).alias("copy"))
    rank = F.col("first") + F.col("copy") + 1
    return scored.where(~in_reach).select(*columns, F.lit(None).cast("long").alias("rank")).unionByName(dealt.select(*columns, F.when(rank <= wanted, rank).alias("rank")))


def resample(docs: DataFrame, target: DataFrame, low: int = 1, high: int = 1, buckets: int = 10_000, seed: int = 2024, percent: int = 10, min_words: int = 20) -> DataFrame:
    """(doc_id, n_features, weight, score, rank), one row per row of docs.

    target: a table with a column text. Of the documents with at least min_words words, percent in a hundred are drawn by
    score; rank is 1, 2, 3... from the highest, ties to the smaller doc_id, null where a document is not drawn.
    """
    features = staged(hashed(docs, low, high, buckets), "features")
    aims = staged(hashed(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), low, high, buckets), "targets")
    gain = np.zeros(buckets, np.int64)
    for bucket, value in gains(features, aims, buckets).collect():  # one row a bucket
        gain[bucket] = value
    scored = weigh(features, gain).withColumn("score", F.col("weight") + noise("doc_id", seed))
    return draw(staged(scored, "scored"), F.col("n_words") >= min_words, percent)

"""Toxicity scores by a factorization machine over hashed terms.

A document's terms are its words and the four-letter starts of its words, hashed into DIMENSIONS. The machine has a
linear weight and a short vector for each informative term: the dot product of two vectors weighs their pair, such as
an insult beside the mention of a group, which linear weights alone cannot. It is fitted on a bounded sample of
labelled rows (SAMPLE_TOXIC and SAMPLE_CLEAN rows, the smallest hashes of doc_id first, so the same rows at each run);
everything else covers all rows. Scoring is one pass without a shuffle.

Null text counts as empty: such rows get the score of a document without terms. Repeated rows give repeated results.
Several labels of one doc_id count as toxic if one is; null labels and rows without a label are not learnt from. With
no labelled rows at all, every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardgrid.llm.common import fold, let, staged, words_of

DIMENSIONS = 1 << 20
SAMPLE_TOXIC = 6000
SAMPLE_CLEAN = 12000
TERMS = 4000  # informative terms that get weights
FACTORS = 8
START_LETTERS = 4
HELD_OUT_OF = 5
HELD = 300_000  # terms that a task weighs at once; a text is never cut, so one longer than that is weighed by itself


def term_columns(docs: DataFrame) -> DataFrame:
    """Adds terms: hashed words, then hashed word starts."""
    slot = lambda x: F.pmod(F.xxhash64(x), F.lit(DIMENSIONS)).cast("int")
    start = lambda w: slot(F.concat(F.lit("^"), F.substring(w, 1, START_LETTERS)))
    return docs.withColumn("terms", let(words_of("text"), lambda words: F.concat(F.transform(words, slot), F.transform(words, start))))


def informative_terms(sample: DataFrame, n_toxic: int, n_clean: int) -> DataFrame:
    """(term, gain) of the TERMS terms whose presence tells most: the G statistic of their 2 x 2 table."""
    seen = sample.select("toxic", F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    total = n_toxic + n_clean

    def part(count: F.Column, row: F.Column, column: int) -> F.Column:
        return F.when(count > 0, count * F.log(count * total / (row * column))).otherwise(0.0)

    has, lacks = F.col("a") + F.col("b"), F.lit(total) - F.col("a") - F.col("b")
    gain = part(F.col("a"), has, n_toxic) + part(F.col("b"), has, n_clean) + part(F.lit(n_toxic) - F.col("a"), lacks, n_toxic) + part(F.lit(n_clean) - F.col("b"), lacks, n_clean)
    return seen.where(has >= 3).select("term", gain.alias("gain")).orderBy(F.desc("gain"), "term").limit(TERMS)


class FactorizationMachine:
    """Second-order machine on presence features, fitted by AdaGrad on the weighted logistic loss."""

    def __init__(self, n_terms: int, factors: int = FACTORS, seed: int = 7):
        self.bias = 0.0
        self.linear = np.zeros(n_terms)
        self.vectors = np.random.default_rng(seed).normal(0, 0.03, (n_terms, factors))

    def margins(self, rows: np.ndarray, terms: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Margin and summed vectors of n documents; entry i says that document rows[i] has terms[i]."""
        sums = np.zeros((n, self.vectors.shape[1]))
        np.add.at(sums, rows, self.vectors[terms])
        own = np.bincount(rows, (self.vectors[terms] ** 2).sum(1), n)
        return self.bias + np.bincount(rows, self.linear[terms], n) + 0.5 * ((sums**2).sum(1) - own), sums

    def fit(self, rows: np.ndarray, terms: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = 25, batch: int = 512, rate: float = 0.15, decay: float = 5e-5, seed: int = 7) -> FactorizationMachine:
        """rows must be ascending."""
        positive = float((weight * y).sum() / weight.sum())
        self.bias = float(np.log(max(positive, 1e-6) / max(1 - positive, 1e-6)))
        edges = np.searchsorted(rows, np.arange(len(y) + 1))
        heat = [1e-6, np.full_like(self.linear, 1e-6), np.full_like(self.vectors, 1e-6)]
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for at in range(0, len(y), batch):
                ids = order[at : at + batch]
                size = edges[ids + 1] - edges[ids]
                local = np.repeat(np.arange(len(ids)), size)
                t = terms[np.repeat(edges[ids] - np.cumsum(size) + size, size) + np.arange(size.sum())]
                margin, sums = self.margins(local, t, len(ids))
                g = weight[ids] * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[ids]) / weight[ids].mean()
                step = [g.sum(), np.bincount(t, g[local], len(self.linear)), np.zeros_like(self.vectors)]
                np.add.at(step[2], t, g[local][:, None] * (sums[local] - self.vectors[t]))
                step = [step[0] / len(ids), step[1] / len(ids) + decay * self.linear, step[2] / len(ids) + decay * self.vectors]
                for h, s in zip(heat[1:], step[1:], strict=True):
                    h += s * s
                heat[0] += step[0] ** 2
                self.bias -= rate * step[0] / np.sqrt(heat[0])
                self.linear -= rate * step[1] / np.sqrt(heat[1])
                self.vectors -= rate * 0.3 * step[2] / np.sqrt(heat[2])
        return self

    def scores(self, rows: np.ndarray, terms: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(rows, terms, n)[0], -30, 30)))


def presence(offsets: np.ndarray, flat: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, place of term), once each, of the terms that have a place."""
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = place[flat]
    keep = at >= 0
    both = np.unique(rows[keep].astype(np.int64) * (len(place) + 1) + at[keep])
    return both // (len(place) + 1), both % (len(place) + 1)


def pieces(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of documents that hold some HELD terms together."""
    start = 0
    while start < len(offsets) - 1:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + HELD, "right")) - 1)
        yield start, stop
        start = stop


def judge(terms: pa.ListArray, place: np.ndarray, machine: FactorizationMachine) -> np.ndarray:
    """The score of each document of a batch; what it takes beside the batch does not grow with it."""
    offsets, flat = terms.offsets.to_numpy(), terms.values.to_numpy()
    score = np.empty(len(terms))
    for s, e in pieces(offsets):
        rows, at = presence(offsets[s : e + 1] - offsets[s], flat[offsets[s] : offsets[e]], place)
        score[s:e] = machine.scores(rows, at, e - s)
    return score


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, FactorizationMachine]:
    """(place of each hashed term or -1, fitted machine), from labelled rows outside the held-out fold."""
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", HELD_OUT_OF) != 0)).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    totals = {r[0]: r[1] for r in marks.groupBy("toxic").count().collect()}
    chosen = None
    for value, bound in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN)):
        some = marks.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
        chosen = some if chosen is None else chosen.unionByName(some)
    # at most SAMPLE_TOXIC + SAMPLE_CLEAN ids
    sample = staged(term_columns(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")).select("toxic", "terms"), "labelled")
    n = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    place = np.full(DIMENSIONS, -1, np.int32)
    if not n_toxic or not n_clean:
        machine = FactorizationMachine(1)
        machine.bias = 30.0 if n_toxic else -30.0
        return place, machine
    best = [r[0] for r in informative_terms(sample, n_toxic, n_clean).collect()]
    place[best] = np.arange(len(best))
    told = sample.sparkSession.sparkContext.broadcast(place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, flat = b.column(1).offsets.to_numpy(), b.column(1).values.to_numpy()
            for s, e in pieces(offsets):
                rows, at = presence(offsets[s : e + 1] - offsets[s], flat[offsets[s] : offsets[e]], told.value)
                edges = np.searchsorted(rows, np.arange(e - s + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s, e - s), pa.ListArray.from_arrays(pa.array(edges), pa.array(at.astype(np.int32)))], ["toxic", "terms"])

    got = sample.mapInArrow(run, "toxic int, terms array<int>").toArrow().combine_chunks()  # bounded: the sample's rows, at most TERMS terms each
    lists = got.column("terms").combine_chunks()
    lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks)
    y = got.column("toxic").to_numpy().astype(float)
    terms = lists.flatten().to_numpy()
    sizes = np.diff(lists.offsets.to_numpy())
    weight = np.where(y == 1, totals[1] / n_toxic, totals[0] / n_clean)
    return place, FactorizationMachine(len(best)).fit(np.repeat(np.arange(len(y)), sizes), terms, y, weight)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of docs."""
    model = docs.sparkSession.sparkContext.broadcast(fit_toxicity(docs, labels))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, machine = model.value
        for b in batches:
            score = judge(b.column(3), place, machine)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "th", "score", "predicted"])

    ready = term_columns(docs.select("doc_id", "text")).select("doc_id", (fold("doc_id", HELD_OUT_OF) == 0).alias("held_out"), F.xxhash64("text").alias("th"), "terms")
    return ready.mapInArrow(run, f"doc_id {kind}, held_out boolean, th long, score double, predicted int")


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of docs."""
    return scored(docs, labels).drop("th")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the machine does not reject, with all their columns. Each text is judged for itself, also where
    rows share a doc_id or have none. Only hashed terms, once each, are sent to Python workers: rows and texts stay in the executor's own,
    bounded memory until their scores are back, and nothing is joined or shuffled."""
    model = docs.sparkSession.sparkContext.broadcast(fit_toxicity(docs, labels))

    @F.arrow_udf("double")
    def toxic_score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        place, machine = model.value
        for terms in batches:
            yield pa.array(judge(terms, place, machine))

    ready = term_columns(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")).select("row", "terms")
    return ready.where(toxic_score(F.array_distinct("terms")) < 0.5).select("row.*")

"""Maximum inner product search with score-aware anisotropic quantisation.

Vectors are quantised by product codes of four bits per two dimensions. Codebooks and codes minimise a loss that
weighs the residual along the vector PARALLEL times as much as the rest, as that part is what errs in large inner
products. Vectors are dealt to lists by their nearest coarse centre; a query visits its best lists, scans their codes
by the products of the vectors that they stand for, and computes exactly the RERANK best of each block, then every other row
whose code, with the length of its residual, does not rule it out. So within the lists that a query visits nothing is lost.

How many lists a query visits is measured, not set: the true neighbours of CHECKED queries are found by brute force over
all rows, and the least number of lists (PROBES or more, up to all) that hold the share FOUND of them is taken. A query
first visits its best list; the k-th best product found there is its floor, and the other lists give only what reaches
it, so what they give follows the queries and not the lists. A query that still has less than k visits all other lists.
With exact=True every list is visited and every product is computed, in blocks.

Everything is fitted on a bounded sample (SAMPLE vectors, the smallest hashes of vec_id); every row is indexed. Lists
are cut into blocks of about BLOCK candidates and QUERIES queries, so a list that holds a third of all rows is many
groups. Vectors that are null, zero, empty, or hold null or non-finite components take no part; products exist between
vectors of the same length only, so each length is searched for itself. Repeated rows count once; a null vec_id takes no
part. Ties go to the smaller vec_id. No usable vector, no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardgrid.llm.common import staged

SAMPLE = 20_000
LIST_ROWS = 4096  # rows of a list on average
MAX_LISTS = 1024
PROBES = 8  # lists visited at least
CHECKED = 512  # queries whose neighbours are looked up by brute force
FOUND = 0.98
RERANK = 240
BLOCK, QUERIES = 8192, 4096
CHUNK = 128  # queries whose products with a block are held at once
PAIRS = 4_000_000  # components of pairs that are multiplied at once
DENSE = 0.05  # share of pairs left by their codes from which a product of matrices costs less than the pairs
PARALLEL = 4.0
CODES = 16
WIDTH = 2


class Quantiser:
    """Coarse centres and anisotropic product codes."""

    def __init__(self, x: np.ndarray, lists: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        pad = -x.shape[1] % WIDTH
        x = np.pad(x, ((0, 0), (0, pad)))
        self.pad, self.parts = pad, x.shape[1] // WIDTH
        self.centres = x[rng.choice(len(x), min(lists, len(x)), replace=False)].copy()
        for _ in range(12):
            near = self._nearest(x)
            for k in range(len(self.centres)):
                if (near == k).any():
                    self.centres[k] = x[near == k].mean(0)
        sub = x.reshape(len(x), self.parts, WIDTH)
        self.books = sub[rng.choice(len(x), CODES, replace=len(x) < CODES)].transpose(1, 0, 2).copy()
        for _ in range(8):
            codes = self.encode(x, 2)
            self._refit(sub, codes)

    def _nearest(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.centres.T - 0.5 * (self.centres**2).sum(1)).argmax(1)

    def _parts_of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sub-vectors, sub-vectors of the direction)."""
        sub = x.reshape(len(x), self.parts, WIDTH)
        return sub, sub / np.linalg.norm(x, axis=1)[:, None, None]

    def encode(self, x: np.ndarray, rounds: int = 3) -> np.ndarray:
        """Codes by coordinate descent on the anisotropic loss."""
        sub, way = self._parts_of(x)
        codes = np.empty((len(x), self.parts), np.uint8)
        along = np.zeros(len(x))
        for s in range(self.parts):
            codes[:, s] = ((sub[:, s, None] - self.books[s]) ** 2).sum(2).argmin(1)
            along += (way[:, s] * (sub[:, s] - self.books[s][codes[:, s]])).sum(1)
        for _ in range(rounds):
            for s in range(self.parts):
                rest = along - (way[:, s] * (sub[:, s] - self.books[s][codes[:, s]])).sum(1)
                gap = sub[:, s, None] - self.books[s]
                own = np.einsum("nd,nkd->nk", way[:, s], gap)
                codes[:, s] = ((gap**2).sum(2) + (PARALLEL - 1) * (rest[:, None] + own) ** 2).argmin(1)
                along = rest + np.take_along_axis(own, codes[:, s, None].astype(np.intp), 1)[:, 0]
        return codes

    def _refit(self, sub: np.ndarray, codes: np.ndarray) -> None:
        """Each codeword solves its weighted least squares, all others fixed."""
        way = sub / np.linalg.norm(sub.reshape(len(sub), -1), axis=1)[:, None, None]
        decoded = np.stack([self.books[s][codes[:, s]] for s in range(self.parts)], 1)
        along = (way * (sub - decoded)).sum((1, 2))
        for s in range(self.parts):
            rest = along - (way[:, s] * (sub[:, s] - decoded[:, s])).sum(1)
            for k in range(CODES):
                at = codes[:, s] == k
                if at.any():
                    u, v = way[at, s], sub[at, s]
                    left = at.sum() * np.eye(WIDTH) + (PARALLEL - 1) * u.T @ u
                    right = v.sum(0) + (PARALLEL - 1) * (u * (rest[at] + (u * v).sum(1))[:, None]).sum(0)
                    self.books[s, k] = np.linalg.solve(left, right)

    def padded(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.pad)))

    def lists_of(self, x: np.ndarray) -> np.ndarray:
        return self._nearest(self.padded(x))

    def probes_of(self, x: np.ndarray, probes: int | None = None) -> np.ndarray:
        """The lists of each query, best first."""
        products = self.padded(x) @ self.centres.T
        return np.argsort(-products, axis=1, kind="stable")[:, :probes]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The vectors that codes stand for."""
        return self.books[np.arange(self.parts), codes].reshape(len(codes), -1)


def pair_products(q: np.ndarray, x: np.ndarray, at: np.ndarray, found: np.ndarray) -> np.ndarray:
    """q[at] . x[found], pair by pair, so that equal vectors have equal products, which a product of matrices does not promise."""
    step = max(1, PAIRS // x.shape[1])
    return np.concatenate([np.zeros(0), *(np.einsum("nd,nd->n", q[at[s : s + step]], x[found[s : s + step]]) for s in range(0, len(at), step))])


def kth(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row; minus infinity if there are fewer."""
    if scores.shape[1] < k:
        return np.full(len(scores), -np.inf)
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]


def nearest(q: np.ndarray, x: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int, coded: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row of x, product) of the k largest products of each query that reach its floor; equal ones go to the earlier row.

    coded is (decoded vectors as columns, how far each is from its own). A product errs by no more than the lengths of the
    query and of that gap allow. The RERANK best by codes are computed first; their k-th product leaves out every row that cannot
    reach it, and what is left is computed exactly. So codes save work, but lose no row. None: all rows are computed.
    """
    length = np.linalg.norm(q, axis=1)
    blur = 1e-12 * length * np.linalg.norm(x, axis=1).max(initial=0)  # rounding of sums
    open_ = ~own
    if coded is not None:
        told = q @ coded[0]
        told[own] = -np.inf
        if len(x) > RERANK:
            top = np.argpartition(told, len(x) - RERANK, axis=1)[:, len(x) - RERANK :]
            some = pair_products(q, x, np.repeat(np.arange(len(q)), RERANK), top.ravel()).reshape(top.shape)
            some[np.take_along_axis(own, top, 1)] = -np.inf
            floor = np.maximum(floor, kth(some, k) - blur)
        told += length[:, None] * coded[1] + blur[:, None]
        open_ &= told >= floor[:, None]
    if open_.mean() > DENSE:
        products = np.where(open_, q @ x.T, -np.inf)
        floor = np.maximum(floor, kth(products, k) - 2 * blur)
        open_ &= products >= (floor - blur)[:, None]
    at, found = np.nonzero(open_)
    score = pair_products(q, x, at, found)
    order = np.lexsort((found, -score, at))
    at, found, score = at[order], found[order], score[order]
    keep = (np.arange(len(at)) - np.searchsorted(at, at) < k) & (score >= floor[at])
    return at[keep], found[keep], score[keep]


def usable(vectors: DataFrame) -> DataFrame:
    """Distinct (vec_id, v) whose vector takes part, v in double precision; an empty one has no component that is not 0."""
    good = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where(
        F.col("vec_id").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    )
    return good.distinct()


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def probes_needed(coded: DataFrame, asked: DataFrame, model: Quantiser, k: int) -> int:
    """How many lists hold the share FOUND of the k true neighbours, by brute force for CHECKED queries."""
    lists = len(model.centres)
    if lists <= PROBES:
        return lists
    some = asked.orderBy(F.xxhash64("vec_id", F.lit(2)), "vec_id").limit(CHECKED).toArrow()
    if not some.num_rows:
        return PROBES
    names, q = some.column("vec_id").to_numpy(), matrix(some.column("v").combine_chunks())
    told = coded.sparkSession.sparkContext.broadcast((names, q))

    def nearest(batches):
        names, q = told.value
        score, found, held = np.full((len(q), k), -np.inf), np.zeros((len(q), k), np.int64), np.zeros((len(q), k), np.int32)
        for b in batches:
            ids, x = b.column(0).to_numpy(), matrix(b.column(1))
            new = q @ x.T
            new[names[:, None] == ids[None, :]] = -np.inf
            score = np.hstack([score, new])
            top = np.argpartition(-score, k - 1, axis=1)[:, :k]
            score = np.take_along_axis(score, top, 1)
            found = np.take_along_axis(np.hstack([found, np.broadcast_to(ids, new.shape)]), top, 1)
            held = np.take_along_axis(np.hstack([held, np.broadcast_to(b.column(2).to_numpy(), new.shape)]), top, 1)
        keep = np.isfinite(score)
        at = np.repeat(np.arange(len(q)), keep.sum(1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[keep]), pa.array(score[keep]), pa.array(held[keep])], ["at", "vec_id", "score", "list"])

    true = coded.select("vec_id", "v", "list").mapInArrow(nearest, "at int, vec_id long, score double, list int")
    place = F.row_number().over(Window.partitionBy("at").orderBy(F.desc("score"), "vec_id"))
    true = true.withColumn("rank", place).where(F.col("rank") <= k).select("at", "list").toArrow()  # bounded: CHECKED * k rows
    turn = np.argsort(model.probes_of(q), axis=1)  # when a query visits each list
    late = turn[true.column("at").to_numpy(), true.column("list").to_numpy()]
    share = np.cumsum(np.bincount(late, minlength=lists)) / max(len(late), 1)
    return max(PROBES, int(np.searchsorted(share, FOUND)) + 1) if len(late) else PROBES


def search(vectors: DataFrame, every: int = 20, k: int = 20, exact: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose vec_id is divisible by `every`."""
    good = staged(usable(vectors), "vectors")
    out = None
    for (length,) in good.select(F.size("v").alias("n")).distinct().orderBy("n").collect():
        found = search_one(good.where(F.size("v") == length), every, k, exact)
        out = found if out is None else out.unionByName(found)
    return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double") if out is None else out


def ranked(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place.cast("int")).where(F.col("rank") <= k)


def search_one(good: DataFrame, every: int, k: int, exact: bool) -> DataFrame:
    """search() over vectors of one length."""
    spark = good.sparkSession
    n = good.count()
    sample = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow()
    lists = min(MAX_LISTS, -(-n // LIST_ROWS))
    model = spark.sparkContext.broadcast(Quantiser(matrix(sample.column(0).combine_chunks()), lists))
    lists = len(model.value.centres)

    def index(batches):
        for b in batches:
            if len(b):
                x = matrix(b.column(1))
                codes = model.value.encode(model.value.padded(x))
                even = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2)))
                flat = pa.array([c.tobytes() for c in even[:, ::2] | (even[:, 1::2] << 4)], pa.binary())  # two codes a byte
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), flat, pa.array(model.value.lists_of(x).astype(np.int32))], ["vec_id", "v", "codes", "list"])

    coded = staged(good.mapInArrow(index, "vec_id long, v array<double>, codes binary, list int"), "codes")
    chosen = good.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    visited = lists if exact else probes_needed(coded, chosen.select(F.col("query_id").alias("vec_id"), F.col("q").alias("v")), model.value, k)
    blocks = coded.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return none
        right = right.sort_by("vec_id")
        ids, x = right.column("vec_id").to_numpy(), matrix(right.column("v").combine_chunks())
        packed = np.stack([np.frombuffer(c, np.uint8) for c in right.column("codes").to_pylist()])
        codes = np.stack([packed & 15, packed >> 4], 2).reshape(len(ids), -1)[:, : model.value.parts]
        names, q, floor = left.column("query_id").to_numpy(), matrix(left.column("q").combine_chunks()), left.column("floor").to_numpy()
        near = model.value.decode(codes)
        err = np.linalg.norm(model.value.padded(x) - near, axis=1)
        near = near[:, : x.shape[1]].T
        out = [none]
        for i in range(0, len(names), CHUNK):
            own = names[i : i + CHUNK, None] == ids[None, :]
            at, found, score = nearest(q[i : i + CHUNK], x, own, floor[i : i + CHUNK], k, None if exact else (near, err))
            out.append(pa.table({"query_id": names[i : i + CHUNK][at], "vec_id": ids[found], "score": score}))
        return pa.concat_tables(out)

    def visit(questions: DataFrame, first: int, last: int) -> DataFrame:
        """What the queries (query_id, q, floor) find in their lists from the first-th to before the last-th best."""

        def route(batches):
            for b in batches:
                if len(b):
                    probes = model.value.probes_of(matrix(b.column(1)))[:, first:last]
                    at = pa.array(np.repeat(np.arange(len(b)), probes.shape[1]))
                    yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in range(3)), pa.array(probes.ravel().astype(np.int32))], ["query_id", "q", "floor", "list"])

        asked = staged(questions.select("query_id", "q", "floor").mapInArrow(route, "query_id long, q array<double>, floor double, list int"), "queries")
        # how many blocks each list is cut into, on either side: at most MAX_LISTS rows
        cuts = F.broadcast(staged(blocks.join(asked.groupBy("list").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("turns")), "list"), "cuts"))
        candidates = coded.join(cuts, "list").select("list", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), "vec_id", "v", "codes")
        met = asked.join(cuts, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("query_id", F.lit(1)), F.col("turns")).cast("int").alias("turn"), "query_id", "q", "floor")
        parts = ["list", "block", "turn"]
        return met.groupBy(*parts).cogroup(candidates.groupBy(*parts)).applyInArrow(best, "query_id long, vec_id long, score double")

    def floors(found: DataFrame) -> DataFrame:
        """The k-th best of each query that has found k; minus infinity for the others."""
        per = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least"))
        return chosen.join(per, "query_id", "left").select("query_id", "q", F.when(F.col("n") >= k, F.col("least")).otherwise(float("-inf")).alias("floor"))

    found = staged(ranked(visit(chosen.withColumn("floor", F.lit(float("-inf"))), 0, 1), k), "found")
    if visited > 1:
        found = staged(ranked(found.drop("rank").unionByName(visit(floors(found), 1, visited)), k), "found")
    if visited < lists:
        short = floors(found).where(F.col("floor") == float("-inf"))
        if not short.isEmpty():
            found = ranked(found.drop("rank").unionByName(visit(short, visited, lists)), k)
    return found.select("query_id", "rank", "vec_id", "score")

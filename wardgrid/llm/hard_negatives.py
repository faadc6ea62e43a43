"""Hard negatives for contrastive training, found in packed R-trees.

Rows are tiled by sort-tile-recursion (STR): sorted by label and cut to slabs, each slab by the coordinate that varies most,
and so on; cuts come from a bounded sample (SAMPLE rows, the smallest hashes), every row is tiled. A tile of more than
ROWS rows is dealt to several blocks. Each block is one R-tree, packed by the same rule down to leaves of LEAF rows. A node's
minimum bounding box gives each coordinate an interval, and so bounds the inner product with an anchor from both sides.

A search asks for the k best rows of an anchor's label (its positives), or for the k best rows of other labels inside
each of its score windows (negatives: from half a positive's score to 0.95 of it). It is best first: the leaf with the highest upper
bound is read before the others; a node is dropped where its interval misses all windows, or lies strictly below the k-th score
found in each that it meets. TOGETHER anchors go down a tree at once, level by level. Anchors first visit the tile with the highest bound; what they find there sets the floors
below which other tiles are left out. Tiles are at most MAX_TILES boxes, so their boxes are broadcast; blocks and
anchors meet in groups of at most some ROWS by ANCHORS rows, so no group grows with the table.

Components are floored after multiplication by 256 and all products are exact integers. Rows with a null vec_id, label or
vector, or a null or non-finite component, take no part; neither do those with a component so large that a product could
pass a long. Rows repeated whole count once; rows that share a vec_id but differ are rows of their own, and each can be the
other's positive. Products exist between vectors of one length only; each length is searched for itself. Ties go to the
smaller vec_id, then to the smaller hash of the row. Fewer rows than asked for are all there are; no usable row, no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardgrid.llm.common import staged

SAMPLE = 20_000
MAX_TILES = 1024
ROWS, ANCHORS = 8192, 1024  # rows of a block and anchors that meet it at once, about
LEAF, FAN = 64, 8
TOGETHER = 64  # anchors that search a tree at once
DEPTH = 4  # coordinates that tiles are cut by, besides the label
LOWEST, HIGHEST = -(2**62), 2**62
ANSWER = "anchor_id long, anchor_key long, slot int, vec_id long, key long, score long"


def usable(vectors: DataFrame) -> DataFrame:
    """Distinct (vec_id, label, v, key) that take part: v holds floor(256 * x) as long, key is a hash of label and v."""
    x = F.col("embedding").cast("array<double>")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    most = F.sqrt(F.lit(2.0**61) / F.greatest(F.size("embedding"), F.lit(1)))
    good = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * 256) < most)))
    found = good.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.transform(x, lambda c: F.floor(c * 256)).alias("v"))
    return found.distinct().withColumn("key", F.xxhash64("label", "v"))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1 if len(column) and len(column.flatten()) else 0)


def fast(*parts: np.ndarray) -> bool:
    """Whether all products and their sums are exact in double precision."""
    return math.prod(float(np.abs(p).max(initial=0)) for p in parts) * max(1, parts[0].shape[1]) < 2.0**52


def product(a: np.ndarray, b: np.ndarray, doubles: bool) -> np.ndarray:
    return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64) if doubles else a @ b


def intervals(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) inner product of each q with anything inside each box."""
    doubles = fast(q, np.maximum(np.abs(low), np.abs(high)))
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    return product(up, low.T, doubles) + product(down, high.T, doubles), product(up, high.T, doubles) + product(down, low.T, doubles)


class Tiles:
    """Cuts of the label and of the coordinates that vary most, learnt from a sample: a tree of slabs."""

    def __init__(self, labels: np.ndarray, x: np.ndarray, tiles: int):
        self.ways = [-1, *np.argsort(-x.astype(np.float64).var(0), kind="stable")[:DEPTH].tolist()] if len(x) else [-1]
        self.slabs = max(1, math.ceil(tiles ** (1 / len(self.ways))))
        self.cuts: dict[tuple[int, ...], np.ndarray] = {}
        self._cut((), labels, x, tiles)
        self.number = {path: i for i, path in enumerate(sorted(self.leaves))}

    def _cut(self, path: tuple[int, ...], labels: np.ndarray, x: np.ndarray, tiles: int) -> None:
        if not path:
            self.leaves: list[tuple[int, ...]] = []
        if len(path) == len(self.ways) or tiles <= 1 or len(x) < 2:
            self.leaves.append(path)
            return
        way = labels if self.ways[len(path)] < 0 else x[:, self.ways[len(path)]]
        slabs = min(tiles, self.slabs)
        cuts = np.unique(np.sort(way)[[len(way) * k // slabs for k in range(1, slabs)]])
        self.cuts[path] = cuts
        slab = np.searchsorted(cuts, way, "right")
        for k in range(len(cuts) + 1):
            here = slab == k
            self._cut((*path, k), labels[here], x[here], max(1, round(tiles * here.mean())))

    def of(self, labels: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The tile of each row."""
        out = np.zeros(len(x), np.int32)

        def walk(path: tuple[int, ...], at: np.ndarray) -> None:
            if not len(at):
                return
            if path not in self.cuts:
                out[at] = self.number[path]
                return
            way = self.ways[len(path)]
            slab = np.searchsorted(self.cuts[path], labels[at] if way < 0 else x[at, way], "right")
            for k in np.unique(slab).tolist():
                walk((*path, k), at[slab == k])

        walk((), np.arange(len(x)))
        return out


class RTree:
    """Rows packed by sort-tile-recursion; all nodes in arrays, children of a node next to each other."""

    def __init__(self, labels: np.ndarray, x: np.ndarray):
        self.order = self._pack(labels, x)
        self.labels, self.x = labels[self.order], x[self.order]
        starts = np.arange(0, len(x), LEAF)
        level = [(np.minimum.reduceat(self.x, starts), np.maximum.reduceat(self.x, starts), np.minimum.reduceat(self.labels, starts), np.maximum.reduceat(self.labels, starts))]
        while len(level[-1][0]) > 1:
            at = np.arange(0, len(level[-1][0]), FAN)
            low, high, first, last = level[-1]
            level.append((np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.minimum.reduceat(first, at), np.maximum.reduceat(last, at)))
        level.reverse()  # the root first
        self.low, self.high, self.first, self.last = (np.concatenate([one[k] for one in level]) for k in range(4))
        self.children: list[tuple[int, int]] = []
        base = 0
        for above, below in zip(level, level[1:], strict=False):
            base += len(above[0])
            self.children += [(base + k * FAN, base + min((k + 1) * FAN, len(below[0]))) for k in range(len(above[0]))]
        self.inner = len(self.children)

    @staticmethod
    def _pack(labels: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Order of rows: slabs of the label, each cut by the coordinate that varies most, and so on."""
        ways = [labels, *(x[:, k] for k in np.argsort(-x.astype(np.float64).var(0), kind="stable")[:DEPTH])]
        parts = [np.arange(len(x))]
        for depth, way in enumerate(ways):
            cut = []
            for part in parts:
                slabs = math.ceil((len(part) / LEAF) ** (1 / (len(ways) - depth)))
                size = -(-len(part) // slabs)
                size = -(-size // LEAF) * LEAF  # slabs of whole leaves
                ordered = part[np.argsort(way[part], kind="stable")]
                cut += [ordered[i : i + size] for i in range(0, len(part), size)]
            parts = cut
        return np.concatenate(parts)


def descend(tree: RTree, q: np.ndarray, labels: np.ndarray, same: bool, of: np.ndarray, floor: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(leaves that some anchor wants, who wants them, their upper bounds), level by level: below a node that nobody wants nothing
    is looked at. of: the anchor of each window (floor, top)."""
    nodes = np.zeros(1, np.int64)
    while True:
        least, most = intervals(q, tree.low[nodes], tree.high[nodes])
        first, last, label = tree.first[nodes], tree.last[nodes], labels[:, None]
        held = (first <= label) & (label <= last) if same else ~((first == label) & (last == label))
        met = np.zeros(held.shape, bool)
        np.logical_or.at(met, of, (most[of] >= floor[:, None]) & (least[of] <= top[:, None]))
        wanted = held & met
        some = wanted.any(0)
        if nodes[0] >= tree.inner or not some.any():
            return nodes[some], wanted[:, some], most[:, some]
        nodes = np.concatenate([np.arange(*tree.children[n]) for n in nodes[some].tolist()])


def kth(scores: np.ndarray, fits: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of the scores that fit in each row, or the least number there is."""
    if scores.shape[1] < k:
        return np.full(len(scores), np.iinfo(np.int64).min)
    return np.partition(np.where(fits, scores, np.iinfo(np.int64).min), scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]


def best_first(tree: RTree, x: np.ndarray, ids: np.ndarray, keys: np.ndarray, own: tuple[np.ndarray, np.ndarray], q: np.ndarray, labels: np.ndarray, same: bool, of: np.ndarray, floor: np.ndarray, top: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, row, score) of the k best of the tree's rows x in each window (floor, top) of an anchor `of`, of the same or of
    other labels, but not own. All anchors search together: each reads its leaf with the highest bound, and what it finds there is
    its floor when all descend again."""
    exact = q.astype(np.int64)
    leaves, wanted, most = descend(tree, exact, labels, same, of, floor, top)
    if len(leaves):
        best = leaves[np.where(wanted, most, np.iinfo(np.int64).min).argmax(1)] - tree.inner
        rows = best[:, None] * LEAF + np.arange(LEAF)
        there = rows < len(x)
        rows = np.minimum(rows, len(x) - 1)
        scores = np.einsum("ard,ad->ar", x[rows], q).astype(np.int64)
        fits = there & ((tree.labels[rows] == labels[:, None]) == same) & ~((ids[rows] == own[0][:, None]) & (keys[rows] == own[1][:, None]))
        floor = np.maximum(floor, kth(scores[of], fits[of] & (scores[of] <= top[:, None]), k))
        leaves, wanted, most = descend(tree, exact, labels, same, of, floor, top)
    if not len(leaves):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows = ((leaves - tree.inner)[:, None] * LEAF + np.arange(LEAF)).ravel()
    rows = rows[rows < len(x)]
    scores = (q @ x[rows].T).astype(np.int64)
    fits = ((tree.labels[rows] == labels[:, None]) == same) & ~((ids[rows] == own[0][:, None]) & (keys[rows] == own[1][:, None]))
    scores, fits = scores[of], fits[of]
    fits &= (scores >= floor[:, None]) & (scores <= top[:, None])
    fits &= scores >= kth(scores, fits, k)[:, None]
    window, at = np.nonzero(fits)
    score, row = scores[window, at], rows[at]
    order = np.lexsort((keys[row], ids[row], -score, window))
    window, row, score = window[order], row[order], score[order]
    keep = np.arange(len(window)) - np.searchsorted(window, window) < k
    return window[keep], row[keep], score[keep]


def boxes_of(tiled: DataFrame) -> list:
    """One row per tile: its bounding box, labels and size; each task merges its own rows first."""
    shape = "tile int, low array<long>, high array<long>, first long, last long, n long"

    def merged(tiles: np.ndarray, low: np.ndarray, high: np.ndarray, first: np.ndarray, last: np.ndarray, n: np.ndarray) -> dict:
        order = np.argsort(tiles, kind="stable")
        names, at = np.unique(tiles[order], return_index=True)
        return {
            t: (lo, hi, int(f), int(la), int(m))
            for t, lo, hi, f, la, m in zip(names.tolist(), np.minimum.reduceat(low[order], at), np.maximum.reduceat(high[order], at), np.minimum.reduceat(first[order], at), np.maximum.reduceat(last[order], at), np.add.reduceat(n[order], at), strict=True)
        }

    def joined(a: tuple, b: tuple) -> tuple:
        return np.minimum(a[0], b[0]), np.maximum(a[1], b[1]), min(a[2], b[2]), max(a[3], b[3]), a[4] + b[4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        for b in batches:
            if len(b):
                x, labels = matrix(b.column(2)), b.column(1).to_numpy()
                for t, box in merged(b.column(0).to_numpy(), x, x, labels, labels, np.ones(len(b), np.int64)).items():
                    held[t] = joined(held[t], box) if t in held else box
        if held:
            columns = [pa.array(list(held), pa.int32()), *(pa.array([box[i].tolist() for box in held.values()], pa.list_(pa.int64())) for i in range(2)), *(pa.array([box[i] for box in held.values()], pa.int64()) for i in range(2, 5))]
            yield pa.RecordBatch.from_arrays(columns, ["tile", "low", "high", "first", "last", "n"])

    def merge(key: tuple, parts: pa.Table) -> pa.Table:
        """The partial boxes of one tile, one per task."""
        low, high = matrix(parts.column("low")), matrix(parts.column("high"))
        one = [[key[0].as_py()], [low.min(0).tolist()], [high.max(0).tolist()], [min(parts.column("first").to_pylist())], [max(parts.column("last").to_pylist())], [sum(parts.column("n").to_pylist())]]
        return pa.table([pa.array(v, t) for v, t in zip(one, [pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64()], strict=True)], ["tile", "low", "high", "first", "last", "n"])

    return tiled.select("tile", "label", "v").mapInArrow(run, shape).groupBy("tile").applyInArrow(merge, shape).orderBy("tile").collect()  # at most MAX_TILES and a few


class Index:
    """Tiled rows of one vector length."""

    def __init__(self, rows: DataFrame):
        spark = rows.sparkSession
        n = rows.count()
        sample = rows.orderBy(F.xxhash64("vec_id", "key"), "vec_id", "key").limit(SAMPLE).select("label", "v").toArrow()
        cuts = spark.sparkContext.broadcast(Tiles(sample.column("label").to_numpy(), matrix(sample.column("v")), min(MAX_TILES, -(-n // ROWS))))

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if len(b):
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cuts.value.of(b.column(1).to_numpy(), matrix(b.column(2))))], ["vec_id", "label", "v", "key", "tile"])

        self.rows = staged(rows.select("vec_id", "label", "v", "key").mapInArrow(deal, "vec_id long, label long, v array<long>, key long, tile int"), "tiled")
        found = boxes_of(self.rows)
        self.tiles = [r.tile for r in found]
        self.blocks = spark.createDataFrame([(r.tile, -(-r.n // ROWS)) for r in found], "tile int, blocks long")
        low, high = (np.array([r[c] for r in found], np.int64).reshape(len(found), -1) for c in ("low", "high"))
        self.boxes = spark.sparkContext.broadcast((np.array(self.tiles, np.int32), low, high, np.array([r.first for r in found]), np.array([r.last for r in found])))

    def _visit(self, asked: DataFrame, same: bool, k: int, first: bool) -> DataFrame:
        """What anchors (anchor_id, anchor_key, label, q, windows) find in the tile with the highest bound, or in all others."""
        boxes = self.boxes

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tiles, low, high, label_low, label_high = boxes.value
            for b in batches:
                if not len(b):
                    continue
                label = b.column(2).to_numpy()[:, None]
                least, most = intervals(matrix(b.column(3)), low, high)
                held = (label_low <= label) & (label <= label_high) if same else ~((label_low == label) & (label_high == label))
                fits = np.zeros_like(held)
                for i, windows in enumerate(b.column(4).to_pylist()):
                    for floor, top, _ in windows:
                        fits[i] |= (most[i] >= floor) & (least[i] <= top)
                # the first tile is chosen by bounds that do not change as floors rise
                start = np.where(held, most, np.iinfo(np.int64).min).argmax(1)
                go = fits & held
                chosen = np.arange(len(tiles)) == start[:, None]
                at, tile = np.nonzero(go & chosen if first else go & ~chosen)
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([*(c.take(take) for c in b.columns), pa.array(tiles[tile])], ["anchor_id", "anchor_key", "label", "q", "windows", "tile"])

        shape = "anchor_id long, anchor_key long, label long, q array<long>, windows array<array<long>>"
        routed = staged(asked.select("anchor_id", "anchor_key", "label", "q", "windows").mapInArrow(route, f"{shape}, tile int"), "routed")
        turns = routed.groupBy("tile").agg(F.ceil(F.count("*") / ANCHORS).alias("turns"))
        cuts = F.broadcast(staged(self.blocks.join(turns, "tile"), "cuts"))  # one row a tile
        parts = ["tile", "block", "turn"]
        met = routed.join(cuts, "tile").withColumn("turn", F.pmod(F.xxhash64("anchor_id", "anchor_key"), "turns")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks", "turns")
        rows = self.rows.join(cuts, "tile").withColumn("block", F.pmod(F.xxhash64("vec_id", "key", F.lit(1)), "blocks")).withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1))).drop("blocks", "turns")

        def search(anchors: pa.Table, rows: pa.Table) -> pa.Table:
            out = [pa.table({c: pa.array([], pa.int32() if c == "slot" else pa.int64()) for c in ("anchor_id", "anchor_key", "slot", "vec_id", "key", "score")})]
            if anchors.num_rows and rows.num_rows:
                x = matrix(rows.column("v"))
                tree = RTree(rows.column("label").to_numpy(), x)
                ids, keys = rows.column("vec_id").to_numpy()[tree.order], rows.column("key").to_numpy()[tree.order]
                q = matrix(anchors.column("q"))
                kind = np.float64 if fast(q, x) else np.int64
                x, q = tree.x.astype(kind), q.astype(kind)
                names, marks, labels = (anchors.column(c).to_numpy() for c in ("anchor_id", "anchor_key", "label"))
                windows = anchors.column("windows").to_pylist()
                for s in range(0, len(q), TOGETHER):
                    part = slice(s, s + TOGETHER)
                    of = np.repeat(np.arange(len(names[part])), [len(w) for w in windows[part]])
                    floor, top, slot = np.array([w for some in windows[part] for w in some], np.int64).reshape(-1, 3).T
                    at, row, score = best_first(tree, x, ids, keys, (names[part], marks[part]), q[part], labels[part], same, of, floor, top, k)
                    out.append(pa.table({"anchor_id": names[part][of[at]], "anchor_key": marks[part][of[at]], "slot": slot[at].astype(np.int32), "vec_id": ids[row], "key": keys[row], "score": score}))
            return pa.concat_tables(out)

        return met.groupBy(*parts).cogroup(rows.groupBy(*parts)).applyInArrow(search, ANSWER)

    def best(self, asked: DataFrame, same: bool, k: int) -> DataFrame:
        """(anchor_id, anchor_key, slot, rank, vec_id, key, score): the k best in each window [floor, top, slot]."""
        name = ["anchor_id", "anchor_key"]
        found = staged(ranked(self._visit(asked, same, k, True), k), "first")
        if len(self.tiles) == 1:
            return found
        floors = found.where(F.col("rank") == k).groupBy(*name).agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("kth"))  # one entry a window
        raised = F.transform("windows", lambda w: F.array(F.greatest(w[0], F.coalesce(F.col("kth")[w[2].cast("int")], w[0])), w[1], w[2]))
        rest = self._visit(asked.join(floors, name, "left").withColumn("windows", raised), same, k, False)
        return ranked(found.drop("rank").unionByName(rest), k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("anchor_id", "anchor_key", "slot").orderBy(F.desc("score"), "vec_id", "key"))
    return found.withColumn("rank", place.cast("int")).where(F.col("rank") <= k)


def mine(vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each row whose vec_id is divisible by `every`."""
    rows = staged(usable(vectors), "usable")
    lengths = [r.n for r in rows.select(F.size("v").alias("n")).distinct().orderBy("n").collect()]
    found = [mine_one(rows.where(F.size("v") == n), every, positives, negatives) for n in lengths]
    empty = vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return reduce(DataFrame.unionByName, found) if found else empty


def mine_one(rows: DataFrame, every: int, positives: int, negatives: int) -> DataFrame:
    """mine() over vectors of one length."""
    index = Index(rows)
    name = ["anchor_id", "anchor_key"]
    anchors = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("anchor_id"), F.col("key").alias("anchor_key"), "label", F.col("v").alias("q"))
    whole = F.array(F.array(F.lit(LOWEST), F.lit(HIGHEST), F.lit(1)).cast("array<long>"))
    near = staged(index.best(anchors.withColumn("windows", whole), True, positives), "positives")
    # 50 p <= 100 n <= 95 p, in whole numbers: n from ceil(p / 2) to floor(19 p / 20)
    p = F.col("score")
    window = F.array(F.expr("(score + 1) div 2"), F.expr("score - (score + 19) div 20"), F.col("rank").cast("long"))
    open_ = near.where(p >= 0).groupBy(*name).agg(F.collect_list(window).alias("windows"))  # a negative score leaves no window; at most `positives` entries
    hard = index.best(anchors.join(open_, name), False, negatives)
    told = near.select(*name, F.col("rank").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return hard.join(told, [*name, "slot"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))

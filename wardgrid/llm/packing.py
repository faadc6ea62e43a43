"""Best-fit packing of documents into sequences by bin completion.

Documents become token ids plus one end id. Longer ones are cut into full sequences and a first, shorter piece. What
must be packed is then a multiset of lengths of at most `capacity`, so the search runs on the histogram of lengths
(at most `capacity` rows whatever the corpus): bin completion around the largest length enumerates undominated
fillings, prunes by waste bounds and keeps the best-fit packing as incumbent. Its plan is a list of patterns with
multiplicities; pieces find their place by their rank within their length, an equi-join with that small plan. Packing is
NP-hard and each search is bounded, so the result states how many sequences there are and a proven lower bound: where
both are equal the packing is optimal, else the difference is the gap.

Null text is empty (one end id). Repeated rows are packed as often as they occur. An empty table gives no rows.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardgrid.llm.common import staged

ALLOWED = (8, 16, 2, 32)  # waste of a bin up to which few lengths are preferred to a tighter filling, in order of trial
SEARCH_NODES = 200  # bins that one search may open beyond those of a single descent
Filling = tuple[tuple[int, int], ...]
Pattern = tuple[Filling, int]


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Fewest bins: items above capacity - k stand alone, those above half never share a bin, the rest fill up by volume."""
    size = np.arange(len(counts))
    best = -(-int((size * counts).sum()) // capacity)
    items, volume = np.cumsum(counts), np.cumsum(size * counts)
    half = capacity // 2
    for k in range(0, half + 1):
        alone = int(items[-1] - items[capacity - k])
        large = int(items[capacity - k] - items[half])
        room = large * capacity - int(volume[capacity - k] - volume[half])
        small = int(volume[half] - (volume[k - 1] if k else 0))
        best = max(best, alone + large + max(0, -(-(small - room) // capacity)))
    return best


def reachable(sizes: list[int], counts: list[int], room: int) -> list[int]:
    """For each place in sizes, the sums up to room that the sizes from there on can give, as bits of a number."""
    out = [1] * (len(sizes) + 1)
    for j in range(len(sizes) - 1, -1, -1):
        sums, left, step = out[j + 1], min(counts[j], room // sizes[j]), 1
        while left > 0:
            take = min(step, left)
            sums |= sums << (sizes[j] * take)
            left, step = left - take, step * 2
        out[j] = sums & ((1 << (room + 1)) - 1)
    return out


def tight_fillings(left: np.ndarray, room: int) -> Iterator[tuple[int, Filling]]:
    """(waste, filling) of a room with any number of lengths: least waste first, then larger lengths first. Only sums that
    can be met are followed, so each step leads to a filling."""
    sizes = [int(s) for s in np.flatnonzero(left[: room + 1])[::-1]]
    counts = [int(left[s]) for s in sizes]
    sums = reachable(sizes, counts, room)

    def descend(j: int, rest: int, chosen: Filling) -> Iterator[Filling]:
        if rest == 0:
            yield chosen
            return
        while j < len(sizes) and sizes[j] > rest:
            j += 1
        if j == len(sizes) or not sums[j] >> rest & 1:
            return
        s = sizes[j]
        for m in range(min(counts[j], rest // s), -1, -1):
            if sums[j + 1] >> (rest - m * s) & 1:
                yield from descend(j + 1, rest - m * s, (*chosen, (s, m)) if m else chosen)

    for waste in range(room + 1):
        if sums[0] >> (room - waste) & 1:
            for filling in descend(0, room - waste, ()):
                yield waste, filling


def completions(left: np.ndarray, room: int, keep: int) -> list[tuple[int, Filling]]:
    """(waste, filling) of the room beside the largest document: the undominated ones of one and of two lengths, then the
    tightest of more. A filling is dominated if one of its lengths could give way to a larger one."""
    sizes = np.flatnonzero(left[: room + 1])
    if not len(sizes):
        return [(room, ())]
    top = int(sizes[-1])
    out: dict[Filling, int] = {((top, 1),): room - top}
    if len(sizes) > 1 or left[top] > 1:
        # with each first length, the largest second one that still fits
        at = np.searchsorted(sizes, room - sizes, side="right") - 1
        at = np.where((at >= 0) & (sizes[np.maximum(at, 0)] == sizes) & (left[sizes] < 2), at - 1, at)
        for a, b in sorted(((int(s), int(sizes[k])) for s, k in zip(sizes, at, strict=True) if k >= 0 and sizes[k] <= s), key=lambda x: (room - sum(x), -x[0]))[:keep]:
            out.setdefault(((a, 2),) if a == b else ((a, 1), (b, 1)), room - a - b)
    for waste, filling in islice(tight_fillings(left, room), keep):
        out.setdefault(filling, waste)
    return [(w, f) for f, w in out.items()]


def best_fit(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Best-fit decreasing on the histogram: each bin takes the largest length that still fits, again and again."""
    left, out = counts.copy(), []
    while left.any():
        used: dict[int, int] = {}
        room = capacity
        while room > 0:
            fits = np.flatnonzero(left[: room + 1])
            fits = [s for s in fits[::-1] if left[s] > used.get(int(s), 0)][:1]
            if not fits:
                break
            s = int(fits[0])
            m = min(room // s, int(left[s]) - used.get(s, 0))
            used[s] = used.get(s, 0) + m
            room -= m * s
        times = min(int(left[s]) // m for s, m in used.items())
        for s, m in used.items():
            left[s] -= m * times
        out.append((tuple(sorted(used.items(), reverse=True)), times))
    return out


def bins(plan: list[Pattern]) -> int:
    return sum(times for _, times in plan)


def complete(counts: np.ndarray, capacity: int, allowed: int, best: list[Pattern], least: int, nodes: int) -> list[Pattern]:
    """Bin completion by depth first: the best packing found before nodes bins were opened, or the one given.

    Of the completions whose waste is allowed, those of few lengths come first, as they leave small documents for later;
    tighter ones follow, then looser ones. A branch ends once its waste exceeds what a better packing can lose in all, or
    once the bound on what is left shows that it cannot become one.
    """
    volume, opened, known = int((np.arange(len(counts)) * counts).sum()), 0, bins(best)
    stack: list[tuple[np.ndarray, list[Pattern], int, int]] = [(counts, [], 0, 0)]
    while stack and known > least and opened < nodes:
        left, done, used, waste = stack.pop()
        if not left.any():
            if used < known:
                best, known = done, used
            continue
        if waste > (known - 1) * capacity - volume or used + lower_bound(left, capacity) >= known:
            continue
        opened += 1
        largest = int(np.flatnonzero(left)[-1])
        rest = left.copy()
        rest[largest] -= 1
        ranked = sorted(completions(rest, capacity - largest, 24), key=lambda x: (x[0] > allowed, sum(m for _, m in x[1]) if x[0] <= allowed else x[0], x[0]))
        for lost, filling in reversed(ranked[:3]):
            whole = Counter({largest: 1})
            whole.update(dict(filling))
            times = min(int(left[s]) // m for s, m in whole.items())
            after = left.copy()
            for s, m in whole.items():
                after[s] -= m * times
            stack.append((after, [*done, (tuple(sorted(whole.items(), reverse=True)), times)], used + times, waste + lost * times))
    return best


def plan_bins(histogram: dict[int, int], capacity: int) -> tuple[list[Pattern], int]:
    """(patterns ((length, how many), ...) with how many bins use each, a proven lower bound): covers the histogram exactly.

    The best-fit packing is the incumbent; searches with other allowances for waste try to better it until one meets the
    bound. Where none does, the best so far stands, and its gap to the bound tells.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for s, n in histogram.items():
        counts[s] += n
    full = [(((capacity, 1),), int(counts[capacity]))] if counts[capacity] else []
    counts[capacity] = 0
    best, least = best_fit(counts, capacity), lower_bound(counts, capacity)
    nodes = SEARCH_NODES + int(min(counts.sum(), 2 * capacity))  # one descent opens no more than this less SEARCH_NODES
    for allowed in ALLOWED:
        best = complete(counts, capacity, allowed, best, least, nodes)
    return full + best, bins(full) + least


def plan_rows(plan: list[Pattern], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, per sequence, offset): where the pieces of a length go, by rank."""
    taken, sequence, out = np.zeros(capacity + 1, np.int64), 0, []
    for pattern, times in plan:
        offset = 0
        for s, m in pattern:
            out.append((s, int(taken[s]), m * times, sequence, m, offset))
            taken[s] += m * times
            offset += s * m
        sequence += times
    return out


class Encoder:
    """Byte-level BPE ids; special strings inside texts become their special ids, as by the tokenizer's default."""

    def __init__(self, tokenizer_json: str):
        import public_tokenizers
        import tiktoken

        spec = json.loads(tokenizer_json)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(c): c for c in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
        self.coder = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.special = list(special)

    def ids(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.array(self.coder.encode(text, allowed_special="all"), np.uint32)
        return np.array(self.coder.encode_ordinary(text), np.uint32)


_ENCODERS: dict[str, Encoder] = {}


def encoder(tokenizer_json: str) -> Encoder:
    if tokenizer_json not in _ENCODERS:
        _ENCODERS[tokenizer_json] = Encoder(tokenizer_json)
    return _ENCODERS[tokenizer_json]


def pieces_of(docs: DataFrame, tokenizer_file: str, end_id: int, capacity: int) -> DataFrame:
    """One row per piece, with its rank among the pieces of its length in its own partition (part, nth)."""
    with open(tokenizer_file, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        code, part, seen = encoder(shared.value), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in batches:
            row: list[int] = []
            cut: list[tuple[int, int, int, int]] = []
            for i, text in enumerate(b.column(1)):
                ids = np.append(code.ids(text.as_py()), np.uint32(end_id)).astype("<u4")
                first = len(ids) % capacity or capacity
                edges = [0, *range(min(first, len(ids)), len(ids) + 1, capacity)]
                raw = memoryview(ids.tobytes())
                for k, (s, e) in enumerate(zip(edges, edges[1:], strict=False)):
                    row.append(i)
                    cut.append((k, s, e - s, zlib.crc32(raw[4 * s : 4 * e])))
            m = np.array(cut, np.int64).reshape(-1, 4)
            length = m[:, 2]
            order = np.argsort(length, kind="stable")
            ranked = length[order]
            nth = np.empty(len(m), np.int64)
            nth[order] = np.arange(len(m)) - np.searchsorted(ranked, ranked) + seen[ranked]
            seen += np.bincount(length, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row, pa.int64())), pa.array(m[:, 0], pa.int32()), pa.array(m[:, 1]), pa.array(length), pa.array(m[:, 3]), pa.array(np.full(len(m), part, np.int64)), pa.array(nth)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"],
            )

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part long, nth long")


def pack(docs: DataFrame, capacity: int = 1024, end_id: int = 2, tokenizer_file: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset, n_sequences, least), one row per piece; n_sequences
    is how many sequences there are in all, least a proven lower bound of it."""
    if tokenizer_file is None:
        import public_tokenizers

        tokenizer_file = public_tokenizers.path("byte_bpe_50k.json")
    spark = docs.sparkSession
    pieces = staged(pieces_of(docs, tokenizer_file, end_id, capacity), "pieces")
    per_part = staged(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths")
    histogram = {r[0]: r[1] for r in per_part.groupBy("length").agg(F.sum("n")).collect()}  # at most `capacity` rows
    patterns, least = plan_bins(histogram, capacity)
    plan = spark.createDataFrame(plan_rows(patterns, capacity), "length long, first long, ranks long, sequence long, per long, place long")
    before = per_part.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).drop("n")
    # lengths x partitions grows with the input, so it is never broadcast
    ranked = pieces.join(before.hint("shuffle_hash"), ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth"))
    at = F.col("rank") - F.col("first")
    # each pattern uses up at least one length, so the plan is bounded by the capacity
    return ranked.join(F.broadcast(plan), "length").where((at >= 0) & (at < F.col("ranks"))).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("sequence") + F.floor(at / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("place") + at % F.col("per") * F.col("length")).cast("long").alias("offset"),
        F.lit(bins(patterns)).cast("long").alias("n_sequences"), F.lit(least).cast("long").alias("least"),
    )

"""Near-duplicate classes by ProbMinHash, banding and verification.

Shingles are five words in a row (fewer if the text has fewer), weighted 1 + ln(times they occur). In each document
every shingle is a Poisson process whose rate is its weight; an arrival carries a register, each register keeps its
first arrival, and a shingle stops once it is later than every register. Two registers agree with the probability
Jaccard similarity of the weighted sets. Links are defined by the plain sets, so a text that repeats shingles is hashed
with unit weights too; for other texts both are the same. Registers are banded; a bucket's members are compared with its most central
member; what stays apart is joined by a prefix filter, which loses no link and emits no bucket's pairs. Links are verified exactly:
the Jaccard similarity of the shingle sets is at least THRESHOLD. Classes are the connected components of links.

Texts with the same words in a row are one node from the start, so a group of exact copies costs one row. A null or
wordless text is alone in its class. A row without doc_id counts for its group but gets its class like the others
(null if none of the group has an id). Repeated rows give repeated results; rows that share a doc_id but not a text
are judged apart. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardgrid.llm.common import let, staged, windows, without_rows, words_of
from wardgrid.llm.components import components

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 5  # a pair at the threshold shares a band with probability 0.9999
BLOCK = 400_000
BROADCAST_WANTED = 400_000  # rows of (key, doc_id) sent to all executors; more of them are joined by a shuffle
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64 bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingles(words: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle) of every window of word hashes; edges: where each document starts, and the end."""
    sizes = np.diff(edges)
    width = np.minimum(sizes, WORDS)
    n = sizes - width + (sizes > 0)
    rows = np.repeat(np.arange(len(sizes)), n)
    first = np.repeat(edges[:-1] - np.cumsum(n) + n, n) + np.arange(n.sum())
    own, out = width[rows], np.zeros(len(rows), np.uint64)
    for k in range(WORDS):
        here = own > k
        out[here] = mix(out[here] * U(0x9E3779B97F4A7C15) + words[first[here] + k])
    return rows, out


def weighted(rows: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, shingle) and the weight of each."""
    order = np.lexsort((items, rows))
    rows, items = rows[order], items[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (items[1:] != items[:-1])
    at = np.flatnonzero(new)
    return rows[at], items[at], 1 + np.log(np.diff(np.append(at, len(rows))))


def prob_min_hash(rows: np.ndarray, items: np.ndarray, weights: np.ndarray, n: int, registers: int) -> np.ndarray:
    """The item that holds each register, (n, registers); 0 for documents without items."""
    first, holder = np.full(n * registers, np.inf), np.zeros(n * registers, np.uint64)
    time, turn = np.zeros(len(rows)), 0
    while len(rows):
        steps = 1 if turn < 3 else 16  # few items are left by then, those of short texts
        with np.errstate(over="ignore"):
            seeds = mix(items[:, None] + np.arange(turn + 1, turn + steps + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
        gaps = -np.log(((seeds >> U(11)).astype(float) + 0.5) / (1 << 53)) / weights[:, None]
        arrivals = time[:, None] + np.cumsum(gaps, axis=1)
        slots = rows[:, None] * registers + (mix(seeds) % U(registers)).astype(np.int64)
        flat, when = slots.ravel(), arrivals.ravel()
        np.minimum.at(first, flat, when)
        won = first[flat] == when
        holder[flat[won]] = np.repeat(items, steps)[won]
        time, turn = arrivals[:, -1], turn + steps
        last = first.reshape(n, registers).max(1) if turn < 3 or n < 64 else None
        if last is None:
            live = np.unique(rows)
            last = np.zeros(n)
            last[live] = first.reshape(n, registers)[live].max(1)
        stay = time <= last[rows]
        rows, items, weights, time = rows[stay], items[stay], weights[stay], time[stay]
    return holder.reshape(n, registers)


def banded(words: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct shingles of each document, its bucket hashes, where those of each document start, and the end).

    BANDS buckets by weight, and as many by unit weights if the document repeats shingles.
    """
    n = len(edges) - 1
    rows, items, weights = weighted(*shingles(words, edges))
    repeats = np.zeros(n, bool)
    repeats[rows[weights > 1]] = True
    again = np.cumsum(repeats) - 1 + n  # these documents stand a second time, after all others
    twice = repeats[rows]
    held = prob_min_hash(np.append(rows, again[rows[twice]]), np.append(items, items[twice]), np.append(weights, np.ones(twice.sum())), n + repeats.sum(), BANDS * ROWS)
    held = held.reshape(-1, BANDS, ROWS)
    out = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(held), 1))
    for k in range(ROWS):
        out = mix(out * U(0x9E3779B97F4A7C15) + held[:, :, k])
    order = np.argsort(np.append(np.arange(n), np.flatnonzero(repeats)), kind="stable")
    starts = np.append(0, np.cumsum(BANDS * (1 + repeats)))
    return np.bincount(rows, minlength=n), out[order].ravel().view(np.int64), starts


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, th, key, size, bands): th is the text's hash; key stands for the words in their order, null for wordless texts."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    both = let(words_of("text"), lambda w: F.struct(F.when(F.size(w) > 0, F.unhex(F.md5(F.array_join(w, " ")))).alias("key"), F.transform(w, lambda x: F.xxhash64(x)).alias("h")))
    ready = docs.select("doc_id", F.xxhash64("text").alias("th"), both.alias("s")).select("doc_id", "th", "s.key", "s.h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            edges, words = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy().view(np.uint64)
            at = 0
            while at < len(b):
                to = max(at + 1, int(np.searchsorted(edges, edges[at] + BLOCK, side="right")) - 1)
                part = edges[at : to + 1]
                size, bands, starts = banded(words[part[0] : part[-1]], part - part[0])
                flat = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(bands))
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(at, to - at) for c in range(3)), pa.array(size.astype(np.int32)), flat], ["doc_id", "th", "key", "size", "bands"])
                at = to

    return ready.mapInArrow(run, f"doc_id {kind}, th long, key binary, size int, bands array<long>")


def shingle_set(norm: Column | str) -> Column:
    """Distinct shingles of a text of single-spaced words."""
    return F.array_distinct(windows(F.transform(F.split(norm, " "), lambda w: F.xxhash64(w)), WORDS))


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, norm): the single-spaced words of the wanted (key, doc_id)."""
    if wanted.count() <= BROADCAST_WANTED:
        wanted = F.broadcast(wanted)
    found = docs.select("doc_id", "text").join(wanted, "doc_id").select("key", F.concat_ws(" ", words_of("text")).alias("norm"))
    return found.where(F.unhex(F.md5("norm")) == F.col("key")).dropDuplicates(["key"])


def verified(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b) of those pairs of keys whose texts are similar enough."""
    asked = pairs.select("a", "b", F.col("a").alias("key"), F.lit(0).alias("side")).unionByName(pairs.select("a", "b", F.col("b").alias("key"), F.lit(1).alias("side")))
    side = lambda n: F.max(F.when(F.col("side") == n, F.col("norm")))
    both = texts.join(asked, "key").groupBy("a", "b").agg(side(0).alias("x"), side(1).alias("y"))
    sets = both.select("a", "b", shingle_set("x").alias("x"), shingle_set("y").alias("y"))
    same = F.size(F.array_intersect("x", "y"))
    return sets.select("a", "b", same.alias("same"), (F.size("x") + F.size("y") - same).alias("either")).where(F.col("same") >= THRESHOLD * F.col("either")).select("a", "b")


def prefix_pairs(texts: DataFrame, open_: DataFrame) -> DataFrame:
    """(a, b) of open (key, component) that may be linked across components, by an exact prefix filter: of two sets
    that are similar enough, the rarest 1 - THRESHOLD of the one's shingles (and one more) meet the other's."""
    # numbers stand for keys and components, as each shingle carries them through the shuffles
    named = staged(open_.withColumn("no", F.monotonically_increasing_id()), "named")
    group = named.groupBy("component").agg(F.min("no").alias("group"))
    sets = texts.join(named.join(group, "component").select("key", "no", "group"), "key").select("key", "no", "group", shingle_set("norm").alias("s"))
    sets = staged(sets, "sets")
    met = sets.select("group", F.explode("s").alias("s")).groupBy("s").agg(F.count("*").alias("df"), F.min("group").alias("lo"), F.max("group").alias("hi")).where("df > 1")
    met = staged(met.select("s", "df", (F.col("lo") < F.col("hi")).alias("across")), "shingles")
    common = sets.select("no", F.explode("s").alias("s")).join(met, "s").groupBy("no").agg(F.array_sort(F.collect_list(F.struct("df", "s", "across"))).alias("common"))
    near = common.join(sets.select("no", "key", "group", F.size("s").alias("n")), "no")
    alone = F.col("n") - F.size("common")  # shingles of this text alone lead the prefix
    prefix = F.greatest(F.col("n") - F.ceil(F.col("n") * THRESHOLD - 1e-9) + 1 - alone, F.lit(0)).cast("int")
    post = near.select("key", "group", "n", alone.alias("alone"), F.posexplode(F.slice("common", F.lit(1), prefix)).alias("at", "c")).where("c.across")
    # `rest`: this shingle and those that follow it
    post = post.select(F.col("c.s").alias("s"), "key", "group", "n", (F.col("n") - F.col("alone") - F.col("at")).alias("rest"))
    post = staged(post, "prefixes")
    other = post.select("s", F.col("key").alias("b"), F.col("group").alias("with"), F.col("n").alias("m"), F.col("rest").alias("rest_b"))
    enough = F.least("rest", "rest_b") >= (F.col("n") + F.col("m")) * (THRESHOLD / (1 + THRESHOLD)) - 1e-9  # what the first shared shingle leaves room for
    pairs = post.join(other, "s").where((F.col("group") < F.col("with")) & (F.col("n") >= THRESHOLD * F.col("m")) & (F.col("m") >= THRESHOLD * F.col("n")) & enough)
    return pairs.select(F.least("key", "b").alias("a"), F.greatest("key", "b").alias("b")).distinct()


def key_classes(docs: DataFrame, seen: DataFrame) -> DataFrame:
    """(key, component, class_id) of every key of the written signatures."""
    nodes = seen.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("doc"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    nodes = staged(nodes.withColumn("no", F.monotonically_increasing_id()), "nodes")
    # most buckets hold one text: until those are gone, a row is a bucket and a number
    laid = nodes.where("doc is not null").select("no", F.explode(F.array_distinct("bands")).alias("bucket"))
    crowd = staged(laid.groupBy("bucket").agg(F.count("*").alias("crowd")).where("crowd > 1"), "buckets")
    member = staged(laid.join(crowd, "bucket").join(nodes.select("no", "key", "doc", "size"), "no").drop("no"), "members")
    central = staged(member.groupBy("key").agg(F.sum("crowd").alias("central")), "central")
    member = staged(member.join(central, "key"), "members")
    texts = staged(texts_of(docs, staged(member.select("key", F.col("doc").alias("doc_id")).distinct(), "wanted")), "texts")
    # each member against the most central one of its bucket; sets of too different sizes cannot be similar
    lead = member.groupBy("bucket").agg(F.max_by(F.struct(F.col("key").alias("b"), F.col("size").alias("size_b")), F.struct("central", "key")).alias("lead"))
    met = member.join(staged(lead.select("bucket", "lead.*"), "leads"), "bucket")
    met = met.where((F.col("key") != F.col("b")) & (F.col("size") >= THRESHOLD * F.col("size_b")) & (F.col("size_b") >= THRESHOLD * F.col("size")))
    pairs = staged(met.select(F.least("key", "b").alias("a"), F.greatest("key", "b").alias("b")).distinct(), "pairs")
    links = staged(verified(texts, pairs), "links")
    of = staged(components(links).withColumnRenamed("node", "key"), "components")
    # buckets that still hold several components: their members may have links that no leader has shown
    now = staged(member.select("key", "bucket").join(of, "key", "left").withColumn("component", F.coalesce("component", "key")), "now")
    apart = staged(now.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("bucket"), "apart")
    open_ = staged(now.join(apart, "bucket").select("key", "component").distinct(), "open")
    more = staged(verified(texts, staged(prefix_pairs(texts, open_).join(pairs, ["a", "b"], "left_anti"), "pairs")), "links")
    if not more.isEmpty():
        of = staged(components(links.unionByName(more)).withColumnRenamed("node", "key"), "components")
    placed = staged(nodes.select("key", "doc").join(of, "key", "left").withColumn("component", F.coalesce("component", "key")), "placed")
    least = staged(placed.groupBy("component").agg(F.min("doc").alias("class_id")), "least")
    return staged(placed.join(least, "component").select("key", "component", "class_id"), "classes")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id), one row per row of docs: class_id is the least doc_id of its class."""
    seen = staged(signatures(docs), "signatures")
    classes = key_classes(docs, seen)
    return seen.select("doc_id", "key").join(classes, "key", "left").select("doc_id", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs that stand for their class, with all their columns.

    Of a class, the row of the least doc_id stays (of several texts under it, that of the least hash); a row without doc_id
    stands for its class only if no row of it has one. Rows that repeat both doc_id and text stay once. Texts without words are
    alone in their class, so all such rows stay. Columns beside doc_id and text do not matter: of repeated rows any one stays.
    """
    seen = staged(signatures(docs), "signatures")
    of = seen.where("key is not null").select("doc_id", "th", "key").join(key_classes(docs, seen).select("key", "component"), "key")
    rank = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "th")
    stays = staged(of.groupBy("component").agg(F.min(rank).alias("r"), F.count("*").alias("n")).select("r.doc_id", "r.th", "n"), "stays")
    gone = of.select("doc_id", "th").distinct().join(stays.select(F.struct("doc_id").alias("_id"), F.col("th").alias("_th")), (F.struct("doc_id") == F.col("_id")) & (F.col("th") == F.col("_th")), "left_anti")
    left = without_rows(docs, gone)
    repeated = of.groupBy("doc_id", "th").agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    repeated = staged(repeated.join(stays.select(F.struct("doc_id").alias("_id"), F.col("th").alias("_th")), (F.struct("doc_id") == F.col("_id")) & (F.col("th") == F.col("_th")), "left_semi"), "repeated")
    if repeated.isEmpty():
        return left
    once = without_rows(left, repeated)
    more = left.join(repeated, (F.struct(left["doc_id"].alias("doc_id")) == F.struct(repeated["doc_id"].alias("doc_id"))) & (F.xxhash64(left["text"]) == repeated["th"]), "left_semi")
    return once.unionByName(more.dropDuplicates(["doc_id", "text"]))

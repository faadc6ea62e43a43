"""Sentence pieces against the library, hard negatives and importance resampling against plain loops."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardgrid.llm import hard_negatives, importance, sentence_pieces

ODD = [(1, None), (2, ""), (None, "a b c d e f"), (3, "word " * 30_000), (4, "x\ty z </s> ▁▁ \n\n é١ <0x41>"), (4, "x\ty z </s> ▁▁ \n\n é١ <0x41>"), (5, "   two  spaces  "), (6, "z" * 40_000)]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame([(d, t, "x", 1, 2) for d, t in ODD], "doc_id long, text string, ids string, rank int, score int")


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def model():
    return sentence_pieces.PieceModel(sentence_pieces._file(None))


def digest(library, text):
    ids = library.encode(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_round_trip_of_a_whole_table_equals_the_library(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in sentence_pieces.round_trip(docs).collect()}
    assert got == {r.doc_id: digest(library, r.text) for r in docs.select("doc_id", "text").collect()}


def test_round_trip_of_odd_texts(spark, odd, library):
    got = sorted((tuple(r) for r in sentence_pieces.round_trip(odd).collect()), key=str)
    assert got == sorted(((d, *digest(library, t)) for d, t in ODD), key=str)
    assert sentence_pieces.round_trip(odd.limit(0)).count() == 0


def test_ids_and_texts_of_random_strings(model, library):
    rng = random.Random(5)
    letters = "  ▁abcdeABént\n\t\x00<s></s>01é日本😀́ا한ñ𝔸​"
    for n in range(6000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))
        if n % 3 == 0:
            text = "".join(rng.choice(model.shown[259:]) for _ in range(rng.randint(1, 8)))
        if n % 7 == 0:
            text = "".join(chr(rng.choice([rng.randint(1, 0xD7FF), rng.randint(0xE000, 0x10FFFF)])) for _ in range(rng.randint(1, 8)))
        ids = model.encode(text)
        assert ids == library.encode(text)
        free = [rng.randrange(32000) if rng.random() < 0.3 else rng.randrange(262) for _ in range(rng.randint(0, 9))]
        for some in (ids, free):
            assert model.decode(np.array(some, np.int32)) == library.decode(some)


def test_pairs_follow_each_other_as_the_library_says(model, library):
    rng = random.Random(6)
    tested = 0
    for _ in range(4000):
        a, b = (rng.randrange(259, 32000) for _ in range(2))
        if model.texts[a].startswith("▁") and not model.texts[b].startswith("▁"):
            ids = library.encode((model.texts[a] + model.texts[b]).replace("▁", " ")[1:])
            alone = [library.encode(model.texts[a].replace("▁", " ")[1:]) == [a], model._trace(b) is not None]
            if all(alone):
                assert model.may_follow(a, b) == (ids == [a, b])
                tested += 1
    assert tested > 500


def test_null_ids_decode_to_nothing(spark):
    rows = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [r.text for r in sentence_pieces.decode_pieces(rows).collect()] == ["", ""]


def brute_mine(rows, every=50, positives=5, negatives=3):
    good = set()
    for i, v, label in rows:
        if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v):
            good.add((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * x) for x in v)))
    out = []
    for a in good:
        if a[0] % every == 0:
            scored = sorted((-sum(p * q for p, q in zip(a[2], r[2], strict=True)), r[0], r[1] == a[1]) for r in good if r != a and len(r[2]) == len(a[2]))
            for p, pid, _ in [s for s in scored if s[2]][:positives]:
                hits = [s for s in scored if not s[2] and 50 * -p <= 100 * -s[0] <= 95 * -p][:negatives]
                out += [(a[0], pid, k + 1, s[1], -p, -s[0]) for k, s in enumerate(hits)]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, 2, "t") for i, v, label in rows], "vec_id long, embedding array<float>, label int, score int, key int, tile string")


@pytest.mark.parametrize("tile", [8192, 60])
def test_hard_negatives(spark, monkeypatch, tile):
    monkeypatch.setattr(hard_negatives, "ROWS", tile)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 7)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(10, 6))
    # quarters make many ties; row copies, a hot label and many equal vectors
    rows = [(i, (np.round((centres[i % 10] + rng.normal(size=6) * 0.6) * 4) / 4).tolist(), int(i % 10) if i % 3 else 4) for i in range(900)]
    rows += [(10_000 + i, rows[50][1], 4) for i in range(200)] + rows[:40]
    rows += [(2000, None, 1), (2001, [1.0] * 6, None), (2050, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (2100, [float("nan")] * 6, 1), (2150, [float("inf")] * 6, 1), (None, [1.0] * 6, 1)]
    rows += [(50, [0.5] * 6, 2)]  # one vec_id with two vectors
    rows += [(3000 + i, [1.0, float(i)], i % 2) for i in range(0, 100, 10)]  # another length
    got = sorted(tuple(r) for r in hard_negatives.mine(vectors(spark, rows)).collect())
    assert got == brute_mine(rows) and len(got) > 200


def test_hard_negatives_search_together(monkeypatch):
    """Work in Python is by groups of anchors, not by anchor and node; what is found is what a plain scan finds."""
    rng = np.random.default_rng(8)
    x, labels, q = rng.integers(-300, 300, (1000, 12)), rng.integers(0, 4, 1000), rng.integers(-300, 300, (60, 12))
    tree = hard_negatives.RTree(labels, x)
    ids, keys, own = tree.order.copy(), tree.order * 7, (np.arange(60) * 3, np.arange(60) * 21)
    calls, plain = [], hard_negatives.intervals
    monkeypatch.setattr(hard_negatives, "intervals", lambda q, low, high: calls.append(len(q)) or plain(q, low, high))
    of = np.repeat(np.arange(60), 2)
    floor, top = np.tile([-(2**62), 20_000], 60), np.tile([2**62, 90_000], 60)
    for same in (True, False):
        at, row, score = hard_negatives.best_first(tree, tree.x.astype(float), ids, keys, own, q.astype(float), np.arange(60) % 4, same, of, floor, top, 3)
        for w in range(len(of)):
            a = of[w]
            scores = x @ q[a]
            fits = [(-scores[i], i) for i in range(1000) if (labels[i] == a % 4) == same and i != own[0][a] and floor[w] <= scores[i] <= top[w]]
            assert list(zip(score[at == w], ids[row[at == w]], strict=True)) == [(-s, i) for s, i in sorted(fits)[:3]]
    assert len(calls) <= 2 * 2 * 4 and set(calls) == {60}


def test_hard_negatives_of_few_rows(spark):
    assert hard_negatives.mine(vectors(spark, [])).count() == 0
    assert hard_negatives.mine(vectors(spark, [(50, [1.0, 1.0], 1)])).count() == 0
    assert hard_negatives.mine(vectors(spark, [(50, None, 1), (100, [], 1)])).count() == 0
    two = [(50, [1.0, 1.0], 1), (51, [1.0, 1.0], 1), (52, [0.75, 0.75], 2)]
    assert [tuple(r) for r in hard_negatives.mine(vectors(spark, two)).collect()] == [(50, 51, 1, 52, 131072, 98304)]
    large = [(50, [1e9, 1e9], 1), (51, [1e9, 1e9], 1), (52, [0.75e9, 0.75e9], 2), (53, [3e30, 1.0], 2)]
    assert hard_negatives.mine(vectors(spark, large)).count() == 0  # too large for products in a long
    exact = [(50, [1e5, 1e5 + 1], 1), (51, [1e5, 1e5 + 3], 1), (52, [0.75e5, 0.75e5 + 7], 2)]
    assert sorted(tuple(r) for r in hard_negatives.mine(vectors(spark, exact)).collect()) == brute_mine(exact)


def test_box_intervals_hold_all_products():
    rng = np.random.default_rng(1)
    x, q = rng.integers(-90, 90, (300, 5)), rng.integers(-90, 90, (20, 5))
    tree = hard_negatives.RTree(rng.integers(0, 4, 300), x)
    least, most = hard_negatives.intervals(q, tree.low, tree.high)
    for leaf in range(tree.inner, len(tree.low)):
        some = tree.x[(leaf - tree.inner) * hard_negatives.LEAF : (leaf - tree.inner + 1) * hard_negatives.LEAF] @ q.T
        assert (some >= least[:, leaf]).all() and (some <= most[:, leaf]).all()
    for node, (first, last) in enumerate(tree.children):
        assert (tree.low[node] == tree.low[first:last].min(0)).all() and (tree.high[node] == tree.high[first:last].max(0)).all()
    assert sorted(tree.order.tolist()) == list(range(300))


def brute_resample(docs, target, low, high, buckets, seed, percent, min_words):
    def features(text):
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
        return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(low, high + 1) for i in range(len(words) - n + 1)]

    read = [(d, *features(t)) for d, t in docs]
    s, t = Counter(b for _, _, f in read for b in f), Counter(b for x in target for b in features(x)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (s.total() + float(buckets)) / ((s[b] + 1.0) * (t.total() + float(buckets))))) for b in range(buckets)]
    rows = []
    for d, n, f in read:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


@pytest.mark.parametrize(("low", "high"), [(1, 1), (1, 2), (2, 3)])
def test_importance_resampling(spark, monkeypatch, low, high):
    monkeypatch.setattr(importance, "CHUNK", 3)
    rng = random.Random(low + high)
    words = "Alpha beta GAMMA délta 12 x9 日本 ß İ k\x7fl a-b c_d".split(" ")
    docs = [(i % 70 if i % 11 else None, " ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) + rng.choice(["", ".", "\n\n x"])) for i in range(160)]
    docs += [(7, "Alpha beta gamma alpha")] * 25 + [(1, None), (2, ""), (3, "word " * 30_000), (4, "\x00\x01--")]  # equal rows, of which the draw takes a part
    target = ["alpha, BETA. gamma", None, "délta delta"]
    frame = spark.createDataFrame([(d, t, 1, "r") for d, t in docs], "doc_id long, text string, score int, rank string").repartition(5)
    got = importance.resample(frame, spark.createDataFrame([(t, 1) for t in target], "text string, n_words int"), low, high, 97, 5, 40, 3)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_resample(docs, target, low, high, 97, 5, 40, 3)


def test_importance_resampling_of_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(none, none.select("text")).count() == 0
    got = importance.resample(docs, none.select("text"), min_words=1, percent=100)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_resample([(1, "a b c"), (2, None)], [], 1, 1, 10_000, 2024, 100, 1)
    assert got.schema.simpleString() == "struct<doc_id:bigint,n_features:bigint,weight:bigint,score:bigint,rank:bigint>"


def test_ranks_are_one_to_n(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = importance.resample(docs, spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet"))
    ranks = sorted(r.rank for r in got.where(F.col("rank").isNotNull()).collect())
    assert ranks == list(range(1, len(ranks) + 1)) and ranks

"""Modality blocks against numpy and plain loops."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardgrid.operators import blocks, fusion
from wardgrid.sources import staging


def close(a, b, digits=5):
    assert len(a) == len(b)
    for x, y in zip(sorted(a), sorted(b), strict=True):
        assert x == pytest.approx(y, abs=10**-digits), (x, y)


def states_of(notes, half_life):
    """(stay, time) -> pooled mean of the notes up to it."""
    out = {}
    for stay in {n[0] for n in notes}:
        own = [(t, np.array(v)) for s, t, v in notes if s == stay]
        for now in {t for t, _ in own}:
            seen = [(t, v) for t, v in own if t <= now]
            if half_life == 0:
                seen = [(t, v) for t, v in seen if t == now]
            w = [1.0 if half_life in (0, math.inf) else 2.0 ** ((t - now) / half_life) for t, _ in seen]
            out[stay, now] = sum(a * v for a, (_, v) in zip(w, seen, strict=True)) / sum(w)
    return out


@pytest.mark.parametrize("rows", [20_000, 7])
@pytest.mark.parametrize("half_life", [math.inf, 3.0, 0])
def test_running_pool_over_parts(spark, monkeypatch, rows, half_life):
    monkeypatch.setattr(blocks, "PART_ROWS", rows)
    monkeypatch.setattr(blocks, "LANES", 2)
    rng = np.random.default_rng(2)
    # one key holds most rows, several rows share a time, one key has one row
    notes = [(("hot" if i % 4 else f"k{i % 3}"), float(i // 3) / 2, rng.normal(size=3).tolist()) for i in range(120)] + [("one", 1.0, [1.0, 2.0, 3.0])]
    extra = [(None, 1.0, [0.0] * 3), ("hot", None, [0.0] * 3), ("hot", 1.0, None)]
    frame = spark.createDataFrame([(k, t, v, "x") for k, t, v in notes + extra], "k string, t double, embedding array<double>, at string").drop("at")
    got = [(r.k, r["at"], *r.pooled) for r in blocks.running_pool(frame, "k", "t", half_life).collect()]
    close(got, [(k, t, *v) for (k, t), v in states_of(notes, half_life).items()], 9)


def test_running_pool_of_nothing(spark):
    none = spark.createDataFrame([], "k long, t double, embedding array<float>")
    assert blocks.running_pool(none, "k", "t", 2.0).count() == 0


def reduce_by_numpy(train, every, components):
    mean = train.mean(0)
    _, values, axes = np.linalg.svd(train - mean, full_matrices=False)
    axes = axes[:components]
    size = np.abs(axes)
    axes = axes * np.sign(axes[np.arange(len(axes)), (size >= size.max(1, keepdims=True) * (1 - 1e-9)).argmax(1)])[:, None]
    scores = (train - mean) @ axes.T
    scale = scores.std(0)
    return (every - mean) @ axes.T / np.where(scale > 1e-9, scale, 1.0), values**2 / (len(train) - 1)


@pytest.mark.parametrize("components", [1, 3, 99])
def test_reduction_equals_numpy(spark, components):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 5)) @ rng.normal(size=(5, 5)) + 3
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(60, None)], "i long, v array<double>").repartition(7)
    train = frame.where("i < 40 or i = 60")
    fit = fusion.fit_reduction(train, "v", components)
    want, variance = reduce_by_numpy(x[:40], x, components)
    assert fit.variance == pytest.approx(variance[:components]) and fit.total == pytest.approx(variance.sum()) and fit.rows == 40
    got = {r.i: r.v for r in fusion.reduced(frame, "v", fit).collect()}
    assert len(got) == 60 and np.allclose([got[i] for i in range(60)], want, atol=1e-4)


def test_reduction_does_not_see_held_out_rows(spark):
    rows = [(i, [float(i), float(i % 3), 1.0]) for i in range(12)]
    frame = spark.createDataFrame(rows, "i long, v array<double>")
    far = spark.createDataFrame([(99, [1e6, -1e6, 1e6])], "i long, v array<double>")
    a, b = (fusion.fit_reduction(f.where("i < 10"), "v", 2) for f in (frame, frame.unionByName(far)))
    assert np.allclose(a.axes, b.axes) and np.allclose(a.mean, b.mean)
    with pytest.raises(ValueError, match="no train stay"):
        fusion.fit_reduction(frame.limit(0), "v", 2)
    with pytest.raises(ValueError, match="differ in length"):
        fusion.fit_reduction(spark.createDataFrame([(1, [2.0, 2.0]), (2, [1.0])], "i long, v array<double>"), "v", 2)
    flat = fusion.fit_reduction(spark.createDataFrame([(1, [2.0, 2.0])], "i long, v array<double>"), "v", 2)
    assert flat.scale.tolist() == [1.0] and flat.total == 0


NOTES = [("a", -2.5, 1), ("a", 1.0, 2), ("a", 1.0, 3), ("a", 4.2, 4), ("b", 3.0, 5), ("b", 7.5, 1), ("c", 0.0, 6), ("d", 2.0, 9), ("b", None, 2)]
VECTORS = {1: [1.0, 0.0, 2.0], 2: [0.0, 4.0, 1.0], 3: [3.0, 1.0, 0.0], 4: [5.0, 5.0, 1.0], 5: [2.0, 2.0, 9.0], 6: [7.0, 1.0, 1.0]}
HOURS = [("a", h) for h in range(6)] + [("b", h) for h in range(9)] + [("z", 0), ("d", 1)]


@pytest.fixture
def notes(spark):
    return (
        spark.createDataFrame(NOTES, "stay_id string, delta_h double, note_id long"),
        spark.createDataFrame(list(VECTORS.items()), "note_id long, embedding array<float>"),
        spark.createDataFrame([("a",), ("b",)], "stay_id string"),
        spark.createDataFrame([(*h, 1.0) for h in HOURS], "stay_id string, hour int, note__0 double"),
    )


@pytest.mark.parametrize("half_life", [math.inf, 2.0])
@pytest.mark.parametrize("components", [2, None])
def test_notes_by_hour(notes, components, half_life):
    stream, vectors, train, grid = notes
    known = [(s, t, VECTORS[n]) for s, t, n in NOTES if t is not None and n in VECTORS]
    states = states_of(known, half_life)
    keys = sorted(states)
    x = np.array([states[k] for k in keys])
    of_train = x[[k[0] in "ab" for k in keys]]
    small = (x - of_train.mean(0)) / of_train.std(0) if components is None else reduce_by_numpy(of_train, x, components)[0]
    want = []
    for stay, hour in HOURS:
        seen = [i for i, (s, t) in enumerate(keys) if s == stay and t <= hour]
        if seen:
            want.append((stay, hour, *small[seen[-1]], 1.0))
    block = fusion.notes_block(stream, vectors, train, grid=grid, components=components, half_life=half_life)
    assert block.columns == ["stay_id", "hour", *[f"note__{i}" for i in range(components or 3)], "notes_present"]
    close([tuple(r) for r in block.collect()], want, 4)


def test_notes_by_cutoff(notes):
    stream, vectors, train, _ = notes
    block = fusion.notes_block(stream, vectors, train, cutoff=3.0, components=None)
    pooled = {s: np.mean([VECTORS[n] for q, t, n in NOTES if q == s and t is not None and t <= 3 and n in VECTORS], 0) for s in "abc"}
    of_train = np.array([pooled["a"], pooled["b"]])
    close([tuple(r) for r in block.collect()], [(s, *((v - of_train.mean(0)) / of_train.std(0)), 1.0) for s, v in pooled.items()], 4)
    assert fusion.notes_block(stream, vectors, train, cutoff=-9.0).columns == ["stay_id", "notes_present"]
    with pytest.raises(ValueError, match="either"):
        fusion.notes_block(stream, vectors, train)
    with pytest.warns(RuntimeWarning, match="train stays"):
        fusion.notes_block(stream, vectors, train.where("stay_id = 'a'"), cutoff=3.0, components=None)


CODES = [("a", "x"), ("a", "x"), ("a", "y"), ("b", "x"), ("b", "z"), ("c", "y"), ("c", "w"), ("d", "w"), ("d", None)]


@pytest.mark.parametrize("how", ["multihot", "count", "tfidf"])
def test_codes_block(spark, how):
    codes, train = spark.createDataFrame(CODES, "stay_id string, code string"), spark.createDataFrame([("a",), ("b",), ("c",)], "stay_id string")
    block, names = fusion.codes_block(codes, train, how, least=1)
    assert names == ["w", "x", "y", "z"]
    held = {"w": 1, "x": 2, "y": 2, "z": 1}
    n = collections.Counter((s, c) for s, c in CODES if c)
    value = {"multihot": lambda s, c: float(n[s, c] > 0), "count": lambda s, c: float(n[s, c]), "tfidf": lambda s, c: n[s, c] * math.log(3 / held[c])}[how]
    close([tuple(r) for r in block.collect()], [(s, *[value(s, c) for c in names], 1.0) for s in "abcd"], 5)
    assert fusion.codes_block(codes, train, how, least=2)[1] == ["x", "y"]
    assert fusion.codes_block(codes, train, how, least=1, top_k=3)[1] == ["w", "x", "y"]
    none, empty = fusion.codes_block(codes, train, how, least=9)
    assert empty == [] and none.columns == ["stay_id", "icd_present"] and none.count() == 4
    with pytest.raises(ValueError, match="unknown"):
        fusion.codes_block(codes, train, "other")


def test_codes_block_reduced(spark):
    codes, train = spark.createDataFrame(CODES, "stay_id string, code string"), spark.createDataFrame([("a",), ("b",), ("c",)], "stay_id string")
    block, _ = fusion.codes_block(codes, train, "count", least=1, components=2)
    x = np.array([[0, 2, 1, 0], [0, 1, 0, 1], [1, 0, 1, 0], [1, 0, 0, 0]], float)
    want, _ = reduce_by_numpy(x[:3], x, 2)
    assert block.columns == ["stay_id", "icd__pca_0", "icd__pca_1", "icd_present"]
    close([tuple(r) for r in block.collect()], [(s, *w, 1.0) for s, w in zip("abcd", want, strict=True)], 4)


GIVEN = [
    ("a", "mech_vent", None, 1.5, 4.0), ("a", "rrt", None, 2.0, None), ("a", "rrt", None, 3.5, None), ("a", "peep", 5.0, 0.5, 0.5), ("a", "peep", 8.0, 3.0, 3.0),
    ("a", "peep", 7.0, 3.0, 3.0), ("a", "peep", None, 4.0, 4.0), ("b", "vasopressor", None, -3.0, 1.0), ("b", "vasopressor_nee", 0.4, 9.0, 9.0), ("b", "unheard", 1.0, 0.0, 5.0),
    ("c", "insulin", 2.0, 1.0, 1.0), ("a", "niv", None, None, 2.0), ("b", "insulin", 4.0, -1.0, -1.0),
]


def treated(stay, hour, task, doses, gated, cutoff=None):
    out = {"sepsis": {"antibiotic", "vasopressor", "vasopressor_nee", "mech_vent", "niv"}, "aki": {"rrt"}}.get(task, set()) if gated else set()
    row = []
    shown = [c for c in fusion.OCCUPANCY if c not in out]
    dosed = [c for c in fusion.DOSES if c not in out and doses]
    own = [g for g in GIVEN if g[0] == stay and g[3] is not None]
    for c in shown:
        if cutoff is None:
            row.append(float(any(g[1] == c and g[3] <= hour and (g[4] >= hour if g[4] is not None else math.floor(g[3]) == math.floor(hour)) for g in own)))
        else:
            row.append(float(any(g[1] == c and g[3] <= cutoff for g in own)))
    end = hour if cutoff is None else cutoff
    for c in dosed:
        seen = sorted((g[3], g[2]) for g in own if g[1] == c and g[2] is not None and g[3] <= end)
        row.append(seen[-1][1] if seen else 0.0)
    return (*row, float(any(g[1] in shown + dosed and g[3] <= end for g in own)))


@pytest.mark.parametrize(("task", "doses", "gated"), [("sepsis", True, True), ("sepsis", True, False), ("aki", False, True), ("los", True, True)])
def test_treatments_block(spark, task, doses, gated):
    aligned = spark.createDataFrame([(*g, 1) for g in GIVEN], "stay_id string, treatment string, dose double, delta_h double, end_delta_h double, hour int").drop("hour")
    grid = spark.createDataFrame([(s, h) for s in "abz" for h in range(6)] + [("c", 0), ("c", 4)], "stay_id string, hour int")
    train = spark.createDataFrame([("a",)], "stay_id string")
    block = fusion.treatments_block(aligned, train, task, grid=grid, doses=doses, gated=gated)
    want = [(r.stay_id, r.hour, *treated(r.stay_id, r.hour, task, doses, gated)) for r in grid.where("stay_id <> 'z'").collect()]
    close([tuple(r) for r in block.collect()], want, 5)
    early = fusion.treatments_block(aligned, train, task, cutoff=2.0, doses=doses, gated=gated)
    close([tuple(r) for r in early.collect()], [(s, *treated(s, None, task, doses, gated, 2.0)) for s in "abc"], 5)


def test_doses_are_scaled_by_train_stays(spark):
    aligned = spark.createDataFrame(GIVEN, "stay_id string, treatment string, dose double, delta_h double, end_delta_h double")
    grid = spark.createDataFrame([(s, h) for s in "abc" for h in range(6)], "stay_id string, hour int")
    train = spark.createDataFrame([("a",)], "stay_id string")
    rows = fusion.treatments_block(aligned, train, "los", grid=grid, doses=True, scale=True).orderBy("stay_id", "hour").collect()
    peep = [5.0, 5.0, 8.0, 8.0, 8.0]  # hours 1 to 5 of stay a
    assert [r.tx__peep for r in rows if r.stay_id == "a"] == pytest.approx([0.0, *((np.array(peep) - np.mean(peep)) / np.std(peep))], abs=1e-5)
    assert {r.tx__insulin for r in rows if r.stay_id == "c"} == {0.0, 2.0}  # no train value: unscaled
    assert fusion.treatments_block(aligned.limit(0), train, "los", grid=grid).count() == 0


def test_as_of_hours_takes_the_latest_state(spark):
    states = spark.createDataFrame([("a", -1.0, 1), ("a", 2.0, 2), ("a", 2.5, 3)], "stay_id string, delta_h double, v int")
    grid = spark.createDataFrame([("a", h) for h in range(5)] + [("a", 1), ("b", 0)], "stay_id string, hour int")
    got = {(r.stay_id, r.hour): r.v for r in fusion.as_of_hours(states, grid, "v").collect()}
    assert got == {("a", 0): 1, ("a", 1): 1, ("a", 2): 2, ("a", 3): 3, ("a", 4): 3}
    assert fusion.as_of_hours(states, grid, "v").groupBy().agg(F.count("*")).first()[0] == 5


def test_wide_vectors_are_dealt_to_more_parts(spark, monkeypatch):
    """A task's memory is in proportion to components, not to rows."""
    parts: list[int] = []

    def spied(df, name):
        out = staging.kept(df, name)
        parts.append(out.select("_part").distinct().count())
        return out

    monkeypatch.setattr(blocks, "kept", spied)
    rows = spark.range(600).select((F.col("id") % 7).alias("k"), F.col("id").cast("double").alias("t"), F.transform(F.sequence(F.lit(1), F.lit(2000)), lambda i: (i * F.col("id") % 11).cast("double")).alias("embedding"))
    got = {(r.k, r.at): r.pooled for r in blocks.running_pool(rows, "k", "t", float("inf")).where("k = 3").collect()}
    assert parts[0] >= 3
    assert np.allclose(got[3, 17.0], [np.mean([i * t % 11 for t in (3, 10, 17)]) for i in range(1, 2001)])

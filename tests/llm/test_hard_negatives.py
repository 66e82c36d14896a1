"""Hard negatives against a plain double loop."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from matchops.llm import hard_negatives
from matchops.llm.common import importable

SCHEMA = "vec_id long, embedding array<double>, label int, row long, block int, v string, slot int"


def brute(rows, is_anchor, n_positives, k, low, high, scale):
    used = [(i, lab, [math.floor(scale * x) for x in v]) for i, v, lab in rows
            if None not in (i, v, lab) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, lab, v in used:
        if not is_anchor(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, other, w in used if i != a)
        for minus, p, _ in [s for s in scored if s[2] == lab][:n_positives]:
            inside = [(-m, i) for m, i, other in scored if other != lab and low * -minus <= 100 * -m <= high * -minus][:k]
            out += [(a, p, rank, i, -minus, s) for rank, (s, i) in enumerate(inside, 1)]
    return sorted(out)


def mined(spark, rows, scale=256, **kind):
    importable(spark)
    frame = spark.createDataFrame([(*r, 7, 8, "x", 9) for r in rows], SCHEMA).repartition(3)
    vectors = hard_negatives.quantised(frame, "vec_id", "embedding", F.col("label"), scale)
    return sorted(tuple(r) for r in hard_negatives.mine(vectors, F.col("vec_id") % 4 == 0, **kind).collect())


def awkward(seed):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([-1, 0, 1, 2]) * rng.choice([0.25, 0.5, 1.0]) for _ in range(4)], rng.randrange(3)) for i in range(120)]
    rows += [(200, [1.0, 1.0, None, 0.0], 1), (204, None, 1), (208, [float("nan")] * 4, 0), (212, [float("inf"), 0.0, 0.0, 0.0], 0),
             (216, [1.0] * 4, None), (None, [1.0] * 4, 1), (220, [0.0] * 4, 2), (224, [], 1), (228, [0.5, 0.5], 1),
             (232, [1.0] * 4, 9), rows[8], rows[8], rows[11]]
    return rows


def test_equals_brute_force(spark):
    for seed, kind in ((1, {}), (2, {"n_positives": 3, "k": 4, "low": -20, "high": 100})):
        rows = awkward(seed)
        args = {"n_positives": 5, "k": 10, "low": 30, "high": 90} | kind
        assert mined(spark, rows, **kind) == brute(rows, lambda i: i % 4 == 0, scale=256, **args)


def test_many_blocks_and_parts(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 16)
    monkeypatch.setattr(hard_negatives, "PART", 7)
    rows = awkward(3)
    assert mined(spark, rows) == brute(rows, lambda i: i % 4 == 0, 5, 10, 30, 90, 256)


def test_large_components_are_exact(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(0.5, 1) for _ in range(3)], i % 2) for i in range(40)]
    scale = 1 << 26  # products past what a double holds
    assert mined(spark, rows, scale) == brute(rows, lambda i: i % 4 == 0, 5, 10, 30, 90, scale)


def test_no_rows_and_no_windows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(4, [1.0], 1), (5, [-1.0], 1), (6, [1.0], 2)]) == []  # the only positive has a negative score
    assert mined(spark, [(4, [1.0], 1), (5, [1.0], 2)]) == []


def test_slots_hold_the_best_of_disjoint_scores():
    scores = np.array([5, 9, 9, 3, 9, 7, 5, 1])
    assert hard_negatives.best_by_slot(scores, [8, 5], 2).tolist() == [5, 0, 6]
    assert hard_negatives.best_by_slot(scores, [9], 2).tolist() == [1, 2]
    assert hard_negatives.best_by_slot(scores, [0], 2).tolist() == []


def test_no_side_of_a_meeting_is_joined_or_broadcast(spark, monkeypatch):
    """A copy of every part goes to every block, more than a file's size tells."""
    plans, best = [], hard_negatives._best

    def watched(found, k):
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        return best(found, k)

    monkeypatch.setattr(hard_negatives, "_best", watched)
    rows = awkward(5)
    assert mined(spark, rows) == brute(rows, lambda i: i % 4 == 0, 5, 10, 30, 90, 256)
    assert len(plans) == 2
    assert not [p for p in plans if "Broadcast" in p or "Join" in p]


def in_rows(values, ids, labels):
    order = np.lexsort((ids, labels))
    return hard_negatives.Rows({"width": values.shape[1], "ints": values[order].astype("<i4").tobytes()} | {
        name: x[order].astype("<i8").tobytes() for name, x in (("rows", np.arange(len(ids))), ("vec_ids", ids), ("labels", labels))})


def test_a_block_in_many_chunks(monkeypatch):
    for name, value in (("CHUNK", 7), ("PENDING", 20), ("SOME", 3)):
        monkeypatch.setattr(hard_negatives, name, value)
    rng = np.random.default_rng(6)
    for factor in (1, 3000, 1 << 24):  # sums exact as float32, float64, int64
        block = in_rows(rng.integers(-3, 4, (90, 3)) * factor, rng.permutation(90), rng.integers(0, 4, 90))
        anchors = in_rows(rng.integers(-3, 4, (6, 3)) * factor, np.arange(100, 106), rng.integers(0, 5, 6))
        unit = factor * factor
        limits = np.array([[9, 4, -2], [20, 3, hard_negatives.NONE], [2, 1, 0], [0, hard_negatives.NONE, hard_negatives.NONE], [5, 4, 3], [-4, -6, -8]])
        limits = np.where(limits > hard_negatives.NONE, limits * unit, limits)
        least = np.array([-9, -30, 0, -2, 1, -20]) * unit
        barred = block.span(anchors.labels)
        own = slice(2, 6)
        found = hard_negatives.Asked(anchors, own, limits[own], least[own], tuple(x[own] for x in barred), 4).best(block, 0, 90)
        scores = anchors.values.astype(object) @ block.values.astype(object).T
        expected = []
        for i in range(2, 6):
            bounds = [x for x in limits[i].tolist() if x > hard_negatives.NONE]
            for slot, upper in enumerate(bounds):
                lower = bounds[slot + 1] + 1 if slot + 1 < len(bounds) else least[i]
                inside = [(-s, block.ids[p], p) for p, s in enumerate(scores[i]) if max(lower, least[i]) <= s <= upper and block.labels[p] != anchors.labels[i]]
                expected += [(i, slot, p, -s) for s, _, p in sorted(inside)[:4]]
        assert sorted(zip(*(x.tolist() for x in found), strict=True)) == sorted(expected)

"""Strassen products, tiles and hard negatives against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import hard_negatives, tiles


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 5, 7), (9, 0, 4), (33, 64, 100), (70, 70, 70), (129, 30, 65)])
@pytest.mark.parametrize("limit", [100, 1 << 40, 1 << 62])
def test_strassen_equals_the_product(shape, limit):
    rng = np.random.default_rng(3)
    left = rng.integers(-limit, limit, shape[:2])
    right = rng.integers(-limit, limit, shape[1:])
    assert (hard_negatives.strassen(left, right, leaf=4) == left @ right).all()  # both modulo 2^64


def test_percentages():
    scores = np.array([-7, -1, 0, 1, 4, 5, 6, 99, 101, (1 << 62) + 3, -(1 << 62)], np.int64)
    exact = scores.astype(object)
    assert hard_negatives._percent_up(80, scores).tolist() == [-(-80 * s // 100) for s in exact]
    assert hard_negatives._percent_down(100, scores).tolist() == scores.tolist()
    assert hard_negatives._percent_down(95, scores).tolist() == [95 * s // 100 for s in exact]


def test_best_merges_with_ties():
    rnd = np.random.default_rng(4)
    best = tiles.Best(3)
    scores, ids = rnd.integers(-2, 3, (5, 60)), rnd.integers(0, 20, 60)
    valid = rnd.random((5, 60)) < 0.6
    for begin in (0, 2, 30):
        end = {0: 2, 2: 30, 30: 60}[begin]
        best.offer(0, scores[:, begin:end], ids[begin:end], valid[:, begin:end])
    for row in range(5):
        expected = sorted((-s, i) for s, i, v in zip(scores[row].tolist(), ids.tolist(), valid[row]) if v)[:3]
        assert list(zip((-best.scores[best.rows == row]).tolist(), best.ids[best.rows == row].tolist())) == expected


def brute(rows, is_anchor, scale=256, positives=5, negatives=5):
    kept = [
        (i, label, [int(np.floor(scale * float(x))) for x in v]) for i, v, label in rows
        if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    anchors = {}
    for i, label, v in sorted(kept):
        if is_anchor(i):
            anchors.setdefault(i, (label, v))
    found = []
    for anchor, (label, v) in anchors.items():
        scored = [(sum(a * b for a, b in zip(v, w)), i, own) for i, own, w in kept if i != anchor and len(w) == len(v)]
        ranked = sorted((-s, i, own) for s, i, own in scored)
        for minus, positive, _ in [r for r in ranked if r[2] == label][:positives]:
            within = [r for r in ranked if r[2] != label and 80 * -minus <= 100 * -r[0] <= 100 * -minus]
            found += [(anchor, positive, k + 1, i, -minus, -s) for k, (s, i, _) in enumerate(within[:negatives])]
    return sorted(found)


@pytest.mark.parametrize("limits", [{}, {"block_bytes": 100, "shard_bytes": 400}])
def test_hard_negatives_by_brute_force(spark, monkeypatch, limits):
    monkeypatch.setattr(tiles, "TILE_ROWS", 16)
    rnd = random.Random(7)
    vector = lambda n: [rnd.choice([-0.5, 0.0, 0.25, 0.5, 1.0, 1.5]) for _ in range(n)]
    rows = [(i, vector(rnd.choice([3, 3, 3, 5])), rnd.randint(0, 2)) for i in range(150)]
    rows += [(5, [0.5, float("nan"), 1.0], 1), (10, [0.5, None, 1.0], 1), (15, None, 1), (None, vector(3), 1), (20, vector(3), None)]
    rows += [(25, [], 1), (200, [], 1), (201, [], 2), (202, [float("inf")], 0), (30, vector(5), 0), (35, vector(3), 2)]
    rows += [(203, [1.0, 1.0, 0.5], 0)] * 90 + [rows[0], rows[10]]
    table = [(i, v, label, "x", 1, 1) for i, v, label in rows]
    schema = "vec_id long, embedding array<float>, label int, id string, score long, size int"
    frame = spark.createDataFrame(table, schema).repartition(4)
    got = hard_negatives.mine_hard_negatives(frame, F.col("vec_id") % 5 == 0, **limits)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    expected = brute(rows, lambda i: i % 5 == 0)
    assert sorted(map(tuple, got.collect())) == expected


def test_no_vectors_and_no_anchors(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert hard_negatives.mine_hard_negatives(spark.createDataFrame([], schema), F.col("vec_id") >= 0).collect() == []
    frame = spark.createDataFrame([(1, [1.0], 0), (2, [1.0], 1)], schema)
    assert hard_negatives.mine_hard_negatives(frame, F.col("vec_id") > 5).collect() == []
    assert hard_negatives.mine_hard_negatives(frame, F.col("vec_id") > 0).collect() == []

"""Fitted states of parts, subsets of an exact size, and layout by weight."""

import hashlib
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from millrace.operators import layout, scaling, subsets


def test_states_of_parts_merge(spark):
    rng = random.Random(1)
    rows = [(rng.gauss(1e6, 3) if i % 5 else None, float(i % 7), i % 4, None) for i in range(2000)] + [(5.0, 1.0, 9, None)]
    df = spark.createDataFrame(rows, "x double, y double, part int, nothing double")
    parts = [scaling.scaler_state(df.where(F.col("part") == p), ["x", "y", "nothing"]) for p in (0, 1, 2, 3, 9, 77)]
    states = parts[0]
    for part in parts[1:]:
        states = states.unionByName(part)
    model = scaling.scaler_of_state(scaling.merge_states(states), ["x", "y", "nothing"])
    whole = scaling.fit_scaler(df, ["x", "y", "nothing"])
    assert model.rows == whole.rows == (1601, 2001, 0)
    assert model.means[:2] == pytest.approx(whole.means[:2]) and model.stds[:2] == pytest.approx(whole.stds[:2])
    assert model.means[2] is model.stds[2] is None
    xs = [r[0] for r in rows if r[0] is not None]
    assert model.stds[0] == pytest.approx(statistics.stdev(xs))
    one = scaling.scaler_of_state(scaling.merge_states(parts[4]), ["x"])
    assert (one.means, one.stds, one.rows) == ((5.0,), (None,), (1,))


def position(*key):
    return int(hashlib.md5("|".join(map(str, key)).encode()).hexdigest()[:15], 16)


@pytest.mark.parametrize("few", [4096, 1])
def test_subsets_have_the_size_asked_for(spark, monkeypatch, few):
    monkeypatch.setattr(subsets, "_FEW_ROWS", few)
    df = spark.createDataFrame([(i, i % 11) for i in range(500)], "k int, w int").repartition(3)
    order = sorted(range(500), key=position)
    for rows in (0, 1, 123, 499, 500, 900):
        assert {r.k for r in subsets.subset_of_rows(df, ["k"], rows).collect()} == set(order[:rows])
    total, chosen = 0, set()
    for k in order:
        total += k % 11
        if total > 400:
            break
        chosen.add(k)
    assert {r.k for r in subsets.subset_of_weight(df, ["k"], 400, F.col("w")).collect()} == chosen
    assert subsets.subset_of_weight(df, ["k"], 10**9, F.col("w")).count() == 500


def test_subsets_among_equal_keys(spark):
    df = spark.createDataFrame([(7, i) for i in range(300)] + [(i, 0) for i in range(100, 150)], "k int, v int").repartition(3)
    sizes = [subsets.subset_of_rows(df, ["k"], n) for n in (40, 100, 340)]
    found = [{tuple(r) for r in s.collect()} for s in sizes]
    assert [len(f) for f in found] == [40, 100, 340] and found[0] <= found[1] <= found[2]
    assert subsets.subset_of_rows(df.limit(0), ["k"], 5).count() == 0


@pytest.mark.parametrize("hot", [0.0, 0.4, 1.0])
def test_layout_by_weight_is_even(spark, hot):
    rng = random.Random(2)
    rows = [(None if rng.random() < hot else rng.randrange(3000), i, "x") for i in range(20_000)]
    df = spark.createDataFrame(rows, "key int, __slot int, v string")
    dealt = layout.repartitioned_by_weight(df, 7, "key")
    assert dealt.columns == df.columns and dealt.schema == df.schema
    placed = dealt.withColumn("p", F.spark_partition_id()).collect()
    sizes = [sum(r.p == p for r in placed) for p in range(7)]
    assert sum(sizes) == 20_000 and max(sizes) < 1.1 * 20_000 / 7
    by_key = {}
    for r in placed:
        by_key.setdefault(r.key, set()).add(r.p)
    assert all(len(p) == 1 for k, p in by_key.items() if k is not None)
    assert hot == 0 or len(by_key[None]) > 1
    assert sorted((r.key is None, r["__slot"]) for r in placed) == sorted((r[0] is None, r[1]) for r in rows)


def test_layout_of_nothing(spark):
    assert layout.repartitioned_by_weight(spark.createDataFrame([], "k string, v int"), 3, "k").count() == 0


def test_packing():
    placed = layout._packed({1: 9, 2: 5, 3: 5, 4: 4, 5: 4}, 3)
    assert placed == {1: 0, 2: 1, 3: 2, 4: 1, 5: 2}
    assert math.isclose(len(layout._packed({}, 3)), 0)

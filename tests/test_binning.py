import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import binning


def brute_force(values, bins):
    ordered = sorted(v for v in values if v is not None and v == v)
    n = len(ordered)
    return tuple(sorted({ordered[max(1, -(-i * n // bins)) - 1] for i in range(1, bins)})) if n else ()


def cases():
    rng = random.Random(5)
    yield "normal", [rng.gauss(0, 1) for _ in range(3000)]
    yield "third_in_one_value", [7.0] * 1000 + [rng.random() * 20 for _ in range(2000)]
    yield "two_hot_values", [1.0] * 900 + [2.0] * 900 + [rng.random() * 3 for _ in range(900)]
    yield "far_outliers", [rng.random() for _ in range(2000)] + [1e300, -1e300, 1e-300]
    yield "constant", [4.0] * 500
    yield "gaps", [None, float("nan"), 1.0, 2.0, 3.0] * 50
    yield "few", [3.0, 1.0, 2.0]
    yield "integers", [float(rng.randrange(5)) for _ in range(1000)]
    yield "empty", [None, float("nan")]


@pytest.mark.parametrize("size", [8192, 64])
@pytest.mark.parametrize("name,values", list(cases()), ids=[n for n, _ in cases()])
def test_splits_are_exact(spark, monkeypatch, name, values, size):
    # Small sketches take as many passes as large tables do.
    monkeypatch.setattr(binning, "SKETCH_SIZE", size)
    monkeypatch.setattr(binning, "_MARGIN", 2 * 2.296 / size**0.9021)
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(3)
    model = binning.fit_bins(df, ["x"], 10)
    assert model.splits[0] == brute_force(values, 10)


def test_wrong_brackets_are_noticed(spark):
    values = [float(v) for v in range(1000)]
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(2)
    sizes, known, brackets = binning._first_look(binning.sketch_columns(df, ["x"]), 10)
    assert brackets == [] and known["x", 5] == 499.0
    aside = [binning._Bracket("x", 5, 700.0, 800.0), binning._Bracket("x", 9, 10.0, 20.0)]
    known, narrower = binning._narrow(df, sizes, aside)
    assert known == {} and {(b.number, b.low, b.high) for b in narrower} == {(5, 0.0, 700.0), (9, 20.0, 999.0)}


def test_sketches_of_parts_merge(spark):
    rng = random.Random(6)
    values = [rng.gauss(0, 3) for _ in range(30_000)]
    df = spark.createDataFrame([(v, i % 3) for i, v in enumerate(values)], "x double, part int")
    parts = [binning.sketch_columns(df.where(F.col("part") == p), ["x"]) for p in range(3)]
    merged = binning.merge_sketches(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    row = merged.first()
    assert (row.rows, row.low, row.high) == (30_000, min(values), max(values))
    assert binning.fit_bins(df, ["x"], 10, sketches=merged).splits[0] == brute_force(values, 10)
    ordered = sorted(values)
    near = binning.sketched_bins(merged, ["x"], 4).splits[0]
    assert all(abs(sum(v <= s for v in ordered) / 30_000 - i / 4) < 0.005 for i, s in enumerate(near, 1))


def test_bins_follow_splits(spark):
    df = spark.createDataFrame([(float(v),) for v in range(1, 101)] + [(None,), (float("nan"),)], "x double")
    binned = binning.bin_columns(df, ["x"])
    counts = {r.x_bin: r["count"] for r in binned.groupBy("x_bin").count().collect()}
    assert counts.pop(None) == 2
    assert set(counts) == set(range(1, 11)) and sum(counts.values()) == 100
    assert binned.where("x = 100").first().x_bin == 10 and binned.where("x = 1").first().x_bin == 1


def test_bins_equal_mllib_with_exact_quantiles(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_extendedprice", "l_quantity")
    mine = binning.bin_columns(df, df.columns)
    stage = binning.mllib_bins(df.columns, suffix="_theirs", relative_error=0.0)
    both = stage.fit(df).transform(mine)
    wrong = both.where(
        (F.col("l_extendedprice_bin") != F.col("l_extendedprice_theirs") + 1)
        | (F.col("l_quantity_bin") != F.col("l_quantity_theirs") + 1)
    )
    assert wrong.count() == 0

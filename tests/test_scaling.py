import math

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from millrace.operators import scaling

GOLDEN = {
    (False, False): ([1, 2, 4], [5, 5, 5]),
    (False, True): ([0.654654, 1.309307, 2.618615], [0, 0, 0]),
    (True, False): ([-1.333333, -0.333333, 1.666667], [0, 0, 0]),
    (True, True): ([-0.872872, -0.218218, 1.091089], [0, 0, 0]),
}


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame([(0, 1.0, 5.0), (1, 2.0, 5.0), (2, 4.0, 5.0)], "i int, a double, b double")


def columns(df):
    rows = df.orderBy("i").collect()
    return [r.a for r in rows], [r.b for r in rows]


@pytest.mark.parametrize("mode", GOLDEN)
def test_four_modes(small, mode):
    expected_a, expected_b = GOLDEN[mode]
    model = scaling.fit_scaler(small, ["a", "b"])
    for scaled in (scaling.scale_columns(small, ["a", "b"], *mode), model.transform(small, *mode)):
        a, b = columns(scaled)
        assert a == pytest.approx(expected_a, abs=1e-6)
        assert b == pytest.approx(expected_b, abs=1e-6)


@pytest.mark.parametrize("mode", GOLDEN)
def test_modes_equal_mllib(spark, mode):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_quantity", "l_extendedprice")
    names = df.columns
    mine = scaling.scale_columns(df, names, *mode).agg(*[F.sum(n) for n in names], *[F.sum(F.abs(n)) for n in names])
    theirs = scaling.mllib_scaler(names, *mode).fit(df).transform(df).select(vector_to_array("scaledFeatures").alias("v"))
    theirs = theirs.select(*[F.get("v", i).alias(n) for i, n in enumerate(names)]).agg(
        *[F.sum(n) for n in names], *[F.sum(F.abs(n)) for n in names]
    )
    assert list(mine.first()) == pytest.approx(list(theirs.first()), rel=1e-9, abs=1e-3)


def test_one_row_and_no_rows(small):
    one = scaling.scale_columns(small.where("i = 2"), ["a"], False, True)
    assert one.first().a == 0.0
    none = small.where("i > 9")
    stats = scaling.moments_by_column(none, ["a"]).first()
    assert stats["mean"] is None and stats["std"] is None and stats["rows"] == 0
    assert scaling.scale_columns(none, ["a"]).count() == 0


def test_zscore_keeps_nulls_and_divides_by_zero_like_floats(spark):
    df = spark.createDataFrame([(0, 1.0, 5.0), (1, None, 5.0), (2, 3.0, None)], "i int, a double, b double")
    a, b = columns(scaling.zscore_columns(df, ["a", "b"]))
    assert a[1] is None and a[0] == pytest.approx(-0.707107, abs=1e-6)
    assert math.isnan(b[0]) and b[2] is None
    other = scaling.fit_scaler(df, ["b"]).zscore(spark.createDataFrame([(7.0,), (3.0,)], "b double"))
    assert [r.b for r in other.collect()] == [float("inf"), float("-inf")]


def test_statistics_of_another_table(spark, small):
    other = spark.createDataFrame([(0, 10.0)], "i int, a double")
    scaled = scaling.scale_columns(other, ["a"], True, True, fitted_on=small)
    assert scaled.first().a == pytest.approx((10 - 7 / 3) / 1.527525, abs=1e-5)


def test_array_slots(spark):
    df = spark.createDataFrame([(0, [1.0, 5.0]), (1, [2.0, 5.0]), (2, [4.0, 5.0])], "i int, v array<double>")
    rows = scaling.scale_array(df, "v", True, True).orderBy("i").collect()
    assert [r.v[0] for r in rows] == pytest.approx([-0.872872, -0.218218, 1.091089], abs=1e-6)
    assert [r.v[1] for r in rows] == [0.0, 0.0, 0.0]


def test_same_for_any_partitioning(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_quantity")
    totals = [
        scaling.zscore_columns(df.repartition(n), ["l_quantity"]).agg(F.sum(F.abs("l_quantity"))).first()[0]
        for n in (1, 7, 50)
    ]
    assert totals == pytest.approx([totals[0]] * 3)


def test_transform_has_no_join_or_shuffle_of_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    plan = scaling.zscore_columns(df, ["l_quantity", "l_tax"]).select("l_orderkey", "l_quantity", "l_tax")
    text = plan._jdf.queryExecution().executedPlan().toString()
    main = text.split("Subquery")[0]
    assert "Join" not in text and "Exchange" not in main

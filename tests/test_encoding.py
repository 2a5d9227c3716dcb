import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from millrace.operators import encoding


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame([(0,), (1,), (3,)], "c int")


def dense(df):
    return ["".join(str(int(x)) for x in r.c_vec) for r in df.orderBy("c").collect()]


def test_fitted(small):
    assert dense(encoding.fit_one_hot(small, ["c"]).dense(small)) == ["1000", "0100", "0001"]
    assert dense(encoding.fit_one_hot(small, ["c"], drop_last=True).dense(small)) == ["100", "010", "000"]


def test_unseen(spark, small):
    unseen = spark.createDataFrame([(9,)], "c int")
    with pytest.raises(Exception, match="unseen or invalid"):
        encoding.fit_one_hot(small, ["c"]).dense(unseen).collect()
    keep = encoding.fit_one_hot(small, ["c"], handle_invalid="keep")
    assert dense(keep.dense(unseen)) == ["00001"]
    dropped = encoding.fit_one_hot(small, ["c"], drop_last=True, handle_invalid="keep")
    assert dense(dropped.dense(unseen)) == ["0000"]


@pytest.mark.parametrize("value", [None, -1.0, 1.5, float("nan")])
def test_invalid_input_is_an_error(spark, small, value):
    bad = spark.createDataFrame([(0.0,), (value,)], "c double")
    with pytest.raises(ValueError, match="not category indices"):
        encoding.fit_one_hot(bad, ["c"])
    with pytest.raises(Exception, match="unseen or invalid"):
        encoding.fit_one_hot(small, ["c"]).sparse(bad).collect()
    kept = encoding.fit_one_hot(small, ["c"], handle_invalid="keep").sparse(bad)
    assert sorted(r.c_vec["indices"][0] for r in kept.collect()) == [0, 4]


def test_only_category_zero_dropped(spark):
    zero = spark.createDataFrame([(0,)], "c int")
    row = encoding.fit_one_hot(zero, ["c"], drop_last=True).dense(zero).first()
    assert row.c_vec == []


@pytest.mark.parametrize("drop_last", [False, True])
@pytest.mark.parametrize("handle_invalid", ["error", "keep"])
def test_equals_mllib(spark, drop_last, handle_invalid):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_linenumber", "l_quantity")
    names = df.columns
    mine = encoding.fit_one_hot(df, names, drop_last, handle_invalid)
    stage = encoding.mllib_one_hot(names, drop_last, handle_invalid=handle_invalid)
    theirs = stage.fit(df).transform(df).select(*names, *[vector_to_array(n + "_vec").alias(n + "_vec") for n in names])
    assert mine.dense(df).exceptAll(theirs).count() == 0
    assert mine.dense(df).count() == theirs.count()


@pytest.mark.parametrize("width", [3, 64, 65, 200])
def test_dense_widths(spark, width):
    df = spark.range(width + 2).select(F.col("id").cast("int").alias("i"))
    rows = df.select("i", encoding.dense_slots("i", width).alias("v")).collect()
    for r in rows:
        assert r.v == [float(r.i == s) for s in range(width)]


def test_wide_null_and_too_large_indices(spark, small):
    df = spark.createDataFrame([(4999,), (None,)], "i int")
    rows = df.select(encoding.dense_slots("i", 5000).alias("v")).collect()
    assert [sum(r.v) for r in rows] == [1.0, 0.0] and rows[0].v[4999] == 1.0
    large = spark.createDataFrame([(float(1 << 31),)], "c double")
    with pytest.raises(ValueError, match="column c"):
        encoding.fit_one_hot(large, ["c"])
    wide = encoding.OneHotModel(("c",), (10_000_000,))
    assert wide.sparse(small).first().c_vec["size"] == 10_000_000


def test_fixed_width(spark):
    texts = ["3", None, "1.9", "-0.5", "-7", "99", "99999999999", "NaN", "x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, c string")
    for encoded in (
        encoding.encode_fixed_width(df, ["c", "absent"]),
        encoding.encode_batches(df, ["c", "absent"], batch_size=2),
    ):
        assert encoded.columns == ["i", "c", "c_vec"]
        rows = encoded.orderBy("i").collect()
        assert [r.c_vec.index(1.0) for r in rows] == [3, 0, 1, 0, 0, 20, 20, 0, 0]
        assert all(sum(r.c_vec) == 1.0 and len(r.c_vec) == 21 for r in rows)


def test_fixed_width_needs_no_python_and_no_shuffle(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/part.parquet").select("p_size")
    plan = encoding.encode_fixed_width(df, ["p_size"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Pandas" not in plan

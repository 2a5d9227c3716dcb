import math

import pytest
from pyspark.sql import functions as F

from millrace.functions import fields


def test_index_of_dirty_text(spark):
    texts = ["3", None, "1.9", "-0.5", "-7", "99", "99999999999", "NaN", "x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select(
        "i",
        fields.clipped_category_index(F.col("t")).alias("clipped"),
        fields.category_index(F.col("t")).alias("plain"),
        fields.double_or_null(F.col("t")).alias("number"),
    ).orderBy("i").collect()
    assert [r.clipped for r in rows] == [3, 0, 1, 0, 0, 20, 20, 0, 0]
    assert [r.plain for r in rows] == [3, 0, 1, 0, -7, 99, 0, 0, 0]
    assert rows[8].number is None and math.isnan(rows[7].number)


def test_fill_covers_null_and_nan(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (2.5,)], "x double")
    assert [r.x for r in fields.clean_features(df, ["x"]).collect()] == [0.0, 0.0, 2.5]


def test_choosing_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert fields.pick_columns(df, [" c", "zzz", "a "]).columns == ["c", "a"]
    assert fields.present_columns(df, ["zzz"], on_missing="skip") == []
    with pytest.raises(ValueError, match="none of"):
        fields.pick_columns(df, ["zzz"])
    with pytest.raises(ValueError, match="on_missing"):
        fields.present_columns(df, ["a"], on_missing="maybe")
    assert fields.split_names(" a, ,b ,") == ["a", "b"]


def test_vector_holds_only_features(spark):
    df = spark.createDataFrame([(1.0, 2.0, "x")], "a double, b double, c string")
    vectors = fields.feature_vector(df, ["b", "a"])
    assert vectors.columns == ["features"]
    assert list(vectors.first().features) == [2.0, 1.0]


def test_clean_reads_only_named_columns(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    plan = fields.clean_features(df, ["l_tax"]).select("l_tax")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<l_tax:double>" in plan

import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.operators import batches, layout


@pytest.fixture(scope="module")
def uneven(spark):
    """Three partitions of 4, 0 and 4 rows."""
    return spark.range(0, 12, 1, 3).where("id < 4 or id >= 8")


def test_empty_partitions_are_counted(uneven):
    counts = layout.partition_rows(uneven)
    assert [tuple(r) for r in counts.orderBy("partition").collect()] == [(0, 4), (1, 0), (2, 4)]
    figures = layout.balance(counts).first()
    assert (figures.num_partitions, figures["min"], figures["max"]) == (3, 0, 4)
    assert figures.mean == pytest.approx(2.666667, abs=1e-6)
    assert figures.std == pytest.approx(1.885618, abs=1e-6)
    assert figures.cv == pytest.approx(0.707107, abs=1e-6)
    assert figures.max_over_min is None
    assert [tuple(r) for r in layout.heaviest(counts).collect()] == [(0, 4), (2, 4), (1, 0)]


def test_balance_of_nothing(spark):
    counts = spark.createDataFrame([], "partition int, rows bigint")
    assert tuple(layout.balance(counts).first()) == (0, 0, 0, 0.0, 0.0, 0.0, None)


def test_partition_rows_add_up(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    for n in (1, 5, 40):
        counts = layout.partition_rows(layout.repartitioned(df, n))
        assert counts.count() == n and counts.agg(F.sum("rows")).first()[0] == 6000
    assert layout.repartitioned(df, 0) is df


def test_partition_rows_after_a_shuffle_that_is_replanned(spark):
    df = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count()
    counts = layout.partition_rows(df)
    assert counts.agg(F.sum("rows")).first()[0] == 10


def test_balance_by_phase(uneven):
    rows = layout.balance_by_phase({"before": uneven, "after": uneven.coalesce(1)}).collect()
    assert {r.phase: (r.num_partitions, r["max"]) for r in rows} == {"before": (3, 4), "after": (1, 8)}


def test_held_is_stored(spark):
    df = layout.held(spark.range(10))
    assert df.is_cached and df.storageLevel.useDisk and df.storageLevel.useMemory
    df.unpersist()


def test_key_balance_over_a_hot_key(spark):
    df = spark.range(900).select(F.when(F.col("id") < 300, 0).otherwise(F.col("id")).alias("k"))
    figures = layout.balance(layout.key_rows(df, "k")).first()
    assert (figures.num_partitions, figures["min"], figures["max"]) == (601, 1, 300)


@pytest.mark.parametrize("sizes", [[10], [3, 3, 4], [1] * 10, [7, 0, 3]])
@pytest.mark.parametrize("batch", [1, 3, 4, 10, 50])
def test_rebatched(sizes, batch):
    frames, start = [], 0
    for size in sizes:
        frames.append(pd.DataFrame({"x": range(start, start + size)}))
        start += size
    out = list(batches.rebatched(iter(frames), batch))
    assert [x for f in out for x in f["x"]] == list(range(10))
    assert all(len(f) == batch for f in out[:-1]) and 0 < len(out[-1]) <= batch


def test_map_batches(spark):
    sizes = batches.map_batches(
        spark.range(0, 10, 1, 1), lambda f: pd.DataFrame({"n": [len(f)]}), "n bigint", batch_size=4
    )
    assert sorted(r.n for r in sizes.collect()) == [2, 4, 4]
    with pytest.raises(ValueError):
        batches.map_batches(spark.range(1), lambda f: f, "id bigint", 0)

"""Partition control, rows per partition and balance figures."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.readings import ratio_or


#: Slots per partition that keys are hashed into, and the share of a partition above which a key is cut.
SLOTS = 64


def repartitioned(df: DataFrame, partitions: int = 0, *keys: str) -> DataFrame:
    """Spread over ``partitions`` when above zero; otherwise the layout stays as it is."""
    return df.repartition(partitions, *keys) if partitions > 0 else df


def held(df: DataFrame, warm: bool = True) -> DataFrame:
    """Keep in memory with spill to disk; ``warm`` fills the store now."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    if warm:
        df.count()
    return df


def _packed(weights: dict[int, int], partitions: int) -> dict[int, int]:
    """Partition of each slot: heaviest slots first, each to the partition that is lightest then."""
    heap = [(0, p) for p in range(partitions)]
    placed = {}
    for slot in sorted(weights, key=lambda s: (-weights[s], s)):
        held, partition = heapq.heappop(heap)
        placed[slot] = partition
        heapq.heappush(heap, (held + weights[slot], partition))
    return placed


def repartitioned_by_weight(df: DataFrame, partitions: int, *keys: str) -> DataFrame:
    """Spread over ``partitions`` of equal rows, rows of one key together unless they are too many.

    Keys are weighed now, by partial counts. One with more than the ``SLOTS``-th part of a partition
    is cut into pieces of that size by a hash of the whole row; the others are hashed into
    ``SLOTS`` slots per partition. Slots and pieces, some thousand numbers, are packed on the
    driver, heaviest first.
    """
    slots = SLOTS * partitions
    value = F.struct(*[F.col(k) for k in keys])
    counts = df.groupBy(value.alias("key")).agg(F.count(F.lit(1)).alias("rows"))
    counts = counts.persist()  # a row per key
    try:
        total = counts.agg(F.sum("rows")).first()[0] or 0
        most = max(1, total // slots)
        light = F.pmod(F.xxhash64("key"), F.lit(slots)).alias("slot")
        heavy = counts.where(F.col("rows") > most).collect()  # fewer than slots
        weights = {r["slot"]: r["rows"] for r in counts.where(F.col("rows") <= most).groupBy(light).agg(F.sum("rows").alias("rows")).collect()}
    finally:
        counts.unpersist()
    cut, free = [], slots
    for row in heavy:
        pieces = math.ceil(row["rows"] / most)
        cut.append((row["key"], free, pieces))
        weights |= dict.fromkeys(range(free, free + pieces), row["rows"] // pieces)
        free += pieces
    spark = df.sparkSession
    kind = df.select(value.alias("key")).schema["key"].dataType.simpleString()
    cuts = F.broadcast(spark.createDataFrame(cut, f"key {kind}, first bigint, pieces bigint"))
    placed = F.broadcast(spark.createDataFrame(list(_packed(weights, partitions).items()), "slot bigint, partition int"))
    rows = df.select(value.alias("key"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    dealt = rows.join(cuts, rows["key"].eqNullSafe(cuts["key"]), "left").select(
        "row", F.coalesce(F.col("first") + F.pmod(F.xxhash64("row"), "pieces"), F.pmod(F.xxhash64(rows["key"]), F.lit(slots))).alias("slot")
    )
    # a row that came in after the count may have a slot without a partition
    number = F.coalesce(F.col("partition"), F.pmod("slot", F.lit(partitions)).cast("int"))
    return dealt.join(placed, "slot", "left").repartitionById(partitions, number).select("row.*")


def partition_rows(df: DataFrame) -> DataFrame:
    """``(partition, rows)`` for every partition, empty ones included.

    A grouped count cannot see an empty partition, and asking for the number of
    partitions separately plans (and under run-time re-planning, runs) the table
    a second time. Here every task reports itself: it receives one constant bit
    per row, no column of the table, and sends one row.
    """

    # Defined here, it travels by value: workers need not have this package.
    def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sum(batch.num_rows for batch in batches)
        partition = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.array([partition], pa.int32()), pa.array([rows], pa.int64())], names=["partition", "rows"]
        )

    return df.select(F.lit(True).alias("row")).mapInArrow(count_batches, "partition int, rows bigint")


def key_rows(df: DataFrame, *keys: str) -> DataFrame:
    """Rows per value of the keys; partial counts make a hot key one row per task."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))


def balance(counts: DataFrame, rows: str = "rows") -> DataFrame:
    """One row of balance figures over a table of row counts.

    Without any counts all figures are zero; ``max_over_min`` is null when the
    smallest count is zero.
    """
    n = F.col(rows)
    figures = counts.agg(
        F.count(n).alias("num_partitions"),
        F.coalesce(F.min(n), F.lit(0)).cast("bigint").alias("min"),
        F.coalesce(F.max(n), F.lit(0)).cast("bigint").alias("max"),
        F.coalesce(F.avg(n), F.lit(0.0)).alias("mean"),
        F.coalesce(F.stddev_pop(n), F.lit(0.0)).alias("std"),
    )
    nothing: Column = F.lit(None).cast("double")
    return figures.withColumns(
        {
            "cv": ratio_or(F.col("std"), F.col("mean"), F.lit(0.0)),
            "max_over_min": ratio_or(F.col("max"), F.col("min"), nothing),
        }
    )


def heaviest(
    counts: DataFrame, limit: int = 10, by: Sequence[str] = ("partition",), rows: str = "rows"
) -> DataFrame:
    """The ``limit`` largest counts, ties in key order. Planned as a top-k, not a sort."""
    return counts.orderBy(F.desc(rows), *[F.asc(k) for k in by]).limit(limit)


def balance_by_phase(phases: dict[str, DataFrame]) -> DataFrame:
    """Balance figures of several states of a table, e.g. before and after a transform."""
    result = None
    for phase, df in phases.items():
        part = balance(partition_rows(df)).select(F.lit(phase).alias("phase"), "*")
        result = part if result is None else result.unionByName(part)
    return result

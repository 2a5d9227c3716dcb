"""Repeatable subsets of one table for size sweeps.

A row belongs to a subset by the hash of its key, so the choice needs no shuffle,
does not depend on the partitioning, and a smaller subset is part of a larger one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Hash spaces: all 64 bits, and for the portable form the first fifteen hex digits of an MD5 digest.
_SPACE = 1 << 64
_MD5_SPACE = 1 << 60
_STRETCH_BITS = 12
_FEW_ROWS = 4096


def md5_position(key: Column) -> Column:
    """Position of a key in ``[0, 2**60)``; any engine with MD5 gets the same number."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 15), 16, 10).cast("bigint")


def subset_fraction(
    df: DataFrame, keys: Sequence[str], fraction: float, portable: bool = False
) -> DataFrame:
    """The rows whose key hash falls in the first ``fraction`` of the hash space."""
    if not 0 <= fraction <= 1:
        raise ValueError(f"fraction must be within 0..1, not {fraction}")
    if portable:
        return df.where(_key_position(keys) < int(fraction * _MD5_SPACE))
    if fraction == 1:
        return df
    first = -(_SPACE // 2)
    return df.where(F.xxhash64(*keys) < F.lit(first + int(fraction * _SPACE)).cast("bigint"))


def _end_of(df: DataFrame, limit: int) -> tuple[int, int]:
    """The position before which rows weigh at most ``limit`` together, the last such one, and what is left.

    ``df`` has position (0 to 2^60) and weight. A pass weighs 4096 stretches of positions, the next
    one those of the stretch in which the limit is reached, until few rows are left in it.
    """
    low, width = 0, _MD5_SPACE.bit_length() - 1
    while True:
        shift = max(0, width - _STRETCH_BITS)
        within = df.where((F.col("position") >= low) & (F.col("position") < low + (1 << width)))
        weighed = within.groupBy(F.shiftright(F.col("position") - low, shift).alias("stretch")).agg(
            F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("rows")
        )
        reached = None
        for row in sorted(weighed.collect(), key=lambda r: r["stretch"]):  # 4096 at most
            if row["weight"] > limit:
                reached = row
                break
            limit -= row["weight"]
        if reached is None:
            return low + (1 << width), limit
        low, width = low + (reached["stretch"] << shift), shift
        if not width:
            return low, limit
        if reached["rows"] <= _FEW_ROWS:
            rows = df.where((F.col("position") >= low) & (F.col("position") < low + (1 << width)))
            for row in rows.groupBy("position").agg(F.sum("weight").alias("weight")).orderBy("position").collect():
                if row["weight"] > limit:
                    return row["position"], limit
                limit -= row["weight"]


def _key_position(keys: Sequence[str]) -> Column:
    return md5_position(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]))


def subset_of_rows(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """Exactly ``rows`` rows, the first by the hash of their key; all of them when there are fewer.

    Fewer rows are part of more. Rows with equal keys are ordered by all their columns; only where
    the limit falls among such rows are any sorted. Positions are found now, without a sort.
    """
    if rows <= 0:
        return df.limit(0)
    placed = df.select(_key_position(keys).alias("position"), F.lit(1).cast("bigint").alias("weight"))
    end, left = _end_of(placed, rows)
    chosen = df.where(_key_position(keys) < end)
    if not left:
        return chosen
    tied = df.where(_key_position(keys) == end).orderBy(F.xxhash64(*df.columns)).limit(left)
    return chosen.unionByName(tied)


def subset_of_weight(df: DataFrame, keys: Sequence[str], limit: int, weight: Column) -> DataFrame:
    """The first rows by the hash of their key that weigh ``limit`` together or just less, e.g. in bytes.

    ``weight`` is a whole number of each row, not negative; null weighs nothing. Rows with equal keys are
    taken together.
    """
    placed = df.select(_key_position(keys).alias("position"), F.coalesce(weight.cast("bigint"), F.lit(0)).alias("weight"))
    end, _ = _end_of(placed, limit)
    return df.where(_key_position(keys) < end)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Size of the files under a path; lists them, reads none."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return listing.agg(F.sum("length").alias("bytes")).first()["bytes"] or 0


def subset_to_size(
    df: DataFrame, keys: Sequence[str], target_bytes: int, table_bytes: int
) -> DataFrame:
    """About ``target_bytes`` worth of a table of ``table_bytes``; all of it when it is smaller."""
    if table_bytes <= target_bytes:
        return df
    return subset_fraction(df, keys, target_bytes / table_bytes)

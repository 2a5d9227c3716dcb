"""Balance over keys and over partitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import layout as ops
from millrace.operators.scaling import scale_columns
from millrace.registry.common import LINE_FEATURES, line_features, lines, r6, round_columns

_FIGURES = ("mean", "std", "cv", "max_over_min")


def _key_balance(spark, folder):
    counts = ops.key_rows(lines(spark, folder), "l_suppkey")
    return round_columns(ops.balance(counts), *_FIGURES)


def _key_balance_top(spark, folder):
    counts = ops.key_rows(lines(spark, folder), "l_suppkey")
    return ops.heaviest(counts, by=["l_suppkey"])


def _dealt(table):
    """Over 17 partitions by the rest of the supplier key modulo 16: the last one stays empty."""
    return table.repartitionById(17, (F.col("l_suppkey") % 16).cast("int"))


def _partition_balance(spark, folder):
    table = _dealt(lines(spark, folder))
    return round_columns(ops.balance(ops.partition_rows(table)), *_FIGURES)


def _partition_top(spark, folder):
    table = _dealt(lines(spark, folder))
    return ops.heaviest(ops.partition_rows(table))


def _balance_phases(spark, folder):
    table = line_features(spark, folder)
    before = _dealt(table)
    after = scale_columns(before, LINE_FEATURES, fitted_on=table)
    return round_columns(ops.balance_by_phase({"before": before, "after": after}), *_FIGURES)


def _balance_by_weight(spark, folder):
    # A third of the rows have one key.
    key = F.when(F.col("l_orderkey") % 3 == 0, 0).otherwise(F.col("l_suppkey"))
    table = lines(spark, folder).withColumn("key", key)
    counts = ops.partition_rows(ops.repartitioned_by_weight(table, 13, "key"))
    return ops.balance(counts).select(
        "num_partitions",
        F.rint(F.col("mean") * F.col("num_partitions")).cast("bigint").alias("rows"),
        (F.col("max") < 1.1 * F.col("mean")).alias("even"),
    )


QUERIES = {
    "balance_by_weight": _balance_by_weight,
    "key_balance": _key_balance,
    "key_balance_top": _key_balance_top,
    "partition_balance": _partition_balance,
    "partition_top": _partition_top,
    "balance_phases": _balance_phases,
}

_PARTITIONS = """SELECT p::INTEGER AS "partition", count(l_suppkey) AS rows
    FROM range(17) AS r(p) LEFT JOIN lineitem ON l_suppkey % 16 = p GROUP BY p"""
_PHYSICAL = f"""count(*) AS num_partitions, min(rows) AS min, max(rows) AS max, {r6('avg(rows)')} AS mean,
    {r6('stddev_pop(rows)')} AS std, {r6('stddev_pop(rows) / avg(rows)')} AS cv, NULL::DOUBLE AS max_over_min"""
_COUNTS = "SELECT l_suppkey, count(*) AS rows FROM lineitem GROUP BY l_suppkey"

ORACLE = {
    "balance_by_weight": "SELECT 13::BIGINT AS num_partitions, count(*) AS rows, true AS even FROM lineitem",
    "key_balance": f"""
        WITH c AS ({_COUNTS})
        SELECT count(*) AS num_partitions, min(rows) AS min, max(rows) AS max,
               {r6('avg(rows)')} AS mean, {r6('stddev_pop(rows)')} AS std,
               {r6('stddev_pop(rows) / avg(rows)')} AS cv,
               {r6('max(rows)::DOUBLE / min(rows)')} AS max_over_min
        FROM c""",
    "key_balance_top": f"{_COUNTS} ORDER BY rows DESC, l_suppkey LIMIT 10",
    "partition_balance": f"WITH c AS ({_PARTITIONS}) SELECT {_PHYSICAL} FROM c",
    "partition_top": f'{_PARTITIONS} ORDER BY rows DESC, "partition" LIMIT 10',
    "balance_phases": f"""
        WITH c AS ({_PARTITIONS}) SELECT phase, {_PHYSICAL} FROM c, (VALUES ('before'), ('after')) AS v(phase)
        GROUP BY phase""",
}

"""Shared pieces of the registered queries."""

from __future__ import annotations

from zlib import crc32

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.tables import parquet_table

LINE_KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
LINE_FEATURES = ("l_quantity", "l_extendedprice", "l_discount")
KEYS_SQL = ", ".join(LINE_KEYS)


def lines(spark: SparkSession, folder: str) -> DataFrame:
    return parquet_table(spark, folder, "lineitem")


def events(spark: SparkSession, folder: str) -> DataFrame:
    return parquet_table(spark, folder, "events")


def line_features(spark: SparkSession, folder: str) -> DataFrame:
    return lines(spark, folder).select(*LINE_KEYS, *LINE_FEATURES)


def round_columns(df: DataFrame, *names: str) -> DataFrame:
    """Six places, since the engines sum in different orders.

    One multiplication and ``rint``: ``round`` goes through decimals and costs more
    than the query. Adding zero turns -0.0 into 0.0.
    """
    return df.withColumns({n: F.expr(f"rint(`{n}` * 1e6D) / 1e6D + 0.0D") for n in names})


def r6(expression: str) -> str:
    """The same in SQL."""
    return f"(round_even(({expression})::DOUBLE * 1e6::DOUBLE, 0) / 1e6::DOUBLE + 0.0)"


def scratch_folder(spark: SparkSession, folder: str, name: str) -> str:
    """The session's folder for tables of ``folder``, shared: for checkpoints or else the warehouse.

    One per folder and name, to be overwritten. A local warehouse will do for a local session only.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    base = (shared or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")
    if not shared and base.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{base}/millrace-{spark.sparkContext.applicationId}/{crc32(folder.encode()):08x}/{name}"

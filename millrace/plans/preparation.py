"""Scaling and encoding runs over a CSV file, timed and with balance figures.

Every run times a full computation of its output (see ``materialise``) and
reports rows per partition before and after the transform.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.fields import (
    TOP_CATEGORY,
    clean_categories,
    clean_features,
    double_or_null,
    feature_array,
    pick_columns,
    present_columns,
)
from millrace.operators.encoding import encode_fixed_width, fit_one_hot
from millrace.operators.layout import balance, heaviest, held, partition_rows, repartitioned
from millrace.operators.scaling import fit_scaler, scaled_check
from millrace.operators.subsets import stored_bytes
from millrace.sinks.execution import materialise
from millrace.sources.tables import TRIP_FEATURES, csv_text


@dataclass
class Run:
    """The prepared table and the record of how it was made."""

    output: DataFrame
    result: dict


def balance_record(df: DataFrame, top: int = 10) -> dict:
    """Balance figures and the heaviest partitions, from one count of the table."""
    counts = partition_rows(df).persist()
    try:
        record = balance(counts).first().asDict()
        record["top_partitions"] = [row.asDict() for row in heaviest(counts, top).collect()]
    finally:
        counts.unpersist()
    return record


def _size_or_none(spark: SparkSession, path: str) -> int | None:
    try:
        return stored_bytes(spark, path)
    except AnalysisException:
        return None


def _staged(df: DataFrame, partitions: int, cache: bool) -> DataFrame:
    df = repartitioned(df, partitions)
    return held(df) if cache else df


def scaling_run(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] = TRIP_FEATURES,
    with_mean: bool = False,
    with_std: bool = False,
    partitions: int = 0,
    cache: bool = False,
    top: int = 10,
    run_id: str = "",
) -> Run:
    """Read, clean, fit and scale; the output is one array column."""
    table = csv_text(spark, path)
    used = present_columns(table, columns)
    cleaned = clean_features(pick_columns(table, used), used)
    features = _staged(cleaned, partitions, cache)
    before = balance_record(features, top)

    started = time.monotonic()
    # Fitted before the shuffle unless its result is stored: the statistics are the same.
    scaled = fit_scaler(features if cache else cleaned, used).transform(features, with_mean, with_std)
    output = scaled.select(feature_array(used).alias("scaled_features"))
    execution = materialise(output, started)

    result = {
        "run_id": run_id,
        "input": path,
        "input_size_bytes": _size_or_none(spark, path),
        "rows": execution.rows,
        "standard_scaler": {
            "withMean": with_mean,
            "withStd": with_std,
            "numeric_cols": used,
            "repartition": partitions,
            "cache": cache,
        },
        "timing": {"job_seconds": execution.seconds},
        # A projection keeps every row in its partition, so the count before holds after.
        "partition_balance": {"before": before, "after": before},
    }
    if cache:
        features.unpersist()
    return Run(output, result)


def zscore_run(
    spark: SparkSession, path: str, columns: Sequence[str] = TRIP_FEATURES, run_id: str = ""
) -> tuple[Run, DataFrame]:
    """Z-scores in place, other columns kept, nulls kept; also the check of the scaled table."""
    table = csv_text(spark, path)
    used = present_columns(table, columns)
    typed = table.withColumns({name: double_or_null(F.col(name)) for name in used})
    started = time.monotonic()
    output = fit_scaler(typed, used).zscore(typed)
    execution = materialise(output, started)
    result = {
        "run_id": run_id,
        "input": path,
        "rows": execution.rows,
        "strategy": "zscore",
        "timing": {
            "job_seconds": execution.seconds,
            "throughput_rows_sec": execution.rows_per_second,
        },
    }
    return Run(output, result), scaled_check(output, used)


def encoding_run(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] = TRIP_FEATURES,
    drop_last: bool = False,
    partitions: int = 0,
    cache: bool = False,
    top: int = 10,
    run_id: str = "",
) -> Run:
    """Read as text, index, fit and encode; the output holds the sparse columns only."""
    table = csv_text(spark, path)
    used = present_columns(table, columns)
    cleaned = clean_categories(pick_columns(table, used), used)
    indexed = _staged(cleaned, partitions, cache)
    before = balance_record(indexed, top)

    started = time.monotonic()
    encoded = fit_one_hot(indexed if cache else cleaned, used, drop_last).sparse(indexed)
    output = encoded.select(*[name + "_vec" for name in used])
    execution = materialise(output, started)

    result = {
        "run_id": run_id,
        "rows": execution.rows,
        "one_hot_encoder": {
            "mode": "fitted",
            "dropLast": drop_last,
            "target_cols": used,
            "repartition": partitions,
            "string_indexer_removed": True,
            "vector_assembler_removed": True,
        },
        "timing": {"job_seconds": execution.seconds},
        "partition_balance": {"before": before, "after": before},
    }
    if cache:
        indexed.unpersist()
    return Run(output, result)


def fixed_encoding_run(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] = TRIP_FEATURES,
    top_category: int = TOP_CATEGORY,
    partitions: int = 0,
    run_id: str = "",
) -> Run:
    """Read and encode at a fixed width in one pass; all columns are kept."""
    started = time.monotonic()
    table = repartitioned(csv_text(spark, path), partitions)
    output = encode_fixed_width(table, columns, top_category)
    execution = materialise(output, started)
    result = {
        "run_id": run_id,
        "rows": execution.rows,
        "framework": "spark",
        "strategy": "stateless_fixed_width",
        "config": {"target_cols": list(columns)},
        "timing": {
            "job_seconds": execution.seconds,
            "throughput_rows_sec": execution.rows_per_second,
        },
    }
    return Run(output, result)

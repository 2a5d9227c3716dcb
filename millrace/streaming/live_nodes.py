"""Node metrics while a run is going on: samplers write files, a stream reads them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from millrace.operators.nodestats import METRICS, clean_readings, metric_series, summarize_by_node
from millrace.sources.nodelogs import METRICS_GLOB, METRICS_SCHEMA, typed_metrics


def stream_node_metrics(
    spark: SparkSession, folder: str, files_per_batch: int = 1000
) -> DataFrame:
    """Cleaned readings from metrics files as they arrive in a folder."""
    raw = (
        spark.readStream.schema(METRICS_SCHEMA)
        .option("header", True)
        .option("pathGlobFilter", METRICS_GLOB)
        .option("maxFilesPerTrigger", files_per_batch)
        .csv(folder)
    )
    return clean_readings(typed_metrics(raw))


def live_series(
    readings: DataFrame,
    every: str = "1 second",
    late_by: str = "1 minute",
    metrics: Sequence[str] = METRICS,
) -> DataFrame:
    """Metric means per node and time step; steps older than ``late_by`` are final and dropped."""
    return metric_series(readings.withWatermark("ts", late_by), metrics, every=every)


def live_summary(readings: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Running per-node average, peak and samples; state is one row per node."""
    return summarize_by_node(readings, metrics)

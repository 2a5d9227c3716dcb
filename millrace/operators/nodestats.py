"""Node-metric summaries: per node, across nodes, and over time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.readings import reading_or_zero

# The metric columns of a node-metrics file, in report order.
METRICS = ("cpu_util_pct", "mem_used_mb", "disk_read_kbps", "disk_write_kbps")


def clean_readings(df: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Metric fields as doubles; a row with any unreadable field is left out whole."""
    typed = df.withColumns({name: reading_or_zero(F.col(name)) for name in metrics})
    return typed.dropna(subset=list(metrics))


def summarize_by_node(
    readings: DataFrame,
    metrics: Sequence[str] = METRICS,
    node: str = "node",
    nodes: DataFrame | None = None,
) -> DataFrame:
    """Per node: ``<metric>_avg``, ``<metric>_peak`` and ``samples``.

    ``nodes`` names the nodes that must appear; one without readings gets zeros.
    """
    measures: list[Column] = []
    for name in metrics:
        measures += [F.avg(name).alias(f"{name}_avg"), F.max(name).alias(f"{name}_peak")]
    summary = readings.groupBy(node).agg(*measures, F.count(F.lit(1)).alias("samples"))
    if nodes is None:
        return summary
    listed = nodes.select(node).distinct().join(summary, node, "left")
    # Not fillna, which would also hide an average that is NaN.
    return listed.withColumns(
        {
            name: F.coalesce(F.col(name), F.lit(0).cast(kind))
            for name, kind in summary.dtypes
            if name != node
        }
    )


def roll_up_nodes(summary: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Across nodes, one row per metric; no nodes give no rows.

    Deliberately the mean of the node averages, so a node counts once however
    many samples it has.
    """
    measures: list[Column] = [F.count(F.lit(1)).alias("num_nodes")]
    for name in metrics:
        measures.append(
            F.struct(
                F.lit(name).alias("metric"),
                F.avg(f"{name}_avg").alias("avg_of_nodes"),
                F.avg(f"{name}_peak").alias("peak_of_nodes_avg"),
                F.max(f"{name}_peak").alias("max_peak"),
            ).alias(name)
        )
    figures = summary.agg(*measures).where("num_nodes > 0")
    return figures.select(F.inline(F.array(*[F.col(n) for n in metrics])), "num_nodes")


def by_metric(
    summary: DataFrame, metrics: Sequence[str] = METRICS, node: str = "node"
) -> DataFrame:
    """The per-node summary as rows ``(node, metric, avg, peak, samples)``."""
    entries = [
        F.struct(
            F.lit(name).alias("metric"),
            F.col(f"{name}_avg").alias("avg"),
            F.col(f"{name}_peak").alias("peak"),
        )
        for name in metrics
    ]
    return summary.select(node, F.inline(F.array(*entries)), "samples")


def metric_series(
    readings: DataFrame,
    metrics: Sequence[str] = METRICS,
    node: str = "node",
    ts: str = "ts",
    every: str = "1 second",
) -> DataFrame:
    """Per node and time step the mean of each metric, for plotting."""
    step = F.window(ts, every)
    return (
        readings.groupBy(node, step.alias("step"))
        .agg(*[F.avg(name).alias(name) for name in metrics], F.count(F.lit(1)).alias("samples"))
        .select(node, F.col("step.start").alias("step_start"), *metrics, "samples")
    )

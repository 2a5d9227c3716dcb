"""From a run's log and metrics folder to its summary and reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from millrace.operators.nodestats import clean_readings, roll_up_nodes, summarize_by_node
from millrace.sinks.summaries import (
    node_report,
    overall_report,
    run_report,
    summary_document,
    write_summary_document,
    write_tsv,
)
from millrace.sources.nodelogs import METRICS_SCHEMA, read_folder_or_none, read_node_metrics, read_node_names
from millrace.sources.runlogs import read_results


@dataclass
class RunSummary:
    nodes: DataFrame
    overall: DataFrame
    result: DataFrame

    def document(self) -> DataFrame:
        return summary_document(self.nodes, self.overall, self.result)

    def write(self, folder: str) -> None:
        """``summary`` (JSON), ``nodes``, ``overall`` and ``run`` (tab-separated) in ``folder``."""
        base = folder.rstrip("/")
        write_summary_document(self.document(), f"{base}/summary")
        write_tsv(node_report(self.nodes).orderBy("node"), f"{base}/nodes")
        write_tsv(overall_report(self.overall).orderBy("position").select("line"), f"{base}/overall")
        write_tsv(run_report(self.result), f"{base}/run")


def summarize_run(spark: SparkSession, log: str, metrics_folder: str) -> RunSummary:
    """Per-node and overall figures and the run result. Missing inputs give empty parts."""
    readings = read_folder_or_none(read_node_metrics, spark, metrics_folder)
    names = read_folder_or_none(read_node_names, spark, metrics_folder)
    if readings is None or names is None:
        readings = spark.createDataFrame([], "node string, " + METRICS_SCHEMA)
        names = readings.select("node")
    nodes = summarize_by_node(clean_readings(readings), nodes=names)
    return RunSummary(nodes, roll_up_nodes(nodes), read_results(spark, log))

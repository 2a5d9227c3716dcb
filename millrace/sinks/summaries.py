"""Summary documents and tab-separated reports of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.readings import fixed_decimals
from millrace.operators.nodestats import METRICS

# Report columns and their decimals.
REPORT_COLUMNS = (
    ("cpu_avg%", "cpu_util_pct_avg", 2),
    ("cpu_peak%", "cpu_util_pct_peak", 2),
    ("mem_avgMB", "mem_used_mb_avg", 0),
    ("mem_peakMB", "mem_used_mb_peak", 0),
    ("rd_avgKB/s", "disk_read_kbps_avg", 1),
    ("rd_peakKB/s", "disk_read_kbps_peak", 1),
    ("wr_avgKB/s", "disk_write_kbps_avg", 1),
    ("wr_peakKB/s", "disk_write_kbps_peak", 1),
)
OVERALL_LABELS = (
    ("cpu_util_pct", "cpu", "%", 2),
    ("mem_used_mb", "mem", "MB", 0),
    ("disk_read_kbps", "rd", "KB/s", 1),
    ("disk_write_kbps", "wr", "KB/s", 1),
)


def _node_entry() -> Column:
    metrics = [
        F.struct(F.col(f"{m}_avg").alias("avg"), F.col(f"{m}_peak").alias("peak")).alias(m)
        for m in METRICS
    ]
    return F.struct("node", F.struct(*metrics, "samples").alias("value"))


def summary_document(summary: DataFrame, roll_up: DataFrame, result: DataFrame) -> DataFrame:
    """One row per log, one column ``document``: the whole run summary as indented JSON.

    ``result`` holds ``payload`` and ``result`` of each log; a payload that is a result
    goes in whole, with fields the schema does not name. Without logs there is one
    document without a run. A document names every node; ``summary_rows`` writes them as
    rows of their own.
    """
    entries = summary.agg(
        F.map_from_entries(F.array_sort(F.collect_list(_node_entry()))).alias("nodes")
    )
    overall = roll_up.agg(
        *[
            F.first(
                F.when(
                    F.col("metric") == m,
                    F.struct("avg_of_nodes", "peak_of_nodes_avg", "max_peak"),
                ),
                ignorenulls=True,
            ).alias(m)
            for m in METRICS
        ],
        F.max("num_nodes").alias("num_nodes"),
    ).select(F.struct(*METRICS, "num_nodes").alias("overall_avg"))
    run = F.parse_json(F.coalesce(F.when(F.col("result").isNotNull(), F.col("payload")), F.lit("{}")))
    one = summary.sparkSession.range(1).select(
        entries.scalar().alias("nodes"), overall.scalar().alias("overall_avg")
    )
    runs = one.join(result.select("payload", "result"), F.lit(True), "left")
    parts = F.struct(run.alias("spark"), "nodes", "overall_avg")
    return runs.select(F.to_json(parts, {"pretty": "true"}).alias("document"))


def write_summary_document(document: DataFrame, folder: str) -> None:
    """One text file in ``folder``; missing parent folders are created."""
    document.coalesce(1).write.mode("overwrite").text(folder)


def summary_rows(summary: DataFrame) -> DataFrame:
    """One JSON object per node, for any number of nodes."""
    entry = _node_entry()
    return summary.select(F.to_json(F.struct("node", entry["value"].alias("metrics"))).alias("value"))


def write_summary_rows(summary: DataFrame, folder: str) -> None:
    summary_rows(summary).write.mode("overwrite").text(folder)


def node_report(summary: DataFrame, node: str = "node") -> DataFrame:
    """The per-node table with fixed columns and decimals, all text."""
    return summary.select(
        F.col(node).alias("node"),
        *[fixed_decimals(c, places).alias(name) for name, c, places in REPORT_COLUMNS],
        F.col("samples").cast("string").alias("samples"),
    )


def overall_report(roll_up: DataFrame) -> DataFrame:
    """``(position, line)``: one line of figures per metric, in report order."""
    labels = F.array(
        *[
            F.struct(
                F.lit(order).alias("position"),
                F.lit(metric).alias("metric"),
                F.lit(short).alias("short"),
                F.lit(unit).alias("unit"),
                F.lit(places).alias("places"),
            )
            for order, (metric, short, unit, places) in enumerate(OVERALL_LABELS)
        ]
    )
    label = F.get(F.filter(labels, lambda entry: entry["metric"] == F.col("metric")), 0)

    def figure(name: str) -> Column:
        places = F.col("label.places")
        return F.when(places == 0, fixed_decimals(name, 0)).when(
            places == 1, fixed_decimals(name, 1)
        ).otherwise(fixed_decimals(name, 2))

    short, unit = F.col("label.short"), F.col("label.unit")
    line = F.concat(
        short, F.lit("_avg"), unit, F.lit("="), figure("avg_of_nodes"),
        F.lit(" "), short, F.lit("_peak_avg"), unit, F.lit("="), figure("peak_of_nodes_avg"),
        F.lit(" "), short, F.lit("_max_peak"), unit, F.lit("="), figure("max_peak"),
    )
    labelled = roll_up.withColumn("label", label).where(F.col("label").isNotNull())
    return labelled.select("label.position", line.alias("line"))


def run_report(result: DataFrame) -> DataFrame:
    """``(label, text)``: seconds and balance of a run, those that are known."""
    r = F.col("result")
    balance = r["partition_balance"]
    texts = {
        "job_seconds": r["timing"]["job_seconds"].cast("string"),
        "partition_balance(before)": F.to_json(balance["before"]),
        "partition_balance(after)": F.to_json(balance["after"]),
    }
    entries = F.array(
        *[F.struct(F.lit(label).alias("label"), text.alias("text")) for label, text in texts.items()]
    )
    return result.select(F.inline(entries)).where(F.col("text").isNotNull())


def write_tsv(report: DataFrame, folder: str) -> None:
    report.write.mode("overwrite").option("sep", "\t").option("header", True).csv(folder)

"""Round trips through files: metrics folders, driver logs, sampler logs, reports, records.

Files are made from the events and line items in the session's shared folder and read
back with the readers that a user calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import nodestats
from millrace.operators.nodestats import METRICS
from millrace.plans.preparation import scaling_run
from millrace.registry import metrics
from millrace.registry.common import LINE_FEATURES, events, line_features, lines, round_columns, scratch_folder
from millrace.registry.metrics import METRIC_SQL
from millrace.sinks import records, summaries
from millrace.sources import nodelogs, runlogs

#: A node or log of the files: an event type and a stretch of events, so that files stay alike at any size.
_STRETCH = 50_000
_KEY = f"event_type || '-' || event_id DIV {_STRETCH}"
_KEY_SQL = f"event_type || '-' || (event_id // {_STRETCH})"

_FIGURES = tuple(f"{m}_{f}" for m in METRICS for f in ("avg", "peak"))


def _one_file_each(spark: SparkSession, rows: DataFrame, folder: str, name: str, suffix: str, order: list[str]) -> None:
    """A text file ``<name><key><suffix>`` per value of ``key``, with the lines in ``value``.

    ``rows`` has key, value and the columns of ``order``.
    """
    parts = f"{folder}-parts"
    dealt = rows.repartition("key").sortWithinPartitions("key", *order).select("key", "value")
    dealt.write.mode("overwrite").partitionBy("key").text(parts)
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    files.delete(path(folder), True)
    files.mkdirs(path(folder))
    for key in files.globStatus(path(f"{parts}/key=*")):
        label = key.getPath().getName().removeprefix("key=")
        (part,) = files.globStatus(path(key.getPath(), "part-*"))
        files.rename(part.getPath(), path(folder, f"{name}{label}{suffix}"))


def _metrics_folder(spark, folder):
    # Files of two nodes have their columns in another order and one more.
    base = scratch_folder(spark, folder, "metrics")
    readings = events(spark, folder).select(
        F.expr(_KEY).alias("key"), "event_id", *[F.expr(sql).alias(n) for n, sql in METRIC_SQL.items()]
    )
    names = list(METRICS)
    other = ["more", *reversed(names)]
    turned = F.pmod(F.crc32(F.col("key").cast("binary")), F.lit(2)) == 1

    def text(columns):
        return F.concat_ws(",", *[F.lit("x") if c == "more" else F.col(c).cast("string") for c in columns])

    rows = readings.select("key", "event_id", F.when(turned, text(other)).otherwise(text(names)).alias("value"))
    header = F.when(turned, F.lit(",".join(other))).otherwise(F.lit(",".join(names)))
    headers = readings.select("key").distinct().select("key", F.lit(-1).cast("bigint").alias("event_id"), header.alias("value"))
    _one_file_each(spark, rows.unionByName(headers), base, "metrics_", ".csv", ["event_id"])
    clean = nodestats.clean_readings(nodelogs.read_node_metrics(spark, base))
    listed = nodelogs.read_node_names(spark, base)
    return round_columns(nodestats.summarize_by_node(clean, nodes=listed), *_FIGURES)


_LOG_SQL = (
    "CASE WHEN event_id % 7 = 3 THEN '  {marker}{{\"run_id\": \"r' || event_id || '\", \"rows\": ' || user_id || "
    "', \"other\": [1], \"timing\": {{\"job_seconds\": ' || (event_id % 100) || '.5}}, \"partition_balance\": "
    "{{\"before\": {{\"num_partitions\": ' || (event_id % 9) || '}}}}}}' "
    "WHEN event_id % 7 = 5 THEN 'INFO {marker}x' ELSE props END"
).format(marker=runlogs.RESULT_MARKER)


def _results(spark, folder):
    base = scratch_folder(spark, folder, "logs")
    rows = events(spark, folder).select(F.expr(_KEY).alias("key"), "event_id", F.expr(_LOG_SQL).alias("value"))
    _one_file_each(spark, rows, base, "", ".log", ["event_id"])
    return runlogs.read_results(spark, base)


def _log_results(spark, folder):
    return _results(spark, folder).select(
        F.regexp_extract("path", "([^/]*)[.]log$", 1).alias("log"), "payload", "result.run_id", "result.rows"
    )


def _log_fields(spark, folder):
    # ``other`` stands in no schema.
    found = _results(spark, folder)
    taken = {"other": ("$.other[0]", "bigint"), "job_seconds": ("$.timing.job_seconds", "double"), "run_id": ("$.run_id", "string")}
    return found.where("fields IS NOT NULL").select(
        F.regexp_extract("path", "([^/]*)[.]log$", 1).alias("log"),
        *[F.try_variant_get("fields", *where).alias(name) for name, where in taken.items()],
    )


def _run_report(spark, folder):
    path = scratch_folder(spark, folder, "run-report")
    summaries.write_tsv(summaries.run_report(_results(spark, folder)), path)
    return spark.read.option("sep", "\t").option("header", True).csv(path)


def _sampler_files(spark, folder):
    base = scratch_folder(spark, folder, "sampler")
    rows = events(spark, folder).select(
        F.when(F.col("event_id") % 10 == 0, F.lit("broken")).otherwise(
            F.concat_ws(" ", F.unix_timestamp("ts"), F.col("event_id"), F.col("user_id"))
        ).alias("value")
    )
    rows.write.mode("overwrite").text(base)
    cpu = nodelogs.read_cpu_log(spark, base).select(F.unix_timestamp("ts").alias("epoch"), F.col("cpu_util_pct").alias("first"))
    memory = nodelogs.read_memory_log(spark, base).select(
        F.unix_timestamp("ts").alias("epoch"), F.col("mem_used_mb").alias("first"), F.col("mem_available_mb").alias("second")
    )
    return cpu.withColumn("second", F.lit(None).cast("double")).unionByName(memory)


def _scaling_record_files(spark, folder):
    path = scratch_folder(spark, folder, "scaling-records")
    result = F.struct(
        F.struct(F.col("l_quantity").alias("job_seconds")).alias("timing"),
        F.col("l_partkey").alias("rows"),
        F.col("l_orderkey").cast("string").alias("run_id"),
    )
    runs = lines(spark, folder).select(
        F.concat(F.col("l_suppkey").cast("string"), F.lit(".csv")).alias("dataset_file"),
        F.col("l_linenumber").alias("machines"),
        F.when(F.col("l_linenumber") == 7, 1).otherwise(0).alias("rc"),
        F.when(F.col("l_linenumber") != 7, result).alias("result"),
    )
    made = records.scaling_records(runs)
    made.limit(0).write.mode("overwrite").csv(path)
    for half in (made.where("machines < 4"), made.where("machines >= 4")):
        records.append_scaling_records(half, path)
    return runlogs.read_scaling_records(spark, path)


def _scaling_records_again(spark, folder):
    # A run per line number; the second half is written twice, as after a retry.
    path = scratch_folder(spark, folder, "scaling-records-put")
    result = F.struct(
        F.struct(F.col("l_quantity").alias("job_seconds")).alias("timing"),
        F.col("l_partkey").alias("rows"),
        F.concat(F.lit("run "), F.col("l_linenumber").cast("string")).alias("run_id"),
    )
    runs = lines(spark, folder).select(
        F.concat((F.col("l_suppkey") % 3).cast("string"), F.lit(".csv")).alias("dataset_file"),
        F.col("l_linenumber").alias("machines"),
        F.when(F.col("l_linenumber") == 7, 1).otherwise(0).alias("rc"),
        F.when(F.col("l_linenumber") != 7, result).alias("result"),
    )
    made = records.scaling_records(runs)
    for half in (made.where("machines < 4"), made.where("machines >= 4"), made.where("machines >= 4")):
        records.put_scaling_records(half, path)
    return runlogs.read_scaling_records(spark, path)


def _run_record(spark, folder):
    """What a scaling run over the line items records, but for its seconds."""
    source = scratch_folder(spark, folder, "run-input")
    line_features(spark, folder).write.mode("overwrite").option("header", True).csv(source)
    run = scaling_run(spark, source, LINE_FEATURES, with_std=True, partitions=6, run_id="recorded")
    path = scratch_folder(spark, folder, "run-records")
    made = records.run_record(spark, run.result)
    made.limit(0).write.mode("overwrite").json(path)
    records.write_run_record(spark, run.result, path)
    saved = spark.read.schema(made.schema).json(path)
    return saved.select(
        "run_id",
        "rows",
        "standard_scaler.withMean",
        "standard_scaler.withStd",
        F.array_join("standard_scaler.numeric_cols", ",").alias("columns"),
        "partition_balance.before.num_partitions",
        (F.col("timing.job_seconds") > 0).alias("timed"),
    )


QUERIES = {
    "metrics_folder_summary": _metrics_folder,
    "log_results": _log_results,
    "log_fields": _log_fields,
    "run_report": _run_report,
    "sampler_files": _sampler_files,
    "scaling_record_files": _scaling_record_files,
    "scaling_records_again": _scaling_records_again,
    "run_record": _run_record,
}

_FIRST = f"""
    SELECT {_KEY_SQL} AS log, min(event_id) AS id, arg_min(user_id, event_id) AS rows
    FROM events WHERE event_id % 7 = 3 GROUP BY 1"""
_PAYLOAD = """'{"run_id": "r' || id || '", "rows": ' || rows || ', "other": [1], "timing": {"job_seconds": '
    || (id % 100) || '.5}, "partition_balance": {"before": {"num_partitions": ' || (id % 9) || '}}}'"""

ORACLE = {
    "metrics_folder_summary": metrics.node_summary_sql(_KEY_SQL),
    "log_results": f"SELECT log, {_PAYLOAD} AS payload, 'r' || id AS run_id, rows FROM ({_FIRST})",
    "log_fields": f"""
        SELECT log, 1::BIGINT AS other, id % 100 + 0.5::DOUBLE AS job_seconds, 'r' || id AS run_id FROM ({_FIRST})""",
    "run_report": f"""
        SELECT 'job_seconds' AS label, (id % 100) || '.5' AS text FROM ({_FIRST})
        UNION ALL SELECT 'partition_balance(before)', '{{"num_partitions":' || (id % 9) || '}}' FROM ({_FIRST})""",
    "sampler_files": """
        SELECT floor(epoch(ts))::BIGINT AS epoch, event_id::DOUBLE AS first, v.second FROM events,
               LATERAL (SELECT NULL::DOUBLE AS second UNION ALL SELECT user_id::DOUBLE) AS v
        WHERE event_id % 10 <> 0""",
    "scaling_record_files": """
        SELECT l_suppkey || '.csv' AS dataset_file, CAST(l_linenumber AS INTEGER) AS machines,
               CAST(l_linenumber AS INTEGER) AS executor_instances, 4 AS executor_cores,
               CAST(l_linenumber * 4 AS INTEGER) AS total_executor_cores,
               CASE WHEN l_linenumber <> 7 THEN l_quantity END AS job_seconds,
               CASE WHEN l_linenumber <> 7 THEN l_partkey END AS rows,
               CASE WHEN l_linenumber <> 7 THEN l_orderkey::VARCHAR END AS run_id,
               CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END AS rc
        FROM lineitem""",
    "scaling_records_again": """
        SELECT (l_suppkey % 3) || '.csv' AS dataset_file, CAST(l_linenumber AS INTEGER) AS machines,
               CAST(l_linenumber AS INTEGER) AS executor_instances, 4 AS executor_cores,
               CAST(l_linenumber * 4 AS INTEGER) AS total_executor_cores,
               CASE WHEN l_linenumber <> 7 THEN l_quantity END AS job_seconds,
               CASE WHEN l_linenumber <> 7 THEN l_partkey END AS rows,
               CASE WHEN l_linenumber <> 7 THEN 'run ' || l_linenumber END AS run_id,
               CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END AS rc
        FROM lineitem""",
    "run_record": f"""
        SELECT 'recorded' AS run_id, count(*) AS rows, false AS "withMean", true AS "withStd",
               '{','.join(LINE_FEATURES)}' AS columns, 6::BIGINT AS num_partitions, true AS timed
        FROM lineitem""",
}

"""Run records and scaling records."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from millrace.sources.runlogs import RECORD, RESULT_MARKER, RESULT_SCHEMA, SCALING_RECORD_SCHEMA


def result_line(result: dict) -> str:
    """The line a driver log carries for one run."""
    return RESULT_MARKER + json.dumps(result, ensure_ascii=False)


def run_record(spark: SparkSession, result: dict) -> DataFrame:
    """One row with the typed fields of a run result."""
    text = spark.createDataFrame([(json.dumps(result),)], "payload string")
    return text.select(F.from_json("payload", RESULT_SCHEMA).alias("r")).select("r.*")


def _replaced(records: DataFrame, *parts: str) -> DataFrameWriter:
    """A writer that replaces the folders of the records' own values of ``parts``, and no others."""
    return records.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts)


def write_run_record(spark: SparkSession, result: dict, path: str) -> None:
    """Append the run to a folder of JSON records."""
    run_record(spark, result).write.mode("append").json(path)


def put_run_record(spark: SparkSession, result: dict, path: str) -> None:
    """Put the run into a folder of JSON records, a folder per run.

    A run that is written again, as after a retry, replaces its record; others stay.
    """
    _replacing(run_record(spark, result), "run_id").json(path)


def _replacing(records: DataFrame, *parts: str) -> DataFrameWriter:
    """A writer that replaces the folders of the records' own values of ``parts``, and no others."""
    return records.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts)


def scaling_records(results: DataFrame, cores_per_machine: int = 4) -> DataFrame:
    """Scaling records from rows ``(dataset_file, machines, rc, result)``.

    A run without a result keeps its row, with the time and rows empty.
    """
    return results.select(
        "dataset_file",
        F.col("machines").cast("int").alias("machines"),
        F.col("machines").cast("int").alias("executor_instances"),
        F.lit(cores_per_machine).alias("executor_cores"),
        (F.col("machines") * cores_per_machine).cast("int").alias("total_executor_cores"),
        F.col("result.timing.job_seconds").alias("job_seconds"),
        F.col("result.rows").alias("rows"),
        F.col("result.run_id").alias("run_id"),
        F.col("rc").cast("int").alias("rc"),
    )


def append_scaling_records(records: DataFrame, path: str) -> None:
    """Append to a folder of CSV records, columns in record order."""
    fields = [part.split()[0] for part in SCALING_RECORD_SCHEMA.split(", ")]
    records.select(*fields).write.mode("append").option("header", True).csv(path)


def put_scaling_records(records: DataFrame, path: str) -> None:
    """Put into a folder of CSV records, a folder per run; ``read_scaling_records`` reads them.

    Records of a run that is written again replace its earlier ones, others stay. A run that
    failed has no id: it goes by its dataset, its machines and its exit code.
    """
    failed = F.concat_ws("-", F.lit("failed"), "dataset_file", "machines", "rc")
    fields = [part.split()[0] for part in SCALING_RECORD_SCHEMA.split(", ")]
    named = records.select(*fields).withColumn(RECORD, F.coalesce(F.concat(F.lit("run-"), F.col("run_id")), failed))
    _replacing(named, RECORD).option("header", True).csv(path)

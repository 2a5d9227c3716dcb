"""Run results out of driver logs, and scaling records."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources import files
from millrace.sources.tables import listed_files, path_missing

# The marker before a result, and the fields of a result.
RESULT_MARKER = "__RESULT_JSON__"
_BALANCE = (
    "struct<num_partitions: bigint, min: bigint, max: bigint, mean: double, std: double, "
    "cv: double, max_over_min: double, "
    "top_partitions: array<struct<partition: int, rows: bigint>>>"
)
RESULT_SCHEMA = (
    "struct<run_id: string, input: string, input_size_bytes: bigint, rows: bigint, "
    "framework: string, strategy: string, "
    "standard_scaler: struct<withMean: boolean, withStd: boolean, numeric_cols: array<string>, "
    "repartition: int, cache: boolean>, "
    "one_hot_encoder: struct<mode: string, dropLast: boolean, target_cols: array<string>, "
    "repartition: int, string_indexer_removed: boolean, vector_assembler_removed: boolean>, "
    "config: struct<batch_size: int, target_cols: array<string>>, "
    "timing: struct<job_seconds: double, throughput_rows_sec: double>, "
    f"partition_balance: struct<before: {_BALANCE}, after: {_BALANCE}>>"
)
SCALING_RECORD_SCHEMA = (
    "dataset_file string, machines int, executor_instances int, executor_cores int, "
    "total_executor_cores int, job_seconds double, rows bigint, run_id string, rc int"
)


#: The folder name by which scaling records of one run lie together.
RECORD = "record"


def parse_result(payload: Column, schema: str = RESULT_SCHEMA) -> Column:
    """A result struct, or null unless the payload is exactly one well-formed JSON object.

    Parsed as a one-element array: text after the object then is an error, where
    the parser would otherwise stop at the object's end. Text that does not begin and
    end like an object never reaches the parser. ``schema`` names the fields to take;
    few are parsed faster than all.
    """
    text = F.btrim(payload, F.lit(" \t\r\n"))
    options = {"allowSingleQuotes": "false"}
    parsed = F.from_json(F.concat(F.lit("["), text, F.lit("]")), f"array<{schema}>", options)
    # Through a one-element array, so that the text is parsed once for both uses.
    single = F.get(F.filter(F.array(parsed), lambda objects: F.size(objects) == 1), 0)
    return F.when(text.startswith("{") & text.endswith("}"), F.get(single, 0))


def parse_fields(payload: Column) -> Column:
    """A result as VARIANT with all its fields, named in a schema or not; null where ``parse_result`` is.

    Take fields with ``try_variant_get(fields, "$.name", type)``. Parsed within an array, as
    there, so that nothing may follow the object.
    """
    text = F.btrim(payload, F.lit(" \t\r\n"))
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    alone = F.try_variant_get(listed, "$[1]", "variant").isNull()
    return F.when(text.startswith("{") & text.endswith("}") & alone, F.try_variant_get(listed, "$[0]", "variant"))


def plain_path(path: Column) -> Column:
    """Local paths are written ``file:/x`` or ``file:///x``; use the first form."""
    return F.regexp_replace(path, "^file:/+", "file:/")


_MARKED_LINE = rf"^\s*{RESULT_MARKER}(.*)$"


def first_marked_line(lines: DataFrame) -> DataFrame:
    """``(path, payload)`` of each log's first marked line.

    Expects ``(path, at, value)`` with ``at`` in line order. A partial aggregate
    keeps one line per log and task, so a log of any size is spread over tasks.
    """
    return (
        lines.where(F.col("value").rlike(_MARKED_LINE))
        .groupBy("path")
        .agg(F.min_by("value", "at").alias("value"))
        .select("path", F.regexp_extract("value", _MARKED_LINE, 1).alias("payload"))
    )


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """``(path, payload, result, fields)`` for every log: its first marked line.

    ``result`` has the fields that are known beforehand, ``fields`` all of them as VARIANT.

    A log without a marked line, or whose first one is malformed, has a null
    result. A missing path gives no rows. Logs are searched once, by pieces, each up to
    its first marked line.
    """
    if files.opens(path):
        if not files.exists(path):
            return _parsed(spark.createDataFrame([], "path string, payload string"))
        marked = files.load(spark, files.MarkedLines, path, marker=RESULT_MARKER)
        first = marked.groupBy("path").agg(F.min_by("line", "at").alias("line"))
        found = first.select("path", F.regexp_extract("line", _MARKED_LINE, 1).alias("payload"))
    else:
        found = _found_by_spark(spark, path)
    return _parsed(found)


def _parsed(found: DataFrame) -> DataFrame:
    payload = F.col("payload")
    return found.select("path", "payload", parse_result(payload).alias("result"), parse_fields(payload).alias("fields"))


def _found_by_spark(spark: SparkSession, path: str) -> DataFrame:
    """The same of a store that only Spark opens: files are listed first, then joined to their marked lines."""
    try:
        listing = listed_files(spark, path).select(plain_path(F.col("path")).alias("path"))
        # Split at line feeds only; a trailing \r is left for the JSON parser to skip.
        text = spark.read.option("lineSep", "\n").text(path)
    except AnalysisException as error:
        if not path_missing(error):
            raise
        return spark.createDataFrame([], "path string, payload string")
    # A log may be read in several splits: the offset of the split orders those,
    # the growing row id orders the lines of one.
    lines = text.select(
        plain_path(F.col("_metadata.file_path")).alias("path"),
        F.struct(
            F.col("_metadata.file_block_start").alias("split"),
            F.monotonically_increasing_id().alias("line"),
        ).alias("at"),
        "value",
    )
    return listing.join(first_marked_line(lines), "path", "left").select("path", "payload")


def read_scaling_records(spark: SparkSession, path: str) -> DataFrame:
    """Scaling records, appended or put; ``job_seconds`` and ``rows`` are empty for a failed run."""
    return spark.read.schema(SCALING_RECORD_SCHEMA).option("header", True).csv(path).drop(RECORD)

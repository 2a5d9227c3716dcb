"""Node-metric files: one CSV per node, and the older plain-text sampler logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources import files
from millrace.sources.tables import listed_files, path_missing

# The columns of a metrics file and its name.
METRICS_FIELDS = (
    "ts",
    "hostname",
    "tag",
    "cpu_util_pct",
    "mem_used_mb",
    "mem_total_mb",
    "disk_read_kbps",
    "disk_write_kbps",
    "devices",
)
METRICS_SCHEMA = ", ".join(f"{name} string" for name in METRICS_FIELDS)
METRICS_GLOB = "metrics_*.csv"
METRICS_NAME_PATTERN = r"^metrics_(.*)\.csv$"


def node_of_file(file_name: Column) -> Column:
    """The node a metrics file belongs to; the file name decides, not ``hostname``.

    Spark gives file names percent-encoded, with ``+`` standing for itself.
    """
    plain = F.url_decode(F.replace(file_name, F.lit("+"), F.lit("%2B")))
    return F.regexp_extract(plain, METRICS_NAME_PATTERN, 1)


def typed_metrics(raw: DataFrame) -> DataFrame:
    """``ts`` as timestamp, ``devices`` as array, ``node`` from the file; metrics stay text.

    Metric fields are typed by ``clean_readings``, which also decides which rows count.
    """
    node = F.col("node") if "node" in raw.columns else node_of_file(F.col("_metadata.file_name"))
    return raw.select(
        node.alias("node"),
        F.timestamp_millis((F.col("ts").try_cast("double") * 1000).cast("bigint")).alias("ts"),
        *[F.col(n) for n in METRICS_FIELDS if n not in ("ts", "devices")],
        F.filter(F.split("devices", ";"), lambda d: d != "").alias("devices"),
    )


def read_node_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """All ``metrics_<node>.csv`` files of a folder, columns taken by name.

    Every file has its own header: columns may come in any order, unknown ones are
    ignored, absent ones are null (and count as empty). The folder is read once, when
    the result is.
    """
    if not files.opens(folder):
        return _by_spark(spark, folder)
    if not files.exists(folder):
        return spark.read.text(folder)  # Spark's own error
    rows = files.load(spark, files.RowsByHeader, folder, names=METRICS_GLOB, fields=",".join(METRICS_FIELDS))
    return typed_metrics(rows.withColumn("node", F.regexp_extract("file_name", METRICS_NAME_PATTERN, 1)))


def _by_spark(spark: SparkSession, folder: str) -> DataFrame:
    """The same of a store that only Spark opens: headers are found first, then joined to their lines."""
    lines = (
        spark.read.option("pathGlobFilter", METRICS_GLOB)
        .text(folder)
        .select(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_name").alias("file_name"),
            F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"),
            "value",
        )
        .where(F.trim("value") != "")
    )
    headers = lines.groupBy("path").agg(F.min_by("value", "at").alias("header"))
    widest = headers.agg(F.max(F.size(F.split("header", ",")))).first()[0] or 1
    fields = ", ".join(f"c{k} string" for k in range(widest))

    def cells(row: str) -> Column:
        return F.array(*[F.col(f"{row}.c{k}") for k in range(widest)])

    # Where each field stands is worked out once per file, the lines are parsed once each.
    names = F.transform(cells("names"), lambda name: F.trim(name))
    position = {n: F.array_position(names, n).cast("int") for n in METRICS_FIELDS}
    places = headers.select("path", "header", F.from_csv("header", fields).alias("names")).select(
        "path", "header", *[F.when(at > 0, at - 1).alias(f"at_{n}") for n, at in position.items()]
    )
    parsed = lines.select("path", "file_name", "value", F.from_csv("value", fields).alias("row"))
    rows = parsed.join(places, "path").where(F.col("value") != F.col("header"))
    return typed_metrics(
        rows.select(
            node_of_file(F.col("file_name")).alias("node"),
            *[F.trim(F.get(cells("row"), F.col(f"at_{n}"))).alias(n) for n in METRICS_FIELDS],
        )
    )


def read_node_names(spark: SparkSession, folder: str) -> DataFrame:
    """``node`` for every metrics file, including files that hold no readings."""
    if not files.opens(folder):
        names = F.element_at(F.split("path", "/"), -1)
        return listed_files(spark, folder, METRICS_GLOB).select(node_of_file(names).alias("node"))
    if not files.exists(folder):
        return spark.read.text(folder)  # Spark's own error
    named = files.load(spark, files.NamedFiles, folder, names=METRICS_GLOB)
    return named.select(F.regexp_extract("name", METRICS_NAME_PATTERN, 1).alias("node"))


def read_folder_or_none(read, spark: SparkSession, folder: str) -> DataFrame | None:
    """The reader's result, or None when the folder does not exist."""
    try:
        return read(spark, folder)
    except AnalysisException as error:
        if path_missing(error):
            return None
        raise


def sampler_readings(lines: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``(path, ts, *fields)`` from ``(path, value)`` lines of an epoch and numbers.

    Lines with a missing or unreadable number are left out.
    """
    words = F.split(F.trim("value"), r"\s+")
    numbers = [F.get("words", i).try_cast("double").alias(n) for i, n in enumerate(fields, 1)]
    return (
        lines.select("path", words.alias("words"))
        .select("path", F.get("words", 0).try_cast("bigint").alias("epoch"), *numbers)
        .where(F.col("epoch").isNotNull())
        .dropna(subset=list(fields))
        .select("path", F.timestamp_seconds("epoch").alias("ts"), *fields)
    )


def _log_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value")


def read_cpu_log(spark: SparkSession, path: str) -> DataFrame:
    """``epoch percent`` lines as ``(path, ts, cpu_util_pct)``."""
    return sampler_readings(_log_lines(spark, path), ["cpu_util_pct"])


def read_memory_log(spark: SparkSession, path: str) -> DataFrame:
    """``epoch used available`` lines as ``(path, ts, mem_used_mb, mem_available_mb)``."""
    return sampler_readings(_log_lines(spark, path), ["mem_used_mb", "mem_available_mb"])

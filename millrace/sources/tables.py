"""Feature tables in Parquet and CSV."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# The feature columns of a trip file.
TRIP_FEATURES = ("passenger_count", "trip_distance", "fare_amount")


def parquet_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a folder of Parquet tables."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def csv_text(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """CSV with a header, every column a string: only headers are read now.

    Type the columns with ``clean_features`` or ``clean_categories``; columns that
    are not used are never parsed. The files of one path have one header, which is
    enforced; several paths may order their columns differently and are put together
    by name.
    """
    return _by_name(path, lambda one: _checked_csv(spark, one, spark.read.option("header", True).csv(one).schema))


def _checked_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A file with another header is an error, not columns mixed up."""
    return spark.read.option("header", True).schema(schema).option("enforceSchema", False).csv(path)


def _by_name(path: str | Sequence[str], read: Callable[[str], DataFrame]) -> DataFrame:
    tables = [read(one) for one in ([path] if isinstance(path, str) else path)]
    return reduce(lambda a, b: a.unionByName(b), tables)


def csv_typed(
    spark: SparkSession, path: str | Sequence[str], schema: StructType | str | None = None
) -> DataFrame:
    """CSV with a header and typed columns: a given schema, or inferred with one more pass."""
    def read(one: str) -> DataFrame:
        found = schema
        if found is None:
            found = spark.read.option("header", True).option("inferSchema", True).csv(one).schema
        return _checked_csv(spark, one, found)

    return _by_name(path, read)


def path_missing(error: AnalysisException) -> bool:
    return error.getCondition() == "PATH_NOT_FOUND"


def listed_files(spark: SparkSession, path: str, name_glob: str = "*") -> DataFrame:
    """``path`` of every file, from the file index Spark keeps on the driver anyway.

    A scan would leave out empty files.
    """
    index = spark.read.format("binaryFile").option("pathGlobFilter", name_glob).load(path)
    return spark.createDataFrame([(file,) for file in index.inputFiles()], "path string")

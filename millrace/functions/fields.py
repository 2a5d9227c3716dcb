"""Choosing, typing and cleaning feature columns.

Everything here is a projection. Chained calls collapse into one ``Project``
above the scan, so only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the highest category the fixed-width encoder keeps (width 21).
TOP_CATEGORY = 20


def split_names(text: str) -> list[str]:
    """Names from a comma-separated argument, blanks trimmed, empties dropped."""
    return [name.strip() for name in text.split(",") if name.strip()]


def present_columns(
    df: DataFrame, wanted: Iterable[str], on_missing: str = "error"
) -> list[str]:
    """The wanted names that exist, in wanted order.

    ``on_missing="error"`` raises when nothing is left; ``"skip"`` allows an
    empty answer.
    """
    if on_missing not in ("error", "skip"):
        raise ValueError(f"on_missing must be 'error' or 'skip', not {on_missing!r}")
    names = [name.strip() for name in wanted]
    have = set(df.columns)
    found = [name for name in names if name in have]
    if not found and on_missing == "error":
        raise ValueError(f"none of {names} is a column; the table has {df.columns}")
    return found


def pick_columns(df: DataFrame, wanted: Iterable[str], on_missing: str = "error") -> DataFrame:
    """Project to the wanted columns that exist."""
    return df.select(*present_columns(df, wanted, on_missing))


def double_or_null(column: Column) -> Column:
    """Typed as double; text that is not a number becomes null instead of an error."""
    return column.try_cast("double")


def double_or_zero(column: Column) -> Column:
    """Typed as double with null and NaN replaced by 0.0."""
    number = double_or_null(column)
    return F.when(number.isNull() | F.isnan(number), F.lit(0.0)).otherwise(number)


def truncate_to_int(column: Column) -> Column:
    """Toward zero; null where the number does not fit an int."""
    return column.try_cast("double").try_cast("int")


def clip(column: Column, low: float, high: float) -> Column:
    """Clip a double. Fill nulls and NaN first: ``least`` skips nulls and ranks NaN highest."""
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), column))


def category_index(column: Column) -> Column:
    """Number or text to a category index: fill, then truncate; no clipping."""
    return F.coalesce(truncate_to_int(double_or_zero(column)), F.lit(0))


def clipped_category_index(column: Column, top: int = TOP_CATEGORY) -> Column:
    """Fill, clip as double, then truncate, so an over-range value lands on ``top``."""
    return clip(double_or_zero(column), 0, top).cast("int")


def clean_features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Numeric features in place: double, nothing missing."""
    return df.withColumns({name: double_or_zero(F.col(name)) for name in columns})


def clean_categories(df: DataFrame, columns: Sequence[str], top: int | None = None) -> DataFrame:
    """Category indices in place; clipped to ``0..top`` when ``top`` is given."""
    if top is None:
        return df.withColumns({name: category_index(F.col(name)) for name in columns})
    return df.withColumns({name: clipped_category_index(F.col(name), top) for name in columns})


def feature_array(columns: Sequence[str]) -> Column:
    """The named columns as one ``array<double>``, in order."""
    return F.array(*[F.col(name).cast("double") for name in columns])


def feature_vector(df: DataFrame, columns: Sequence[str], output: str = "features") -> DataFrame:
    """Only the assembled ML vector, for users of MLlib stages."""
    return VectorAssembler(inputCols=list(columns), outputCol=output).transform(df).select(output)

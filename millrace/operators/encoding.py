"""One-hot encoding, fitted to the data or at a fixed width.

Encoded values come in three shapes, all plain expressions:

* sparse: ``struct(size, indices, values)`` - one slot per row however many
  categories there are; the shape to use when the width is large;
* dense: ``array<double>``;
* slots: one ``double`` column per category.

``mllib_one_hot`` gives ML vectors instead.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from millrace.functions.fields import TOP_CATEGORY, clipped_category_index, present_columns

# Indices are 32-bit numbers.
MOST_CATEGORIES = (1 << 31) - 1


def dense_slots(index: str, width: int) -> Column:
    """``array<double>`` of ``width`` with 1.0 at column ``index``; all zeros for null or >= width."""
    if width <= 0:
        return F.expr("CAST(array() AS array<double>)")
    return F.expr(
        f"IF(`{index}` < {width}, concat(array_repeat(0.0D, `{index}`), array(1.0D), "
        f"array_repeat(0.0D, {width - 1} - `{index}`)), array_repeat(0.0D, {width}))"
    )


def sparse_slots(index: Column, width: int) -> Column:
    """``struct(size, indices, values)`` with at most one filled slot."""
    inside = index < width
    return F.struct(
        F.lit(width).alias("size"),
        F.when(inside, F.array(index.cast("int")))
        .otherwise(F.array().cast("array<int>"))
        .alias("indices"),
        F.when(inside, F.array(F.lit(1.0)))
        .otherwise(F.array().cast("array<double>"))
        .alias("values"),
    )


def _with_outputs(df: DataFrame, indices: dict[str, Column], outputs: dict[str, Column]) -> DataFrame:
    # The indices are a projection of their own, so their checks and casts run
    # once per row and not once per slot.
    staged = df.withColumns(indices)
    return staged.select(
        *[F.col(f"`{name}`") for name in df.columns],
        *[column.alias(name) for name, column in outputs.items()],
    )


def encode_fixed_width(
    df: DataFrame, columns: Sequence[str], top: int = TOP_CATEGORY, suffix: str = "_vec"
) -> DataFrame:
    """Stateless dense encoding of width ``top + 1``; no fit, hence no barrier.

    Values are filled, clipped to ``0..top`` and truncated first. Missing
    columns are skipped; all columns of the table pass through.
    """
    found = present_columns(df, columns, on_missing="skip")
    return _with_outputs(
        df,
        {f"__index_{n}": clipped_category_index(F.col(n), top) for n in found},
        {n + suffix: dense_slots(f"__index_{n}", top + 1) for n in found},
    )


def encode_batches(
    df: DataFrame,
    columns: Sequence[str],
    top: int = TOP_CATEGORY,
    batch_size: int = 4096,
    suffix: str = "_vec",
) -> DataFrame:
    """``encode_fixed_width`` through a batch function, for comparison and as a pattern.

    The index is computed before it leaves the JVM, and only the index does: the function turns
    batches of indices into lists of an identity matrix's rows, as Arrow arrays.
    """
    found = present_columns(df, columns, on_missing="skip")
    width = top + 1

    @F.arrow_udf(ArrayType(DoubleType()))
    def fill(index: pa.Array) -> pa.Array:
        parts = []
        for begin in range(0, len(index), batch_size):
            own = index.slice(begin, batch_size).to_numpy(zero_copy_only=False).astype(np.int64)
            values = np.zeros((len(own), width))
            values[np.arange(len(own)), own] = 1.0
            parts.append(pa.ListArray.from_arrays(np.arange(0, values.size + 1, width, dtype=np.int32), values.ravel()))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.float64()))

    return df.withColumns({name + suffix: fill(clipped_category_index(F.col(name), top)) for name in found})


@dataclass(frozen=True)
class OneHotModel:
    """Category count per column."""

    columns: tuple[str, ...]
    sizes: tuple[int, ...]
    drop_last: bool = False
    handle_invalid: str = "error"

    def width(self, name: str) -> int:
        """Slots of the encoded column. With ``keep`` the extra slot is the last one."""
        size = self.sizes[self.columns.index(name)]
        return size + (self.handle_invalid == "keep") - self.drop_last

    def checked_index(self, name: str) -> Column:
        """The category, with anything outside the fitted range raised or moved to its own slot."""
        size = self.sizes[self.columns.index(name)]
        value = F.col(name).cast("double")
        valid = (value >= 0) & (value < size) & (value == F.floor(value))
        if self.handle_invalid == "keep":
            return F.when(valid, value.cast("int")).otherwise(F.lit(size))
        message = F.concat(
            F.lit(f"column {name} holds an unseen or invalid category: "),
            F.coalesce(value.cast("string"), F.lit("null")),
        )
        return F.when(valid, value.cast("int")).otherwise(F.raise_error(message).cast("int"))

    def _encode(self, df: DataFrame, outputs: dict[str, Column]) -> DataFrame:
        return _with_outputs(df, {f"__index_{n}": self.checked_index(n) for n in self.columns}, outputs)

    def sparse(self, df: DataFrame, suffix: str = "_vec") -> DataFrame:
        """Append one sparse column per encoded column."""
        return self._encode(
            df,
            {n + suffix: sparse_slots(F.col(f"__index_{n}"), self.width(n)) for n in self.columns},
        )

    def dense(self, df: DataFrame, suffix: str = "_vec") -> DataFrame:
        """Append one dense array per encoded column."""
        return self._encode(
            df,
            {n + suffix: dense_slots(f"__index_{n}", self.width(n)) for n in self.columns},
        )

    def slots(self, df: DataFrame, infix: str = "_is_") -> DataFrame:
        """Append one double column per category of every encoded column."""
        return self._encode(
            df,
            {
                f"{n}{infix}{slot}": F.expr(f"double(`__index_{n}` = {slot})")
                for n in self.columns
                for slot in range(self.width(n))
            },
        )


def fit_one_hot(
    df: DataFrame,
    columns: Sequence[str],
    drop_last: bool = False,
    handle_invalid: str = "error",
) -> OneHotModel:
    """Category counts (highest index + 1) and input checks for all columns in one pass."""
    if handle_invalid not in ("error", "keep"):
        raise ValueError(f"handle_invalid must be 'error' or 'keep', not {handle_invalid!r}")
    measures = []
    for name in columns:
        value = F.col(name).cast("double")
        odd = value.isNull() | F.isnan(value) | (value < 0) | (value != F.floor(value))
        measures.append(
            F.struct(
                F.max(F.when(~odd, value)).alias("top"), F.count_if(odd).alias("invalid")
            ).alias(name)
        )
    row = df.agg(*measures).first()
    sizes = []
    for name in columns:
        if handle_invalid == "error" and row[name]["invalid"]:
            raise ValueError(
                f"column {name} has {row[name]['invalid']} values that are not category indices "
                "(null, negative or fractional)"
            )
        top = row[name]["top"]
        if top is not None and top >= MOST_CATEGORIES:
            raise ValueError(f"column {name} holds category {top:.0f}; the largest index is {MOST_CATEGORIES - 1}")
        sizes.append(0 if top is None else int(top) + 1)
    return OneHotModel(tuple(columns), tuple(sizes), drop_last, handle_invalid)


def mllib_one_hot(
    columns: Sequence[str], drop_last: bool = False, suffix: str = "_vec", handle_invalid: str = "error"
) -> Pipeline:
    """The MLlib form: sparse ML vectors through a one-stage pipeline."""
    return Pipeline(
        stages=[
            OneHotEncoder(
                inputCols=list(columns),
                outputCols=[name + suffix for name in columns],
                dropLast=drop_last,
                handleInvalid=handle_invalid,
            )
        ]
    )

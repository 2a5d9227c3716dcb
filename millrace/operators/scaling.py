"""Standard scaling and z-scores.

All columns are fitted by one aggregate with partial sums per task, so the fit
moves one row per task. Two forms are offered:

* lazy: the statistics stay in the plan as a one-row scalar subquery, and the
  transform is a projection above the scan (no join, no shuffle of the table);
* fitted: ``fit_scaler`` returns the numbers, two per column, to reuse on other
  tables or on streams.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _moments(columns: Sequence[str]) -> list[Column]:
    # F.nanvl is not used: a NaN input makes the moments NaN, as it does in MLlib.
    return [
        F.struct(
            F.avg(F.col(name).cast("double")).alias("mean"),
            F.stddev_samp(F.col(name).cast("double")).alias("std"),
            F.count(F.col(name)).alias("rows"),
        ).alias(name)
        for name in columns
    ]


def column_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: for each column a struct ``(mean, std, rows)``, std being the sample std.

    No rows give null mean and std, one row gives null std.
    """
    return df.agg(*_moments(columns))


def moments_by_column(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The same statistics as rows ``(column, mean, std, rows)``."""
    entries = F.array(
        *[
            F.struct(F.lit(name).alias("column"), F.col(f"`{name}`.mean"), F.col(f"`{name}`.std"),
                     F.col(f"`{name}`.rows"))
            for name in columns
        ]
    )
    return column_moments(df, columns).select(F.inline(entries))


def standard_scaled(
    value: Column, mean: Column, std: Column, with_mean: bool, with_std: bool
) -> Column:
    """Standard scaling of one value: a zero spread scales to 0.0 when ``with_std``."""
    result = value.cast("double")
    if with_mean:
        result = result - mean
    if with_std:
        # One row has no sample spread; it scales like a constant column.
        spread = F.coalesce(std, F.lit(0.0))
        result = F.when(value.isNull(), None).when(spread == 0, F.lit(0.0)).otherwise(
            result / F.when(spread != 0, spread)
        )
    return result


def z_scored(value: Column, mean: Column, std: Column) -> Column:
    """``(value - mean) / std``; nulls stay null, and a zero spread divides as floats do."""
    centred = value.cast("double") - mean
    by_zero = (
        F.when(centred > 0, F.lit(float("inf")))
        .when(centred < 0, F.lit(float("-inf")))
        .when(centred.isNotNull(), F.lit(float("nan")))
    )
    return F.when(std == 0, by_zero).otherwise(centred / F.when(std != 0, std))


def _with_moments(df: DataFrame, columns: Sequence[str], fitted_on: DataFrame | None, scaled):
    """Replace ``columns`` by ``scaled(value, statistics)``.

    The statistics enter as one column of their own, so the plan holds a single
    subquery however often they are used.
    """
    source = fitted_on if fitted_on is not None else df
    moments = column_moments(source, columns).select(F.struct(*[F.col(f"`{n}`") for n in columns]))
    staged = df.withColumn("__moments", moments.scalar())
    stats = F.col("__moments")
    return staged.withColumns(
        {name: scaled(F.col(f"`{name}`"), stats[name]) for name in columns}
    ).drop("__moments")


def scale_columns(
    df: DataFrame,
    columns: Sequence[str],
    with_mean: bool = False,
    with_std: bool = True,
    fitted_on: DataFrame | None = None,
) -> DataFrame:
    """Scale columns in place by their own statistics (or those of ``fitted_on``), lazily."""
    if not (with_mean or with_std):
        return df.withColumns({name: F.col(name).cast("double") for name in columns})
    return _with_moments(
        df,
        columns,
        fitted_on,
        lambda value, stats: standard_scaled(value, stats["mean"], stats["std"], with_mean, with_std),
    )


def zscore_columns(
    df: DataFrame, columns: Sequence[str], fitted_on: DataFrame | None = None
) -> DataFrame:
    """Z-score columns in place from global statistics, lazily. Other columns pass through."""
    return _with_moments(
        df, columns, fitted_on, lambda value, stats: z_scored(value, stats["mean"], stats["std"])
    )


@dataclass(frozen=True)
class ScalerModel:
    """Fitted statistics; size grows with the number of columns only."""

    columns: tuple[str, ...]
    means: tuple[float | None, ...]
    stds: tuple[float | None, ...]
    rows: tuple[int, ...]

    def _numbers(self):
        for name, mean, std in zip(self.columns, self.means, self.stds):
            yield name, F.lit(mean).cast("double"), F.lit(std).cast("double")

    def transform(
        self, df: DataFrame, with_mean: bool = False, with_std: bool = True
    ) -> DataFrame:
        return df.withColumns(
            {
                name: standard_scaled(F.col(name), mean, std, with_mean, with_std)
                for name, mean, std in self._numbers()
            }
        )

    def zscore(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {name: z_scored(F.col(name), mean, std) for name, mean, std in self._numbers()}
        )


def fit_scaler(df: DataFrame, columns: Sequence[str]) -> ScalerModel:
    """Run the one-pass fit and bring back two numbers per column."""
    row = column_moments(df, columns).first()
    return ScalerModel(
        columns=tuple(columns),
        means=tuple(row[name]["mean"] for name in columns),
        stds=tuple(row[name]["std"] for name in columns),
        rows=tuple(row[name]["rows"] for name in columns),
    )


def scaler_state(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One pass: ``(column, rows, mean, m2)`` per column, to keep as a table and to merge.

    ``m2`` is the sum of squared distances from the mean. Nulls do not count as rows; a column
    without values has a null mean.
    """
    cells = []
    for name in columns:
        value = F.col(f"`{name}`").cast("double")
        rows = F.count(value)
        spread = F.when(rows > 0, F.var_pop(value) * rows)
        cells.append(F.struct(F.lit(name).alias("column"), rows.alias("rows"), F.avg(value).alias("mean"), spread.alias("m2")))
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def merge_states(states: DataFrame) -> DataFrame:
    """States of parts of a table, of several files or days, as the state of all of it.

    Two parts merge into (n, mean, m2) by their counts and the distance of their means; parts are
    taken in order of size, which gives the same digits whatever order they come in.
    """
    part = F.struct("rows", "mean", "m2")
    none = F.struct(F.lit(0).cast("bigint").alias("rows"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def both(a: Column, b: Column) -> Column:
        rows = a["rows"] + b["rows"]
        step = b["mean"] - a["mean"]
        share = b["rows"] / rows
        return F.struct(
            rows.alias("rows"),
            (a["mean"] + step * share).alias("mean"),
            (a["m2"] + b["m2"] + step * step * a["rows"] * share).alias("m2"),
        )

    merged = (
        states.groupBy("column")
        .agg(F.array_sort(F.collect_list(F.when(F.col("rows") > 0, part))).alias("parts"))  # a row per part
        .select("column", F.aggregate("parts", none, both).alias("s"))
    )
    filled = F.col("s.rows") > 0
    return merged.select("column", "s.rows", *[F.when(filled, F.col(f"s.{n}")).alias(n) for n in ("mean", "m2")])


def scaler_of_state(states: DataFrame, columns: Sequence[str]) -> ScalerModel:
    """The model of a merged state, as ``fit_scaler`` gives it; reads no row of the table itself."""
    found = {r["column"]: r for r in states.collect()}  # a row per column
    rows = [found[n]["rows"] for n in columns]
    return ScalerModel(
        columns=tuple(columns),
        means=tuple(found[n]["mean"] for n in columns),
        stds=tuple((found[n]["m2"] / (k - 1)) ** 0.5 if k > 1 else None for n, k in zip(columns, rows)),
        rows=tuple(rows),
    )


def slot_moments(df: DataFrame, array_column: str) -> DataFrame:
    """Statistics of every slot of an array column: ``(slot, mean, std, rows)``.

    Slots are exploded below a map-side aggregate, so a task sends one row per slot.
    """
    slots = df.select(F.posexplode(array_column).alias("slot", "value"))
    value = F.col("value").cast("double")
    return slots.groupBy("slot").agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("rows")
    )


def scale_array(
    df: DataFrame,
    array_column: str,
    with_mean: bool = False,
    with_std: bool = True,
    output: str | None = None,
) -> DataFrame:
    """Scale an array column slot by slot, lazily; arrays may differ in length.

    Slots take their statistics from the rows that have them. These enter as one-row
    scalar subquery whose size is the longest array's, whatever the number of rows;
    every array keeps its own length.
    """
    entry = F.struct("slot", "mean", "std")
    stats = (
        slot_moments(df, array_column)
        .agg(F.array_sort(F.collect_list(entry)).alias("slots"))
        .scalar()
    )

    def scaled_slot(value: Column, number: Column) -> Column:
        slot = F.get(F.col("__slots"), number)
        return standard_scaled(value, slot["mean"], slot["std"], with_mean, with_std)

    scaled = F.transform(array_column, scaled_slot)
    # A subquery may not stand inside a lambda, so it gets a column of its own first.
    return df.withColumn("__slots", stats).withColumn(output or array_column, scaled).drop("__slots")


def scaled_check(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and std of columns after scaling, one row per column."""
    return moments_by_column(df, columns)


def mllib_scaler(
    columns: Sequence[str],
    with_mean: bool = False,
    with_std: bool = True,
    features: str = "features",
    output: str = "scaledFeatures",
) -> Pipeline:
    """The MLlib form, for users who want ML vectors. Fill nulls first."""
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=list(columns), outputCol=features),
            StandardScaler(inputCol=features, outputCol=output, withMean=with_mean, withStd=with_std),
        ]
    )

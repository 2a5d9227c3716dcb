"""Tables that compare runs: speed-up, frameworks side by side, repeated runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.readings import ratio_or

_SALTS = 64


def mean_of_runs(
    runs: DataFrame, configuration: Sequence[str], seconds: str = "job_seconds"
) -> DataFrame:
    """Mean seconds and number of runs per configuration; runs without a time do not count."""
    return (
        runs.where(F.col(seconds).isNotNull())
        .groupBy(*configuration)
        .agg(F.avg(seconds).alias(seconds), F.count(F.lit(1)).alias("runs"))
    )


def speed_up(
    runs: DataFrame,
    series: Sequence[str] = ("framework", "dataset"),
    machines: str = "machines",
    seconds: str = "job_seconds",
) -> DataFrame:
    """Append ``speedup``: seconds on one machine over seconds on n, within each series.

    The one-machine rows are reduced to one per series, which is joined back in
    ``_SALTS`` copies to runs that are dealt over as many: a series of any length is
    spread over tasks by whatever join. Null where a series lacks one-machine runs.
    """
    single = (
        runs.where(F.col(machines) == 1)
        .groupBy(*series)
        .agg(F.avg(seconds).alias("__single"))
        .withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    )
    salt = F.pmod(F.xxhash64(*runs.columns), F.lit(_SALTS)).cast("int")
    nothing = F.lit(None).cast("double")
    return (
        runs.withColumn("__salt", salt)
        .join(single, [*series, "__salt"], "left")
        .withColumn("speedup", ratio_or(F.col("__single"), F.col(seconds), nothing))
        .drop("__single", "__salt")
    )


def side_by_side(
    figures: DataFrame,
    rows: Sequence[str],
    framework: str,
    frameworks: Sequence[str],
    measures: dict[str, str],
) -> DataFrame:
    """One row per ``rows`` value, one column ``<framework>_<measure>`` per pair.

    ``measures`` maps an output name to an aggregate, e.g. ``{"cpu_avg": "avg(cpu)"}``.
    The frameworks are named by the caller, so no job runs to discover them.
    """
    wide = (
        figures.groupBy(*rows)
        .pivot(framework, list(frameworks))
        .agg(*[F.expr(text).alias(name) for name, text in measures.items()])
    )
    if len(measures) > 1:
        return wide
    # With one measure pivot names the columns by framework alone.
    (name,) = measures
    return wide.withColumnsRenamed({f: f"{f}_{name}" for f in map(str, frameworks)})

"""Running a plan for its cost, and looking at a few rows of it."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Execution:
    rows: int
    seconds: float

    @property
    def rows_per_second(self) -> float:
        return self.rows / self.seconds if self.seconds > 0 else 0.0


def materialise(df: DataFrame, started: float | None = None) -> Execution:
    """Compute every column of every row and keep nothing; rows are counted on the way.

    ``count()`` would not do: the optimizer drops columns nobody asks for, and
    with them the transform to be timed. ``started`` (``time.monotonic()``) moves
    the start of the clock back, e.g. to before a fit.
    """
    begin = time.monotonic() if started is None else started
    counted = Observation()
    df.observe(counted, F.count(F.lit(1)).alias("rows")).write.format("noop").mode(
        "overwrite"
    ).save()
    return Execution(rows=counted.get["rows"], seconds=time.monotonic() - begin)


def sample_rows(df: DataFrame, rows: int = 5) -> DataFrame:
    """Any few rows, for a look; stops reading once it has them."""
    return df.limit(rows)

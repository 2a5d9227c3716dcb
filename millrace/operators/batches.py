"""Mapping a pandas function over fixed-size batches.

For functions that expressions cannot state; the operators of this package do
not need it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


def rebatched(frames: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """The same rows in frames of ``size``, the last one possibly shorter."""
    waiting: list[pd.DataFrame] = []
    held = 0
    for frame in frames:
        start = 0
        while len(frame) - start >= size - held:
            end = start + size - held
            waiting.append(frame.iloc[start:end])
            yield pd.concat(waiting, ignore_index=True)
            waiting, held, start = [], 0, end
        if start < len(frame):
            waiting.append(frame.iloc[start:])
            held += len(frame) - start
    if held:
        yield pd.concat(waiting, ignore_index=True)


def map_batches(
    df: DataFrame,
    function: Callable[[pd.DataFrame], pd.DataFrame],
    schema: str | StructType,
    batch_size: int = 4096,
) -> DataFrame:
    """Apply ``function`` to batches of ``batch_size`` rows of each partition."""
    if batch_size <= 0:
        raise ValueError("batch_size must be above zero")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in rebatched(frames, batch_size):
            yield function(frame)

    return df.mapInPandas(run, schema)

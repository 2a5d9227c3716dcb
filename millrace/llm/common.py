"""Shared pieces of the training-data operators: tables, checkpoints, splits, digests."""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import ship_package


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the folder; the workers get this package along with it."""
    ship_package(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared checkpoint folder, its lineage cut.

    The folder is the one the session names in ``spark.checkpoint.dir``; a local one is
    set only where none is named and the session is local, as in tests.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(folder)
    return df.checkpoint()


def remainder(key: Column, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % parts


def sha256_text(text: str) -> str:
    """Lowercase hex digest of a text in UTF-8."""
    return hashlib.sha256(text.encode()).hexdigest()


def portions(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts come to about ``limit`` bytes, or one text if it is longer."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    begin = filled = 0
    for i, n in enumerate(lengths):
        if filled and filled + n > limit:
            yield batch.slice(begin, i - begin)
            begin, filled = i, 0
        filled += n
    if begin < len(lengths):
        yield batch.slice(begin)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for ``mapInArrow``; after each batch Arrow gives back the memory it keeps for later ones.

    Python workers outlive their tasks, and what a worker keeps counts for its executor.
    """

    def release(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield batch
            del batch
            pa.default_memory_pool().release_unused()
        pa.default_memory_pool().release_unused()

    return release

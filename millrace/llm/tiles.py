"""Whole-number vectors in tiles, and blocks of searched vectors paired with shards of tiles by Spark.

Rows are packed into tiles where they are read, in the narrowest integers that hold them, and
written once. Searches are dealt into blocks by id, tiles into shards by the place they were packed
in, so that rows with one id spread; every block meets every shard in a group of bounded size.
The driver sees counts only, and a plan is the same for any number of blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import checkpointed

TILE_ROWS = 2048
TILE_BYTES = 4 << 20
BLOCK_BYTES = 16 << 20
SHARD_BYTES = 32 << 20
#: Rows of a block that are multiplied with a tile at once.
BLOCK_ROWS = 256

TILES = "size int, part int, number int, n int, ids binary, labels binary, kind string, vectors binary"
_KINDS = (*[pa.int32()] * 4, pa.binary(), pa.binary(), pa.string(), pa.binary())
_NAMES = [part.split()[0] for part in TILES.split(", ")]


@dataclass
class Tile:
    """Ids, labels and vectors (a row each) of equal length."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray


def whole_vectors(vectors: DataFrame, key: str, vector: str, scale: int, label: Column | None = None) -> DataFrame:
    """Columns id, label, v (array<long>, floor(scale * x)) of the rows that take part.

    Rows with a null id, vector or label, or with a null or non-finite component, do not.
    """
    value = F.col(vector).cast("array<double>")
    finite = F.forall(value, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))  # NaN is larger
    named = (F.lit(0) if label is None else label).cast("long")
    return vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & finite & named.isNotNull()).select(
        F.col(key).cast("long").alias("id"), named.alias("label"), F.transform(value, lambda x: F.floor(x * scale)).alias("v")
    )


def tiles_of(batch: pa.RecordBatch | pa.Table) -> Iterator[tuple[int, Tile, np.ndarray]]:
    """Rows with columns id, label, v by length of vector: length, tile, and the places of its rows."""
    if isinstance(batch, pa.Table):
        batch = batch.combine_chunks()
        arrays = [batch.column(n).chunk(0) if batch.num_rows else batch.column(n) for n in ("id", "label", "v")]
    else:
        arrays = [batch.column(n) for n in ("id", "label", "v")]
    if not len(arrays[0]):
        return
    ids, labels = arrays[0].to_numpy(), arrays[1].to_numpy()
    sizes, flat = arrays[2].value_lengths().to_numpy(), arrays[2].flatten().to_numpy()
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        yield size, Tile(ids[at], labels[at], flat[starts[at][:, None] + np.arange(size)].astype(np.int64)), at


def _narrow(values: np.ndarray) -> np.ndarray:
    low, high = int(values.min(initial=0)), int(values.max(initial=0))
    for kind in ("i1", "i2", "i4"):
        if np.iinfo(kind).min <= low and high <= np.iinfo(kind).max:
            return values.astype(kind)
    return values


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, number = TaskContext.get().partitionId(), 0
    held: dict[int, list[Tile]] = {}

    def packed(size: int) -> pa.RecordBatch:
        nonlocal number
        tiles = held.pop(size)
        ids, labels, vectors = (np.concatenate([getattr(t, n) for t in tiles]) for n in ("ids", "labels", "vectors"))
        vectors, number = _narrow(vectors), number + 1
        row = (size, part, number, len(ids), ids.tobytes(), labels.tobytes(), vectors.dtype.str, vectors.tobytes())
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _KINDS)], names=_NAMES)

    for batch in batches:
        for begin in range(0, batch.num_rows, TILE_ROWS):
            for size, tile, _ in tiles_of(batch.slice(begin, TILE_ROWS)):
                held.setdefault(size, []).append(tile)
                rows = sum(len(t.ids) for t in held[size])
                if rows >= TILE_ROWS or 8 * size * rows >= TILE_BYTES:
                    yield packed(size)
    for size in list(held):
        yield packed(size)


def written_tiles(rows: DataFrame) -> DataFrame:
    """Rows of ``TILES`` for rows with columns id, label, v: packed once, whatever reads them."""
    return checkpointed(rows.mapInArrow(_pack, TILES))


def read_tiles(rows: pa.Table) -> Iterator[Tile]:
    for row in rows.select(_NAMES).to_pylist():
        vectors = np.frombuffer(row["vectors"], row["kind"]).reshape(row["n"], row["size"]).astype(np.int64)
        yield Tile(np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64), vectors)


def searched(
    anchors: DataFrame,
    tiles: DataFrame,
    work: Callable[[pa.Table, pa.Table], pa.Table],
    schema: str,
    block_bytes: int = BLOCK_BYTES,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """``work`` over every block of ``anchors`` (id, label, v and more) with every shard of tiles of the same length.

    A group holds about ``block_bytes`` of anchors and ``shard_bytes`` of rows at most. There are as many shards as the
    session runs tasks, or more where these bytes ask for it.
    """
    asked = anchors.agg(F.sum(8 * (F.size("v") + 4))).first()[0] or 0
    stored, count = tiles.agg(F.sum(F.col("n").cast("long") * (8 * F.col("size") + 16)), F.count("*")).first()
    blocks = max(1, math.ceil(asked / block_bytes))
    spread = min(count, tiles.sparkSession.sparkContext.defaultParallelism)
    shards = max(1, math.ceil((stored or 0) / shard_bytes), spread)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = (
        anchors.withColumn("size", F.size("v"))
        .withColumn("block", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(blocks)).cast("int"))
        .withColumn("shard", each(shards))
    )
    right = tiles.withColumn("shard", F.pmod(F.xxhash64("part", "number"), F.lit(shards)).cast("int")).withColumn("block", each(blocks))
    keys = ("size", "block", "shard")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(work, schema)


class Best:
    """The k best rows of each of some searches: highest score first, ties to the smaller id; merges with others."""

    def __init__(self, k: int):
        self.k = k
        self.rows = self.scores = self.ids = np.empty(0, np.int64)

    def offer(self, first: int, scores: np.ndarray, ids: np.ndarray, valid: np.ndarray) -> None:
        """Scores of searches ``first``, first + 1 ... (rows) against a tile (columns)."""
        chosen = valid
        if scores.shape[1] > self.k:
            # every score that may be among the k best, ties of the k-th included
            low = np.where(valid, scores, np.iinfo(np.int64).min)
            chosen = valid & (scores >= np.partition(low, -self.k, axis=1)[:, -self.k][:, None])
        row, column = np.nonzero(chosen)
        self.merge(row + first, scores[row, column], ids[column])

    def merge(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(rows):
            return
        rows, scores, ids = (np.concatenate(p) for p in ((self.rows, rows), (self.scores, scores), (self.ids, ids)))
        order = np.lexsort((ids, ~scores, rows))  # ~s falls as s rises, without overflow
        rows = rows[order]
        begins = np.concatenate([[True], rows[1:] != rows[:-1]])
        rank = np.arange(len(rows)) - np.flatnonzero(begins)[np.cumsum(begins) - 1]
        kept = order[rank < self.k]
        self.rows, self.scores, self.ids = rows[rank < self.k], scores[kept], ids[kept]

"""Hard negatives: for an anchor and each of its best rows of its own label, the best rows of other labels that score a little less.

Vectors are whole numbers, floor(``scale`` * x). Anchors are dealt into blocks, all rows into
shards of tiles (``tiles``), and each block meets each shard twice: first for the heaps of
positives, which merge to the final positives of an anchor; then, with the windows of scores that
these open, for a heap per window. The heaps of a group come down to ``positives`` or
``negatives`` rows per search before they leave their task.

The products of a block with a tile are Strassen's: operands are padded with zeros to even sides,
halved, and seven products of sums take the place of eight, down to ``LEAF``. Sums and
differences are of 64-bit integers, exact as long as a score fits them; leaves are multiplied
as floats while these hold every partial sum exactly, as integers otherwise.

Defined cases: rows with a null id, label or vector, or a null or non-finite component take no
part. Only vectors of equal length are compared. Rows of an anchor's own id are neither its
positives nor its negatives; of several anchors with one id the least (label, vector) counts; a
row that is repeated counts as often as it occurs. A positive score of 0 opens the window of
score 0, a negative one opens none. An anchor without positives or without negatives in
a window has no rows there; an empty table gives none. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import checkpointed, table
from millrace.llm.tiles import BLOCK_BYTES, BLOCK_ROWS, SHARD_BYTES, Best, read_tiles, searched, tiles_of, whole_vectors, written_tiles

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
LOW_PERCENT = 80
HIGH_PERCENT = 100
LEAF = 32
EXACT = 1 << 53


def _leaf(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    bound = float(np.abs(left.astype(float)).max(initial=0)) * float(np.abs(right.astype(float)).max(initial=0))
    if bound * max(1, left.shape[1]) < EXACT:
        return (left.astype(np.float64) @ right.astype(np.float64)).astype(np.int64)
    return left @ right


def _even(matrix: np.ndarray) -> np.ndarray:
    rows, columns = matrix.shape
    return np.pad(matrix, ((0, rows % 2), (0, columns % 2))) if rows % 2 or columns % 2 else matrix


def strassen(left: np.ndarray, right: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """left @ right of int64 matrices, modulo 2^64."""
    if min(*left.shape, right.shape[1]) <= leaf:
        return _leaf(left, right)
    rows, columns = left.shape[0], right.shape[1]
    left, right = _even(left), _even(right)
    (a, b), (c, d) = (np.split(half, 2, axis=1) for half in np.split(left, 2))
    (e, f), (g, h) = (np.split(half, 2, axis=1) for half in np.split(right, 2))
    p1 = strassen(a + d, e + h, leaf)
    p2 = strassen(c + d, e, leaf)
    p3 = strassen(a, f - h, leaf)
    p4 = strassen(d, g - e, leaf)
    p5 = strassen(a + b, h, leaf)
    p6 = strassen(c - a, e + f, leaf)
    p7 = strassen(b - d, g + h, leaf)
    product = np.block([[p1 + p4 - p5 + p7, p3 + p5], [p2 + p4, p1 - p2 + p3 + p6]])
    return product[:rows, :columns]


def _percent_up(percent: int, scores: np.ndarray) -> np.ndarray:
    """ceil(percent * score / 100) without leaving 64 bits."""
    whole, rest = np.divmod(scores, 100)
    return percent * whole - (-percent * rest) // 100


def _percent_down(percent: int, scores: np.ndarray) -> np.ndarray:
    whole, rest = np.divmod(scores, 100)
    return percent * whole + percent * rest // 100


def _table(columns: list[np.ndarray], names: str) -> pa.Table:
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=[n.split()[0] for n in names.split(", ")])


FOUND = "anchor_id long, vec_id long, score long"
WINDOWED = "anchor_id long, positive_score long, vec_id long, score long"


def _positive_heaps(k: int):
    def search(anchors: pa.Table, tiles: pa.Table) -> pa.Table:
        best, ids = Best(k), np.empty(0, np.int64)
        for _, own, _ in tiles_of(anchors):
            ids = own.ids
            for tile in read_tiles(tiles):
                for begin in range(0, len(ids), BLOCK_ROWS):
                    part = slice(begin, begin + BLOCK_ROWS)
                    scores = strassen(own.vectors[part], tile.vectors.T)
                    valid = (own.labels[part][:, None] == tile.labels) & (ids[part][:, None] != tile.ids)
                    best.offer(begin, scores, tile.ids, valid)
        return _table([ids[best.rows], best.ids, best.scores], FOUND)

    return search


def _window_heaps(k: int, low: int, high: int):
    def search(anchors: pa.Table, tiles: pa.Table) -> pa.Table:
        results = []
        for _, own, at in tiles_of(anchors):
            opened = anchors.column("opened").combine_chunks().take(pa.array(at)).to_pylist()
            windows = max(map(len, opened))
            for number in range(windows):
                held = np.array([i for i, o in enumerate(opened) if len(o) > number])
                opening = np.array([opened[i][number] for i in held], np.int64)
                results.append((Best(k), held, opening, _percent_up(low, opening), _percent_down(high, opening)))
            for tile in read_tiles(tiles):
                for begin in range(0, len(own.ids), BLOCK_ROWS):
                    part = slice(begin, begin + BLOCK_ROWS)
                    scores = strassen(own.vectors[part], tile.vectors.T)
                    other = (own.labels[part][:, None] != tile.labels) & (own.ids[part][:, None] != tile.ids)
                    for best, held, _, least, most in results:
                        here = slice(*np.searchsorted(held, (begin, begin + BLOCK_ROWS)))
                        rows = held[here] - begin
                        if len(rows):
                            within = scores[rows]
                            valid = other[rows] & (within >= least[here, None]) & (within <= most[here, None])
                            best.offer(here.start, within, tile.ids, valid)
            anchor_ids = own.ids
        columns = [np.concatenate([np.empty(0, np.int64), *parts]) for parts in zip(
            *((anchor_ids[held[b.rows]], opening[b.rows], b.ids, b.scores) for b, held, opening, _, _ in results)
        )] or [np.empty(0, np.int64)] * 4
        return _table(columns, WINDOWED)

    return search


def _first(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine_hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str | Column = "label",
    scale: int = SCALE,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low_percent: int = LOW_PERCENT,
    high_percent: int = HIGH_PERCENT,
    block_bytes: int = BLOCK_BYTES,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Columns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A negative's score lies between ``low_percent`` and ``high_percent`` of the positive's.
    """
    named = F.col(label) if isinstance(label, str) else label
    tiles = written_tiles(whole_vectors(vectors, key, vector, scale, named))
    anchors = (
        whole_vectors(vectors.where(is_anchor), key, vector, scale, named)
        .groupBy("id")
        .agg(F.min(F.struct("label", "v")).alias("row"))
        .select("id", "row.label", "row.v")
    )
    limits = (block_bytes, shard_bytes)
    near = searched(anchors, tiles, _positive_heaps(positives), FOUND, *limits)
    best = checkpointed(_first(near, ["anchor_id"], positives).drop("rank"))
    opened = best.groupBy(F.col("anchor_id").alias("id")).agg(F.array_sort(F.collect_set("score")).alias("opened"))
    windows = searched(
        anchors.join(opened, "id"), tiles, _window_heaps(negatives, low_percent, high_percent), WINDOWED, *limits
    )
    mined = _first(windows, ["anchor_id", "positive_score"], negatives).select(
        "anchor_id", "positive_score", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")
    )
    found = best.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(mined, ["anchor_id", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every vector whose id is divisible by 100; every seventh row has the next label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


QUERIES = {"op11_hard_negatives": op11_hard_negatives}
ORACLE = {
    "op11_hard_negatives": f"""
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                          list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v
                   FROM embeddings
                   WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS same,
                          CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
                   FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id AND len(a.v) = len(c.v)),
             p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
                   QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES})
        SELECT anchor_id, positive_id, CAST(n AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
        FROM (SELECT p.*, s.vec_id, s.score,
                     row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS n
              FROM p JOIN s USING (anchor_id)
              WHERE NOT same AND {LOW_PERCENT} * positive_score <= 100 * score AND 100 * score <= {HIGH_PERCENT} * positive_score)
        WHERE n <= {NEGATIVES}"""
}

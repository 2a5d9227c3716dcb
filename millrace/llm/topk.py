"""Exact top-k search by inner product, in tiles.

Vectors are turned into whole numbers, floor(``scale`` * x). The queries are dealt into blocks,
all rows into shards of tiles (``tiles``), and each block meets each shard in a group of its
own: the block is multiplied with the shard tile by tile, the best k of a tile are taken by
partial selection and folded into the lists that the group carries. The lists of the groups
are merged in two levels, first in branches of shards, then per query. Neither queries nor rows
pass the driver.

Products are exact: 64-bit floats while every product stays below 2^50, integers (modulo 2^64)
beyond. Ties go to the smaller id.

Defined cases: rows with a null id, and vectors that are null or hold null or non-finite
components, take no part; an empty vector has score 0 with other empty ones. Only vectors of
equal length are compared. A query is not compared with rows of its own id; a row that is
repeated as a candidate is listed as often as it occurs, a query row that is repeated is
searched once. With no query or no candidate the result is empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import table
from millrace.llm.tiles import BLOCK_BYTES, BLOCK_ROWS, SHARD_BYTES, Best, read_tiles, searched, tiles_of, whole_vectors, written_tiles

BRANCHES = 16
EXACT = 1 << 50
LISTS = "query_id long, branch int, vec_id long, score long"


def _products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """left @ right.T as int64."""
    largest = float(np.abs(left.astype(float)).max(initial=0)) * float(np.abs(right.astype(float)).max(initial=0))
    if largest * max(1, left.shape[1]) < EXACT:
        return (left.astype(np.float64) @ right.astype(np.float64).T).astype(np.int64)
    return left @ right.T


def _searcher(k: int):
    def search(key: tuple, queries: pa.Table, tiles: pa.Table) -> pa.Table:
        best, ids = Best(k), np.empty(0, np.int64)
        for _, own, _ in tiles_of(queries):  # of one length
            ids = own.ids
            for tile in read_tiles(tiles):
                for begin in range(0, len(ids), BLOCK_ROWS):
                    part = slice(begin, begin + BLOCK_ROWS)
                    scores = _products(own.vectors[part], tile.vectors)
                    best.offer(begin, scores, tile.ids, ids[part][:, None] != tile.ids)
        branch = np.full(len(best.rows), key[2].as_py() % BRANCHES, np.int32)
        return pa.table([ids[best.rows], branch, best.ids, best.scores], names=[n.split()[0] for n in LISTS.split(", ")])

    return search


def _ranked(lists: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "vec_id")
    return lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", scale: int = 64,
    block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Columns query_id, rank, vec_id, score: for each query its k best rows among all others."""
    tiles = written_tiles(whole_vectors(vectors, key, vector, scale))
    queries = whole_vectors(vectors.where(is_query), key, vector, scale).distinct()
    lists = searched(queries, tiles, _searcher(k), LISTS, block_bytes, shard_bytes)
    branches = _ranked(lists, ["query_id", "branch"], k).drop("rank", "branch")
    return _ranked(branches, ["query_id"], k).select("query_id", "rank", "vec_id", "score")


def op3_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 best rows of every vector whose id is divisible by 20."""
    return top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, 20)


QUERIES = {"op3_topk": op3_topk}
ORACLE = {
    "op3_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                          CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
                   FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
             r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
        SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 20"""
}

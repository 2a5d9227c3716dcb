"""Connected components of a graph of links, by union-find in the tasks and hooking between them.

Each round the tasks, one per ``PER_FOREST`` links, merge the links they hold with a union-find
forest, so that every node points at one root there. Nodes with several roots, at most one per
task, then link these to the least of them, all others jump to the root of their root. Rounds
end when nothing moves; a chain of n nodes needs about log n of them. Links stay distributed
all the time and every round is cut off by a checkpoint.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import checkpointed

PER_FOREST = 200_000


class Forest:
    """Union-find over integers; the least member is the root."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, node: int) -> int:
        top = node
        while (above := self.parent.get(top, top)) != top:
            top = above
        while (above := self.parent.get(node, node)) != top:
            self.parent[node] = top
            node = above
        return top

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (node, root) of the forests over the links of a partition, each of bounded size."""

    def rows(forest: Forest) -> pa.RecordBatch:
        nodes = sorted(forest.parent)
        roots = [forest.root(n) for n in nodes]
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], ["node", "root"])

    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            forest.join(a, b)
        if len(forest.parent) >= PER_FOREST:
            yield rows(forest)
            forest = Forest()
    yield rows(forest)


def connected_components(links: DataFrame) -> DataFrame:
    """Columns node, root (the least node of its component) of all nodes that are not roots.

    ``links`` has two long columns; both ends of a link may be the same or come in any order.
    """
    edges = checkpointed(links.select(F.col(links.columns[0]).alias("node"), F.col(links.columns[1]).alias("root")))
    while True:
        tasks = max(1, math.ceil(edges.count() / PER_FOREST))
        merged = edges.coalesce(tasks).mapInArrow(_merge, "node long, root long").where("node <> root")
        low = merged.groupBy("node").agg(F.min("root").alias("low"), F.collect_set("root").alias("roots"))
        hooks = low.select(F.explode("roots").alias("node"), F.col("low").alias("root"), F.lit(True).alias("moved"))
        above = low.select(F.col("node").alias("low"), F.col("low").alias("higher"))
        jumps = low.join(above, "low", "left").select(
            "node", F.coalesce("higher", "low").alias("root"), F.col("higher").isNotNull().alias("moved")
        )
        found = jumps.unionByName(hooks.where("node <> root"))
        # as many files as forests, or one a core if those are fewer
        edges = checkpointed(found.coalesce(max(tasks, links.sparkSession.sparkContext.defaultParallelism)))
        moved = edges.agg(F.max("moved")).first()[0]
        edges = edges.drop("moved")
        if not moved:
            return edges

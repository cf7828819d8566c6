"""Connected components by alternating star operations, all on executors.

Large stars link every larger neighbour of a node with the node's smallest neighbour, small stars
every smaller one; the edges shrink towards one star a component in a logarithmic number of rounds.
Before a round is written, each task makes stars of the edges that it has, in pieces of bounded size:
what lies in one task needs no more rounds, each of which costs the driver two queries.
Smallest neighbours come from an aggregation that combines before its shuffle, and go back to the
edges by a sort-merge join, at every size, as a broadcast would pass them through the driver; adaptive
execution splits it where one node has very many.  Each round is written to the shared folder, so
lineage stays short and a lost executor costs one round at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored

#: Edges that a task makes stars of at once.
PIECE_EDGES = 500_000


def _stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the smallest one that these edges reach, itself excepted."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while (root[a] != root[b]).any():
        # a root that meets a smaller one goes below it; of those that meet, half are gone at least
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while (root[root] != root).any():
            root = root[root]
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def _stars_of_tasks(edges: DataFrame) -> DataFrame:
    """Edges that connect what these connect: stars of pieces of each task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, n = [], 0

        def out() -> pa.RecordBatch:
            u, v = _stars(*(np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in piece]) for i in (0, 1)))
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        for batch in batches:
            piece.append(batch)
            n += batch.num_rows
            if n >= PIECE_EDGES:
                yield out()
                piece, n = [], 0
        if n:
            yield out()

    return edges.mapInArrow(run, "u long, v long")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("least")).select(F.col("u").alias("w"), F.least("u", "least").alias("least"))
    larger = both.filter("v > u")
    return larger.join(least.hint("merge"), larger["u"] == least["w"]).select(F.col("v").alias("u"), F.col("least").alias("v")).filter("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("least")).withColumnRenamed("u", "w")
    moved = down.join(least.hint("merge"), down["u"] == least["w"]).filter("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return moved.union(least.select(F.col("w").alias("u"), F.col("least").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v) -> (node, component): the smallest node that links reach, for each node of an edge.

    Self links and repeated links have no effect; nulls are dropped; no edges, no rows.
    """
    edges = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).filter("u is not null and v is not null and u <> v")
    state = stored(_stars_of_tasks(_small_star(edges)), "edges")
    while not _are_stars(state):
        before, state = state, stored(_stars_of_tasks(_small_star(_large_star(state))), "stars")
        forget(before)
    roots = state.select(F.col("v").alias("node")).distinct()
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge to a smaller one, or only edges from larger ones."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up"))
    ends = ends.union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down + up > 1").isEmpty()

"""Connected components: contraction inside partitions, then rounds of joins and aggregates between them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from balanza.session import materialize

#: Edges that one task contracts; up to so many are done without a round.
EDGES_A_TASK = 200_000


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertex, root) of the vertices of edges (a, b) but the roots; a root is the least vertex of its component.

    Roots with a smaller neighbour are hooked to it and paths are halved until no edge is left
    between two components; each round at least joins every root to another one or keeps it as
    the least of its neighbours.
    """
    vertices, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = np.arange(len(vertices))
    u, v = ends[: len(a)], ends[len(a) :]
    while True:
        x, y = root[u], root[v]
        apart = x != y
        if not apart.any():
            break
        u, v = u[apart], v[apart]
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while not np.array_equal(up := root[root], root):
            root = up
    own = root != np.arange(len(root))
    return vertices[own], vertices[root[own]]


def contract(edges: DataFrame) -> DataFrame:
    """Each partition's edges (a, b) as stars: every vertex but the roots once, with its root in the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = np.zeros(0, np.int64), np.zeros(0, np.int64)
        full = EDGES_A_TASK
        for batch in batches:
            left = np.concatenate([left, batch.column(0).to_numpy()])
            right = np.concatenate([right, batch.column(1).to_numpy()])
            if len(left) >= full:
                left, right = contracted(left, right)
                full = 2 * len(left) + EDGES_A_TASK
        left, right = contracted(left, right)
        yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right)], names=["a", "b"])

    return edges.select("a", "b").mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(vertex, root) of every vertex of ``edges (a bigint, b bigint)``; root is its least reachable vertex.

    Each partition is contracted to stars first, so what is left has at most one edge a vertex
    and partition. While that is more than one task takes, rounds of large stars (a vertex hands
    its larger neighbours to its least one) and small stars (it hands its smaller ones to the
    least) follow, each contracted again, until nothing changes. Each round is written to the
    shared folder, so lineage stays short. Minima are pre-aggregated, and joins on a vertex with
    very many neighbours are ones whose partitions Spark can split. Loops, repeated edges and an
    empty table are fine.
    """
    spark = edges.sparkSession
    now = materialize(contract(edges), "edges")
    mark = _mark(now)
    while (parts := -(-mark[0] // EDGES_A_TASK)) > 1:
        large = _star(now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b"))), large=True)
        now = materialize(contract(_star(large, large=False)), "edges")
        last, mark = mark, _mark(now)
        if last == mark:
            break
    if parts == 1:
        now = materialize(contract(now.coalesce(1)), "edges")
    if not mark[0]:
        return spark.createDataFrame([], "vertex bigint, root bigint")
    roots = now.select(F.col("b").alias("vertex")).distinct()
    return now.select(F.col("a").alias("vertex"), F.col("b").alias("root")).unionByName(
        roots.withColumn("root", F.col("vertex"))
    )


def _distinct(edges: DataFrame) -> DataFrame:
    """Each edge once, from the larger to the smaller vertex."""
    return edges.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).distinct()


def _mark(edges: DataFrame) -> tuple[int, int | None]:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    return row[0], row[1]


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Of (a, b): a's least neighbour (or itself) takes over a's larger or smaller neighbours."""
    least = edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
    joined = edges.join(least, "a")
    moved = joined.where(F.col("b") > F.col("a")) if large else joined
    pairs = moved.select(F.col("b").alias("a"), F.col("least").alias("b"))
    if not large:
        pairs = pairs.unionByName(least.select("a", F.col("least").alias("b")))
    return _distinct(pairs)

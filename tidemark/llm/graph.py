"""Connected components of an edge table: local contraction, with alternating large-star and small-star steps above it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Edges that one task may hold (16 bytes each).
LOCAL_EDGES = 500_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one task replaced by stars: each node with the least node that these edges lead to."""
    got = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches if b.num_rows]
    if not got:
        return
    nodes, at = np.unique(np.concatenate(got, axis=1), return_inverse=True)
    u, v = at.reshape(2, -1)
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        while True:  # halve the paths
            up = new[new]
            if (up == new).all():
                break
            new = up
        if (new == root).all():
            break
        root = new
    keep = root != np.arange(len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(nodes[root[keep]])], names=["u", "v"])


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, most_rounds: int = 60, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """node, root (the least node that it reaches) of every node of the edges (u, v: long) that is not its own root.

    Tasks of about local_edges edges, which are dealt by ranges of (v, u), replace their edges by stars. What needs more
    than one such task goes on with star steps over the whole table, which only join and aggregate, so a hub of any degree
    is no harder than its edges; as soon as one task can hold the rest, it ends there.
    """
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "edges")
    state = _sum(now)
    if state[0] > local_edges:
        parts = -(-state[0] // local_edges)
        # by ranges of both ends, so that a hub's edges are shared out among tasks as all others are
        now = cut(now.repartitionByRange(parts, "v", "u").mapInArrow(_contract, "u long, v long").distinct(), "edges")
        state = _sum(now)
    for _ in range(most_rounds):
        if state[0] <= local_edges:
            now = cut(now.repartition(1).mapInArrow(_contract, "u long, v long"), "stars")
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        now = cut(small, "small-star")
        before, state = state, _sum(now)
        if before == state:
            break
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))

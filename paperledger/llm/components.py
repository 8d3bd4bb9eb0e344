"""Connected components of an edge table, by alternating large-star and small-star rounds.

Each half round finds the least neighbour of every node in a hash aggregation, whose map side merges a hub's edges
before they are sent, and joins it back to the edges; Spark splits the join's large partitions. Every round's edges
are written to the shared folder. Chains shorten to half in a round; stars end in one. As soon as no more than ``FEW``
edges are left, one task joins them: that many need some tens of megabytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch

FEW = 1 << 20


def least_reached(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges, and the least node that each reaches."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    of = np.arange(len(nodes))
    while len(a):
        low = np.minimum(of[a], of[b])
        np.minimum.at(of, of[a], low)
        np.minimum.at(of, of[b], low)
        while (up := of[of]).tobytes() != of.tobytes():
            of = up
        apart = of[a] != of[b]
        a, b = a[apart], b[apart]
    return nodes, nodes[of]


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if held:
        nodes, of = least_reached(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(of)], ["node", "component"])


def _large(edges: DataFrame) -> DataFrame:
    """Every neighbour that is larger than a node goes to the least of the node and its neighbours."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours go to the least of these. Edges point from the larger to the smaller."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node of an edge: the least node that it reaches. Loops are edges of one node."""
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now, last = scratch.table(pairs, "edges"), None
    while True:
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if seen.n <= FEW:
            done = now.coalesce(1).mapInArrow(_finish, "node long, component long")
            break
        if seen == last:
            done = now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
            break
        before, now, last = now, scratch.table(_small(_large(now)), "edges"), seen
        scratch.drop(before)
    return done

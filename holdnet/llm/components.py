"""Connected components of an edge table by star contraction; state is linear in the edges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdnet.llm.common import written


def local_roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) among the given edges, by hooking and pointer jumping."""
    nodes, idx = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = idx[:len(u)], idx[len(u):]
    parent = np.arange(len(nodes))
    while True:
        pa_, pb = parent[a], parent[b]
        apart = pa_ != pb
        if not apart.any():
            return nodes, nodes[parent]
        hi, lo = np.maximum(pa_[apart], pb[apart]), np.minimum(pa_[apart], pb[apart])
        np.minimum.at(parent, hi, lo)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def _contract(batches):
    """Replace a task's edges by (node, local root) stars, one Arrow batch group of bounded size at a time."""
    held, n = [], 0

    def out():
        u = np.concatenate([x[0] for x in held])
        v = np.concatenate([x[1] for x in held])
        nodes, roots = local_roots(u, v)
        far = nodes != roots
        return pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(roots[far])], names=["u", "v"])

    for b in batches:
        held.append((b.column("u").to_numpy(zero_copy_only=False), b.column("v").to_numpy(zero_copy_only=False)))
        n += b.num_rows
        if n >= 1_000_000:
            yield out()
            held, n = [], 0
    if held:
        yield out()


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``(node, root)`` for every node of ``edges(u, v)`` (longs) that is not the smallest of its component.

    Each round contracts every task's edges locally, then runs a large-star and a small-star step (each a minimum per
    node joined back to its edges; no neighbour list is ever gathered) and writes the remaining edges to the shared
    folder.  It ends when every edge points straight at its component's smallest node.  Repeated edges and self loops
    are harmless; an empty table gives an empty table.
    """
    e = written(edges.select("u", "v").filter("u <> v").distinct().mapInArrow(_contract, "u long, v long").distinct(),
                "edges")
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small_min = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (down.join(small_min, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("s"))
                 .select(F.col("s.v").alias("u"), F.col("s.m").alias("v")).filter("u <> v").distinct())
        e = written(small.mapInArrow(_contract, "u long, v long").distinct(), "edges")
        # done when no node has two parents and no parent has a parent
        twice = e.groupBy("u").count().filter("count > 1").limit(1).count()
        if twice == 0 and e.join(e.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).count() == 0:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")

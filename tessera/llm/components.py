"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.llm._common import discard, settled, spread_join


def _stars(edges: DataFrame, n_edges: int, both_ways: bool) -> DataFrame:
    """Half a round: every node's larger (large-star) or all smaller (small-star) neighbours move to its least neighbour.

    The settled table `edges` goes, the result is settled. Every plan reads tables alone: the driver plans, compiles and
    keeps about as much for a round as for one join, where a plan over a plan would repeat the inner one at each use.
    """
    sides = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if both_ways:
        sides = sides.union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = settled(sides.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n")))
    moved = spread_join(sides, least, "u", n_edges * (2 if both_ways else 1))
    if both_ways:
        out = moved.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    out = settled(out.where("a <> b").distinct())
    discard(least)
    discard(edges)
    return out


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge table (a, b); root is the least node of its component.

    Edges may repeat, point either way or join a node to itself; nodes without a real edge don't appear.
    Null ends are ignored. Every half of a round is written to the shared folder, so that nothing is computed
    again after a loss. No task holds a hub: its least neighbour is found by partial aggregation and, as there can be
    few hubs, broadcast to its edges.
    """
    now = settled(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    n_edges, mark = now.count(), None
    for _ in range(max_rounds if n_edges else 0):
        # no round has more edges than the one before
        now = _stars(_stars(now, n_edges, True), n_edges, False)
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        if mark == (seen.n, seen.h):
            break
        n_edges, mark = seen.n, (seen.n, seen.h)
    else:
        if n_edges:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def forest(n: int, batches) -> "list[int]":
    """Parents (roots) of 0..n-1 after joining the index pairs that `batches` yields as two arrays each."""
    import numpy as np

    parent = np.arange(n)
    for i, j in batches:
        while True:
            a, b = parent[i], parent[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = parent[parent]
                if (up == parent).all():
                    break
                parent = up
    return parent

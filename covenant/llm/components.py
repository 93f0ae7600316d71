"""Connected components of an edge table by alternating large-star and small-star.

Every step is a grouped minimum (partial aggregation) and a join on the node;
a node with very many neighbours is one skewed join key on the edge side,
which adaptive execution splits because the other side has one row for it.
Edges are written to the shared folder after each double step; only a count
and a checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covenant.llm.common import stored


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"),
                    F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row.n, int(row.s or 0)


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (both.where("v > u").join(low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct())


def small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def components(edges: DataFrame, max_steps: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v: bigint); component is
    the smallest node reachable. Null ends and self-loops add no link."""
    edges = stored(edges.select("u", "v").where("u != v").distinct(), "edges")
    state = _state(edges)
    for _ in range(max_steps):
        if state[0] == 0:
            break
        edges = stored(small_star(large_star(edges)), "edges")
        now = _state(edges)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not converge in {max_steps} steps")
    # at the fixed point every edge points from a node to the smallest of its component
    return (edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct())

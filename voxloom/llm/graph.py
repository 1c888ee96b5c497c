"""Connected components of narrow edge tables by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import settled


def components(edges: DataFrame) -> DataFrame:
    """node, root of all nodes of edges(u, v); the root is the least node of the
    component. Each round hangs a node's larger neighbours on its least one, then
    its smaller ones; stars are joins and minima, so a hub's edges are never one
    group, and each round's edges are checkpointed. Self-loops say nothing."""
    now = settled(_ordered(edges))
    state = _state(now)
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("_m"))
        large = _ordered(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("_m").alias("v")))
        hubs = large.groupBy("u").agg(F.min("v").alias("_m"))
        small = large.join(hubs, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("_m").alias("v")), F.struct("u", F.col("_m").alias("v")))).alias("e")).select("e.u", "e.v")
        after = settled(_ordered(small))
        reached = _state(after)
        if reached == state:
            return after.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(after.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        now, state = after, reached


def _ordered(edges: DataFrame) -> DataFrame:
    """Distinct edges with u > v."""
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())

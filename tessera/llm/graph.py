"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import stored


def components(edges: DataFrame, u: str = "u", v: str = "v", rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges``; ``component`` is its smallest reachable node.

    Each round hangs the larger neighbours of every node under its smallest neighbour (large star), then the node and
    its smaller neighbours under the smallest of these (small star). The number of edges doesn't grow, a hub's minimum
    is pre-aggregated, and joins on a hub are split by Spark. Rounds grow with the logarithm of the longest chain; each
    is stored in the shared folder. Loops, repeated edges and nulls on either side are left out. A round has five
    exchanges and another tells whether it was the last one, as every task that is sent out takes driver's memory.
    """
    now = stored(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where(F.col(u).isNotNull() & F.col(v).isNotNull() & (F.col("u") != F.col("v"))).distinct(), "edges")
    for _ in range(rounds):
        if _is_star_forest(now):
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        # edges lead from the larger end to the smaller, so a node's least neighbour, if less than itself, is one of its v
        least = now.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        large = now.join(least, F.col("v") == F.col("w"), "left").select("u", F.coalesce("m", "v").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
        now = stored(large.join(least, "u").select(hung.alias("e")).select("e.u", "e.v").where("u != v").distinct(), "edges")
    raise RuntimeError(f"no fixed point after {rounds} rounds")


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether every larger end hangs under one smaller end that itself hangs under none; so it is without edges."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e"))
    nodes = ends.groupBy("e.node").agg(F.sum("e.up").alias("up"), F.max("e.down").alias("down"))
    return not nodes.agg(F.max((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).alias("tangled")).first()["tangled"]

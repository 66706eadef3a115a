"""Connected components over an edge list, without GraphFrames and without driver state.

Alternating star contraction: each round first links every larger neighbour of a node to
the smallest node it knows, then does the same among smaller neighbours. The edge set ends
as one star per component, centred on the smallest node. Only a row count and a checksum
reach the driver. Every round is checkpointed, so a lost executor repeats one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import cut


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """One half round. ``edges`` has columns u > v, no duplicates."""
    if small:
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        linked = edges.join(low, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
    else:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        linked = both.join(low, "u").where("v > u").select(F.struct(F.col("v").alias("u"), "m").alias("e"))
    return linked.select(F.col("e.u").alias("u"), F.col("e.m").alias("v")).where("u > v").distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Rows (node, component): every node of an edge with the smallest node it reaches.

    Edges are undirected; self-loops name a node without linking it; edges with a null end
    are ignored. An empty edge list gives an empty result. Node ids may be of any ordered
    type. ``max_rounds`` only guards against a defect: passing it raises, never truncates.
    """
    raw = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    current = cut(raw.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    loops = raw.where("a = b").select(F.col("a").alias("node"))
    seen = None
    for _ in range(max_rounds):
        state = current.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state["n"] == 0 or (state["n"], state["h"]) == seen:
            break
        seen = (state["n"], state["h"])
        current = cut(_stars(_stars(current, small=False), small=True))
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = current.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    alone = loops.distinct().join(stars.select("node").unionByName(roots.select("node")), "node", "left_anti")
    return stars.unionByName(roots).unionByName(alone.select("node", F.col("node").alias("component")))

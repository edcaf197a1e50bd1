"""Connected components of an edge table by alternating star contraction (Kiveris et al., SoCC 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _settled(e: DataFrame) -> bool:
    """Whether every component of `e (u, v)`, u > v, is a star around its smallest node: no node has two nodes below it, or nodes on both sides."""
    one, none = F.lit(1), F.lit(0)
    ends = e.select(F.col("u").alias("x"), one.alias("below"), none.alias("above")).unionByName(e.select(F.col("v").alias("x"), none.alias("below"), one.alias("above")))
    return ends.groupBy("x").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where("below > 1 or (below = 1 and above = 1)").isEmpty()


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """`(node, root)` for every node of `edges (a, b)`; root is the smallest node of its component.

    A round needs one minimum per node (combined before the shuffle) and one join on the node, twice; a node of
    very many edges is split by the skew join. Neighbour lists are never gathered. Rounds grow with the
    logarithm of the longest path; edges that are stars already need none. Loops are ignored and an empty table gives
    an empty one.
    """
    kind = edges.schema["a"].dataType.simpleString()
    e = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(max_rounds):
        if _settled(e):
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: neighbours above a node move to the least of its neighbourhood; one row for each edge at most
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: neighbours below a node, and itself, move to the least of those
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        moved = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        kept = low.select("u", F.col("m").alias("v"))
        e = checkpointed(moved.unionByName(kept).distinct())
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots).distinct().select(F.col("node").cast(kind), F.col("root").cast(kind))

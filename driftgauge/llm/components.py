"""Connected components of links, by alternating star contraction; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import checkpointed, matched


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node that each linked node reaches. ``links`` may repeat and point either way; nodes are longs.

    A node may have any number of links: least neighbours are aggregated before they are shuffled, and the links of a hot
    node stay where they are (``matched``). Defined results: null ends and loops are no links; without links the result is empty.
    """
    edges, before = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"u <> v AND {a} IS NOT NULL AND {b} IS NOT NULL").distinct(), None
    edges = checkpointed(edges)  # what makes the links is worked out once
    total = edges.count()
    while total:
        # large star: the greater neighbours of each node get its least neighbour
        both = edges.union(edges.select("v", "u"))
        least = checkpointed(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c")).select("u", F.least("u", "m").alias("m"), "c"))
        edges = checkpointed(matched(both, least, ["u"], 2 * total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        # small star: the lesser neighbours of each node get the least of them, and so does the node
        least = checkpointed(edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c")))
        lesser = matched(edges, least, ["u"], total).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = checkpointed(lesser.union(least.select("u", "m")).distinct())
        # done once no node has two lesser neighbours or is one and has one
        total, digest = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        if (total, digest) == before or _are_stars(edges):
            break
        before = total, digest
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(nodes.select("component", "component").distinct())


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node is either the least of its component or has one edge, to it."""
    ends = edges.select("u", F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("u").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 OR down = 1 AND up = 1").isEmpty()

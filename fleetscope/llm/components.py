"""Connected components of an edge table, by alternating star contractions in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.common import LEAST_FILES, ROWS_PER_FILE, checkpointed, shards


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for each node with an edge; ``root`` is the least node of its component.

    Large-star ties every larger neighbour of a node to the least of its
    neighbourhood, small-star does so with the smaller ones; both keep
    components whole, and the edges end as one star a component. The minima are
    written before they are joined, so that the join of a hub's edges can be split.
    """
    edges = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u <> v").distinct()
    edges = checkpointed(edges)
    n, seen = edges.count(), None
    if not n:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    edges = edges.coalesce(shards(n, ROWS_PER_FILE, LEAST_FILES))
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = checkpointed(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), 2 * n)
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = checkpointed(large, n)
        least = checkpointed(large.groupBy("u").agg(F.min("v").alias("m")), n)
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges = checkpointed(small.select("e.u", "e.v").where("u <> v").distinct(), n)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

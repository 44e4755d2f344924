"""Walks along one step a node: where each ends, by doubling the steps in every round."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.sources.checkpoints import checkpointed


def follow(steps: DataFrame, by: Sequence[str] = ("host_id",), node: str = "id", to: str = "to") -> DataFrame:
    """``by…, id, end, steps, entry, cycle``: where each node's walk ends, and after how many steps.

    ``steps`` has one row for each node that has a step. A walk ends at the first node
    without one. A round doubles how far everybody sees, so their number is the logarithm
    of the longest walk, whatever its length; only those that haven't arrived are moved
    and written. Once a round lets nobody arrive, the rest comes to cycles: then ``end`` and
    ``steps`` are null, ``entry`` is the cycle's first node on the walk (for members themselves), ``cycle`` its least one.
    """
    keys = [*by, node]
    kind = steps.schema[node].dataType
    own = checkpointed(steps.select(*keys, F.col(to).cast(kind).alias("_at"), F.lit(1).cast("long").alias("_n"), F.col(node).alias("_low")))
    left, arrived = _arriving(own, own.select(*keys), by, node)
    done, waiting, reach = [arrived], left.count(), 1
    while waiting:
        left, arrived = _doubled(left, [*done, left], by, node)
        done.append(arrived)
        before, waiting, reach = waiting, left.count(), 2 * reach
        if waiting == before:
            break
    nothing = F.lit(None).cast(kind)
    out = reduce(DataFrame.unionByName, done).select(*keys, F.col("_at").alias("end"), F.col("_n").alias("steps"), nothing.alias("entry"), nothing.alias("cycle"))
    if not waiting:
        return out
    while reach < waiting:
        left, _ = _doubled(left, [left], by, node)
        reach *= 2
    # Who has walked on for long enough stands on a cycle, and all of the cycle's nodes have somebody on them.
    members = checkpointed(left.select(*by, F.col("_at").alias(node)).distinct().join(left.select(*keys, "_low"), keys))
    tails = steps.join(left.select(*keys), keys, "left_semi").join(members, keys, "left_anti")
    ring = members.select(*keys, F.col(node).alias("entry"), F.col("_low").alias("cycle"))
    if not tails.isEmpty():
        met = follow(tails.select(*keys, to), by, node, to).select(*keys, F.col("end").alias("entry"))
        ring = ring.unionByName(met.join(members.select(*by, F.col(node).alias("entry"), F.col("_low").alias("cycle")), [*by, "entry"]).select(*ring.columns))
    return out.unionByName(ring.select(*keys, nothing.alias("end"), F.lit(None).cast("long").alias("steps"), "entry", "cycle"))


def _arriving(rows: DataFrame, onward: DataFrame, by: Sequence[str], node: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` that stand on a node with a step, and those that don't."""
    there = onward.select(*by, F.col(node).alias("_at"), F.lit(True).alias("_goes_on"))
    rows = checkpointed(rows.join(there, [*by, "_at"], "left").select(*by, node, "_at", "_n", "_low", F.coalesce("_goes_on", F.lit(False)).alias("_goes_on")))
    return rows.where("_goes_on"), rows.where("NOT _goes_on")


def _doubled(left: DataFrame, known: list[DataFrame], by: Sequence[str], node: str) -> tuple[DataFrame, DataFrame]:
    """Everybody of ``left`` goes as far again as whoever it stands on."""
    ahead = reduce(DataFrame.unionByName, known).select(*by, F.col(node).alias("_at"), F.col("_at").alias("_then"), F.col("_n").alias("_more"), F.col("_low").alias("_low2"), F.col("_goes_on").alias("_on"))
    moved = left.drop("_goes_on").join(ahead, [*by, "_at"])
    moved = checkpointed(moved.select(*by, node, F.col("_then").alias("_at"), (F.col("_n") + F.col("_more")).alias("_n"), F.least("_low", "_low2").alias("_low"), F.col("_on").alias("_goes_on")))
    return moved.where("_goes_on"), moved.where("NOT _goes_on")


def parents(edges: DataFrame, by: Sequence[str] = ("host_id",), child: str = "child", parent: str = "parent", node: str = "id", to: str = "to") -> DataFrame:
    """One parent a node, the least; nobody is their own."""
    return edges.where(F.col(child) != F.col(parent)).groupBy(*by, F.col(child).alias(node)).agg(F.min(parent).alias(to))

"""Trees and dependency graphs: ancestors, descendants, forests, roll-ups, nearest owners."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetscope.operators.pointers import follow, parents
from fleetscope.sources.checkpoints import checkpointed


def ancestors(edges: DataFrame, max_hops: int = 12, by: Sequence[str] = ("host_id",), child: str = "child", parent: str = "parent") -> DataFrame:
    """``by…, id, ancestor, depth``: every ancestor up to ``max_hops``; a node that is met again ends the walk.

    A join a level with the parents, as deep as the forest is; the distances that have
    been walked are kept as the path, so cycles end. Each level is written.
    """
    up = edges.where(F.col(child) != F.col(parent)).groupBy(*by, F.col(child).alias("_c")).agg(F.min(parent).alias("_p"))
    level = edges.where(F.col(child) != F.col(parent)).groupBy(*by, F.col(child).alias("id")).agg(F.min(parent).alias("ancestor"))
    level = checkpointed(level.withColumn("path", F.array("id", "ancestor")))
    up = checkpointed(up)
    out = level.select(*by, "id", "ancestor", F.lit(1).alias("depth"))
    for depth in range(2, max_hops + 1):
        step = level.join(up.withColumnRenamed("_c", "ancestor"), [*by, "ancestor"]).where(~F.array_contains("path", F.col("_p")))
        level = checkpointed(step.select(*by, "id", F.col("_p").alias("ancestor"), F.concat("path", F.array("_p")).alias("path")))
        if level.isEmpty():
            break
        out = out.unionByName(level.select(*by, "id", "ancestor", F.lit(depth).alias("depth")))
    return out


def ancestry_chain(nodes: DataFrame, closure: DataFrame, names: DataFrame, by: Sequence[str] = ("host_id",), shown: int = 6) -> DataFrame:
    """``launched_by`` (``a ← b``, the nearest ``shown``) and ``depth`` of each node; ``names`` has ``id, name``."""
    named = closure.join(names.select(*by, F.col("id").alias("ancestor"), "name"), [*by, "ancestor"])
    chain = named.groupBy(*by, "id").agg(F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("depth", "name"))), 1, shown), lambda x: x["name"]), " ← ").alias("launched_by"), F.max("depth").alias("depth"))
    return nodes.join(chain, [*by, "id"], "left").fillna("", ["launched_by"]).fillna(0, ["depth"])


def descendants(edges: DataFrame, depth: int = 2, fanout: int = 12, by: Sequence[str] = ("host_id",), child: str = "child", parent: str = "parent") -> DataFrame:
    """``by…, id, descendant, depth``: to ``depth`` levels, the first ``fanout`` children of each node by id."""
    rank = F.row_number().over(Window.partitionBy(*by, parent).orderBy(child))
    first = edges.where(F.col(child) != F.col(parent)).withColumn("_r", rank).where(F.col("_r") <= fanout).select(*by, F.col(parent).alias("_p"), F.col(child).alias("_c"))
    level = first.select(*by, F.col("_p").alias("id"), F.col("_c").alias("descendant"))
    out = level.withColumn("depth", F.lit(1))
    for d in range(2, depth + 1):
        level = level.join(first.withColumnRenamed("_p", "descendant"), [*by, "descendant"]).where("id <> _c").select(*by, "id", F.col("_c").alias("descendant"))
        out = out.unionByName(level.withColumn("depth", F.lit(d)))
    return out


def forest(nodes: DataFrame, sort: Column, by: Sequence[str] = ("host_id",), node: str = "pid", parent: str = "ppid") -> DataFrame:
    """``depth`` and ``path`` of each node from its root; ordering by ``path`` is a depth-first walk, siblings by ``sort``.

    A node is a root if its parent is absent or itself; those on a cycle, or below one, are never reached and come as roots
    too. Levels are walked until one is empty.
    """
    text = F.col(node).cast("string")
    padded = F.when(F.length(text) < 12, F.lpad(text, 12, "0")).otherwise(text)
    own = nodes.select("*", F.concat(sort, F.lit(" "), padded).alias("_key"))
    present = nodes.select(*by, F.col(node).alias(parent)).distinct()
    orphan = own.join(present, [*by, parent], "left_anti").unionByName(own.where(F.col(node) == F.col(parent)))
    level = checkpointed(orphan.select(*by, F.col(node).alias("_id"), F.array("_key").alias("path"), F.lit(0).alias("depth")))
    keyed = checkpointed(own.where(F.col(node) != F.col(parent)).select(*by, F.col(parent).alias("_up"), F.col(node).alias("_id"), "_key"))
    seen = level
    for depth in count(1):
        step = keyed.join(level.select(*by, F.col("_id").alias("_up"), "path"), [*by, "_up"])
        level = checkpointed(step.select(*by, "_id", F.concat("path", F.array("_key")).alias("path"), F.lit(depth).alias("depth")))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    out = nodes.join(seen.withColumnRenamed("_id", node), [*by, node], "left")
    alone = F.array(F.concat(sort, F.lit(" "), padded))
    return out.withColumn("depth", F.coalesce("depth", F.lit(0))).withColumn("path", F.array_join(F.coalesce("path", alone), "/"))


def subtree_sum(metrics: DataFrame, edges: DataFrame, sums: Sequence[str], by: Sequence[str] = ("host_id",), node: str = "id", child: str = "child", parent: str = "parent") -> DataFrame:
    """``by…, id, n`` and the sums over each node's subtree, itself included. A member of a cycle sums all that leads to the cycle.

    No closure is written: a node knows the sum of its descendants nearer than 2^k and its ancestor 2^k steps up; a round adds the
    sums to those ancestors and doubles the step, so rounds are the logarithm of the depth, and each moves every node once.
    """
    up = parents(edges, by, child, parent, node, "_up")
    own = metrics.select(*by, node, F.lit(1).cast("long").alias("n"), *sums).groupBy(*by, node).agg(*(F.sum(c).alias(c) for c in ("n", *sums)))
    placed = up.join(own.select(*by, F.col(node).alias("_up")), [*by, "_up"], "left_semi")
    rows = checkpointed(own.join(placed, [*by, node], "left"))
    climbing = rows.where("_up IS NOT NULL").count()
    add = [F.sum(c).alias(c) for c in ("n", *sums)]
    while climbing:
        given = rows.where("_up IS NOT NULL").select(*by, F.col("_up").alias(node), "n", *sums)
        total = rows.select(*by, node, "n", *sums).unionByName(given).groupBy(*by, node).agg(*add)
        far = rows.select(*by, F.col(node).alias("_up"), F.col("_up").alias("_further"))
        onward = rows.where("_up IS NOT NULL").select(*by, node, "_up").join(far, [*by, "_up"]).select(*by, node, F.col("_further").alias("_up"))
        rows = checkpointed(total.join(onward, [*by, node], "left"))
        before, climbing = climbing, rows.where("_up IS NOT NULL").count()
        if climbing == before:
            break
    done = rows.where("_up IS NULL").select(*by, node, "n", *sums)
    if not climbing:
        return done
    # Who still climbs leads to a cycle: its members are roots of what hangs on them, and each has the sum of all members.
    left = checkpointed(rows.where("_up IS NOT NULL").select(*by, node))
    walks = checkpointed(follow(placed.join(left, [*by, node], "left_semi"), by, node, "_up"))
    members = walks.where(F.col("entry") == F.col(node)).select(*by, node, "cycle")
    hanging = placed.join(left, [*by, node], "left_semi").join(members, [*by, node], "left_anti").select(*by, F.col(node).alias(child), F.col("_up").alias(parent))
    trees = subtree_sum(metrics.join(left, [*by, node], "left_semi"), hanging, sums, by, node, child, parent)
    rings = trees.join(members, [*by, node]).groupBy(*by, "cycle").agg(*add)
    rings = members.join(rings, [*by, "cycle"]).select(*done.columns)
    return done.unionByName(trees.join(members, [*by, node], "left_anti").select(*done.columns)).unionByName(rings)


def top_with_ancestors(nodes: DataFrame, closure: DataFrame, metric: str, n: int = 18, node: str = "id", by: Sequence[str] = ("host_id",)) -> DataFrame:
    """The ``n`` nodes with the largest metric and all their ancestors: ``by…, id, top, depth`` (how many ancestors each has)."""
    top = nodes.orderBy(F.desc(metric), node).limit(n).select(*by, node)
    kept = top.withColumn("top", F.lit(1)).unionByName(top.join(closure, [*by, node]).select(*by, F.col("ancestor").alias(node), F.lit(0).alias("top")))
    depth = closure.groupBy(*by, node).agg(F.max("depth").alias("depth"))
    return kept.groupBy(*by, node).agg(F.max("top").alias("top")).join(depth, [*by, node], "left").fillna(0, ["depth"])


def nearest_ancestor(nodes: DataFrame, edges: DataFrame, qualifies: Column, value: str, by: Sequence[str] = ("host_id",), node: str = "id", child: str = "child", parent: str = "parent") -> DataFrame:
    """``value`` of each node that doesn't qualify itself, from its nearest ancestor that does; ``from_depth`` is 0 for its own, null for none.

    Walks end at nodes that qualify, so what is written is one row a node, not one an ancestor.
    """
    good = nodes.where(qualifies).select(*by, F.col(node).alias("end"), F.col(value).alias("_v"))
    steps = parents(edges, by, child, parent, node, "_up").join(good.select(*by, F.col("end").alias(node)), [*by, node], "left_anti")
    best = follow(steps, by, node, "_up").join(good, [*by, "end"]).select(*by, node, "steps", "_v")
    mine = F.coalesce(qualifies, F.lit(False))
    out = nodes.join(best, [*by, node], "left")
    return out.withColumn("from_depth", F.when(mine, 0).otherwise(F.col("steps"))).withColumn(value, F.when(mine, F.col(value)).otherwise(F.coalesce("_v", F.lit("")))).drop("steps", "_v")


def nearest_owner(requires: DataFrame, programs: DataFrame, max_levels: int = 64, by: Sequence[str] = ("host_id",), child: str = "child", parent: str = "parent", node: str = "id") -> DataFrame:
    """``by…, id, owner, dist``: the nearest program that needs a node, over any number of steps; at equal distance the first by name.

    ``requires`` leads from who needs (``child``) to what is needed (``parent``). Every step is one long, so a node is settled when it
    is first reached: a level moves its new nodes only and writes them once; nothing known before is written again. The edges of
    a node that needs a third of all are split by adaptive joins; what many nodes offer to one is reduced in each task first.
    """
    edges = checkpointed(requires.select(*by, F.col(child).alias(node), F.col(parent).alias("_to")).distinct())
    frontier = checkpointed(programs.select(*by, node, F.col(node).alias("owner")).distinct())
    settled = [frontier.withColumn("dist", F.lit(0))]
    for level in range(1, max_levels + 1):
        offers = frontier.join(edges, [*by, node]).groupBy(*by, F.col("_to").alias(node)).agg(F.min("owner").alias("owner"))
        known = reduce(DataFrame.unionByName, (x.select(*by, node) for x in settled))
        frontier = checkpointed(offers.join(known, [*by, node], "left_anti"))
        if frontier.isEmpty():
            break
        settled.append(frontier.withColumn("dist", F.lit(level)))
    return reduce(DataFrame.unionByName, settled).select(*by, node, "owner", "dist")


def component_names(rollup: DataFrame, by: Sequence[str] = ("host_id",), node: str = "id", names: int = 12) -> DataFrame:
    """``by…, owner, components, component_names``: what a program draws in, itself left out."""
    own = rollup.where(F.col("owner") != F.col(node))
    rank = F.row_number().over(Window.partitionBy(*by, "owner").orderBy(node))
    return own.withColumn("_r", rank).groupBy(*by, "owner").agg(F.count(F.lit(1)).alias("components"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("_r") <= names, F.col(node).cast("string")))), ", ").alias("component_names"))

"""Walks of any depth, cycles, and keys with most of the rows, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from fleetscope.operators import hierarchy, pointers, timeline


def walk(parent: dict, start):
    seen, at = [], start
    while at not in seen:
        seen.append(at)
        if at not in parent:
            return ("end", at, len(seen) - 1)
        at = parent[at]
    ring = seen[seen.index(at) :]
    return ("ring", at, min(ring))


def forest(rng, n=400):
    parent = {}
    for k in range(n):
        kind = rng.random()
        parent[k] = k - 1 if kind < 0.8 and k % 100 else rng.randrange(n) if kind < 0.95 else None
    return {k: p for k, p in parent.items() if p is not None and p != k}


@pytest.mark.parametrize("seed", [1, 2])
def test_follow_equals_a_loop(spark, seed):
    parent = forest(random.Random(seed))
    rows = spark.createDataFrame([("h", k, p) for k, p in parent.items()] + [("other", 1, 0)], "host_id string, id long, to long")
    got = {(r.host_id, r.id): r for r in pointers.follow(rows).collect()}
    assert len(got) == len(parent) + 1 and got["other", 1].end == 0
    for k in parent:
        kind, a, b = walk(parent, k)
        r = got["h", k]
        assert (r.end, r.steps, r.entry, r.cycle) == ((a, b, None, None) if kind == "end" else (None, None, a, b))


def test_a_chain_of_ten_thousand_in_few_rounds(spark, monkeypatch):
    written, real = [], pointers.checkpointed
    monkeypatch.setattr(pointers, "checkpointed", lambda df: written.append(1) or real(df))
    rows = spark.range(1, 10_000).select(F.lit("h").alias("host_id"), "id", (F.col("id") - 1).alias("to"))
    found = pointers.follow(rows)
    assert found.where("end = 0 AND steps = id").count() == 9_999 and len(written) < 20


def reference_root(parent, shells, pid):
    seen, cur = set(), pid
    while True:
        seen.add(cur)
        up = parent.get(cur)
        if up is None or up in seen or up in shells or up not in parent:
            return cur
        cur = up


@pytest.mark.parametrize("seed", [3, 4])
def test_chain_roots_with_shells_and_cycles(spark, seed):
    rng = random.Random(seed)
    parent = forest(rng)
    shells = {k for k in range(400) if rng.random() < 0.02}
    edges = spark.createDataFrame([("h", k, p) for k, p in parent.items()], "host_id string, child long, parent long")
    names = spark.createDataFrame([("h", k, "/usr/bin/fish" if k in shells else "x") for k in range(400)], "host_id string, id long, name string")
    got = {r.id: r.root for r in timeline.chain_roots(edges, names).collect()}
    assert got == {k: reference_root(parent, shells, k) for k in parent}


@pytest.mark.parametrize("seed", [5, 6])
def test_subtree_sums_and_nearest_ancestors(spark, seed):
    rng = random.Random(seed)
    parent = forest(rng, 200)
    edges = spark.createDataFrame([("h", k, p) for k, p in parent.items()], "host_id string, child long, parent long")
    weight = {k: rng.randrange(100) for k in range(200)}
    named = {k: f"p{k}" if rng.random() < 0.1 else "" for k in range(200)}
    nodes = spark.createDataFrame([("h", k, weight[k], named[k]) for k in range(200)], "host_id string, id long, v long, pkg string")
    n, total, near = dict.fromkeys(range(200), 0), dict.fromkeys(range(200), 0), {}
    for k in range(200):
        seen, at, d = [], k, 0
        while at not in seen:
            seen.append(at)
            n[at] += 1
            total[at] += weight[k]
            if named[at] and k not in near:
                near[k] = (named[at], d)
            if at not in parent:
                break
            at, d = parent[at], d + 1
    got = {r.id: (r.n, r.v) for r in hierarchy.subtree_sum(nodes, edges, ["v"]).collect()}
    assert got == {k: (n[k], total[k]) for k in range(200)}
    found = {r.id: (r.pkg, r.from_depth) for r in hierarchy.nearest_ancestor(nodes.drop("v"), edges, F.col("pkg") != "", "pkg").collect()}
    assert found == {k: near.get(k, ("", None)) for k in range(200)}


def test_a_tree_five_thousand_deep(spark):
    nodes = spark.range(5_000).select(F.lit("h").alias("host_id"), "id", F.lit(2).alias("v"), F.when(F.col("id") == 0, "top").otherwise("").alias("pkg"))
    edges = spark.range(1, 5_000).select(F.lit("h").alias("host_id"), F.col("id").alias("child"), (F.col("id") - 1).alias("parent"))
    assert hierarchy.subtree_sum(nodes, edges, ["v"]).where("n = 5000 - id AND v = 2 * n").count() == 5_000
    assert hierarchy.nearest_ancestor(nodes, edges, F.col("pkg") != "", "pkg").where("pkg = 'top' AND from_depth = id").count() == 5_000


def test_a_key_with_all_rows_is_spread(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be one range
    rows = spark.range(40_000).select(F.lit("h").alias("host_id"), F.lit("one").alias("key"), F.struct(F.col("id").alias("ts")).alias("at"), F.col("id").cast("string").alias("event_id"))
    seen, real = [], timeline.checkpointed
    try:
        timeline.checkpointed = lambda df: seen.append(real(df)) or seen[-1]
        found = timeline._previous(rows.repartition(16), ["host_id", "key"])
        assert found.where("coalesce(last, '-1') = cast(at.ts - 1 AS string)").count() == 40_000
    finally:
        timeline.checkpointed = real
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in seen[0].groupBy("_range").count().collect()]
    assert len(sizes) > 1 and max(sizes) < 25_000


def test_owners_are_written_once(spark, monkeypatch):
    written, real = [], hierarchy.checkpointed
    monkeypatch.setattr(hierarchy, "checkpointed", lambda df: written.append(real(df)) or written[-1])
    edges = spark.range(60).select(F.lit("h").alias("host_id"), F.col("id").alias("child"), (F.col("id") + 1).alias("parent"))
    found = hierarchy.nearest_owner(edges, spark.createDataFrame([("h", 0), ("h", 30)], "host_id string, id long"))
    assert {r.id: (r.owner, r.dist) for r in found.collect()} == {k: (0, k) if k < 30 else (30, k - 30) for k in range(61)}
    assert sum(x.count() for x in written[1:]) == 61

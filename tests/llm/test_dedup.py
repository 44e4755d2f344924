import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fleetscope.llm import exact_dedup as X
from fleetscope.llm import simhash as H
from fleetscope.llm.components import connected_components

DOCS = "doc_id long, text string"
AWKWARD = [(1, "Hello World foo bar baz"), (2, "hello world FOO bar baz"), (2, "hello world FOO bar baz"), (3, None), (4, ""), (None, "x"), (None, "x"), (None, "y"), (7, "É"), (8, "é"), (9, "word " * 30_000)]


@given(st.lists(st.tuples(st.booleans(), st.integers(0, 60)), max_size=400))
@settings(max_examples=40, deadline=None)
def test_cuckoo_index_is_a_set(steps):
    index, live = X.CuckooIndex(8), set()
    for add, k in steps:
        key = hashlib.sha256(str(k).encode()).digest()
        if add and k not in live:
            index.insert(key, k)
            live.add(k)
        elif not add:
            assert index.delete(key) == (k in live)
            live.discard(k)
    for k in range(61):
        key = hashlib.sha256(str(k).encode()).digest()
        assert (index.find(key) is not None) == (k in live)
        assert index.may_contain(key) or k not in live


def test_cuckoo_index_grows_from_its_keys():
    index = X.CuckooIndex(8)
    keys = [hashlib.sha256(str(k).encode()).digest() for k in range(5000)]
    for k in keys:
        index.insert(k, None)
    assert index.resizes > 0 and all(index.find(k) is not None for k in keys)


def test_exact_dedup_of_awkward_rows(spark):
    df = spark.createDataFrame([(*r, "other") for r in AWKWARD], DOCS + ", digest string")
    rows = X.decisions(df).collect()
    assert len(rows) == len(AWKWARD)
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in rows}
    assert {(1, 2, 3, False), (2, 2, 3, True), (3, 4, 2, False), (4, 4, 2, True), (None, None, 2, True), (7, 7, 1, True), (8, 8, 1, True)} <= got
    kept = X.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, (r.text or "")[:3]) for r in kept.collect()) == [(0, "x"), (0, "y"), (2, "hel"), (4, ""), (7, "É"), (8, "é"), (9, "wor")]


def test_exact_dedup_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert X.decisions(empty).count() == 0 and X.deduplicate(empty).count() == 0


def test_index_inserts_and_deletes(spark):
    rng = random.Random(8)
    key = lambda t: X.digest(t.encode())
    rows = [(rng.randrange(30), rng.choice("abcdefgh")) for _ in range(60)]
    members = X.keys(spark.createDataFrame(rows, DOCS))
    index, live = X.build_index(members, 4), X.live_rows(members)
    for _ in range(3):
        more = [(rng.randrange(40), rng.choice("ABghij")) for _ in range(12)]
        less = rng.sample(rows, 20) + [(99, "a"), (3, "never")] + [max(r for r in rows if r[1].lower() == t) for t in "cd" if any(r[1].lower() == t for r in rows)]
        index, live = X.update_index(index, live, 4, inserted=X.keys(spark.createDataFrame(more, DOCS)), deleted=X.keys(spark.createDataFrame(less, DOCS)))
        rows = rows + more
        for d, t in less:
            at = [k for k, r in enumerate(rows) if r[0] == d and r[1].lower() == t.lower()]
            if at:
                rows.pop(at[0])
        want = defaultdict(list)
        for d, t in rows:
            want[key(t)].append(d)
        got = {bytes(r.digest): (r.keep_id, r.at_keep, r.group_size) for r in index.collect()}
        assert got == {k: (max(v), v.count(max(v)), len(v)) for k, v in want.items()}
    asked = [(1, "a"), (3, "B"), (4, "never"), (5, "j"), (6, "a")]
    found = {r.doc_id: r.live for r in X.lookup(index, X.keys(spark.createDataFrame(asked, DOCS)), 4).collect()}
    assert found == {d: key(t) in want for d, t in asked}
    gone, live = X.update_index(index, live, 4, deleted=live.select("doc_id", "digest", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k")).select("doc_id", "digest"))
    assert gone.count() == live.count() == 0


def components_by_force(fps, ids, radius):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, d in enumerate(ids):
        least[find(i)].append(d)
    return [min(least[find(i)]) for i in range(len(fps))]


def test_gray_tree_finds_all_links_and_no_others():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fp = np.unique(np.concatenate([b ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (20, 3), dtype=np.uint64), axis=1) for b in base]))
    group = np.sort(rng.integers(0, 5, len(fp)))
    order = np.lexsort((H.gray_rank(fp), group))
    fp, group = fp[order], group[order]
    tree = H.GrayTree(fp, group)
    got = {(int(i), int(j)) for a, b in tree.search(fp, tree.group_no, 4, after=np.arange(len(fp))) for i, j in zip(a, b)}
    want = {(i, j) for i in range(len(fp)) for j in range(i + 1, len(fp)) if group[i] == group[j] and bin(int(fp[i] ^ fp[j])).count("1") <= 4}
    assert got == want


@pytest.mark.parametrize("limit", [4096, 6])
def test_simhash_components_match_brute_force(spark, limit):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(300)]
    texts = []
    for _ in range(40):
        base = [rng.choice(words) for _ in range(80)]
        for _ in range(rng.randint(1, 6)):
            own = list(base)
            for _ in range(rng.randint(0, 2)):
                own[rng.randrange(80)] = rng.choice(words)
            texts.append(" ".join(own))
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in H.components(spark.createDataFrame(rows, DOCS), limit=limit).collect()}
    fps = [H.fingerprint(t.encode()) for t in texts]
    assert [got[k].fp & (2**64 - 1) for k, _ in rows] == fps
    assert [got[k].component_id for k, _ in rows] == components_by_force(fps, range(len(rows)), 4)
    assert len(set(components_by_force(fps, range(len(rows)), 4))) < len(set(fps))


def test_fingerprint_by_definition():
    import xxhash

    def plain(text):
        words = text.lower().split()
        shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
        hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
        return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))

    for text in ("", "  ", "one", "a b c", "a b c d", "A b\tc\nd e f a b c d", "über straße " * 7):
        assert H.fingerprint(text.encode()) == plain(text)


def test_simhash_of_awkward_rows(spark):
    df = spark.createDataFrame([(*r, "z") for r in AWKWARD], DOCS + ", fp string")
    rows = {(r.doc_id, r.component_id) for r in H.components(df).collect()}
    assert {(3, 3), (4, 3), (None, None), (1, 1), (2, 1)} <= rows
    kept = H.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, (r.text or "")[:3]) for r in kept.collect()) == [(0, "x"), (0, "y"), (1, "Hel"), (3, ""), (7, "É"), (8, "é"), (9, "wor")]
    assert H.components(spark.createDataFrame([], DOCS)).count() == 0


def test_components_of_a_long_chain(spark):
    n = 200
    edges = spark.createDataFrame([(k * 7919 % n, (k + 1) * 7919 % n) for k in range(n - 1)] + [(1000, 1001)], "a long, b long")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert got == {k: 0 for k in range(n)} | {1000: 1000, 1001: 1000}

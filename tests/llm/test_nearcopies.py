import random
import tracemalloc
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from fleetscope.llm import nearcopies as N
from fleetscope.llm import quality as Q

DOCS = "doc_id long, text string"


def kept_by_force(rows):
    """Ids that stay if texts link at a Jaccard similarity of 0.8 of their five-word shingles."""
    sets = []
    for _, text in rows:
        w = (text or "").lower().split()
        sets.append({" ".join(w[k : k + 5]) for k in range(max(len(w) - 4, 1))})
    near = defaultdict(list)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                near[i].append(j)
                near[j].append(i)
    seen, kept = set(), []
    for i in range(len(rows)):
        if i in seen:
            continue
        group, todo = [], [i]
        seen.add(i)
        while todo:
            x = todo.pop()
            group.append(rows[x][0])
            new = set(near[x]) - seen
            seen |= new
            todo += new
        kept.append(min(group))
    return sorted(kept)


def test_stage_drops_near_copies_of_similarity_over_four_fifths(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    notice = [word() for _ in range(40)]
    rows = []
    for _ in range(25):
        base = [word() for _ in range(rng.choice([12, 60, 200]))] + notice
        for _ in range(4):
            own = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                own[rng.randrange(len(own))] = word()
            rows.append((len(rows), " ".join(own)))
    base = [word() for _ in range(100)]
    for _ in range(120):
        own = list(base)
        for _ in range(rng.choice([1, 2, 3])):
            own[rng.randrange(100)] = word()
        rows.append((len(rows), " ".join(own)))
    expected = kept_by_force(rows)
    assert 30 < len(expected) < 120
    got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, DOCS), "")
    assert sorted(r.doc_id for r in got.collect()) == expected


def test_similarity_of_exactly_four_fifths_links(spark):
    # 13 words have 9 shingles; 8 of them shared make 8/10, 7 of them 7/11.
    words = [f"w{k}" for k in range(13)]
    rows = [(5, " ".join(words)), (3, " ".join([*words[:-1], "other"])), (1, " ".join([*words[:-2], "quite", "other"]))]
    got = N.deduplicate(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(r.doc_id for r in got) == kept_by_force(rows) == [1, 3]


def test_awkward_rows(spark):
    rows = [(None, None), (None, "x"), (None, "x"), (2, "a b c d e f"), (2, "a b c d e f"), (4, ""), (5, "  "), (6, "A b c d e f"), (None, "a b c d e f")]
    got = N.deduplicate(spark.createDataFrame(rows, DOCS))
    assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == [(0, "x"), (2, "a b c d e f"), (4, "")]
    assert N.deduplicate(spark.createDataFrame([], DOCS)).count() == 0


def test_bit_maps_leave_out_no_link(spark, monkeypatch):
    monkeypatch.setattr(N, "HOT", 1)
    monkeypatch.setattr(N, "STARS", (1,))
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdef", k=4))
    rows = []
    for size in (8, 35, 70, 300, 1500):
        base = [word() for _ in range(size)]
        for _ in range(24):
            own = base[: len(base) - rng.randrange(1 + size // 6)]
            for _ in range(rng.choice([0, 1, 1, 2, 3]) * max(1, size // 150)):
                own[rng.randrange(len(own))] = word()
            rows.append((len(rows), " ".join(own)))
    got = N.deduplicate(spark.createDataFrame(rows, DOCS))
    assert sorted(r.doc_id for r in got.collect()) == kept_by_force(rows)


def _moved(spark):
    """Bytes that all stages so far wrote to shuffles."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty(30_000)
    stages = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_pairs_that_bit_maps_rule_out_move_no_whole_sets(spark, monkeypatch):
    monkeypatch.setattr(N, "BROADCAST_SHINGLES", 0)
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    # Pairs with half of their words in common, and a few of every degree around the limit.
    texts, pairs = [], []
    for k in range(60):
        base = [word() for _ in range(3000)]
        other = list(base)
        if k < 48:
            other[1500:] = [word() for _ in range(1500)]
        else:
            for at in rng.sample(range(3000), 10 * (k - 45)):
                other[at] = word()
        pairs.append((2 * k, 2 * k + 1))
        texts += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
    texts += [(200, "one two three four five six"), (201, "ONE two three four five six"), (202, ""), (203, None)]
    pairs += [(200, 201), (202, 203), (200, 202), (0, 200), (201, 0)]
    shingles = {i: {" ".join(w[j : j + 5]) for j in range(max(len(w) - 4, 1))} for i, t in texts for w in [(t or "").lower().split()]}
    expected = sorted((a, b) for a, b in pairs if 5 * len(shingles[a] & shingles[b]) >= 4 * len(shingles[a] | shingles[b]))
    assert 4 < len(expected) < 16
    docs = spark.createDataFrame(texts, "node long, text string")
    before = _moved(spark)
    got = N.links(spark.createDataFrame(pairs, "a long, b long"), docs)
    assert sorted((r.a, r.b) for r in got.collect()) == expected
    # One side's whole sets take 60 times 24 KB, its bit maps 60 times 2 KB.
    assert _moved(spark) - before < 700_000


@pytest.mark.parametrize("count, least", [(N._often, 2), (Q._counted, 1)])
def test_counts_hold_their_values_once(count, least):
    rng = np.random.default_rng(7)
    # Shingles mostly stand alone, and use the highest bit; n-grams of five bytes mostly repeat.
    high, alone = (64, 20) if least == 2 else (40, 1)
    some = rng.integers(0, 1 << high, 20_000, dtype=np.uint64)
    parts = [rng.choice(some, 100_000) for _ in range(30 - alone)] + [rng.integers(0, 1 << high, 100_000, dtype=np.uint64) for _ in range(alone)]
    parts[0] = np.r_[parts[0], np.uint64(0), np.uint64((1 << high) - 1)]
    parts[1] = np.r_[parts[1], np.uint64(0)]
    size = sum(x.nbytes for x in parts)
    h, n = np.unique(np.concatenate(parts), return_counts=True)
    expected = dict(zip(h[n >= least].view(np.int64).tolist(), n[n >= least].tolist()))
    tracemalloc.start()
    try:
        got = count(parts)
        # What is held besides the parts.
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert dict(zip(got.column(0).to_pylist(), got.column(1).to_pylist())) == expected
    assert peak < 1.8 * size
    assert count([np.array([5], dtype=np.uint64)]).num_rows == 2 - least

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetscope.llm import ctw as W
from fleetscope.llm.common import crc_mod
from fleetscope.llm.queries import op12_context_tree


def brute_log10(train: list[str], texts: list[str], depth: int) -> list[float]:
    """Context-tree weighting straight from its definition, a dictionary of counts for each node."""

    def events(text: str):
        data = b"\n" * depth + W.stream(text.encode())
        for i in range(depth, len(data)):
            for bit in range(8):
                yield data[i - depth : i], (bit, data[i] >> (8 - bit)), data[i] >> (7 - bit) & 1

    counts = defaultdict(lambda: [0, 0])
    children = defaultdict(set)
    for text in train:
        for context, decision, one in events(text):
            for d in range(depth + 1):
                counts[decision, context[depth - d :]][one] += 1
                if d < depth:
                    children[decision, context[depth - d :]].add(context[depth - d - 1 :])

    def estimate(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    known: dict = {}

    def weighted(decision, context):
        if (decision, context) not in known:
            a, b = counts.get((decision, context), (0, 0))
            own = estimate(a, b)
            if len(context) < depth:
                below = sum(weighted(decision, c) for c in children.get((decision, context), ()))
                own = math.log(0.5) + np.logaddexp(own, below)
            known[decision, context] = own
        return known[decision, context]

    def probability(decision, context, one, d=0):
        own = context[depth - d :]
        a, b = counts.get((decision, own), (0, 0))
        kt = ((b if one else a) + 0.5) / (a + b + 1)
        if d == depth:
            return kt
        stop = math.exp(math.log(0.5) + estimate(a, b) - weighted(decision, own))
        return stop * kt + (1 - stop) * probability(decision, context, one, d + 1)

    return [sum(math.log10(probability(decision, context, one)) for context, decision, one in events(t)) for t in texts]


TEXTS = ["the cat sat on the mat", "The  dog sat\ton the log", "ça va très bien", "the cat and the dog", None, "", "  ", "zz qq", "the cat sat on the mat", "on the mat the cat sat " * 40]


@pytest.mark.parametrize("depth,split,block", [(4, 3, 40), (6, 3, 1 << 20), (2, 1, 100)])
def test_equals_the_definition(spark, depth, split, block):
    docs = spark.createDataFrame([(k, t, "x", "y") for k, t in enumerate(TEXTS)] + [(3, TEXTS[3], "x", "y"), (None, "the cat", "x", "y")], "doc_id long, text string, block string, learns string").repartition(3)
    held = F.coalesce(F.col("doc_id") % 4 == 3, F.lit(False))
    found = W.scores(docs, ~held, depth=depth, split=split, block_bytes=block, shard_bytes=200).collect()
    all_texts = [(k, t or "") for k, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, "the cat")]
    train = [t for k, t in all_texts if k is None or k % 4 != 3]
    assert sorted(str(r.doc_id) for r in found) == sorted(str(k) for k, _ in all_texts)
    want = dict(zip([k for k, _ in all_texts], brute_log10(train, [t for _, t in all_texts], depth)))
    tokens = Counter(w for t in train for w in [*t.lower().split(), "\n"])
    n, v = sum(tokens.values()), len(tokens)
    text = dict(all_texts)
    for r in found:
        assert r.score == pytest.approx(want[r.doc_id], rel=1e-5)
        own = [*text[r.doc_id].lower().split(), "\n"]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.learns) == (len(own), sum(tokens[w] > 0 for w in own), n, r.doc_id is None or r.doc_id % 4 != 3)
        assert r.base_score == pytest.approx(sum(math.log10((tokens[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own), rel=1e-9)
        assert r.bits_per_byte == pytest.approx(-r.score * math.log2(10) / r.n_bytes)


def test_no_training_text_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    a, b = sorted(W.scores(docs, F.lit(False)).collect())
    assert (a.bits_per_byte, b.bits_per_byte, a.train_tokens, a.base_score, a.n_known) == (pytest.approx(8, rel=1e-6), pytest.approx(8, rel=1e-6), 0, 0.0, 0)
    assert W.scores(docs.limit(0), F.lit(True)).count() == 0


def test_estimates_of_large_counts():
    a, b = np.array([0, 5, 4095, 4096, 10**7]), np.array([0, 3, 4096, 1, 10**6])
    want = [math.lgamma(x + 0.5) + math.lgamma(y + 0.5) - math.lgamma(x + y + 1) - math.log(math.pi) for x, y in zip(a, b)]
    assert W.log_kt(a, b) == pytest.approx(want, rel=1e-9, abs=1e-9)


def test_unasked_n_gram_is_an_error():
    keys = np.array([3, 9, 1 << 40], dtype=np.uint64)
    assert W.Places(keys).of(keys[::-1]).tolist() == [2, 1, 0]
    with pytest.raises(ValueError):
        W.Places(keys).of(np.array([4], dtype=np.uint64))


def test_query_beats_single_words(spark):
    found = op12_context_tree(spark, "/root/testdata/sf0.01").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", (crc_mod("doc_id", 5) == 1).alias("held")).toPandas()
    assert len(found) == len(docs) and set(found.doc_id[found.held_out]) == set(docs.doc_id[docs.held])
    held = found[found.held_out]
    assert held.score.sum() > held.base_score.sum() and (found.score < 0).all()

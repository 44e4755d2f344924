import hashlib
import math
import re
from collections import Counter

import pytest

from fleetscope.llm import fim as M
from fleetscope.llm import lexsearch as S

ODD = ["", None, "x", "ab", "<P> holds a mark", "half a mark <S and <M", "ends with <", "né è ü 語言 🙂🙂🙂 " * 30, "<<<>>>" * 50, "word " * 20_000, "same", "same"]


def expected(doc_id, text):
    t = text or ""
    digest = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (len(t) + 1), h[1] % (len(t) + 1)))
    if not t or re.search("<[PSM]>", t) or h[2] % 100 >= 90:
        return "plain", None, None, t
    parts = t[:a], t[a:b], t[b:]
    if h[3] % 100 < 20:
        return "spm", a, b - a, f"<S>{parts[2]}<P>{parts[0]}<M>{parts[1]}"
    return "psm", a, b - a, f"<P>{parts[0]}<S>{parts[2]}<M>{parts[1]}"


@pytest.mark.parametrize("chunk", [1, 7, 4096])
def test_fill_in_middle(spark, chunk):
    texts = [x if chunk > 1 else (x or "")[:300] for x in ODD] * 4
    rows = [(k, t, 5, "f") for k, t in enumerate(texts)] + [(None, "no id", 1, "f"), (3, texts[3], 1, "f"), (3, texts[3], 1, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pos int, form string").repartition(5)
    found = sorted(M.digests(docs, chunk=chunk).collect(), key=str)
    assert len(found) == len(rows)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(k, len(t or ""), *expected(k, t)[:3], sha(expected(k, t)[3]), sha(t or "")) for k, t, *_ in rows]
    assert sorted((tuple(r) for r in found), key=str) == sorted(want, key=str)
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    texts_out = M.outputs(docs, chunk=chunk).collect()
    assert Counter((r.doc_id, r.form, r.output) for r in texts_out) == Counter((k, expected(k, t)[0], expected(k, t)[3]) for k, t, *_ in rows)
    assert Counter(M.restored(r.form, r.output) for r in texts_out) == Counter(t or "" for _, t, *_ in rows)
    assert M.digests(docs.limit(0)).count() == 0


def test_fill_in_middle_moves_texts_once(spark):
    plan = M.digests(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def brute_ranks(docs, items, k):
    cut = lambda t: re.findall(S.TERM, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own = [(d, Counter(cut(t))) for d, t in docs]
    n_docs, n_all = sum(bool(c) for _, c in own), sum(c.total() for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        ranked = []
        for d, c in own:
            score = 0
            for t in set(cut(text)) & set(c):
                m = 50 + 50 * c.total() * n_docs // n_all
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m))
            if score:
                ranked.append((-score, d is None, d or 0, d))
        out += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(ranked)[:k])]
    return out


@pytest.mark.parametrize("block", [5, 1 << 16])
def test_search_equals_brute_force(spark, block):
    docs = [(1, "The cat, the Cat."), (2, None), (3, "... !"), (4, "dog-cat dog"), (5, "concatenate cat's"), (None, "cat dog"), (7, "Ärger ärger über cat"), (8, "x " * 9000 + "cat"), (9, "cat dog"), (10, "cat dog"), (9, "cat dog"), (11, "")]
    items = [(1, "cat"), (2, "DOG cat cat"), (3, None), (4, "none such"), (5, "über Ärger ärger"), (6, "s 's the"), (7, "x")]
    for k in (2, 50):
        found = S.search(spark.createDataFrame([(*d, "c") for d in docs], "doc_id long, text string, item string").repartition(4), spark.createDataFrame([(*i, 1) for i in items], "item_id int, text string, rank int"), k=k, block=block)
        assert found.schema["item_id"].dataType.simpleString() == "int"
        assert sorted((tuple(r) for r in found.collect()), key=str) == sorted(brute_ranks(docs, items, k), key=str)


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert S.search(docs.limit(0), items).count() == 0 and S.search(docs, items.limit(0)).count() == 0
    assert [tuple(r) for r in S.search(docs, items).select("item_id", "rank", "doc_id").collect()] == [(1, 1, 1)]


def test_the_best_of_many_with_ties(spark):
    docs = spark.range(0, 3000).selectExpr("id AS doc_id", "concat('words ', CASE WHEN id % 7 = 0 THEN 'same' ELSE 'other' END) AS text").repartition(200, "doc_id")
    found = S.search(docs, spark.createDataFrame([(1, "same")], "item_id long, text string"), k=5).orderBy("rank").collect()
    assert [r.doc_id for r in found] == [0, 7, 14, 21, 28]

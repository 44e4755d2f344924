import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from fleetscope.llm import decontam as D
from fleetscope.llm import packing as P
from fleetscope.llm import quality as Q

DOCS = "doc_id long, text string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@given(st.lists(st.text(alphabet="aB9 é.\n_-{", max_size=40), max_size=8))
@settings(max_examples=60, deadline=None)
def test_words_as_the_pattern_has_them(texts):
    for t in texts:
        assert D.split_words(t.encode()) == [w.encode() for w in WORD.findall(t.translate(LOW))]


def decontaminate_by_force(docs, items, size=10):
    windows = defaultdict(set)
    for i, t in items:
        w = WORD.findall((t or "").translate(LOW))
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[k : k + size])].add(str(i))
    out = {}
    for d, t in docs:
        w = WORD.findall((t or "").translate(LOW))
        hit, ids = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    ids |= windows[tuple(w[k : k + n])]
        out[d] = (len(w), len(hit), sorted(ids))
    return out


def test_decontamination_matches_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(30)] + ["é", "ñu"]
    item = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, item(rng.choice([3, 9, 10, 14, 40]))) for k in range(12)] + [(50, None), (51, ""), (52, "lone"), (53, "lone")]
    docs = [(k, ", ".join([item(15), (items[k % 12][1]).upper(), item(rng.randint(0, 30)), items[(k * 5) % 12][1]])) for k in range(40)] + [(90, None), (91, ""), (92, "a lone. word"), (93, "... " * 9)]
    want = decontaminate_by_force(docs, items)
    df, bench = spark.createDataFrame(docs, DOCS + "").withColumnRenamed("text", "text"), spark.createDataFrame(items, "item_id long, text string")
    for block, segment in ((200_000, 1 << 20), (20, 64)):
        monkeypatch.setattr(D, "SEGMENT", segment)
        rows = D.find(df, bench, block=block).withColumn("n_hit", D.hit_words("hits")).collect()
        assert {r.doc_id: (r.hits.n_words, r.n_hit, list(r.hits["items"])) for r in rows} == want
    clean = {r.doc_id for r in D.remove_documents(df, bench).collect()}
    assert clean == {d for d, x in want.items() if not x[1]}
    cut = {r.doc_id: r.text for r in D.remove_spans(df, bench).collect()}
    assert cut[92].split() == ["a", "word"] or cut[92] == "a . word"
    assert cut[90] is None
    assert D.find(df.limit(0), bench).count() == 0 and D.find(df, bench.limit(0)).where("size(hits.spans) > 0").count() == 0


def test_segments_keep_all_windows():
    text = " ".join(f"w{k}" for k in range(2000)).encode()
    old, D.SEGMENT = D.SEGMENT, 100
    try:
        parts = D._segments(text, 10)
    finally:
        D.SEGMENT = old
    assert len(parts) > 20
    seen = Counter()
    for part, base in parts:
        for k, w in enumerate(D.split_words(part)):
            assert w == f"w{base + k}".encode()
            seen[base + k] += 1
    assert set(seen) == set(range(2000))


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
@settings(max_examples=80, deadline=None)
def test_plan_places_each_piece_once(counts):
    slots = P.plan(counts, 64)
    filled = defaultdict(list)
    for length, rank, n, first, offset in slots:
        for k in range(n):
            filled[first + k].append((offset, length))
    ranks = defaultdict(list)
    for length, rank, n, _, _ in slots:
        ranks[length] += range(rank, rank + n)
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items()}
    for own in filled.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 64
    assert len(filled) == best_fit_decreasing([k for k, n in counts.items() for _ in range(n)], 64)


def best_fit_decreasing(lengths, size):
    spaces = []
    for n in sorted(lengths, reverse=True):
        fits = [s for s in spaces if s >= n]
        if fits:
            spaces.remove(min(fits))
            spaces.append(min(fits) - n)
        else:
            spaces.append(size - n)
    return len(spaces)


def test_packing_round_trip(spark):
    rng = random.Random(2)
    docs = [(k, " ".join(rng.choice("alpha beta gamma delta stadt été".split()) for _ in range(rng.randint(0, 900)))) for k in range(60)] + [(100, None), (101, ""), (101, ""), (None, "x"), (102, "a <|endoftext|> b"), (103, "z" * 50_000)]
    got = [r.asDict() for r in P.pack(spark.createDataFrame(docs, DOCS), size=128, keep_ids=True).collect()]
    from tokenizers import Tokenizer
    import public_tokenizers

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {d: t for d, t in docs if d != 101}
    for d, t in texts.items():
        own = sorted((r for r in got if r["doc_id"] == d), key=lambda r: r["piece"])
        ids = [i for r in own for i in r["ids"]]
        assert ids == plain.encode(t or "", add_special_tokens=False).ids + [2]
        assert [r["start"] for r in own] == np.cumsum([0, *(r["length"] for r in own)])[:-1].tolist()
        assert all(r["length"] == 128 for r in own[1:])
        assert all(zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) == r["ids_crc32"] for r in own)
    assert sum(r["doc_id"] == 101 for r in got) == 2
    used = defaultdict(list)
    for r in got:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in used.values():
        assert sum(n for _, n in own) <= 128
        assert [o for o, _ in sorted(own)] == np.cumsum([0, *(n for _, n in sorted(own))])[:-1].tolist()
    assert len(used) <= -(-sum(r["length"] for r in got) // 128) + 2
    assert P.pack(spark.createDataFrame([], DOCS)).count() == 0


def kneser_ney_by_force(texts, order):
    """Interpolated modified Kneser-Ney over the same symbols, written out with dictionaries."""
    levels = {order: Counter()}
    for t in texts:
        levels[order].update(Q.grams(*Q.symbols([t.encode()]), order)[0].tolist())
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g & ((1 << 8 * k) - 1) for g in levels[k + 1])
    cuts, totals, freed = {}, {}, {}
    for k, own in levels.items():
        n = Counter(c for c in own.values() if c <= 4)
        if all(n[i] for i in (1, 2, 3, 4)):
            y = n[1] / (n[1] + 2 * n[2])
            d = [min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.05 * i), 0.95 * i) for i in (1, 2, 3)]
        else:
            d = [0.5, 1.0, 1.5]
        cuts[k] = lambda c, d=d: d[min(c, 3) - 1]
        totals[k], freed[k] = Counter(), Counter()
        for g, c in own.items():
            totals[k][g >> 8] += c
            freed[k][g >> 8] += cuts[k](c)

    def p(g, k):
        if k == 0:
            return 1 / 256
        g &= (1 << 8 * k) - 1
        ctx = g >> 8
        if ctx not in totals[k]:
            return p(g, k - 1)
        c = levels[k].get(g, 0)
        return (c - cuts[k](c) if c else 0) / totals[k][ctx] + freed[k][ctx] / totals[k][ctx] * p(g, k - 1)

    return lambda t: [p(g, order) for g in Q.grams(*Q.symbols([t.encode()]), order)[0].tolist()]


def test_perplexities_match_brute_force(spark):
    rng = random.Random(4)
    syllables = "an the re on ti ou er sh".split()
    make = lambda n: " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n))
    docs = [(k, make(rng.randint(1, 40))) for k in range(60)] + [(90, "ZZZ!! ZZZ!!"), (91, None), (92, ""), (93, "the the the the the"), (None, "the an")]
    df = spark.createDataFrame(docs, DOCS)
    trusted = [t for d, t in docs if d is not None and d < 50]
    p = kneser_ney_by_force(trusted, Q.ORDER)
    model = Q.KneserNey(Q.gram_counts(df.where("doc_id < 50")))
    got = {r.doc_id: r for r in Q.perplexities(df, model).collect()}
    for d, t in docs:
        own = p(t or "")
        assert got[d].n_symbols == len(own)
        if own:
            assert np.isclose(got[d].perplexity, np.exp(-np.mean(np.log(own))), rtol=1e-4)
        else:
            assert got[d].perplexity is None
    assert got[93].perplexity > 2 * got[0].perplexity


def test_probabilities_sum_to_one(spark):
    df = spark.createDataFrame([(1, "the an the on an the re"), (2, "an on the")], DOCS)
    model = Q.KneserNey(Q.gram_counts(df))
    context = int(Q.grams(*Q.symbols([b"the a"]))[0][-1]) >> 8
    wanted = spark.createDataFrame([(context << 8 | b,) for b in range(256)], "g long")
    assert abs(sum(np.exp(r.logp) for r in model.log_probability(wanted).collect()) - 1) < 1e-3


def test_quality_keeps_good_and_drops_junk(spark):
    rng = random.Random(6)
    syllables = "an the re on ti ou er sh".split()
    make = lambda n: " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n)) + "."
    docs = [(k, make(40), "en" if k % 2 else None, "keep") for k in range(300)] + [(400, "QX%% ZK&& " * 30, "en", "junk"), (401, "onre " * 80, "xx", "junk"), (402, None, "en", "junk"), (403, make(30), "xx", "keep")]
    df = spark.createDataFrame(docs, DOCS + ", lang string, low string")
    kept = Q.keep_accepted(df, spark.createDataFrame([(k,) for k in range(250)], "doc_id long"))
    assert kept.columns == df.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {400, 401, 402}.isdisjoint(ids) and len(ids & set(range(300))) >= 297 and 403 in ids
    assert Q.keep_accepted(df, spark.createDataFrame([], "doc_id long")).where("text IS NOT NULL").count() == 303
    assert Q.keep_accepted(df.limit(0), spark.createDataFrame([(1,)], "doc_id long")).count() == 0

import math
import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from fleetscope.llm import htmlmain as M
from fleetscope.llm import langid as L
from fleetscope.llm import licences as C
from fleetscope.llm import toxicity as T
from fleetscope.llm import urlfilter as U
from fleetscope.llm.common import crc_mod

SF = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = L.learn(docs, crc_mod("doc_id", 4) != 2, sample=150)
    assert model.families == ["germanic", "romance"] and len(model.pairs) == 2
    found = L.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(crc_mod("doc_id", 4) == 2).toPandas()
    assert (found.lang == found.lang_pred).mean() > 0.97
    assert found.score.between(0, 1).all()
    odd = L.identify(spark.createDataFrame([(1, None), (2, ""), (3, "12 ... 3"), (None, "the and of"), (5, "the and of " * 50_000)], "doc_id long, text string"), model).collect()
    assert [r.lang_pred for r in odd[:3]] == ["und"] * 3 and odd[0].score == 0.0 and odd[3].lang_pred in model.langs and odd[4].lang_pred == odd[3].lang_pred
    assert L.learn(docs.limit(0), F.lit(True)) is None
    assert L.identify(docs.limit(3), None).first().lang_pred == "und"


def test_toxicity_learns_and_shares_subwords(spark):
    rng = random.Random(1)
    plain = ["".join(rng.choice("an the re on ti ou er sh ly".split()) for _ in range(rng.randint(1, 3))) for _ in range(400)]
    bad = ["disgusting", "worthless", "pathetic"]
    rows, labels = [], []
    for k in range(600):
        own = [rng.choice(plain) for _ in range(60)]
        if k % 4 == 0:
            for _ in range(3):
                own[rng.randrange(60)] = rng.choice(bad)
        rows.append((k, " ".join(own)))
        labels.append((k, int(k % 4 == 0)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = T.learn(docs, marks, crc_mod("doc_id", 5) != 0)
    held = T.score(docs, model).join(marks, "doc_id").where(crc_mod("doc_id", 5) == 0).toPandas()
    assert ((held.score >= 0.5) == (held.toxic == 1)).mean() > 0.95
    base = " ".join(rng.choice(plain) for _ in range(40))
    a, b = model.scores([base.encode(), (base + " disgustingg pathetik disgustinng").encode()])
    assert b > a + 0.2
    odd = T.score(spark.createDataFrame([(1, None), (None, ""), (3, "... !!")], "doc_id long, text string"), model).collect()
    assert all(0 < r.score < 0.5 for r in odd)
    assert T.learn(docs, marks.limit(0), F.lit(True)) is None
    # Names that clash, ids that repeat, and bounds that choose by the id's hash whatever the order of rows.
    odd = docs.selectExpr("doc_id", "text", "1 AS id", "2 AS label", "3 AS _id", "4 AS rank")
    few = T.learn(odd.unionByName(odd.limit(50)).repartition(7), marks.unionByName(marks.limit(9)), F.lit(True), sample=200)
    again = T.learn(docs.orderBy(F.desc("doc_id")).coalesce(1), marks, F.lit(True), sample=200)
    texts = [r.text.encode() for r in docs.limit(20).collect()]
    assert np.allclose(few.scores(texts), again.scores(texts))
    assert T.learn(docs, marks, F.lit(True), most_bytes=30_000) is not None and T.learn(docs, marks, F.lit(True), most_bytes=10) is None
    assert T.score(docs.limit(1), None).first().score == 0.0


def test_licences(spark):
    lines = ["Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.", "All rights reserved.", "// SPDX-License-Identifier: Apache-2.0", "# SPDX-License-Identifier: MIT", "The licence of poets is well known to all readers of verse.", "He was released under bail by the court.", "his driver's licence was taken away"]
    header = "some words here\n\n * Permission to use, copy, modify, and/or distribute this software for any\n * purpose with or without fee is hereby granted, provided that the above\n * copyright notice and this permission notice appear in all copies.\n\nend"
    docs = spark.createDataFrame([(k, f"some words here\n{x}\nmore words", 1, 2) for k, x in enumerate(lines)] + [(50, None, 1, 2), (None, "", 1, 2), (51, "plain " * 99_999, 1, 2), (52, header, 1, 2), (52, header, 1, 2)], "doc_id long, text string, findings int, unit int")
    corpus = spark.read.parquet(f"{SF}/documents.parquet")
    model = C.train(corpus, 500)
    found = [(r.doc_id, [(x.line, x["last"], x.family) for x in r.findings if x.confirmed]) for r in C.scan(docs, model).collect()]
    by_id = dict(found)
    assert [by_id[k] for k in range(7)] == [[(1, 1, f)] for f in ("mit", "cc-by-nc", "apache-2.0", "gpl", "proprietary", "apache-2.0", "mit")]
    assert not any(by_id[k] for k in (7, 8, 9, 50, None, 51)) and len(found) == 15
    assert [x for k, x in found if k == 52] == [[(2, 4, "isc")]] * 2
    assert C.scan(docs.limit(0), model).count() == 0
    assert C.train(docs.limit(0)).classes[0] == C.UNKNOWN


def test_licence_bound_leaves_nothing_out_and_recall(spark):
    import textwrap

    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(300).collect()]
    model = C.Classifier(sorted({x.split("\n")[0][:400] for x in texts if not C.MARKS.search(x)}))
    # The bound never hides a unit that all classes' numbers would accept.
    units = C.Units([x.encode() for x in texts] + [t.encode() for own in C.TEXTS.values() for t in own])
    z = model.logits(units) / model.temperature
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    every = np.flatnonzero((p.argmax(1) > 0) & (p.max(1) >= C.LEAST))
    assert set(every) == set(model.classify(units)[0])
    # Headers broken at other widths than any that was trained on, set among other lines.
    rng, hit, n = random.Random(5), 0, 0
    for family, own in C.TEXTS.items():
        for text in own:
            for width in (48, 66, 80):
                lines = textwrap.wrap(text, width)
                at = rng.randrange(max(1, len(lines) - 5))
                doc = "\n".join([rng.choice(texts).split("\n")[0][:200], *(f" * {x}" for x in lines[at : at + 6]), "the end of it"])
                hit += any(x["family"] == family and x["confirmed"] for x in C.find(model, [doc.encode()])[0])
                n += 1
    assert hit >= 0.95 * n
    # Of the corpus nothing is confirmed but lines that name a licence, and of these each is told.
    for text, own in zip(texts, C.find(model, [x.encode() for x in texts])):
        rows = text.split("\n")
        assert all(C.MARKS.search("\n".join(rows[x["line"] : x["last"] + 1])) for x in own if x["confirmed"])
        assert {k for k, row in enumerate(rows) if C.MARKS.search(row)} <= {k for x in own for k in range(x["line"], x["last"] + 1)}


PAGE = """<html><body><div class="top-bar"><a href=x>Home</a></div><header><h1>Site</h1></header><div id="sidebar"><p>Side text, long and wide</p></div>
<main><article class="post-{n}"><div class="post-header"><h1>Title &amp; more</h1></div><p>First para <b>bold</b> text<p>Second   para<br>line &lt;x&gt;</p><ul><li>One<li>Two</ul>
<div class="share-buttons">Share</div><script>if (a < b) document.write("<p>no</p>")</script><form><p>Your mail</p></form></article>
<section class="comments"><p>Nice article! I agree with all that was said in it and more.</p></section></main><div class="cookie-notice">We use cookies</div><footer>foot</footer>"""


def test_main_text(spark):
    want = "Title & more\nFirst para bold text\nSecond para line <x>\nOne\nTwo"
    odd = "<html><body><div class=x><p>short</p></div></body></html>"
    rows = [(k, "http://a.example/1", PAGE.replace("{n}", str(k))) for k in range(3)] + [(10, "http://a.example/2", odd), (11, None, None), (12, "http://b.example", ""), (13, "http://b.example", "just text"), (None, "http://a.example/1", "<p>a<p>b")]
    got = {r.page_id: r.text for r in M.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[k] for k in range(3)] == [want] * 3
    assert got[10] == "short" and got[11] == "" and got[12] == "" and got[13] == "just text" and got[None] == "a\nb"
    paths = {r.host: r.path for r in M.host_paths(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert paths["a.example"] == next(x.path for x in M.blocks(PAGE.replace("{n}", "1"))[0] if x.tag == "article")
    assert M.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_main_text_without_inline_boilerplate():
    page = '<body><nav>menu</nav><article><p>First <b>bold</b> text, long enough.</p><button>Buy</button><label>Name <b>x</b></label><select><option>One</select><p>More <span class="ad">AD <span>x</span></span> text <i hidden>no</i> here.<p>Last <em>one</em></article><form>f</form>'
    assert M.text_of(page, None) == "First bold text, long enough.\nMore text here.\nLast one"
    assert M.text_of("<article><p>kept <button>gone</p><p>after the block</article>", None) == "kept\nafter the block"


def test_malformed_pages_take_linear_time():
    from time import perf_counter

    for page in ("<a " * 350_000, "<div>word " * 100_000, "<a '" * 100_001 + ">", "<div>" * 50_000 + "<tr></tr>" * 50_000, "<div>" * 50_000 + "x</span></b>" * 50_000, "<p class='" * 100_000, "< " * 300_000 + ">"):
        began = perf_counter()
        M.text_of(page, None)
        assert perf_counter() - began < 10


def judge_by_force(urls):
    from math import log

    def rule(url):
        i = (url or "").find("://")
        rest = url[i + 3 :] if url and i >= 0 else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = rest[:cut].lower(), rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
        fits = [(len(r), r, v) for r, v in U.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.partition("/")[2])]
        return host, path, *(max(fits)[1:] if fits else (None, None))

    import re
    import zlib

    def fold(url):
        t = re.sub(r"[0-9]+", "0", (url or "").lower())
        t = re.sub(r"[?=&#:_%+;]", "?", t)
        return "^^^" + re.sub(r"[^a-z0/.?-]", "~", t) + "$"

    grams = lambda t: [t[k : k + 4] for k in range(len(t) - 3)]
    held = lambda u: zlib.crc32((u or "").encode()) % 5 == 0
    counts = {v: Counter(g for u in urls if rule(u)[3] == v and not held(u) for g in grams(fold(u))) for v in ("allow", "block")}

    def tables(c):
        out = []
        for k in range(4):
            own, total, kinds = Counter(), Counter(), defaultdict(set)
            for g, n in c.items():
                own[g[3 - k :]] += n
                total[g[3 - k : 3]] += n
                kinds[g[3 - k : 3]].add(g[3])
            out.append((own, total, kinds))
        return out

    models = {v: tables(c) for v, c in counts.items()}

    def p(g, model):
        x = 1 / U.SYMBOLS
        for k, (own, total, kinds) in enumerate(model):
            ctx = g[3 - k : 3]
            if total[ctx]:
                x = (own[g[3 - k :]] + len(kinds[ctx]) * x) / (total[ctx] + len(kinds[ctx]))
        return x

    score = lambda u: sum(log(p(g, models["allow"])) - log(p(g, models["block"])) for g in grams(fold(u))) / len(grams(fold(u)))
    known = {v: [score(u) for u in urls if held(u) and rule(u)[3] == v] for v in ("allow", "block")}
    (ma, sa), (mb, sb) = ((np.mean(x), np.std(x, ddof=1)) for x in (known["allow"], known["block"]))
    t = (ma * sb + mb * sa) / (sa + sb)
    return {u: (*rule(u)[:3], rule(u)[3] or ("allow" if score(u) >= t else "block"), score(u) - t) for u in urls}


def test_url_filter_matches_brute_force(spark):
    urls = [r.url for r in spark.read.parquet(f"{SF}/pages.parquet").select("url").collect()]
    urls += [None, "", "no scheme", "http://NET", "http://a.NET/x", "https://Example.net/en/1?q=/de/", "http://x.example.com?u=/de/", "ftp://fr.org/fr/", "http://notnet/", "http://ü.example.org/fr"]
    got = {r.page_id: r for r in U.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    want = judge_by_force(urls)
    for k, u in enumerate(urls):
        host, path, rule, verdict, score = want[u]
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule)
        assert math.isclose(got[k].score, score, abs_tol=1e-9) and (got[k].verdict == verdict or abs(score) < 1e-9)


def test_url_filter_of_awkward_tables(spark):
    twice = spark.createDataFrame([(1, "http://a.net/"), (1, "http://a.net/"), (None, None)], "page_id long, url string")
    rows = U.judge(twice).collect()
    assert len(rows) == 3 and {(r.page_id, r.rule, r.verdict) for r in rows} == {(1, "net/", "block"), (None, None, "allow")}
    assert U.judge(twice.limit(0)).count() == 0


def test_url_filter_is_native(spark):
    import re

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    assert not re.search(r"Python|Pandas|Arrow", U.score_rows(pages)._jdf.queryExecution().executedPlan().toString())

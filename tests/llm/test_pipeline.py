import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fleetscope.llm import decontam, exact_dedup, nearcopies, packing, quality, simhash
from tests.llm.test_nearcopies import kept_by_force
from tests.llm.test_text import decontaminate_by_force, kneser_ney_by_force

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    read = lambda t: spark.read.parquet(f"{SF}/{t}.parquet").toPandas()
    return read("documents"), read("labels"), read("benchmark")


def test_run_matches_brute_force(spark, tables):
    docs, labels, bench = tables
    trusted = set(labels.doc_id[labels.quality == 1])
    own = {r.doc_id for r in spark.createDataFrame(docs[["doc_id", "text"]]).where(quality._held_back(F.col("text"))).select("doc_id").collect()}
    held = docs.doc_id.isin(own).to_numpy()
    p = kneser_ney_by_force([t for d, t in zip(docs.doc_id, docs.text) if d in trusted and d not in own], quality.ORDER)
    logs = [np.log(p(t)) for t in docs.text]
    x, n = np.array([-v.mean() for v in logs]), np.array([len(v) for v in logs])
    away, low, high = np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x))
    is_trusted = docs.doc_id.isin(trusted).to_numpy()
    for lang in set(docs.lang):
        own = (docs.lang == lang).to_numpy()
        base = own & is_trusted if (own & is_trusted).sum() >= quality.LEAST_TRUSTED else is_trusted
        least = 1 if base is is_trusted else quality.LEAST_TRUSTED
        upper = base & held if (base & held).sum() >= least else base
        middle = np.sort(x[upper])[(upper.sum() + 1) // 2 - 1]
        a = (x - middle) * n / (n + quality.PRIOR)
        away[own], low[own], high[own] = a[own], a[base].min() - quality.MARGIN, a[upper].max() + quality.MARGIN
    assert min(np.abs(away - low).min(), np.abs(away - high).min()) > 1e-6
    kept = docs[(away >= low) & (away <= high)]
    assert 0.5 < len(kept) / len(docs) < 1
    best = {}
    for d, t in zip(kept.doc_id, kept.text):
        key = exact_dedup.digest(t.encode())
        best[key] = max(best.get(key, d), d)
    kept = kept[kept.doc_id.isin(set(best.values()))]
    kept = kept[kept.doc_id.isin(kept_by_force(list(zip(kept.doc_id, kept.text))))]
    hits = decontaminate_by_force(list(zip(kept.doc_id, kept.text)), list(zip(bench.item_id, bench.text)))
    kept = kept[[hits[d][1] == 0 for d in kept.doc_id]]

    got = corpus_pipeline.run(spark, SF).toPandas()
    assert set(got.doc_id) == set(kept.doc_id)
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for d, t in zip(kept.doc_id, kept.text):
        ids = np.array(plain.encode(t, add_special_tokens=False).ids + [2], dtype="<u4")
        own = got[got.doc_id == d].sort_values("piece")
        assert [zlib.crc32(ids[a : a + k].tobytes()) for a, k in zip(own.start, own.length)] == own.ids_crc32.tolist()
        assert own.length.sum() == len(ids)
    used = defaultdict(list)
    for r in got.itertuples():
        used[r.sequence_id].append((r.offset, r.length))
    for own in used.values():
        assert [o for o, _ in sorted(own)] == np.cumsum([0, *(k for _, k in sorted(own))])[:-1].tolist() and sum(k for _, k in own) <= 1024


def test_stages_keep_columns_and_take_awkward_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "a b c d e f", None, "s", 11), (2, "a b c d e f", None, "s", 11), (3, "word " * 40_000, "en", None, 200_000)]
    for table in (rows, []):
        docs = spark.createDataFrame(table, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, SF).columns == docs.columns
            stage(spark, docs, SF).collect()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= len(table)


CLASHING = ("_id", "_key", "_rows", "_hash", "root", "_hits", "hits", "_text_hash", "_text_key", "id", "key", "rows", "hash", "node", "n", "text_hash", "TEXT_KEY", "b", "more", "x", "stays", "doc_id_", "block", "trusted_id")


def test_stages_keep_columns_of_any_name(spark):
    rows = [(1, "a b c d e f g", "en"), (2, "A b c d e f g", "en"), (3, "a b c d e f g h i j k l m n o p q r s t u v w x y", "en"), (4, "a b c d e f g h i j k l m n o p q r s t u v w x z", "en"), (5, None, None)]
    docs = spark.createDataFrame([(*r, *(f"{c}{r[0]}" for c in CLASHING)) for r in rows], f"doc_id long, text string, lang string, {', '.join(f'`{c}` string' for c in CLASHING)}")
    trusted = docs.select("doc_id")
    kept = [quality.keep_accepted(docs, trusted), exact_dedup.deduplicate(docs), nearcopies.deduplicate(docs), simhash.deduplicate(docs), decontam.remove_documents(docs, spark.createDataFrame([(1, "y x w v")], "item_id long, text string")), decontam.remove_spans(docs, spark.createDataFrame([(1, "z")], "item_id long, text string"))]
    for df in kept:
        assert df.columns == docs.columns
        for r in df.collect():
            assert all(r[c] == f"{c}{r.doc_id}" for c in CLASHING)
    assert [sorted(r.doc_id for r in df.collect()) for df in kept[1:3]] == [[2, 3, 4, 5], [1, 3, 5]]
    assert len({r.doc_id for r in packing.pack(docs).collect()}) == 5

"""Ranked lexical search: the terms of all queries, counted in each document by one scan of an Aho-Corasick automaton.

Terms are runs of ASCII letters and digits and of non-ASCII characters, after lower-casing
A-Z. In a document everything else becomes a space, and the automaton, which is
broadcast, knows each term with a space on both sides, so that it finds whole terms only;
neighbours share a space, as the automaton finds matches that overlap. It gives the
numbers of the terms, which a table leads to the items that have them. Documents have
no index: one scan gives the counts over all of them (documents, terms, document
frequencies), a second one the scores.

A scan keeps each item's ``k`` best documents of a task, ``FAN_IN`` tasks' lists are merged to one
of ``k``, and these to the result, so no item's candidates grow with the documents of a task.

Items come in blocks of about ``BLOCK`` pairs of item and term, each with its own automaton
and scans; what is broadcast and collected is one block.

Weights and scores are 64-bit integers, as stated at ``score``.

Edge cases: a null text has no terms; documents without terms count for nothing; an
item without terms, or whose terms no document has, has no rows; items and documents
whose ids repeat are ranked row by row; null document ids rank last among equal scores;
empty tables give an empty result; further columns, of any name, are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetscope.llm.common import ASCII_UPPER, checkpointed, id_text, shards, slices, text_bytes

K = 50
BLOCK = 65_536
FAN_IN = 64
#: Cells of a scan's table of (item, term) pairs by documents.
CELLS = 1 << 22
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_KEPT = bytes(c for c in range(256) if c >= 128 or chr(c).isalnum())
_TO_TERMS = bytes(c + 32 if chr(c) in ASCII_UPPER else c if c in _KEPT else 32 for c in range(256))
_SECOND = itemgetter(1)


def term_text(text: bytes) -> bytes:
    """The text's terms in lower case, with spaces around them."""
    return b" " + text.translate(_TO_TERMS) + b" "


def item_terms(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item, terms``: each item's distinct terms; items without any are left out."""
    low = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), ASCII_UPPER, ASCII_UPPER.lower())
    return items.select(F.col(item_col).alias("item"), F.array_sort(F.array_distinct(F.regexp_extract_all(low, F.lit(TERM), 0))).alias("terms")).where(F.size("terms") > 0)


class TermScan:
    """The automaton of a block of items, and which terms each item has."""

    def __init__(self, items: list[list[str]]):
        import ahocorasick

        self.terms = sorted({t for terms in items for t in terms})
        number = {t: k for k, t in enumerate(self.terms)}
        self.pairs = np.array([number[t] for terms in items for t in terms], dtype=np.int64)
        self.first = np.r_[0, np.cumsum([len(x) for x in items])][:-1].astype(np.int64)
        self.n_items = len(items)
        # Bytes as characters of the same codes.
        self.automaton = ahocorasick.Automaton()
        for t, k in number.items():
            self.automaton.add_word(f" {t} ".encode().decode("latin-1"), k)
        self.automaton.make_automaton()

    def counts(self, text: bytes) -> tuple[Counter, int]:
        """How often each term (by number) occurs, and the number of all terms of the text."""
        own = term_text(text)
        return Counter(map(_SECOND, self.automaton.iter(own.decode("latin-1")))), len(own.split())


def totals(docs: DataFrame, scan, n_terms: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all documents' terms, and in how many documents each of the automaton's terms is."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, df, n_docs, n_all = scan.value, Counter(), 0, 0
        for batch in batches:
            for part in slices(batch):
                for text in text_bytes(part.column("text")):
                    found, n = own.counts(text)
                    df.update(found.keys())
                    n_docs += n > 0
                    n_all += n
        keys = [-1, -2, *df]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([n_docs, n_all, *df.values()], pa.int64())], ["term", "n"])

    found = docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(n_terms + 2, dtype=np.int64)
    df[found["term"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return int(df[-1]), int(df[-2]), df[:n_terms]


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    """floor(1000 ln((2 N + 2) / (2 df + 1))), in doubles."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], dtype=np.int64)


class _Best:
    """Each item's ``k`` best documents so far: by score, then by id, null ids last."""

    def __init__(self, n_items: int, k: int):
        self.k, self.least = k, np.zeros(n_items, dtype=np.int64)
        self.item = self.score = self.doc = np.zeros(0, dtype=np.int64)
        self.none = np.zeros(0, dtype=bool)

    def add(self, scores: np.ndarray, doc: np.ndarray, none: np.ndarray) -> None:
        """``scores``: items by documents."""
        item, at = np.nonzero((scores >= self.least[:, None]) & (scores > 0))
        self.item, self.score = np.r_[self.item, item], np.r_[self.score, scores[item, at]]
        self.doc, self.none = np.r_[self.doc, doc[at]], np.r_[self.none, none[at]]
        if len(self.item) > 2 * self.k * len(self.least):
            self.cut()

    def cut(self) -> None:
        order = np.lexsort((self.doc, self.none, -self.score, self.item))
        item = self.item[order]
        first = np.searchsorted(item, np.arange(len(self.least)))
        place = np.arange(len(item)) - first[item]
        stay = order[place < self.k]
        last = order[place == self.k - 1]
        self.least[self.item[last]] = self.score[last]
        self.item, self.score, self.doc, self.none = (x[stay] for x in (self.item, self.score, self.doc, self.none))


def score(docs: DataFrame, scan, weight: np.ndarray, n_docs: int, n_all: int, k: int = K) -> DataFrame:
    """``item, doc_id, score``: the ``k`` best of each task.

    A document of n terms has m = 50 + (50 n N) div L, and a term that occurs tf times in it
    adds w ((1000000000 tf) div (1000 tf + 20 m)) to the score of each item that has the term.
    """

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, (ids, none, terms, tf, many, m) = scan.value, ([] for _ in range(6))
        best, at_once = _Best(own.n_items, k), max(16, CELLS // max(len(own.pairs), 1))

        def settle() -> None:
            of = np.repeat(np.arange(len(ids)), many)
            t, f = np.array(terms, dtype=np.int64), np.array(tf, dtype=np.int64)
            added = np.zeros((len(own.terms), len(ids)), dtype=np.int64)
            added[t, of] = weight[t] * ((1_000_000_000 * f) // (1000 * f + 20 * np.array(m, dtype=np.int64)[of]))
            best.add(np.add.reduceat(added[own.pairs], own.first, axis=0), np.array(ids, dtype=np.int64), np.array(none, dtype=bool))
            for x in (ids, none, terms, tf, many, m):
                x.clear()

        for batch in batches:
            for part in slices(batch):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), text_bytes(part.column("text"))):
                    found, n = own.counts(text)
                    if found:
                        ids.append(doc_id or 0)
                        none.append(doc_id is None)
                        terms.extend(found.keys())
                        tf.extend(found.values())
                        many.append(len(found))
                        m.append(50 + 50 * n * n_docs // n_all)
                        if len(ids) >= at_once:
                            settle()
        if ids:
            settle()
        best.cut()
        yield pa.RecordBatch.from_arrays([pa.array(best.item, pa.int64()), pa.array(best.doc, pa.int64(), mask=best.none), pa.array(best.score, pa.int64())], ["item", "doc_id", "score"])

    return docs.mapInArrow(rank, "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = K, block: int = BLOCK) -> DataFrame:
    """``item_id, rank, doc_id, score``: of each item the ``k`` documents with the highest score above 0."""
    spark, kind = docs.sparkSession, items.schema[item_col].dataType.simpleString()
    docs = id_text(docs, id_col, text_col)
    wanted = checkpointed(item_terms(items, item_col, item_text_col))
    pairs = wanted.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = shards(pairs, block, 1)
    found = None
    for b in range(blocks):
        own = wanted if blocks == 1 else wanted.where(F.pmod(F.xxhash64("item", "terms"), F.lit(blocks)) == b)
        rows = own.collect()
        if not rows:
            continue
        terms = TermScan([x["terms"] for x in rows])
        scan = spark.sparkContext.broadcast(terms)
        n_docs, n_all, df = totals(docs, scan, len(terms.terms))
        best = score(docs, scan, weights(n_docs, df), n_docs, n_all, k).withColumn("part", F.floor(F.spark_partition_id() / FAN_IN))
        for by in (["item", "part"], ["item"]):
            order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
            best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, x["item"]) for i, x in enumerate(rows)], f"item long, item_id {kind}")
        best = best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        if blocks > 1:
            best = checkpointed(best)
            scan.unpersist()
        found = best if found is None else found.unionByName(best)
    return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long") if found is None else found

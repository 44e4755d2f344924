"""Toxicity scores from subword-bag embeddings averaged into a linear softmax.

A text is the bag of its words and their character n-grams, each hashed to an
embedding; the mean embedding goes into a two-class softmax. Embeddings and softmax
are trained together in numpy (Adam on minibatches). A misspelt word that was never
seen shares most of its n-grams' vectors with the word meant.

A mean and a linear layer commute, so scoring looks up one number a subword, the
embedding times the softmax weights, and averages those over the whole text.

Edge cases: a null or empty text, or one without words, gets the share of label 1
among the rows learnt from; without rows to learn from all scores are 0; ids may be
null or repeat; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.common import checkpointed, id_text, slices, text_bytes
from fleetscope.llm.ngrams import WORD_BYTES, hashed, laid_out

SAMPLE, SAMPLE_BYTES = 10_000, 192 << 20
SIZES = (3, 4, 5)
BUCKETS = 1 << 16
WIDTH = 8
ROUNDS = 14
RATE = 0.03
DECAY = 2e-4
BATCH = 128
_STEP = np.uint64(0x100000001B3)


def subwords(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and their n-grams, with the word's ends marked, and the text of each."""
    codes, of = laid_out(texts, WORD_BYTES)
    blank = codes == 32
    found, whose = [], []
    for size in SIZES:
        at = hashed(codes, size, BUCKETS, size)
        n = len(at)
        inside = np.ones(n, dtype=bool)
        for k in range(1, size - 1):
            inside &= ~blank[k : k + n]
        inside &= of[:n] == of[size - 1 :]
        found.append(at[inside])
        whose.append(of[:n][inside])
    start = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    end = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    if len(start):
        powers = np.cumprod(np.r_[np.uint64(1), np.full(63, _STEP)], dtype=np.uint64)
        place = np.arange(len(codes)) - start[np.maximum(np.searchsorted(start, np.arange(len(codes)), side="right") - 1, 0)]
        mixed = np.where(blank, np.uint64(0), (codes.astype(np.uint64) + np.uint64(1)) * powers[place % 64])
        word = np.add.reduceat(mixed, start)
        word ^= word >> np.uint64(33)
        word *= np.uint64(0xFF51AFD7ED558CCD)
        found.append((word >> np.uint64(48)).astype(np.int32))
        whose.append(of[start])
    assert len(start) == len(end)
    return np.concatenate(found), np.concatenate(whose)


def bags(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct buckets and their shares."""
    at, of = subwords(texts)
    key, n = np.unique(of.astype(np.int64) * BUCKETS + at, return_counts=True)
    cut = np.searchsorted(key, np.arange(len(texts) + 1) * BUCKETS)
    return [((key[a:b] % BUCKETS).astype(np.uint16), (n[a:b] / max(1, n[a:b].sum())).astype(np.float32)) for a, b in zip(cut[:-1], cut[1:])]


class SubwordSoftmax:
    """``logit[bucket]``: what a subword adds to the log-odds of label 1 before averaging; ``base``: the log-odds without any."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 11):
        draw = np.random.default_rng(seed)
        table = draw.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
        softmax = draw.normal(0, 0.5, (WIDTH, 2)).astype(np.float32)
        share = min(max(float(labels.mean()), 1e-3), 1 - 1e-3)
        bias = np.log(np.array([1 - share, share], dtype=np.float32))
        self.empty = float(np.log(share / (1 - share)))
        params = [table, softmax, bias]
        first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        scale = np.float32(30.0)
        for turn in range(ROUNDS):
            rate = RATE * (1 - turn / ROUNDS)
            order = draw.permutation(len(rows))
            for a in range(0, len(order), BATCH):
                own = [k for k in order[a : a + BATCH] if len(rows[k][0])]
                if not own:
                    continue
                at = np.concatenate([rows[k][0] for k in own]).astype(np.int64)
                weight = np.concatenate([rows[k][1] for k in own]) * scale
                cut = np.cumsum([0, *(len(rows[k][0]) for k in own)])
                mean = np.add.reduceat(table[at] * weight[:, None], cut[:-1], axis=0)
                z = mean @ softmax + bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(own)), labels[own]] -= 1
                p /= len(own)
                back = np.repeat(p @ softmax.T, np.diff(cut), axis=0) * weight[:, None]
                grad = np.stack([np.bincount(at, weights=back[:, k], minlength=BUCKETS) for k in range(WIDTH)], axis=1).astype(np.float32)
                step += 1
                for k, g in enumerate((grad + DECAY * table, mean.T @ p + DECAY * softmax, p.sum(0))):
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    params[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        self.logit = (table @ (softmax[:, 1] - softmax[:, 0])) * scale
        self.base = float(bias[1] - bias[0])

    def scores(self, texts: list[bytes]) -> np.ndarray:
        at, of = subwords(texts)
        n = np.bincount(of, minlength=len(texts))
        z = np.bincount(of, weights=self.logit[at], minlength=len(texts)) / np.maximum(n, 1) + self.base
        return 1 / (1 + np.exp(-np.clip(np.where(n > 0, z, self.empty), -30, 30)))


def learn(docs: DataFrame, labels: DataFrame, learn_from, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_bytes: int = SAMPLE_BYTES) -> SubwordSoftmax | None:
    """The model from labelled rows where ``learn_from`` holds: those whose ids have the least hashes, at most ``sample`` rows and ``most_bytes`` of subword bags.

    Of rows that share an id, the largest label and the least text count.
    """
    known = labels.where(F.col(label_col).isNotNull() & learn_from).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("id IS NOT NULL")
    known = known.groupBy("id").agg(F.max("label").alias("label")).withColumn("rank", F.xxhash64("id", F.lit(5))).orderBy("rank", "id").limit(sample)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    chosen = texts.join(F.broadcast(known), "id").groupBy("id", "label", "rank").agg(F.min("text").alias("text"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=1 << 18):
                own = bags(text_bytes(part.column("text")))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("id", "label", "rank")), pa.array([x.tobytes() for x, _ in own], pa.binary()), pa.array([w.astype(np.float16).tobytes() for _, w in own], pa.binary())], ["id", "label", "rank", "at", "weight"])

    rows = checkpointed(chosen.mapInArrow(vectors, "id long, label int, rank long, at binary, weight binary"))
    sizes = sorted((x["rank"], x["id"], x["size"]) for x in rows.select("rank", "id", (F.length("at") + F.length("weight")).alias("size")).collect())
    upto = int(np.searchsorted(np.cumsum([x[2] for x in sizes]), most_bytes, side="right"))
    if not upto:
        return None
    rank, last, _ = sizes[upto - 1]
    found = []
    for row in rows.where(F.struct("rank", "id") <= F.struct(F.lit(rank).cast("long").alias("rank"), F.lit(last).cast("long").alias("id"))).toLocalIterator():
        found.append((row["id"], int(row["label"] > 0), np.frombuffer(bytes(row["at"]), np.uint16), np.frombuffer(bytes(row["weight"]), np.float16).astype(np.float32)))
    found.sort(key=lambda x: x[0])
    return SubwordSoftmax([(x[2], x[3]) for x in found], np.array([x[1] for x in found]))


def score(docs: DataFrame, model: SubwordSoftmax | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in slices(batch):
                texts = text_bytes(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.scores(texts) if model else np.zeros(len(texts)), pa.float64())], ["doc_id", "score"])

    return id_text(docs, id_col, text_col).mapInArrow(judged, "doc_id long, score double")

"""Language identification by hierarchical discrimination.

A linear one-versus-rest layer predicts the language family first; inside a family
one-versus-one linear support vector machines vote for the language. Features are
hashed byte n-grams of the lower-cased letters, as shares of all n-grams of their
size, so every length of text is on one scale. The machines are trained by dual
coordinate descent on a sample of at most ``SAMPLE`` rows a language and about
``SAMPLE_IN_ALL`` rows in all, those with the least hashes, of the ``LANGS`` languages
with most rows.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; languages
outside the family table are families of their own; with nothing to learn from all
rows are ``und``; ids may be null or repeat; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.common import id_text, slices, text_bytes
from fleetscope.llm.ngrams import LETTERS, hashed, laid_out

SAMPLE, SAMPLE_IN_ALL, LANGS = 500, 6000, 200
SIZES = (2, 3, 4)
BUCKETS = 2048
SCALE = 40.0
#: Families of common languages by ISO 639-1 code.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af",
    "romance": "fr es it pt ro ca gl",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz",
    "indic": "hi mr ne bn gu pa",
    "semitic": "ar he mt am",
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}
_LETTER = regex.compile(r"\p{L}")


def features(texts: list[bytes]) -> np.ndarray:
    """A row for each text: shares of the hashed n-grams, one block of columns a size."""
    codes, of = laid_out(texts, LETTERS)
    blocks = []
    for size in SIZES:
        at, who = _grams(codes, of, size)
        counts = np.bincount(who * BUCKETS + at, minlength=len(texts) * BUCKETS).reshape(len(texts), BUCKETS)
        blocks.append(counts / np.maximum(counts.sum(1, keepdims=True), 1))
    return (np.concatenate(blocks, axis=1) * SCALE).astype(np.float32)


def _grams(codes: np.ndarray, of: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of n-grams that lie in one text and hold at least two letters' bytes side by side."""
    at = hashed(codes, size, BUCKETS, size)
    n = len(at)
    letter = codes != 32
    inside = (of[:n] == of[size - 1 :]) & (letter[:n] | letter[1 : n + 1])
    return at[inside], of[:n][inside]


def train_svm(x: np.ndarray, y: np.ndarray, cost: float = 1.0, rounds: int = 10, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear support vector machine (hinge loss); ``y`` is -1 or 1."""
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1)
    w, alpha, norm = np.zeros(x.shape[1], np.float32), np.zeros(len(x)), (x * x).sum(1) + 1e-12
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(x)):
            step = np.clip(alpha[i] - (y[i] * (x[i] @ w) - 1) / norm[i], 0, cost) - alpha[i]
            if step:
                alpha[i] += step
                w += np.float32(step * y[i]) * x[i]
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w[:-1], float(w[-1])


def calibrated(margin: np.ndarray, y: np.ndarray) -> float:
    """Slope of a logistic curve over the margins."""
    slope = 1.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * margin, -30, 30)))
        gradient = ((p - (y > 0)) * margin).mean() + 1e-3 * (slope - 2)
        curve = (p * (1 - p) * margin**2).mean() + 1e-3
        slope = float(np.clip(slope - gradient / curve, 0.1, 10))
    return slope


class Hierarchy:
    """Families, their languages, and the columns of weights: one a family, then one a pair of languages in a family."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        own = np.array(langs)
        family = np.array([FAMILY_OF.get(lang, lang) for lang in langs])
        self.families = sorted(set(family.tolist()))
        self.members = {f: [g for g in self.langs if FAMILY_OF.get(g, g) == f] for f in self.families}
        columns, self.pairs = [], []
        if len(self.families) > 1:
            columns += [self._column(x, np.where(family == f, 1.0, -1.0)) for f in self.families]
        for f in self.families:
            for a, b in combinations(self.members[f], 2):
                rows = (own == a) | (own == b)
                self.pairs.append((a, b))
                columns.append(self._column(x[rows], np.where(own[rows] == a, 1.0, -1.0)))
        width = len(SIZES) * BUCKETS
        self.weights = np.stack([c[0] for c in columns], axis=1).astype(np.float32) if columns else np.zeros((width, 0), np.float32)
        self.bias = np.array([c[1] for c in columns])
        self.slope = np.array([c[2] for c in columns])

    @staticmethod
    def _column(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float, float]:
        w, b = train_svm(x, y)
        return w, b, calibrated(x @ w + b, y)

    def margins(self, texts: list[bytes]) -> np.ndarray:
        """Margin of each column for each text, without a matrix of features."""
        codes, of = laid_out(texts, LETTERS)
        out = np.tile(self.bias, (len(texts), 1))
        for block, size in enumerate(SIZES):
            at, who = _grams(codes, of, size)
            n = np.maximum(np.bincount(who, minlength=len(texts)), 1)
            for k in range(self.weights.shape[1]):
                weight = self.weights[block * BUCKETS : (block + 1) * BUCKETS, k]
                out[:, k] += np.bincount(who, weights=weight[at], minlength=len(texts)) / n * SCALE
        return out

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        """Family first, then the language with most votes in it; the score is the two steps' joint probability."""
        p = 1 / (1 + np.exp(-np.clip(self.margins(texts) * self.slope, -30, 30)))
        many = len(self.families) if len(self.families) > 1 else 0
        families = p[:, :many] / np.maximum(p[:, :many].sum(1, keepdims=True), 1e-9) if many else np.ones((len(texts), 1))
        first = families.argmax(1)
        langs, scores = np.empty(len(texts), dtype=object), families.max(1)
        for f, name in enumerate(self.families):
            rows, own = np.flatnonzero(first == f), self.members[name]
            votes, share = np.zeros((len(rows), len(own))), np.zeros((len(rows), len(own)))
            for k, (a, b) in enumerate(self.pairs):
                if a in own:
                    x = p[rows, many + k]
                    i, j = own.index(a), own.index(b)
                    votes[:, i] += x >= 0.5
                    votes[:, j] += x < 0.5
                    share[:, i] += x
                    share[:, j] += 1 - x
            if len(own) > 1:
                best = (votes + share / (len(own) + 1)).argmax(1)
                scores[rows] *= share[np.arange(len(rows)), best] / (len(own) - 1)
            else:
                best = np.zeros(len(rows), dtype=int)
            langs[rows] = [own[k] for k in best]
        return langs.tolist(), scores


def learn(docs: DataFrame, learn_from, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Hierarchy | None:
    """The hierarchy from rows where ``learn_from`` holds; some ``sample`` rows a language, chosen by a hash of the id."""
    rows = docs.where(learn_from & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    counts = rows.groupBy(F.col(lang_col).cast("string").alias("lang")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGS)
    counts = {x["lang"]: x["n"] for x in counts.collect()}
    if not counts:
        return None
    sample = max(20, min(sample, SAMPLE_IN_ALL // len(counts)))
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col(lang_col) == lang, F.lit(min(1.0, 1.3 * sample / n))).otherwise(share)
    rank = F.xxhash64(F.col(id_col), F.col(text_col), F.lit(3))
    chosen = rows.where(F.pmod(rank, F.lit(1 << 20)) < share * (1 << 20))
    chosen = chosen.select(F.col(lang_col).cast("string").alias("lang"), F.pmod(rank, F.lit(1 << 20)).alias("rank"), F.col(text_col).cast("string").alias("text"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=1 << 18):
                yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("rank"), pa.array([v.tobytes() for v in features(text_bytes(part.column("text"))).astype(np.float16)], pa.binary())], ["lang", "rank", "v"])

    found: dict[str, list[tuple[int, bytes]]] = {}
    for row in chosen.mapInArrow(vectors, "lang string, rank long, v binary").toLocalIterator():
        found.setdefault(row["lang"], []).append((row["rank"], bytes(row["v"])))
    found = {lang: sorted(own)[:sample] for lang, own in found.items()}
    langs = [lang for lang in sorted(found) for _ in found[lang]]
    x = np.stack([np.frombuffer(v, dtype=np.float16) for lang in sorted(found) for _, v in found[lang]]).astype(np.float32)
    return Hierarchy(x, langs)


def identify(docs: DataFrame, model: Hierarchy | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text").to_pylist()
                langs, scores = model.predict([x.lower().encode() for x in texts]) if model else (["und"] * len(texts), np.zeros(len(texts)))
                letter = np.array([bool(_LETTER.search(x)) for x in texts], dtype=bool)
                langs = [lang if known else "und" for lang, known in zip(langs, letter)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(langs, pa.string()), pa.array(np.where(letter, scores, 0.0))], ["doc_id", "lang_pred", "score"])

    return id_text(docs, id_col, text_col).mapInArrow(predict, "doc_id long, lang_pred string, score double")

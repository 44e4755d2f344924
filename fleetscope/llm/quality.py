"""Quality classifier: perplexity under an interpolated modified Kneser-Ney n-gram model of trusted text.

Symbols are the bytes of the text; white space counts as one space, and a word that
repeats the word before it is one symbol of its own, so that drumming one word does
not pass for fluent text. The model has orders 1 to ``ORDER``; contexts span words, and
the tables of the upper orders grow with the corpus. Counts, and the continuation counts
of the lower orders, are aggregated in Spark over the trusted text of four folds of
five, and each order's probabilities come from joins of those tables on context and
suffix. Of the model only the orders up to ``LOCAL`` are broadcast, which have at most 2^24
n-grams whatever the corpus.

Scoring: texts are dealt out, some at a time and in turn, to blocks of about
``BLOCK_BYTES``, so that neither an id nor a text decides how much a block holds. Each
block's distinct n-grams are looked up by joins against the count tables, shard by
shard, and come back to the block, where the documents take them up. What is moved is a
block's distinct n-grams, not its tokens. Log-probabilities per symbol give the perplexity.

Per language, quantiles of trusted documents, widened by a margin, are the bounds of
what is accepted: both what the model finds too surprising and what it finds too
predictable go. Median and upper bound come from the fold that the model has not
counted, the lower bound from all trusted documents, as the counted ones, and whatever
repeats them, are the most predictable of clean texts. Languages with under
``LEAST_TRUSTED`` such documents share the bounds of all.

Edge cases: a text without symbols has no perplexity (null) and is accepted if
``accept_empty``; a null or rare language is judged by the bounds of all; without
trusted text everything is accepted; with too little for a fold of its own, bounds come
from what the model has counted; rows that repeat are scored each; further columns, of
any name, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.common import LEAST_FILES, ROWS_PER_FILE, broadcast_if_small, checkpointed, distinct_counts, flat, id_text, shards, slices, text_bytes, unused

ORDER, LOCAL = 5, 3
REPEAT = 1
BLOCK_BYTES, LEAST_BLOCKS, DEALT_BYTES = 64 << 20, 12, 1 << 20
FOLDS = 5
FLUSH = 1 << 22
#: Bytes of text whose n-grams are made at a time: they take some seventy times as much.
PART_BYTES, PARTS = 1 << 18, 32
LOW, HIGH, MARGIN = 0.001, 0.999, 0.15
PRIOR = 30
LEAST_TRUSTED = 50
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts end to end, each text with one space before it; their offsets; and for each word that repeats the one before it the place of the last symbol of the word it repeats. Repeats themselves are left out."""
    data, offsets = flat([b" " + x for x in texts])
    space = _SPACE[data]
    start = np.flatnonzero(~space & np.r_[True, space[:-1]])
    end = np.flatnonzero(~space & np.r_[space[1:], True]) + 1
    keep = np.ones(len(data), dtype=bool)
    keep[1:] = ~(space[1:] & space[:-1])
    keep[offsets[:-1]] = True
    out = np.where(space, np.uint8(32), data)
    last = np.zeros(0, dtype=np.int64)
    if len(start) > 1:
        long = end - start
        same = (long[1:] == long[:-1]) & (data[start[1:]] == data[start[:-1]]) & (data[end[1:] - 1] == data[end[:-1] - 1])
        text_of = np.searchsorted(offsets, start, side="right")
        same = np.flatnonzero(same & (text_of[1:] == text_of[:-1])) + 1
        raw = data.tobytes()
        equal = [raw[a:b] == raw[c:d] for a, b, c, d in zip(start[same].tolist(), end[same].tolist(), start[same - 1].tolist(), end[same - 1].tolist())]
        same = same[np.array(equal, dtype=bool)]
        repeats = np.zeros(len(start), dtype=bool)
        repeats[same] = True
        base = np.maximum.accumulate(np.where(repeats, 0, np.arange(len(start))))
        last = end[base[same]] - 1
        drop = np.zeros(len(data) + 1, dtype=np.int32)
        drop[end[same - 1]] += 1
        drop[end[same]] -= 1
        keep &= np.cumsum(drop[:-1]) == 0
    before = np.r_[0, np.cumsum(keep)]
    return out[keep], before[offsets], before[last]


def grams(codes: np.ndarray, offsets: np.ndarray, repeated: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each symbol (packed, last symbol lowest) and its text; a text's first ones are filled up with spaces. A repeat is a symbol after the word and a space."""
    n = len(codes)
    packed = np.zeros(n, dtype=np.uint64)
    text_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    place = np.arange(n) - offsets[:-1][text_of]
    for back in range(order):
        symbol = np.full(n, 32, dtype=np.uint64)
        symbol[back:] = codes[: n - back] if back else codes
        symbol[place < back] = 32
        packed |= symbol << np.uint64(8 * back)
    inner = place > 0
    again = ((packed[repeated] << np.uint64(16)) | np.uint64(32 << 8 | REPEAT)) & np.uint64((1 << 8 * order) - 1)
    return np.r_[packed[inner], again], np.r_[text_of[inner], text_of[repeated]]


def _counted(packed: list[np.ndarray]) -> pa.RecordBatch:
    found, n = distinct_counts(packed)
    return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["g", "n"])


def gram_counts(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """``g, n``: how often each n-gram occurs in ``text``, over all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in batches:
            for part in slices(batch, limit=PART_BYTES):
                waiting.append(grams(*symbols(text_bytes(part.column("text"))), order)[0])
                size += len(waiting[-1])
                if size > FLUSH:
                    yield _counted(waiting)
                    waiting, size = [], 0
        if waiting:
            yield _counted(waiting)

    return texts.mapInArrow(count, "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))


def _suffix(g: str, order: int) -> Column:
    return F.col(g).bitwiseAND(F.lit((1 << 8 * order) - 1))


def _prefix(g: str) -> Column:
    return F.shiftright(F.col(g), 8)


def _discounts(n: dict[int, int]) -> tuple[float, float, float]:
    """Chen and Goodman's three discounts from the counts of counts; 0.5, 1, 1.5 where these are too few."""
    if not all(n.get(k) for k in (1, 2, 3, 4)):
        return 0.5, 1.0, 1.5
    y = n[1] / (n[1] + 2 * n[2])
    return tuple(min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.05 * k), 0.95 * k) for k in (1, 2, 3))


class LowerOrders:
    """Probabilities of the orders up to ``LOCAL`` from the counts of the highest of them: at most 2^24 n-grams, whatever the corpus."""

    def __init__(self, g: np.ndarray, n: np.ndarray, order: int):
        levels = {order: (g, n)}
        for k in range(order - 1, 0, -1):
            levels[k] = np.unique(levels[k + 1][0] & ((1 << 8 * k) - 1), return_counts=True)
        self.order, self.known, self.p, self.weight = order, {}, {}, {}
        for k in range(1, order + 1):
            g, n = levels[k]
            cut = np.array(_discounts({c: int((n == c).sum()) for c in (1, 2, 3, 4)}))[np.minimum(n, 3) - 1]
            context, of = np.unique(g >> 8, return_inverse=True)
            total, freed = np.bincount(of, weights=n, minlength=len(context)), np.bincount(of, weights=cut, minlength=len(context))
            self.weight[k] = np.ones(1 << 8 * (k - 1))
            self.weight[k][context] = freed / np.maximum(total, 1)
            self.p[k] = (n - cut) / total[of] + self.weight[k][g >> 8] * self.look_up(g, k - 1)
            self.known[k] = g

    def look_up(self, g: np.ndarray, order: int | None = None) -> np.ndarray:
        """The probability of each n-gram's last ``order`` symbols."""
        order = self.order if order is None else order
        if not order:
            return np.full(len(g), 1 / 256)
        g = g & ((1 << 8 * order) - 1)
        out = self.weight[order][g >> 8] * self.look_up(g, order - 1)
        known = self.known[order]
        if len(known):
            at = np.minimum(np.searchsorted(known, g), len(known) - 1)
            out = np.where(known[at] == g, self.p[order][at], out)
        return out


class KneserNey:
    """Tables ``p[k]`` (n-gram, probability) and ``backoff[k]`` (context, weight) of the orders over ``LOCAL``, and the ``lower`` ones."""

    def __init__(self, counts: DataFrame, order: int = ORDER):
        self.order, self.local = order, min(LOCAL, order)
        levels = {order: checkpointed(counts)}
        n = self.distinct = levels[order].count()
        levels[order] = levels[order].coalesce(shards(n, ROWS_PER_FILE, LEAST_FILES))
        for k in range(order - 1, self.local - 1, -1):
            levels[k] = levels[k + 1].groupBy(_suffix("g", k).alias("g")).agg(F.count(F.lit(1)).alias("n"))
            if k > self.local:
                levels[k] = checkpointed(levels[k], n)
        rows = levels[self.local].toPandas().sort_values("g")
        self.lower = counts.sparkSession.sparkContext.broadcast(LowerOrders(rows["g"].to_numpy(np.int64), rows["n"].to_numpy(np.int64), self.local))
        self.p: dict[int, DataFrame] = {}
        self.backoff: dict[int, DataFrame] = {}
        for k in range(self.local + 1, order + 1):
            d1, d2, d3 = _discounts({x["n"]: x["m"] for x in levels[k].where("n <= 4").groupBy("n").agg(F.count(F.lit(1)).alias("m")).collect()})
            cut = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
            rows = levels[k].select("g", _prefix("g").alias("context"), _suffix("g", k - 1).alias("suffix"), "n", cut.alias("cut"))
            total = rows.groupBy("context").agg(F.sum("n").alias("total"), F.sum("cut").alias("freed"))
            self.backoff[k] = checkpointed(total.select("context", "total", (F.col("freed") / F.col("total")).alias("weight")), n)
            own = ((F.col("n") - F.col("cut")) / F.col("total")).alias("own")
            joined = rows.join(self.backoff[k], "context").select("g", "suffix", own, "weight")
            if k == self.local + 1:
                below = joined.mapInArrow(self._lower("suffix", "below"), "g long, suffix long, own double, weight double, below double")
            else:
                below = joined.join(self.p[k - 1].select(F.col("g").alias("suffix"), F.col("p").alias("below")), "suffix")
            self.p[k] = checkpointed(below.select("g", (F.col("own") + F.col("weight") * F.col("below")).alias("p")), n)

    def _lower(self, of: str, name: str):
        """Adds the lower orders' probability of the n-grams in column ``of``."""
        lower = self.lower

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lower.value.look_up(batch.column(of).to_numpy()))], [*batch.schema.names, name])

        return look

    def log_probability(self, wanted: DataFrame) -> DataFrame:
        """``g, logp`` for distinct n-grams ``g``: the longest known suffix's probability, times the back-off weights of the longer contexts."""
        out = wanted.select("g", F.lit(1.0).alias("weight"), F.lit(None).cast("double").alias("p"))
        for k in range(self.order, self.local, -1):
            here = self.p[k].select(F.col("g").alias("known"), F.col("p").alias("found"))
            back = self.backoff[k].select("context", F.col("weight").alias("back"))
            out = out.withColumn("own", _suffix("g", k)).withColumn("context", F.shiftright("own", 8))
            out = out.join(here, out.own == here.known, "left").join(back, "context", "left")
            settled = F.coalesce("p", F.col("found") * F.col("weight"))
            weight = F.when(settled.isNull(), F.col("weight") * F.coalesce("back", F.lit(1.0))).otherwise(F.col("weight"))
            out = out.select("g", weight.alias("weight"), settled.alias("p"))
        out = out.mapInArrow(self._lower("g", "below"), "g long, weight double, p double, below double")
        return out.select("g", F.log(F.coalesce("p", F.col("weight") * F.col("below"))).cast("float").alias("logp"))


def text_blocks(docs: DataFrame, blocks: int, id_col: str = "doc_id", text_col: str = "text", dealt: int = DEALT_BYTES) -> DataFrame:
    """The rows of ``docs`` dealt out to blocks in turn, each row of the result holding consecutive rows of about ``dealt`` bytes, compressed: ``block, payload``."""
    rows = id_text(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")

    def squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        press, turn = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId() * 7
        for batch in batches:
            for part in slices(batch, limit=dealt):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema) as out:
                    out.write_batch(part)
                yield pa.RecordBatch.from_arrays([pa.array([turn % blocks], pa.int64()), pa.array([press.compress(sink.getvalue())], pa.binary())], ["block", "payload"])
                turn += 1

    return rows.mapInArrow(squeezed, "block long, payload binary").repartition(blocks, "block")


def _opened(payload: bytes) -> pa.Table:
    import zstandard

    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(payload)).read_all()


def perplexities(docs: DataFrame, model: KneserNey, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, text_hash, n_symbols, perplexity``, one row for each row of ``docs``.

    The texts are moved to their blocks once; the look-ups and the scoring read that one shuffle.
    """
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    blocks = shards(size, block_bytes, LEAST_BLOCKS)
    rows = text_blocks(docs, blocks, id_col, text_col)
    order = model.order

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload").to_pylist()):
                known = waiting.setdefault(block, [])
                for own in _opened(payload).to_batches():
                    for part in slices(own, limit=PART_BYTES):
                        known.append(np.unique(grams(*symbols(text_bytes(part.column("text"))), order)[0]))
                if len(known) > PARTS:
                    waiting[block] = [np.unique(np.concatenate(known))]
        for block, known in waiting.items():
            found = np.unique(np.concatenate(known)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), block)), pa.array(found)], ["block", "g"])

    wanted = rows.mapInArrow(distinct, "block long, g long")
    known = model.log_probability(wanted.select("g").distinct())
    looked_up = wanted.join(known, "g").select("block", "g", "logp")

    def score(texts: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        g, logp = table["g"].to_numpy().astype(np.uint64), table["logp"].to_numpy().astype(np.float64)
        by_g = np.argsort(g)
        g, logp = g[by_g], logp[by_g]
        out = []
        for payload in texts["payload"]:
            own = _opened(payload)
            for batch in own.to_batches():
                for part in slices(batch, limit=PART_BYTES):
                    many = part.num_rows
                    packed, text_of = grams(*symbols(text_bytes(part.column("text"))), order)
                    n = np.bincount(text_of, minlength=many)
                    total = np.bincount(text_of, weights=logp[np.searchsorted(g, packed)], minlength=many) if len(packed) else np.zeros(many)
                    ids = part.column("doc_id").to_pandas(integer_object_nulls=True)
                    out.append(pd.DataFrame({"doc_id": ids, "text_hash": part.column("text_hash").to_numpy(), "n_symbols": n, "perplexity": np.where(n > 0, np.exp(-total / np.maximum(n, 1)), np.nan)}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"doc_id": [], "text_hash": [], "n_symbols": [], "perplexity": []}).astype({"doc_id": "int64", "text_hash": "int64", "n_symbols": "int64"})

    scored = rows.groupBy("block").cogroup(looked_up.groupBy("block")).applyInPandas(score, "doc_id long, text_hash long, n_symbols long, perplexity double")
    return scored.withColumn("perplexity", F.when(~F.isnan("perplexity"), F.col("perplexity")))


def bounds(scores: DataFrame, low: float = LOW, high: float = HIGH, margin: float = MARGIN) -> dict[str | None, tuple[float, float, float]]:
    """Median and bounds for each language from the trusted rows of ``scores``; the entry None holds for all others.

    What is bounded is the log-perplexity's distance from the language's median. A
    short text's distance varies much, so it counts as if ``PRIOR`` symbols at the
    median belonged to the text. Median and upper bound are those of the rows with
    ``held_back``, if there are enough, the lower bound that of all.
    """
    trusted = scores.where("trusted AND perplexity IS NOT NULL").select("lang", F.log("perplexity").alias("x"), "n_symbols", "held_back")
    found: dict[str | None, tuple[float, float, float]] = {}
    for by in (["lang"], []):
        least = LEAST_TRUSTED if by else 1
        middles = trusted.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if("held_back").alias("m"), F.percentile_approx("x", 0.5, 20_000).alias("all"), F.percentile_approx(F.when(F.col("held_back"), F.col("x")), 0.5, 20_000).alias("held"))
        middles = {x["lang"] if by else None: x for x in middles.where(F.col("n") >= least).collect()}
        middle = {lang: x["held"] if x["m"] >= least else x["all"] for lang, x in middles.items()}
        rows = trusted.withColumn("away", away(F.col("x"), by_language(middle, 0.0), F.col("n_symbols")))
        quantiles = rows.groupBy(*by).agg(F.percentile_approx("away", [low, high], 20_000).alias("all"), F.percentile_approx(F.when(F.col("held_back"), F.col("away")), high, 20_000).alias("held"))
        for x in quantiles.collect():
            lang = x["lang"] if by else None
            if lang in middle and (not by or lang is not None):
                upper = x["held"] if middles[lang]["m"] >= least else x["all"][1]
                found[lang] = (middle[lang], x["all"][0] - margin, upper + margin)
    return found


def by_language(values: dict[str | None, float], other: float) -> Column:
    """The value of the row's language, else that of null, else ``other``."""
    out = F.lit(float(values.get(None, other)))
    for lang, x in values.items():
        if lang is not None:
            out = F.when(F.col("lang") == lang, F.lit(float(x))).otherwise(out)
    return out


def away(x: Column, middle: Column, n: Column) -> Column:
    return (x - middle) * n / (n + F.lit(PRIOR))


def _held_back(text: Column) -> Column:
    """The fold that the model doesn't count, chosen by the text, so that its copies are in it too."""
    return F.pmod(F.xxhash64(text, F.lit(2)), F.lit(FOLDS)) == 0


def classify(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", accept_empty: bool = False) -> DataFrame:
    """``doc_id, text_hash, lang, perplexity, away, low, high, accepted`` for each row of ``docs``.

    ``trusted_ids`` (column ``doc_id``) names the trusted documents.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    trusted = broadcast_if_small(checkpointed(trusted_ids.select(F.col("doc_id").cast("long").alias("trusted_id")).where("trusted_id IS NOT NULL").distinct()))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    texts = texts.join(trusted, texts.doc_id == trusted.trusted_id, "left_semi")
    model = KneserNey(gram_counts(texts.where(~_held_back(F.col("text")))))
    if not model.distinct:
        model = KneserNey(gram_counts(texts))
    scores = checkpointed(perplexities(docs, model, id_col, text_col))
    langs = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("hash"), F.col(lang_col).cast("string").alias("lang"), _held_back(text).alias("held_back"))
    langs = langs.groupBy("id", "hash").agg(F.min("lang").alias("lang"), F.first("held_back").alias("held_back"))
    scores = scores.join(langs, scores.doc_id.eqNullSafe(langs.id) & (scores.text_hash == langs.hash), "left").drop("id", "hash")
    scores = scores.join(trusted, scores.doc_id == trusted.trusted_id, "left").withColumn("trusted", F.col("trusted_id").isNotNull()).drop("trusted_id")
    scores = checkpointed(scores)
    if not model.distinct:
        return scores.select("doc_id", "text_hash", "lang", "perplexity", F.lit(None).cast("double").alias("away"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(True).alias("accepted"))
    found = bounds(scores)
    limit = lambda k, other: by_language({lang: x[k] for lang, x in found.items()}, other)
    scores = scores.withColumn("away", away(F.log("perplexity"), limit(0, 0.0), F.col("n_symbols"))).withColumn("low", limit(1, -math.inf)).withColumn("high", limit(2, math.inf))
    accepted = F.coalesce(F.col("away").between(F.col("low"), F.col("high")), F.lit(accept_empty))
    return scores.select("doc_id", "text_hash", "lang", "perplexity", "away", "low", "high", accepted.alias("accepted"))


def keep_accepted(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The accepted rows of ``docs``, all columns."""
    own, (text_hash, id_, hash_) = docs.columns, unused(docs, "text_hash", "id", "hash")
    rejected = classify(docs, trusted_ids, id_col, text_col, lang_col).where("NOT accepted").select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_)).distinct()
    rejected = broadcast_if_small(checkpointed(rejected))
    kept = docs.withColumn(text_hash, F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    kept = kept.join(rejected, F.col(id_col).cast("long").eqNullSafe(F.col(id_)) & (F.col(text_hash) == F.col(hash_)), "left_anti")
    return kept.select(*(F.col(f"`{c}`") for c in own))

"""Language-model scoring by context-tree weighting.

A text is scored as bytes: A-Z lower-cased, its words (runs of other characters than ASCII
white space) with one space between them and a line feed at the end. Each byte is eight
binary decisions; each decision has a tree of contexts, the 0 to ``DEPTH`` bytes before
it (line feeds before the text). Every node holds the Krichevsky-Trofimov estimate of its
zeros and ones, and a node's weighted probability is half its own estimate and half the
product of its children's. A decision's probability is the mean of the estimates at all
depths of its path under the weights that the training text gives them; the sum of
logarithms is the text's code length.

Counting: each task takes its texts, some at a time, as blocks of ``BLOCK_BYTES``, which are
written with their distinct n-grams (context and byte, packed; 0 times for those that
no training text has) and distinct words. The n-grams are dealt out to shards by the
``SPLIT`` bytes of context next to the predicted byte, so that each shard has whole trees from
that depth on. A first pass sums what the shards' trees give to the depths above, which have
at most 2^8(SPLIT-1) contexts (2^16) with 255 decisions each, however large the corpus; the
driver weights those and broadcasts them. A second pass gives each n-gram's log-probability, and
each block gets back the answers to what it has asked for, with which its documents are
scored. An n-gram or word that a block misses is an error.

What is moved is a block's distinct n-grams; they and the trees grow with the text.

For comparison each text has a score by single words: the sum over its words, and an
end, of log10((c + 0.5) / (N + 0.5 (V + 1))), with c from the training texts.

Edge cases: a null text counts as empty, of which the end alone is scored; ids may repeat
or be null (such rows are trained on, unless told otherwise), each row is scored by itself; without
training text every bit has probability 1/2; an empty table gives an empty result;
further columns, of any name, are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.common import checkpointed, flat, shards, slices, text_bytes

DEPTH, SPLIT = 6, 3
BLOCK_BYTES, SHARD_BYTES, LEAST_SHARDS, PAYLOAD_BYTES = 32 << 20, 16 << 20, 12, 1 << 20
#: N-grams that wait in a block before they are merged, at least.
WAITING = 1 << 20
END = b"\n"
_HALF = math.log(0.5)
_TABLE = 1 << 12
_LOG_GAMMA_HALF = np.r_[0.0, np.cumsum(np.log(np.arange(_TABLE) + 0.5))]
_LOG_FACTORIAL = np.r_[0.0, np.cumsum(np.log(np.arange(1, _TABLE + 1)))]
_MASK = np.uint64(0xFF)
#: A block's texts are in ``payload``; what it asks of a shard is in ``grams`` or ``words``, with ``counts``.
_WRITTEN = "block long, shard int, payload binary, grams binary, words binary, counts binary"


def stream(text: bytes) -> bytes:
    """The bytes that are scored."""
    return b" ".join(text.lower().split()) + END


def _stirling(x: np.ndarray) -> np.ndarray:
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of a sequence of ``a`` zeros and ``b`` ones."""

    def half(n: np.ndarray) -> np.ndarray:  # log Gamma(n + 1/2) - log Gamma(1/2)
        return np.where(n < _TABLE, _LOG_GAMMA_HALF[np.minimum(n, _TABLE)], _stirling(np.maximum(n, 1) + 0.5) - 0.5 * math.log(math.pi))

    n = a + b
    return half(a) + half(b) - np.where(n < _TABLE, _LOG_FACTORIAL[np.minimum(n, _TABLE)], _stirling(np.maximum(n, 1) + 1.0))


def grams(data: np.ndarray, offsets: np.ndarray, depth: int) -> np.ndarray:
    """For each byte the n-gram of its context and itself, packed: the byte lowest, the one before it highest."""
    n = len(data)
    packed = data.astype(np.uint64)
    for back in range(1, depth + 1):
        byte = np.full(n, END[0], dtype=np.uint8)
        byte[back:] = data[: max(n - back, 0)]
        for k in range(back):  # a text's first bytes
            first = offsets[:-1] + k
            byte[first[first < offsets[1:]]] = END[0]
        packed |= byte.astype(np.uint64) << np.uint64(8 * (depth - back + 1))
    return packed


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their counts."""
    if not parts:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    keys, counts = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _press(a: np.ndarray) -> bytes:
    """An array's bytes, first all lowest ones, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8).T).tobytes())


def _opened(data: bytes, kind: type) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view(kind).ravel()


def _press_keys(keys: np.ndarray) -> bytes:
    return _press(np.diff(keys, prepend=np.uint64(0)))


def _opened_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_opened(data, np.uint64), dtype=np.uint64)


def _press_words(words: list[bytes]) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(b" ".join(words))


def _opened_words(data: bytes) -> list[bytes]:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data).split(b" ")


def shard_of(keys: np.ndarray, depth: int, split: int, n: int) -> np.ndarray:
    """The shard of each n-gram, by its ``split`` nearest bytes of context."""
    near = (keys >> np.uint64(8 * (depth - split + 1))) * np.uint64(0x9E3779B97F4A7C15)
    return ((near >> np.uint64(40)) % np.uint64(n)).astype(np.int32)


class _Block:
    """Texts that are scored together, with their distinct n-grams and words."""

    def __init__(self, block: int, depth: int, split: int, n_shards: int):
        self.block, self.depth, self.split, self.n_shards = block, depth, split, n_shards
        self.parts, self.waiting, self.most, self.size, self.words, self.other = [], 0, WAITING, 0, Counter(), set()

    def take(self, batch: pa.RecordBatch) -> tuple:
        """Adds a batch of ``doc_id, learns, text``, and gives the row that holds its streams."""
        import zstandard

        streams, learns = [stream(x) for x in text_bytes(batch.column("text"))], batch.column("learns").to_numpy(zero_copy_only=False)
        data, offsets = flat(streams)
        keys, counted = grams(data, offsets, self.depth), np.repeat(learns, np.diff(offsets))
        for own, factor in ((keys[counted], 1), (keys[~counted], 0)):
            if len(own):
                own, n = np.unique(own, return_counts=True)
                self.parts.append((own, n * factor))
                self.waiting += len(own)
        if self.waiting > self.most:
            self.parts = [merged(self.parts)]
            self.waiting = len(self.parts[0][0])
            self.most = max(WAITING, 2 * self.waiting)
        for s, counts in zip(streams, learns):
            words = s[:-1].split()
            if counts:
                self.words.update(words)
                self.words[END] += 1
            else:
                self.other.update(words)
                self.other.add(END)
        self.size += len(data)
        sink = pa.BufferOutputStream()
        kept = pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("learns"), pa.array(streams, pa.binary())], ["doc_id", "learns", "stream"])
        with pa.ipc.new_stream(sink, kept.schema) as out:
            out.write_batch(kept)
        return self.block, None, zstandard.ZstdCompressor(level=3).compress(sink.getvalue()), None, None, None

    def asks(self) -> Iterator[tuple]:
        """Rows that hold each shard's part of the n-grams and words, with their counts in training texts."""
        keys, counts = merged(self.parts)
        shard = shard_of(keys, self.depth, self.split, self.n_shards)
        order = np.argsort(shard, kind="stable")
        edge = np.searchsorted(shard[order], np.arange(self.n_shards + 1))
        for k in np.flatnonzero(np.diff(edge)):
            own = order[edge[k] : edge[k + 1]]
            yield self.block, int(k), None, _press_keys(keys[own]), None, _press(counts[own])
        lists: list[list[bytes]] = [[] for _ in range(self.n_shards)]
        for word in self.words.keys() | self.other:
            lists[zlib.crc32(word) % self.n_shards].append(word)
        for k, words in enumerate(lists):
            if words:
                words.sort()
                yield self.block, k, None, None, _press_words(words), _press(np.array([self.words[w] for w in words], dtype=np.int64))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), *[pa.binary()] * 4)
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], ["block", "shard", "payload", "grams", "words", "counts"])


def write_blocks(docs: DataFrame, depth: int, split: int, n_shards: int, block_bytes: int) -> DataFrame:
    """Texts, n-grams and words of all blocks, written to the shared folder; ``docs`` has ``doc_id, learns, text``."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, made = None, 0
        for batch in batches:
            for part in slices(batch, limit=PAYLOAD_BYTES):
                if own is None:
                    own = _Block((TaskContext.get().partitionId() << 32) + made, depth, split, n_shards)
                    made += 1
                yield _batch([own.take(part)])
                if own.size >= block_bytes:
                    yield _batch(list(own.asks()))
                    own = None
        if own is not None:
            yield _batch(list(own.asks()))

    return checkpointed(docs.mapInArrow(emit, _WRITTEN))


class Trees:
    """The trees of one of the eight decisions, from depth ``low`` to ``depth``.

    ``levels[d]`` has the distinct (context of d bytes, byte) of depth d and their counts.
    """

    def __init__(self, levels: dict[int, tuple[np.ndarray, np.ndarray]], low: int, depth: int, bit: int):
        self.low, self.depth, self.bit = low, depth, bit
        self.nodes, self.a, self.b, self.own, self.weighted, self.parent, self.of = {}, {}, {}, {}, {}, {}, {}
        below = None
        for d in range(depth, low - 1, -1):
            keys, counts = levels[d]
            node = keys >> np.uint64(8 - bit)
            first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            one = (keys >> np.uint64(7 - bit)) & np.uint64(1) == 1
            self.of[d] = np.cumsum(np.r_[False, node[1:] != node[:-1]])
            self.nodes[d] = node[first]
            self.a[d], self.b[d] = np.add.reduceat(np.where(one, 0, counts), first), np.add.reduceat(np.where(one, counts, 0), first)
            self.own[d] = self.weighted[d] = log_kt(self.a[d], self.b[d])
            if below is not None:
                children = np.bincount(np.searchsorted(self.nodes[d], below), weights=self.weighted[d + 1], minlength=len(first))
                self.parent[d + 1] = np.searchsorted(self.nodes[d], below)
                self.weighted[d] = _HALF + np.logaddexp(self.own[d], children)
            below = up(self.nodes[d], bit)

    def zero(self, mixed: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """The probability that the decision of each n-gram is 0; ``mixed`` and ``rest`` are those of the nodes at ``low`` from the depths above."""
        for d in range(self.low, self.depth + 1):
            if d > self.low:
                mixed, rest = mixed[self.parent[d]], rest[self.parent[d]]
            stop = np.exp((_HALF if d < self.depth else 0.0) + self.own[d] - self.weighted[d])
            mixed = mixed + rest * stop * (self.a[d] + 0.5) / (self.a[d] + self.b[d] + 1.0)
            rest = rest * (1 - stop)
        return mixed[self.of[self.depth]]


def up(nodes: np.ndarray, bit: int) -> np.ndarray:
    """The same decision's node without the farthest byte of context."""
    bits = np.uint64(bit)
    return ((nodes >> np.uint64(8 + bit)) << bits) | (nodes & np.uint64((1 << bit) - 1))


def levels_of(keys: np.ndarray, counts: np.ndarray, low: int, depth: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    found = {depth: (keys, counts)}
    for d in range(depth - 1, low - 1, -1):
        own, n = found[d + 1]
        found[d] = merged([(((own >> np.uint64(16)) << np.uint64(8)) | (own & _MASK), n)])
    return found


def _merged_asks(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return merged([(_opened_keys(a), _opened(b, np.int64)) for a, b in zip(group.column("grams").to_pylist(), group.column("counts").to_pylist())])


class Upper:
    """Depths 0 to ``split - 1``: for each node at the deepest of them, the mixture so far of probability 0, and the weight that remains for longer contexts."""

    def __init__(self, rows: pd.DataFrame, split: int):
        self.nodes, self.mixed, self.rest = {}, {}, {}
        for bit in range(8):
            own = rows[rows["bit"] == bit].sort_values("node")
            d = split - 1
            nodes = {d: own["node"].to_numpy(np.int64).astype(np.uint64)}
            a, b = {d: own["a"].to_numpy(np.int64)}, {d: own["b"].to_numpy(np.int64)}
            below, estimate, weighted, parent = {d: own["below"].to_numpy(np.float64)}, {}, {}, {}
            for d in range(split - 1, -1, -1):
                estimate[d] = log_kt(a[d], b[d])
                weighted[d] = _HALF + np.logaddexp(estimate[d], below[d])
                if d:
                    nodes[d - 1], parent[d] = np.unique(up(nodes[d], bit), return_inverse=True)
                    n = len(nodes[d - 1])
                    a[d - 1], b[d - 1] = (np.bincount(parent[d], weights=x[d], minlength=n).astype(np.int64) for x in (a, b))
                    below[d - 1] = np.bincount(parent[d], weights=weighted[d], minlength=n)
            mixed, rest = np.zeros(len(nodes[0])), np.ones(len(nodes[0]))
            for d in range(split):
                if d:
                    mixed, rest = mixed[parent[d]], rest[parent[d]]
                stop = np.exp(_HALF + estimate[d] - weighted[d])
                mixed, rest = mixed + rest * stop * (a[d] + 0.5) / (a[d] + b[d] + 1.0), rest * (1 - stop)
            self.nodes[bit], self.mixed[bit], self.rest[bit] = nodes[split - 1], mixed, rest

    def above(self, trees: Trees) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.nodes[trees.bit], up(trees.nodes[trees.low], trees.bit))
        return self.mixed[trees.bit][at], self.rest[trees.bit][at]


def upper_rows(asked: DataFrame, depth: int, split: int) -> DataFrame:
    """``bit, node, a, b, below``: what the shards' trees give to the nodes just above them."""

    def climb(group: pa.Table) -> pa.Table:
        levels, out = levels_of(*_merged_asks(group), split, depth), []
        for bit in range(8):
            trees = Trees(levels, split, depth, bit)
            node, of = np.unique(up(trees.nodes[split], bit), return_inverse=True)
            sums = [np.bincount(of, weights=x, minlength=len(node)) for x in (trees.a[split], trees.b[split], trees.weighted[split])]
            out.append(pa.table([np.full(len(node), bit, dtype=np.int32), node.astype(np.int64), sums[0].astype(np.int64), sums[1].astype(np.int64), sums[2]], ["bit", "node", "a", "b", "below"]))
        return pa.concat_tables(out)

    found = asked.groupBy("shard").applyInArrow(climb, "bit int, node long, a long, b long, below double")
    return found.groupBy("bit", "node").agg(*(F.sum(c).alias(c) for c in ("a", "b", "below")))


def gram_answers(asked: DataFrame, upper, depth: int, split: int) -> DataFrame:
    """For each block and shard the n-grams that were asked for, and their log-probabilities (base e)."""

    def answer(group: pa.Table) -> pa.Table:
        keys, counts = _merged_asks(group)
        levels, logp = levels_of(keys, counts, split, depth), np.zeros(len(keys))
        for bit in range(8):
            trees = Trees(levels, split, depth, bit)
            zero = trees.zero(*upper.value.above(trees))
            logp += np.log(np.where((keys >> np.uint64(7 - bit)) & np.uint64(1) == 1, 1 - zero, zero))
        found = [logp[np.searchsorted(keys, _opened_keys(x))].astype(np.float32).tobytes() for x in group.column("grams").to_pylist()]
        return group.select(["block", "grams"]).append_column("logp", pa.array(found, pa.binary()))

    return asked.groupBy("shard").applyInArrow(answer, "block long, grams binary, logp binary")


def word_answers(asked: DataFrame) -> DataFrame:
    """For each block and shard the words that were asked for, and how often training texts have them; a row without block has a shard's sum of these and the number of its words that occur."""

    def answer(group: pa.Table) -> pa.Table:
        lists = [(_opened_words(a), _opened(b, np.int64)) for a, b in zip(group.column("words").to_pylist(), group.column("counts").to_pylist())]
        total: dict[bytes, int] = {}
        for words, counts in lists:
            for w, n in zip(words, counts.tolist()):
                total[w] = total.get(w, 0) + n
        found = [_press(np.array([total[w] for w in words], dtype=np.int64)) for words, _ in lists]
        block, own = (group.column(c).to_pylist() for c in ("block", "words"))
        nothing = [None] * len(lists)
        columns = [[*block, None], [*own, None], [*found, None], [*nothing, sum(total.values())], [*nothing, sum(n > 0 for n in total.values())]]
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
        return pa.table([pa.array(c, kind) for c, kind in zip(columns, kinds)], ["block", "words", "counts", "tokens", "distinct"])

    return asked.groupBy("shard").applyInArrow(answer, "block long, words binary, counts binary, tokens long, distinct long")


class Places:
    """Finds distinct packed n-grams by hashing, a level for those that others have pushed out of the one before."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.levels, left = keys, [], np.arange(len(keys))
        while len(left):
            bits = max(1, int(len(left) - 1).bit_length() + 1)
            slot = np.zeros(1 << bits, dtype=np.int32)
            factor = np.uint64(0x9E3779B97F4A7C15 + 2 * len(self.levels) * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)
            place = self._hash(keys[left], factor, bits)
            slot[place] = left
            self.levels.append((factor, bits, slot))
            left = left[slot[place] != left]

    @staticmethod
    def _hash(keys: np.ndarray, factor: np.uint64, bits: int) -> np.ndarray:
        return (((keys ^ (keys >> np.uint64(29))) * factor) >> np.uint64(64 - bits)).astype(np.int64)

    def of(self, wanted: np.ndarray) -> np.ndarray:
        found, left = np.zeros(len(wanted), dtype=np.int64), np.arange(len(wanted))
        for factor, bits, slot in self.levels:
            at = slot[self._hash(wanted[left], factor, bits)]
            found[left] = at
            left = left[self.keys[at] != wanted[left]]
            if not len(left):
                return found
        if len(left):
            raise ValueError("a block has an n-gram that was not asked for")
        return found


def scores(docs: DataFrame, learns: Column, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, split: int = SPLIT, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``doc_id, learns, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte``, one row for each row of ``docs``.

    The model learns from the rows where ``learns``, a condition on ``docs``, is true or null.
    """
    spark = docs.sparkSession
    rows = docs.withColumn(id_col, F.col(id_col).cast("long"))
    marked = rows.select(F.col(id_col).alias("doc_id"), F.coalesce(learns, F.lit(True)).alias("learns"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = marked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_shards = shards(size, shard_bytes, LEAST_SHARDS)
    written = write_blocks(marked, depth, split, n_shards, block_bytes)
    asked = written.where("grams IS NOT NULL").select("block", "shard", "grams", "counts")
    upper = Upper(upper_rows(asked, depth, split).toPandas(), split)
    answers = gram_answers(asked, spark.sparkContext.broadcast(upper), depth, split)
    counted = checkpointed(word_answers(written.where("words IS NOT NULL").select("block", "shard", "words", "counts")))
    tokens, distinct = counted.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    by_end = math.log10(tokens + 0.5 * (distinct + 1))

    def score(key, texts: pa.Table, table: pa.Table) -> pa.Table:
        asked, answered, words, counts = (table.column(c).drop_null().to_pylist() for c in ("grams", "logp", "words", "counts"))
        keys = np.concatenate([_opened_keys(x) for x in asked])
        logp = np.concatenate([np.frombuffer(x, dtype=np.float32) for x in answered]).astype(np.float64)
        known: dict[bytes, int] = {}
        for own, n in zip(words, counts):
            known.update(zip(_opened_words(own), _opened(n, np.int64).tolist()))
        del asked, answered, words, counts
        places, out = Places(keys), []
        import zstandard

        for payload in texts.column("payload").to_pylist():
            own = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(payload)).read_all().combine_chunks()
            streams = own.column("stream").to_pylist()
            data, offsets = flat(streams)
            total = np.add.reduceat(logp[places.of(grams(data, offsets, depth))], offsets[:-1]) / math.log(10)
            by_word = [np.array([known[w] for w in s[:-1].split()] + [known[END]]) for s in streams]
            n = np.array([len(x) for x in by_word])
            long = np.diff(offsets)
            base = [float(np.log10(x + 0.5).sum()) - len(x) * by_end for x in by_word]
            columns = [own.column("doc_id"), own.column("learns"), n, [int((x > 0).sum()) for x in by_word], np.full(len(n), tokens), base, total, long, -total * math.log2(10) / long]
            out.append(pa.table(columns, names))
        return pa.concat_tables(out).combine_chunks()

    names = ["doc_id", "learns", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte"]
    both = answers.unionByName(counted.where("block IS NOT NULL").drop("tokens", "distinct"), allowMissingColumns=True)
    texts = written.where("payload IS NOT NULL").select("block", "payload")
    return texts.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(score, "doc_id long, learns boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double")

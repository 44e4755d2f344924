"""Best-fit packing of tokenised documents, planned on the histogram of lengths.

Each document's ids and an end id make one piece, or, beyond ``size``, pieces of
``size`` ids of which the first may be shorter. The plan is made from the number of
pieces of each length, at most ``size`` numbers: best-fit decreasing, where whole
runs of equal pieces go to runs of equally filled sequences at once. The plan is a
list of slot runs: length, first rank, number of slots, first sequence, offset. A
piece then takes the slot of its rank among the pieces of its length. Ranks come
from a count a task and length, summed over the tasks before it, so no length's
pieces ever meet in one task.

Edge cases: a null or empty text is the end id alone; ids may repeat or be null;
ties in length are placed by task and order of reading; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetscope.llm.common import checkpointed, id_text, slices

SIZE = 1024
END_ID = 2
SPECIAL = "<|endoftext|>"
VOCABULARY = "byte_bpe_50k"


class Encoder:
    """Ids as the tokenizers library gives them, by its faster twin where the two are alike.

    The two files hold one vocabulary. Texts with the special token's own string go
    through tokenizers, as only that treats it as a token.
    """

    def __init__(self, vocabulary: str = VOCABULARY):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        lines = open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb").read().splitlines()
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("fleetscope", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.load = lambda: Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
        self.slow = None

    def encode(self, text: str) -> np.ndarray:
        if SPECIAL in text:
            self.slow = self.slow or self.load()
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.uint32, copy=False)


_ENCODERS: dict[str, Encoder] = {}


def _encoder(vocabulary: str) -> Encoder:
    """One for each Python worker."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Encoder(vocabulary)
    return _ENCODERS[vocabulary]


def cuts(n: int, size: int = SIZE) -> list[tuple[int, int]]:
    """Start and length of each piece of a document of ``n`` ids."""
    first = n % size or size
    return [(0, min(n, first)), *((a, size) for a in range(first, n, size))] if n > size else [(0, n)]


def pieces(docs: DataFrame, size: int = SIZE, end_id: int = END_ID, vocabulary: str = VOCABULARY, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, task, place`` (and ``ids``): ``place`` is the rank in the task within the length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, seen = _encoder(vocabulary), TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            for part in slices(batch):
                rows = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    ids = np.append(encoder.encode(text), np.uint32(end_id)).astype("<u4")
                    for no, (start, length) in enumerate(cuts(len(ids), size)):
                        own = ids[start : start + length]
                        rows.append((doc_id, no, start, length, zlib.crc32(own.tobytes()), task, seen[length], own if keep_ids else None))
                        seen[length] += 1
                columns = list(zip(*rows))
                arrays = [pa.array(columns[i], kind) for i, kind in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([*arrays, *([pa.array(columns[7], pa.list_(pa.uint32())).cast(pa.list_(pa.int32()))] if keep_ids else [])], names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "place", *(["ids"] if keep_ids else [])]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, place long" + ", ids array<int>" * keep_ids
    return id_text(docs, id_col, text_col).mapInArrow(cut, schema)


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int]]:
    """Slot runs (length, first rank, slots, first sequence, offset) by best-fit decreasing.

    ``counts``: pieces of each length. Open sequences are kept as runs by free
    space, fullest first; a run of equal pieces takes the least space that holds
    one, as many times over as each such sequence has room, and else opens new ones.
    """
    slots: list[tuple[int, int, int, int, int]] = []
    open_runs: dict[int, list[tuple[int, int]]] = defaultdict(list)
    spaces: list[int] = []
    opened = 0

    def put(space: int, first: int, n: int) -> None:
        if space and n:
            if not open_runs[space]:
                bisect.insort(spaces, space)
            open_runs[space].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            k = bisect.bisect_left(spaces, length)
            if k < len(spaces):
                space = spaces[k]
                first, n = open_runs[space].pop()
                if not open_runs[space]:
                    spaces.pop(k)
            else:
                space, first = size, opened
                n = max(1, -(-left // (size // length)))
                opened += n
            each = space // length
            full, rest = divmod(left, each)
            full = min(full, n)
            if full:
                for turn in range(each):
                    slots.append((length, rank, full, first, size - space + turn * length))
                    rank += full
                left -= full * each
                put(space - each * length, first, full)
            if full < n:
                if left and left < each:
                    for turn in range(left):
                        slots.append((length, rank, 1, first + full, size - space + turn * length))
                        rank += 1
                    put(space - left * length, first + full, 1)
                    left, full = 0, full + 1
                put(space, first + full, n - full)
    return slots


def pack(docs: DataFrame, size: int = SIZE, end_id: int = END_ID, vocabulary: str = VOCABULARY, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``): one row a piece."""
    spark = docs.sparkSession
    cut = checkpointed(pieces(docs, size, end_id, vocabulary, keep_ids, id_col, text_col))
    by_task = checkpointed(cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")))
    counts = {x["length"]: x["n"] for x in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = plan(counts, size)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    order = np.lexsort(([x[1] for x in slots], [x[0] for x in slots])) if slots else []
    runs = np.array([slots[k] for k in order], dtype=np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast(runs)
    kept = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = shared.value
        stride = int(runs[:, 1].max()) + int(runs[:, 2].max()) + 1 if len(runs) else 1
        first = runs[:, 0] * stride + runs[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(first, length * stride + rank, side="right") - 1
            found = [pa.array(runs[at, 3] + rank - runs[at, 1]), pa.array(runs[at, 4])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *found], [*kept, "sequence_id", "offset"])

    ranked = cut.join(before, ["length", "task"]).withColumn("rank", F.col("place") + F.col("before")).select(*kept, "rank")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids + ", sequence_id long, offset long"
    return ranked.mapInArrow(take, schema)

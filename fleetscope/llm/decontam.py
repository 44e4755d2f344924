"""Benchmark decontamination: a broadcast hash set of test n-grams against every training window.

Words are runs of ASCII letters and digits and of all non-ASCII characters, after
lower-casing A-Z. A window is ``size`` consecutive words of a benchmark item; an
item of fewer words is one window. Every window of a document is hashed by a
rolling hash and looked up in the set; a hit is verified word by word. Long documents
are scanned in segments that overlap by ``size - 1`` words.

At most ``block`` windows are broadcast at a time. Of a larger benchmark only those
windows are, whose hashes occur in the documents: the documents' window hashes that pass
a bit map of fixed size are joined with the windows' by a shuffle. If even these are more
than one block, blocks follow one another, each with its result written and its
broadcast freed.

Edge cases: a null text has no words; items without words have no window; an id may
be null or repeat, each row is judged by itself; an empty table gives an empty
result; further columns, of any name, stay as they are.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from fleetscope.llm.common import ASCII_UPPER, checkpointed, flat, slices, text_bytes, unused

SIZE = 10
BLOCK = 200_000
MAP_BITS, PAGE_BITS = 27, 13
SEGMENT = 1 << 20
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_HITS = StructType([StructField("n_words", LongType()), StructField("spans", ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))), StructField("items", ArrayType(StringType()))])
_CODE = np.arange(256)
_LOWER = np.frombuffer(bytes(range(256)).translate(bytes.maketrans(ASCII_UPPER.encode(), ASCII_UPPER.lower().encode())), dtype=np.uint8)
_IS_WORD = (_CODE >= 128) | ((_CODE >= 48) & (_CODE <= 57)) | ((_CODE >= 97) & (_CODE <= 122)) | ((_CODE >= 65) & (_CODE <= 90))
_BASE, _STEP = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


class _Powers:
    """Powers of an odd number and of its inverse modulo 2^64, as far as needed so far."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(n, b, dtype=np.uint64)], dtype=np.uint64) for b in (self.base, self.inverse))
        return self.up, self.down


_BYTES, _WORDS = _Powers(_BASE), _Powers(_STEP)


def words(data: np.ndarray, offsets: np.ndarray, letters: np.ndarray = _IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of lower-cased texts laid end to end: start, end, hash and text number of each run of ``letters``."""
    inside = letters[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[heads] = inside[heads]
    start = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[tails] = inside[tails]
    end = np.flatnonzero(last) + 1
    up, down = _BYTES.upto(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    mark = (total[end] - total[start]) * down[start]
    mark ^= mark >> np.uint64(29)
    mark *= np.uint64(0xBF58476D1CE4E5B9)
    mark ^= mark >> np.uint64(32)
    return start, end, mark, np.searchsorted(offsets, start, side="right") - 1


def window_hashes(mark: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive words."""
    n = len(mark)
    if n < size:
        return np.zeros(0, dtype=np.uint64)
    up, down = _WORDS.upto(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(mark * up[:n], out=total[1:])
    found = (total[size:] - total[:-size]) * down[: n - size + 1]
    return found ^ (found >> np.uint64(31))


def split_words(text: bytes) -> list[bytes]:
    data = _LOWER[np.frombuffer(text, dtype=np.uint8)]
    start, end, _, _ = words(data, np.array([0, len(data)]))
    low = data.tobytes()
    return [low[a:b] for a, b in zip(start, end)]


class WindowSet:
    """Windows of the benchmark: their hashes by length, and words and items to verify with."""

    def __init__(self, items: list[tuple[str, bytes]]):
        self.items: dict[bytes, list[str]] = {}
        by_size: dict[int, set[int]] = defaultdict(set)
        for item_id, window in items:
            known = self.items.setdefault(window, [])
            known.append(item_id)
            parts = window.split(b" ")
            data = np.frombuffer(window, dtype=np.uint8)
            _, _, mark, _ = words(data, np.array([0, len(data)]))
            by_size[len(parts)].add(int(window_hashes(mark, len(parts))[0]))
        self.hashes = {n: np.array(sorted(x), dtype=np.uint64) for n, x in by_size.items()}
        self.maybe = {}
        for n, x in self.hashes.items():
            self.maybe[n] = np.zeros(1 << 20, dtype=bool)
            self.maybe[n][x >> np.uint64(44)] = True

    def hits(self, texts: list[bytes]) -> tuple[np.ndarray, list[list[tuple[int, int, list[str]]]]]:
        """Words of each text, and its verified hits: place of the first word, words, items."""
        offsets = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum([len(x) for x in texts], out=offsets[1:])
        data = _LOWER[np.frombuffer(b"".join(texts), dtype=np.uint8)]
        start, end, mark, of = words(data, offsets)
        first = np.searchsorted(of, np.arange(len(texts) + 1))
        found: list[list[tuple[int, int, list[str]]]] = [[] for _ in texts]
        low = None
        for size, known in self.hashes.items():
            seen = window_hashes(mark, size)
            at = np.flatnonzero(self.maybe[size][seen >> np.uint64(44)])
            at = at[of[at] == of[at + size - 1]]
            near = np.minimum(np.searchsorted(known, seen[at]), len(known) - 1)
            for k in at[known[near] == seen[at]].tolist():
                low = data.tobytes() if low is None else low
                window = b" ".join([low[a:b] for a, b in zip(start[k : k + size].tolist(), end[k : k + size].tolist())])
                if window in self.items:
                    found[of[k]].append((k - int(first[of[k]]), size, self.items[window]))
        return np.diff(first), found


def _segments(text: bytes, size: int) -> list[tuple[bytes, int]]:
    """Parts of a long text that overlap by ``size - 1`` words, and the number of each part's first word."""
    if len(text) <= SEGMENT:
        return [(text, 0)]
    data = np.frombuffer(text, dtype=np.uint8)
    inside = _IS_WORD[data]
    start = np.flatnonzero(inside & ~np.r_[False, inside[:-1]])
    if not len(start):
        return [(text[:0], 0)]
    out, first = [], 0
    while True:
        stop = int(np.searchsorted(start, start[first] + SEGMENT))
        stop = max(stop, first + size)
        if stop >= len(start):
            out.append((text[start[first] :], first))
            return out
        out.append((text[start[first] : start[stop]], first))
        first = stop - size + 1


def scan(windows: WindowSet, texts: list[bytes], size: int) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
    """For each text: its words, the spans of words that are hit (merged), and the items that occur."""
    parts = [(k, part, base) for k, text in enumerate(texts) for part, base in _segments(text, size)]
    counts, hits = windows.hits([p for _, p, _ in parts])
    total, spans, items = [0] * len(texts), [[] for _ in texts], [set() for _ in texts]
    for (k, _, base), n, own in zip(parts, counts.tolist(), hits):
        total[k] = max(total[k], base + n)
        for place, long, ids in own:
            spans[k].append((base + place, base + place + long))
            items[k].update(ids)
    out = []
    for n, own, ids in zip(total, spans, items):
        merged: list[tuple[int, int]] = []
        for a, b in sorted(own):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(merged[-1][1], b))
            else:
                merged.append((a, b))
        out.append((n, merged, ids))
    return out


def benchmark_windows(benchmark: DataFrame, size: int = SIZE, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id`` (string), ``window`` (words joined by spaces), ``words``, ``hash``, each pair once."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out, many, marks = [], [], [], []
            for item, text in zip(batch.column("item_id").to_pylist(), text_bytes(batch.column("text"))):
                data = _LOWER[np.frombuffer(text, dtype=np.uint8)]
                start, end, mark, _ = words(data, np.array([0, len(data)]))
                long, low = min(size, len(start)), data.tobytes()
                for k, h in enumerate(window_hashes(mark, long).tolist() if long else ()):
                    ids.append(item)
                    out.append(b" ".join([low[a:b] for a, b in zip(start[k : k + long].tolist(), end[k : k + long].tolist())]))
                    many.append(long)
                    marks.append(h)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(out, pa.binary()), pa.array(many, pa.int64()), pa.array(np.array(marks, np.uint64).view(np.int64))], ["item_id", "window", "words", "hash"])

    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(cut, "item_id string, window binary, words long, hash long").distinct()


def _bit_map(windows: DataFrame) -> np.ndarray:
    """Which of the 2^27 leading hash bits some window has; pages of it are made in Spark."""
    place = F.shiftrightunsigned("hash", 64 - MAP_BITS)

    def page(pdf: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(1 << PAGE_BITS, dtype=bool)
        bits[pdf["place"].to_numpy() & ((1 << PAGE_BITS) - 1)] = True
        return pd.DataFrame({"page": [pdf["page"].iat[0]], "bits": [np.packbits(bits).tobytes()]})

    pages = windows.select(place.alias("place")).distinct().withColumn("page", F.shiftright("place", PAGE_BITS)).groupBy("page").applyInPandas(page, "page long, bits binary")
    out = np.zeros(1 << (MAP_BITS - 3), dtype=np.uint8)
    width = 1 << (PAGE_BITS - 3)
    for row in pages.toLocalIterator():
        out[row["page"] * width : (row["page"] + 1) * width] = np.frombuffer(bytes(row["bits"]), dtype=np.uint8)
    return out


def occurring(docs: DataFrame, windows: DataFrame, text_col: str = "text") -> DataFrame:
    """Those of the windows whose hash some document's window has."""
    sizes = [x["words"] for x in windows.select("words").distinct().collect()]
    shared = docs.sparkSession.sparkContext.broadcast(_bit_map(windows))

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for part in slices(batch):
                data, offsets = flat(text_bytes(part.column("text")))
                _, _, mark, of = words(_LOWER[data], offsets)
                for size in sizes:
                    found = window_hashes(mark, size)
                    found = np.unique(found[of[: len(found)] == of[size - 1 :]]) if len(found) else found
                    place = found >> np.uint64(64 - MAP_BITS)
                    found = found[(known[place >> np.uint64(3)] >> (np.uint64(7) - (place & np.uint64(7))).astype(np.uint8)) & 1 > 0]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), size)), pa.array(found.view(np.int64))], ["words", "hash"])

    hashes = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).mapInArrow(seen, "words long, hash long").distinct()
    return windows.join(hashes, ["words", "hash"], "left_semi")


def _with_hits(docs: DataFrame, shared, text_col: str, size: int, name: str) -> DataFrame:
    """``docs`` with a struct of the words, spans and items that one broadcast window set finds in each text."""
    kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                found = scan(shared.value, text_bytes(part.column(text_col)), size)
                hits = pa.array([{"n_words": n, "spans": [{"start": a, "end": b} for a, b in spans], "items": sorted(ids)} for n, spans, ids in found], kind)
                yield pa.RecordBatch.from_arrays([*part.columns, hits], [*part.schema.names, name])

    return docs.mapInArrow(look, StructType([*docs.schema.fields, StructField(name, _HITS)]))


def _joined(one: Column, two: Column) -> Column:
    """The hits of two window sets together."""
    spans = F.array_sort(F.concat(one["spans"], two["spans"]))
    merged = F.aggregate(spans, F.array().cast("array<struct<start:bigint,end:bigint>>"), lambda acc, x: F.when((F.size(acc) > 0) & (x["start"] <= F.element_at(acc, -1)["end"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(x))))
    return F.struct(one["n_words"].alias("n_words"), merged.alias("spans"), F.array_sort(F.array_union(one["items"], two["items"])).alias("items"))


def find(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", size: int = SIZE, block: int = BLOCK, name: str = "hits") -> DataFrame:
    """``docs`` with column ``name``: struct of ``n_words``, ``spans`` (word numbers, end exclusive) and ``items``."""
    windows = checkpointed(benchmark_windows(benchmark, size))
    n = windows.count()
    if n > block:
        windows = checkpointed(occurring(docs, windows, text_col))
        n = windows.count()
    blocks = max(1, -(-n // block))
    out, (more,) = docs, unused(docs, "more")
    for k in range(blocks):
        part = windows if blocks == 1 else windows.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == k)
        shared = docs.sparkSession.sparkContext.broadcast(WindowSet([(x.item_id, bytes(x.window)) for x in part.select("item_id", "window").toLocalIterator()]))
        out = _with_hits(out, shared, text_col, size, more if k else name)
        if k:
            out = out.withColumn(name, _joined(F.col(name), F.col(more))).drop(more)
        if blocks > 1:
            out = checkpointed(out)
            shared.destroy()
    return out


def hit_words(hits):
    """Words of the spans."""
    return F.aggregate(F.col(hits)["spans"], F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])


def remove_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", size: int = SIZE) -> DataFrame:
    """The rows of ``docs`` in which no window occurs."""
    own, (hits,) = docs.columns, unused(docs, "hits")
    return find(docs, benchmark, text_col, size, name=hits).where(F.size(F.col(hits)["spans"]) == 0).select(*(F.col(f"`{c}`") for c in own))


def cut_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the given spans of words; what stands between the words of a span goes too."""
    data = np.frombuffer(text, dtype=np.uint8)
    start, end, _, _ = words(_LOWER[data], np.array([0, len(data)]))
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : start[a]])
        at = end[b - 1]
    return b"".join([*out, text[at:]])


def remove_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", size: int = SIZE) -> DataFrame:
    """All rows of ``docs``, with the hit words cut out of their texts."""
    (hits,) = unused(docs, "hits")
    found = find(docs, benchmark, text_col, size, name=hits)
    schema = docs.schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            for k, hit in enumerate(batch.column(hits).to_pylist()):
                if hit["spans"]:
                    texts[k] = cut_spans(texts[k].encode(), [(x["start"], x["end"]) for x in hit["spans"]]).decode()
            columns = [pa.array(texts, pa.string()) if c == text_col else batch.column(c) for c in schema.names]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return found.mapInArrow(cut, schema)

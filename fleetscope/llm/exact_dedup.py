"""Exact deduplication with a sharded cuckoo-filter index.

A text's key is the SHA-256 of its UTF-8 bytes after lower-casing A-Z only. The
index is cut into shards by a key prefix. A shard is a cuckoo filter of 16-bit
fingerprints (two candidate buckets of four slots) over a content store that is
bucketed in the same way and holds the whole 256-bit keys with the text length:
a filter miss proves a key new, a filter hit is verified against the content of
its two buckets. An insertion that finds no slot within a bounded number of
evictions doubles the filter and refills it from the stored keys. Beside the index stands
a table of the live rows; a deletion takes its row from there, chooses the row that stays
anew from what is left of the text, and removes a key without live rows from filter and
store.

Rows of one text can be a third of the table, so each task first passes its rows
through a local index of the same kind and ships one row a distinct key; a
shard then sees each key at most once a task. Texts never leave the first scan.

Edge cases: a null text is the empty text; a null id ranks below every other;
equal rows count each; deleting a row that is not live changes nothing; an empty table
gives an empty result; further columns, of any name, are ignored, or kept by
``deduplicate``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from fleetscope.llm.common import ASCII_UPPER, checkpointed, id_text, shards, slices, text_bytes, unused

SLOTS = 4
MAX_EVICTIONS = 200
LOWEST = -(1 << 63)
LOCAL_KEYS = 100_000
KEYS_PER_SHARD = 20_000
LOWER = bytes.maketrans(ASCII_UPPER.encode(), ASCII_UPPER.lower().encode())


class CuckooIndex:
    """Cuckoo filter over a bucketed store of live keys.

    ``entries`` maps an entry number to ``[key, value]``; ``content`` has, for
    each bucket, the entry numbers of the fingerprints in its slots, so a key is
    compared only with the at most eight stored keys of its two buckets.
    """

    def __init__(self, capacity: int = 1024):
        self.entries: dict[int, list] = {}
        self.serial = 0
        self.resizes = 0
        self._allocate(capacity)

    def _allocate(self, capacity: int) -> None:
        self.buckets = 1 << max(4, int(np.ceil(np.log2(max(1, capacity) / SLOTS / 0.85))))
        self.filter: list[list[int]] = [[] for _ in range(self.buckets)]
        self.content: list[list[int]] = [[] for _ in range(self.buckets)]

    def _place(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[8:10], "little") or 1
        first = int.from_bytes(key[16:24], "little") & (self.buckets - 1)
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & (self.buckets - 1)

    def may_contain(self, key: bytes) -> bool:
        """The filter's answer: False is certain, True is to be verified."""
        mark, first, second = self._place(key)
        return mark in self.filter[first] or mark in self.filter[second]

    def find(self, key: bytes) -> int | None:
        """The entry of a live key: filter, then verification against bucketed content."""
        mark, first, second = self._place(key)
        for bucket in (first, second):
            if mark in self.filter[bucket]:
                for entry in self.content[bucket]:
                    if self.entries[entry][0] == key:
                        return entry
        return None

    def insert(self, key: bytes, value) -> int:
        """Adds a key that is not live."""
        entry = self.serial
        self.serial += 1
        self.entries[entry] = [key, value]
        if not self._settle(key, entry):
            self._grow()
        return entry

    def _settle(self, key: bytes, entry: int) -> bool:
        mark, first, second = self._place(key)
        for bucket in (first, second):
            if len(self.filter[bucket]) < SLOTS:
                self.filter[bucket].append(mark)
                self.content[bucket].append(entry)
                return True
        bucket = second
        for turn in range(MAX_EVICTIONS):
            slot = (entry + turn) % SLOTS
            self.filter[bucket][slot], mark = mark, self.filter[bucket][slot]
            self.content[bucket][slot], entry = entry, self.content[bucket][slot]
            bucket = self._other(bucket, mark)
            if len(self.filter[bucket]) < SLOTS:
                self.filter[bucket].append(mark)
                self.content[bucket].append(entry)
                return True
        return False

    def _grow(self) -> None:
        """Overflow: a filter of twice the size, refilled from the stored keys."""
        capacity = self.buckets * SLOTS * 2 * 0.85
        while True:
            self.resizes += 1
            self._allocate(int(capacity))
            if all(self._settle(key, entry) for entry, (key, _) in self.entries.items()):
                return
            capacity *= 2

    def delete(self, key: bytes) -> bool:
        """Removes a live key from filter and store."""
        entry = self.find(key)
        if entry is None:
            return False
        _, first, second = self._place(key)
        bucket = first if entry in self.content[first] else second
        slot = self.content[bucket].index(entry)
        self.filter[bucket].pop(slot)
        self.content[bucket].pop(slot)
        del self.entries[entry]
        return True

    def merge(self, key: bytes, keep_id: int, at_keep: int, rows: int) -> None:
        """A row, or the rows of a task: the largest id stays, counts add up."""
        entry = self.find(key) if self.may_contain(key) else None
        if entry is None:
            self.insert(key, (keep_id, at_keep, rows))
            return
        best, at_best, n = self.entries[entry][1]
        if keep_id > best:
            best, at_best = keep_id, 0
        self.entries[entry][1] = (best, at_best + (at_keep if keep_id == best else 0), n + rows)


def digest(text: bytes) -> bytes:
    return hashlib.sha256(text.translate(LOWER)).digest()


def keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, digest`` of every row; the texts stay in the scan's task."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([digest(x) for x in text_bytes(part.column("text"))], pa.binary())], ["doc_id", "digest"])

    return id_text(docs, id_col, text_col).mapInArrow(hashed, "doc_id long, digest binary")


def _packed(index: CuckooIndex) -> pa.RecordBatch:
    live = list(index.entries.values())
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in live], pa.binary()), *(pa.array([x[1][i] for x in live], pa.int64()) for i in range(3))], ["digest", "keep_id", "at_keep", "group_size"])


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a distinct key of the task; a full local index is shipped and started anew."""
    index = CuckooIndex()
    for batch in batches:
        for doc_id, key in zip(batch.column("doc_id").to_pylist(), batch.column("digest").to_pylist()):
            index.merge(key, LOWEST if doc_id is None else doc_id, 1, 1)
        if len(index.entries) >= LOCAL_KEYS:
            yield _packed(index)
            index = CuckooIndex()
    if index.entries:
        yield _packed(index)


def build_index(members: DataFrame, n_shards: int) -> DataFrame:
    """The live keys: ``shard, digest, keep_id, at_keep, group_size``.

    ``at_keep`` counts the rows that carry ``keep_id``. The result is the
    index's content store; ``update_index`` starts from it again.
    """
    schema = "digest binary, keep_id long, at_keep long, group_size long"
    return _merge_shards(members.mapInArrow(_local, schema), n_shards)


def _merge_shards(partials: DataFrame, n_shards: int) -> DataFrame:
    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        index = CuckooIndex(len(pdf))
        for key, keep_id, at_keep, rows in zip(pdf["digest"], pdf["keep_id"].tolist(), pdf["at_keep"].tolist(), pdf["group_size"].tolist()):
            index.merge(bytes(key), keep_id, at_keep, rows)
        out = _packed(index).to_pandas()
        out.insert(0, "shard", pdf["shard"].iat[0])
        return out

    return partials.select(_shard(n_shards), "digest", "keep_id", "at_keep", "group_size").groupBy("shard").applyInPandas(fold, "shard long, digest binary, keep_id long, at_keep long, group_size long")


def live_rows(members: DataFrame) -> DataFrame:
    """``doc_id, digest, n``: how many live rows have this id and text."""
    return members.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n"))


def _shard(n_shards: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(n_shards)).alias("shard")


def update_index(index: DataFrame, live: DataFrame, n_shards: int, inserted: DataFrame | None = None, deleted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The index and its live rows after inserting, then deleting rows (``doc_id, digest``).

    Only keys that a change touches are counted anew, and only in their shards.
    """
    schema, nothing = "digest binary, keep_id long, at_keep long, group_size long", live.limit(0).select("doc_id", "digest")
    changes = [(inserted if inserted is not None else nothing, 1, 0), (deleted if deleted is not None else nothing, 0, 1)]
    rows = live.select("doc_id", "digest", F.col("n").alias("more"), F.lit(0).cast("long").alias("less"))
    for table, more, less in changes:
        rows = rows.unionByName(table.select("doc_id", "digest", F.lit(more).cast("long").alias("more"), F.lit(less).cast("long").alias("less")))
    rows = rows.groupBy("doc_id", "digest").agg((F.sum("more") - F.sum("less")).alias("n"))
    live = checkpointed(rows.where("n > 0"))
    touched = checkpointed(changes[0][0].select("digest").unionByName(changes[1][0].select("digest")).distinct())
    left = live.join(touched, "digest", "left_semi").groupBy("digest").agg(F.max(F.struct(F.coalesce("doc_id", F.lit(LOWEST)).alias("id"), "n")).alias("x"), F.sum("n").alias("rows"))
    state = touched.join(left, "digest", "left").select("digest", F.coalesce("x.id", F.lit(LOWEST)).alias("keep_id"), F.coalesce("x.n", F.lit(0)).cast("long").alias("at_keep"), F.coalesce("rows", F.lit(0)).cast("long").alias("group_size"), F.lit(1).alias("kind"))
    changes = index.select("digest", "keep_id", "at_keep", "group_size", F.lit(0).alias("kind")).unionByName(state)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("kind", kind="stable")
        own = CuckooIndex(len(pdf))
        for key, value in zip(map(bytes, pdf["digest"]), zip(pdf["keep_id"].tolist(), pdf["at_keep"].tolist(), pdf["group_size"].tolist())):
            entry = own.find(key)
            if not value[2]:
                own.delete(key)
            elif entry is None:
                own.insert(key, value)
            else:
                own.entries[entry][1] = value
        out = _packed(own).to_pandas()
        out.insert(0, "shard", pdf["shard"].iat[0])
        return out

    return checkpointed(changes.select(_shard(n_shards), "*").groupBy("shard").applyInPandas(fold, f"shard long, {schema}")), live


def lookup(index: DataFrame, members: DataFrame, n_shards: int) -> DataFrame:
    """``doc_id, digest, live`` for rows that may be in the index: each shard's filter answers for the distinct keys, and hits are verified."""

    def ask(live: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        own = CuckooIndex(len(live))
        for key in live["digest"]:
            own.insert(bytes(key), None)
        return wanted[["digest"]].assign(live=[own.may_contain(key) and own.find(key) is not None for key in map(bytes, wanted["digest"])])

    wanted = members.select("digest").distinct().select(_shard(n_shards), "digest")
    found = index.select(_shard(n_shards), "digest").groupBy("shard").cogroup(wanted.groupBy("shard")).applyInPandas(ask, "digest binary, live boolean")
    return members.select("doc_id", "digest").join(found, "digest")


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, digest, keep_id, at_keep, group_size, kept``: a row for each row of ``docs``.

    Rows that share text and largest id are all ``kept``; ``at_keep`` counts them.

    The join back is on the key; a hot key's side is split by Spark's skew join.
    """
    members = checkpointed(keys(docs, id_col, text_col))
    live = build_index(members, shards(members.count(), KEYS_PER_SHARD, 256))
    live = live.select("digest", F.when(F.col("keep_id") != LOWEST, F.col("keep_id")).alias("keep_id"), "at_keep", "group_size")
    live = checkpointed(live)
    return members.join(live, "digest").select("doc_id", "digest", "keep_id", "at_keep", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, one for each distinct text: that with the largest id.

    Where several rows share text and largest id, one of them stays.
    """
    chosen = decisions(docs, id_col, text_col).where("kept")
    own, (text_key, key, id_, rows) = docs.columns, unused(docs, "text_key", "key", "id", "rows")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                found = pa.array([digest(x) for x in text_bytes(part.column(text_col))], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, found], [*part.schema.names, text_key])

    schema = StructType([*docs.schema.fields, StructField(text_key, BinaryType())])
    chosen = checkpointed(chosen.groupBy(F.col("digest").alias(key), F.col("doc_id").alias(id_)).agg(F.max("at_keep").alias(rows)))
    kept = docs.mapInArrow(keyed, schema).join(chosen, (F.col(text_key) == F.col(key)) & F.col(id_col).cast("long").eqNullSafe(F.col(id_)))
    single = kept.where(F.col(rows) == 1).select(*(F.col(f"`{c}`") for c in own))
    several = kept.where(F.col(rows) > 1).dropDuplicates([key]).select(*(F.col(f"`{c}`") for c in own))
    return single.unionByName(several)

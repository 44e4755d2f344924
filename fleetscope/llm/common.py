"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.sources.checkpoints import checkpointed as written

ROWS_PER_FILE, LEAST_FILES = 100_000, 12
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def checkpointed(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` written to the shared folder, its lineage cut. With an estimate of its ``rows``, small tables are written in few files, so that the shuffles after them have few and larger blocks."""
    return written(df if rows is None else df.coalesce(shards(rows, ROWS_PER_FILE, LEAST_FILES)))


def broadcast_if_small(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` (narrow) rows; beyond that Spark shuffles both sides."""
    return F.broadcast(df) if df.count() <= most else df


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only ``doc_id`` and ``text``; a null text counts as empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, modulus: int):
    """crc32 of the id written as text, modulo ``modulus``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    column = pc.fill_null(column, "")
    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch whose texts hold about ``limit`` bytes, so that temporary arrays stay small."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    part = np.cumsum(sizes) // limit
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def flat(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one byte array, and the offsets of each."""
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(x) for x in texts], out=offsets[1:])
    return np.frombuffer(b"".join(texts), dtype=np.uint8), offsets


def distinct_counts(parts: list[np.ndarray], repeated: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of all ``parts``, ascending, and how often each occurs; only those that occur more than once if ``repeated``.

    ``parts`` is emptied while its values are copied, and they are sorted in place, so that they are held once.
    """
    every, end = np.empty(sum(len(x) for x in parts), dtype=parts[0].dtype), 0
    while parts:
        part = parts.pop()
        every[end : end + len(part)] = part
        end += len(part)
    every.sort()
    new = np.ones(end + 1, dtype=bool)
    new[1:-1] = every[1:] != every[:-1]
    first, last = new[:-1], new[1:]
    if repeated:
        first, last = first & ~last, last & ~first
    first, last = np.flatnonzero(first), np.flatnonzero(last)
    return every[first], last - first + 1


def shards(rows: int, per_shard: int, least: int = 1) -> int:
    """How many shards hold ``rows`` rows at ``per_shard`` each."""
    return max(least, -(-rows // per_shard))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until it is no column of ``df`` in any case."""
    own = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in own:
            name += "_"
        own.add(name.lower())
        found.append(name)
    return found

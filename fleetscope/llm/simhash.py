"""SimHash near-duplicates with a Gray-order hierarchical index.

A fingerprint has 64 bits: bit k is 1 if it is set in over half of the XXH64
values (seed 42) of the text's word shingles. Fingerprints link at ``radius`` or
fewer differing bits, and the links' connected components are the groups.

Candidates: the 64 bits are cut into bands such that linked fingerprints agree on
some number of whole bands, and each fingerprint goes to one group for each such
choice of bands; no link is lost. The scheme takes wider keys as the number of
distinct fingerprints grows, so groups stay small. Inside a group, fingerprints
stand in order of their Gray rank. Runs of them form the nodes of a tree; a node
factors out the bits that all its fingerprints share and its parent's do not, as a
mask and a pattern. A search adds up the differences on the way down and leaves a
whole node as soon as they pass the radius. Groups over ``limit`` rows are cut,
in Gray order, into chunks, and only those pairs of chunks are searched whose
shared bits differ in ``radius`` places at most.

A group gives the edges of a spanning forest of its links, not all pairs.

Edge cases: a null or empty text has the fingerprint zero, which links like any
other; a null id never becomes a component's id unless all are null; equal rows
each get a row; an empty table gives an empty result; further columns, of any name,
are ignored, or kept by ``deduplicate``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.common import LEAST_FILES, ROWS_PER_FILE, checkpointed, id_text, shards, slices, text_bytes, unused
from fleetscope.llm.components import connected_components

RADIUS = 4
SHINGLE = 4
SEED = 42
GROUP_LIMIT = 4096
FANOUT = 8
FRONTIER = 1 << 20
#: bands and how many of them linked fingerprints (4 bits) share; the last number is the largest count of distinct fingerprints.
SCHEMES = ((5, 1, 8_000_000), (6, 2, 2_000_000_000), (7, 3, None))
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of whole words; lower-cases A-Z only."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        marks, n = xxhash.xxh64_digest(line, SEED), 1
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *ends[:-1].tolist()]
        stops = (ends[shingle - 1 :] - 1).tolist()
        n = len(stops)
        of = xxhash.xxh64_digest
        marks = b"".join([of(line[a:z], SEED) for a, z in zip(starts, stops)])
    by_place = np.frombuffer(marks, dtype=np.uint8).reshape(n, 8)
    counts = np.concatenate([np.bincount(by_place[:, k], minlength=256) @ _BITS for k in range(8)])
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp, text_hash`` with the fingerprint as a signed long; ``text_hash`` is XXH64 of the text as it is."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = text_bytes(part.column("text"))
                found = np.array([[fingerprint(x, shingle), xxhash.xxh64_intdigest(x, SEED)] for x in texts], dtype=np.uint64).reshape(-1, 2).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found[:, 0]), pa.array(found[:, 1])], ["doc_id", "fp", "text_hash"])

    return id_text(docs, id_col, text_col).mapInArrow(marked, "doc_id long, fp long, text_hash long")


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Place of each fingerprint in Gray order: the number whose Gray code it is."""
    rank = fp.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _shared(fp: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For runs that begin at ``starts``: the bits in which all fingerprints of the run agree."""
    return ~(np.bitwise_or.reduceat(fp, starts) ^ np.bitwise_and.reduceat(fp, starts))


class GrayTree:
    """Hierarchy over fingerprints that stand group by group, in Gray order in each.

    ``levels`` goes from the leaves' parents to the roots, one root a group; a
    level has, for each node, its first row, the mask of newly shared bits and
    their pattern, and the range of its children one level below.
    """

    def __init__(self, fp: np.ndarray, group: np.ndarray):
        self.fp = fp
        n = len(fp)
        new = np.r_[True, group[1:] != group[:-1]] if n else np.zeros(0, bool)
        self.first_of_group = np.flatnonzero(new)
        sizes = np.diff(np.r_[self.first_of_group, n])
        self.group_no = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(n) - np.repeat(self.first_of_group, sizes)
        self.levels: list[dict[str, np.ndarray]] = []
        width, starts, below = FANOUT, np.flatnonzero(place % FANOUT == 0), np.arange(n)
        while True:
            first_child = np.searchsorted(below, starts)
            self.levels.append({"start": starts, "end": np.r_[starts[1:], n], "child": first_child, "child_end": np.r_[first_child[1:], len(below)], "shared": _shared(fp, starts)})
            if len(starts) == len(self.first_of_group):
                break
            below, width = starts, width * FANOUT
            starts = np.flatnonzero(place % width == 0)
        for low, high in zip(self.levels, self.levels[1:]):
            parent = np.searchsorted(high["start"], low["start"], side="right") - 1
            low["mask"] = low["shared"] & ~high["shared"][parent]
        self.levels[-1]["mask"] = self.levels[-1]["shared"]
        for level in self.levels:
            level["pattern"] = fp[level["start"]] & level["mask"]

    def search(self, query: np.ndarray, node: np.ndarray, radius: int, after: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (number of the query, row) within ``radius``. ``node``: each query's root; ``after``: only rows beyond this one."""
        spread = np.ones(len(query), dtype=np.int64) if not len(self.levels) else (self.levels[-1]["end"] - self.levels[-1]["start"])[node]
        part = np.cumsum(spread) // FRONTIER
        edges = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(query)] if len(query) else np.zeros(1, np.int64)
        for a, b in zip(edges[:-1], edges[1:]):
            who, at = np.arange(a, b), node[a:b]
            spent = np.zeros(b - a, dtype=np.int64)
            for level in reversed(self.levels):
                spent = spent + np.bitwise_count((query[who] & level["mask"][at]) ^ level["pattern"][at])
                stays = spent <= radius
                if after is not None:
                    stays &= level["end"][at] > after[who] + 1
                who, at, spent = who[stays], at[stays], spent[stays]
                child, many = level["child"][at], level["child_end"][at] - level["child"][at]
                step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                who, spent, at = np.repeat(who, many), np.repeat(spent, many), np.repeat(child, many) + step
            near = np.bitwise_count(query[who] ^ self.fp[at]) <= radius
            if after is not None:
                near &= at > after[who]
            yield who[near], at[near]


def _forest(n: int, left: list[np.ndarray], right: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, least node reachable) of the links' components."""
    label = np.arange(n)
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
    while len(a):
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
        if np.array_equal(before, label):
            break
    tied = np.flatnonzero(label != np.arange(n))
    return tied, label[tied]


def links_within(fp: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges of the links inside each group; rows stand by group and Gray rank."""
    if not len(fp):
        return fp, fp
    tree = GrayTree(fp, group)
    left, right = [], []
    for i, j in tree.search(fp, tree.group_no, radius, after=np.arange(len(fp))):
        left.append(i)
        right.append(j)
    a, b = _forest(len(fp), left, right)
    return fp[a], fp[b]


def links_between(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges of the links between two runs in Gray order."""
    tree = GrayTree(right, np.zeros(len(right), np.int64))
    a, b = [], []
    for i, j in tree.search(left, np.zeros(len(left), np.int64), radius):
        a.append(i)
        b.append(j + len(left))
    x, y = _forest(len(left) + len(right), a, b)
    both = np.concatenate([left, right])
    return both[x], both[y]


def scheme(distinct: int, radius: int = RADIUS) -> tuple[int, int]:
    """Bands, and how many of them linked fingerprints share (bands minus radius)."""
    if radius != RADIUS:
        return radius + 1, 1
    return next((bands, shared) for bands, shared, most in SCHEMES if most is None or distinct <= most)


def band_keys(bands: int, shared: int) -> list[tuple[int, int]]:
    """For each choice of ``shared`` bands: its number and the mask of its bits."""
    edges = [round(64 * k / bands) for k in range(bands + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [(no, sum(masks[k] for k in chosen)) for no, chosen in enumerate(combinations(range(bands), shared))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _edge_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])


def _search_small(radius: int):
    """Rows sorted by group: whole groups are gathered and searched some thousand rows at a time."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fp, no, key = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))

        def found(fp, no, key):
            rank = gray_rank(fp)
            order = np.lexsort((rank, key, no))
            fp, no, key = fp[order], no[order], key[order]
            group = np.cumsum(np.r_[True, (no[1:] != no[:-1]) | (key[1:] != key[:-1])])
            return _edge_batch(*links_within(fp, group, radius))

        for batch in batches:
            fp = np.r_[fp, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)]
            no = np.r_[no, batch.column("no").to_numpy(zero_copy_only=False).astype(np.int64)]
            key = np.r_[key, batch.column("key").to_numpy(zero_copy_only=False)]
            if len(fp) < 1 << 15:
                continue
            last = np.flatnonzero((no != no[-1]) | (key != key[-1]))
            cut = last[-1] + 1 if len(last) else 0
            if cut:
                yield found(fp[:cut], no[:cut], key[:cut])
                fp, no, key = fp[cut:], no[cut:], key[cut:]
        if len(fp):
            yield found(fp, no, key)

    return search


def _chunks(limit: int):
    """Sorted rows of large groups: consecutive rows of a group form chunks, known by their first row's task and place."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, serial, room, last = TaskContext.get().partitionId() << 32, -1, 0, None
        for batch in batches:
            no, key = batch.column("no").to_pylist(), batch.column("key").to_pylist()
            out = []
            for group in zip(no, key):
                if group != last or not room:
                    last, room, serial = group, limit, serial + 1
                room -= 1
                out.append(base + serial)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*batch.schema.names, "chunk"])

    return cut


def _search_large(rows: DataFrame, radius: int, limit: int) -> DataFrame:
    """Edges inside groups of over ``limit`` rows, by pairs of chunks that may hold links."""
    gray = F.col("fp")
    for shift in (1, 2, 4, 8, 16, 32):
        gray = gray.bitwiseXOR(F.shiftrightunsigned(gray, shift))
    ordered = rows.withColumn("gray", gray).repartitionByRange("no", "key", "gray").sortWithinPartitions("no", "key", "gray").select("no", "key", "fp")
    chunked = checkpointed(ordered.mapInArrow(_chunks(limit), "no int, key long, fp long, chunk long"))
    nodes = checkpointed(chunked.groupBy("no", "key", "chunk").agg(F.bitwise_not(F.bit_or("fp").bitwiseXOR(F.bit_and("fp"))).alias("mask"), F.bit_and("fp").alias("pattern")))
    one, two = (nodes.select("no", "key", *(F.col(c).alias(f"{c}{side}") for c in ("chunk", "mask", "pattern"))) for side in (1, 2))
    apart = F.bit_count(F.col("pattern1").bitwiseXOR(F.col("pattern2")).bitwiseAND(F.col("mask1")).bitwiseAND(F.col("mask2")))
    pairs = checkpointed(one.join(two, ["no", "key"]).where((F.col("chunk1") <= F.col("chunk2")) & (apart <= radius)).select("chunk1", "chunk2"))
    sides = pairs.select(F.col("chunk1").alias("chunk"), "chunk1", "chunk2", F.lit(1).alias("side")).unionByName(pairs.where("chunk1 <> chunk2").select(F.col("chunk2").alias("chunk"), "chunk1", "chunk2", F.lit(2).alias("side")))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        fp = pdf["fp"].to_numpy().view(np.uint64)
        side = pdf["side"].to_numpy()
        order = np.argsort(gray_rank(fp), kind="stable")
        fp, side = fp[order], side[order]
        left, right = fp[side == 1], fp[side == 2]
        a, b = links_between(left, right, radius) if len(right) else links_within(left, np.zeros(len(left), np.int64), radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return chunked.select("chunk", "fp").join(sides, "chunk").groupBy("chunk1", "chunk2").applyInPandas(search, "a long, b long")


def link_edges(distinct: DataFrame, n: int, radius: int = RADIUS, limit: int = GROUP_LIMIT) -> DataFrame:
    """``a, b``: the ``n`` fingerprints (column ``fp``, each once) whose links have the components of all links within ``radius``."""
    keys = [F.struct(F.lit(no).alias("no"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("key")) for no, mask in band_keys(*scheme(n, radius))]
    rows = distinct.select("fp", F.explode(F.array(*keys)).alias("k")).select(F.col("k.no").alias("no"), F.col("k.key").alias("key"), "fp")
    large = checkpointed(rows.groupBy("no", "key").count().where(F.col("count") > limit).select("no", "key"))
    if large.isEmpty():
        small, more = rows, None
    else:
        large = F.broadcast(large) if large.count() <= 10_000 else large
        small, more = rows.join(large, ["no", "key"], "left_anti"), rows.join(large, ["no", "key"], "left_semi")
    edges = small.repartition("no", "key").sortWithinPartitions("no", "key").mapInArrow(_search_small(radius), "a long, b long")
    return edges if more is None else edges.unionByName(_search_large(more, radius, limit))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, limit: int = GROUP_LIMIT) -> DataFrame:
    """``doc_id, fp, component_id, root, text_hash`` of every row.

    ``component_id`` is the least id reachable over links, ``root`` the least fingerprint.
    """
    marked = checkpointed(fingerprints(docs, id_col, text_col, shingle))
    distinct = checkpointed(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    n = distinct.count()
    distinct = distinct.coalesce(shards(n, ROWS_PER_FILE // 10, LEAST_FILES))
    roots = connected_components(link_edges(distinct, n, radius, limit))
    rooted = checkpointed(distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), n)
    least = checkpointed(rooted.groupBy("root").agg(F.min("least").alias("component_id")), n)
    known = checkpointed(rooted.select("fp", "root").join(least, "root").select("fp", "root", "component_id"), n)
    return marked.join(known, "fp").select("doc_id", "fp", "component_id", "root", "text_hash")


def hex_fingerprint(fp):
    """Sixteen lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs``, all columns, one for each group: that with the least id.

    Of rows that share that id, one stays; null ids rank last.
    """
    own, (text_hash, id_, hash_, rows, root) = docs.columns, unused(docs, "text_hash", "id", "hash", "rows", "root")
    first = components(docs, id_col, text_col, shingle, radius).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    first = first.groupBy("root", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("rows"))
    stays = first.groupBy("root").agg(F.min(F.struct("text_hash", "doc_id", "rows")).alias("x"))
    stays = checkpointed(stays.select(F.col("root").alias(root), F.col("x.doc_id").alias(id_), F.col("x.text_hash").alias(hash_), F.col("x.rows").alias(rows)))
    kept = docs.withColumn(text_hash, F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    kept = kept.join(stays, F.col(id_col).cast("long").eqNullSafe(F.col(id_)) & (F.col(text_hash) == F.col(hash_)))
    single = kept.where(F.col(rows) == 1).select(*(F.col(f"`{c}`") for c in own))
    if stays.where(F.col(rows) > 1).isEmpty():
        return single
    return single.unionByName(kept.where(F.col(rows) > 1).dropDuplicates([root]).select(*(F.col(f"`{c}`") for c in own)))

"""Near copies: SimHash groups first, then whatever else has similar shingles.

Two texts link if their sets of word shingles (five words, lower-casing A-Z only) have a
Jaccard similarity of ``SIMILARITY`` or more; the links' connected components are the
groups. The first candidates are the links of ``simhash`` (Gray-order index, fingerprints
of the same shingles).
Fingerprints of texts of that similarity differ in up to some 13 bits, which no lossless
choice of bands can search, so the links that remain come from a prefix index, which
misses none: whatever the order of all shingles, linked texts share one of their first
``n - ceil(0.8 n) + 1``.

The order is by hash, but what many texts have in common (a notice, a menu) comes last,
so that it joins nobody. Shingles count as common if they stand in two texts of some
part of a task's texts and in over ``OFTEN`` in all such parts; beyond ``MOST`` of them
only the more frequent ones. The order changes the work and never the result. Pairs that
cannot reach the similarity, by their sizes and the places of the shared shingle, are
left out. Of the others, bit maps of a sixteenth to an eighth of the sets' size leave out
those that they show to be less similar, and only the rest is verified on the whole sets. All
are made anew from the texts, as storing the sets would take more room than the texts.

A large group is not compared pair by pair. In each round of ``STARS``, each text goes to
one of its shingles, and the texts under a shingle are compared with that many of them, first the least changed one, then by turns any one and one of the least changed, if
they are not in one component yet, and take over a component. Then only pairs of texts that still stand in different components are
compared, all of them. Under a shingle of over ``HOT`` texts, these carry a bit map of their shingles' hashes: a bit that only one of
two texts has stands for one shingle at least that the other lacks, which bounds what they share from above, so most pairs that aren't
similar never leave the join, and none that is similar is lost. The maps have ``BITS`` bits a shingle or more, up to ``LONGEST`` longs;
on texts of many more shingles they leave out less.

Edge cases: a text of under five words is one shingle; a null or blank text is one
shingle too, so blank texts link; equal texts link; a null id ranks last; further
columns, of any name, stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.llm import simhash
from fleetscope.llm.common import LEAST_FILES, ROWS_PER_FILE, broadcast_if_small, checkpointed, distinct_counts, flat, shards, slices, text_bytes, unused
from fleetscope.llm.components import connected_components
from fleetscope.llm.decontam import _LOWER, _WORDS, window_hashes, words

SHINGLE = 5
SIMILARITY = 4, 5
STARS = 1, 16
HOT, BITS, LONGEST = 8, 4, 64
#: Bit maps that are moved once a pair may have so many longs.
LONGEST_OF_PAIR = 1 << 13
OFTEN, MOST, FLUSH = 16, 1_000_000, 1 << 22
MAP_BITS = 27
BROADCAST_SHINGLES = 4_000_000
_NOT_SPACE = np.ones(256, dtype=bool)
_NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False


def shingle_sets(texts: list[bytes], shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' distinct shingles, ascending in each text, and where each text's begin and end."""
    data, offsets = flat(texts)
    _, _, mark, of = words(_LOWER[data], offsets, _NOT_SPACE)
    first = np.searchsorted(of, np.arange(len(texts) + 1))
    many = np.diff(first)
    at = np.arange(max(len(mark) - shingle + 1, 0))
    at = at[of[at] == of[at + shingle - 1]]
    # Of a text of too few words, all are one shingle.
    short = np.flatnonzero(many < shingle)
    up, down = _WORDS.upto(len(mark) + 1)
    total = np.r_[np.uint64(0), np.cumsum(mark * up[: len(mark)], dtype=np.uint64)]
    whole = (total[first[:-1][short] + many[short]] - total[first[:-1][short]]) * down[first[:-1][short]]
    whole ^= (whole >> np.uint64(31)) ^ (many[short].astype(np.uint64) + np.uint64(1)) << np.uint64(50)
    h = np.r_[window_hashes(mark, shingle)[at], whole]
    who = np.r_[of[at], short]
    order = np.lexsort((h, who))
    h, who = h[order], who[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (who[1:] != who[:-1])
    return h[new], np.searchsorted(who[new], np.arange(len(texts) + 1))


def first_ones(n):
    """How many shingles of ``n``, in any order common to all texts, hold one of each similar text's."""
    over, under = SIMILARITY
    return n - (over * n + under - 1 - (over * n + under - 1) % under) / under + 1 if isinstance(n, Column) else n - (over * n + under - 1) // under + 1


def text_nodes(docs: DataFrame, text_col: str) -> DataFrame:
    """``node, text``: the node of a text is its XXH64."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.xxhash64(text).alias("node"), text.alias("text"))


def _often(waiting: list[np.ndarray]) -> pa.RecordBatch:
    h, texts = distinct_counts(waiting, repeated=True)
    return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(texts)], ["h", "texts"])


def _repeated(shingle: int):
    """Shingles that two texts of some million shingles have, with the number of such texts."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in batches:
            for part in slices(batch):
                waiting.append(shingle_sets(text_bytes(part.column("text")), shingle)[0])
                size += len(waiting[-1])
                if size > FLUSH:
                    yield _often(waiting)
                    waiting, size = [], 0
        if waiting:
            yield _often(waiting)

    return emit


def _map_of(shared: DataFrame) -> np.ndarray:
    """Which of the 2^27 leading hash bits some ``h`` has: 16 MB, whatever the corpus."""
    place = F.shiftrightunsigned("h", 64 - MAP_BITS)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    words_ = shared.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toPandas()
    out = np.zeros(1 << (MAP_BITS - 6), dtype=np.uint64)
    out[words_["word"].to_numpy(np.int64)] = words_["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def _first(shingle: int, common, shared=None):
    """Each text's first shingles and their places, the common ones last; only those that a bit map ``shared`` may have, if there is one."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, often = common.value
        for batch in batches:
            for part in slices(batch):
                h, edge = shingle_sets(text_bytes(part.column("text")), shingle)
                n = np.diff(edge)
                who = np.repeat(np.arange(len(n)), n)
                if len(known):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    h = h[np.lexsort((h, np.where(known[at] == h, often[at], 0), who))]
                place = np.arange(len(h)) - np.repeat(edge[:-1], n) + 1
                stays = place <= np.repeat(first_ones(n), n)
                if shared is not None:
                    at = h >> np.uint64(64 - MAP_BITS)
                    stays &= (shared.value[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
                node = np.asarray(part.column("node"))[who]
                yield pa.RecordBatch.from_arrays([pa.array(node[stays]), pa.array(n[who][stays]), pa.array(h[stays].view(np.int64)), pa.array(place[stays])], ["node", "n", "h", "place"])

    return emit


def _whole(shingle: int, names: list[str]):
    """The rows' columns ``names`` and the text's whole set."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                h, edge = shingle_sets(text_bytes(part.column("text")), shingle)
                own = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), own], [*names, "own"])

    return emit


def _maps(shingle: int, names: list[str], longest: int = LONGEST):
    """The rows' columns ``names``, the size of the text's set and its bit map; the map's number of longs is a power of two, and a map of half the size has a bit wherever one of both halves has it."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                h, edge = shingle_sets(text_bytes(part.column("text")), shingle)
                n = np.diff(edge)
                longs = np.minimum(1 << np.ceil(np.log2(np.maximum(BITS * n / 64, 1))).astype(np.int64), longest)
                start = np.r_[0, np.cumsum(longs)]
                place = (((h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) & np.repeat(longs * 64 - 1, n).astype(np.uint64)
                bits = np.zeros(start[-1], dtype=np.uint64)
                np.bitwise_or.at(bits, np.repeat(start[:-1], n) + (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
                map_ = pa.ListArray.from_arrays(pa.array(start.astype(np.int32)), pa.array(bits.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(n), map_], [*names, "size", "map"])

    return emit


def first_shared(texts: DataFrame, shingle: int = SHINGLE, often: int = OFTEN, most: int = MOST) -> DataFrame:
    """``node, n, h, place, many``: each text's size and its first shingles, of those that are first in other texts too, and in how many rows they are."""
    counts = texts.select("text").mapInArrow(_repeated(shingle), "h long, texts long").groupBy("h").agg(F.sum("texts").alias("texts"))
    counts = checkpointed(counts.where(F.col("texts") > often))
    while counts.count() > most:
        often *= 2
        counts = counts.where(F.col("texts") > often)
    rows = counts.toPandas().astype("int64")
    known = rows["h"].to_numpy().view(np.uint64)
    order = np.argsort(known)
    common = texts.sparkSession.sparkContext.broadcast((known[order], rows["texts"].to_numpy()[order]))
    first = texts.mapInArrow(_first(shingle, common), "node long, n long, h long, place long")
    shared = checkpointed(first.groupBy("h").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count(F.lit(1)).alias("many")).where("a <> b").select("h", "many"))
    # Most first shingles stand in one text: the bit map keeps them from being moved again.
    first = texts.mapInArrow(_first(shingle, common, texts.sparkSession.sparkContext.broadcast(_map_of(shared))), "node long, n long, h long, place long")
    # Rows of a text lie together from here on, so that sums by text are made before they are moved.
    return checkpointed(first.join(broadcast_if_small(shared), "h").repartition("node").groupBy("node", "h").agg(*(F.first(c).alias(c) for c in ("n", "place", "many"))))


def _similar(shared: Column, n: Column, m: Column) -> Column:
    over, under = SIMILARITY
    return shared * (over + under) >= (n + m) * over


def _may_link() -> Column:
    """Different components, and enough shingles from the shared one on if it is the first."""
    rest = F.least(F.col("n1") - F.col("place1"), F.col("n2") - F.col("place2")) + 1
    return (F.col("root1") != F.col("root2")) & _similar(rest, F.col("n1"), F.col("n2"))


def _may_share() -> Column:
    """Whether the bit maps, if both are there, leave enough shingles that both may have."""
    size = F.least(F.size("map1"), F.size("map2"))
    # Sizes of texts that may link differ by one halving at most.
    one, two = (F.when(F.size(m) > size, F.zip_with(F.slice(m, 1, size), F.slice(m, size + 1, size), lambda x, y: x.bitwiseOR(y))).otherwise(F.col(m)) for m in ("map1", "map2"))
    only = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda total, k: total + k)
    most = F.least(F.col("n1") - only(one, two), F.col("n2") - only(two, one))
    return F.col("map1").isNull() | F.col("map2").isNull() | _similar(most, F.col("n1"), F.col("n2"))


def _side(rows: DataFrame, no: int, *more: str) -> DataFrame:
    return rows.select("h", *(F.col(c).alias(f"{c}{no}") for c in ("node", "n", "place", "root", *more)))


def _sides(pairs: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``node, text`` of the pairs' nodes ``a``, and ``a, b, text`` with the text of each pair's ``b``."""
    leaders = broadcast_if_small(pairs.select(F.col("a").alias("node")).distinct())
    both = texts.withColumnRenamed("node", "b").join(broadcast_if_small(pairs), "b").select("a", "b", "text")
    return texts.join(leaders, "node", "left_semi"), both


def _open_pairs(pairs: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """Those of the pairs that sizes and bit maps of both texts leave open; no similar pair is left out."""
    one, both = _sides(pairs, texts)
    one = one.mapInArrow(_maps(shingle, ["node"], LONGEST_OF_PAIR), "node long, size long, map array<long>").groupBy(F.col("node").alias("a")).agg(F.first("size").alias("n1"), F.first("map").alias("map1"))
    two = both.mapInArrow(_maps(shingle, ["a", "b"], LONGEST_OF_PAIR), "a long, b long, size long, map array<long>").select("a", "b", F.col("size").alias("n2"), F.col("map").alias("map2"))
    return two.join(one, "a").where(_similar(F.least("n1", "n2"), F.col("n1"), F.col("n2")) & _may_share()).select("a", "b").distinct()


def links(pairs: DataFrame, texts: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Those of the pairs of nodes ``a, b`` whose whole sets are similar.

    Whole sets are made and moved only for pairs that the bit maps leave open.
    The sets of ``a`` are broadcast if together they are small, and those of ``b`` are made where the texts are.
    """
    pairs = checkpointed(pairs.select("a", "b").distinct())
    if pairs.isEmpty():
        return pairs
    pairs = checkpointed(_open_pairs(pairs, texts, shingle))
    if pairs.isEmpty():
        return pairs
    sets, both = _sides(pairs, texts)
    sets = sets.mapInArrow(_whole(shingle, ["node"]), "node long, own array<long>")
    sets = checkpointed(sets.groupBy(F.col("node").alias("a")).agg(F.first("own").alias("own_a")))
    if (sets.agg(F.sum(F.size("own_a"))).first()[0] or 0) <= BROADCAST_SHINGLES:
        sets = F.broadcast(sets)
    both = both.mapInArrow(_whole(shingle, ["a", "b"]), "a long, b long, own array<long>").join(sets, "a")
    return checkpointed(both.where(_similar(F.size(F.array_intersect("own_a", "own")), F.size("own_a"), F.size("own"))).select("a", "b").distinct())


def _labelled(roots: DataFrame, found: DataFrame) -> DataFrame:
    """``roots``, where each ``b`` of a link takes over an ``a``'s root if it is less. Who has a root, is connected to it."""
    new = found.join(broadcast_if_small(roots.withColumnRenamed("node", "a")), "a").groupBy(F.col("b").alias("node")).agg(F.min("root").alias("to"))
    return checkpointed(roots.join(broadcast_if_small(checkpointed(new)), "node", "left").select("node", F.least("root", "to").alias("root")))


def _contracted(roots: DataFrame, found: DataFrame) -> DataFrame:
    """``roots`` after all links."""
    known = broadcast_if_small(checkpointed(connected_components(found.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))).withColumnRenamed("root", "to"))
    return checkpointed(roots.join(known, "node", "left").select("node", F.coalesce("to", "root").alias("root")))


def simhash_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``a, b``: texts (nodes) whose SimHash fingerprints are equal or linked, a spanning forest of these links."""
    marked = checkpointed(simhash.fingerprints(docs, id_col, text_col, shingle).select("fp", F.col("text_hash").alias("node")))
    heads = checkpointed(marked.groupBy("fp").agg(F.min("node").alias("a"), F.max("node").alias("most")))
    n = heads.count()
    edges = simhash.link_edges(heads.select("fp").coalesce(shards(n, ROWS_PER_FILE // 10, LEAST_FILES)), n).select(F.col("a").alias("one"), F.col("b").alias("two"))
    one, two = (heads.select(F.col("fp").alias(fp), F.col("a").alias(name)) for fp, name in (("one", "b"), ("two", "a")))
    equal = marked.join(broadcast_if_small(heads.where("a <> most").select("fp", "a")), "fp").where("a <> node").select("a", F.col("node").alias("b"))
    return edges.join(broadcast_if_small(one), "one").join(broadcast_if_small(two), "two").select("a", "b").unionByName(equal)


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, stars: tuple[int, ...] = STARS) -> DataFrame:
    """``node, root`` of each text that may link to another: the least node of its component."""
    texts = text_nodes(docs, text_col)
    first = first_shared(texts, shingle)
    # Of copies with changes of their own, the least changed has most of its first shingles in common with others.
    shares = first.groupBy("node").agg((F.count(F.lit(1)) / first_ones(F.first("n"))).alias("share"))
    first = checkpointed(first.join(broadcast_if_small(checkpointed(shares)), "node"))
    roots = checkpointed(first.select("node", F.col("node").alias("root")).distinct())
    every = [links(simhash_pairs(docs, id_col, text_col, shingle), texts, shingle)]
    roots = _labelled(roots, every[0])
    leader = lambda k: F.min_by(F.struct("node", "n", "place", "root"), F.struct(F.lit(0) if k % 2 else -F.round("share", 1 if k % 100 else 9), F.xxhash64("node", F.lit(k))))
    meet = [F.min("root").alias("low"), F.max("root").alias("high")]
    for k, many in enumerate(stars):
        # One shingle a text: any, but the same one in most texts that share most; then that of the most texts.
        pick = F.min_by(F.struct("h", "n", "place", "root", "share"), F.struct(-F.col("many") if k else F.lit(0), F.xxhash64("h", F.lit(k)))).alias("x")
        picks = checkpointed(first.join(broadcast_if_small(roots), "node").groupBy("node").agg(pick).select("node", "x.*"))
        heads = picks.groupBy("h").agg(F.array(*(leader(100 * k + i) for i in range(many))).alias("x"), *meet).where("low <> high")
        heads = checkpointed(heads.select("h", F.explode(F.array_distinct("x")).alias("x")).select("h", "x.*"))
        met = _side(picks, 2).join(broadcast_if_small(_side(heads, 1)), "h").where(_may_link())
        every.append(links(met.select(F.col("node1").alias("a"), F.col("node2").alias("b")), texts, shingle))
        roots = _labelled(roots, every[-1])
    roots = _contracted(roots, reduce(DataFrame.unionByName, every))
    # Wherever two components still meet: whatever is outside the largest, with all others.
    heads = first.join(broadcast_if_small(roots), "node").groupBy("h").agg(F.mode("root").alias("main"), (F.count(F.lit(1)) > HOT).alias("hot"), *meet)
    heads = checkpointed(heads.where("low <> high").select("h", "main", "hot"))
    if heads.isEmpty():
        return roots
    heads = broadcast_if_small(heads)
    rows = checkpointed(first.join(heads, "h").join(broadcast_if_small(roots), "node"))
    hot = checkpointed(rows.where("hot").select("node").distinct())
    maps = texts.join(broadcast_if_small(hot), "node", "left_semi").mapInArrow(_maps(shingle, ["node"]), "node long, size long, map array<long>")
    maps = checkpointed(maps.groupBy("node").agg(F.first("map").alias("map")))
    rows = rows.where("hot").join(maps, "node").unionByName(rows.where("NOT hot").withColumn("map", F.lit(None).cast("array<long>")))
    rows = checkpointed(rows)
    outside = _side(rows.where("root <> main"), 1, "map")
    met = _side(rows, 2, "map").join(outside, "h").where(_may_link() & _may_share()).select(F.least("node1", "node2").alias("a"), F.greatest("node1", "node2").alias("b"))
    found = links(met, texts, shingle)
    return roots if found.isEmpty() else _contracted(roots, found)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs``, all columns, one for each group: that with the least id.

    Of rows that share that id, one stays.
    """
    own, (node, id_, n, i) = docs.columns, unused(docs, "node", "id", "n", "i")
    roots = broadcast_if_small(components(docs, id_col, text_col, shingle))
    keyed = docs.withColumn(node, F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))).withColumn(id_, F.col(id_col).cast("long"))
    rows = keyed.groupBy(F.col(node).alias("node"), F.col(id_).alias("id")).agg(F.count(F.lit(1)).alias("rows"))
    rows = checkpointed(rows.join(roots, "node", "left").select("node", "id", "rows", F.coalesce("root", "node").alias("root")))
    rank = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("node").alias("node"))
    groups = checkpointed(rows.groupBy("root").agg(F.min(rank).alias("x"), F.sum("rows").alias("many")).where("many > 1"))
    rows = rows.join(broadcast_if_small(groups), "root").withColumn("stays", F.col("id").eqNullSafe(F.col("x.id")) & (F.col("node") == F.col("x.node")))
    # Rows that go, and those of which one of several equal ones stays.
    special = checkpointed(rows.where("NOT stays OR rows > 1").select(F.col("node").alias(n), F.col("id").alias(i), "stays"))
    same = (F.col(node) == F.col(n)) & F.col(id_).eqNullSafe(F.col(i))
    kept = keyed.join(broadcast_if_small(special.select(n, i)), same, "left_anti").select(*(F.col(f"`{c}`") for c in own))
    several = special.where("stays").select(n, i)
    if several.isEmpty():
        return kept
    return kept.unionByName(keyed.join(broadcast_if_small(several), same, "left_semi").dropDuplicates([node, id_]).select(*(F.col(f"`{c}`") for c in own)))

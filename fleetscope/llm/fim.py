"""Fill-in-middle transformation: pieces of each document, put in order by a secondary sort.

A document of n code points is cut at two places, drawn by the SHA-256 of seed and id,
into prefix, middle and suffix. Its form is ``psm`` (``<P>`` prefix ``<S>`` suffix ``<M>`` middle), ``spm``
(``<S>`` suffix ``<P>`` prefix ``<M>`` middle) or ``plain`` (the text as it is: when it is empty, holds a mark itself, or is
not among the ``rate`` hundredths that are transformed).

Each document is emitted as pieces of at most ``chunk`` code points, keyed by document and
place in the output. One exchange deals the pieces out by document, each partition is
sorted by document and place, and tasks stream it into incremental digests, so that no
task holds a document's whole output (``repartition`` and ``sortWithinPartitions``: what
``repartitionAndSortWithinPartitions`` is to an RDD). For restoration the same stream is
parsed by its marks alone, the parts it finds are sorted anew by their place in the text,
inside the partition they are in, and digested again: the texts are moved once.

A document's key is a hash of the row and of the task that read it, and its number in
that task; all its pieces come from one task and go to one, whatever is run again, and
rows that repeat are dealt out too.

Edge cases: a null text counts as empty; empty texts are plain; a null id is drawn for
as ``null``; ids may repeat, each row is transformed by itself; an empty table gives an
empty result; further columns, of any name, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.common import id_text

MARKS = {"prefix": "<P>", "suffix": "<S>", "middle": "<M>"}
FORMS = {"psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle"), "plain": ()}
#: Of a hundred documents those that are transformed, and of a hundred of these those whose suffix comes first.
RATE, SUFFIX_FIRST = 90, 20
SEED = "1:"
CHUNK = 4096
FLUSH_BYTES = 4 << 20
_PLACE = {"prefix": 0, "middle": 1, "suffix": 2}
_KEY = [("row_key", pa.int64()), ("task", pa.int32()), ("no", pa.int64())]
_ABOUT = [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())]
PIECES = pa.schema([*_KEY, ("pos", pa.int64()), ("data", pa.binary()), *_ABOUT])
PARTS = pa.schema([*_KEY, ("place", pa.int32()), ("seq", pa.int64()), ("data", pa.binary()), *_ABOUT, ("output_sha256", pa.string())])
DIGESTS = pa.schema([*_ABOUT, ("output_sha256", pa.string()), ("restored_sha256", pa.string())])
OUTPUTS = pa.schema([*_ABOUT, ("output", pa.string())])


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.string(): "string"}
    return ", ".join(f"{x.name} {kinds[x.type]}" for x in schema)


class _Rows:
    """Rows gathered up to some bytes, handed on as a batch."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.size = schema, [], 0

    def add(self, row: tuple, size: int = 64) -> bool:
        self.rows.append(row)
        self.size += size
        return self.size >= FLUSH_BYTES

    def batch(self) -> pa.RecordBatch:
        columns = zip(*self.rows) if self.rows else [()] * len(self.schema)
        self.rows, self.size, made = [], 0, [pa.array(c, x.type) for c, x in zip(columns, self.schema)]
        return pa.RecordBatch.from_arrays(made, schema=self.schema)


def plan(doc_id: int | None, text: str, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: str = SEED) -> tuple[str, int, int]:
    """Form of a text, and where its prefix and its middle end."""
    digest = hashlib.sha256(f"{seed}{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or h3 % 100 >= rate or any(m in text for m in MARKS.values()):
        return "plain", 0, 0
    cuts = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
    return ("spm" if h4 % 100 < suffix_first else "psm"), *cuts


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: str = SEED) -> DataFrame:
    """The pieces of all documents' outputs (``PIECES``); the piece at place 0 tells about the document."""
    rows = id_text(docs, id_col, text_col).withColumn("task", F.spark_partition_id()).withColumn("row_key", F.xxhash64("doc_id", "text", "task"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, no = _Rows(PIECES), 0
        for batch in batches:
            for doc_id, text, task, key in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "task", "row_key"))):
                form, first, second = plan(doc_id, text, rate, suffix_first, seed)
                part = {"prefix": (0, first), "middle": (first, second), "suffix": (second, len(text))}
                about = (doc_id, len(text), form, None if form == "plain" else first, None if form == "plain" else second - first)
                pos = 0
                for mark, (start, end) in [(MARKS[p], part[p]) for p in FORMS[form]] or [("", (0, len(text)))]:
                    for at in range(start, max(end, start + 1), chunk):
                        data = ((mark if at == start else "") + text[at : min(at + chunk, end)]).encode()
                        full = out.add((key, task, no, pos, data, *(about if pos == 0 else (None,) * len(about))), len(data) + 100)
                        pos += 1
                        if full:
                            yield out.batch()
                no += 1
        yield out.batch()

    return rows.mapInArrow(emit, _ddl(PIECES))


def in_order(pieces: DataFrame) -> DataFrame:
    """The pieces dealt out by document; each partition sorted by document and place."""
    return pieces.repartition("row_key").sortWithinPartitions("row_key", "task", "no", "pos")


class _Parser:
    """Takes an output in consecutive pieces and gives its parts, by the form's marks alone; a mark may span pieces."""

    def __init__(self, form: str):
        self.awaited = [(MARKS[p].encode(), _PLACE[p]) for p in FORMS[form]]
        self.place, self.rest = (0 if form == "plain" else -1), b""

    def take(self, data: bytes) -> Iterator[tuple[int, bytes]]:
        data = self.rest + data
        while self.awaited:
            mark, place = self.awaited[0]
            at = data.find(mark)
            if at < 0:
                # What may begin the mark stays.
                keep = min(len(data), len(mark) - 1)
                self.rest = data[len(data) - keep :]
                yield self.place, data[: len(data) - keep]
                return
            yield self.place, data[:at]
            self.place, data = place, data[at + len(mark) :]
            self.awaited.pop(0)
        self.rest = b""
        yield self.place, data

    def end(self) -> Iterator[tuple[int, bytes]]:
        if self.awaited:
            raise ValueError("an output lacks a mark of its form")
        yield self.place, self.rest


def _documents(batches: Iterator[pa.RecordBatch], names: list[str], first: str) -> Iterator[tuple[bool, tuple]]:
    """Rows of a sorted partition, each with whether a document begins; the places of a document must have no gap."""
    due = 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in names)):
            pos = row[names.index(first)]
            if pos not in (0, due):
                raise ValueError("a document's pieces have a gap")
            due = pos + 1
            yield pos == 0, row


def assemble(pieces: DataFrame) -> DataFrame:
    """``PARTS`` of all documents from pieces in order: what the output's marks divide, and last (place 3) the output's digest."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, key, about, digest, parser, seq = _Rows(PARTS), None, None, None, None, 0
        nothing = (None,) * (len(_ABOUT) + 1)

        def closing() -> Iterator[tuple]:
            if key is not None:
                for place, data in parser.end():
                    if data:
                        yield (*key, place, seq, data, *nothing)
                yield (*key, 3, seq + 1, b"", *about, digest.hexdigest())

        for begins, row in _documents(batches, PIECES.names, "pos"):
            if begins:
                for x in closing():
                    if out.add(x):
                        yield out.batch()
                key, about = row[:3], row[5:]
                digest, parser, seq = hashlib.sha256(), _Parser(about[2]), 0
            digest.update(row[4])
            for place, data in parser.take(row[4]):
                if data:
                    if place < 0:
                        raise ValueError("an output has text before its first mark")
                    seq += 1
                    if out.add((*key, place, seq, data, *nothing), len(data) + 100):
                        yield out.batch()
        for x in closing():
            out.add(x)
        yield out.batch()

    return pieces.mapInArrow(stream, _ddl(PARTS))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: str = SEED) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256``, one row for each row of ``docs``."""
    parts = assemble(in_order(cut(docs, id_col, text_col, chunk, rate, suffix_first, seed))).sortWithinPartitions("row_key", "task", "no", "place", "seq")

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, digest = _Rows(DIGESTS), hashlib.sha256()
        for batch in batches:
            for place, data, *about in zip(*(batch.column(c).to_pylist() for c in ("place", "data", *(x for x, _ in _ABOUT), "output_sha256"))):
                if place < 3:
                    digest.update(data)
                else:
                    if out.add((*about, digest.hexdigest()), 400):
                        yield out.batch()
                    digest = hashlib.sha256()
        yield out.batch()

    return parts.mapInArrow(restore, _ddl(DIGESTS))


def outputs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: str = SEED) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output``: the transformed texts themselves; a task holds one output at a time."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, about, waiting = _Rows(OUTPUTS), None, []
        for begins, row in _documents(batches, PIECES.names, "pos"):
            if begins:
                if about is not None and out.add((*about, b"".join(waiting).decode()), sum(map(len, waiting)) + 100):
                    yield out.batch()
                about, waiting = row[5:], []
            waiting.append(row[4])
        if about is not None:
            out.add((*about, b"".join(waiting).decode()))
        yield out.batch()

    return in_order(cut(docs, id_col, text_col, chunk, rate, suffix_first, seed)).mapInArrow(join, _ddl(OUTPUTS))


def restored(form: str, output: str) -> str:
    """The text behind one output, by its form."""
    parser, found = _Parser(form), {0: [], 1: [], 2: []}
    for place, data in [*parser.take(output.encode()), *parser.end()]:
        if data:
            found[place].append(data)
    return b"".join(found[0] + found[1] + found[2]).decode()

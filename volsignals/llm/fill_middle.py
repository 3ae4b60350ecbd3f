"""Fill-in-the-middle transformation by a secondary sort of pieces.

A text is cut into lines, and two hashes of its id choose where its prefix and its middle end. No
task joins a document together: its parts leave the first pass as pieces, runs of whole lines of up
to ``chunk`` bytes, keyed by document and place in the output. One shuffle by document with a sort
by place inside each partition (``repartition`` and ``sortWithinPartitions``, which is
repartitionAndSortWithinPartitions on frames) brings them to a stream that feeds an incremental
digest of the output. The same stream looks for the markers in what it reads and sends every run
of text on with its place in the original; a second sort inside the partition, without a shuffle,
restores the original for a digest of its own. Memory is one batch of pieces, however long a text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from volsignals.llm.common import row_slices, whole_text, width

#: Markers of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Sections in the order of the original, and the row that ends a document.
_SECTIONS = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}
_END = 3
#: Markers in the order of the output.
ORDERS = {"plain": (), "psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
#: Most bytes of a piece.
CHUNK = 1 << 14
#: The transformation's seed, the share of texts that it takes, and of those the share in spm
#: order, both in per cent.
SEED, RATE, SPM = 7, 100, 50

_META = "n long, form string, prefix_chars long, middle_chars long, copies long"


def _cuts(text: bytes, doc_id: object, seed: int, rate: int, spm: int) -> tuple[int, str, int, int]:
    """Number of lines, form, and where prefix and middle end."""
    n = text.count(b"\n") + (not text.endswith(b"\n") if text else 0)
    name = "" if doc_id is None else str(doc_id)
    digest = hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    if not text or any(m in text for m in _SECTIONS) or h3 % 100 >= rate:
        return n, "plain", 0, 0
    breaks = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    first, last = (
        0 if not k else len(text) if k == n else int(breaks[k - 1])
        for k in sorted((h1 % (n + 1), h2 % (n + 1)))
    )
    return n, "spm" if h4 % 100 < spm else "psm", first, last


def _chunks(text: bytes, most: int) -> Iterator[bytes]:
    """Runs of whole lines of up to ``most`` bytes; a longer line is cut between characters."""
    at = 0
    while at < len(text):
        end = min(at + most, len(text))
        if end < len(text):
            line = text.rfind(b"\n", at, end) + 1
            if line > at:
                end = line
            else:
                while end > at + 1 and text[end] & 0xC0 == 0x80:
                    end -= 1
        yield text[at:end]
        at = end


#: Rows after which a stream hands on what it has, and bytes.
_ROWS, _BYTES = 4096, 1 << 22


def _batches(rows: Iterator[tuple], schema: pa.Schema, payload: int) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded size; ``payload`` is the column whose bytes count."""
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        columns = zip(zip(*held, strict=True), schema.types, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], schema=schema)

    for row in rows:
        held.append(row)
        size += len(row[payload] or b"")
        if len(held) >= _ROWS or size >= _BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def pieces(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM, chunk: int = CHUNK) -> DataFrame:
    """Pieces of all outputs: doc_id, key (of the text), place in the output, chunk.

    The first piece of a document also has n, form, prefix_chars, middle_chars and copies, the
    number of equal rows that it stands for; equal rows of one slice are combined before the
    shuffle.
    """
    id_type = docs.schema["doc_id"].dataType
    schema = pa.schema([
        ("doc_id", to_arrow_type(id_type)), ("key", pa.binary()), ("place", pa.int64()), ("chunk", pa.binary()),
        ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("copies", pa.int64()),
    ])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch):
                counts: dict[tuple, int] = {}
                for row in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    counts[row] = counts.get(row, 0) + 1
                out: list[tuple] = []
                for (doc_id, text), copies in counts.items():
                    n, form, first, last = _cuts(text, doc_id, seed, rate, spm)
                    own = {PREFIX: text[:first], MIDDLE: text[first:last], SUFFIX: text[last:]}
                    stream = [c for m in ORDERS[form] for c in (m, own[m])] or [text]
                    sizes = [len(own[m].decode(errors="replace")) if form != "plain" else None for m in (PREFIX, MIDDLE)]
                    meta = (n, form, *sizes, copies)
                    key = hashlib.sha256(text).digest()[:16]
                    # a marker goes with the piece after it
                    flat, ahead = [], b""
                    for c in stream:
                        if c in _SECTIONS:
                            ahead += c
                            continue
                        for run in _chunks(c, chunk):
                            flat.append(ahead + run)
                            ahead = b""
                    if ahead or not flat:
                        flat.append(ahead)
                    for place, run in enumerate(flat):
                        out.append((doc_id, key, place, run, *(meta if not place else (None,) * 5)))
                yield from _batches(iter(out), schema, 3)

    texts = docs.select("doc_id", whole_text().cast("binary").alias("text"))
    return texts.mapInArrow(cut, f"doc_id {id_type.simpleString()}, key binary, place long, chunk binary, {_META}")


class _Reader:
    """An output read piece by piece: its digest, and its runs of text with their section."""

    def __init__(self, form: str):
        self.digest = hashlib.sha256()
        self.expected = list(ORDERS[form])
        self.section, self.held = 0, b""

    def read(self, chunk: bytes) -> list[tuple[int, bytes]]:
        self.digest.update(chunk)
        rest, out = self.held + chunk, []
        while self.expected:
            at = rest.find(self.expected[0])
            if at < 0:
                break
            out.append((self.section, rest[:at]))
            self.section = _SECTIONS[self.expected.pop(0)]
            rest = rest[at + 3 :]
        self.held = b""
        if self.expected:  # what may be the beginning of a marker waits for the next piece
            for k in (2, 1):
                if rest.endswith(self.expected[0][:k]):
                    rest, self.held = rest[:-k], rest[-k:]
                    break
        out.append((self.section, rest))
        return [x for x in out if x[1]]

    def close(self) -> list[tuple[int, bytes]]:
        return [(self.section, self.held)] if self.held else []


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for part in row_slices(batch, "chunk"):
            yield from zip(*(c.to_pylist() for c in part.columns), strict=True)


def _opened(rows: Iterator[tuple], texts: bool) -> Iterator[tuple]:
    """Sorted pieces to runs of the original; after a document's runs the row that ends it."""
    owner, reader, run, meta, output, last = None, None, 0, None, [], -1

    def end() -> Iterator[tuple]:
        for section, chunk in reader.close():
            yield (*owner, section, run, chunk, *(None,) * 6)
        whole = b"".join(output) if texts else None
        yield (*owner, _END, 0, whole, *meta, reader.digest.hexdigest())

    for doc_id, key, place, chunk, *own in rows:
        if (doc_id, key) != owner:
            if owner is not None:
                yield from end()
            owner, reader, run, meta, output, last = (doc_id, key), _Reader(own[1]), 0, own, [], -1
        elif not place:
            meta[-1] += own[-1]  # the same rows from another slice
        if place <= last:
            continue
        last = place
        if texts:
            output.append(chunk)
        for section, part in reader.read(chunk):
            yield (doc_id, key, section, run, part, *(None,) * 6)
            run += 1
    if owner is not None:
        yield from end()


def _closed(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Runs in the order of the original to one row for each input row."""
    digest = hashlib.sha256()
    for doc_id, _, section, _, chunk, *meta, output_sha256 in rows:
        if section != _END:
            digest.update(chunk)
            continue
        n, form, prefix_chars, middle_chars, copies = meta
        for _ in range(copies):
            yield doc_id, n, form, prefix_chars, middle_chars, output_sha256, digest.hexdigest(), chunk
        digest = hashlib.sha256()


def fill_in_middle(
    docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM, texts: bool = False, chunk: int = CHUNK
) -> DataFrame:
    """Per row of ``docs``: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256.

    With ``texts`` also ``output``, the text itself (then memory holds one output at a time). Null
    texts count as empty and empty ones are plain, with n = 0; a null doc_id is hashed as an empty
    name; repeated rows get a row each; texts of any length stream in pieces; an empty table gives
    an empty one; other columns of ``docs`` are not read. The digest of the restored text is taken
    from the output and its form alone.
    """
    laid = pieces(docs, seed, rate, spm, chunk)
    id_field = laid.schema["doc_id"]
    kind, id_type = id_field.dataType.simpleString(), to_arrow_type(id_field.dataType)
    own = [("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())]
    of_runs = pa.schema([
        ("doc_id", id_type), ("key", pa.binary()), ("section", pa.int32()), ("run", pa.int64()), ("chunk", pa.binary()),
        *own, ("copies", pa.int64()), ("output_sha256", pa.string()),
    ])
    of_rows = pa.schema([
        ("doc_id", id_type), *own, ("output_sha256", pa.string()), ("restored_sha256", pa.string()), ("output", pa.binary()),
    ])

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(_opened(_rows(batches), texts), of_runs, 4)

    def closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(_closed(_rows(batches)), of_rows, 7)

    dealt = laid.repartition(width(docs.sparkSession), "doc_id", "key").sortWithinPartitions("doc_id", "key", "place")
    runs = dealt.mapInArrow(
        opened, f"doc_id {kind}, key binary, section int, run long, chunk binary, {_META}, output_sha256 string"
    )
    out = runs.sortWithinPartitions("doc_id", "key", "section", "run").mapInArrow(
        closed,
        f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, "
        "restored_sha256 string, output binary",
    )
    return out.withColumn("output", F.col("output").cast("string")) if texts else out.drop("output")


def original(output: str | Column = "output", form: str | Column = "form") -> Column:
    """The text that an output was made from, as an expression: for readers of transformed files."""
    text = F.col(output) if isinstance(output, str) else output
    kind = F.col(form) if isinstance(form, str) else form

    def between(start: bytes | None, end: bytes | None) -> Column:
        out = text
        if start:
            out = F.substring_index(out, start.decode(), -1)
        return F.substring_index(out, end.decode(), 1) if end else out

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    return F.when(kind == "psm", psm).when(kind == "spm", spm).otherwise(text)

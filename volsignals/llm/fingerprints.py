"""Threshold-scaled sketches of documents.

A sketch keeps every hash of a run of five words that is below a fixed fraction of all hashes, so
its size follows the text's, sketches of parts merge into the sketch of the whole, and both the
likeness of two texts and how much of one is contained in the other can be estimated whatever
their lengths. A text that keeps none is known by its smallest hash.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volsignals.llm import shingles as sh
from volsignals.llm.common import row_slices, utf8, whole_text, width

#: Kept share of hashes: one of so many.
SCALE = 4
#: Blocks of neighbouring ids per shuffle partition, and at most.
BLOCKS_EACH, MOST_BLOCKS = 4, 1024


def sketches(data: np.ndarray, offsets: np.ndarray, scale: int = SCALE) -> list[np.ndarray]:
    """Sorted kept hashes (their upper 32 bits) of each text."""
    hashes, first = sh.shingles(*sh.words(data, offsets))
    n = len(first) - 1
    text = np.repeat(np.arange(n), np.diff(first))
    top = (hashes >> np.uint64(32)).astype(np.uint32)
    kept = top < (1 << 32) // scale
    none = np.setdiff1d(np.flatnonzero(np.diff(first)), text[kept])
    if len(none):
        least = np.minimum.reduceat(top, first[:-1][none]) if len(none) == n else None
        for i in none:
            own = slice(first[i], first[i + 1])
            at = first[i] + int(top[own].argmin()) if least is None else first[i] + int(np.flatnonzero(top[own] == least[i])[0])
            kept[at] = True
    key = np.unique((text[kept].astype(np.uint64) << np.uint64(32)) | top[kept])
    ends = np.searchsorted(key, np.arange(n + 1, dtype=np.uint64) << np.uint64(32))
    low = (key & np.uint64(0xFFFFFFFF)).astype("<u4")
    return [low[ends[i] : ends[i + 1]] for i in range(n)]


def written(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype("<u4").tobytes()).decode()


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u4")


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sketch of two texts taken together."""
    return np.union1d(a, b)


def compared(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """Estimates: likeness of two texts' shingle sets, and the share of the first in the second.

    Two texts without words are alike; one without words is contained in anything.
    """
    if len(a) == len(b) and (a == b).all():
        return 1.0, 1.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common), common / len(a) if len(a) else 1.0


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of each row of ``docs`` (doc_id, text); null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch):
                own = [written(s) for s in sketches(*utf8(part.column("text")))]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(own, pa.string())], names=["doc_id", "fingerprint"]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fingerprint string")


_OUT = [
    ("n_chars", "long", pa.int64()), ("edited_sha256", "string", pa.string()),
    ("fingerprint", "string", pa.string()), ("edited_fingerprint", "string", pa.string()),
    ("near_edited", "double", pa.float64()), ("near_next", "double", pa.float64()),
    ("kept_in_edited", "double", pa.float64()), ("kept_in_next", "double", pa.float64()),
]


def _bytes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    return np.frombuffer(b"".join(raw), np.uint8), offsets


def _compare_run(ids: list, texts: list[str]) -> list[tuple]:
    """Rows of all but the last text, each compared with its edit and with the next text."""
    edits = [a[: len(a) - len(a) // 2] + b[: len(a) // 2] for a, b in zip(texts, texts[1:])]
    own, new = sketches(*_bytes_of(texts)), sketches(*_bytes_of(edits))
    out = []
    for i, edit in enumerate(edits):
        like, inside = compared(own[i], new[i])
        like_next, inside_next = compared(own[i], own[i + 1])
        digest = hashlib.sha256(edit.encode("utf-8", "surrogatepass")).hexdigest()
        out.append((
            ids[i], len(texts[i]), digest, written(own[i]), written(new[i]), like, like_next,
            inside, inside_next,
        ))
    return out


def _blocks(docs: DataFrame) -> tuple[list[int], list[int | None]]:
    """Cuts between blocks of ids, and the smallest id of each block.

    Both are bounded by ``MOST_BLOCKS``. The cuts only deal out the work.
    """
    n = min(MOST_BLOCKS, BLOCKS_EACH * width(docs.sparkSession))
    at = [i / n for i in range(1, n)]
    ids = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("id"))
    cuts = ids.agg(F.percentile_approx("id", at, 10 * n)).first()[0] if at else []
    cuts = sorted(set(cuts or []))
    place = _block(F.col("id"), cuts)
    least = {r[0]: r[1] for r in ids.groupBy(place.alias("b")).agg(F.min("id")).collect()}
    return cuts, [least.get(b) for b in range(len(cuts) + 1)]


def _block(doc_id, cuts: list[int]):
    """Number of cuts at or below the id, by halving."""
    def pick(low: int, high: int):
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(doc_id < cuts[mid], pick(low, mid)).otherwise(pick(mid + 1, high))

    return pick(0, len(cuts))


def edited_neighbours(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of an edit of it, and its likeness to both neighbours.

    The edit has the last half (rounded down) of the code points replaced by the first as many,
    or all, of the next document's in order of ``doc_id``; the last one's next is the first.
    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, kept_in_edited, kept_in_next (shares contained). Null text is empty; rows with one
    id follow each other in order of their text; a null id comes last; a lone row is its own
    next; an empty table gives an empty table; other columns are left out.

    Texts move once: blocks of neighbouring ids meet, and the first row of each block goes to the
    block before it as well. Tasks hold two texts and a slice at a time.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    cuts, least = _blocks(docs)
    full = [b for b, x in enumerate(least) if x is not None] or [len(cuts)]
    before = {b: full[k - 1] for k, b in enumerate(full)}
    firsts = [x for x in least if x is not None]
    doc_id = F.col("doc_id").cast("long")
    own = F.when(doc_id.isNull(), F.lit(full[-1])).otherwise(_block(doc_id, cuts))
    previous = F.element_at(F.array(*[F.lit(before.get(b, 0)) for b in range(len(cuts) + 1)]), F.col("_own") + 1)
    is_first = doc_id.isin(firsts) if firsts else doc_id.isNull()
    rows = docs.select("doc_id", whole_text().alias("text")).withColumn("_own", own)
    here = F.struct(F.col("_own").alias("block"), F.lit(0).alias("guest"))
    there = F.struct(previous.alias("block"), F.lit(1).alias("guest"))
    rows = rows.select(
        "doc_id", "text",
        F.explode(F.when(is_first, F.array(here, there)).otherwise(F.array(here))).alias("x"),
    ).select("x.block", "x.guest", "doc_id", "text")
    dealt = rows.repartition(width(docs.sparkSession), "block").sortWithinPartitions(
        "block", "guest", F.asc_nulls_last("doc_id"), "text"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = None
        block, closed, ids, texts = None, False, [], []
        for batch in batches:
            kinds = batch.schema.field("doc_id").type
            for part in row_slices(batch):
                out = []
                columns = [part.column(c).to_pylist() for c in ("block", "guest", "doc_id", "text")]
                for b, guest, doc, text in zip(*columns, strict=True):
                    if b != block:
                        out += _compare_run(ids, texts)
                        block, closed, ids, texts = b, False, [], []
                    if not closed:
                        ids.append(doc)
                        texts.append(text)
                        closed = bool(guest)
                out += _compare_run(ids, texts)
                ids, texts = ids[-1:], texts[-1:]
                if out:
                    values = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(values[0], kinds)]
                        + [pa.array(v, t) for v, (_, _, t) in zip(values[1:], _OUT, strict=True)],
                        names=["doc_id", *[n for n, _, _ in _OUT]],
                    )

    schema = ", ".join([f"doc_id {kind}", *[f"{n} {t}" for n, t, _ in _OUT]])
    return dealt.mapInArrow(run, schema)

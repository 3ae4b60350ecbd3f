"""Near-duplicates by Order MinHash.

For each of ``FUNCTIONS`` hash functions the two smallest of a text's five-word shingles are
sampled, each shingle labelled with its occurrence number, and kept in the order in which they
stand in the text: shared content in another order does not collide. Bands of ``ROWS`` such
elements are bucket keys. In every bucket each text is aligned with the bucket's lead, the text
that shares most buckets with others, such as the original of a group of copies: a group costs as
many alignments as it has texts. Texts that this leaves apart from their lead are then compared
with all texts of the same lead, a task a pair of blocks: shared shingles are counted by matrix
products, and only pairs that share enough and are not connected yet are aligned. Tasks return
links that join parts, never the pairs.

Likeness of two texts: matched shingles of the best alignment against all shingles of both, each
matched one once.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volsignals.llm import shingles as sh
from volsignals.llm.common import row_slices, stored, text_key, utf8, whole_text, width
from volsignals.llm.components import components

SIMILARITY = 0.8
FUNCTIONS, ROWS = 28, 2
#: Match points per shingle beyond which the alignment goes by whole rows instead of points.
DENSE = 16
#: Texts of a block, and shingles of one matrix product.
BLOCK, COLUMNS = 256, 4096

_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)
_SEEDS = sh.mixed(np.arange(1, FUNCTIONS + 1, dtype=np.uint64)) | np.uint64(1)


def occurrences(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """How often each shingle came before in its text."""
    order = np.lexsort((hashes, text))  # stable: equal ones stay in place order
    h, t = hashes[order], text[order]
    new = np.append(True, (h[1:] != h[:-1]) | (t[1:] != t[:-1]))[: len(h)]
    at = np.arange(len(h))
    out = np.empty(len(h), np.uint64)
    out[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return out


def order_minhash(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Elements of each text with shingles, one column per function."""
    counts = np.diff(first)
    text = np.repeat(np.arange(len(counts)), counts)
    labelled = sh.mixed(hashes + occurrences(hashes, text) * np.uint64(0x9E3779B97F4A7C15))
    begins = first[:-1][counts > 0]
    row = np.repeat(np.arange(len(begins)), counts[counts > 0])
    out = np.empty((len(begins), FUNCTIONS), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(FUNCTIONS):
            v = labelled * _SEEDS[k]
            v ^= v >> np.uint64(29)
            v *= np.uint64(0x94D049BB133111EB)
            v ^= v >> np.uint64(32)
            one = np.minimum.reduceat(v, begins)
            at = np.flatnonzero(v == one[row])
            place = np.empty(len(begins), np.int64)
            place[row[at][::-1]] = at[::-1]  # the first of equal ones
            v[place] = _MAX
            two = np.minimum.reduceat(v, begins)
            at = np.flatnonzero(v == two[row])
            other = place.copy()
            other[row[at][::-1]] = at[::-1]
            a, b = np.minimum(place, other), np.maximum(place, other)
            out[:, k] = sh.mixed(labelled[a] * np.uint64(3) + labelled[b])
    return out


def bands(elements: np.ndarray) -> np.ndarray:
    """One hash per band of elements."""
    n = FUNCTIONS // ROWS
    out = np.empty((len(elements), n), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            h = np.full(len(elements), np.uint64(k + 1))
            for j in range(ROWS):
                h = sh.mixed(h * np.uint64(0x9E3779B97F4A7C15) + elements[:, k * ROWS + j])
            out[:, k] = h
    return out


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the text) and band keys of every row of ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = FUNCTIONS // ROWS
        for batch in batches:
            for part in row_slices(batch):
                hashes, at = sh.words(*utf8(part.column("text")))
                runs, first = sh.shingles(hashes, at)
                full = np.diff(first) > 0
                keys = bands(order_minhash(runs, first)) if full.any() else np.zeros((0, width), np.uint64)
                ends = np.concatenate([[0], np.cumsum(full * width)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), part.column("key"),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel().view(np.int64))),
                    ],
                    names=["doc_id", "key", "bands"],
                )

    rows = docs.select("doc_id", text_key().alias("key"), whole_text().alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, key string, bands array<long>")


def _matched(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Length of the best alignment of equal members with places at most ``band`` apart."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    tail = int(differ[0]) if len(differ) else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return head + tail
    order = np.argsort(b, kind="stable")
    low = np.searchsorted(b[order], a, side="left")
    count = np.searchsorted(b[order], a, side="right") - low
    if count.sum() > DENSE * (len(a) + len(b)):
        return head + tail + _matched_rows(a, b, band)
    # longest rising run of match points, each row's places from the largest down
    ends: list[int] = []
    for i in np.flatnonzero(count).tolist():
        for k in range(low[i] + count[i] - 1, low[i] - 1, -1):
            j = int(order[k])
            if abs(i - j) <= band:
                at = bisect_left(ends, j)
                ends[at : at + 1] = [j]
    return head + tail + len(ends)


def _matched_rows(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """The same by dynamic programming over a band of the rows of a."""
    best = np.zeros(len(b) + 1, np.int32)
    for i in range(len(a)):
        low, high = max(0, i - band), min(len(b), i + band + 1)
        if low >= high:
            continue
        here = np.maximum(best[low + 1 : high + 1], best[low:high] + (b[low:high] == a[i]))
        here = np.maximum(np.maximum.accumulate(here), best[low])
        best[low + 1 : high + 1] = here
        best[high + 1 :] = np.maximum(best[high + 1 :], here[-1])
    return int(best[-1])


def likeness(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Likeness of two rows of word hashes, or 0 where it is surely below ``least``."""
    a, _ = sh.shingles(a.astype(np.uint64), np.array([0, len(a)]))
    b, _ = sh.shingles(b.astype(np.uint64), np.array([0, len(b)]))
    need = least * (len(a) + len(b)) / (1 + least)
    if min(len(a), len(b)) < need - 1e-9 or not len(a):
        return 0.0
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    if np.minimum(ca[ia], cb[ib]).sum() < need - 1e-9:
        return 0.0
    band = int(max(len(a), len(b)) - need) + 1
    m = _matched(a, b, band)
    return m / (len(a) + len(b) - m)


def _word_rows(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """key and words (32 bits of each word's hash) of one document of each wanted text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch):
                hashes, first = sh.words(*utf8(part.column("text")))
                short = (hashes >> np.uint64(32)).astype("<u4")
                own = [short[first[i] : first[i + 1]].tobytes() for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), pa.array(own, pa.binary())], names=["key", "words"]
                )

    w = wanted.select(F.col("key").alias("_key"), F.col("doc_id").alias("_doc"))
    rows = docs.select("doc_id", text_key().alias("key"), whole_text().alias("text")).join(
        w, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_key")), "left_semi"
    )
    return rows.select("key", "text").mapInArrow(run, "key string, words binary")


def _labelled(words: np.ndarray) -> np.ndarray:
    """A text's shingles, repeated ones told apart by occurrence; sorted."""
    h, _ = sh.shingles(words.astype(np.uint64), np.array([0, len(words)]))
    with np.errstate(over="ignore"):
        return np.sort(sh.mixed(h + occurrences(h, np.zeros(len(h), np.int64)) * np.uint64(0x9E3779B97F4A7C15)))


def _words_of(cell) -> np.ndarray:
    return np.frombuffer(cell, "<u4")


def _aligned(pairs: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """Likeness of each pair (a, b), 0 where it is surely below ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("words_a"), batch.column("words_b")
            like = [likeness(_words_of(a[i].as_buffer()), _words_of(b[i].as_buffer()), least) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(like, pa.float64())], names=["a", "b", "likeness"]
            )

    first = pairs.join(words.select(F.col("key").alias("a"), F.col("words").alias("words_a")), "a")
    both = first.join(words.select(F.col("key").alias("b"), F.col("words").alias("words_b")), "b")
    return both.mapInArrow(run, "a string, b string, likeness double")


def shared_counts(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """Number of shingles that each x shares with each y, by products of 0/1 matrices."""
    flat = np.concatenate([*xs, *ys])
    _, column, n = np.unique(flat, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(xs) + len(ys)), [len(v) for v in [*xs, *ys]])
    often = n[column] > 1
    row, column = row[often], (np.cumsum(n > 1) - 1)[column[often]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(xs), len(ys)), np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        own = slice(*np.searchsorted(column, [low, low + COLUMNS]))
        m = np.zeros((len(xs) + len(ys), COLUMNS), np.float32)
        m[row[own], column[own] - low] = 1
        out += m[: len(xs)] @ m[len(xs) :].T
    return out


def _joining(least: float):
    """Links between different parts among a block of texts and another one of the same lead."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "key"]).reset_index(drop=True)
        n = int((pdf["side"] == 0).sum())
        words = [_words_of(w) for w in pdf["words"]]
        keys, parts = pdf["key"].tolist(), pdf["part"].tolist()
        out: list[tuple[str, str]] = []
        if 0 < n < len(words):
            own = [_labelled(w) for w in words]
            size = np.array([len(v) for v in own])
            need = least * (size[:n, None] + size[None, n:]) / (1 + least) - 1e-9
            shared = shared_counts(own[:n], own[n:])
            number = {p: k for k, p in enumerate(dict.fromkeys(parts))}
            part = np.array([number[p] for p in parts])
            a, b = np.nonzero((shared >= need) & (part[:n, None] != part[None, n:]))
            root = list(range(len(number)))

            def find(k: int) -> int:
                while root[k] != k:
                    root[k] = root[root[k]]
                    k = root[k]
                return k

            for k in np.argsort(-(shared - need)[a, b], kind="stable").tolist():
                i, j = int(a[k]), int(b[k]) + n
                p, q = find(int(part[i])), find(int(part[j]))
                if p != q and likeness(words[i], words[j], least) >= least - 1e-12:
                    root[p] = q
                    out.append((keys[i], keys[j]))
        return pd.DataFrame(out, columns=["a", "b"])

    return run


def _links_apart(pairs: DataFrame, parts: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """Links among texts with a common lead that join parts which their lead has not joined."""
    spark = pairs.sparkSession
    at = lambda c: parts.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    part = F.coalesce("root_b", "b")
    known = stored(
        pairs.join(at("a"), "a", "left").join(at("b"), "b", "left").select(
            F.col("a").alias("lead"), F.col("b").alias("key"), part.alias("part"),
            (part != F.coalesce("root_a", "a")).alias("apart"),
        ),
        "omh-known",
    )
    # texts apart from their lead meet all texts of that lead
    sizes = known.groupBy("lead").agg(F.count_if("apart").alias("nx"), F.count(F.lit(1)).alias("ny"))
    sizes = stored(sizes.filter("nx > 0 AND ny > 1"), "omh-sizes")
    known = known.join(sizes, "lead")
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    mine = lambda n: F.pmod(F.xxhash64("key"), blocks(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    left = known.filter("apart").select("key", "part", "lead", F.lit(0).alias("side"), mine("nx").alias("i"), every("ny").alias("j"))
    right = known.select("key", "part", "lead", F.lit(1).alias("side"), every("nx").alias("i"), mine("ny").alias("j"))
    rows = stored(left.unionByName(right), "omh-blocks").join(words, "key")
    dealt = rows.repartition(width(spark), "lead", "i", "j")
    return dealt.groupBy("lead", "i", "j").applyInPandas(_joining(least), "a string, b string")


def near_classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Class of each row of ``docs`` (doc_id, text): what links of likeness ``least`` connect.

    Returns doc_id, key (of the text), class_key, class_id (smallest doc_id of the class, nulls
    aside), class_size (rows), class_texts (different texts). Equal texts are in one class, empty
    and null ones too; words are runs of letters and digits with A-Z lower-cased, and a text of
    fewer than five words is one shingle. Repeated rows get the same class each; an empty table
    gives an empty table; other columns are left out.
    """
    sketch = stored(sketched(docs), "omh-sketch")
    texts = stored(
        sketch.groupBy("key").agg(F.min("doc_id").alias("doc_id")), "omh-texts"
    )
    banded = sketch.select("key", F.posexplode("bands").alias("band", "bucket"))
    buckets = banded.groupBy("band", "bucket").agg(
        F.min("key").alias("low"), F.max("key").alias("high"), F.count(F.lit(1)).alias("n")
    ).filter("low != high")
    buckets = stored(buckets.select("band", "bucket", "n"), "omh-buckets")
    members = stored(banded.join(buckets, ["band", "bucket"]).distinct(), "omh-members")
    shared = stored(members.groupBy("key").agg(F.sum("n").alias("shared")), "omh-shared")
    words = stored(_word_rows(docs, texts.join(shared, "key", "left_semi")).dropDuplicates(["key"]), "omh-words")
    leads = members.join(shared, "key").groupBy("band", "bucket").agg(
        F.max_by("key", F.struct("shared", "key")).alias("lead")
    )
    led = members.join(stored(leads, "omh-leads"), ["band", "bucket"]).filter(F.col("key") != F.col("lead"))
    pairs = stored(led.select(F.col("lead").alias("a"), F.col("key").alias("b")).distinct(), "omh-pairs")
    links = _aligned(pairs, words, least).filter(F.col("likeness") >= least - 1e-12).select("a", "b")
    links = stored(links, "omh-links")
    joined = components(links)
    more = stored(_links_apart(pairs, joined, words, least), "omh-links")
    if not more.isEmpty():
        joined = components(links.unionByName(more))
    rows = sketch.select("doc_id", "key").join(joined, F.col("key") == F.col("node"), "left").select(
        "doc_id", "key", F.coalesce("root", "key").alias("class_key")
    )
    rows = stored(rows, "omh-rows")
    classes = stored(
        rows.groupBy("class_key").agg(
            F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"),
            F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("kept"),
        ),
        "omh-classes",
    )
    sizes = rows.select("class_key", "key").distinct().groupBy("class_key").agg(
        F.count(F.lit(1)).alias("class_texts")
    )
    classes = stored(classes.join(sizes, "class_key"), "omh-classes")
    return rows.join(classes, "class_key").select(
        "doc_id", "key", "class_key", "class_id", "class_size", "class_texts",
        (F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("key") == F.col("kept.key"))).alias("kept"),
    )


def one_of_each(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each class: the smallest doc_id, null last, then text key.

    Of rows equal in id and text any one stays.
    """
    kept = near_classes(docs, least).filter("kept").groupBy("doc_id", "key").agg(
        F.count(F.lit(1)).alias("_n")
    )
    kept = kept.select(F.col("doc_id").alias("_doc"), F.col("key").alias("_key"), "_n")
    own = [f"_own{i}" for i in range(len(docs.columns))]
    names = dict(zip(docs.columns, own, strict=True))
    rows = docs.select(*[F.col(f"`{c}`").alias(o) for c, o in names.items()]).withColumn(
        "_text_key", text_key(names["text"])
    )
    rows = rows.join(
        kept, F.col(names["doc_id"]).eqNullSafe(F.col("_doc")) & (F.col("_text_key") == F.col("_key"))
    )
    single, several = rows.filter("_n = 1"), rows.filter("_n > 1")
    back = [F.col(o).alias(c) for c, o in names.items()]
    return single.unionByName(several.dropDuplicates([names["doc_id"], "_text_key"])).select(*back)

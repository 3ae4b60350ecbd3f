"""Line dedup by winnowing over line hashes.

A window is a shortest run of lines with at least ``MIN_WORDS`` words, taken forwards and
backwards from every line. The smallest line hash in a window is its fingerprint, so any two runs
of so many words that are alike share one. Fingerprints met in more than one place are joined;
only around these are the matches extended both ways, by the hashes of the windows that hold the
fingerprint. A window that stands earlier somewhere else is a later copy, and its lines go. Every
line of a longer run is in such a window, whole runs are deleted, and the first copy of any line
stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volsignals.llm import shingles as sh
from volsignals.llm.common import row_slices, stored, utf8, whole_text

#: Words of the shortest run that counts as repeated.
MIN_WORDS = 10


def lines_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of every line; a text has one line more than line feeds."""
    feeds = np.flatnonzero(data == 10)
    texts = np.concatenate([np.searchsorted(offsets[1:], feeds, side="right"), np.arange(len(offsets) - 1)])
    starts = np.concatenate([feeds + 1, offsets[:-1]])
    ends = np.concatenate([feeds, offsets[1:]])
    by_start, by_end = np.lexsort((starts, texts)), np.lexsort((ends, texts))
    return starts[by_start], ends[by_end], texts[by_start]


def windows_of(
    words: np.ndarray, texts: np.ndarray, n_texts: int, least: int
) -> tuple[np.ndarray, np.ndarray]:
    """First and last line of every window; each line here has words."""
    sums = np.concatenate([[0], np.cumsum(words)])
    first = np.searchsorted(texts, np.arange(n_texts))
    stop = np.searchsorted(texts, np.arange(n_texts), side="right")
    at = np.arange(len(words))
    to = np.searchsorted(sums, sums[:-1] + least) - 1
    on = to < stop[texts]
    back = np.searchsorted(sums, sums[1:] - least, side="right") - 1
    off = back >= first[texts]
    pairs = np.unique(
        np.concatenate([at[on] << 32 | to[on], back[off] << 32 | at[off]]).astype(np.int64)
    )
    return pairs >> 32, pairs & 0xFFFFFFFF


def _fingerprints(docs: DataFrame, least: int) -> DataFrame:
    """Per document and fingerprint: how often the line occurs in it, and the windows it is of."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    windows_type = pa.struct([("hash", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch):
                data, offsets = utf8(part.column("text"))
                starts, ends, texts = lines_of(data, offsets)
                word_starts = sh.word_places(data, offsets)[0]
                words = np.searchsorted(word_starts, ends) - np.searchsorted(word_starts, starts)
                number = np.arange(len(starts)) - np.searchsorted(texts, texts)
                full = words > 0
                starts, ends, texts, words, number = (
                    x[full] for x in (starts, ends, texts, words, number)
                )
                hashes = sh.range_hashes(sh.RAW[data], starts, ends)
                first, last = windows_of(words, texts, part.num_rows, least)
                if not len(first):
                    continue
                whole = sh.range_hashes(hashes, first, last + 1)
                edges = np.column_stack([first, last + 1]).ravel()
                least_hash = np.minimum.reduceat(np.append(hashes, np.uint64(0)), edges)[::2]
                doc = texts[first]
                order = np.lexsort((first, least_hash, doc))
                doc, least_hash = doc[order], least_hash[order]
                new = np.append(True, (doc[1:] != doc[:-1]) | (least_hash[1:] != least_hash[:-1]))
                heads = np.flatnonzero(new)
                # occurrences of the fingerprint's line in its document
                by_line = np.lexsort((hashes, texts))
                t, h = texts[by_line], hashes[by_line]
                run_heads = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (h[1:] != h[:-1])))
                run_sizes = np.diff(np.append(run_heads, len(t)))
                mine = {k: n for k, n in zip(zip(t[run_heads].tolist(), h[run_heads].tolist()), run_sizes.tolist())}
                times = [mine[k] for k in zip(doc[heads].tolist(), least_hash[heads].tolist())]
                found = pa.StructArray.from_arrays(
                    [
                        pa.array(whole[order].view(np.int64)),
                        pa.array(number[first[order]], pa.int32()),
                        pa.array(number[last[order]], pa.int32()),
                    ],
                    fields=list(windows_type),
                )
                rows = pa.array(doc[heads])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(rows), part.column("text_id").take(rows),
                        pa.array(least_hash[heads].view(np.int64)), pa.array(times, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(np.append(heads, len(doc)), pa.int32()), found),
                    ],
                    names=["doc_id", "text_id", "fingerprint", "times", "windows"],
                )

    schema = (
        f"doc_id {kind}, text_id long, fingerprint long, times long, "
        "windows array<struct<hash: long, first: int, last: int>>"
    )
    return docs.mapInArrow(run, schema)


def _place(*more: Column | str) -> Column:
    """Where a row stands: by id, nulls last, then by text."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_id", *more)


def repeated_runs(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """Per document (doc_id, text_id) the runs (first, last line) that stand earlier elsewhere.

    In order of their first line, which is that of their last line too: windows are shortest, so
    none lies in another one without its first and last line.
    """
    keyed = docs.select("doc_id", F.xxhash64(whole_text()).alias("text_id"), whole_text().alias("text"))
    prints = stored(_fingerprints(keyed, least), "line-prints")
    met = prints.groupBy("fingerprint").agg(F.sum("times").alias("n")).filter("n > 1")
    around = prints.join(met.select("fingerprint"), "fingerprint").select(
        "doc_id", "text_id", F.inline("windows")
    )
    around = stored(around, "line-windows")
    place = _place("first")
    firsts = around.groupBy("hash").agg(
        F.min(place).alias("earliest"), F.max(place).alias("latest")
    ).filter("earliest != latest").select("hash", "earliest")
    later = around.join(firsts, "hash").filter(place > F.col("earliest"))
    return later.groupBy("doc_id", "text_id").agg(
        F.array_sort(F.collect_set(F.struct("first", "last"))).alias("runs")
    )


def deduplicate(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """``docs`` (doc_id, text, any others) without the later copies of repeated runs of lines.

    The text is what is left, its lines joined by line feeds; ``n_lines`` and ``n_removed`` are
    added (and replace columns of these names). Documents stand in order of doc_id, null last,
    then of a hash of the text; rows with the same id and text count as one document and keep the
    same lines. Lines without words neither make nor break a run; inside a deleted run they go.
    A null text stays null. An empty table gives an empty table.
    """
    own = [f"_own{i}" for i in range(len(docs.columns))]
    names = dict(zip(docs.columns, own, strict=True))
    runs = repeated_runs(docs, least).select(
        F.col("doc_id").alias("_doc"), F.col("text_id").alias("_text"), "runs"
    )
    kept = docs.select(*[F.col(f"`{c}`").alias(o) for c, o in names.items()])
    kept = kept.withColumn("_key", F.xxhash64(whole_text(names["text"])))
    both = kept.join(
        runs, F.col(names["doc_id"]).eqNullSafe(F.col("_doc")) & (F.col("_key") == F.col("_text")), "left"
    )
    lines = F.split(F.col(names["text"]), "\n")
    both = both.withColumn("_lines", F.when(F.col("runs").isNotNull(), lines))
    # what lies between one run and the next: every line and every run is passed once
    after = F.concat(F.array(F.lit(0)), F.transform("runs", lambda r: r["last"] + 1))
    until = F.concat(F.transform("runs", lambda r: r["first"]), F.array(F.size("_lines")))
    left = F.transform(
        F.arrays_zip(after.alias("after"), until.alias("until")),
        lambda x: F.slice("_lines", x["after"] + 1, F.greatest(x["until"] - x["after"], F.lit(0))),
    )
    both = both.withColumn("_left", F.flatten(left))
    count = F.coalesce(F.length(names["text"]) - F.length(F.replace(F.col(names["text"]), F.lit("\n"), F.lit(""))), F.lit(0)) + 1
    gone = F.coalesce(F.size("_lines") - F.size("_left"), F.lit(0))
    text = F.coalesce(F.array_join("_left", "\n"), F.col(names["text"]))
    return both.select(
        *[(text if c == "text" else F.col(o)).alias(c) for c, o in names.items() if c not in ("n_lines", "n_removed")],
        count.cast("long").alias("n_lines"),
        F.when(F.col("_lines").isNull(), 0).otherwise(gone).cast("long").alias("n_removed"),
    )

"""Removal of long repeated byte strings by a logarithmic family of suffix arrays.

A suffix is known by its place (text, byte) and ordered by the hash of its first ``PREFIX`` bytes, so
that suffixes that begin alike are neighbours. Only suffixes at anchors are indexed: every string of
``LENGTH`` bytes holds one, and equal strings hold it at the same place. Texts come in batches.
A batch gets its suffix array, sorted and written; a level has the runs of suffixes that begin alike,
sorted and in buckets. A batch's level is merge-scanned against every older level, bucket by bucket;
then levels of equal size merge into one of twice the size, so that there are logarithmically many.
Arrays and levels stay on disk (``IndexFamily``), so that a later batch meets the earlier ones.
Prefixes met twice are candidates.

A candidate's context is all that strings holding its anchor can reach. Where two places have the
same context, all of it is repeated. Where contexts differ, the hashes of the strings in them are
compared; how far an anchor's repeated strings, which all overlap, reach before and behind it is the
length of its match, one span.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volsignals.llm import repeats as rp
from volsignals.llm import shingles as sh
from volsignals.llm.common import dropped, maybe_in, release, row_slices, stored, text_key, utf8, whole_text, width
from volsignals.session import shared_folder

#: Batches of a table that comes at once.
BATCHES = 4
#: Different contexts of one prefix that a task compares, 5 MB of bytes and 100 MB of hashes; more
#: go by single strings, a row each, which any number of tasks share.
HOT = 8192
#: Contexts compared in one step.
STEP_ROWS = 2048
#: Spark's own bound on the buckets of a table.
MOST_BUCKETS = 100_000

SUFFIX = "prefix long, context long, text_id string, at int, left int, right int"
RUN = "prefix BIGINT, one BIGINT, other BIGINT, n BIGINT"


def suffixes(docs: DataFrame) -> DataFrame:
    """Anchored suffixes of every text: prefix hash, context hash, place, reach of the context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch):
                data, offsets = utf8(part.column("text"))
                own = rp.Hashed(data, offsets)
                at = own.anchors()
                doc = np.searchsorted(offsets, at, side="right") - 1
                low = np.maximum(at - (rp.SPAN - 1), offsets[doc])
                high = np.minimum(at + rp.LENGTH, offsets[doc + 1])
                with np.errstate(over="ignore"):
                    context = own.strings(low, high) + (at - low).astype(np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(own.strings(at, at + rp.PREFIX).view(np.int64)),
                        pa.array(context.view(np.int64)),
                        part.column("text_id").take(pa.array(doc)),
                        pa.array(at - offsets[doc], pa.int32()),
                        pa.array(at - low, pa.int32()), pa.array(high - at, pa.int32()),
                    ],
                    names=["prefix", "context", "text_id", "at", "left", "right"],
                )

    return docs.select("text_id", "text").mapInArrow(
        run, SUFFIX
    )


class IndexFamily:
    """Suffix arrays of batches of different texts, and levels of their sorted runs, in a folder.

    A level's row is a run of suffixes that begin alike: prefix, smallest and largest place (64 bits
    of text and byte) and number of places, so that a level holds one row for a prefix however many
    texts share it. The places themselves are in the batches' arrays. Levels are bucketed and sorted
    by prefix: scans and merges of two levels shuffle nothing.

    ``folder`` names a family that stays: its state is a file per batch that ends with a marker of
    its own, so that a driver lost while it adds a batch leaves the family as it was before. Without
    ``folder`` the family is one for the job, below the folder all executors share.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = (folder or f"{shared_folder(spark)}/suffix-family-{uuid.uuid4().hex}").rstrip("/")
        state = self._read_state()
        self.version: int = state.get("version", 0)
        self.buckets: int = state.get("buckets") or min(width(spark), MOST_BUCKETS)
        #: Batches in a level and its folder; folders of batches' arrays and of prefixes met.
        self.levels: list[tuple[int, str]] = [(n, path) for n, path in state.get("levels", [])]
        self.arrays: list[str] = state.get("arrays", [])
        self.met: list[str] = state.get("met", [])

    def _path(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _read_state(self) -> dict:
        fs, p = self._path(f"{self.folder}/state")
        if not fs.exists(p):
            return {}
        done = [
            x.getPath().toString() for x in fs.listStatus(p)
            if fs.exists(self._path(f"{x.getPath().toString()}/_SUCCESS")[1])
        ]
        return json.loads(self.spark.read.text(max(done)).first()[0]) if done else {}

    def _write_state(self) -> None:
        self.version += 1
        state = {k: getattr(self, k) for k in ("version", "buckets", "levels", "arrays", "met")}
        row = self.spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1)
        # what a lost driver left of a state that was never finished is written over
        row.write.mode("overwrite").text(f"{self.folder}/state/{self.version:09d}")

    def _new(self, kind: str) -> str:
        return f"{self.folder}/{kind}/{uuid.uuid4().hex}"

    def _name(self, path: str) -> str:
        return f"suffix_level_{path.rsplit('/', 1)[1]}"

    def _write_level(self, runs: DataFrame) -> str:
        path = self._new("levels")
        runs = runs.select("prefix", "one", "other", "n")
        runs.write.bucketBy(self.buckets, "prefix").sortBy("prefix").option("path", path).saveAsTable(self._name(path))
        return path

    def level(self, path: str) -> DataFrame:
        """A level as a table whose buckets Spark knows; named anew where another session wrote it."""
        name = self._name(path)
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(
                f"CREATE TABLE {name} ({RUN}) USING parquet CLUSTERED BY (prefix) SORTED BY (prefix) "
                f"INTO {self.buckets} BUCKETS LOCATION '{path}'"
            )
        return self.spark.table(name)

    def _gone(self, path: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self._name(path)}")
        fs, p = self._path(path)
        fs.delete(p, True)

    def merged(self, old: str, new: str) -> DataFrame:
        """The runs of two levels as those of one."""
        a, b = self.level(old), self.level(new).toDF("_prefix", "_one", "_other", "_n")
        both = a.hint("merge").join(b, F.col("prefix") == F.col("_prefix"), "full")
        zero = F.lit(0).cast("long")
        return both.select(
            F.coalesce("prefix", "_prefix").alias("prefix"), F.least("one", "_one").alias("one"),
            F.greatest("other", "_other").alias("other"),
            (F.coalesce("n", zero) + F.coalesce("_n", zero)).alias("n"),
        )

    def scanned(self, own: str, older: str) -> DataFrame:
        """Prefixes of one level that are in another."""
        a, b = self.level(own), self.level(older).select("prefix")
        return a.hint("merge").join(b, "prefix").select("prefix")

    def add(self, batch: DataFrame) -> None:
        """Scan a batch of suffixes against itself and every level, then keep it as a level.

        ``batch``: columns of ``suffixes``, of texts that are in no earlier batch. Rows of equal texts
        are the same places.
        """
        array = self._new("arrays")
        batch.sortWithinPartitions("prefix").write.parquet(array)
        place = F.xxhash64("text_id", "at")
        runs = self.spark.read.schema(SUFFIX).parquet(array).groupBy("prefix").agg(
            F.min(place).alias("one"), F.max(place).alias("other"), F.count(F.lit(1)).alias("n")
        )
        own = self._write_level(runs)
        found = [self.level(own).filter("one != other").select("prefix")]
        found += [self.scanned(own, level) for _, level in self.levels]
        met = self._new("met")
        reduce(DataFrame.unionByName, found).write.parquet(met)
        levels, old, size = list(self.levels), [], 1
        while levels and levels[-1][0] == size:
            _, before = levels.pop()
            old += [before, own]
            own = self._write_level(self.merged(before, own))
            size *= 2
        self.levels, self.arrays, self.met = [*levels, (size, own)], [*self.arrays, array], [*self.met, met]
        self._write_state()
        for path in old:
            self._gone(path)

    def repeated(self) -> DataFrame:
        """Prefixes that stand in two places or more."""
        return self.spark.read.schema("prefix long").parquet(*self.met).distinct()

    def suffixes(self) -> DataFrame:
        """The arrays of all batches."""
        return self.spark.read.schema(SUFFIX).parquet(*self.arrays)

    def delete(self) -> None:
        for _, path in self.levels:
            self._gone(path)
        fs, p = self._path(self.folder)
        fs.delete(p, True)


def _contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` rows (rep: text_id, at, left, right; any others) with the bytes of their context.

    ``docs``: doc_id, text_id, text; ``wanted`` names the one document to read each text from.
    """
    per = wanted.groupBy("doc_id", "text_id").agg(
        F.collect_list(F.struct("prefix", "context", "at", "left", "right", "single")).alias("own")
    )
    per = stored(per, "suffix-wanted")
    rows, _ = maybe_in(docs, "text_id", per.select("text_id"))
    w = per.select(F.col("doc_id").alias("_doc"), F.col("text_id").alias("_text"), "own")
    rows = rows.join(w, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_id") == F.col("_text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch):
                data, offsets = utf8(part.column("text"))
                raw, lists = data.tobytes(), part.column("own")
                flat = lists.flatten()
                doc = np.repeat(np.arange(part.num_rows), np.asarray(lists.value_lengths()))
                at, left, right = (np.asarray(flat.field(c)).astype(np.int64) for c in ("at", "left", "right"))
                place = offsets[doc] + at
                own = [raw[i:j] for i, j in zip((place - left).tolist(), (place + right).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[flat.field(c) for c in ("prefix", "context")],
                        part.column("text_id").take(pa.array(doc)),
                        *[flat.field(c) for c in ("at", "left", "right", "single")],
                        pa.array(own, pa.binary()),
                    ],
                    names=["prefix", "context", "text_id", "at", "left", "right", "single", "bytes"],
                )

    # rows with one id and text are one document
    return rows.select("text_id", "text", "own").mapInArrow(
        run,
        "prefix long, context long, text_id string, at int, left int, right int, single boolean, bytes binary",
    )


def _strings(rows: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, distance before the anchor, and hash of every string that holds a row's anchor."""
    data, offsets = utf8(rows.column("bytes"))
    left, right = (np.asarray(rows.column(c)).astype(np.int64) for c in ("left", "right"))
    least, most = np.maximum(0, rp.LENGTH - right), np.minimum(left, rp.SPAN - 1)
    n = np.maximum(0, most - least + 1)
    row = np.repeat(np.arange(len(n)), n)
    before = least[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    start = offsets[row] + left[row] - before
    return row, before, rp.Hashed(data, offsets).strings(start, start + rp.LENGTH)


def _compared(contexts: DataFrame) -> DataFrame:
    """Spans of the single contexts, a prefix's contexts being compared in one task."""

    def spans(rows: pa.Table) -> pa.RecordBatch:
        row, before, h = _strings(rows.combine_chunks().to_batches()[0])
        # a string may hold several anchors: it is repeated if it begins in two places
        at = np.asarray(rows.column("at")).astype(np.int64)
        text = np.asarray(rows.column("text_id").combine_chunks().dictionary_encode().indices).astype(np.int64)
        place = text[row] << 32 | (at[row] - before)
        order = np.lexsort((place, h))
        heads = np.flatnonzero(np.append(True, h[order][1:] != h[order][:-1])) if len(h) else np.zeros(0, int)
        tails = np.append(heads[1:], len(h))
        differ = place[order[heads]] != place[order[tails - 1]] if len(h) else np.zeros(0, bool)
        again = np.zeros(len(h), bool)
        again[order] = np.repeat(differ, tails - heads)
        n = rows.num_rows
        most, least = np.full(n, -1), np.full(n, rp.LENGTH)
        np.maximum.at(most, row[again], before[again])
        np.minimum.at(least, row[again], before[again])
        found = (most >= 0) & np.asarray(rows.column("single"))
        return pa.RecordBatch.from_arrays(
            [
                rows.column("text_id").combine_chunks().filter(pa.array(found)),
                pa.array((at - most)[found], pa.int32()), pa.array((at - least + rp.LENGTH)[found], pa.int32()),
            ],
            names=["text_id", "start", "end"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for at in range(0, batch.num_rows, STEP_ROWS):
                held.append(batch.slice(at, STEP_ROWS))
                rows = pa.Table.from_batches(held)
                key = np.asarray(rows.column("prefix"))
                cut = int(np.flatnonzero(key != key[-1])[-1]) + 1 if (key != key[-1]).any() else 0
                if cut >= STEP_ROWS:
                    yield spans(rows.slice(0, cut))
                    rows = rows.slice(cut)
                held = rows.to_batches()
        if held:
            yield spans(pa.Table.from_batches(held))

    dealt = contexts.repartition(width(contexts.sparkSession), "prefix").sortWithinPartitions("prefix")
    return dealt.mapInArrow(run, "text_id string, start int, end int")


def _compared_one_by_one(contexts: DataFrame) -> DataFrame:
    """The same for prefixes with very many contexts: a row per string, grouped by its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STEP_ROWS):
                part = batch.slice(at, STEP_ROWS)
                row, before, h = _strings(part)
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(h.view(np.int64)), part.column("text_id").take(rows),
                        part.column("at").take(rows), pa.array(before, pa.int32()),
                        part.column("single").take(rows),
                    ],
                    names=["hash", "text_id", "at", "before", "single"],
                )

    strings = stored(
        contexts.mapInArrow(run, "hash long, text_id string, at int, before int, single boolean"), "suffix-strings"
    )
    place = F.xxhash64("text_id", F.col("at") - F.col("before"))
    again = strings.groupBy("hash").agg(F.min(place).alias("one"), F.max(place).alias("other"))
    again = stored(again.filter("one != other").select("hash"), "suffix-again")
    return strings.filter("single").join(again, "hash", "left_semi").groupBy("text_id", "at").agg(
        (F.col("at") - F.max("before")).alias("start"), (F.col("at") - F.min("before") + rp.LENGTH).alias("end")
    ).select("text_id", "start", "end")


def repeated_spans(docs: DataFrame, batches: int = BATCHES, family: IndexFamily | None = None) -> DataFrame:
    """text_id and spans (bytes) of what stands elsewhere too. ``docs``: doc_id, text_id, text.

    ``family``: one that stays. Texts it does not hold yet are added to it in ``batches`` batches.
    """
    spark = docs.sparkSession
    texts = stored(
        docs.groupBy("text_id").agg(
            F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"), F.max(F.octet_length("text")).alias("n_bytes")
        ),
        "suffix-texts",
    )
    own = family or IndexFamily(spark)
    later = bool(own.arrays)
    new = docs
    if later:
        new = docs.join(own.suffixes().select("text_id").distinct(), "text_id", "left_anti")
    found = suffixes(new)
    if batches > 1:
        found = stored(found, "suffixes")
    for b in range(batches):
        own.add(found.filter(F.pmod(F.xxhash64("text_id"), F.lit(batches)) == b) if batches > 1 else found)
    repeated = stored(own.repeated(), "suffix-repeated")
    release(spark)
    rows = own.suffixes().join(repeated, "prefix", "left_semi")
    if later:
        # texts that are not among the documents any more are no places
        rows = rows.join(texts.select("text_id"), "text_id", "left_semi")
    rows = stored(rows.distinct(), "suffix-rows")
    if batches > 1:
        dropped(found)
    if family is None:
        own.delete()
    place = F.xxhash64("text_id", "at")
    alike = stored(
        rows.groupBy("prefix", "context").agg(
            (F.min(place) == F.max(place)).alias("single"),
            F.min(F.struct("text_id", "at", "left", "right")).alias("x"),
        ).select("prefix", "context", "single", "x.*"),
        "suffix-contexts",
    )
    # equal contexts: all of them is repeated
    several = alike.filter("NOT single").select("prefix", "context")
    whole = rows.join(several, ["prefix", "context"], "left_semi").filter(F.col("left") + F.col("right") >= rp.LENGTH)
    whole = whole.select("text_id", (F.col("at") - F.col("left")).alias("start"), (F.col("at") + F.col("right")).alias("end"))
    # different contexts of one prefix
    sizes = stored(
        alike.groupBy("prefix").agg(F.count(F.lit(1)).alias("contexts")).filter("contexts > 1"), "suffix-sizes"
    )
    wanted = alike.join(sizes, "prefix").join(texts.select("text_id", "doc_id"), "text_id")
    wanted = wanted.filter(F.col("left") + F.col("right") >= rp.LENGTH)
    contexts = _contexts(docs, wanted.drop("contexts"))
    contexts = stored(contexts.join(sizes, "prefix"), "suffix-bytes")
    release(spark)
    few, many = contexts.filter(f"contexts <= {HOT}"), contexts.filter(f"contexts > {HOT}")
    # texts that stand in two documents
    copied = texts.filter(f"n > 1 AND n_bytes >= {rp.LENGTH}").select(
        "text_id", F.lit(0).alias("start"), F.col("n_bytes").alias("end")
    )
    spans = reduce(DataFrame.unionByName, [whole, _compared(few), _compared_one_by_one(many), copied])
    return spans.groupBy("text_id").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def _cut(raw: bytes, spans: list[dict]) -> tuple[bytes, int]:
    """What is left of a text, and the number of maximal removed runs."""
    runs: list[list[int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in spans):
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], end)
        else:
            runs.append([start, end])
    edges = [0, *[x for r in runs for x in r], len(raw)]
    return b"".join(raw[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)), len(runs)


def without_repeats(docs: DataFrame, batches: int = BATCHES, family: IndexFamily | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): the bytes left when repeated ones are removed.

    A byte goes if a string of 400 bytes over it also starts elsewhere, in the same document or
    another, judged on the input. Returns doc_id, n_bytes, n_removed, n_spans, kept (binary, null
    where nothing is removed) and kept_sha256. Null text is empty; rows equal in id and text are
    copies of each other like any other rows; an empty table gives an empty table; other columns
    are left out.

    ``family``: an index that stays on disk. ``docs`` is still the whole table, but only texts that the
    family does not hold are hashed, sorted and scanned; the result is that of one run over ``docs``.
    Texts that the family holds and ``docs`` does not are no copies of anything.
    """
    keyed = docs.select("doc_id", text_key().alias("text_id"), whole_text().alias("text"))
    spans = stored(repeated_spans(keyed, batches, family), "suffix-spans")
    release(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    maybe, rest = maybe_in(keyed, "text_id", spans.select("text_id"))
    joined = maybe.join(spans, "text_id", "left").select("doc_id", "text", "spans")

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            for part in row_slices(batch):
                out = []
                for text, own in zip(part.column("text"), part.column("spans")):
                    raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                    kept, n = _cut(raw, own.as_py() or [])
                    out.append((len(raw), len(raw) - len(kept), n, kept if n else None, hashlib.sha256(kept).hexdigest()))
                n_bytes, gone, n, kept, digest = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(gone, pa.int64()),
                        pa.array(n, pa.int64()), pa.array(kept, pa.binary()), pa.array(digest, pa.string()),
                    ],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"],
                )

    cut = joined.mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"
    )
    zero = F.lit(0).cast("long")
    whole = rest.select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"),
        F.lit(None).cast("binary").alias("kept"), F.sha2("text", 256).alias("kept_sha256"),
    )
    return cut.unionByName(whole)

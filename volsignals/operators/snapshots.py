"""The bar table on disk as a row of snapshots.

A change writes the parts it touches into a folder of its own and then names the new snapshot:
a small file with the folder of every part, which gets its number in one rename. Nothing that a
reader may be reading is overwritten. A driver that dies before the rename leaves the old snapshot
as it was and a folder nothing refers to; two writers cannot both get a number, the second one
starts again from the first one's snapshot. Old snapshots can be read until they are expired.

    <path>/data/batch=<id>/year=<y>/bucket=<b>/*.parquet
    <path>/newest/batch=<id>/*.parquet             the newest bars of every ticker (newest.py)
    <path>/snapshots/<number>                      JSON
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from volsignals.operators import newest as side
from volsignals.operators.store import delete_tickers, keep_last, upsert
from volsignals.schema import BAR_COLUMNS, BARS

#: Parts of a year on disk, by ticker, unless the first merge says otherwise.
BUCKETS = 64
#: Tasks that write a year at least; with fewer buckets a part is written by several, a file each.
TASKS = 32
LAYOUT = BARS + ", year INT, bucket INT"

Part = tuple[int, int]


class Taken(Exception):
    """Another writer has committed a snapshot meanwhile."""


@dataclass(frozen=True)
class Snapshot:
    number: int = 0
    buckets: int = BUCKETS
    parts: dict[Part, str] = field(default_factory=dict)  # the batch that holds each part
    sizes: dict[str, int] = field(default_factory=dict)  # parts that a batch was written with
    newest: str | None = None
    streams: dict[str, int] = field(default_factory=dict)  # last batch merged of each stream

    def text(self) -> str:
        parts = sorted([y, b, batch] for (y, b), batch in self.parts.items())
        return json.dumps({
            "buckets": self.buckets, "parts": parts, "sizes": self.sizes, "newest": self.newest, "streams": self.streams,
        })

    @staticmethod
    def of(number: int, text: str) -> Snapshot:
        x = json.loads(text)
        parts = {(y, b): batch for y, b, batch in x["parts"]}
        return Snapshot(number, x["buckets"], parts, x["sizes"], x["newest"], x["streams"])


# --- files, through the file system that Spark itself uses ---------------------------------


def _files(spark: SparkSession, path: str):
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Names in a folder and when they last changed; none if there is no such folder."""
    _, where, fs = _files(spark, path)
    if not fs.exists(where):
        return []
    return [(s.getPath().getName(), s.getModificationTime()) for s in fs.listStatus(where)]


def _read_text(spark: SparkSession, path: str) -> str:
    jvm, where, fs = _files(spark, path)
    stream = fs.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _remove(spark: SparkSession, path: str) -> None:
    _, where, fs = _files(spark, path)
    fs.delete(where, True)


def _swap(spark: SparkSession, path: str, number: int, text: str) -> None:
    """Give ``text`` the number of the next snapshot: written aside, then renamed, never over another."""
    draft = f"{path}/snapshots/.draft-{uuid.uuid4().hex}"
    jvm, where, fs = _files(spark, draft)
    out = fs.create(where, False)
    out.write(bytearray(text.encode()))
    out.close()
    target = jvm.org.apache.hadoop.fs.Path(f"{path}/snapshots/{number:012d}")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(where, target, none)
    except Py4JJavaError as e:
        fs.delete(where, False)
        if fs.exists(target):
            raise Taken(number) from e
        raise


# --- reading --------------------------------------------------------------------------------


def numbers(spark: SparkSession, path: str) -> list[int]:
    """Snapshots that can be read, oldest first."""
    return sorted(int(n) for n, _ in _names(spark, f"{path}/snapshots") if n.isdigit())


def snapshot(spark: SparkSession, path: str, number: int | None = None) -> Snapshot:
    """The newest snapshot or the one of a number; an empty one if nothing has been written yet."""
    have = numbers(spark, path)
    if number is None:
        number = have[-1] if have else 0
    if not number:
        return Snapshot()
    return Snapshot.of(number, _read_text(spark, f"{path}/snapshots/{number:012d}"))


def _stored(spark: SparkSession, path: str, state: Snapshot, only: set[Part] | None = None) -> DataFrame:
    """The bars of a snapshot's parts; a batch of which every part is wanted is read as one folder."""
    wanted = {p: b for p, b in state.parts.items() if only is None or p in only}
    if not wanted:
        return spark.createDataFrame([], LAYOUT)
    counts: dict[str, int] = {}
    for batch in wanted.values():
        counts[batch] = counts.get(batch, 0) + 1
    folder = lambda batch: f"{path}/data/batch={batch}"
    whole = {b for b, n in counts.items() if n == state.sizes.get(b)}
    paths = [folder(b) for b in sorted(whole)]
    paths += [f"{folder(b)}/year={y}/bucket={k}" for (y, k), b in sorted(wanted.items()) if b not in whole]
    rows = spark.read.schema(LAYOUT).option("basePath", f"{path}/data").parquet(*paths)
    return rows.select(*BAR_COLUMNS, "year", "bucket")


def read_bars(
    spark: SparkSession, path: str, years: list[int] | None = None, number: int | None = None
) -> DataFrame:
    """Bars at ``path``, of ``years`` if given, as of snapshot ``number`` or the newest one.

    Only the folders of the snapshot's parts in these years are listed and read. The frame keeps
    reading its snapshot, whatever is committed later.
    """
    state = snapshot(spark, path, number)
    only = None if years is None else {p for p in state.parts if p[0] in years}
    return _stored(spark, path, state, only).drop("year", "bucket")


def read_newest(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The newest bars of every ticker, kept with the table: nothing of history is read."""
    state = snapshot(spark, path, number)
    if state.newest is None:
        return spark.createDataFrame([], side.NEWEST)
    return spark.read.schema(side.NEWEST).parquet(f"{path}/newest/batch={state.newest}")


# --- writing --------------------------------------------------------------------------------


def _part(buckets: int) -> tuple[Column, Column]:
    return F.year("date").alias("year"), F.pmod(F.xxhash64("ticker"), F.lit(buckets)).cast("int").alias("bucket")


def _laid(rows: DataFrame, buckets: int) -> DataFrame:
    """Rows with those of a part in one task, or in one of a few by ticker."""
    slices = F.pmod(F.xxhash64("ticker", F.lit("slice")), F.lit(-(-TASKS // buckets)))
    return rows.withColumn("_slice", slices).repartition("year", "bucket", "_slice")


def _merged(old: DataFrame, new: DataFrame, buckets: int) -> DataFrame:
    """Upsert of rows of the same parts, both unique: they meet once, on their part, and are sorted once."""
    rows = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    key = Window.partitionBy("year", "bucket", "ticker", "date", "_slice").orderBy(F.desc("_new"))
    return _laid(rows, buckets).withColumn("_place", F.row_number().over(key)).filter("_place = 1")


def _commit(
    spark: SparkSession, path: str, state: Snapshot, touched: set[Part], rows: DataFrame,
    newest: Callable[[DataFrame], DataFrame], streams: dict[str, int],
) -> int:
    """Write ``rows``, laid out by part, as the new content of the parts ``touched`` and swap the snapshot.

    ``newest`` makes the table of newest bars from the rows as written.
    """
    batch = uuid.uuid4().hex
    folder = f"{path}/data/batch={batch}"
    (
        rows.sortWithinPartitions("year", "bucket", "ticker", "date")
        .select(*BAR_COLUMNS, "year", "bucket")
        .write.partitionBy("year", "bucket")
        .parquet(folder)
    )
    # bounded by the calendar and the number of buckets, not by the data
    own: set[Part] = set()
    for year, _ in _names(spark, folder):
        if year.startswith("year="):
            own |= {
                (int(year[5:]), int(b[7:])) for b, _ in _names(spark, f"{folder}/{year}") if b.startswith("bucket=")
            }
    if not own and not touched:  # nothing has come
        _remove(spark, folder)
        return state.number
    newest(spark.read.schema(LAYOUT).parquet(folder)).write.parquet(f"{path}/newest/batch={batch}")
    kept = {p: b for p, b in state.parts.items() if p not in touched}
    parts = kept | dict.fromkeys(own, batch)
    sizes = {b: n for b, n in state.sizes.items() if b in kept.values()} | {batch: len(own)}
    new = Snapshot(state.number + 1, state.buckets, parts, sizes, batch, state.streams | streams)
    _swap(spark, path, new.number, new.text())
    return new.number


def _changed(
    spark: SparkSession, path: str, buckets: int,
    change: Callable[[Snapshot], tuple[set[Part], DataFrame, Callable[[DataFrame], DataFrame]] | None],
    streams: dict[str, int] | None = None,
) -> int:
    """Apply ``change`` to the newest snapshot; again to a newer one if another writer was first."""
    while True:
        state = snapshot(spark, path)
        if not state.number:
            state = Snapshot(buckets=buckets)
        if streams and all(state.streams.get(k, -1) >= n for k, n in streams.items()):
            return state.number  # merged before a failure, and now repeated
        found = change(state)
        if found is None:
            return state.number
        try:
            return _commit(spark, path, state, *found, streams or {})
        except Taken:
            continue


def merge_bars(
    spark: SparkSession, path: str, new: DataFrame, buckets: int = BUCKETS, stream: tuple[str, int] | None = None,
    unique: bool = False,
) -> int:
    """Upsert ``new`` into the table at ``path``; returns the number of the snapshot.

    A part is a year and a hash bucket of tickers, so a late bar rewrites one part of its year. Old and
    new rows meet by one plain shuffle on the part (a range sort would sample its input, that is compute it
    twice) and lie sorted by ticker and date, so that lookups prune row groups. ``buckets`` counts for
    the table's first snapshot only. ``stream``: a name and a batch number; a batch that a
    snapshot already has is not merged again. ``unique``: ``new`` has one row per ticker and date;
    otherwise the last of several is found first.
    """
    if not unique:
        order = ["ingest_seq"] if "ingest_seq" in new.columns else []
        rest = [c for c in new.columns if c not in ("ticker", "date", *order)]
        new = keep_last(new, ["ticker", "date"], F.struct(*order, *rest))

    def change(state: Snapshot) -> tuple[set[Part], DataFrame, Callable[[DataFrame], DataFrame]] | None:
        parted = new.select(*BAR_COLUMNS, *_part(state.buckets))
        newest = lambda written: side.merge_newest(read_newest(spark, path, state.number), written)
        if not state.parts:  # nothing to find or to replace, so that the rows are read once
            return set(), _laid(parted, state.buckets), newest
        new.persist()
        touched = {tuple(r) for r in parted.select("year", "bucket").distinct().collect()}
        if not touched:
            return None
        old = _stored(spark, path, state, touched & set(state.parts))
        return touched, _merged(old, parted, state.buckets), newest

    try:
        return _changed(spark, path, buckets, change, dict([stream]) if stream else None)
    finally:
        new.unpersist()


def delete_bars(spark: SparkSession, path: str, tickers: list[str]) -> int:
    """S15 on disk: the parts that may hold these tickers are written anew without them."""
    return replace_bars(spark, path, tickers, None)


def replace_bars(spark: SparkSession, path: str, tickers: list[str], new: DataFrame | None) -> int:
    """S14 on disk: all bars of ``tickers`` go and theirs in ``new`` come, in one snapshot."""
    names = spark.createDataFrame([(t,) for t in tickers], "ticker STRING")

    def change(state: Snapshot) -> tuple[set[Part], DataFrame, Callable[[DataFrame], DataFrame]] | None:
        bucket = _part(state.buckets)[1]
        hit = {r.bucket for r in names.select(bucket).distinct().collect()}
        touched = {p for p in state.parts if p[1] in hit}
        rows = delete_tickers(_stored(spark, path, state, touched), tickers)
        newest = delete_tickers(read_newest(spark, path, state.number), tickers)
        if new is not None:
            own = new.filter(F.col("ticker").isin(tickers)).select(*BAR_COLUMNS, *_part(state.buckets))
            more = {tuple(r) for r in own.select("year", "bucket").distinct().collect()}
            beside = _stored(spark, path, state, (more - touched) & set(state.parts))
            rows = upsert(rows.unionByName(beside), own)
            newest = side.merge_newest(newest, upsert(own.limit(0), own))
            touched |= more
        return (touched, _laid(rows, state.buckets), lambda _: newest) if touched else None

    return _changed(spark, path, BUCKETS, change)


def expire(spark: SparkSession, path: str, keep: int = 2, orphans_after: float = 24 * 3600) -> None:
    """Forget all but the newest ``keep`` snapshots, and remove what only they refer to.

    Folders that no snapshot refers to are what a failed writer left, or what a running one is
    writing; they go once they have been left alone for ``orphans_after`` seconds.
    """
    have = numbers(spark, path)
    gone, stay = have[: max(0, len(have) - max(keep, 1))], have[max(0, len(have) - max(keep, 1)) :]
    states = {n: snapshot(spark, path, n) for n in have}
    for n in gone:  # first, so that nobody begins to read what goes
        _remove(spark, f"{path}/snapshots/{n:012d}")
    used = {(b, p) for n in stay for p, b in states[n].parts.items()}
    newest = {states[n].newest for n in stay}
    for b, (y, k) in {(b, p) for n in gone for p, b in states[n].parts.items()} - used:
        _remove(spark, f"{path}/data/batch={b}/year={y}/bucket={k}")
    known = {b for s in states.values() for b in (*s.parts.values(), s.newest)}
    last = {b for b, _ in used}
    for folder, live in (("data", last), ("newest", newest)):
        for name, changed in _names(spark, f"{path}/{folder}"):
            batch = name.removeprefix("batch=")
            old = time.time() - changed / 1000 > orphans_after
            if batch not in live and (batch in known or old):
                _remove(spark, f"{path}/{folder}/{name}")
    for name, changed in _names(spark, f"{path}/snapshots"):
        if name.startswith(".draft-") and time.time() - changed / 1000 > orphans_after:
            _remove(spark, f"{path}/snapshots/{name}")

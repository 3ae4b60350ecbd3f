"""Packing documents into sequences by a grouping genetic algorithm on islands.

Documents become pieces of at most ``CAPACITY`` tokens, rows of a few numbers each. Full pieces
are sequences of their own. The others are dealt into shards of a bounded number of pieces; every
shard is packed by several islands, tasks of their own that start from different packings. A
crossover injects whole well-filled bins of one packing into another, takes out the bins that
hold any of their pieces, and best-fits the pieces that this displaces. Between epochs each
island's best packing moves to the next island. The winner's poorly filled bins are opened, and
their pieces go, with those of other shards, to the next, smaller level. After the last of these
levels only the emptiest bin of each shard is opened, and a few shards merge into one, until one is
left.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volsignals.llm.common import row_slices, stored, whole_text, width

CAPACITY = 4096
END_ID = 1
#: Pieces of a shard on the first level and on later ones, islands, epochs, packings per island,
#: crossovers per epoch.
SHARD, LATER_SHARD, ISLANDS, EPOCHS, POPULATION, CROSSOVERS = 1536, 256, 2, 2, 4, 12
GROUPS_PER_TASK = 8
#: A bin with more than this share open is opened again, on so many levels; after them, shards whose
#: emptiest bins merge.
OPEN_SHARE, LEVELS, MERGED = 0.002, 6, 8

_PIECE = "doc_id {}, piece int, start long, length long, ids_crc32 long, row long"
_tokens: dict[str, object] = {}


def _tokenizer(path: str):
    if path not in _tokens:
        from volsignals.llm.word_tokens import WordTokens

        _tokens[path] = WordTokens(path)
    return _tokens[path]


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of every document: its tokens, cut only where there are too many.

    ``row`` is a number of its own for each row (task and place); read it from a stored table.
    """
    kind = docs.schema["doc_id"].dataType
    end = np.array([END_ID], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        tokens = _tokenizer(vocabulary)
        for batch in batches:
            for part in row_slices(batch):
                doc, out = [], []
                ids = tokens.ids(part.column("text").to_pylist())
                for i, own in enumerate(ids):
                    own += end
                    for k, at in enumerate(range(0, len(own), 4 * capacity)):
                        one = own[at : at + 4 * capacity]
                        doc.append(i)
                        out.append((k, at // 4, len(one) // 4, zlib.crc32(one), row))
                        row += 1
                k, start, length, crc, rows = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(doc)), pa.array(k, pa.int32()),
                        pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                        pa.array(crc, pa.int64()), pa.array(rows, pa.int64()),
                    ],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "row"],
                )

    texts = docs.select("doc_id", whole_text().alias("text"))
    return texts.mapInArrow(cut, _PIECE.format(kind.simpleString()))


class Bins:
    """A packing under way: pieces of each bin, and open space, sorted for best fit."""

    def __init__(self, lengths: list[int], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.bins: list[list[int]] = []
        self.open: list[tuple[int, int]] = []

    def add(self, members: list[int]) -> None:
        insort(self.open, (self.capacity - sum(map(self.lengths.__getitem__, members)), len(self.bins)))
        self.bins.append(members)

    def best_fit(self, items: list[int]) -> None:
        """Each piece into the bin it leaves least space in, else into a new one."""
        for i in items:
            size = self.lengths[i]
            at = bisect_left(self.open, (size, -1))
            if at == len(self.open):
                insort(self.open, (self.capacity - size, len(self.bins)))
                self.bins.append([i])
            else:
                space, k = self.open.pop(at)
                self.bins[k].append(i)
                insort(self.open, (space - size, k))


def _worth(packing: list[list[int]], lengths: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then bins that are fuller or emptier rather than alike."""
    fills = [sum(map(lengths.__getitem__, b)) / capacity for b in packing]
    return -len(packing), sum(f * f for f in fills)


def crossed(
    host: list[list[int]], donor: list[list[int]], lengths: list[int], capacity: int,
    rng: np.random.Generator,
) -> list[list[int]]:
    """``host`` with some well-filled bins of ``donor`` in place of what they collide with."""
    fills = np.array([sum(map(lengths.__getitem__, b)) for b in donor])
    best = np.argsort(-fills, kind="stable")[: max(1, (len(donor) * 2) // 3)]
    chosen = rng.choice(best, max(1, len(best) // 2), replace=False)
    injected = [donor[i] for i in chosen]
    taken = {i for b in injected for i in b}
    child, displaced = Bins(lengths, capacity), []
    for b in host:
        if taken.isdisjoint(b):
            child.add(list(b))
        else:
            displaced += [i for i in b if i not in taken]
    for b in injected:
        child.add(list(b))
    displaced.sort(key=lambda i: -lengths[i])
    child.best_fit(displaced)
    return child.bins


def evolve(
    lengths: list[int], starts: list[list[list[int]]], capacity: int, seed: list[int],
) -> list[list[int]]:
    """The best packing of one island after an epoch."""
    rng = np.random.default_rng(seed)
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    least = -(-sum(lengths) // capacity)

    def fresh(noise: float) -> list[list[int]]:
        b = Bins(lengths, capacity)
        size = np.array(lengths) * (1 + noise * rng.random(len(lengths)))
        b.best_fit(order if not noise else np.argsort(-size, kind="stable").tolist())
        return b.bins

    alive = [(_worth(p, lengths, capacity), p) for p in starts]
    for noise in (0.0, 0.05, 0.2, 0.5)[: max(0, POPULATION - len(alive))]:
        if alive and max(alive, key=lambda x: x[0])[0][0] == -least:
            break
        p = fresh(noise)
        alive.append((_worth(p, lengths, capacity), p))
    for _ in range(CROSSOVERS):
        alive.sort(key=lambda x: x[0], reverse=True)
        if alive[0][0][0] == -least or len(alive) < 2:
            break
        a, b = rng.choice(len(alive), 2, replace=False)
        child = crossed(alive[a][1], alive[b][1], lengths, capacity, rng)
        alive[-1] = max(alive[-1], (_worth(child, lengths, capacity), child), key=lambda x: x[0])
    return max(alive, key=lambda x: x[0])[1]


def _packings(pdf: pd.DataFrame) -> list[list[list[int]]]:
    """The packings that a group's rows carry, by origin; places are those of sorted rows."""
    out = []
    for _, own in pdf.groupby("origin"):
        bins: dict[int, list[int]] = {}
        for i, b in enumerate(own.sort_values("row")["bin"].tolist()):
            bins.setdefault(b, []).append(i)
        out.append(list(bins.values()))
    return out


def _tasks(rows: DataFrame, groups: int) -> int:
    """A task for each few groups; a group is small, so more tasks would only cost their start."""
    return max(1, min(groups, width(rows.sparkSession)), groups // GROUPS_PER_TASK)


def _island_epoch(rows: DataFrame, groups: int, level: int, epoch: int, capacity: int) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        starts = _packings(pdf) if epoch else []
        own = pdf[pdf["origin"] == 0].sort_values("row").reset_index(drop=True)
        shard, island = int(own["shard"].iloc[0]), int(own["island"].iloc[0])
        best = evolve(own["length"].tolist(), starts, capacity, [level, epoch, shard, island])
        bin_of = np.empty(len(own), np.int64)
        for k, members in enumerate(best):
            bin_of[members] = k
        own["bin"], own["bins"] = bin_of, len(best)
        return own

    spread = rows.repartition(_tasks(rows, groups), "shard", "island")
    return spread.groupBy("shard", "island").applyInPandas(run, rows.schema)


def _settle(rows: DataFrame, groups: int, level: int, capacity: int, last: bool) -> DataFrame:
    """The best island's packing of each shard: sequence, place in it, and whether it is final.

    From the last of ``LEVELS`` on, all bins but the emptiest are.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        best = pdf.sort_values(["bins", "island"], kind="stable")["island"].iloc[0]
        own = pdf[pdf["island"] == best].sort_values(["bin", "row"]).reset_index(drop=True)
        fill = own.groupby("bin")["length"].transform("sum")
        own["offset"] = own.groupby("bin")["length"].cumsum() - own["length"]
        own["sequence_id"] = ((level + 1) << 58) + own["shard"] * (1 << 16) + own["bin"]
        own["settled"] = True if last else fill >= capacity * (1 - OPEN_SHARE)
        if level >= LEVELS - 1:
            own["settled"] |= own["bin"] != own["bin"].loc[fill.idxmin()]
        return own[[*carried, "sequence_id", "offset", "settled"]]

    carried = ["doc_id", "piece", "start", "length", "ids_crc32", "row"]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in carried)
    spread = rows.repartition(_tasks(rows, groups), "shard").groupBy("shard")
    return spread.applyInPandas(run, f"{schema}, sequence_id long, offset long, settled boolean")


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of ``docs`` (doc_id, text) with its sequence and place in it.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null or empty text is
    one piece, the end id alone; repeated rows are packed each; other columns are left out. No
    sequence has more than ``capacity`` tokens, and offsets have no gaps. An empty table gives an
    empty table.
    """
    cut = stored(pieces(docs, vocabulary, capacity), "pack-pieces")
    full = F.col("length") == capacity
    done = [
        cut.filter(full).withColumn("sequence_id", F.col("row")).withColumn("offset", F.lit(0).cast("long"))
    ]
    rest, level, shards = cut.filter(~full), 0, 0
    n = rest.count()
    while n:
        # one open bin a shard, so MERGED shards hold fewer than MERGED * capacity tokens
        shards = -(-shards // MERGED) if level >= LEVELS else -(-n // (LATER_SHARD if level else SHARD))
        groups = shards * ISLANDS
        rows = (
            rest.withColumn("shard", F.pmod(F.xxhash64("row", F.lit(level)), F.lit(shards)))
            .withColumn("island", F.explode(F.array(*map(F.lit, range(ISLANDS)))))
            .withColumns({c: F.lit(0).cast("long") for c in ("origin", "bin", "bins")})
        )
        for epoch in range(EPOCHS):
            if epoch:
                moved = rows.withColumn("island", (F.col("island") + 1) % ISLANDS)
                rows = rows.unionByName(moved.withColumn("origin", F.lit(1).cast("long")))
            rows = _island_epoch(rows, groups, level, epoch, capacity)
        out = stored(_settle(rows, shards, level, capacity, shards == 1), "pack-level")
        done.append(out.filter("settled"))
        rest = out.filter("NOT settled").drop("sequence_id", "offset", "settled")
        n, level = rest.count(), level + 1
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    found = [d.select(*names) for d in done]
    out = found[0]
    for d in found[1:]:
        out = out.unionByName(d)
    return out

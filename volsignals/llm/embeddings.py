"""Near-duplicate embeddings by an inverted multi-index.

Each half of the unit vectors has a codebook of its own, fitted on a bounded sample; a vector's
cell is its pair of nearest codewords in the product grid. A vector is compared with the members
of the cells that the multi-sequence traversal of its two sorted codeword lists meets first. How
many cells it visits is set on a bounded set of query vectors, whose true links among all vectors
are found block by block: the target share of queries must meet the target share of their links.
Where too few queries have links, probes at the limiting cosine count as well, and where a quarter
of the cells would be visited all vectors are compared. Every pair met is verified by its cosine
in double precision.

Equal vectors are one row with a weight. A cell is compared block by block, a task a pair of
blocks, so that no task holds a whole cell; tasks return link counts and a spanning forest, never
the pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volsignals.llm.common import stored, width
from volsignals.llm.components import components

COSINE = 0.9
#: Vectors that codebooks are fitted on, and vectors per cell aimed at.
SAMPLE, PER_CELL = 8192, 64
#: Codewords per half at most, rounds of fitting, share of queries and of each one's links to be met.
MOST_WORDS, ROUNDS, RECALL = 256, 12, 0.9995
#: Queries that the number of visits is set on, their bytes at most, linked ones that are enough.
QUERIES, QUERY_BYTES, ENOUGH = 16384, 1 << 26, 1000
#: Probes for each of so many queries where too few are linked.
PROBES, PROBED = 4, 2048
#: Vectors of a block, and tasks of the comparison at most.
BLOCK, MOST_TASKS = 512, 1 << 15


def _vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, key and unit vector (doubles as bytes); both null where nothing can be linked."""
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, units = [], []
            for one in batch.column("embedding"):
                raw = None
                if one.is_valid and not one.values.null_count:
                    v = np.asarray(one.values, np.float64)
                    top = np.abs(v).max(initial=0)
                    if np.isfinite(v).all() and top > 0:
                        v = v / top  # so that no square under- or overflows
                        raw = (v / np.sqrt(v @ v)).tobytes()
                units.append(raw)
                keys.append(hashlib.blake2b(raw, digest_size=16).hexdigest() if raw else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(keys, pa.string()), pa.array(units, pa.binary())],
                names=["vec_id", "key", "unit"],
            )

    return vectors.select("vec_id", "embedding").mapInArrow(run, f"vec_id {kind}, key string, unit binary")


def codebook(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means centres of the rows of ``x``, started from rows spread by distance."""
    rng = np.random.default_rng(seed)
    centres = x[[int(rng.integers(len(x)))]]
    far = ((x - centres[0]) ** 2).sum(1)
    for _ in range(k - 1):
        p = far / far.sum() if far.sum() > 0 else None
        new = x[int(rng.choice(len(x), p=p))]
        centres = np.vstack([centres, new])
        far = np.minimum(far, ((x - new) ** 2).sum(1))
    for _ in range(ROUNDS):
        own = _distances(x, centres).argmin(1)
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)).clip(0)


class Index:
    """Codebooks of both halves of vectors of one length, and how many cells a vector visits."""

    def __init__(self, sample: np.ndarray, n: int):
        self.half = sample.shape[1] // 2
        self.k = int(np.clip(np.sqrt(n / PER_CELL), 1, min(MOST_WORDS, len(sample))))
        self.words = [codebook(x, self.k, s) for s, x in enumerate(self._halves(sample))]
        self.visits = 1

    def _halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.half], x[:, self.half :]

    def distances(self, x: np.ndarray) -> list[np.ndarray]:
        return [_distances(h, c) for h, c in zip(self._halves(x), self.words, strict=True)]

    def own(self, x: np.ndarray) -> np.ndarray:
        d = self.distances(x)
        return d[0].argmin(1) * self.k + d[1].argmin(1)

    def ranks(self, one: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """How many cells the traversal of the vector ``one`` meets before each of ``cells``, ties all before."""
        d = [x[0] for x in self.distances(one[None])]
        sums = np.sort((d[0][:, None] + d[1]).ravel())
        to = d[0][cells // self.k] + d[1][cells % self.k]
        own = d[0].argmin() * self.k + d[1].argmin()
        return np.where(cells == own, 0, np.searchsorted(sums, to + 1e-12, side="right") - 1)

    def probed(self, queries: np.ndarray, cosine: float) -> int:
        """Cells to visit so that ``RECALL`` of vectors at the limiting cosine are met.

        Half of the probes lie off their query towards other queries, the others in any direction.
        """
        rng = np.random.default_rng(0)
        ranks = [np.zeros(1, np.int64)]
        for q in queries[:PROBED]:
            to = rng.standard_normal((PROBES, len(q)))
            to[: PROBES // 2] = queries[rng.integers(len(queries), size=PROBES // 2)]
            to -= (to @ q)[:, None] * q
            size = np.sqrt((to**2).sum(1, keepdims=True))
            to = (to / np.where(size > 1e-9, size, 1))[size[:, 0] > 1e-9]
            ranks.append(self.ranks(q, self.own(cosine * q + np.sqrt(max(0, 1 - cosine**2)) * to)))
        return int(np.quantile(np.concatenate(ranks), RECALL, method="higher")) + 1

    def fit_visits(self, needs: list[int], whole: bool, queries: np.ndarray, cosine: float) -> None:
        """``needs``: the visits of each query that has links; ``whole``: every vector is a query."""
        most = int(np.quantile(needs, RECALL, method="higher")) if needs else 1
        if not whole and len(needs) < ENOUGH:
            most = max(most, self.probed(queries, cosine))
        if 4 * most >= self.k * self.k:  # all vectors as one cell: no more copies, and none is missed
            self.k, self.words, most = 1, [w[:1] for w in self.words], 1
        self.visits = most

    def traverse(self, x: np.ndarray) -> np.ndarray:
        """The first cells of each row in order of distance; its own cell comes first.

        The t-th nearest cell pairs ranks (i, j) with i * j <= t, so only those are tried.
        """
        d = self.distances(x)
        order = [np.argsort(h, axis=1, kind="stable") for h in d]
        near = [np.take_along_axis(h, o, 1) for h, o in zip(d, order, strict=True)]
        t = min(self.visits, self.k * self.k)
        i, j = np.nonzero(np.outer(np.arange(1, self.k + 1), np.arange(1, self.k + 1)) <= t)
        sums = near[0][:, i] + near[1][:, j]
        pick = np.argsort(sums, axis=1, kind="stable")[:, :t]
        return order[0][np.arange(len(x))[:, None], i[pick]] * self.k + order[1][np.arange(len(x))[:, None], j[pick]]


def _needs(distinct: DataFrame, index: Index, queries: np.ndarray, keys: list[str], cosine: float) -> list[int]:
    """For each query that has links among all vectors, the visits that meet ``RECALL`` of them."""
    dims, place = queries.shape[1], {k: i for i, k in enumerate(keys)}

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in _parts(batch):
                x = np.frombuffer(b"".join(part.column("unit").to_pylist())).reshape(-1, dims)
                linked = x @ queries.T >= cosine
                for i, key in enumerate(part.column("key").to_pylist()):
                    if key in place:
                        linked[i, place[key]] = False
                seen = np.flatnonzero(linked.any(0))
                if not len(seen):
                    continue
                own = index.own(x)
                order = np.argsort(own, kind="stable")
                cells, starts = np.unique(own[order], return_index=True)
                n = np.add.reduceat(linked[:, seen][order], starts, axis=0, dtype=np.int64)
                c, q = np.nonzero(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seen[q], pa.int64()), pa.array(cells[c], pa.int64()), pa.array(n[c, q], pa.int64())],
                    names=["query", "cell", "n"],
                )

    def need(pdf: pd.DataFrame) -> pd.DataFrame:
        ranks = index.ranks(queries[int(pdf["query"].iloc[0])], pdf["cell"].to_numpy())
        order = np.argsort(ranks, kind="stable")
        met = pdf["n"].to_numpy()[order].cumsum()
        enough = np.searchsorted(met, RECALL * met[-1] - 1e-9)
        return pd.DataFrame({"need": [int(ranks[order][enough]) + 1]})

    found = distinct.filter(F.octet_length("unit") == 8 * dims).select("key", "unit").mapInArrow(links, "query long, cell long, n long")
    found = found.groupBy("query", "cell").agg(F.sum("n").alias("n"))
    return [r[0] for r in found.groupBy("query").applyInPandas(need, "need long").collect()]


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Rows of one length, a slice at a time, with that length."""
    sizes = np.array([len(u.as_buffer()) // 8 for u in batch.column("unit")], np.int64)
    for dims in np.unique(sizes).tolist():
        rows = batch.filter(pa.array(sizes == dims))
        for at in range(0, rows.num_rows, 512):
            yield dims, rows.slice(at, 512)


def _visited(distinct: DataFrame, indexes: dict[int, Index], first: dict[int, int]) -> DataFrame:
    """key, unit, weight and the cells to visit, own cell first.

    ``first``: by length, the number of its first cell; a length without an index is one cell.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dims, part in _parts(batch):
                cells = np.full((part.num_rows, 1), first[dims], np.int64)
                if dims in indexes:
                    x = np.frombuffer(b"".join(part.column("unit").to_pylist())).reshape(-1, dims)
                    cells = indexes[dims].traverse(x) + first[dims]
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(cells) + 1) * cells.shape[1], pa.int32()), pa.array(cells.ravel(), pa.int64())
                )
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in ("key", "unit", "weight")], lists],
                    names=["key", "unit", "weight", "visits"],
                )

    return distinct.select("key", "unit", "weight").mapInArrow(
        run, "key string, unit binary, weight long, visits array<long>"
    )


def _forest(linked: np.ndarray, n: int) -> np.ndarray:
    """For each row and then each column of a link matrix, the smallest of those it is joined to."""
    m, q = linked.shape
    rows, columns = np.arange(m), np.arange(m, m + q)
    while True:
        down = np.minimum(columns, np.where(linked, rows[:, None], n).min(0, initial=n))
        across = np.minimum(rows, np.where(linked, down[None, :], n).min(1, initial=n))
        if (down == columns).all() and (across == rows).all():
            return np.concatenate([rows, columns])
        rows, columns = across, down


def _compare(cosine: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "key"]).reset_index(drop=True)
        x = np.frombuffer(b"".join(pdf["unit"])).reshape(len(pdf), -1)
        side = pdf["side"].to_numpy()
        own_cell, home = int(pdf["cell"].iloc[0]), pdf["home"].to_numpy()
        m = int((side == 0).sum())
        inner = pdf["diagonal"].iloc[0]
        if inner:  # one block with itself
            linked = np.triu(x @ x.T >= cosine, 1)
            a, b = np.nonzero(linked)
            top = 0
        else:
            linked = x[:m] @ x[m:].T >= cosine
            a, b = np.nonzero(linked)
            # a pair whose both ends visit each other's cell counts where the smaller cell visits
            foreign = home[m:][b] > own_cell
            if foreign.any():
                lists = {i: set(pdf["visits"].iloc[i]) for i in np.unique(a[foreign])}
                drop = np.array([f and home[m + k] in lists[i] for i, k, f in zip(a, b, foreign)], bool)
                linked[a[drop], b[drop]] = False
                a, b = a[~drop], b[~drop]
            top = m
        weight = pdf["weight"].to_numpy()
        n = np.bincount(a, weight[b + top], len(x)) + np.bincount(b + top, weight[a], len(x))
        if inner:
            full = linked | linked.T
            root = np.arange(len(x))
            while True:
                new = np.minimum(root, np.where(full, root[None, :], len(x)).min(1, initial=len(x)))
                if (new == root).all():
                    break
                root = new
        else:
            root = _forest(linked, len(x))
        keep = n > 0
        keys = pdf["key"].to_numpy()
        return pd.DataFrame({"key": keys[keep], "n": n[keep].astype(np.int64), "root": keys[root[keep]]})

    return run


def _index(distinct: DataFrame, dims: int, n: int, cosine: float) -> Index:
    """The index of the ``n`` vectors of one length."""
    rows = distinct.filter(F.octet_length("unit") == 8 * dims).select("unit", "key").orderBy("key")
    queries = max(1, min(QUERIES, QUERY_BYTES // (8 * dims)))
    taken = rows.limit(max(SAMPLE, queries)).collect()
    x = np.frombuffer(b"".join(t.unit for t in taken)).reshape(-1, dims)
    index = Index(x[:SAMPLE], n)
    if index.k > 1:
        needs = _needs(distinct, index, x[:queries], [t.key for t in taken[:queries]], cosine)
        index.fit_visits(needs, queries >= n, x[:queries], cosine)
    return index


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Links of cosine ``cosine`` or more among all rows of ``vectors`` (vec_id, embedding).

    Returns vec_id, n_links (other rows linked directly), component_id (smallest vec_id reached by
    links, nulls aside, its own included) and kept (it is the component's id). A null or zero
    vector, and one with null or non-finite components, links with nothing; vectors link with those
    of their length only; repeated rows are rows of their own, linked to each other. An empty table
    gives an empty table; other columns are left out.
    """
    spark = vectors.sparkSession
    rows = stored(_vectors(vectors), "vec-rows")
    distinct = stored(
        rows.filter("key IS NOT NULL").groupBy("key").agg(F.first("unit").alias("unit"), F.count(F.lit(1)).alias("weight")),
        "vec-distinct",
    )
    sizes = {
        r[0] // 8: r[1] for r in distinct.groupBy(F.octet_length("unit")).agg(F.count(F.lit(1))).orderBy(F.octet_length("unit")).collect()
    }
    own = rows.select("vec_id", "key")
    if not sizes:
        return own.select(
            "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")
        )
    indexes = {dims: _index(distinct, dims, n, cosine) for dims, n in sizes.items() if n >= 4 * PER_CELL}
    first, cells = {}, 0
    for dims in sizes:
        first[dims] = cells
        cells += indexes[dims].k ** 2 if dims in indexes else 1
    placed = stored(_visited(distinct, indexes, first), "vec-placed")
    # blocks of members and parts of visitors per cell: at most k * k rows a length, k <= MOST_WORDS
    at = placed.select(F.posexplode("visits").alias("rank", "cell")).groupBy("cell").agg(
        F.count_if(F.col("rank") == 0).alias("members"), F.count_if(F.col("rank") > 0).alias("visitors")
    )
    cells = [(r.cell, -(-r.members // BLOCK), -(-r.visitors // BLOCK)) for r in at.filter("members > 0").collect()]
    full = spark.createDataFrame(cells, "cell long, blocks int, parts int")
    block = F.pmod(F.xxhash64("key"), F.lit(1 << 30))
    visits = placed.select("*", F.posexplode("visits").alias("rank", "cell")).join(F.broadcast(full), "cell")
    mine = (block % F.col("blocks")).cast("int")
    each = F.sequence(F.lit(0), F.col("blocks") - 1)
    # a member's block i meets the blocks j >= i of its cell, as the left or the right side
    member = F.transform(
        each,
        lambda j: F.struct(
            F.least(mine, j).alias("left"), F.greatest(mine, j).alias("right"),
            F.when(mine <= j, 0).otherwise(1).alias("side"), (mine == j).alias("diagonal"), F.lit(0).alias("kind"),
        ),
    )
    # a visitor meets every block of the cell; visitors are cut into parts of their own number
    part = (block / F.lit(7)).cast("long") % F.col("parts")
    visitor = F.transform(
        each,
        lambda j: F.struct(
            j.alias("left"), part.cast("int").alias("right"), F.lit(1).alias("side"), F.lit(False).alias("diagonal"), F.lit(1).alias("kind"),
        ),
    )
    host = F.transform(
        F.when(F.col("parts") > 0, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array().cast("array<int>")),
        lambda j: F.struct(
            mine.alias("left"), j.alias("right"), F.lit(0).alias("side"), F.lit(False).alias("diagonal"), F.lit(1).alias("kind"),
        ),
    )
    dealt = visits.withColumn(
        "to", F.explode(F.when(F.col("rank") == 0, F.concat(member, host)).otherwise(visitor))
    ).select("key", "unit", "weight", "visits", "cell", "to.*")
    # only hosts of visitors are asked what they visit; of the others their own cell is enough
    dealt = dealt.withColumn("home", F.col("visits")[0]).withColumn(
        "visits", F.when((F.col("kind") == 1) & (F.col("side") == 0), F.col("visits"))
    )
    groups = sum(b * (b + 1) // 2 + b * p for _, b, p in cells)
    tasks = dealt.repartition(max(width(spark), min(groups // 32, MOST_TASKS)), "cell", "kind", "left", "right")
    found = tasks.groupBy("cell", "kind", "left", "right").applyInPandas(
        _compare(cosine), "key string, n long, root string"
    )
    found = stored(found, "vec-found")
    links = stored(found.groupBy("key").agg(F.sum("n").alias("n")), "vec-links")
    joined = components(found.select(F.col("key").alias("a"), F.col("root").alias("b")))
    weights = stored(
        distinct.select("key", "weight").join(links, "key", "left").join(
            joined.withColumnRenamed("node", "key"), "key", "left"
        ).select(
            "key", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "key").alias("root")
        ),
        "vec-weights",
    )
    out = stored(own.join(weights, "key", "left"), "vec-out")
    least = stored(
        out.filter("root IS NOT NULL").groupBy("root").agg(F.min("vec_id").alias("component_id")), "vec-least"
    )
    out = out.join(least, "root", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    )
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

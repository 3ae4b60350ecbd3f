"""Prefix trie of conversations whose heads come from another conversation.

Every conversation is rebuilt from the first turns of a base conversation and its own later ones,
but never as text. A turn is a number, a sequence of turns the product of its turns in a monoid:
``(v, n) * (w, m) = (v * B**m + w, n + m)`` modulo a prime. The products of all prefixes of the
stored conversations are taken once; a rebuilt prefix is the base's head times the quotient of two
own prefixes, so it is composed from three stored numbers, and dividing its last turn out again
gives its parent. Equal prefixes are groups of equal fingerprints, and every group is verified: all
members must have the same parent and, through references to the stored turns, the same last turn,
text by text. Should a group fail, all is done again with another base and other turn numbers.

No task holds a conversation or a node. Turns are sorted by ranges, and what a range adds to a
conversation that began in an earlier one is composed from the ranges' products. Subtree sums use
that every node belongs to its smallest member, whose nodes are one chain downwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volsignals.llm.common import dropped, stored, width

#: A conversation's base is the first of its block of so many ids; heads have fewer turns than HEADS.
BLOCK, HEADS = 100, 6
#: Modulus, and bits of the lower of the two longs that hold a number below it.
MODULUS, LOW_BITS = (1 << 107) - 1, 61
#: Depths of a chain that one window sums; ids of a node's ends that make up one piece of text.
CHAIN, ENDS = 4096, 4096

_KEY = ["depth", "hi", "lo"]
_LOW = (1 << LOW_BITS) - 1


def _base(attempt: int) -> int:
    return int.from_bytes(hashlib.sha256(f"base {attempt}".encode()).digest(), "big") % MODULUS


def _split(values: list[int]) -> tuple[pa.Array, pa.Array]:
    return pa.array([v >> LOW_BITS for v in values], pa.int64()), pa.array([v & _LOW for v in values], pa.int64())


def _joined(batch: pa.RecordBatch, hi: str, lo: str) -> list[int]:
    return [a << LOW_BITS | b for a, b in zip(batch.column(hi).to_pylist(), batch.column(lo).to_pylist(), strict=True)]


class _Powers:
    """Powers of the base, those of short sequences looked up."""

    def __init__(self, base: int):
        self.base, self.first = base, [1]
        for _ in range(255):
            self.first.append(self.first[-1] * base % MODULUS)

    def __getitem__(self, n: int) -> int:
        return self.first[n] if n < 256 else pow(self.base, n, MODULUS)


def identity(role: str = "role", text: str = "text") -> Column:
    """What makes two turns equal, as one text: the length of the role parts it from the text."""
    own = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text)]
    return F.concat(F.octet_length(own[0]).cast("string"), F.lit(":"), *own)


def numbered(turns: DataFrame, attempt: int = 0) -> DataFrame:
    """Stored turns: conv_id, part, place in the part, running product there, role, text.

    Sorted by ranges of (conv_id, turn, null first, SHA-256 of role and text). Rows without a
    conv_id belong to no conversation.
    """
    base = _base(attempt)
    rows = turns.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("_turn"), F.sha2(identity(), 256).alias("_tie"),
        F.sha2(F.concat(F.lit(f"{attempt}:"), identity()), 256).alias("_number"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    order = [F.col("conv_id"), F.col("_turn").asc_nulls_first(), F.col("_tie")]
    rows = rows.repartitionByRange(width(turns.sparkSession), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, conv, place, value = TaskContext.get().partitionId(), None, 0, 0
        for batch in batches:
            places, values, numbers = [], [], []
            for c, digest in zip(batch.column("conv_id").to_pylist(), batch.column("_number").to_pylist(), strict=True):
                if c != conv:
                    conv, place, value = c, 0, 0
                number = int(digest, 16) % MODULUS
                place, value = place + 1, (value * base + number) % MODULUS
                places.append(place)
                values.append(value)
                numbers.append(number)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("conv_id"), pa.array([part] * len(places), pa.int32()), pa.array(places, pa.int64()),
                    *_split(values), *_split(numbers), batch.column("role"), batch.column("text"),
                ],
                names=["conv_id", "part", "pos", "hi", "lo", "t_hi", "t_lo", "role", "text"],
            )

    out = rows.mapInArrow(
        run, "conv_id long, part int, pos long, hi long, lo long, t_hi long, t_lo long, role string, text string"
    )
    return stored(out.withColumn("n_chars", F.length("text").cast("long")), "turns")


def _carried(turns: DataFrame, attempt: int) -> dict[tuple[int, int], tuple[int, int]]:
    """Turns and product before a part, for conversations that lie in several parts.

    Each part boundary cuts one conversation at most, so that what comes to the driver is
    bounded by the number of parts.
    """
    spans = turns.groupBy("conv_id").agg(F.min("part").alias("first"), F.max("part").alias("last"))
    cut = spans.filter("first < last").select("conv_id")
    sizes = turns.select("conv_id", "part").join(F.broadcast(cut), "conv_id").groupBy("conv_id", "part").count()
    ends = turns.join(F.broadcast(sizes.withColumnRenamed("count", "pos")), ["conv_id", "part", "pos"])
    powers, out, state = _Powers(_base(attempt)), {}, {}
    for r in sorted(ends.select("conv_id", "part", "pos", "hi", "lo").collect()):
        n, value = state.get(r.conv_id, (0, 0))
        out[r.conv_id, r.part] = n, value
        state[r.conv_id] = n + r.pos, (value * powers[r.pos] + (r.hi << LOW_BITS | r.lo)) % MODULUS
    return out


def _whole(turns: DataFrame, carry: dict, attempt: int) -> DataFrame:
    """Numbers of the turns, places and products counted from the conversation's beginning."""
    base = _base(attempt)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers(base)
        for batch in batches:
            places, values = batch.column("pos").to_pylist(), _joined(batch, "hi", "lo")
            for i, key in enumerate(zip(batch.column("conv_id").to_pylist(), batch.column("part").to_pylist(), strict=True)):
                if key in carry:
                    n, value = carry[key]
                    values[i] = (value * powers[places[i]] + values[i]) % MODULUS
                    places[i] += n
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("conv_id"), pa.array(places, pa.int64()), *_split(values), batch.column("t_hi"),
                    batch.column("t_lo"), batch.column("n_chars"),
                ],
                names=["conv_id", "pos", "hi", "lo", "t_hi", "t_lo", "n_chars"],
            )

    slim = turns.select("conv_id", "part", "pos", "hi", "lo", "t_hi", "t_lo", "n_chars")
    return slim.mapInArrow(run, "conv_id long, pos long, hi long, lo long, t_hi long, t_lo long, n_chars long")


_PREFIX = "conv_id long, depth long, hi long, lo long, p_hi long, p_lo long, ref_conv long, ref_pos long, n_chars long, total long"


def rebuilt(whole: DataFrame, block: int = BLOCK, heads: int = HEADS, attempt: int = 0) -> DataFrame:
    """A row for every prefix of every rebuilt conversation, its root included.

    conv_id, depth, fingerprint (hi, lo), its parent's (p_hi, p_lo), the stored turn that is its last
    one (ref_conv, ref_pos), that turn's length, and the depth of the whole conversation (total).
    """
    base = _base(attempt)
    most = heads - 1
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    at = lambda k, c: F.max(F.when(F.col("pos") == k, F.col(c)))
    convs = whole.groupBy("conv_id").agg(
        F.max("pos").alias("size"),
        *[at(k, c).alias(f"{c}{k}") for k in range(1, most + 1) for c in ("hi", "lo", "n_chars")],
    )
    first = [f"{c}{k}" for k in range(1, most + 1) for c in ("hi", "lo", "n_chars")]
    bases = convs.filter(F.col("conv_id") % block == 0).select(
        F.col("conv_id").alias("base"), F.col("size").alias("base_size"), *[F.col(c).alias(f"base_{c}") for c in first]
    )
    convs = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % block).withColumn("h", h.cast("long"))
    convs = convs.join(bases, "base", "left").withColumn("head", F.least("h", F.coalesce("base_size", F.lit(0).cast("long"))))
    convs = convs.withColumn("total", F.col("head") + F.greatest(F.col("size") - F.col("h"), F.lit(0)))

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Root and head rows; the last also carries what the own turns' products need."""
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                value = lambda name, k: r[f"{name}hi{k}"] << LOW_BITS | r[f"{name}lo{k}"] if k else 0  # noqa: E731, B023
                out.append((r["conv_id"], 0, 0, 0, None, None, None, None, 0, r["total"]))
                for d in range(1, r["head"] + 1):
                    own, parent = value("base_", d), value("base_", d - 1)
                    out.append((
                        r["conv_id"], d, own >> LOW_BITS, own & _LOW, parent >> LOW_BITS, parent & _LOW, r["base"], d,
                        r[f"base_n_chars{d}"], r["total"],
                    ))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 10)], names=names
            )

    def difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The head's product less the product of the own turns that it replaces."""
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                value = lambda name, k: r[f"{name}hi{k}"] << LOW_BITS | r[f"{name}lo{k}"] if k else 0  # noqa: E731, B023
                own = (value("base_", r["head"]) - value("", r["h"])) % MODULUS
                out.append((r["conv_id"], r["h"], r["head"], own >> LOW_BITS, own & _LOW, r["total"]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 6)],
                names=["conv_id", "h", "head", "d_hi", "d_lo", "total"],
            )

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, less = _Powers(base), pow(base, -1, MODULUS)
        for batch in batches:
            pos, skip, head = (batch.column(c).to_pylist() for c in ("pos", "h", "head"))
            prefix, change, number = (_joined(batch, f"{c}hi", f"{c}lo") for c in ("", "d_", "t_"))
            value = [(c * powers[p - s] + v) % MODULUS for c, p, s, v in zip(change, pos, skip, prefix, strict=True)]
            parent = [(v - t) * less % MODULUS for v, t in zip(value, number, strict=True)]
            depth = [a + p - s for a, p, s in zip(head, pos, skip, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("conv_id"), pa.array(depth, pa.int64()), *_split(value), *_split(parent),
                    batch.column("conv_id"), batch.column("pos"), batch.column("n_chars"), batch.column("total"),
                ],
                names=names,
            )

    names = [c.split()[0] for c in _PREFIX.split(", ")]
    convs = stored(convs, "conversations")
    long_enough = convs.filter("size > h").mapInArrow(
        difference, "conv_id long, h long, head long, d_hi long, d_lo long, total long"
    )
    later = whole.join(long_enough, "conv_id").filter("pos > h")
    return convs.mapInArrow(shared, _PREFIX).unionByName(later.mapInArrow(own, _PREFIX))


def _verified(nodes: DataFrame, prefixes: DataFrame, turns: DataFrame, carry: dict) -> bool:
    """Whether all members of every node have one parent and one last turn, compared as texts."""
    if nodes.filter("p_hi <> p_hi_max OR p_lo <> p_lo_max").limit(1).count():
        return False
    several = nodes.filter("ref_conv <> ref_conv_max OR ref_pos <> ref_pos_max").select(*_KEY)
    refs = prefixes.join(several, _KEY).select(*_KEY, F.col("ref_conv").alias("conv_id"), F.col("ref_pos").alias("pos")).distinct()
    spark = nodes.sparkSession
    before = spark.createDataFrame([(*k, n) for k, (n, _) in carry.items()], "conv_id long, part int, before long")
    texts = turns.select("conv_id", "part", "pos", "role", "text").join(F.broadcast(before), ["conv_id", "part"], "left")
    texts = texts.select("conv_id", (F.col("pos") + F.coalesce("before", F.lit(0))).alias("pos"), "role", "text")
    same = refs.join(texts, ["conv_id", "pos"]).groupBy(*_KEY).agg(
        F.min("role") != F.max("role"), F.min("text") != F.max("text")
    )
    same = same.toDF(*_KEY, "roles", "texts")
    return not same.filter("roles OR texts").limit(1).count()


def _chains(nodes: DataFrame) -> DataFrame:
    """``below``: the sum of ``value`` from each node down the chain of its conversation.

    In two steps, so that no window holds more than ``CHAIN`` depths of a chain.
    """
    blocks = nodes.withColumn("_block", F.floor(F.col("depth") / CHAIN))
    later = Window.partitionBy("conv_id").orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    sums = blocks.groupBy("conv_id", "_block").agg(F.sum("value").alias("_sum"))
    sums = sums.select("conv_id", "_block", F.coalesce(F.sum("_sum").over(later), F.lit(0)).alias("_later"))
    inside = Window.partitionBy("conv_id", "_block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    own = blocks.withColumn("_own", F.sum("value").over(inside))
    return own.join(sums, ["conv_id", "_block"]).withColumn("below", F.col("_own") + F.col("_later"))


def _ends(prefixes: DataFrame) -> DataFrame:
    """SHA-256 of the comma-joined ids of the conversations that end at each node.

    Ids are joined in runs by tasks that share a node's ids; only the runs meet in one stream.
    """
    n = width(prefixes.sparkSession)
    order = [*_KEY, "conv_id"]
    rows = prefixes.filter("depth = total").select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order)
    names = [*_KEY, "first", "ids"]

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.string())], names=names)

        key, ids = None, []
        for part in batches:
            out = []
            for *own, conv in zip(*(part.column(c).to_pylist() for c in order), strict=True):
                if own != key or len(ids) == ENDS:
                    if ids:
                        out.append((*key, ids[0], ",".join(map(str, ids))))
                    key, ids = own, []
                ids.append(conv)
            if out:
                yield batch(out)
        if ids:
            yield batch([(*key, ids[0], ",".join(map(str, ids)))])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], names=[*_KEY, "ends_sha256"])

        key, digest = None, hashlib.sha256()
        for part in batches:
            out = []
            for *own, _, ids in zip(*(part.column(c).to_pylist() for c in names), strict=True):
                if own != key:
                    if key is not None:
                        out.append((*key, digest.hexdigest()))
                    key, digest = own, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if out:
                yield batch(out)
        if key is not None:
            yield batch([(*key, digest.hexdigest())])

    pieces = rows.mapInArrow(runs, "depth long, hi long, lo long, first long, ids string")
    pieces = pieces.repartition(n, *_KEY).sortWithinPartitions(*_KEY, "first")
    return pieces.mapInArrow(digests, "depth long, hi long, lo long, ends_sha256 string")


def prefix_trie(turns: DataFrame, block: int = BLOCK, heads: int = HEADS) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns``: conv_id (integer), turn, role, text; other columns are not read. Turns are ordered
    by ``turn``, null first, and rows that tie by the SHA-256 of role and text, so that repeated
    rows are turns of their own. Null role and text count as empty; rows without conv_id are in no
    conversation; negative ids have the block of their truncated remainder; a conversation whose
    rebuilt form has no turns is a member of the root alone. An empty table has no nodes.
    """
    attempt = 0
    while True:
        stored_turns = numbered(turns, attempt)
        carry = _carried(stored_turns, attempt)
        prefixes = stored(rebuilt(_whole(stored_turns, carry, attempt), block, heads, attempt), "prefixes")
        both = [c for c in ("p_hi", "p_lo", "ref_conv", "ref_pos")]
        nodes = stored(
            prefixes.groupBy(*_KEY).agg(
                F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
                ((F.count(F.lit(1)) - 1) * F.max("n_chars")).alias("value"),
                *[F.min(c).alias(c) for c in both], *[F.max(c).alias(f"{c}_max") for c in both],
            ),
            "nodes",
        )
        if _verified(nodes, prefixes, stored_turns, carry):
            break
        for old in (stored_turns, prefixes, nodes):
            dropped(old)
        attempt += 1

    parent = (F.col("depth") - 1).alias("depth")
    children = nodes.filter("depth > 0").groupBy(parent, F.col("p_hi").alias("hi"), F.col("p_lo").alias("lo")).agg(
        F.count(F.lit(1)).alias("n_children")
    )
    nodes = nodes.select(*_KEY, "conv_id", "n_convs", "value", "p_hi", "p_lo").join(children, _KEY, "left")
    nodes = stored(nodes.withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "nodes")
    # every node is in the chain of its smallest member, and a chain ends in at most one leaf
    chains = nodes.groupBy("conv_id").agg(
        F.min("depth").alias("top"), F.sum("value").alias("below"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf")
    )
    above = prefixes.select("conv_id", *_KEY).join(chains, "conv_id").filter("depth < top")
    inside = _chains(nodes).select("conv_id", *_KEY, "below").join(chains.select("conv_id", "leaf"), "conv_id")
    sums = above.select(*_KEY, "below", "leaf").unionByName(inside.select(*_KEY, "below", "leaf")).groupBy(*_KEY).agg(
        F.sum("below").alias("saved_tokens"), F.sum("leaf").alias("n_leaves")
    )
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("hi").alias("p_hi"), F.col("lo").alias("p_lo"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(parents, ["depth", "p_hi", "p_lo"], "left").join(sums, _KEY).join(_ends(prefixes), _KEY, "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )

"""Mixing sources to target weights by hash-threshold histograms (DataFrame functions only).

Every row has a 60-bit hash of its id and text. What a source gives beyond whole repeats is the
set of its rows below a threshold, and the threshold comes from sums of words by (source, hash
bucket): whole buckets below the budget are in, only the bucket in which the budget ends is
refined, by its next bits, until it holds few rows. No source is ever sorted. Budgets are nested:
the words that the boundary row leaves open are filled in the same way from rows that still fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volsignals.llm.common import stored, whole_text
from volsignals.operators.ranking import global_rank

#: Weights by place of the source in code-point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: A source's target, and so a document, is repeated up to so many times.
MOST = 3
#: Hash bits, bits of one histogram, rows of a boundary bucket that are added up one by one.
BITS, STEP, FEW = 60, 12, 1024
#: The key's digits from the highest: the hash, then the row's number, which has 63 bits.
DIGITS = [
    (key, max(0, shift)) for key, bits in (("hash", BITS), ("pos", 63)) for shift in range(bits - STEP, -STEP, -STEP)
]
#: Fillings: the first, and those of what the boundary row left open.
ROUNDS = 3
#: Source tables up to this many rows are broadcast; larger ones are joined by shuffles.
BROADCAST_SOURCES = 50_000

WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: str = "text") -> Column:
    return F.regexp_count(whole_text(text), F.lit(WORD)).cast("long")


def hash_of(doc_id: str = "doc_id", text: str = "text") -> Column:
    """60 bits of an MD5 of id and text: the same in every run and engine."""
    whole = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.md5(whole_text(text)))
    return F.conv(F.substring(F.md5(whole), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """Per source: ``source_size`` and ``target``; the targets share all words by weight.

    No target is above ``most`` times its source; the excess goes to the others by weight: a
    target is the smaller of its cap and its weight times one level. Sources are ranked in range
    parts, and the level comes from sums alone, so that no task sees all sources.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = global_rank(per, [F.isnull("source"), F.col("source")], "place")
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    level = _level(per)
    target = F.col("cap") if level is None else F.least(F.col("cap"), F.col("w") * F.lit(level))
    return per.select("source", "source_size", target.alias("target"))


def _level(per: DataFrame) -> float | None:
    """The level at which all sources together give all words; None without sources.

    Starts at the level without caps and caps what ends below it, until nothing more does. What
    the sources give is concave in the level, so this is Newton's method from below: each round
    is one sum over the sources, and only ever more of them are capped.
    """
    full, level = F.col("cap") / F.col("w"), 0.0
    while True:
        row = per.agg(
            F.sum("source_size").cast("double").alias("total"),
            F.sum(F.when(full < level, F.col("cap"))).alias("capped"),
            F.sum(F.when(full >= level, F.col("w"))).alias("open"),
        ).first()
        if not row.open:
            return level if row.total is not None else None
        new = (row.total - (row.capped or 0.0)) / row.open
        if new <= level:
            return new
        level = new


def _joined(rows: DataFrame, per_source: DataFrame, small: bool, how: str = "inner") -> DataFrame:
    """``per_source`` columns for each row; broadcast where the number of sources was checked."""
    right = per_source.withColumnRenamed("source", "_source")
    right = F.broadcast(right) if small else right
    return rows.join(right, F.col("source").eqNullSafe(F.col("_source")), how).drop("_source")


def _threshold(rows: DataFrame, budget: DataFrame, small: bool) -> DataFrame:
    """Per source of ``budget`` (source, gap): the key below which rows fill the gap, what is left.

    ``rows``: source, size, hash, pos. The key is (hash, pos): pos only parts equal rows. A
    boundary bucket of very many equal rows is refined by the bits of pos in the same way.
    """
    state = budget.select("source", F.lit(0).cast("long").alias("low"), "gap")
    inside = rows
    for key, shift in DIGITS:
        bucket = F.shiftrightunsigned(key, shift)
        sums = inside.groupBy("source", bucket.alias("bucket")).agg(
            F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")
        )
        up_to = Window.partitionBy("source").orderBy("bucket")
        sums = _joined(sums, state, small).withColumn("cum", F.sum("words").over(up_to))
        edge = sums.filter(F.col("cum") > F.col("gap")).groupBy("source").agg(
            F.min(F.struct("bucket", "cum", "words", "n")).alias("edge")
        )
        after = _joined(edge, state.select("source", "gap"), small).select(
            "source", F.col("edge.bucket").alias("low"),
            (F.col("gap") - F.col("edge.cum") + F.col("edge.words")).alias("gap"),
            F.col("edge.n").alias("n"),
        )
        after = stored(after, "mix-edge")
        most = after.agg(F.max("n")).first()[0] or 0
        state = after.drop("n")
        inside = _joined(inside, state.select("source", "low"), small).filter(
            bucket == F.col("low")
        ).drop("low")
        if most <= FEW:
            break
    # few rows per source are left: add them up
    by = Window.partitionBy("source").orderBy("hash", "pos")
    one = _joined(inside, state, small).withColumn("cum", F.sum("size").over(by))
    first_out = one.filter(F.col("cum") > F.col("gap")).groupBy("source").agg(
        F.min(F.struct("hash", "pos", "cum", "size", "gap")).alias("x")
    )
    return first_out.select(
        "source", F.col("x.hash").alias("hash_to"), F.col("x.pos").alias("pos_to"),
        (F.col("x.gap") - F.col("x.cum") + F.col("x.size")).alias("left"),
    )


def plan(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> tuple[DataFrame, bool]:
    """Per source: size, target, whole repeats and up to ``ROUNDS`` (largest size, key) thresholds.

    ``sizes``: source, size, hash, pos, of all rows, cheap to read more than once.
    """
    per = targets(sizes, weights, most)
    repeats = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    per = stored(
        per.withColumn("repeats", repeats.cast("int")).withColumn(
            "gap", F.col("target") - F.col("repeats") * F.col("source_size")
        ),
        "mix-targets",
    )
    small = per.count() <= BROADCAST_SOURCES
    out = per
    gaps = per.filter("gap > 0").select("source", "gap")
    rest = sizes.filter("size > 0")
    for k in range(ROUNDS):
        open_ = _joined(rest, gaps, small).filter(F.col("size") <= F.col("gap")).drop("gap") if k else rest
        cut = stored(_threshold(open_, gaps, small), "mix-cut")
        mine = _joined(gaps, cut, small, "left").select(
            "source", F.col("gap").alias(f"fit{k}"), F.col("hash_to").alias(f"hash{k}"),
            F.col("pos_to").alias(f"pos{k}"),
        )
        out = stored(_joined(out, mine, small, "left"), "mix-plan")
        gaps = cut.filter("left > 0").select("source", F.col("left").alias("gap"))
        rest = _joined(rest, cut.select("source", "hash_to", "pos_to"), small).filter(
            ~_below("hash_to", "pos_to")
        ).drop("hash_to", "pos_to")
    return out, small


def _below(hash_to: str, pos_to: str) -> Column:
    h = F.col(hash_to)
    return (F.col("hash") < h) | ((F.col("hash") == h) & (F.col("pos") < F.col(pos_to)))


def taken(rows: DataFrame, per_source: DataFrame, small: bool) -> DataFrame:
    """``rows`` (source, size, hash, pos, any others) with source_size, target and copies."""
    df = _joined(rows, per_source, small)
    more = F.lit(False)
    for k in range(ROUNDS):
        fits = F.col("size") <= F.col(f"fit{k}") if k else F.lit(True)
        # no key: everything that fits is in
        under = F.when(F.col(f"hash{k}").isNull(), F.lit(True)).otherwise(_below(f"hash{k}", f"pos{k}"))
        more = more | (F.col(f"fit{k}").isNotNull() & fits & under & (F.col("size") > 0))
    copies = F.col("repeats") + F.when(more, 1).otherwise(0)
    gone = ["repeats", "gap"] + [f"{c}{k}" for c in ("fit", "hash", "pos") for k in range(ROUNDS)]
    return df.withColumn("copies", copies.cast("int")).drop(*gone)


def measured(docs: DataFrame) -> DataFrame:
    """One narrow row per document: doc_id, source, size, hash, pos."""
    return docs.select(
        "doc_id", "source", size_of().alias("size"), hash_of().alias("hash"),
        F.monotonically_increasing_id().alias("pos"),
    )


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """How often the mix takes each row of ``docs`` (doc_id, text, source).

    Returns doc_id, source, size (words; null text: 0), source_size, target, copies, taken.
    A null source is a source of its own, last in order. Rows without words are taken as often
    as their source repeats as a whole, with 0 words. Equal rows are told apart by place. An
    empty table gives an empty table. Whole documents only: a source's words end within the
    smallest of its open rows that still fitted, below its target.
    """
    rows = stored(measured(docs), "mix-rows")
    per_source, small = plan(rows.drop("doc_id"), weights, most)
    out = taken(rows, per_source, small)
    return out.select(
        "doc_id", "source", "size", "source_size", "target", "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The rows of the mix themselves, each as often as it is taken, with the columns of ``docs``.

    The decision is a function of a row's source, size and hash, so that nothing is joined on rows.
    """
    rows = stored(measured(docs), "mix-rows")
    per_source, small = plan(rows.drop("doc_id"), weights, most)
    own = [f"_own{i}" for i in range(len(docs.columns))]
    packed = docs.select(
        "source", size_of().alias("size"), hash_of().alias("hash"),
        F.monotonically_increasing_id().alias("pos"),
        *[F.col(f"`{c}`").alias(o) for c, o in zip(docs.columns, own, strict=True)],
    )
    out = taken(packed, per_source, small).filter("copies > 0")
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select(*[F.col(o).alias(c) for c, o in zip(docs.columns, own, strict=True)])

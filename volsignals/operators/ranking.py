"""Order and rank over a whole table without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volsignals.session import written

def sort_result(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Global sort of rows that are few next to what they are computed from.

    A range sort first samples its input, which computes it twice. Shuffling the few rows once
    before the sort leaves the sample to read the shuffle instead. (A hash of the key, as a
    shuffle on the key itself is dropped when the rows are already partitioned by it.)
    """
    return df.repartition(F.xxhash64(key)).orderBy(*order)


def range_parts(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` as a written table in sorted parts: ``_part`` in order, ``_place`` in it from 0.

    The parts are those of Spark's range partitioner, whose split keys are quantiles of a sample of
    the whole key, so that ties in its leading columns fall into several parts and no part is
    much larger than the others. The rows are shuffled once before, by a hash of the key, so that
    the sample reads that shuffle and what they are computed from is computed once. Written, the
    parts no longer depend on the sample.
    """
    dealt = df.repartition(F.xxhash64(*order)).orderBy(*order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return written(dealt.select("*", F.spark_partition_id().alias("_part"), place.alias("_place")), "ranked")


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """1-based position of every row under ``order``, ascending columns that are a total order.

    A row's rank is its place in its part plus the sizes of the parts before. The parts are
    written when this is called; ranks and offsets are read from them.
    """
    placed = range_parts(df, order)
    sizes = placed.groupBy("_part").agg((F.max("_place") + 1).alias("_size"))
    # one row per part
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "_part", F.coalesce(F.sum("_size").over(ahead), F.lit(0).cast("bigint")).alias("_start")
    )
    return placed.join(F.broadcast(starts), "_part").select(
        (F.col("_start") + F.col("_place") + 1).alias(name), *df.columns
    )

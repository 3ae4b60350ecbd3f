"""Connected components of a link table, without any group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volsignals.llm.common import dropped, stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root`` (the smallest node it is joined to) of every node with a link.

    Each round hangs every node's neighbours under its smallest neighbour: first the larger ones
    (large star), then the node itself and the smaller ones (small star). Rounds end only when nothing
    changes. Smallest neighbours are combined before the shuffle and written, so that both sides
    of the join that follows are plain shuffles, in which a hub's rows can be split.
    """
    edges = links.filter(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    ).distinct()
    edges = stored(edges, "links")
    state = None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(
            both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least"
        )
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.filter("u != v").distinct(), "links")
        # small star: every row has u > v already
        low = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            small.select("u", F.col("m").alias("v"))
        )
        new = stored(small.filter("u != v").distinct(), "links")
        mark = new.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        for old in (edges, least, large, low):
            dropped(old)
        edges = new
        if mark == state:
            break
        state = mark
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )

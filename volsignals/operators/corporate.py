"""Backward adjustment of prices for bonus issues."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from volsignals.schema import PRICES

_BEGIN = "0001-01-01"


def bonus_intervals(corp_actions: DataFrame) -> DataFrame:
    """Per event, the days from the previous event up to it and the factor that applies there:
    the product of 1/(1+bonus) over this and all later events of the ticker."""
    w = Window.partitionBy("ticker").orderBy("ex_date", "bonus_fraction")
    later = w.rowsBetween(0, Window.unboundedFollowing)
    return corp_actions.select(
        "ticker",
        F.coalesce(F.lag("ex_date", 1).over(w), F.lit(_BEGIN).cast("date")).alias("_from"),
        F.col("ex_date").alias("_until"),
        F.aggregate(
            F.collect_list("bonus_fraction").over(later), F.lit(1.0), lambda a, x: a / (x + 1.0)
        ).alias("_factor"),
    )


def adjust_for_bonus(bars: DataFrame, corp_actions: DataFrame) -> DataFrame:
    """Prices strictly before each ex-date scaled down; volume is left as it is.

    The intervals of a ticker do not overlap, so each bar meets at most one and the join adds
    no rows. Events are few per ticker, and Spark broadcasts them if they are few in all.
    """
    i = bonus_intervals(corp_actions).withColumnRenamed("ticker", "_ticker")
    hit = (
        (F.col("ticker") == F.col("_ticker"))
        & (F.col("date") >= F.col("_from"))
        & (F.col("date") < F.col("_until"))
    )
    f = F.coalesce("_factor", F.lit(1.0))
    return bars.join(i, hit, "left").select(
        *[(F.col(c) * f).alias(c) if c in PRICES else c for c in bars.columns]
    )

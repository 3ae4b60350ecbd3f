"""Points, reasons and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volsignals import texts
from volsignals.functions.numeric import fixed, round_exact
from volsignals.params import Params


def with_capital(df: DataFrame, fundamentals: DataFrame | None) -> DataFrame:
    """Left join of the paid-up capital, one row per ticker. Unhinted: Spark broadcasts it only below its own
    size threshold and otherwise joins on the ticker partitioning already in place."""
    if fundamentals is None:
        return df.withColumn("paid_up_capital", F.lit(None).cast("double"))
    return df.join(fundamentals.select("ticker", "paid_up_capital"), "ticker", "left")


def label(score: Column, p: Params = Params()) -> Column:
    return (
        F.when(score >= p.buy_score, "BUY").when(score >= p.wait_score, "WAIT").otherwise("IGNORE")
    )


def score(df: DataFrame, p: Params = Params()) -> DataFrame:
    """Add ``score``, ``signal`` and ``reasons`` to rows with indicators and capital."""
    loud = F.coalesce(F.col("rvol") > p.rvol_threshold, F.lit(False))
    quiet = loud & F.coalesce(F.abs("price_change") < p.quiet_move, F.lit(False))
    light = F.coalesce(F.col("paid_up_capital") < p.low_cap, F.lit(False))
    known = F.col("sma_200").isNotNull()
    above = known & F.coalesce(F.col("close") > F.col("sma_200"), F.lit(False))
    points = (
        F.when(loud, p.high_rvol_points).otherwise(0)
        + F.when(quiet, p.quiet_points).otherwise(0)
        + F.when(light, p.low_float_points).otherwise(0)
        + F.when(above, p.above_sma_points).when(known, p.below_sma_points).otherwise(0)
    )
    reasons = F.array_compact(
        F.array(
            F.when(loud, fixed(texts.HIGH_RVOL, 1, F.col("rvol"))),
            F.when(
                quiet,
                F.format_string(
                    texts.QUIET,
                    round_exact(F.col("rvol"), 1),
                    round_exact(F.col("price_change_pct"), 2),
                ),
            ),
            F.when(light, fixed(texts.LOW_FLOAT, 1, F.col("paid_up_capital"))),
            F.when(above, texts.ABOVE_SMA).when(known, texts.BELOW_SMA),
        )
    )
    return (
        df.withColumn("score", points.cast("int"))
        .withColumn("signal", label(F.col("score"), p))
        .withColumn("reasons", reasons)
    )

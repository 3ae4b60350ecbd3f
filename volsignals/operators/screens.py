"""Survival screens (F1-F8): the first rule that applies decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volsignals import texts
from volsignals.params import Params


def _penny(p: Params) -> Column:
    heavy = F.col("paid_up_capital") > p.high_cap
    still = F.abs("price_change_pct") < p.penny_move_pct
    return F.coalesce(heavy & still, F.lit(False))


def screen(df: DataFrame, p: Params = Params()) -> DataFrame:
    """Add ``status`` (``success`` / ``filtered``) and ``message`` to indicator rows.

    ``strict_floor`` takes the strict form of the floor rule (F7) in place of the usual one;
    ``penny_trap`` adds F6 at the end.
    """
    floor = F.col("flat_idle" if p.strict_floor else "stuck")
    verdict = (
        F.when(F.col("ghost"), texts.GHOST_TOWN)
        .when(floor, texts.STUCK)
        .when(F.col("volume") < p.min_volume, F.format_string(texts.LOW_VOLUME, F.col("volume")))
    )
    if p.penny_trap:
        verdict = verdict.when(_penny(p), texts.PENNY_TRAP)
    return df.withColumn("message", verdict.otherwise(texts.PASSED)).withColumn(
        "status", F.when(F.col("message") == texts.PASSED, "success").otherwise("filtered")
    )


def drop_penny_traps(df: DataFrame, p: Params = Params()) -> DataFrame:
    """F6 on its own: drop large companies that hardly move."""
    return df.filter(~_penny(p))


def drop_idle_floor(df: DataFrame) -> DataFrame:
    """F7 on its own: drop five unchanged closes with no volume on the last."""
    return df.filter(~F.col("flat_idle"))


def drop_category(df: DataFrame, categories: DataFrame, category: str = "Z") -> DataFrame:
    """F8: drop tickers listed under ``category`` in (ticker, category)."""
    listed = categories.filter(F.col("category") == category).select("ticker").distinct()
    return df.join(listed, "ticker", "left_anti")

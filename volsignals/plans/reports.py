"""Report tables over signal rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volsignals.functions.numeric import fixed
from volsignals.operators.ranking import global_rank
from volsignals.params import Params

def signal_counts(signals: DataFrame) -> DataFrame:
    """A1."""
    is_ = lambda s: F.count_if(F.col("signal") == s)
    return signals.agg(
        F.count(F.lit(1)).alias("total"),
        is_("BUY").alias("buy"),
        is_("WAIT").alias("wait"),
        is_("IGNORE").alias("ignore"),
    )


def _top(signals: DataFrame, label: str, n: int) -> DataFrame:
    return (
        signals.filter(F.col("signal") == label).orderBy(F.desc("score"), "ticker").limit(n)
    )


def top_buy(signals: DataFrame, p: Params = Params()) -> DataFrame:
    """A2: best BUY rows with their distance from the long mean in per cent."""
    diff = F.try_divide(F.col("close") - F.col("sma_200"), "sma_200") * 100.0
    return _top(signals, "BUY", p.top_buy).withColumn("sma_diff", diff)


def top_wait(signals: DataFrame, p: Params = Params()) -> DataFrame:
    """A3."""
    return _top(signals, "WAIT", p.top_wait)


def _money(x: str | Column) -> Column:
    return fixed("%.2f", 2, F.col(x) if isinstance(x, str) else x)


def _or_na(c: str, text: Column) -> Column:
    return F.when(F.coalesce(F.col(c) != 0, F.lit(False)), text).otherwise("N/A")


def report_table(signals: DataFrame, p: Params = Params()) -> DataFrame:
    """Ranked display rows; all values but the rank are text.

    Signal rows carry their own open, high and low; where a caller's do not, the close stands
    in for them.
    """
    have = set(signals.columns)
    price = lambda c: _money(c if c in have else "close")
    rows = signals.select(
        "ticker",
        "signal",
        "score",
        F.when(F.col("score") >= p.buy_score, "score-high")
        .when(F.col("score") >= p.wait_score, "score-medium")
        .otherwise("score-low")
        .alias("band"),
        *[price(c).alias(c) for c in ("close", "open", "high", "low")],
        F.format_string("%.2fx", "rvol").alias("rvol"),
        F.format_number("volume", 0).alias("volume"),
        F.format_number("avg_volume_20", 0).alias("avg_volume_20"),
        F.format_string("%.2f%%", "price_change_pct").alias("change"),
        _or_na("sma_200", _money("sma_200")).alias("sma_200"),
        _or_na("paid_up_capital", fixed("%.1f Cr", 1, F.col("paid_up_capital"))).alias("paid_up_capital"),
        F.array_join("reasons", ", ").alias("reasons"),
        F.when(F.col("signal") == "BUY", "BUY")
        .when(F.col("signal") == "WAIT", "WATCH")
        .otherwise("SKIP")
        .alias("action"),
    )
    return global_rank(rows, [-F.col("score"), F.col("ticker")])


def csv_rows(signals: DataFrame) -> DataFrame:
    """Signal rows with the reasons joined to one text."""
    return signals.withColumn("reasons", F.array_join("reasons", " | "))


def write_signals_csv(signals: DataFrame, folder: str, day: dt.date) -> str:
    """Write ``signals_YYYYMMDD.csv`` under ``folder``; returns its path.

    A Spark output of part files, each with a header, sorted across parts if the rows are.
    """
    path = f"{folder}/signals_{day:%Y%m%d}.csv"
    csv_rows(signals).write.mode("overwrite").option("header", True).csv(path)
    return path

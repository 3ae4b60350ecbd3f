"""Signals: newest bar of every ticker, one ticker, a given day, or the whole history."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volsignals import texts
from volsignals.functions.numeric import round_exact
from volsignals.operators.indicators import indicators, latest_indicators
from volsignals.operators.ranking import sort_result
from volsignals.operators.scoring import score, with_capital
from volsignals.operators.screens import screen
from volsignals.params import Params
from volsignals.schema import PRICES, SIGNAL_COLUMNS


def _judged(rows: DataFrame, fundamentals: DataFrame | None, p: Params) -> DataFrame:
    return score(screen(with_capital(rows, fundamentals), p), p)


def signal_rows(judged: DataFrame) -> DataFrame:
    """The 13 reported fields, rounded and truncated for display; open/high/low ride along."""
    zero = F.lit(0.0)
    return judged.withColumns({
        "close": round_exact(F.col("close"), 2),
        "rvol": round_exact(F.col("rvol"), 2),
        "avg_volume_20": F.col("avg_volume_20").cast("bigint"),
        "price_change_pct": F.coalesce(round_exact(F.col("price_change_pct"), 2), zero),
        "sma_200": round_exact(F.col("sma_200"), 2),
    }).select(*SIGNAL_COLUMNS, "message", *[c for c in PRICES if c != "close"])


def latest_status(
    bars: DataFrame,
    fundamentals: DataFrame | None = None,
    p: Params = Params(),
    tickers: DataFrame | None = None,
    as_of: dt.date | None = None,
) -> DataFrame:
    """One row per ticker with its outcome: ``success``, ``filtered`` or ``error``.

    With ``as_of`` the bar of exactly that day is judged, screens included, and later bars
    are not looked at. ``tickers`` (column ``ticker``) names the requested ones; without it,
    those that have bars.
    """
    wanted = tickers.select("ticker").distinct() if tickers is not None else None
    if wanted is not None:
        bars = bars.join(wanted, "ticker", "left_semi")
    seen = bars
    if as_of is not None:
        seen = bars.filter(F.col("date") <= F.lit(as_of))
    out = signal_rows(_judged(latest_indicators(seen, p), fundamentals, p))
    if as_of is None and wanted is None:
        return out
    has_bars = bars.groupBy("ticker").agg(F.lit(True).alias("_any"))
    asked = has_bars if wanted is None else wanted.join(has_bars, "ticker", "left")
    if as_of is not None:
        out = out.filter(F.col("date") == F.lit(as_of))
    missing = F.lit(texts.NO_DATA)
    if as_of is not None:
        missing = F.when(F.col("_any"), texts.NO_DATA_FOR_DATE % as_of.isoformat()).otherwise(
            texts.NO_DATA
        )
    cols = out.columns
    return (
        asked.join(out, "ticker", "left")
        .withColumn("message", F.coalesce("message", missing))
        .withColumn("status", F.coalesce("status", F.lit("error")))
        .select(*cols)
    )


def passing(
    bars: DataFrame,
    fundamentals: DataFrame | None = None,
    p: Params = Params(),
    as_of: dt.date | None = None,
) -> DataFrame:
    """Every ticker that passes the screens, in no order; what the reports start from."""
    rows = latest_status(bars, fundamentals, p, as_of=as_of).filter("status = 'success'")
    return rows.drop("message")


def analyze(
    bars: DataFrame,
    fundamentals: DataFrame | None = None,
    p: Params = Params(),
    as_of: dt.date | None = None,
) -> DataFrame:
    """The passing tickers, best score first."""
    rows = passing(bars, fundamentals, p, as_of)
    return sort_result(rows, "ticker", [F.desc("score"), F.asc("ticker")])


def analyze_ticker(
    bars: DataFrame,
    ticker: str,
    fundamentals: DataFrame | None = None,
    p: Params = Params(),
    as_of: dt.date | None = None,
) -> DataFrame:
    """The outcome row of one ticker; the filter reaches the scan."""
    asked = bars.sparkSession.createDataFrame([(ticker,)], "ticker STRING")
    one = bars.filter(F.col("ticker") == ticker)
    return latest_status(one, fundamentals, p, tickers=asked, as_of=as_of)


def signal_history(
    bars: DataFrame, fundamentals: DataFrame | None = None, p: Params = Params()
) -> DataFrame:
    """Score, label and screen outcome of every bar (G9); unrounded, no look-ahead."""
    return _judged(indicators(bars, p), fundamentals, p)

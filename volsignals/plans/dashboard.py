"""The four tables a positions dashboard shows (P10)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volsignals.operators import store
from volsignals.operators.positions import (
    portfolio_summary, sell_signals, stop_loss, trailing_stop,
)
from volsignals.params import Params


@dataclass(frozen=True)
class Dashboard:
    positions: DataFrame
    summary: DataFrame
    signals: DataFrame
    tickers: DataFrame


def positions_with_stops(positions: DataFrame, p: Params = Params()) -> DataFrame:
    buy, peak = F.col("buy_price"), F.col("highest_seen")
    return store.list_positions(positions).withColumns({
        "stop_loss_price": stop_loss(buy, peak, p),
        "trailing_stop_price": trailing_stop(peak, p),
    })


def dashboard(positions: DataFrame, bars: DataFrame, p: Params = Params()) -> Dashboard:
    return Dashboard(
        positions_with_stops(positions, p),
        portfolio_summary(positions, bars, p),
        sell_signals(positions, bars, p),
        store.tickers(bars),
    )


#: Every field of the feed; a part has those of its table, the others are missing.
FEED = (
    "ticker STRING, buy_price DOUBLE, quantity BIGINT, highest_seen DOUBLE, purchase_date DATE, notes STRING, "
    "stop_loss_price DOUBLE, trailing_stop_price DOUBLE, "
    "total_positions BIGINT, total_invested DOUBLE, current_value DOUBLE, total_profit DOUBLE, profit_pct DOUBLE, "
    "action STRING, signal_type STRING, urgency STRING, reason STRING, current_price DOUBLE, profit_amount DOUBLE, rvol DOUBLE"
)


def feed(d: Dashboard) -> DataFrame:
    """The four tables as one feed of rows: ``part`` and ``json``, an object per row.

    A double is written with as many digits as give it back, a date as text, and what is missing is
    left out, so that :func:`read_feed` returns the tables' own values.
    """
    out = None
    for name in ("positions", "summary", "signals", "tickers"):
        rows = as_json(getattr(d, name)).select(F.lit(name).alias("part"), "json")
        out = rows if out is None else out.unionByName(rows)
    return out


def read_feed(rows: DataFrame, part: str | None = None) -> DataFrame:
    """Rows of a feed with typed columns; of one part, only its own if ``part`` is given."""
    typed = rows.select("part", F.from_json("json", FEED).alias("_row")).select("part", "_row.*")
    return typed if part is None else typed.filter(F.col("part") == part)


def as_json(df: DataFrame) -> DataFrame:
    """One JSON text per row, for a web client."""
    return df.select(F.to_json(F.struct("*")).alias("json"))

"""Positions, the ratchet and the exit rules."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volsignals import texts
from volsignals.functions.numeric import exact_total, fixed
from volsignals.operators.indicators import newest_bars
from volsignals.operators.store import latest_close
from volsignals.params import Params
from volsignals.schema import POSITION_COLUMNS, SELL_COLUMNS

# --- the positions table ------------------------------------------------------------------


def add_positions(positions: DataFrame, trades: DataFrame, today: dt.date) -> DataFrame:
    """Add trades whose ticker is not held; the peak starts at the buy price.

    Of several trades in one ticker the first submitted is taken, by ``trade_seq`` if there is
    such a column, then by date and price, as the later ones meet a held ticker.
    """
    fresh = (
        trades.join(positions.select("ticker"), "ticker", "left_anti")
        .withColumn("purchase_date", F.coalesce("purchase_date", F.lit(today)))
        .groupBy("ticker")
        .agg(F.min(_submitted(trades)).alias("t"))
        .select(
            "ticker", "t.buy_price", "t.quantity", F.col("t.buy_price").alias("highest_seen"),
            "t.purchase_date", F.coalesce("t.notes", F.lit("")).alias("notes"),
        )
    )
    return positions.select(*POSITION_COLUMNS).unionByName(fresh)


def _submitted(trades: DataFrame) -> Column:
    order = ["trade_seq"] if "trade_seq" in trades.columns else []
    return F.struct(*order, "purchase_date", "buy_price", "quantity", "notes")


def rejected_trades(positions: DataFrame, trades: DataFrame, today: dt.date) -> DataFrame:
    """Trades P1 refuses: the ticker is held already, or an earlier trade of the batch took it.

    Of trades that are equal in every column one is taken and the others are refused.
    """
    held = positions.select("ticker", F.lit(True).alias("_held"))
    dated = trades.withColumn("_day", F.coalesce("purchase_date", F.lit(today)))
    order = ["trade_seq"] if "trade_seq" in trades.columns else []
    w = Window.partitionBy("ticker").orderBy(*order, "_day", "buy_price", "quantity", "notes")
    return (
        dated.join(held, "ticker", "left")
        .withColumn("_turn", F.row_number().over(w))
        .filter(F.coalesce("_held", F.lit(False)) | (F.col("_turn") > 1))
        .select(*trades.columns)
    )


def update_positions(positions: DataFrame, changes: DataFrame) -> DataFrame:
    """``changes(ticker, quantity, avg_price)`` sets the total quantity, and the price if one
    is given and not zero. The peak stays; unknown tickers are ignored. Of several changes to one
    ticker the highest in ``ingest_seq`` counts if there is such a column, then the largest."""
    order = [c for c in ("ingest_seq",) if c in changes.columns]
    changes = changes.groupBy("ticker").agg(
        F.max_by(F.struct("quantity", "avg_price"), F.struct(*order, "quantity", "avg_price")).alias("c")
    ).select("ticker", "c.*")
    c = changes.select(
        "ticker", F.col("quantity").alias("_q"), F.nullif("avg_price", F.lit(0.0)).alias("_p")
    )
    return positions.join(c, "ticker", "left").select(
        "ticker",
        F.coalesce("_p", "buy_price").alias("buy_price"),
        F.coalesce("_q", "quantity").alias("quantity"),
        "highest_seen", "purchase_date", "notes",
    )


def remove_positions(positions: DataFrame, sold: DataFrame) -> DataFrame:
    """P3; tickers not held are ignored."""
    return positions.join(sold.select("ticker").distinct(), "ticker", "left_anti")


# --- rules as columns ---------------------------------------------------------------------


def stop_loss(buy: Column, peak: Column, p: Params = Params()) -> Column:
    """P4, and P12 when switched on: break-even once the peak was high enough."""
    stop = buy * p.stop_factor
    if p.break_even:
        stop = F.when(peak >= buy * (1.0 + p.break_even_gain), F.greatest(buy, stop)).otherwise(stop)
    return stop


def trailing_stop(peak: Column, p: Params = Params()) -> Column:
    return peak * p.trail_factor


def position_size(capital: Column, p: Params = Params()) -> Column:
    """The amount whose loss at the stop is the allowed share of the capital."""
    return capital * p.risk_fraction / p.stop_fraction


# --- market state of each position --------------------------------------------------------


def market_state(
    positions: DataFrame, bars: DataFrame, p: Params = Params(), since_last_run: bool = False
) -> DataFrame:
    """Each position with its newest bar, relative volume and moved peak.

    Positions without bars are left out. One join of bars with positions, which carries the
    position's columns along; then two small aggregates, neither of which sorts history: the
    peak since purchase is a maximum combined before the shuffle, and the newest 20 bars are cut
    by a group limit before theirs. The relative volume is 0 below 20 bars. ``since_last_run``
    looks at the newest close only, as a run on that day would; it needs no peak.
    """
    held = bars.select("ticker", "date", "open", "close", "volume").join(
        positions.select("ticker", F.struct(*POSITION_COLUMNS).alias("_held")), "ticker"
    )
    newest = F.col("back") == 1
    pick = lambda c: F.max(F.when(newest, F.col(c)))
    recent = newest_bars(held, p.rvol_period).groupBy("ticker").agg(
        F.first("_held").alias("_held"),
        F.max("date").alias("date"),
        pick("open").alias("current_open"),
        pick("close").alias("current_price"),
        pick("volume").alias("current_volume"),
        F.count(F.lit(1)).alias("_n"),
        F.avg("volume").alias("_mean"),
    )
    enough = (F.col("_n") >= p.rvol_period) & (F.col("_mean") > 0)
    if since_last_run:
        state = recent.withColumn("_peak", F.col("current_price"))
    else:
        peaks = held.filter(F.col("date") >= F.col("_held.purchase_date")).groupBy("ticker").agg(
            F.max("close").alias("_peak")
        )
        state = recent.join(peaks, "ticker", "left")
    own = [F.col(f"_held.{c}").alias(c) for c in POSITION_COLUMNS if c not in ("ticker", "highest_seen")]
    return state.select(
        "ticker", *own,
        F.greatest("_held.highest_seen", "_peak").alias("highest_seen"),
        "date", "current_open", "current_price", "current_volume",
        F.when(enough, F.try_divide("current_volume", "_mean")).otherwise(F.lit(0.0)).alias("rvol"),
    )


def ratcheted(
    positions: DataFrame, bars: DataFrame, p: Params = Params(), since_last_run: bool = False
) -> DataFrame:
    """The positions table with moved peaks; positions without bars are unchanged."""
    if since_last_run:
        moved = latest_close(bars).select("ticker", F.col("close").alias("_peak"))
    else:
        moved = (
            bars.select("ticker", "date", "close")
            .join(positions.select("ticker", "purchase_date"), "ticker")
            .filter(F.col("date") >= F.col("purchase_date"))
            .groupBy("ticker")
            .agg(F.max("close").alias("_peak"))
        )
    moved = moved.withColumnRenamed("_peak", "_moved")
    return positions.join(moved, "ticker", "left").select(
        *[
            F.greatest("highest_seen", "_moved").alias(c) if c == "highest_seen" else c
            for c in POSITION_COLUMNS
        ]
    )


def decide(state: DataFrame, p: Params = Params()) -> DataFrame:
    """Stops, profit and the exit decision of every row of :func:`market_state`."""
    buy, price, peak = F.col("buy_price"), F.col("current_price"), F.col("highest_seen")
    opened = F.col("current_open")
    body = F.try_divide(F.abs(price - opened), opened)
    candle = (price < opened) | ((opened > 0) & (body < p.doji_body))
    s = state.withColumns({
        "stop_loss_price": stop_loss(buy, peak, p),
        "trailing_stop_price": trailing_stop(peak, p),
        "profit_pct": F.try_divide(price - buy, buy) * 100.0,
        "profit_amount": (price - buy) * F.col("quantity"),
    })
    climax = (F.col("profit_pct") > p.climax_profit_pct) & (F.col("rvol") > p.climax_rvol)
    s = s.withColumn(
        "signal_type",
        F.when(price <= F.col("stop_loss_price"), "STOP_LOSS")
        .when(price <= F.col("trailing_stop_price"), "TAKE_PROFIT")
        .when(climax & F.coalesce(candle, F.lit(False)), "CLIMAX"),
    )
    kind = F.col("signal_type")
    by = lambda a, b, c, d: (
        F.when(kind == "STOP_LOSS", a).when(kind == "TAKE_PROFIT", b).when(kind == "CLIMAX", c)
        .otherwise(d)
    )
    return s.withColumns({
        "action": by(
            texts.STOP_ACTION, texts.TRAIL_ACTION, texts.CLIMAX_ACTION, F.lit(texts.HOLD_ACTION)
        ),
        "urgency": by("CRITICAL", "HIGH", "HIGH", F.lit("LOW")),
        "reason": by(
            texts.STOP_REASON,
            fixed(texts.TRAIL_REASON, 2, peak),
            fixed(texts.CLIMAX_REASON, 1, F.col("rvol")),
            F.lit(""),
        ),
    })


def check_positions(
    positions: DataFrame, bars: DataFrame, p: Params = Params(), since_last_run: bool = False
) -> DataFrame:
    """The decision row of every position with bars, HOLD included."""
    state = market_state(positions, bars, p, since_last_run)
    return decide(state, p).select(*SELL_COLUMNS)


def sell_signals(
    positions: DataFrame, bars: DataFrame, p: Params = Params(), since_last_run: bool = False
) -> DataFrame:
    """Only the rows that call for selling."""
    return check_positions(positions, bars, p, since_last_run).filter(
        F.col("signal_type").isNotNull()
    )


def portfolio_summary(
    positions: DataFrame, bars: DataFrame, p: Params = Params()
) -> DataFrame:
    """A4: one row; positions without a close count but carry no money. Empty gives zeros."""
    priced = positions.join(
        latest_close(bars).select("ticker", F.col("close").alias("_close")), "ticker", "left"
    ).withColumn("_paid", F.when(F.col("_close").isNotNull(), F.col("buy_price")))
    # no priced position gives 0; a product beyond the exact range gives NULL
    money = lambda c: F.when(F.count(c) == 0, 0.0).otherwise(
        exact_total(F.col(c) * F.col("quantity").cast("double"))
    )
    s = priced.agg(
        F.count(F.lit(1)).alias("total_positions"),
        money("_paid").alias("total_invested"),
        money("_close").alias("current_value"),
    ).withColumn("total_profit", F.col("current_value") - F.col("total_invested"))
    return s.withColumn(
        "profit_pct",
        F.when(F.col("total_invested") > 0, F.col("total_profit") / F.col("total_invested") * 100.0)
        .otherwise(F.lit(0.0)),
    )

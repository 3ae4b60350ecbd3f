"""Indicators of new bars from a stored state instead of history.

The state of a ticker is what its windows can reach back to: its newest bars, as many as the longest
window and one more, the number of bars before them, and the last close there is. Everything the
full pass computes for a bar follows from these, so an increment is read with its tickers' states
and nothing else. A bar that comes late or again changes later bars' windows; its ticker, and no
other, is computed anew from the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from volsignals.operators.indicators import (
    INDICATORS, _finish, _lagged, _recent, _running, indicators, newest_bars, without_nan,
)
from volsignals.params import Params
from volsignals.schema import PRICES

_BAR = ["date", *PRICES, "volume"]
STATE = (
    "ticker STRING, bars ARRAY<STRUCT<date: DATE, open: DOUBLE, high: DOUBLE, low: DOUBLE, close: DOUBLE, "
    "volume: BIGINT>>, before BIGINT, filled DOUBLE"
)


def reach(p: Params = Params()) -> int:
    """Bars of a state: the longest window, and one for the lag."""
    return max(p.sma_period, p.rvol_period, p.stuck_days, p.ghost_days) + 1


def indicator_state(bars: DataFrame, p: Params = Params()) -> DataFrame:
    """The state of every ticker after ``bars``; its newest bars are cut before the shuffle."""
    clean = without_nan(bars)
    tail = newest_bars(clean, reach(p)).groupBy("ticker").agg(
        F.sort_array(F.collect_list(F.struct(*_BAR)), asc=False).alias("bars")
    )
    whole = clean.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("_n"),
        F.max_by("close", F.when(F.col("close").isNotNull(), F.col("date"))).alias("filled"),
    )
    return tail.join(whole, "ticker").select("ticker", "bars", (F.col("_n") - F.size("bars")).alias("before"), "filled")


def advance(state: DataFrame, increment: DataFrame, p: Params = Params()) -> DataFrame:
    """The state after ``increment``, whose bars are all newer than their ticker's newest one."""
    new = indicator_state(increment, p).select(
        "ticker", F.col("bars").alias("_bars"), F.col("before").alias("_before"), F.col("filled").alias("_filled")
    )
    none = F.array().cast(state.schema["bars"].dataType)
    every = F.concat(F.coalesce("_bars", none), F.coalesce("bars", none))
    zero = F.lit(0).cast("bigint")
    gone = F.greatest(F.size(every) - reach(p), F.lit(0)).cast("bigint")
    return state.join(new, "ticker", "full").select(
        "ticker", F.slice(every, 1, reach(p)).alias("bars"),
        (F.coalesce("before", zero) + F.coalesce("_before", zero) + gone).alias("before"),
        F.coalesce("_filled", "filled").alias("filled"),
    )


def continued(state: DataFrame, increment: DataFrame, p: Params = Params()) -> DataFrame:
    """Indicators of ``increment``, whose bars are all newer than their ticker's newest one.

    Equal to the full pass over history and increment. One shuffle of the increment and of the
    states of its tickers, at most ``reach`` bars each.
    """
    held = state.join(increment.select("ticker").distinct(), "ticker", "left_semi")
    # the last close before the kept bars: the state's, unless one of them has it
    kept = F.exists("bars", lambda b: b["close"].isNotNull())
    told = held.select("ticker", "bars", F.col("before").alias("_before"), F.when(~kept, F.col("filled")).alias("_carried"))
    # in a step of its own: what is computed from the bars beside the generator is computed for each of them
    old = told.select("ticker", "_before", "_carried", F.inline("bars")).withColumn("_new", F.lit(False))
    # windows look back at closes and volumes only
    old = old.withColumns({c: F.lit(None).cast("double") for c in PRICES if c != "close"})
    new = without_nan(increment).select("ticker", *_BAR).withColumns({
        "_before": F.lit(None).cast("bigint"), "_carried": F.lit(None).cast("double"), "_new": F.lit(True),
    })
    w = Window.partitionBy("ticker").orderBy("date")
    # kept bars come before the new ones and hand on what their state says; no join with it
    handed = lambda c: F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    first = _running(w, p) | _recent(w, p)
    first["bar_no"] = F.row_number().over(w) + F.coalesce(handed("_before"), F.lit(0).cast("bigint"))
    first["_filled"] = F.coalesce(first["_filled"], handed("_carried"))
    done = old.unionByName(new).withColumns(first).withColumns(_lagged(w, p))
    return _finish(done.filter("_new"), ["ticker", *_BAR], p)


def refreshed(table: DataFrame, state: DataFrame, increment: DataFrame, p: Params = Params()) -> DataFrame:
    """Indicators that ``increment`` adds or changes, to be upserted into stored ones.

    ``table`` is the bar table after the upsert, ``state`` the one before. Tickers whose increment
    is all new go on from their state. Of those with a late or replaced bar, all bars from the
    first such day on are computed from the table, of which only these tickers are read.
    """
    newest = state.select("ticker", F.get("bars", F.lit(0))["date"].alias("_newest"))
    late = increment.join(newest, "ticker").filter(F.col("date") <= F.col("_newest")).groupBy("ticker").agg(F.min("date").alias("_from"))
    on_time = increment.join(late, "ticker", "left_anti")
    again = table.join(late.select("ticker"), "ticker", "left_semi").select("ticker", *_BAR)
    anew = indicators(again, p).join(late, "ticker").filter(F.col("date") >= F.col("_from"))
    return continued(state, on_time, p).unionByName(anew.select("ticker", *_BAR, *INDICATORS))

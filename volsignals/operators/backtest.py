"""Backtest of BUY signals against the exit rules, and paper profit per day (B1, B2, A5).

Rules: enter at the close of a screened BUY bar; from the next bar on, leave at the first
close at or under the stop-loss or the trailing stop, whose peak is the highest close since
entry; after ``hold_bars`` bars leave with ``TIMEOUT``. A trade whose series ends first stays
``OPEN``. Entries are independent of each other, also within one ticker.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from volsignals.functions.numeric import exact, exact_mean, exact_total
from volsignals.operators.positions import stop_loss, trailing_stop
from volsignals.params import Params

TRADE = ["ticker", "entry_no", "entry_date", "entry_price"]


def piece_rows(p: Params) -> int:
    """Bars of a piece: at least a horizon, so that an entry's bars lie in one piece and its copies."""
    return max(p.segment_rows, p.hold_bars)


def _pieces(p: Params) -> list[str]:
    return ["ticker", "_piece"] if p.segment_rows else ["ticker"]


def trade_paths(history: DataFrame, p: Params = Params()) -> DataFrame:
    """Each entry with its own bar and the bars of its horizon, and the rule each bar meets.

    One running maximum finds each bar's last entry, and bars beyond its horizon go. The others
    look back over ``hold_bars`` bars for entries still running and are repeated for each. That
    takes the ticker partitioning the history already has and no join, so the rows are neither
    read nor shuffled a second time; grouping by (ticker, entry) afterwards is covered by it too.
    A ticker's bars, at most one per day, times the entries that run at once stay in one task, unless
    ``segment_rows`` cuts series into pieces: a piece has its own bars, whose entries it follows, and
    copies of the bars of the horizon after them, which are no entries there. An entry lies in one
    piece with all its horizon, so results are equal, and no task holds more than a piece.
    """
    by = _pieces(p)
    w = Window.partitionBy(*by).orderBy("date")
    enters = (
        (F.col("signal") == "BUY") & (F.col("status") == "success") & F.col("close").isNotNull()
    )
    entry = F.when(
        enters,
        F.struct(
            F.col("bar_no").alias("entry_no"),
            F.col("date").alias("entry_date"),
            F.col("close").alias("entry_price"),
        ),
    )
    last = F.max("_entry.entry_no").over(w.rowsBetween(Window.unboundedPreceding, 0))
    by_no = Window.partitionBy(*by).orderBy("bar_no")
    running = F.collect_list("_entry").over(by_no.rangeBetween(-p.hold_bars, 0))
    rows = history.select("ticker", "bar_no", "date", "close", entry.alias("_entry"))
    if p.segment_rows:
        size = piece_rows(p)
        home, place = F.floor((F.col("bar_no") - 1) / size), (F.col("bar_no") - 1) % size
        own = F.struct(home.alias("_piece"), F.col("_entry").alias("_own"))
        copy = F.struct((home - 1).alias("_piece"), F.lit(None).cast(rows.schema["_entry"].dataType).alias("_own"))
        follows = (home > 0) & (place < p.hold_bars)
        dealt = F.inline(F.when(follows, F.array(own, copy)).otherwise(F.array(own)))
        rows = rows.select("ticker", "bar_no", "date", "close", dealt).withColumnRenamed("_own", "_entry")
    bars = (
        rows.withColumn("_near", F.col("bar_no") - last <= p.hold_bars)
        .filter("_near")
        .withColumn("_running", running)
        .select(*by, F.inline("_running"), "bar_no", "date", "close")
    )
    we = Window.partitionBy(*by, "entry_no").orderBy("bar_no")
    seen = we.rowsBetween(Window.unboundedPreceding, 0)
    before = we.rowsBetween(Window.unboundedPreceding, -1)
    price, close, peak = F.col("entry_price"), F.col("close"), F.col("peak")
    later = F.col("bar_no") > F.col("entry_no")
    return (
        bars.withColumn("peak", F.max("close").over(seen))
        .withColumn(
            "rule",
            F.when(later & (close <= stop_loss(price, peak, p)), "STOP_LOSS")
            .when(later & (close <= trailing_stop(peak, p)), "TAKE_PROFIT"),
        )
        .withColumn("held", later & (F.count("rule").over(before) == 0))
    )


def backtest(history: DataFrame, p: Params = Params()) -> DataFrame:
    """B1: one row per entry with its exit."""
    priced = F.col("close").isNotNull()
    bar = F.struct("bar_no", "date", "close", "rule")
    trades = (
        trade_paths(history, p)
        .groupBy(*_pieces(p), "entry_no")
        .agg(
            F.first("entry_date").alias("entry_date"),
            F.first("entry_price").alias("entry_price"),
            F.min(F.when(F.col("rule").isNotNull(), bar)).alias("hit"),
            F.max(F.when(priced, bar)).alias("end"),
            F.max("bar_no").alias("_last"),
        )
    )
    timed_out = F.col("_last") >= F.col("entry_no") + p.hold_bars
    out = F.coalesce("hit", F.when(timed_out, F.col("end")))
    return (
        trades.withColumn("out", out)
        .select(
            *TRADE,
            F.col("out.date").alias("exit_date"),
            F.col("out.close").alias("exit_price"),
            F.when(F.col("hit").isNotNull(), F.col("hit.rule"))
            .when(timed_out, "TIMEOUT")
            .otherwise("OPEN")
            .alias("exit_reason"),
            (F.col("out.bar_no") - F.col("entry_no")).alias("bars_held"),
        )
        .withColumn(
            "return_pct",
            F.try_divide(F.col("exit_price") - F.col("entry_price"), "entry_price") * 100.0,
        )
    )


def trade_quality(trades: DataFrame, p: Params = Params()) -> DataFrame:
    """A5: one row over the closed trades; a return of exactly 0 is neither win nor loss."""
    r = F.col("return_pct")
    mean = lambda cond: exact_mean(F.try_sum(F.when(cond, exact(r))), F.count_if(cond))
    s = trades.filter("exit_reason <> 'OPEN'").agg(
        F.count(F.lit(1)).alias("closed_trades"),
        F.count_if(r > 0).alias("wins"),
        F.count_if(r < 0).alias("losses"),
        mean(r > 0).alias("mean_win_pct"),
        mean(r < 0).alias("mean_loss_pct"),
    )
    return s.withColumns({
        "win_rate": F.try_divide(F.col("wins").cast("double"), "closed_trades"),
        "risk_reward": F.try_divide(F.col("mean_win_pct"), F.abs("mean_loss_pct")),
    })


def paper_profit(history: DataFrame, p: Params = Params()) -> DataFrame:
    """B2: per day, how many trades were held into its close and their profit against entry,
    the day of the exit included."""
    gain = (F.col("close") - F.col("entry_price")) * p.paper_quantity
    return (
        trade_paths(history, p)
        .filter(F.col("held") & F.col("close").isNotNull())
        .groupBy("date")
        .agg(
            F.count(F.lit(1)).alias("trades"),
            exact_total(gain).alias("profit"),
        )
        .orderBy("date")
    )

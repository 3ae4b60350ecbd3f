"""Rolling indicators of every bar of every ticker (W1-W8) and the newest-bar picks.

Bars are unique per (ticker, date), so a ticker's window holds at most one row per calendar
day however many raw rows its source delivered; duplicates are collapsed before this point
with a map-side combine. For series too long for one task there is
:func:`indicators_segmented`, with equal results.

Means come from running sums: ``S[i] - S[i-n]`` costs the same for any window length, while a
sliding frame re-adds n rows for each row. Sums are exact, so the difference equals the frame's own
sum: prices of at most six decimals as whole millionths, the others as decimals of 18 places, volumes
as two halves of 32 bits. Arithmetic of decimals for each row would cost more than all the rest. The mean is
rounded to 18 places, then cut to a double. A price beyond 10^20 makes the means over it NULL, for its
ticker only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from volsignals.functions.numeric import EXACT, EXACT_END, exact, exact_mean, micros, micros_exact, micros_mean
from volsignals.params import Params
from volsignals.schema import PRICES

INDICATORS = [
    "bar_no", "sma_200", "avg_volume_20", "rvol", "price_change", "price_change_pct",
    "daily_range", "short_history", "ghost", "stuck", "flat_idle",
]

#: A volume is summed in two halves, so that no sum leaves a long.
_HALF = 2**32


def without_nan(bars: DataFrame) -> DataFrame:
    """Missing prices as NULL only: a NaN would pass through sums and means."""
    null = F.lit(None).cast("double")
    return bars.withColumns({c: F.nanvl(c, null) for c in PRICES if c in bars.columns})


def _running(w: WindowSpec, p: Params) -> dict[str, Column]:
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    close, volume = F.col("close"), F.col("volume").cast("bigint")
    few = micros(close)
    return {
        "bar_no": F.row_number().over(w).cast("bigint"),
        "_micros": F.try_sum(F.coalesce(few, F.lit(0).cast("bigint"))).over(run),
        "_rest": F.try_sum(exact(F.when(few.isNull(), close))).over(run),
        "_rest_n": F.count_if(few.isNull() & (F.abs(close) < EXACT_END)).over(run),
        "_close_n": F.count("close").over(run),
        "_close_out": F.count_if(F.abs(close) >= EXACT_END).over(run),
        "_volume_low": F.sum(volume.bitwiseAND(_HALF - 1)).over(run),
        "_volume_high": F.sum(F.shiftright(volume, 32)).over(run),
        "_filled": F.last("close", ignorenulls=True).over(run),
    }


def _recent(w: WindowSpec, p: Params) -> dict[str, Column]:
    back = lambda n: w.rowsBetween(1 - n, 0)
    return {
        "_traded": F.max(F.when(F.col("volume") != 0, 1).when(F.col("volume") == 0, 0)).over(back(p.ghost_days)),
        "_std": F.stddev_samp("close").over(back(p.stuck_days)),
        "_top": F.max("close").over(back(p.stuck_days)),
        "_bottom": F.min("close").over(back(p.stuck_days)),
    }


def _lagged(w: WindowSpec, p: Params) -> dict[str, Column]:
    sums = ["_micros", "_rest", "_rest_n", "_close_n", "_close_out"]
    return {
        **{f"{c}0": F.lag(c, p.sma_period).over(w) for c in sums},
        **{f"{c}0": F.lag(c, p.rvol_period).over(w) for c in ("_volume_low", "_volume_high")},
        "_filled0": F.lag("_filled", 1).over(w),
    }


def _flags(p: Params) -> dict[str, Column]:
    full = F.col("bar_no") >= p.stuck_days
    return {
        "ghost": (F.col("bar_no") >= p.ghost_days) & F.coalesce(F.col("_traded") == 0, F.lit(False)),
        "stuck": full & F.coalesce(F.col("_std") < p.stuck_std, F.lit(False)),
        "flat_idle": full & (F.col("volume") == 0)
        & F.coalesce(F.col("_top") == F.col("_bottom"), F.lit(False)),
    }


def _mean_close(within: Callable[[str], Column]) -> Column:
    """Mean close of a window; ``within`` gives what the window added to a running sum."""
    n, more = within("_close_n"), within("_micros")
    none = F.lit(0).cast(EXACT)
    rest = F.when(F.col("_rest_n") > 0, F.col("_rest")).otherwise(none)
    rest0 = F.when(F.col("_rest_n0") > 0, F.col("_rest0")).otherwise(none)
    # sums below 10^18 keep all 18 places, a difference of two beyond it 17
    cut = lambda c: c.try_cast("decimal(36,18)")
    total = F.coalesce(cut(rest) - cut(rest0) + micros_exact(more), (rest - rest0 + micros_exact(more)).try_cast(EXACT))
    mean = F.when(within("_rest_n") == 0, micros_mean(more, n)).otherwise(exact_mean(total, n))
    return F.when(within("_close_out") == 0, mean)


def _shares(low: Column, high: Column) -> Column:
    """Volume from sums of its halves, as the double next to it."""
    wide = high.cast("decimal(20,0)") * F.lit(_HALF).cast("decimal(10,0)") + low.cast("decimal(20,0)")
    return F.when((F.abs(high) < 2**30) & (low < 2**62), (high * _HALF + low).cast("double")).otherwise(wide.cast("double"))


def _finish(df: DataFrame, keep: list[str], p: Params) -> DataFrame:
    within = lambda c: F.col(c) - F.coalesce(f"{c}0", F.lit(0).cast("bigint"))
    shares = _shares(within("_volume_low"), within("_volume_high"))
    return (
        df.withColumns({
            "sma_200": _mean_close(within),
            "avg_volume_20": shares / F.least("bar_no", F.lit(p.rvol_period)),
            "price_change": F.try_divide("_filled", "_filled0") - 1.0,
        })
        .withColumns({
            "rvol": F.coalesce(F.try_divide("volume", "avg_volume_20"), F.lit(0.0)),
            "price_change_pct": F.col("price_change") * 100.0,
            "daily_range": F.try_divide(F.col("high") - F.col("low"), "low") * 100.0,
            "short_history": F.col("bar_no") < p.sma_period,
            **_flags(p),
        })
        .select(*keep, *INDICATORS)
    )


def indicators(bars: DataFrame, p: Params = Params(), keep_last: bool = False) -> DataFrame:
    """Add the indicator columns to every bar; one exchange on ticker, one sort.

    ``keep_last`` adds a boolean ``is_latest`` for the newest bar of each ticker, from the
    same window. With ``segment_rows`` set, :func:`indicators_segmented` does the work.
    """
    if p.segment_rows:
        return indicators_segmented(bars, p, rows=p.segment_rows, keep_last=keep_last)
    w = Window.partitionBy("ticker").orderBy("date")
    keep = list(bars.columns)
    df = without_nan(bars).withColumns(_running(w, p) | _recent(w, p))
    extra = {}
    if keep_last:
        extra["is_latest"] = F.lead("date", 1).over(w).isNull()
        keep.append("is_latest")
    return _finish(df.withColumns(_lagged(w, p) | extra), keep, p)


def latest_indicators(bars: DataFrame, p: Params = Params()) -> DataFrame:
    """Indicators of each ticker's newest bar only."""
    return indicators(bars, p, keep_last=True).filter("is_latest").drop("is_latest")


def latest_flags(bars: DataFrame, p: Params = Params()) -> DataFrame:
    """Newest bar of each ticker with ``ghost``, ``stuck`` and ``flat_idle``.

    These rules count a few rows only, so history is cut by a group limit before the shuffle.
    """
    rows = max(p.ghost_days, p.stuck_days)
    near = without_nan(newest_bars(bars, rows)).drop("back")
    w = Window.partitionBy("ticker").orderBy("date")
    keep = [*bars.columns, "ghost", "stuck", "flat_idle"]
    flagged = near.withColumn("bar_no", F.row_number().over(w)).withColumns(_recent(w, p))
    return (
        flagged.withColumns(_flags(p))
        .withColumn("_last", F.lead("date", 1).over(w).isNull())
        .filter("_last")
        .select(*keep)
    )


def newest_bars(bars: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` bars of each ticker; planned as a group limit before the shuffle."""
    w = Window.partitionBy("ticker").orderBy(F.desc("date"))
    newest = bars.withColumn("back", F.row_number().over(w)).filter(F.col("back") <= n)
    return newest.withColumn("back", F.col("back").cast("bigint"))


def indicators_segmented(
    bars: DataFrame,
    p: Params = Params(),
    segment: str = "year",
    rows: int = 4096,
    keep_last: bool = False,
) -> DataFrame:
    """Equal to :func:`indicators`, with long series cut into pieces of ``rows`` bars.

    1. Count bars and find the last close per (ticker, calendar ``segment``): a map-side
       combined aggregation whose result has one row per segment.
    2. Running totals over those few rows give each segment its first bar number and the
       close carried into it.
    3. Joined back, every bar knows its number in the whole series; bars are dealt to pieces
       by number, and the last bars of a piece are copied into the next as run-up.
    4. The frames then run per (ticker, piece), where all of them fit, and the run-up is
       dropped.

    No task holds more than one segment or one piece of a ticker.
    """
    runup = max(p.sma_period, p.rvol_period, p.stuck_days, p.ghost_days) + 1
    if rows < runup:
        raise ValueError(f"rows must be at least {runup}, the longest window plus one")
    seg = F.date_trunc(segment, F.col("date")).cast("date")
    cut = without_nan(bars).withColumn("_segment", seg)
    sums = cut.groupBy("ticker", "_segment").agg(
        F.count(F.lit(1)).alias("_n"),
        F.max_by("close", F.when(F.col("close").isNotNull(), F.col("date"))).alias("_last"),
    )
    whole = Window.partitionBy("ticker")
    before = whole.orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        "ticker",
        "_segment",
        F.coalesce(F.sum("_n").over(before), F.lit(0).cast("bigint")).alias("_offset"),
        F.last("_last", ignorenulls=True).over(before).alias("_carried"),
        F.sum("_n").over(whole).alias("_total"),
    )
    ws = Window.partitionBy("ticker", "_segment").orderBy("date")
    # the windows come first, so that the join finds its rows sorted
    within = cut.withColumns({
        "_no": F.row_number().over(ws),
        "_filled": F.last("close", ignorenulls=True).over(ws.rowsBetween(Window.unboundedPreceding, 0)),
    })
    numbered = (
        within.join(starts, ["ticker", "_segment"])
        .withColumn("_no", F.col("_no") + F.col("_offset"))
        .withColumn("_filled", F.coalesce("_filled", "_carried"))
        .withColumn("is_latest", F.col("_no") == F.col("_total"))
        .drop("_segment", "_offset", "_carried", "_total")
    )
    home = F.floor((F.col("_no") - 1) / rows)
    tail = (F.col("_no") - 1) % rows >= rows - runup
    dealt = numbered.withColumn("_home", home).withColumn(
        "_piece",
        F.explode(F.when(tail, F.array("_home", F.col("_home") + 1)).otherwise(F.array("_home"))),
    )
    wp = Window.partitionBy("ticker", "_piece").orderBy("_no")
    first = {k: v for k, v in (_running(wp, p) | _recent(wp, p)).items() if k != "_filled"}
    first["bar_no"] = F.col("_no")
    done = dealt.withColumns(first).withColumns(_lagged(wp, p))
    keep = [*bars.columns, "is_latest"] if keep_last else list(bars.columns)
    return _finish(done.filter("_piece = _home"), keep, p)

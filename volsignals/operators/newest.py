"""The newest bars of every ticker as a small table of its own.

One row per ticker with its newest ``n`` bars, newest first. An increment is merged into it
without a look at history: a bar that comes again replaces the one of its day, a late one takes
its place if it is among the newest, and the oldest drop out. As an upsert never removes a day,
what is kept is always what the whole table would give.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volsignals.operators.indicators import newest_bars
from volsignals.schema import PRICES

#: Bars that are kept of a ticker.
KEPT = 20
_BAR = ["date", *PRICES, "volume"]
NEWEST = (
    "ticker STRING, bars ARRAY<STRUCT<date: DATE, open: DOUBLE, high: DOUBLE, low: DOUBLE, close: DOUBLE, "
    "volume: BIGINT>>"
)


def newest_of(bars: DataFrame, n: int = KEPT) -> DataFrame:
    """``ticker, bars`` of a whole table, whose days are unique; cut by a group limit before the shuffle."""
    return newest_bars(bars, n).groupBy("ticker").agg(
        F.sort_array(F.collect_list(F.struct(*_BAR)), asc=False).alias("bars")
    )


def merge_newest(newest: DataFrame, increment: DataFrame, n: int = KEPT) -> DataFrame:
    """``newest`` after an upsert of ``increment``, whose days are unique (``store.upsert`` takes the last)."""
    new = newest_of(increment, n).withColumnRenamed("bars", "_new")
    none = F.array().cast(newest.schema["bars"].dataType)
    old, add = F.coalesce("bars", none), F.coalesce("_new", none)
    rest = F.filter(old, lambda b: ~F.exists(add, lambda x: x["date"] == b["date"]))
    merged = F.slice(F.sort_array(F.concat(rest, add), asc=False), 1, n)
    return newest.join(new, "ticker", "full").select("ticker", merged.alias("bars"))


def _first(field: str) -> Column:
    return F.get("bars", F.lit(0))[field]


def newest_dates(newest: DataFrame) -> DataFrame:
    """Q3 from the small table; also the marks of ``increments.past_high_water``."""
    return newest.select("ticker", _first("date").alias("latest_date"))


def newest_closes(newest: DataFrame) -> DataFrame:
    """Q7 from the small table."""
    return newest.select("ticker", _first("close").alias("close"), _first("date").alias("date"))


def newest_rows(newest: DataFrame, n: int = KEPT) -> DataFrame:
    """Q6 from the small table: a row per bar, ``back`` 1 for the newest."""
    rows = newest.select("ticker", F.posexplode(F.slice("bars", 1, n)).alias("_back", "_bar"))
    return rows.select("ticker", *[F.col(f"_bar.{c}").alias(c) for c in _BAR], (F.col("_back") + 1).cast("bigint").alias("back"))

"""Keeping the bar table and its load metadata (S9, S11, S12, S14, S15) and lookups (Q1-Q8).

Here as functions of frames; the table on disk is in ``snapshots``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from volsignals.operators.indicators import newest_bars
from volsignals.params import Params
from volsignals.schema import POSITION_COLUMNS

KEY = ["ticker", "date"]


# --- writes as functions of the old table -------------------------------------------------


def keep_last(df: DataFrame, key: list[str], order: Column) -> DataFrame:
    """One row per ``key``, the one highest in ``order``. An aggregation, so copies of a key
    collapse before the shuffle no matter how many there are.

    Where ``order`` and the columns have a fixed width, each column has a winner of its own, all under
    the same order and so of the same row, in a hash aggregation. Otherwise the row is one value,
    which has no fixed width, and Spark sorts the rows by key before it combines them.
    """
    rest = [c for c in df.columns if c not in key]
    typed = df.select(*[F.col(c) for c in rest], order.alias("_order_"))
    if all(_fixed(f.dataType) for f in typed.schema):
        best = [F.max_by(c, order).alias(c) for c in rest]
        return df.groupBy(*key).agg(*best).select(*df.columns)
    return (
        df.groupBy(*key)
        .agg(F.max_by(F.struct(*rest), order).alias("_row"))
        .select(*[c if c in key else F.col(f"_row.{c}").alias(c) for c in df.columns])
    )


def _fixed(kind: T.DataType) -> bool:
    return isinstance(kind, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType))


def upsert(old: DataFrame, new: DataFrame, key: list[str] = KEY, unique: bool = False) -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` with the same key; the rest is appended.

    Of several rows of ``new`` with one key the last counts: the highest ``ingest_seq`` if there
    is such a column, then the largest in its columns; with ``unique`` there is one. The old table must be unique and is only
    filtered: when the increment is small, Spark broadcasts its keys and history is not shuffled
    at all; when it is large, the anti-join shuffles both sides on the key.
    """
    order = ["ingest_seq"] if "ingest_seq" in new.columns else []
    if not unique:
        new = keep_last(new, key, F.struct(*order, *[c for c in new.columns if c not in (*key, *order)]))
    kept = old.join(new.select(*key), key, "left_anti")
    return kept.select(*old.columns).unionByName(new.select(*old.columns))


def batch_meta(batch: DataFrame, source: str, now: dt.datetime) -> DataFrame:
    """Load metadata of one batch: its row count per ticker, not the table's."""
    return batch.groupBy("ticker").agg(
        F.lit(now).cast("timestamp").alias("last_updated"),
        F.lit(source).alias("data_source"),
        F.count(F.lit(1)).alias("record_count"),
    )


def upsert_meta(old: DataFrame, batch: DataFrame, source: str, now: dt.datetime) -> DataFrame:
    return upsert(old, batch_meta(batch, source, now), ["ticker"])


def delete_tickers(table: DataFrame, tickers: list[str] | DataFrame) -> DataFrame:
    """S15; a list for a few names, a table with column ``ticker`` for many."""
    if isinstance(tickers, DataFrame):
        return table.join(tickers.select("ticker").distinct(), "ticker", "left_anti")
    return table.filter(~F.col("ticker").isin(list(tickers)))


def keep_tickers(table: DataFrame, tickers: list[str] | DataFrame) -> DataFrame:
    """S3, same two forms."""
    if isinstance(tickers, DataFrame):
        return table.join(tickers.select("ticker").distinct(), "ticker", "left_semi")
    return table.filter(F.col("ticker").isin(list(tickers)))


def reload_ticker(old: DataFrame, ticker: str, new: DataFrame | None) -> DataFrame:
    """S14, one table: the ticker's old rows go even if there is nothing to load in their place.

    ``plans.update.reload`` does bars and metadata together.
    """
    rest = delete_tickers(old, [ticker])
    if new is None:
        return rest
    return rest.unionByName(new.filter(F.col("ticker") == ticker).select(*old.columns))


# --- lookups ------------------------------------------------------------------------------


def bars_range(
    bars: DataFrame,
    ticker: str | None = None,
    start: dt.date | None = None,
    end: dt.date | None = None,
) -> DataFrame:
    """Q1: bars of one ticker (or of all) by date, both ends included."""
    out = bars
    if ticker is not None:
        out = out.filter(F.col("ticker") == ticker)
    if start is not None:
        out = out.filter(F.col("date") >= F.lit(start))
    if end is not None:
        out = out.filter(F.col("date") <= F.lit(end))
    return out.orderBy("date") if ticker is not None else out.orderBy("ticker", "date")


def tickers(bars: DataFrame) -> DataFrame:
    """Q2."""
    return bars.select("ticker").distinct().orderBy("ticker")


def latest_date(bars: DataFrame) -> DataFrame:
    """Q3, for every ticker at once."""
    return bars.groupBy("ticker").agg(F.max("date").alias("latest_date"))


def table_stats(bars: DataFrame) -> DataFrame:
    """Q4: one row; no bars give ``No data``."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return bars.agg(
        F.countDistinct("ticker").alias("total_tickers"),
        F.count(F.lit(1)).alias("total_records"),
        F.min("date").alias("_lo"),
        F.max("date").alias("_hi"),
    ).select(
        "total_tickers",
        "total_records",
        F.coalesce(F.concat(day("_lo"), F.lit(" to "), day("_hi")), F.lit("No data")).alias(
            "date_range"
        ),
    )


def ticker_preview(bars: DataFrame, p: Params = Params()) -> DataFrame:
    """Q5: one row with the first tickers and how many more there are."""
    return first_names(bars.select("ticker").distinct(), p.ticker_preview)


def first_names(names: DataFrame, n: int) -> DataFrame:
    """One row: the first ``n`` of distinct tickers in order, and how many more there are.

    Ranks by name within hash buckets; only each bucket's first ``n`` are gathered, so the list
    stays bounded, and the names are computed once.
    """
    bucket = F.pmod(F.xxhash64("ticker"), F.lit(64))
    w = Window.partitionBy("_b").orderBy("ticker")
    near = names.withColumn("_b", bucket).withColumn("_r", F.row_number().over(w))
    return near.agg(
        F.slice(
            F.array_sort(F.collect_list(F.when(F.col("_r") <= n, F.col("ticker")))), 1, n
        ).alias("first"),
        F.greatest(F.count(F.lit(1)) - n, F.lit(0)).alias("more"),
    )


def last_bars(bars: DataFrame, n: int = 20) -> DataFrame:
    """Q6 for every ticker: newest ``n`` bars."""
    return newest_bars(bars, n)


def latest_close(bars: DataFrame) -> DataFrame:
    """Q7 for every ticker."""
    return bars.groupBy("ticker").agg(
        F.max_by("close", "date").alias("close"), F.max("date").alias("date")
    )


def list_positions(positions: DataFrame) -> DataFrame:
    """Q8."""
    return positions.select(*POSITION_COLUMNS).orderBy("ticker")

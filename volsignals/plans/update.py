"""Loading and updating the bar table: files or deliveries in, table and statistics out."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volsignals.operators import increments, newest, snapshots, store
from volsignals.params import Params
from volsignals.sources import csv_files


@dataclass(frozen=True)
class Update:
    bars: DataFrame
    meta: DataFrame
    stats: DataFrame  # one row of counts
    outcome: DataFrame  # a row for every file or expected ticker, failed ones included


def load_csv_folder(
    spark: SparkSession,
    folder: str,
    bars: DataFrame,
    meta: DataFrame,
    ingest_seq: int,
    now: dt.datetime,
    only: list[str] | None = None,
) -> Update:
    """Upsert every accepted file of ``folder``; statistics count files."""
    load = csv_files.load_folder(spark, folder, ingest_seq, only)
    return Update(
        store.upsert(bars, load.bars),
        store.upsert_meta(meta, load.bars, csv_files.CSV_SOURCE, now),
        csv_files.load_stats(load.files),
        load.files,
    )


def apply_delivery(
    bars: DataFrame,
    meta: DataFrame,
    delivered: DataFrame,
    source: str,
    now: dt.datetime,
    expected: DataFrame | None = None,
    p: Params = Params(),
) -> Update:
    """Upsert a delivery; ``expected`` defaults to the tickers already held, and
    tickers outside it are not touched."""
    expected = store.tickers(bars) if expected is None else expected
    taken = store.keep_tickers(delivered, expected)
    outcome = increments.delivery(expected, taken)
    return Update(
        store.upsert(bars, taken),
        store.upsert_meta(meta, taken, source, now),
        increments.delivery_stats(outcome, p),
        outcome,
    )


def update_range(
    bars: DataFrame,
    meta: DataFrame,
    landed: DataFrame,
    start: dt.date,
    end: dt.date,
    source: str,
    now: dt.datetime,
    p: Params = Params(),
) -> Update:
    """S16 as a plan: only the days asked for are taken over."""
    return apply_delivery(bars, meta, increments.in_range(landed, start, end), source, now, p=p)


def smart_update(
    bars: DataFrame,
    meta: DataFrame,
    landed: DataFrame,
    today: dt.date,
    source: str,
    now: dt.datetime,
    expected: DataFrame | None = None,
    marks: DataFrame | None = None,
) -> Update:
    """S18 as a plan: each ticker goes on after its newest bar; bars and metadata follow.

    ``outcome`` has a row for every expected ticker: ``up to date`` if its newest bar is not
    before ``today``, else ``updated`` or ``failed`` with the number of new bars.
    """
    expected = store.tickers(bars) if expected is None else expected.select("ticker").distinct()
    marks = store.latest_date(bars) if marks is None else marks
    fresh = increments.past_high_water(
        bars, store.keep_tickers(landed, expected), today, marks=marks
    )
    got = fresh.groupBy("ticker").agg(F.count(F.lit(1)).alias("rows"))
    outcome = (
        expected.join(marks, "ticker", "left")
        .join(got, "ticker", "left")
        .select(
            "ticker",
            F.when(F.col("rows") > 0, "updated")
            .when(F.col("latest_date") >= F.lit(today), "up to date")
            .otherwise("failed")
            .alias("status"),
            F.coalesce("rows", F.lit(0).cast("bigint")).alias("rows"),
        )
    )
    n = lambda status, name: F.count_if(F.col("status") == status).alias(name)
    stats = outcome.agg(
        n("updated", "updated"), n("up to date", "up_to_date"), n("failed", "failed"),
        F.count(F.lit(1)).alias("total"), F.coalesce(F.sum("rows"), F.lit(0).cast("bigint")).alias("rows"),
    )
    return Update(
        store.upsert(bars, fresh), store.upsert_meta(meta, fresh, source, now), stats, outcome
    )


def update_table(
    spark: SparkSession,
    path: str,
    landed: DataFrame,
    today: dt.date,
    expected: DataFrame | None = None,
    stream: tuple[str, int] | None = None,
) -> int:
    """S18 on disk: the daily update of the table at ``path``; returns the snapshot's number.

    High-water marks come from the newest bars kept with the table, and only the parts that fresh bars
    fall into are read and written, so the work follows the increment and not history.
    ``expected`` defaults to the tickers held; one that is not held starts at the default date.
    """
    marks = newest.newest_dates(snapshots.read_newest(spark, path))
    landed = store.keep_tickers(landed, marks if expected is None else expected)
    fresh = increments.past_high_water(landed, landed, today, marks=marks)
    return snapshots.merge_bars(spark, path, fresh, stream=stream)


def reload(
    bars: DataFrame, meta: DataFrame, ticker: str, new: DataFrame | None, source: str, now: dt.datetime
) -> Update:
    """A ticker's bars and metadata replaced together; gone if there is nothing new."""
    own = bars.limit(0) if new is None else new.filter(F.col("ticker") == ticker)
    rest = store.delete_tickers(meta, [ticker])
    asked = bars.sparkSession.createDataFrame([(ticker,)], "ticker STRING")
    outcome = increments.delivery(asked, own)
    return Update(
        store.reload_ticker(bars, ticker, new),
        rest.unionByName(store.batch_meta(own, source, now).select(*rest.columns)),
        increments.delivery_stats(outcome),
        outcome,
    )


def clear(bars: DataFrame, meta: DataFrame, tickers: list[str] | DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bars and metadata without these tickers."""
    return store.delete_tickers(bars, tickers), store.delete_tickers(meta, tickers)

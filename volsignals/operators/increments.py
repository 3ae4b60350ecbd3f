"""Landed increments: date ranges, high-water marks, delivery statistics."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from volsignals.params import Params
from volsignals.texts import DEFAULT_START


def in_range(landed: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Delivered bars from ``start`` to ``end``, both included."""
    return landed.filter(F.col("date").between(F.lit(start), F.lit(end)))


def past_high_water(
    bars: DataFrame,
    landed: DataFrame,
    today: dt.date,
    default_start: dt.date = dt.date.fromisoformat(DEFAULT_START),
    marks: DataFrame | None = None,
) -> DataFrame:
    """Delivered bars newer than what each ticker already has, up to ``today``.

    A ticker without bars starts at ``default_start``. The marks are one row per ticker and
    only of tickers in the increment; the join is left to Spark's size check. ``marks`` (ticker,
    latest_date), kept with the table, saves reading history for them.
    """
    if marks is not None:
        marks = marks.select("ticker", F.col("latest_date").alias("_mark"))
    else:
        marks = (
            bars.join(landed.select("ticker").distinct(), "ticker", "left_semi")
            .groupBy("ticker")
            .agg(F.max("date").alias("_mark"))
        )
    start = F.coalesce(F.date_add("_mark", 1), F.lit(default_start))
    return (
        landed.filter(F.col("date") <= F.lit(today))
        .join(marks, "ticker", "left")
        .filter(F.col("date") >= start)
        .drop("_mark")
    )


def delivery(expected: DataFrame, delivered: DataFrame) -> DataFrame:
    """Every expected ticker with its number of delivered bars and whether it succeeded."""
    got = delivered.groupBy("ticker").agg(F.count(F.lit(1)).alias("rows"))
    return (
        expected.select("ticker")
        .distinct()
        .join(got, "ticker", "left")
        .select(
            "ticker",
            F.coalesce("rows", F.lit(0).cast("bigint")).alias("rows"),
            F.col("rows").isNotNull().alias("success"),
        )
    )


def failed_tickers(outcome: DataFrame) -> DataFrame:
    """All tickers of :func:`delivery` that got nothing, one row each."""
    return outcome.filter("NOT success").select("ticker")


def delivery_stats(outcome: DataFrame, p: Params = Params()) -> DataFrame:
    """One row of counts over :func:`delivery`, with a preview of the failed tickers.

    ``failed_first`` are the first by name and ``failed_more`` counts the others; the whole list
    is :func:`failed_tickers`.
    """
    bucket = F.pmod(F.xxhash64("ticker"), F.lit(64))
    w = Window.partitionBy("_b", "success").orderBy("ticker")
    near = outcome.withColumn("_b", bucket).withColumn("_r", F.row_number().over(w))
    failed = ~F.col("success")
    first = F.when(failed & (F.col("_r") <= p.failed_preview), F.col("ticker"))
    return near.agg(
        F.count_if("success").alias("success"),
        F.count_if(failed).alias("failed"),
        F.count(F.lit(1)).alias("total"),
        F.slice(F.array_sort(F.collect_list(first)), 1, p.failed_preview).alias("failed_first"),
        F.greatest(F.count_if(failed) - p.failed_preview, F.lit(0)).alias("failed_more"),
    )

"""Bars, positions and the other inputs, derived by Spark from the order tables.

The tables hold no price series, so line items are grouped into one bar per supplier and
ship date. The first aggregation keys on (ticker, date) and combines map-side, so a supplier
with a large share of the line items is spread over its dates and shrinks before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from volsignals.params import Params

# thresholds that fit the derived volumes; everything else keeps its default
DERIVED = Params(min_volume=10, climax_rvol=1.5)


# Order of line items within a day, by (order, line, part, price). One number instead of a
# struct: a struct cannot be updated in place, which would turn the hash aggregation into a
# sort of all line items.
LINE_ORDER = """
    CAST(l_orderkey * 10 + l_linenumber AS DECIMAL(15,0)) * 10000000000000000000000
    + CAST(l_partkey AS DECIMAL(11,0)) * 100000000000
    + CAST(floor(l_extendedprice * 100 + 0.5) AS DECIMAL(11,0))
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bar per (supplier, ship date); tickers ending in 9, 7 and 3 get a flat, a dead and
    a spiking end so that every screen and rule has cases."""
    price = F.lit(100.0) + F.lit(100.0) * F.col("l_discount") + F.lit(10.0) * F.col("l_tax")
    raw = (
        table(spark, sf_dir, "lineitem")
        .select(
            F.col("l_suppkey").cast("bigint").alias("tk"),
            F.col("l_shipdate").cast("date").alias("date"),
            price.alias("p"),
            F.col("l_quantity").alias("q"),
            F.expr(LINE_ORDER).alias("k"),
        )
        .groupBy("tk", "date")
        .agg(
            F.min_by("p", "k").alias("open"),
            F.max("p").alias("high"),
            F.min("p").alias("low"),
            F.max_by("p", "k").alias("close"),
            F.sum("q").cast("bigint").alias("volume"),
        )
        .withColumn("ticker", F.concat(F.lit("T"), F.col("tk").cast("string")))
        .withColumn("kind", F.col("tk") % 10)
    )
    # "among the newest n" is "no row n steps ahead": one ascending sort, which the
    # indicator windows reuse
    w = Window.partitionBy("ticker").orderBy("date")
    ahead = {f"_ahead{n}": F.lead("date", n).over(w) for n in (1, 3, 5)}
    flat = (F.col("kind") == 9) & F.col("_ahead5").isNull()
    dead = (F.col("kind") == 7) & F.col("_ahead3").isNull()
    spike = (F.col("kind") == 3) & F.col("_ahead1").isNull()
    return raw.withColumns(ahead).select(
        "ticker",
        "date",
        *[F.when(flat, 105.0).otherwise(F.col(c)).alias(c) for c in ("open", "high", "low", "close")],
        F.when(dead, F.lit(0).cast("bigint"))
        .when(spike, F.col("volume") * 12)
        .otherwise(F.col("volume"))
        .alias("volume"),
    )


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("T"), F.col("s_suppkey").cast("bigint").cast("string")).alias("ticker"),
        (F.col("s_acctbal") / 10).alias("paid_up_capital"),
    )


def ticker_number(c: str = "ticker"):
    return F.substring(c, 2, 18).cast("bigint")


def positions(bars_df: DataFrame) -> DataFrame:
    """One position per ticker, bought at its 30th newest bar at 80 to 104 % of the close."""
    w = Window.partitionBy("ticker").orderBy(F.desc("date"))
    tk = ticker_number()
    return (
        bars_df.select("ticker", "date", "close", F.row_number().over(w).alias("_back"))
        .filter("_back = 30")
        .select(
            "ticker",
            (F.col("close") * (F.lit(0.80) + F.lit(0.06) * (tk % 5))).alias("buy_price"),
            (tk + 100).alias("quantity"),
            F.col("date").alias("purchase_date"),
            F.concat(F.lit("lot "), F.col("ticker")).alias("notes"),
        )
        .select(
            "ticker", "buy_price", "quantity", F.col("buy_price").alias("highest_seen"),
            "purchase_date", "notes",
        )
    )


def corp_actions(bars_df: DataFrame) -> DataFrame:
    """Bonus issues for every fourth ticker: 10 % at its 300th and 20 % at its 100th newest bar."""
    w = Window.partitionBy("ticker").orderBy(F.desc("date"))
    return (
        bars_df.filter(ticker_number() % 4 == 0)
        .select("ticker", "date", F.row_number().over(w).alias("_back"))
        .filter("_back <= 300 AND _back IN (100, 300)")
        .select(
            "ticker",
            F.col("date").alias("ex_date"),
            F.when(F.col("_back") == 100, 0.20).otherwise(0.10).alias("bonus_fraction"),
        )
    )

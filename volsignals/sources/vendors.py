"""Landed vendor deliveries brought to the six standard columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volsignals.operators.store import KEY
from volsignals.sources.cleaning import REQUIRED, canonical, parse, require_columns
from volsignals.texts import VENDOR_A_SOURCE, VENDOR_B_SOURCE

# fixed values: column names of vendor B; its LTP, YCP, TRADE and VALUE_MN are not used
VENDOR_B_NAMES = {
    "DATE": "Date",
    "OPENP": "Open",
    "HIGH": "High",
    "LOW": "Low",
    "CLOSEP": "Close",
    "VOLUME": "Volume",
}


#: Rows of a delivery that one task groups, about 200 bytes each.
TASK_ROWS = 500_000


def from_vendor_a(df: DataFrame, ticker: Column | None = None) -> DataFrame:
    """Names in any case."""
    low = df.toDF(*[c.lower() for c in df.columns])
    named = low.withColumnsRenamed({c.lower(): c for c in REQUIRED})
    return _six(named, F.col("ticker") if ticker is None else ticker)


def from_vendor_b(df: DataFrame, ticker: Column | None = None) -> DataFrame:
    """The closing price is ``CLOSEP``, not the last trade; ticker from ``TRADING_CODE``."""
    code = F.col("TRADING_CODE") if ticker is None else ticker
    named = df.select(
        code.alias("_code"), *[F.col(c).alias(VENDOR_B_NAMES.get(c, c)) for c in df.columns]
    )
    return _six(named, F.col("_code"))


def _six(named: DataFrame, ticker: Column) -> DataFrame:
    """Ticker and the six columns; a row order the caller added as ``_order`` is kept."""
    extra = [c for c in named.columns if c == "_order"]
    return require_columns(named).select(ticker.alias("ticker"), *REQUIRED, *extra)


def bad_date_tickers(parsed: DataFrame) -> DataFrame:
    """Tickers with at least one row whose date did not parse."""
    return parsed.filter("date IS NULL").select("ticker").distinct()


def delivered_bars(
    six: DataFrame, source: str, ingest_seq: int, order: Column | None = None
) -> DataFrame:
    """Canonical bars of a delivery. Unlike a file, a delivery with a bad date is refused for
    that ticker as a whole.

    The delivery is read three times (its length, its bad dates, its rows), so it should be landed. Split by
    bytes, its rows would meet in as few tasks as there are cores; a large one is dealt by its length, so
    that no task groups many more than ``TASK_ROWS`` rows before the shuffle on ticker and date.
    """
    order = F.monotonically_increasing_id() if order is None else order
    parsed = parse(six.withColumn("_order", order))
    sound = parsed.join(bad_date_tickers(parsed), "ticker", "left_anti")
    tasks = -(-six.count() // TASK_ROWS)
    if tasks > 1:
        sound = sound.repartition(tasks, F.xxhash64(*KEY, "_order"))
    return canonical(sound, source, ingest_seq, F.col("_order"))


def vendor_a_bars(df: DataFrame, ingest_seq: int, ticker: Column | None = None) -> DataFrame:
    return delivered_bars(from_vendor_a(df, ticker), VENDOR_A_SOURCE, ingest_seq)


def vendor_b_bars(df: DataFrame, ingest_seq: int, ticker: Column | None = None) -> DataFrame:
    return delivered_bars(from_vendor_b(df, ticker), VENDOR_B_SOURCE, ingest_seq)

"""From text columns to the canonical bar table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from volsignals.functions.numeric import (
    DATE_FORMATS, clean_date, clean_number, clean_volume, finite, plain_date, whole,
)
from volsignals.operators.store import KEY, keep_last
from volsignals.schema import BAR_COLUMNS, PRICES

REQUIRED = ["Date", "Open", "High", "Low", "Close", "Volume"]


def missing_columns(columns: list[str]) -> list[str]:
    """Required names not among ``columns``; names match exactly."""
    return [c for c in REQUIRED if c not in columns]


def require_columns(df: DataFrame) -> DataFrame:
    lacking = missing_columns(df.columns)
    if lacking:
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    return df


def parse(
    df: DataFrame,
    thousands: bool = False,
    formats: tuple[str, ...] = DATE_FORMATS,
    day_first: Column | None = None,
) -> DataFrame:
    """Typed columns from the six named ones; bad dates and prices become NULL, bad volumes 0.
    Other columns are kept. ``day_first`` tells how dates with the year last are read. Columns that
    are dates, doubles or whole numbers already give what their text would, without being spelled."""
    require_columns(df)
    text = lambda c: F.col(c).cast("string")
    others = [c for c in df.columns if c not in REQUIRED]
    # a float or a decimal may be spelled as another double than its own
    number = lambda c: isinstance(df.schema[c].dataType, (T.DoubleType, T.IntegralType))
    price = lambda c: finite(F.col(c)) if number(c) else clean_number(text(c), thousands)
    typed = isinstance(df.schema["Date"].dataType, T.DateType)
    return df.select(
        *others,
        (plain_date(F.col("Date")) if typed else clean_date(text("Date"), formats, day_first)).alias("date"),
        *[price(c.capitalize()).alias(c) for c in PRICES],
        (whole(F.col("Volume")) if number("Volume") else clean_volume(text("Volume"), thousands)).alias("volume"),
    )


def canonical(
    parsed: DataFrame, source: str, ingest_seq: int, order: Column
) -> DataFrame:
    """Drop rows without date or without any price, keep the last row in ``order``
    per (ticker, date), stamp source and batch number.

    Unusable rows get no place in the order, which the aggregation passes over, instead of a
    filter: a filter would move below the parsing and parse everything twice.
    """
    usable = F.col("date").isNotNull() & F.coalesce(*PRICES).isNotNull()
    rows = parsed.select(
        "ticker", "date", *PRICES, "volume", F.when(usable, order).alias("_order")
    )
    return (
        keep_last(rows, KEY, F.col("_order"))
        .filter(F.col("_order").isNotNull())
        .withColumns({
            "source": F.lit(source),
            "ingest_seq": F.lit(ingest_seq).cast("bigint"),
        })
        .select(*BAR_COLUMNS)
    )

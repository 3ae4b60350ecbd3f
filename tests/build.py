"""Small literal inputs for hand-checked cases."""

from __future__ import annotations

import datetime as dt

DAY0 = dt.date(2024, 1, 1)
SCHEMA = (
    "ticker STRING, date DATE, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume BIGINT"
)


def day(n: int) -> dt.date:
    return DAY0 + dt.timedelta(days=n)


def series(ticker, closes, volumes, opens=None):
    """Bars on consecutive days."""
    opens = opens or closes
    return [
        (ticker, day(i), o, c, c, c, v)
        for i, (c, v, o) in enumerate(zip(closes, volumes, opens))
    ]


def bars(spark, *rows):
    flat = [r for part in rows for r in (part if isinstance(part, list) else [part])]
    return spark.createDataFrame(flat, SCHEMA)


def positions(spark, *rows):
    """(ticker, buy, quantity, highest, purchase_date)"""
    return spark.createDataFrame(
        [(*r, "") for r in rows],
        "ticker STRING, buy_price DOUBLE, quantity BIGINT, highest_seen DOUBLE, "
        "purchase_date DATE, notes STRING",
    )


def by(df, key="ticker"):
    return {r[key]: r for r in df.collect()}

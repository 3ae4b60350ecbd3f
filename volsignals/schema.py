"""Canonical table schemas."""

from __future__ import annotations

BARS = (
    "ticker STRING, date DATE, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, "
    "volume BIGINT, source STRING, ingest_seq BIGINT"
)
LOAD_META = "ticker STRING, last_updated TIMESTAMP, data_source STRING, record_count BIGINT"
FUNDAMENTALS = "ticker STRING, paid_up_capital DOUBLE"
POSITIONS = (
    "ticker STRING, buy_price DOUBLE, quantity BIGINT, highest_seen DOUBLE, "
    "purchase_date DATE, notes STRING"
)
TRADES_IN = (
    "ticker STRING, buy_price DOUBLE, quantity BIGINT, purchase_date DATE, notes STRING"
)
CORP_ACTIONS = "ticker STRING, ex_date DATE, bonus_fraction DOUBLE"

PRICES = ["open", "high", "low", "close"]
BAR_COLUMNS = ["ticker", "date", *PRICES, "volume", "source", "ingest_seq"]
POSITION_COLUMNS = [
    "ticker", "buy_price", "quantity", "highest_seen", "purchase_date", "notes",
]
SIGNAL_COLUMNS = [
    "ticker", "status", "date", "close", "volume", "rvol", "avg_volume_20",
    "price_change_pct", "sma_200", "paid_up_capital", "score", "signal", "reasons",
]
SELL_COLUMNS = [
    "ticker", "action", "signal_type", "urgency", "reason", "buy_price", "current_price",
    "highest_seen", "profit_pct", "profit_amount", "quantity", "rvol", "stop_loss_price",
    "trailing_stop_price",
]

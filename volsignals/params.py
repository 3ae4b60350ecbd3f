"""Thresholds of the signal engine. Every operator takes them as one argument."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    # fixed values: indicator windows and screens
    sma_period: int = 200
    rvol_period: int = 20
    min_volume: int = 50_000
    ghost_days: int = 3
    stuck_days: int = 5
    stuck_std: float = 0.01

    # fixed values: scoring
    rvol_threshold: float = 2.5
    quiet_move: float = 0.02
    low_cap: float = 50.0
    high_rvol_points: int = 50
    quiet_points: int = 20
    low_float_points: int = 20
    above_sma_points: int = 10
    below_sma_points: int = -50
    buy_score: int = 80
    wait_score: int = 45

    # fixed values: exit rules
    stop_factor: float = 0.93
    trail_factor: float = 0.95
    climax_profit_pct: float = 20.0
    climax_rvol: float = 5.0
    doji_body: float = 0.01

    # described rules, off unless switched on
    penny_trap: bool = False
    high_cap: float = 500.0
    penny_move_pct: float = 0.5
    strict_floor: bool = False
    break_even: bool = False
    break_even_gain: float = 0.10

    # position sizing
    risk_fraction: float = 0.02
    stop_fraction: float = 0.05

    # reports
    top_buy: int = 20
    top_wait: int = 10
    ticker_preview: int = 50
    failed_preview: int = 10

    # ours: bars per piece when a ticker's series is to be split over several tasks (None keeps a
    # series whole); holding horizon and lot of the backtest
    segment_rows: int | None = None
    hold_bars: int = 60
    paper_quantity: int = 1

import re
from dataclasses import replace

import pandas as pd
import pytest
from pyspark.sql import functions as F

import build
from volsignals import Params
from volsignals.operators import backtest as bt
from volsignals.operators.corporate import adjust_for_bonus
from volsignals.plans.analyze import signal_history
from volsignals.sources import driver_tables as src


def actions(spark, *rows):
    return spark.createDataFrame(list(rows), "ticker STRING, ex_date DATE, bonus_fraction DOUBLE")


def test_bonus(spark):
    b = build.bars(spark, build.series("A", [100.0] * 6, [7] * 6), build.series("B", [50.0], [1]))
    ev = actions(spark, ("A", build.day(4), 0.20), ("A", build.day(2), 0.10))
    got = adjust_for_bonus(b, ev)
    a = [(round(r.close, 2), round(r.open, 2), r.volume) for r in got.filter("ticker = 'A'").orderBy("date").collect()]
    assert a == [(75.76, 75.76, 7)] * 2 + [(83.33, 83.33, 7)] * 2 + [(100.0, 100.0, 7)] * 2
    assert got.filter("ticker = 'B'").first().close == 50.0
    assert got.count() == 7


def test_two_events_on_one_day_compound(spark):
    b = build.bars(spark, build.series("A", [132.0] * 3, [7] * 3))
    ev = actions(spark, ("A", build.day(1), 0.20), ("A", build.day(1), 0.10))
    got = [round(r.close, 6) for r in adjust_for_bonus(b, ev).orderBy("date").collect()]
    assert got == [100.0, 132.0, 132.0]


def history(spark, closes, entries, ticker="A", volumes=None):
    rows = [
        (ticker, i + 1, build.day(i), c, "BUY" if i in entries else "IGNORE", "success")
        for i, c in enumerate(closes)
    ]
    return spark.createDataFrame(
        rows, "ticker STRING, bar_no BIGINT, date DATE, close DOUBLE, signal STRING, status STRING"
    )


def trade(spark, closes, h=5):
    return bt.backtest(history(spark, closes, {0}), Params(hold_bars=h)).first()


def test_trailing_exit(spark):
    r = trade(spark, [100.0, 120.0, 115.0, 114.0, 90.0])
    assert (r.exit_reason, r.exit_price, r.bars_held, r.exit_date) == ("TAKE_PROFIT", 114.0, 3, build.day(3))
    assert r.return_pct == pytest.approx(14.0)


def test_stop_loss_exit(spark):
    r = trade(spark, [100.0, 93.0, 50.0])
    assert (r.exit_reason, r.exit_price, r.bars_held) == ("STOP_LOSS", 93.0, 1)


def test_timeout_and_open(spark):
    r = trade(spark, [100.0] * 7, h=5)
    assert (r.exit_reason, r.bars_held, r.return_pct) == ("TIMEOUT", 5, 0.0)
    r = trade(spark, [100.0] * 4, h=5)
    assert (r.exit_reason, r.exit_price, r.bars_held) == ("OPEN", None, None)
    r = trade(spark, [100.0], h=5)
    assert r.exit_reason == "OPEN"


def test_exit_only_within_the_horizon(spark):
    r = trade(spark, [100.0, 100.0, 100.0, 50.0], h=2)
    assert (r.exit_reason, r.exit_price, r.bars_held) == ("TIMEOUT", 100.0, 2)


def test_null_closes_are_passed_over(spark):
    r = trade(spark, [100.0, None, 99.0, None], h=3)
    assert (r.exit_reason, r.exit_price, r.bars_held) == ("TIMEOUT", 99.0, 2)


def test_screened_signals_do_not_enter(spark):
    h = history(spark, [100.0] * 3, {0}).withColumn("status", F.lit("filtered"))
    assert bt.backtest(h).count() == 0


def _exits(g: pd.DataFrame, p: Params):
    g = g.sort_values("date").reset_index(drop=True)
    out = []
    for e in g.index[(g["signal"] == "BUY") & (g["status"] == "success")]:
        price = peak = g["close"][e]
        res = ("OPEN", None)
        for k in range(e + 1, min(e + p.hold_bars, len(g) - 1) + 1):
            c = g["close"][k]
            peak = max(peak, c)
            if c <= price * p.stop_factor:
                res = ("STOP_LOSS", c)
            elif c <= peak * p.trail_factor:
                res = ("TAKE_PROFIT", c)
            elif k == e + p.hold_bars:
                res = ("TIMEOUT", c)
            if res[1] is not None:
                break
        out.append((g["ticker"][e], g["date"][e], *res))
    return out


@pytest.mark.parametrize("h, rows", [(3, None), (60, None), (3, 3), (3, 10), (60, 7), (60, 128)])
def test_against_a_loop(spark, sf, h, rows):
    p = Params(min_volume=10, hold_bars=h, trail_factor=0.93, rvol_threshold=1.5)
    hist = signal_history(src.bars(spark, sf), src.fundamentals(spark, sf), p).cache()
    cut = replace(p, segment_rows=rows)
    got = {
        (r.ticker, r.entry_date): (r.exit_reason, r.exit_price) for r in bt.backtest(hist, cut).collect()
    }
    if rows:  # every column, and the profit of every day
        assert sorted(bt.backtest(hist, cut).collect()) == sorted(bt.backtest(hist, p).collect())
        assert bt.paper_profit(hist, cut).collect() == bt.paper_profit(hist, p).collect()
    want = {}
    pdf = hist.select("ticker", "date", "close", "signal", "status").toPandas()
    for _, g in pdf.groupby("ticker"):
        want.update({(t, d): (why, x) for t, d, why, x in _exits(g, p)})
    assert len(want) > 50 and got == want


def test_a_long_ticker_is_dealt_to_several_tasks(spark):
    """One ticker with 5,000 bars: its pieces are grouped by piece, none holds more than one and its copies."""
    h = history(spark, [100.0 + i % 7 for i in range(5000)], set(range(0, 5000, 5))).cache()
    p = Params(hold_bars=20, segment_rows=100)
    paths = bt.trade_paths(h, p)
    assert paths.groupBy("_piece").agg(F.countDistinct("bar_no").alias("n")).agg(F.max("n")).first()[0] <= 120
    assert paths.select("_piece").distinct().count() == 50
    plan = bt.backtest(h, p)._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert len(keys) == 1 and "_piece" in keys[0]


def test_quality(spark):
    t = spark.createDataFrame(
        [(10.0, "TIMEOUT"), (20.0, "TAKE_PROFIT"), (-5.0, "STOP_LOSS"), (0.0, "TIMEOUT"), (None, "OPEN")],
        "return_pct DOUBLE, exit_reason STRING",
    )
    r = bt.trade_quality(t).first()
    assert (r.closed_trades, r.wins, r.losses) == (4, 2, 1)
    assert (r.mean_win_pct, r.mean_loss_pct, r.win_rate, r.risk_reward) == (15.0, -5.0, 0.5, 3.0)
    none = bt.trade_quality(t.filter("false")).first()
    assert none.closed_trades == 0 and none.win_rate is None and none.risk_reward is None


def test_paper_profit(spark):
    h = history(spark, [100.0, 101.0, 90.0, 95.0], {0, 1})
    got = {r.date: (r.trades, r.profit) for r in bt.paper_profit(h, Params(paper_quantity=10)).collect()}
    # both leave on the third day, which is their last
    assert got == {build.day(1): (1, 10.0), build.day(2): (2, -210.0)}

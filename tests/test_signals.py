import datetime as dt

import pytest
from pyspark.sql import functions as F

import build
from volsignals import Params, texts
from volsignals.operators.scoring import label
from volsignals.operators.screens import drop_category, drop_idle_floor, drop_penny_traps, screen
from volsignals.operators.indicators import latest_indicators
from volsignals.plans.analyze import analyze, analyze_ticker, latest_status, signal_history
from volsignals.sources import driver_tables as src

K = 1000  # volumes well over the minimum


def wave(n, base=100.0):
    return [base + (i % 3) for i in range(n)]


def message(spark, closes, volumes, p=Params()):
    b = build.bars(spark, build.series("A", closes, volumes))
    r = latest_status(b, None, p).first()
    return r.status, r.message


def test_ghost_town(spark):
    assert message(spark, wave(6), [90 * K] * 3 + [0] * 3) == ("filtered", texts.GHOST_TOWN)


def test_ghost_wins_over_stuck(spark):
    assert message(spark, [5.0] * 6, [90 * K] * 3 + [0] * 3)[1] == texts.GHOST_TOWN


def test_two_zero_volumes_are_not_ghost(spark):
    assert message(spark, wave(2), [0, 0]) == ("filtered", "Low volume: 0")


def test_stuck_needs_five_rows(spark):
    assert message(spark, [5.0] * 5, [90 * K] * 5)[1] == texts.STUCK
    assert message(spark, [5.0] * 4, [90 * K] * 4) == ("success", texts.PASSED)


def test_null_deviation_passes(spark):
    closes = [None] * 4 + [5.0]
    b = [("A", build.day(i), 5.0, 5.0, 5.0, c, 90 * K) for i, c in enumerate(closes)]
    assert latest_status(build.bars(spark, b)).first().status == "success"


@pytest.mark.parametrize("v,status", [(49_999, "filtered"), (50_000, "success")])
def test_minimum_volume(spark, v, status):
    assert message(spark, wave(6), [90 * K] * 5 + [v])[0] == status


def one(spark, closes, volumes, cap=None):
    b = build.bars(spark, build.series("A", closes, volumes))
    caps = None
    if cap is not None:
        caps = spark.createDataFrame([("A", cap)], "ticker STRING, paid_up_capital DOUBLE")
    return analyze(b, caps).first()


LOUD = [60 * K] * 19 + [600 * K]


def test_rvol_alone_and_below_mean(spark):
    r = one(spark, [100.0] * 18 + [101.0, 90.0], LOUD)
    assert (r.score, r.signal, list(r.reasons)) == (0, "IGNORE", ["High RVOL (6.9x)", "Below 200 SMA"])


def test_quiet_edge_is_not_quiet(spark):
    # in doubles 102/100 - 1 is just above 0.02
    r = one(spark, [99.0] * 18 + [100.0, 102.0], LOUD)
    assert (r.score, r.signal) == (60, "WAIT")


def test_fall_is_quiet_too(spark):
    r = one(spark, [90.0] * 18 + [100.0, 99.0], LOUD)
    assert (r.score, r.signal) == (80, "BUY")
    assert r.reasons[1] == "Quiet Accumulation (RVOL 6.9x, Price Change -1.00%)"


@pytest.mark.parametrize("cap,points", [(49.9, 100), (50.0, 80), (None, 80), (-3.0, 100)])
def test_low_float(spark, cap, points):
    assert one(spark, [90.0] * 18 + [100.0, 99.0], LOUD, cap).score == points


def test_close_equal_to_mean_counts_as_below(spark):
    b = build.bars(spark, build.series("A", [83.3] * 4, [90 * K] * 4))
    r = analyze(b).first()
    assert (r.score, list(r.reasons)) == (-50, [texts.BELOW_SMA])


def test_rvol_exactly_at_threshold_scores_nothing(spark):
    p = Params(min_volume=1)
    b = build.bars(
        spark,
        build.series("AT", wave(20), [35] * 19 + [95]),
        build.series("UP", wave(20), [35] * 19 + [96]),
    )
    r = build.by(analyze(b, None, p))
    assert all("High RVOL" not in x for x in r["AT"].reasons)
    assert r["UP"].reasons[0] == "High RVOL (2.5x)"


def test_labels(spark):
    df = spark.createDataFrame([(80,), (79,), (45,), (44,)], "score INT")
    got = [r[1] for r in df.select("score", label(F.col("score"))).collect()]
    assert got == ["BUY", "WAIT", "WAIT", "IGNORE"]


def test_sorted_by_score_then_ticker(spark, sf):
    rows = analyze(src.bars(spark, sf), src.fundamentals(spark, sf), src.DERIVED).collect()
    keys = [(-r.score, r.ticker) for r in rows]
    assert keys == sorted(keys) and len(rows) > 5


def test_missing_ticker_and_missing_day(spark):
    b = build.bars(spark, build.series("A", wave(6), [90 * K] * 6))
    asked = spark.createDataFrame([("A",), ("NONE",)], "ticker STRING")
    r = build.by(latest_status(b, tickers=asked))
    assert r["A"].status == "success"
    assert (r["NONE"].status, r["NONE"].message) == ("error", texts.NO_DATA)
    r = build.by(latest_status(b, tickers=asked, as_of=build.day(40)))
    assert r["A"].message == f"No data for date {build.day(40)}"
    assert r["NONE"].message == texts.NO_DATA
    assert analyze_ticker(b, "NONE").first().status == "error"
    assert analyze_ticker(b, "A").first().date == build.day(5)


def test_as_of_day_judges_that_bar_and_its_past_only(spark):
    b = build.bars(spark, build.series("A", wave(10), [90 * K] * 7 + [0] * 3))
    assert latest_status(b).first().message == texts.GHOST_TOWN
    r = latest_status(b, as_of=build.day(5)).first()
    assert (r.status, r.date) == ("success", build.day(5))
    short = latest_status(b.filter(F.col("date") <= F.lit(build.day(5)))).first()
    assert (r.score, r.close, r.sma_200) == (short.score, short.close, short.sma_200)


def test_history_ends_with_the_latest_signal(spark, sf):
    b, f = src.bars(spark, sf), src.fundamentals(spark, sf)
    newest = signal_history(b, f, src.DERIVED).join(
        b.groupBy("ticker").agg(F.max("date").alias("date")), ["ticker", "date"]
    )
    h = {r.ticker: (r.score, r.signal, r.status) for r in newest.collect()}
    s = {r.ticker: (r.score, r.signal, r.status) for r in latest_status(b, f, src.DERIVED).collect()}
    assert h == s


def test_history_is_not_changed_by_later_bars(spark, sf):
    b, f = src.bars(spark, sf), src.fundamentals(spark, sf)
    cut = dt.date(1999, 1, 1)
    cols = ["ticker", "date", "status", "score", "reasons"]
    early = signal_history(b.filter(F.col("date") < F.lit(cut)), f, src.DERIVED).select(*cols)
    full = signal_history(b, f, src.DERIVED).filter(F.col("date") < F.lit(cut)).select(*cols)
    assert early.exceptAll(full).count() == 0 and full.exceptAll(early).count() == 0


def test_optional_screens(spark):
    b = build.bars(
        spark,
        build.series("HEAVY", [100.0] * 4 + [100.2, 100.4], [90 * K] * 6),
        build.series("IDLE", [5.0] * 6, [90 * K] * 5 + [0]),
        build.series("FLAT", [5.0] * 6, [90 * K] * 6),
        build.series("FINE", wave(6), [90 * K] * 6),
    )
    caps = spark.createDataFrame(
        [("HEAVY", 900.0), ("IDLE", 10.0)], "ticker STRING, paid_up_capital DOUBLE"
    )
    rows = latest_indicators(b).join(caps, "ticker", "left")
    assert sorted(r.ticker for r in drop_penny_traps(rows).collect()) == ["FINE", "FLAT", "IDLE"]
    assert sorted(r.ticker for r in drop_idle_floor(rows).collect()) == ["FINE", "FLAT", "HEAVY"]
    on = build.by(screen(rows, Params(penny_trap=True, strict_floor=True)))
    assert on["HEAVY"].message == texts.PENNY_TRAP
    assert on["IDLE"].message == texts.STUCK
    assert on["FLAT"].message == texts.PASSED
    assert build.by(screen(rows))["FLAT"].message == texts.STUCK
    cats = spark.createDataFrame([("HEAVY", "Z"), ("FINE", "A")], "ticker STRING, category STRING")
    assert sorted(r.ticker for r in drop_category(rows, cats).collect()) == ["FINE", "FLAT", "IDLE"]


def test_split_series_give_the_same_signals(spark, sf):
    b, f = src.bars(spark, sf), src.fundamentals(spark, sf)
    from dataclasses import replace

    cut = replace(src.DERIVED, segment_rows=201)
    for q in (latest_status, signal_history):
        x, y = q(b, f, src.DERIVED), q(b, f, cut)
        assert x.columns == y.columns
        assert x.exceptAll(y).count() == 0 and y.exceptAll(x).count() == 0

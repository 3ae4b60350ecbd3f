import datetime as dt

import pytest
from pyspark.sql import functions as F

import build
from volsignals import Params
from volsignals.operators import positions as pos
from volsignals.operators.store import latest_close
from volsignals.plans.dashboard import as_json, dashboard, feed, read_feed
from volsignals.sources import driver_tables as src

D = build.day(0)


def decision(spark, buy, peak, closes, opens=None, volumes=None, p=Params(), **kw):
    volumes = volumes or [100] * len(closes)
    b = build.bars(spark, build.series("A", closes, volumes, opens))
    held = build.positions(spark, ("A", buy, 10, peak, build.day(len(closes) - 1)))
    return pos.check_positions(held, b, p, **kw).first()


@pytest.mark.parametrize(
    "buy,peak,close,kind",
    [
        (100.0, 100.0, 93.0, "STOP_LOSS"),  # at the stop counts
        (100.0, 97.0, 93.1, None),
        (21.2, 24.0, 24.0, None),
        (21.2, 24.0, 23.5, None),
        (21.2, 24.0, 22.5, "TAKE_PROFIT"),
        (13.70, 16.50, 15.70, None),  # trailing stop is 15.675
        (100.0, 200.0, 190.0, "TAKE_PROFIT"),  # at the trailing stop counts
    ],
)
def test_stops(spark, buy, peak, close, kind):
    r = decision(spark, buy, peak, [close])
    assert r.signal_type == kind
    assert r.stop_loss_price == buy * 0.93 and r.trailing_stop_price == peak * 0.95


def test_texts(spark):
    r = decision(spark, 21.2, 24.0, [22.5])
    assert r.action == "SELL NOW 💰" and r.urgency == "HIGH"
    assert r.reason == "TRAILING STOP: Dropped 5% from peak of 24.00. Trend broken."
    r = decision(spark, 100.0, 100.0, [90.0])
    assert (r.action, r.urgency) == ("SELL NOW ❌", "CRITICAL")
    assert r.reason == "EMERGENCY BRAKE: Hit -7% stop loss limit"
    r = decision(spark, 100.0, 100.0, [101.0])
    assert (r.action, r.urgency, r.reason, r.rvol) == ("HOLD ✅", "LOW", "", 0.0)


def climax(spark, n=20, last_open=125.0, volume=6):
    closes = [120.0] * (n - 1) + [124.0]
    opens = [120.0] * (n - 1) + [last_open]
    # volume of the last bar against a mean over all 20
    vols = [100] * (n - 1) + [100 * 19 * volume // (20 - volume)]
    return decision(spark, 100.0, 125.0, closes, opens, vols)


def test_climax(spark):
    r = climax(spark, volume=6)
    assert (r.signal_type, r.action) == ("CLIMAX", "SELL HALF ⚠️")
    assert r.reason == "CLIMAX DETECTED: RVOL 6.0x with red/doji candle. Possible dump."


def test_climax_needs_20_bars_a_weak_candle_and_more_than_five(spark):
    assert climax(spark, n=19).signal_type is None
    assert climax(spark, last_open=120.0).signal_type is None
    assert climax(spark, last_open=123.5).signal_type == "CLIMAX"  # doji
    assert climax(spark, last_open=0.0).signal_type is None
    assert climax(spark, volume=5).signal_type is None


def test_ratchet_modes(spark):
    b = build.bars(spark, build.series("A", [90.0, 130.0, 110.0], [1, 1, 1]))
    held = build.positions(spark, ("A", 100.0, 1, 100.0, build.day(0)))
    assert pos.ratcheted(held, b).first().highest_seen == 130.0
    assert pos.ratcheted(held, b, since_last_run=True).first().highest_seen == 110.0
    late = build.positions(spark, ("A", 100.0, 1, 100.0, build.day(2)))
    assert pos.ratcheted(late, b).first().highest_seen == 110.0
    never = build.positions(spark, ("A", 140.0, 1, 140.0, build.day(0)), ("NOBARS", 1.0, 1, 1.0, D))
    r = build.by(pos.ratcheted(never, b))
    assert r["A"].highest_seen == 140.0 and r["NOBARS"].highest_seen == 1.0


def test_ratchet_never_falls_and_is_idempotent(spark, sf):
    b = src.bars(spark, sf)
    p0 = src.positions(b).cache()
    p1 = pos.ratcheted(p0, b).cache()
    both = p0.alias("a").join(p1.alias("b"), "ticker")
    assert both.filter("b.highest_seen < a.highest_seen").count() == 0
    assert p1.exceptAll(pos.ratcheted(p1, b)).count() == 0


def test_null_latest_close_holds(spark):
    b = build.bars(spark, [("A", D, 1.0, 1.0, 1.0, 50.0, 1), ("A", build.day(1), 1.0, 1.0, 1.0, None, 1)])
    held = build.positions(spark, ("A", 100.0, 1, 100.0, D))
    r = pos.check_positions(held, b).first()
    assert r.signal_type is None and r.current_price is None and r.highest_seen == 100.0


def test_positions_without_bars_are_skipped(spark):
    b = build.bars(spark, build.series("A", [1.0], [1]))
    held = build.positions(spark, ("B", 100.0, 1, 100.0, D))
    assert pos.sell_signals(held, b).count() == 0


def trades(spark, *rows):
    return spark.createDataFrame(
        list(rows), "ticker STRING, buy_price DOUBLE, quantity BIGINT, purchase_date DATE, notes STRING"
    )


def test_add(spark):
    held = build.positions(spark, ("A", 10.0, 1, 12.0, D))
    new = trades(
        spark,
        ("A", 99.0, 9, D, "dup"),
        ("B", 5.0, 2, None, None),
        ("C", 7.0, 1, build.day(5), "later"),
        ("C", 8.0, 3, build.day(1), "first"),
    )
    r = build.by(pos.add_positions(held, new, dt.date(2025, 1, 1)))
    assert set(r) == {"A", "B", "C"}
    assert (r["A"].buy_price, r["A"].highest_seen) == (10.0, 12.0)
    assert (r["B"].highest_seen, r["B"].purchase_date, r["B"].notes) == (5.0, dt.date(2025, 1, 1), "")
    assert (r["C"].buy_price, r["C"].notes) == (8.0, "first")
    refused = pos.rejected_trades(held, new, dt.date(2025, 1, 1)).collect()
    assert {x.notes for x in refused} == {"dup", "later"}
    order = new.withColumn("trade_seq", F.when(F.col("notes") == "later", 0).otherwise(1))
    first = build.by(pos.add_positions(held, order, dt.date(2025, 1, 1)))
    assert first["C"].notes == "later"  # submitted first, though bought later


def test_two_changes_make_one_position(spark):
    held = build.positions(spark, ("A", 10.0, 1, 12.0, D))
    ch = spark.createDataFrame(
        [("A", 5, 11.0, 2), ("A", 9, 12.0, 1)], "ticker STRING, quantity BIGINT, avg_price DOUBLE, ingest_seq INT"
    )
    rows = pos.update_positions(held, ch).collect()
    assert [(r.quantity, r.buy_price) for r in rows] == [(5, 11.0)]


def test_update(spark):
    held = build.positions(spark, ("A", 10.0, 1, 12.0, D), ("B", 20.0, 2, 20.0, D), ("C", 1.0, 1, 1.0, D))
    ch = spark.createDataFrame(
        [("A", 5, 11.0), ("B", 6, 0.0), ("X", 1, 1.0)], "ticker STRING, quantity BIGINT, avg_price DOUBLE"
    )
    r = build.by(pos.update_positions(held, ch))
    assert set(r) == {"A", "B", "C"}
    assert (r["A"].buy_price, r["A"].quantity, r["A"].highest_seen) == (11.0, 5, 12.0)
    assert (r["B"].buy_price, r["B"].quantity) == (20.0, 6)
    assert (r["C"].buy_price, r["C"].quantity) == (1.0, 1)


def test_remove(spark):
    held = build.positions(spark, ("A", 10.0, 1, 12.0, D), ("B", 20.0, 2, 20.0, D))
    sold = spark.createDataFrame([("A",), ("X",)], "ticker STRING")
    assert [r.ticker for r in pos.remove_positions(held, sold).collect()] == ["B"]


def test_summary(spark):
    b = build.bars(spark, build.series("A", [10.0, 12.0], [1, 1]), build.series("N", [3.0, None], [1, 1]))
    held = build.positions(spark, ("A", 10.0, 5, 10.0, D), ("NOBARS", 50.0, 1, 50.0, D), ("N", 9.0, 1, 9.0, D))
    r = pos.portfolio_summary(held, b).first()
    assert (r.total_positions, r.total_invested, r.current_value) == (3, 50.0, 60.0)
    assert (r.total_profit, r.profit_pct) == (10.0, 20.0)


def test_summary_of_nothing(spark):
    b = build.bars(spark, build.series("A", [10.0], [1]))
    r = pos.portfolio_summary(build.positions(spark, ("A", 1.0, 1, 1.0, D)).filter("false"), b).first()
    assert tuple(r) == (0, 0.0, 0.0, 0.0, 0.0)


def test_position_size(spark):
    one = spark.range(1).select(pos.position_size(F.lit(1_000_000.0)).alias("x")).first().x
    assert one == 400_000.0


def test_break_even(spark):
    p = Params(break_even=True)
    assert decision(spark, 100.0, 110.1, [99.9], p=p).stop_loss_price == 100.0
    assert decision(spark, 100.0, 109.0, [105.0], p=p).stop_loss_price == 93.0


def test_dashboard(spark):
    b = build.bars(spark, build.series("A", [10.0, 5.0], [1, 1]), build.series("B", [1.0], [1]))
    d = dashboard(build.positions(spark, ("A", 10.0, 5, 10.0, D)), b)
    assert d.positions.first().stop_loss_price == 10.0 * 0.93
    assert d.summary.first().current_value == 25.0
    assert d.signals.first().signal_type == "STOP_LOSS"
    assert [r.ticker for r in d.tickers.collect()] == ["A", "B"]
    assert '"signal_type":"STOP_LOSS"' in as_json(d.signals).first().json


def test_dashboard_feed_gives_the_values_back(spark):
    b = build.bars(spark, build.series("A", [10.0, 5.0], [1, 1]), build.series('B"é\n', [1 / 3], [1]))
    d = dashboard(build.positions(spark, ("A", 0.1 + 0.2, 5, 1e17 / 3, D), ("Z", 1e-300, 1, 2.0, None)), b)
    rows = feed(d).cache()
    assert [r["count"] for r in rows.groupBy("part").count().orderBy("part").collect()] == [2, 1, 1, 2]
    for name in ("positions", "summary", "signals", "tickers"):
        table = getattr(d, name)
        back = read_feed(rows, name).select(*table.columns)
        assert sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, table.collect()), key=repr)
    none = dashboard(build.positions(spark, ("A", 1.0, 1, 1.0, D)).limit(0), b.limit(0))
    assert [r.part for r in feed(none).collect()] == ["summary"]

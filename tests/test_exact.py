"""Means are not rounded on the way, and no value of one ticker stops the others."""

from __future__ import annotations

import datetime as dt

import build
import pytest
from pyspark.sql import functions as F

from volsignals.operators import store
from volsignals.operators.indicators import indicators, latest_flags, latest_indicators
from volsignals.operators.positions import portfolio_summary
from volsignals.plans import update
from volsignals.plans.analyze import latest_status
from volsignals.params import Params

K = 100 / 1.2


def bars(spark, *series):
    rows = [
        (t, build.day(n), c, c, c, c, v, "x", 1)
        for t, closes, volumes in series
        for n, (c, v) in enumerate(zip(closes, volumes))
    ]
    from volsignals.schema import BARS

    return spark.createDataFrame(rows, BARS)


def test_close_equal_to_its_mean_is_below(spark):
    closes = [K] * 25 + [K - 0.02, K + 0.02, K - 0.02, K + 0.02, K]
    b = bars(spark, ("A", closes, [60_000] * 29 + [60_000 * 20]))
    caps = spark.createDataFrame([("A", 40.0)], "ticker STRING, paid_up_capital DOUBLE")
    r = latest_status(b, caps).first()
    assert "Below 200 SMA" in r.reasons
    assert (r.score, r.signal) == (50 + 20 + 20 - 50 - (0 if r.price_change_pct > -2 else 20), "IGNORE")


@pytest.mark.parametrize(
    "closes, volumes",
    [
        ([1e13] * 3, [1] * 3),
        ([float("inf"), 1.0, 2.0], [1] * 3),
        ([1.0, 1.0, 1.0], [5 * 10**18] * 3),
        ([1e25, 1.0, 2.0], [-(2**63), 1, 1]),
    ],
)
def test_other_tickers_are_unchanged(spark, closes, volumes):
    good = ("G", [10.0, 11.0, 12.0], [100, 200, 300])
    alone = indicators(bars(spark, good)).collect()
    both = indicators(bars(spark, good, ("X", closes, volumes))).filter("ticker = 'G'").collect()
    assert sorted(both) == sorted(alone)


def test_mean_beyond_the_range_is_null_for_its_bars_only(spark):
    b = bars(spark, ("X", [1e25, 1.0, 2.0, 3.0], [1] * 4))
    got = [r.sma_200 for r in indicators(b, Params(sma_period=2)).orderBy("date").collect()]
    assert got[:2] == [None, None] and got[2:] == [1.5, 2.5]


def test_portfolio_of_large_positions(spark):
    held = build.positions(spark, ("A", 1000.0, 10**11, 1000.0, build.day(0)))
    r = portfolio_summary(held, bars(spark, ("A", [1001.0], [1]))).first()
    assert (r.total_invested, r.current_value) == (1e14, 1.001e14)


def test_flags_of_the_newest_rows_alone(spark, sf):
    from volsignals.sources import driver_tables as src

    b = src.bars(spark, sf)
    want = latest_indicators(b, src.DERIVED).select("ticker", "ghost", "stuck", "flat_idle").collect()
    got = latest_flags(b, src.DERIVED)
    assert sorted(got.select("ticker", "ghost", "stuck", "flat_idle").collect()) == sorted(want)
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


def test_increment_with_a_key_twice(spark):
    old = bars(spark, ("A", [1.0, 2.0], [1, 1]))
    new = bars(spark, ("A", [5.0], [1])).withColumn("ingest_seq", F.lit(3).cast("bigint")).unionByName(
        bars(spark, ("A", [9.0], [1])).withColumn("ingest_seq", F.lit(2).cast("bigint"))
    )
    assert sorted(r.close for r in store.upsert(old, new).collect()) == [2.0, 5.0]


def test_update_plans(spark):
    now, today = dt.datetime(2024, 5, 1), build.day(3)
    held = bars(spark, ("A", [1.0, 2.0], [1, 1]), ("B", [1.0] * 4, [1] * 4), ("C", [1.0], [1]))
    meta = store.batch_meta(held, "x", now)
    landed = bars(spark, ("A", [7.0] * 6, [1] * 6), ("B", [8.0] * 4, [1] * 4))
    u = update.smart_update(held, meta, landed, today, "y", now)
    assert {r.ticker: (r.status, r.rows) for r in u.outcome.collect()} == {
        "A": ("updated", 2), "B": ("up to date", 0), "C": ("failed", 0),
    }
    assert tuple(u.stats.first()) == (1, 1, 1, 3, 2)
    assert sorted(r.close for r in u.bars.filter("ticker = 'A'").collect()) == [1.0, 2.0, 7.0, 7.0]
    assert {r.ticker: r.record_count for r in u.meta.collect()} == {"A": 2, "B": 4, "C": 1}

    again = update.reload(held, meta, "A", landed, "y", now)
    assert again.bars.filter("ticker = 'A'").count() == 6
    assert {r.ticker: (r.data_source, r.record_count) for r in again.meta.collect()}["A"] == ("y", 6)
    gone = update.reload(held, meta, "A", None, "y", now)
    assert gone.meta.filter("ticker = 'A'").count() == 0 == gone.bars.filter("ticker = 'A'").count()
    assert [r.ticker for r in gone.outcome.filter("NOT success").collect()] == ["A"]
    left = update.clear(held, meta, ["A", "B"])
    assert [r.ticker for r in left[0].collect()] == ["C"] == [r.ticker for r in left[1].collect()]


def test_date_spellings(spark):
    from volsignals.functions.numeric import clean_date

    cases = {
        "2024-1-5": (1, 5), "1/5/2024": (1, 5), "25/12/2023": None, "20240105": (1, 5), "Jan 5, 2024": (1, 5),
        "2024-01-05T00:00:00Z": (1, 5), "2024/01/05 10:00": (1, 5), "05-01-2024": (1, 5), "5-Jan-2024": (1, 5),
        "2024-13-01": None, "2024-02-30": None, "soon": None, "": None, None: None, "99999999": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t STRING")
    got = {r.t: r.d and (r.d.month, r.d.day) for r in df.select("t", clean_date(F.col("t")).alias("d")).collect()}
    assert got == cases
    day = df.select("t", clean_date(F.col("t"), day_first=F.lit(True)).alias("d")).filter("t LIKE '%/%/____'")
    assert {r.t: str(r.d) for r in day.collect()} == {"1/5/2024": "2024-05-01", "25/12/2023": "2023-12-25"}


def test_day_order_is_chosen_per_file(spark, tmp_path):
    from volsignals.sources import csv_files

    head = "Date,Open,High,Low,Close,Volume"
    row = lambda d: f"{d},1,1,1,1,5"
    (tmp_path / "A_data.csv").write_text("\n".join([head, row("05/12/2023"), row("25/12/2023")]))
    (tmp_path / "B_data.csv").write_text("\n".join([head, row("05/12/2023"), row("12/25/2023"), row("oops")]))
    load = csv_files.load_folder(spark, str(tmp_path), 1)
    got = {(r.ticker, str(r.date)) for r in load.bars.collect()}
    assert got == {("A", "2023-12-05"), ("A", "2023-12-25"), ("B", "2023-05-12"), ("B", "2023-12-25")}
    assert tuple(csv_files.load_stats(load.files).first()) == (2, 0, 0, 2, 1)


def test_missing_folder_gives_zeros(spark, tmp_path):
    from volsignals.sources import csv_files

    load = csv_files.load_folder(spark, str(tmp_path / "none"), 1)
    assert load.bars.count() == 0
    assert tuple(csv_files.load_stats(load.files).first()) == (0, 0, 0, 0, 0)

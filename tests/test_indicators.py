import math
import random
from fractions import Fraction

import pandas as pd
import pytest
from pyspark.sql import functions as F

import build
from volsignals import Params, texts
from volsignals.operators.indicators import (
    indicators, indicators_segmented, latest_indicators, newest_bars,
)
from volsignals.sources import driver_tables as src


def last(df):
    return df.orderBy(F.desc("date")).first()


def test_rvol_at_and_above_threshold(spark):
    flat = [10.0 + i % 3 for i in range(20)]
    b = build.bars(
        spark,
        build.series("AT", flat, [35] * 19 + [95]),
        build.series("UP", flat, [35] * 19 + [96]),
    )
    rows = build.by(latest_indicators(b))
    assert rows["AT"].avg_volume_20 == 38.0 and rows["AT"].rvol == 2.5
    assert rows["UP"].rvol > 2.5


def test_first_bar(spark):
    r = indicators(build.bars(spark, build.series("A", [10.0], [5]))).first()
    assert (r.rvol, r.price_change, r.sma_200, r.short_history) == (1.0, None, 10.0, True)


def test_zero_volume_gives_zero_rvol(spark):
    r = last(indicators(build.bars(spark, build.series("A", [1.0, 2.0], [0, 0]))))
    assert r.rvol == 0.0 and not r.ghost


def test_null_close_is_filled_forward_for_returns(spark):
    r = indicators(build.bars(spark, build.series("A", [10.0, None, 11.0], [1, 1, 1])))
    got = [x.price_change for x in r.orderBy("date").collect()]
    assert got[0] is None and got[1] == 0.0 and got[2] == 11.0 / 10.0 - 1.0


def test_nan_close_counts_as_missing(spark):
    r = last(indicators(build.bars(spark, build.series("A", [10.0, float("nan"), 12.0], [1, 1, 1]))))
    assert r.sma_200 == 11.0


@pytest.mark.parametrize("price", [0.1, 0.3, 83.3, 105.7, 1234.55])
def test_mean_of_constant_price_is_that_price(spark, price):
    rows = indicators(build.bars(spark, build.series("A", [price] * 7, [1] * 7))).collect()
    assert {r.sma_200 for r in rows} == {price}


def test_zero_low_gives_null_range(spark):
    assert indicators(build.bars(spark, build.series("A", [0.0], [1]))).first().daily_range is None


def _pandas_indicators(g: pd.DataFrame) -> pd.DataFrame:
    g = g.sort_values("date").copy()
    g["e_sma"] = g["close"].rolling(200, min_periods=1).mean()
    g["e_avg"] = g["volume"].rolling(20, min_periods=1).mean()
    g["e_rvol"] = (g["volume"] / g["e_avg"].replace(0, math.nan)).fillna(0)
    f = g["close"].ffill()
    g["e_chg"] = f / f.shift() - 1
    g["e_std"] = g["close"].rolling(5).std()
    g["e_ghost"] = g["volume"].rolling(3).max() == 0
    return g


def test_against_pandas_on_derived_bars(spark, sf):
    got = indicators(src.bars(spark, sf), src.DERIVED).toPandas()
    for _, g in got.groupby("ticker"):
        e = _pandas_indicators(g)
        for ours, theirs in [
            ("sma_200", "e_sma"), ("avg_volume_20", "e_avg"), ("rvol", "e_rvol"),
            ("price_change", "e_chg"),
        ]:
            d = (e[ours] - e[theirs]).abs().max()
            assert d < 1e-9, (ours, d)
        assert (e["ghost"].astype(bool) == e["e_ghost"]).all()
        assert (e["stuck"].astype(bool) == (e["e_std"] < 0.01 - 1e-9)).all()


def _random_bars(spark, seed=3, n=900):
    rnd = random.Random(seed)
    rows = []
    for t, gap in (("A", 1), ("B", 3), ("C", 40)):
        d = 0
        for _ in range(n if gap < 40 else 60):
            d += rnd.randrange(1, 1 + 2 * gap)
            c = None if rnd.random() < 0.05 else round(rnd.uniform(5, 9), 2)
            rows.append((t, build.day(d), c, c, c, c, rnd.choice([0, 0, 5, 17])))
    rnd.shuffle(rows)
    return build.bars(spark, rows)


@pytest.mark.parametrize("rows", [201, 256, 400])
@pytest.mark.parametrize("segment", ["year", "month"])
def test_segmented_equals_plain(spark, rows, segment):
    b = _random_bars(spark)
    plain = indicators(b)
    cut = indicators_segmented(b, segment=segment, rows=rows)
    assert cut.columns == plain.columns
    assert cut.exceptAll(plain).count() == 0 and plain.exceptAll(cut).count() == 0


def test_segmented_rejects_pieces_shorter_than_a_window(spark):
    with pytest.raises(ValueError):
        indicators_segmented(_random_bars(spark), rows=200)


def test_no_look_ahead_and_order_independence(spark):
    b = _random_bars(spark)
    cut = build.day(500)
    early = indicators(b.filter(F.col("date") <= F.lit(cut)))
    full = indicators(b.repartition(5, F.rand(1))).filter(F.col("date") <= F.lit(cut))
    assert early.exceptAll(full).count() == 0 and full.exceptAll(early).count() == 0


def test_newest_bars(spark):
    b = build.bars(spark, build.series("A", [1.0] * 30, [1] * 30), build.series("B", [1.0] * 4, [1] * 4))
    n = build.by(newest_bars(b, 20).groupBy("ticker").agg(F.count("*").alias("n"), F.min("date").alias("d")))
    assert (n["A"].n, n["A"].d, n["B"].n) == (20, build.day(10), 4)


def test_segmented_query_derives_bars_once(spark, sf):
    from volsignals.plans import catalog

    plan = catalog.queries()["indicators_segmented"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "l_suppkey" not in plan


def test_no_decimal_is_added_for_a_price_of_few_decimals(spark):
    from volsignals.functions.numeric import micros

    xs = [104.6, 0.000001, -7.25, 0.0, 999999.999999, 1e6, 0.1 + 0.2, 1e-7, float("inf"), None]
    df = spark.createDataFrame([(n, x) for n, x in enumerate(xs)], "n INT, x DOUBLE")
    got = [r.m for r in df.orderBy("n").select(micros(F.col("x")).alias("m")).collect()]
    assert got == [104600000, 1, -7250000, 0, 999999999999, None, None, None, None, None]


@pytest.mark.parametrize("kind", ["few", "many", "mixed", "large"])
def test_means_are_rounded_from_the_exact_sum(spark, kind):
    rng = random.Random(kind)
    few = lambda: round(rng.uniform(1, 500), rng.randrange(7))
    many = lambda: rng.uniform(1, 500)
    make = {"few": few, "many": many, "mixed": lambda: rng.choice([few, many])(), "large": lambda: rng.choice([few(), rng.randrange(1, 3000) * 1e15])}
    closes = [None if rng.random() < 0.1 else make[kind]() for _ in range(90)]
    volumes = [rng.choice([rng.randrange(100), 2**62 - rng.randrange(100), -(2**40), 0]) for _ in closes]
    p = Params(sma_period=16, rvol_period=5)
    rows = [("A", build.day(n), c, c, c, c, v) for n, (c, v) in enumerate(zip(closes, volumes))]
    got = indicators(spark.createDataFrame(rows, build.SCHEMA), p).orderBy("date").collect()
    for n, r in enumerate(got):
        window = [Fraction(repr(c)) for c in closes[max(0, n - 15) : n + 1] if c is not None]
        # half up at 18 places, then to the double next to it
        mean = Fraction(int(sum(window) / len(window) * 10**18 + Fraction(1, 2)), 10**18) if window else None
        assert r.sma_200 == (None if mean is None else float(mean))
        held = volumes[max(0, n - 4) : n + 1]
        assert r.avg_volume_20 == float(sum(held)) / len(held)

"""Indicators from a stored state against the full pass."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

import build
from volsignals import Params
from volsignals.operators import continued as go
from volsignals.operators import store
from volsignals.operators.indicators import INDICATORS, indicators

P = Params(sma_period=12, rvol_period=5)


def bars(spark, seed=1, days=70, tickers="ABCDE"):
    """Series with gaps, missing closes (one ticker has none for long) and volumes of 0."""
    rng, rows = random.Random(seed), []
    for t in tickers:
        for n in range(days):
            if rng.random() < 0.15:
                continue
            c = None if rng.random() < 0.2 or (t == "E" and 5 < n < 60) else round(rng.uniform(1, 50), 2)
            rows.append((t, build.day(n), c, c, c, c, rng.choice([0, 0, rng.randrange(1000)])))
    return spark.createDataFrame(rows, build.SCHEMA)


def key(df):
    """A null as itself, the rest as it prints, so that values compare bit for bit."""
    columns = ["ticker", "date", "close", "volume", *INDICATORS]
    return sorted(tuple(repr(x) for x in r) for r in df.select(*columns).collect())


def before(df, n):
    return df.filter(F.col("date") < F.lit(build.day(n))), df.filter(F.col("date") >= F.lit(build.day(n)))


@pytest.mark.parametrize("cut", [0, 1, 3, 20, 50, 69])
def test_history_and_increment_equal_the_full_pass(spark, cut):
    every = bars(spark)
    old, new = before(every, cut)
    state = go.indicator_state(old, P)
    assert key(go.continued(state, new, P)) == key(indicators(every, P).filter(F.col("date") >= F.lit(build.day(cut))))


def test_state_advances_as_it_would_be_built(spark):
    every = bars(spark, seed=2)
    state = go.indicator_state(every.limit(0), P)
    for a in range(0, 70, 14):
        step = every.filter(F.col("date").between(F.lit(build.day(a)), F.lit(build.day(a + 13))))
        got = key(go.continued(state, step, P))
        upto = every.filter(F.col("date") <= F.lit(build.day(a + 13)))
        assert got == key(indicators(upto, P).filter(F.col("date") >= F.lit(build.day(a))))
        state = spark.createDataFrame(go.advance(state, step, P).collect(), go.STATE)
        want = sorted(go.indicator_state(upto, P).collect())
        assert sorted(state.collect()) == want
    assert max(len(r.bars) for r in state.collect()) == go.reach(P) == 13


def test_late_and_replaced_bars(spark):
    every = bars(spark, seed=3)
    late = (F.col("ticker") == "B") & (F.dayofmonth("date") == 9)
    wrong = (F.col("ticker") == "C") & (F.col("date") == F.lit(build.day(30)))
    old = before(every, 50)[0].filter(~late).withColumn("close", F.when(wrong, F.lit(99.0)).otherwise(F.col("close")))
    increment = every.filter((F.col("date") >= F.lit(build.day(50))) | late | wrong)
    changed = go.refreshed(every, go.indicator_state(old, P), increment, P)
    days = {(r.ticker, r.date) for r in changed.collect()}
    assert min(d for t, d in days if t == "A") >= build.day(50)  # not computed again
    assert min(d for t, d in days if t == "C") <= build.day(30)
    assert key(store.upsert(indicators(old, P), changed)) == key(indicators(every, P))


def test_new_tickers_and_nothing(spark):
    every = bars(spark, tickers="AB")
    state = go.indicator_state(every.filter("ticker = 'A'"), P)
    new = every.filter("ticker = 'B'")
    assert key(go.continued(state, new, P)) == key(indicators(new, P))
    assert go.continued(state, new.limit(0), P).collect() == []


def test_history_is_not_read(spark, tmp_path):
    every = bars(spark)
    old, new = before(every, 50)
    path = str(tmp_path / "state")
    go.indicator_state(old, P).write.parquet(path)
    inc = str(tmp_path / "inc")
    new.write.parquet(inc)
    plan = go.continued(spark.read.parquet(path), spark.read.parquet(inc), P)
    assert {f.split("/")[-2] for f in plan.inputFiles()} == {"state", "inc"}
    assert spark.read.parquet(path).select(F.max(F.size("bars"))).first()[0] <= 13
    assert key(plan) == key(indicators(every, P).filter(F.col("date") >= F.lit(build.day(50))))
    assert isinstance(build.day(50), dt.date)


def test_a_state_hands_on_without_a_join_of_every_bar(spark, tmp_path):
    every = bars(spark)
    old, new = before(every, 50)
    go.indicator_state(old, P).write.parquet(str(tmp_path / "state"))
    plan = go.continued(spark.read.parquet(str(tmp_path / "state")), new, P)._jdf.queryExecution().executedPlan().toString()
    # the tickers of the increment pick their states; nothing else is joined
    assert plan.count("LeftSemi") == 1 and "LeftOuter" not in plan
    # the bars of a state are not copied to each of their own rows
    assert "Generate inline(bars" in plan
    assert not any("exists(bars" in x for x in plan.split("Generate inline(bars")[0].splitlines())


def test_each_delivery_is_read_alone(spark, sf):
    from volsignals.plans import catalog

    plan = catalog.queries()["indicators_continued"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.splitlines() if "FileScan" in x and "/bars-" in x]
    assert scans and all("PartitionFilters: [isnotnull(arrived" in x for x in scans)

"""Every registered query against DuckDB, and the shape of the plans that matter."""

import re

import pytest

import __spark_entry__ as entry
import compare
from volsignals.plans import catalog

QUERIES, ORACLE = catalog.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return compare.connect(sf)


def test_every_query_has_a_check():
    # the corpus queries have tests of their own
    assert set(QUERIES) <= set(ORACLE) and set(ORACLE) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns[0] == "ticker"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_duckdb(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in p and "NestedLoop" not in p
    assert compare.differences(df, con, ORACLE[name]) == ""


def plan(spark, sf, name):
    return QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name", ["indicators", "score_history", "score_latest", "backtest", "screen", "ghost_flag"]
)
def test_one_exchange_on_ticker(spark, sf, name):
    # the other hash exchange is the grouping of line items into bars
    keys = re.findall(r"Exchange hashpartitioning\((\w+)", plan(spark, sf, name))
    # the ranked result is shuffled once more before its sort, by a hash of the ticker
    assert [k for k in keys if k != "xxhash64"] == ["ticker", "tk"]


def test_top_n_is_planned_as_top_n(spark, sf):
    assert "TakeOrderedAndProject" in plan(spark, sf, "top_buy")


def test_latest_rows_are_limited_before_the_shuffle(spark, sf, tmp_path):
    from volsignals.operators.indicators import newest_bars
    from volsignals.sources import driver_tables as src

    src.bars(spark, sf).write.parquet(str(tmp_path / "b"))
    df = newest_bars(spark.read.parquet(str(tmp_path / "b")), 20)
    p = df._jdf.queryExecution().executedPlan().toString()
    assert p.count("WindowGroupLimit") == 2  # one on each side of the exchange


@pytest.mark.parametrize("name", ["indicators", "clean_rows", "csv_lines", "csv_uniform"])
def test_raw_rows_are_grouped_by_hash(spark, sf, name):
    p = plan(spark, sf, name)
    assert "SortAggregate" not in p and "HashAggregate" in p


def test_filter_on_ticker_reaches_the_scan(spark, tmp_path):
    from volsignals.operators.indicators import indicators
    from volsignals.sources import driver_tables as src

    path = str(tmp_path / "b")
    src.bars(spark, "/root/testdata/sf0.001").write.parquet(path)
    df = indicators(spark.read.parquet(path)).filter("ticker = 'T3'")
    assert "EqualTo(ticker,T3)" in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["dashboard", "indicators_continued", "indicators_refreshed"])
def test_bars_are_derived_once(spark, sf, name):
    # what reads the bars several times reads them as written, not line items again
    assert "l_suppkey" not in plan(spark, sf, name)

import datetime as dt

import pytest
from pyspark.sql import functions as F

from volsignals import Params
from volsignals.operators.ranking import global_rank, range_parts
from volsignals.plans import reports
from volsignals.plans.analyze import analyze
from volsignals.sources import driver_tables as src

SCHEMA = (
    "ticker STRING, status STRING, date DATE, close DOUBLE, volume BIGINT, rvol DOUBLE, "
    "avg_volume_20 BIGINT, price_change_pct DOUBLE, sma_200 DOUBLE, paid_up_capital DOUBLE, "
    "score INT, signal STRING, reasons ARRAY<STRING>"
)
D = dt.date(2024, 2, 20)


@pytest.fixture()
def sample(spark):
    rows = [
        ("GP", "success", D, 286.6, 150000, 3.2, 50000, 1.5, 280.0, None, 90, "BUY",
         ["High RVOL (3.2x)", "Quiet Accumulation", "Above 200 SMA"]),
        ("BX", "success", D, 45.5, 250000, 2.8, 90000, 0.8, 50.0, 45.0, 85, "BUY",
         ["High RVOL (2.8x)", "Quiet Accumulation", "Low Float (45.0 Cr)"]),
        ("SQ", "success", D, 180.3, 120000, 1.5, 80000, -0.5, 0.0, 0.0, 50, "WAIT", ["Above 200 SMA"]),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_counts(sample):
    assert tuple(reports.signal_counts(sample).first()) == (3, 2, 1, 0)


def test_tops(sample):
    top = reports.top_buy(sample).collect()
    assert [r.ticker for r in top] == ["GP", "BX"]
    assert round(top[0].sma_diff, 2) == 2.36
    assert [r.ticker for r in reports.top_buy(sample, Params(top_buy=1)).collect()] == ["GP"]
    assert [r.ticker for r in reports.top_wait(sample).collect()] == ["SQ"]


def test_table(sample):
    r = {x["rank"]: x for x in reports.report_table(sample).collect()}
    gp, bx, sq = r[1], r[2], r[3]
    assert (gp.ticker, gp.band, gp.action, gp.close, gp.open) == ("GP", "score-high", "BUY", "286.60", "286.60")
    assert (gp.volume, gp.rvol, gp.change, gp.sma_200, gp.paid_up_capital) == (
        "150,000", "3.20x", "1.50%", "280.00", "N/A",
    )
    assert bx.paid_up_capital == "45.0 Cr"
    assert gp.reasons == "High RVOL (3.2x), Quiet Accumulation, Above 200 SMA"
    assert (sq.band, sq.action, sq.sma_200, sq.paid_up_capital) == ("score-medium", "WATCH", "N/A", "N/A")


def test_csv(spark, sample, tmp_path):
    path = reports.write_signals_csv(sample, str(tmp_path), dt.date(2024, 2, 20))
    assert path.endswith("/signals_20240220.csv")
    back = {r.ticker: r for r in spark.read.option("header", True).csv(path).collect()}
    assert back["SQ"].reasons == "Above 200 SMA"
    assert back["GP"].reasons == "High RVOL (3.2x) | Quiet Accumulation | Above 200 SMA"
    assert list(back["GP"].asDict()) == [f.name for f in sample.schema]


def test_rank_spans_partitions(spark):
    n = 10_000
    df = spark.range(n).select((F.col("id") % 7).alias("score"), F.col("id").alias("k"))
    got = global_rank(df.repartition(16), [-F.col("score"), F.col("k")]).collect()
    want = sorted(((i % 7, i) for i in range(n)), key=lambda t: (-t[0], t[1]))
    assert {(r["score"], r["k"]): r["rank"] for r in got} == {t: i + 1 for i, t in enumerate(want)}


def test_rank_of_few_and_no_rows(spark):
    one = spark.range(1).select(F.lit(5).alias("score"), "id")
    assert [r["rank"] for r in global_rank(one, [-F.col("score"), F.col("id")]).collect()] == [1]
    assert global_rank(one.limit(0), [-F.col("score"), F.col("id")]).collect() == []


@pytest.mark.parametrize("skew", ["ties", "third", "spread"])
def test_parts_of_a_rank_are_even(spark, skew):
    """200,000 rows, most with one leading value: no part has more than twice the mean."""
    n = 200_000
    score = {
        "ties": F.when(F.col("id") % 10 < 9, F.lit(0)).otherwise(F.col("id") % 100),
        "third": F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.xxhash64("id") % 1000),
        "spread": F.xxhash64("id") % 1_000_000,
    }[skew].cast("bigint")
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(n).select(score.alias("score"), F.concat(F.lit("T"), F.col("id")).alias("ticker"))
        order = [-F.col("score"), F.col("ticker")]
        parts = range_parts(df, order)
        sizes = [r["count"] for r in parts.groupBy("_part").count().collect()]
        assert len(sizes) == 64 and max(sizes) <= 2 * n / 64
        ranked = global_rank(df, order)
        got = ranked.agg(F.min("rank"), F.max("rank"), F.countDistinct("rank")).first()
        assert tuple(got) == (1, n, n)
        back = ranked.alias("a").join(ranked.alias("b"), F.expr("b.rank = a.rank + 1"))
        assert back.filter("a.score < b.score OR a.score = b.score AND a.ticker >= b.ticker").count() == 0
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_report_computes_its_rows_once(spark, sf, tmp_path):
    """The plan that writes the parts groups the line items into bars once."""
    b = src.bars(spark, sf)
    table = reports.report_table(analyze(b, None, src.DERIVED))
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and "Window" in plan and "rangepartitioning" not in plan


def test_report_has_the_real_prices(spark, sf):
    b = src.bars(spark, sf)
    rows = {r.ticker: r for r in reports.report_table(analyze(b, None, src.DERIVED)).collect()}
    newest = b.groupBy("ticker").agg(F.max_by("high", "date").alias("high")).collect()
    for x in newest:
        if x.ticker in rows:
            assert rows[x.ticker].high == f"{x.high:.2f}"

"""One key with a third of all rows: nothing may gather it raw in one task."""

import re

from pyspark.sql import functions as F

from volsignals.operators import store
from volsignals.operators.indicators import indicators
from volsignals.sources import driver_tables as src


def skewed(spark, sf, tmp_path):
    """The line items with every third one moved to supplier 1."""
    li = src.table(spark, sf, "lineitem")
    hot = F.xxhash64("l_orderkey", "l_linenumber", "l_partkey") % 3 == 0
    li.withColumn("l_suppkey", F.when(hot, F.lit(1).cast("bigint")).otherwise(F.col("l_suppkey"))).write.parquet(
        str(tmp_path / "lineitem.parquet")
    )
    return str(tmp_path)


def test_hot_supplier_is_combined_before_the_shuffle(spark, sf, tmp_path):
    folder = skewed(spark, sf, tmp_path)
    b = src.bars(spark, folder)
    raw = src.table(spark, folder, "lineitem")
    share = raw.filter("l_suppkey = 1").count() / raw.count()
    assert share > 0.3
    p = b._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"partial_max_by[\s\S]*FileScan", p)
    # after the grouping a ticker has at most one row per calendar day
    days = raw.select(F.col("l_shipdate").cast("date")).distinct().count()
    assert b.groupBy("ticker").count().agg(F.max("count")).first()[0] <= days
    want = raw.filter("l_suppkey = 1").select(F.sum("l_quantity")).first()[0]
    kept = b.filter("ticker = 'T1'").agg(F.sum("volume")).first()[0]
    assert kept == want
    assert indicators(b, src.DERIVED).count() == b.count()


def test_copies_of_one_key_collapse_in_the_map_tasks(spark):
    n = 90_000
    df = spark.range(n).repartition(8).select(
        F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(F.concat(F.lit("T"), F.col("id"))).alias("ticker"),
        F.lit("2024-01-01").cast("date").alias("date"),
        F.col("id").cast("double").alias("close"),
        "id",
    )
    got = store.keep_last(df, ["ticker", "date"], F.col("id"))
    p = got._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in p
    hot = got.filter("ticker = 'HOT'").collect()
    assert len(hot) == 1 and hot[0].close == float(n - 3)
    assert got.count() == n - n // 3 + 1

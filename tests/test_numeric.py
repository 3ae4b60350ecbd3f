import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from volsignals.functions import numeric as N


def rounded(spark, xs, digits):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i INT, x DOUBLE")
    rows = df.select("i", N.round_exact(F.col("x"), digits).alias("r")).orderBy("i").collect()
    return [r.r for r in rows]


def test_round_exact_on_known_ties(spark):
    xs = [2.675, 0.125, 0.375, 1.005, 2.65, 0.25, -2.675, -0.125, -0.001, 0.0, 1e9 + 0.125]
    for digits in (1, 2):
        got = rounded(spark, xs, digits)
        assert [repr(g) for g in got] == [repr(round(x, digits)) for x in xs]


def test_round_exact_on_many_values(spark):
    rnd = random.Random(7)
    xs = [rnd.randrange(0, 4_000_000) / 1000 for _ in range(5000)]
    xs += [rnd.randrange(1, 5000) * 20 / rnd.randrange(1, 3000) for _ in range(5000)]
    xs += [-x for x in xs[:500]]
    for digits in (1, 2):
        assert rounded(spark, xs, digits) == [round(x, digits) for x in xs]


@settings(
    max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(st.lists(st.floats(-1e7, 1e7), min_size=1, max_size=200))
def test_round_exact_property(spark, xs):
    assert rounded(spark, xs, 2) == [round(x, 2) for x in xs]


def test_fixed_text_equals_exact_formatting(spark):
    xs = [2.65, 2.35, 10.94117, 0.05, 12.25, -0.04]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i INT, x DOUBLE")
    got = [r.t for r in df.orderBy("i").select(N.fixed("%.1fx", 1, F.col("x")).alias("t")).collect()]
    assert got == [f"{x:.1f}x" for x in xs]


def test_null(spark):
    df = spark.createDataFrame([(None,)], "x DOUBLE")
    assert df.select(N.exact(F.col("x"))).first()[0] is None
    assert rounded(spark, [None], 2) == [None]


def test_clean_number(spark):
    cases = {
        "12.5": 12.5, " 7 ": 7.0, "1e3": 1000.0, "-0.5": -0.5, ".5": 0.5, "abc": None, "": None,
        "1d": None, "1e400": None, "-1e999": None, "1f": None, "nan": None, "1,234.5": None, None: None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t STRING")
    got = {r.t: r.x for r in df.select("t", N.clean_number(F.col("t")).alias("x")).collect()}
    assert got == cases
    one = spark.createDataFrame([("1,234.5",)], "t STRING")
    assert one.select(N.clean_number(F.col("t"), thousands=True)).first()[0] == 1234.5


def test_clean_volume(spark):
    cases = {"100": 100, "99.9": 99, "": 0, "x": 0, None: 0, "1e30": 0, "-3.7": -3}
    df = spark.createDataFrame([(k,) for k in cases], "t STRING")
    got = {r.t: r.x for r in df.select("t", N.clean_volume(F.col("t")).alias("x")).collect()}
    assert got == cases


def test_clean_date(spark):
    import datetime as dt

    cases = {
        "2024-02-29": dt.date(2024, 2, 29), "2024/03/01": dt.date(2024, 3, 1),
        "03/04/2024": dt.date(2024, 3, 4), "2024-01-02 10:11:12": dt.date(2024, 1, 2),
        "05-Jan-2024": dt.date(2024, 1, 5), "2024-02-30": None, "soon": None, "": None, None: None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t STRING")
    got = {r.t: r.x for r in df.select("t", N.clean_date(F.col("t")).alias("x")).collect()}
    assert got == cases

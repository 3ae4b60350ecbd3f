import datetime as dt

import pytest
from pyspark.sql import functions as F

import build
from volsignals.operators import increments, snapshots, store
from volsignals.plans.update import apply_delivery, load_csv_folder
from volsignals.schema import BARS, LOAD_META
from volsignals.sources import csv_files, vendors
from volsignals.sources.cleaning import missing_columns

NOW = dt.datetime(2024, 5, 1, 6, 0)
HEAD = "Date,Open,High,Low,Close,Volume\n"


@pytest.fixture()
def folder(tmp_path):
    f = tmp_path / "csv"
    f.mkdir()
    (f / "GOOD_data.csv").write_text(
        HEAD
        + "2024-01-03,3,3,3,3,30\n"
        + "2024-01-01,1,1.5,0.5,1,10.9\n"
        + "soon,9,9,9,9,9\n"  # bad date: dropped
        + "2024-01-02,abc,2,2,2,\n"  # bad price: null; blank volume: 0
        + "2024-01-04,,,,,40\n"  # no price at all: dropped
        + "2024-01-03,4,4,4,4,44\n"  # same day again: the last wins
    )
    (f / "SWAP_data_data.csv").write_text(
        "Volume,Extra,Close,Low,High,Open,Date\n7,x,4,3,2,1,2024-01-05\n"
    )
    (f / "LACK_data.csv").write_text("Date,Open,High,Low,Close\n2024-01-01,1,1,1,1\n")
    (f / "JUNK_data.csv").write_text(HEAD + "never,1,1,1,1,1\n")
    (f / "EMPTY_data.csv").write_text("")
    (f / "OTHER.csv").write_text(HEAD + '2024-02-01,"1,000.5",1,1,1,"2,000"\n')
    (f / "notes.txt").write_text("not a csv")
    return str(f)


def rows(df):
    return sorted(
        (r.ticker, str(r.date), r.open, r.high, r.low, r.close, r.volume) for r in df.collect()
    )


GOOD = [
    ("GOOD", "2024-01-01", 1.0, 1.5, 0.5, 1.0, 10),
    ("GOOD", "2024-01-02", None, 2.0, 2.0, 2.0, 0),
    ("GOOD", "2024-01-03", 4.0, 4.0, 4.0, 4.0, 44),
]


def test_folder(spark, folder):
    load = csv_files.load_folder(spark, folder, ingest_seq=1)
    assert load.bars.columns == [f.name for f in spark.createDataFrame([], BARS).schema]
    assert rows(load.bars) == GOOD + [
        ("OTHER", "2024-02-01", None, 1.0, 1.0, 1.0, 0),
        ("SWAP", "2024-01-05", 1.0, 2.0, 3.0, 4.0, 7),
    ]
    status = {r.ticker: (r.status, r.rows) for r in load.files.collect()}
    assert status == {
        "GOOD": ("success", 4), "SWAP": ("success", 1), "OTHER": ("success", 1),
        "LACK": ("failed", 0), "JUNK": ("failed", 0), "EMPTY": ("failed", 0),
    }
    assert tuple(csv_files.load_stats(load.files).first())[:4] == (3, 3, 0, 6)


def test_folder_with_ticker_list_and_thousands(spark, folder):
    load = csv_files.load_folder(spark, folder, 1, only=["OTHER", "LACK"], thousands=True)
    assert rows(load.bars) == [("OTHER", "2024-02-01", 1000.5, 1.0, 1.0, 1.0, 2000)]
    assert tuple(csv_files.load_stats(load.files).first())[:4] == (1, 1, 4, 6)


@pytest.mark.parametrize("headers", [csv_files.MOST_HEADERS, 1, 0])
def test_folder_with_rare_headers(spark, folder, monkeypatch, headers):
    """Files beyond the headers that get scans of their own are read line by line, with equal results."""
    monkeypatch.setattr(csv_files, "MOST_HEADERS", headers)
    load = csv_files.load_folder(spark, folder, ingest_seq=1)
    assert rows(load.bars) == GOOD + [
        ("OTHER", "2024-02-01", None, 1.0, 1.0, 1.0, 0),
        ("SWAP", "2024-01-05", 1.0, 2.0, 3.0, 4.0, 7),
    ]
    assert tuple(csv_files.load_stats(load.files).first())[:4] == (3, 3, 0, 6)


def test_quoted_line_breaks_and_blank_lines(spark, tmp_path):
    (tmp_path / "N_data.csv").write_text(
        "\n" + 'Note,Date,Open,High,Low,Close,Volume\n"said\n""buy"", then\nsold",2024-01-05,1,2,0.5,1.5,10\n\nplain,2024-01-08,2,2,2,2,20\n'
    )
    (tmp_path / "P_data.csv").write_text("Note,Date,Open,High,Low,Close,Volume\nx,2024-01-05,1,1,1,1,1\n")
    load = csv_files.load_folder(spark, str(tmp_path), 1)
    assert rows(load.bars) == [
        ("N", "2024-01-05", 1.0, 2.0, 0.5, 1.5, 10), ("N", "2024-01-08", 2.0, 2.0, 2.0, 2.0, 20),
        ("P", "2024-01-05", 1.0, 1.0, 1.0, 1.0, 1),
    ]
    assert {r.ticker: r.rows for r in load.files.collect()} == {"N": 2, "P": 1}


@pytest.mark.parametrize("named", [csv_files.MOST_NAMED, 0])
def test_order_of_day_and_month_is_each_files_own(spark, tmp_path, monkeypatch, named):
    monkeypatch.setattr(csv_files, "MOST_NAMED", named)
    for name, days in {"D": ["25/01/2024", "05/02/2024"], "M": ["01/25/2024", "02/05/2024"], "H": ["05-02-2024"], "S": ["02/05/2024"]}.items():
        (tmp_path / f"{name}_data.csv").write_text(HEAD + "".join(f"{d},1,1,1,1,1\n" for d in days))
    got = csv_files.load_folder(spark, str(tmp_path), 1).bars
    assert sorted({(r.ticker, str(r.date)) for r in got.collect()}) == [
        ("D", "2024-01-25"), ("D", "2024-02-05"), ("H", "2024-02-05"), ("M", "2024-01-25"), ("M", "2024-02-05"), ("S", "2024-02-05"),
    ]


def test_odd_names_and_folders_of_parts(spark, tmp_path):
    plain, parted = tmp_path / "plain", tmp_path / "parted"
    plain.mkdir()
    for name in ("A[1]_data.csv", "B{x} %41+.csv", "C*d.csv"):
        (plain / name).write_text(HEAD + "2024-01-05,1,1,1,1,1\n")
        (parted / f"name={name}").mkdir(parents=True)
        (parted / f"name={name}" / "part-0.txt").write_text(HEAD + "2024-01-05,1,1,1,1,1\n")
    want = [(t, "2024-01-05", 1.0, 1.0, 1.0, 1.0, 1) for t in ("A[1]", "B{x} %41+", "C*d")]
    assert rows(csv_files.load_folder(spark, str(plain), 1).bars) == want
    assert rows(csv_files.load_folder(spark, str(plain), 1, only=["C*d"]).bars) == want[2:]
    assert rows(csv_files.load_folder(spark, str(parted), 1, folders=True).bars) == want


def test_lines_of_files_are_not_shuffled(spark, folder):
    """Before the grouping by ticker and day there is no exchange, and nothing but scans of CSV."""
    plan = csv_files.load_folder(spark, folder, 1).bars._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning(ticker") == plan.count("Exchange")
    assert "FileScan csv" in plan and "FileScan text" not in plan


@pytest.mark.parametrize("named", [csv_files.MOST_NAMED, 0])
def test_last_of_several_files_of_a_ticker(spark, tmp_path, monkeypatch, named):
    monkeypatch.setattr(csv_files, "MOST_NAMED", named)
    for k, name in enumerate(["A", "A_data", "A_data_data", "B"]):
        (tmp_path / f"{name}.csv").write_text(HEAD + f"2024-01-05,{k},,{k},,{k}\n2024-01-0{k + 1},9,9,9,9,9\n")
    want = [("A", "2024-01-01"), ("A", "2024-01-02"), ("A", "2024-01-03"), ("A", "2024-01-05"), ("B", "2024-01-04"), ("B", "2024-01-05")]
    for df in (csv_files.load_folder(spark, str(tmp_path), 1).bars, csv_files.read_uniform(spark, str(tmp_path), 1)):
        got = rows(df)
        assert [r[:2] for r in got] == want
        # all columns of the winner, missing ones too
        assert got[3][2:] == (2.0, None, 2.0, None, 2) and got[5][2:] == (3.0, None, 3.0, None, 3)


def test_no_file_can_be_used(spark, tmp_path):
    (tmp_path / "X.csv").write_text("a,b\n1,2\n")
    load = csv_files.load_folder(spark, str(tmp_path), 1)
    assert load.bars.collect() == [] and [(r.ticker, r.status) for r in load.files.collect()] == [("X", "failed")]
    none = csv_files.load_folder(spark, str(tmp_path), 1, only=["Y"])
    assert none.bars.collect() == [] and [r.status for r in none.files.collect()] == ["skipped"]


def test_uniform_reader(spark, folder):
    assert rows(csv_files.read_uniform(spark, folder + "/GOOD_data.csv", 1)) == GOOD
    named = csv_files.read_uniform(spark, folder + "/GOOD_data.csv", 1, ticker="Z")
    assert {r.ticker for r in named.collect()} == {"Z"}


def test_uniform_reader_refuses_another_column_order(spark, folder):
    with pytest.raises(Exception, match="(?i)header"):
        csv_files.read_uniform(spark, folder + "/SWAP_data_data.csv", 1).collect()


def test_split_file_keeps_the_last_row_of_a_day(spark, tmp_path):
    f = tmp_path / "big"
    f.mkdir()
    body = "".join(f"2024-01-{1 + i % 9:02d},{i},{i},{i},{i},{i}\n" for i in range(20_000))
    (f / "A_data.csv").write_text(HEAD + body)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        a = csv_files.load_folder(spark, str(f), 1).bars
        b = csv_files.read_uniform(spark, str(f), 1)
        want = sorted(19_999 - k for k in range(9))
        assert sorted(r.volume for r in a.collect()) == want
        assert sorted(r.volume for r in b.collect()) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_ticker_of(spark):
    names = {
        "file:/a/b/GP_data.csv": "GP", "file:/a/A%20B+C%25_data_data.csv": "A B+C%",
        "file:/a/x_data/X.csv.csv": "X.csv",
    }
    df = spark.createDataFrame([(k,) for k in names], "u STRING")
    assert {r.u: r.t for r in df.select("u", csv_files.ticker_of(F.col("u")).alias("t")).collect()} == names


def test_required_columns():
    assert missing_columns(["Date", "open", "High", "Low", "Close", "Volume"]) == ["Open"]


def vendor_b(spark, *recs):
    names = "DATE TRADING_CODE LTP HIGH LOW OPENP CLOSEP YCP TRADE VALUE_MN VOLUME".split()
    schema = ", ".join(f"{n} STRING" for n in names)
    return spark.createDataFrame(
        [(d, t, "999", "3", "1", "2", c, "0", "0", "0", v) for d, t, c, v in recs], schema
    )


def test_vendor_b(spark):
    df = vendor_b(
        spark, ("2024-01-02", "A", "2.5", "20"), ("2024-01-01", "A", "1.5", "10"),
        ("2024-01-01", "B", "5", "1"), ("nope", "B", "6", "1"),
    )
    got = vendors.vendor_b_bars(df, 3)
    # a bad date refuses the whole ticker
    assert rows(got) == [
        ("A", "2024-01-01", 2.0, 3.0, 1.0, 1.5, 10), ("A", "2024-01-02", 2.0, 3.0, 1.0, 2.5, 20),
    ]
    assert {(r.source, r.ingest_seq) for r in got.collect()} == {("stocksurferbd", 3)}


def test_vendor_a(spark):
    df = spark.createDataFrame(
        [(dt.date(2024, 1, 1), "A", 1.0, 2.0, 0.5, 1.5, "7")],
        "DATE DATE, Ticker STRING, OPEN DOUBLE, High DOUBLE, low DOUBLE, Close DOUBLE, Volume STRING",
    )
    assert rows(vendors.vendor_a_bars(df, 1)) == [("A", "2024-01-01", 1.0, 2.0, 0.5, 1.5, 7)]
    with pytest.raises(ValueError, match="Close"):
        vendors.vendor_a_bars(df.drop("Close"), 1)


def test_typed_deliveries_give_what_their_text_gives(spark):
    from volsignals.sources.cleaning import REQUIRED, parse

    inf, nan = float("inf"), float("nan")
    odd = [
        (dt.date(2024, 2, 29), 1.5, -0.0, nan, inf, 7), (None, 1e300, 1e-320, -inf, 2.675, -3),
        (dt.date(1, 1, 1), None, 0.1, 1e16, -1e7, 2**63 - 1), (dt.date(9999, 12, 31), 3.0, 1.0, 1.0, 1.0, None),
        (dt.date(1582, 10, 15), 5e-324, 123456.789, 1.7976931348623157e308, 9.0, 2**53 + 1),
    ]
    kinds = "Date DATE, Open DOUBLE, High DOUBLE, Low DOUBLE, Close DOUBLE, Volume BIGINT"
    df = spark.createDataFrame(odd, kinds)
    # years beyond four digits and before the first
    far = df.limit(1).withColumn("Date", F.explode(F.expr("array(make_date(10000,1,1), make_date(0,3,1), make_date(-1,1,1))")))
    df = df.unionByName(far.select(*df.columns)).withColumns({"Open": F.col("Volume"), "Volume": F.col("Volume")})
    more = df.withColumns({"Volume": F.col("Low"), "Close": F.col("High").cast("float"), "Open": F.lit(7).cast("int")})
    for typed in (df, more):
        text = typed.select(*[F.col(c).cast("string").alias(c) for c in REQUIRED])
        show = lambda x: sorted(repr(r) for r in x.withColumn("date", F.col("date").cast("string")).collect())
        assert show(parse(typed)) == show(parse(text))


def test_large_delivery_is_dealt_by_its_length(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "landed")
    day = F.date_add(F.lit(build.DAY0), (F.col("id") % 50).cast("int"))
    price = [F.col("id").cast("double").alias(c) for c in ("Open", "High", "Low", "Close")]
    spark.range(1000).select(
        F.concat(F.lit("T"), (F.col("id") % 7).cast("string")).alias("ticker"), day.alias("Date"), *price, F.col("id").alias("Volume")
    ).coalesce(1).write.parquet(path)
    whole = vendors.vendor_a_bars(spark.read.parquet(path), 1)
    monkeypatch.setattr(vendors, "TASK_ROWS", 100)
    dealt = vendors.vendor_a_bars(spark.read.parquet(path), 1)
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and ", 10), REPARTITION_BY_NUM" in plan
    assert whole.count() == 350 and sorted(whole.collect()) == sorted(dealt.collect())


def canonical(spark, *recs):
    return spark.createDataFrame(
        [(t, build.day(n), c, c, c, c, 1, s, q) for t, n, c, s, q in recs], BARS
    )


def test_upsert_replaces_appends_and_is_idempotent(spark):
    old = canonical(spark, ("A", 0, 1.0, "x", 1), ("A", 1, 2.0, "x", 1))
    new = canonical(spark, ("A", 1, 9.0, "y", 2), ("B", 0, 5.0, "y", 2))
    got = store.upsert(old, new)
    assert sorted((r.ticker, r.close, r.source) for r in got.collect()) == [
        ("A", 1.0, "x"), ("A", 9.0, "y"), ("B", 5.0, "y"),
    ]
    again = store.upsert(got, new)
    assert again.exceptAll(got).count() == 0 and again.count() == 3


def test_metadata_counts_the_batch(spark):
    old = spark.createDataFrame(
        [("A", NOW, "x", 100), ("C", NOW, "x", 7)], LOAD_META
    )
    batch = canonical(spark, ("A", 1, 9.0, "y", 2), ("B", 0, 5.0, "y", 2))
    got = {r.ticker: (r.data_source, r.record_count) for r in store.upsert_meta(old, batch, "y", NOW).collect()}
    assert got == {"A": ("y", 1), "B": ("y", 1), "C": ("x", 7)}


def test_reload_clears_even_without_a_file(spark):
    old = canonical(spark, ("A", 0, 1.0, "x", 1), ("B", 1, 2.0, "x", 1))
    assert [r.ticker for r in store.reload_ticker(old, "A", None).collect()] == ["B"]
    new = canonical(spark, ("A", 5, 7.0, "y", 2), ("B", 5, 7.0, "y", 2))
    got = store.reload_ticker(old, "A", new)
    assert sorted((r.ticker, r.close) for r in got.collect()) == [("A", 7.0), ("B", 2.0)]


def test_delete_and_keep_take_lists_and_tables(spark):
    b = canonical(spark, ("A", 0, 1.0, "x", 1), ("B", 0, 1.0, "x", 1))
    names = spark.createDataFrame([("A",), ("A",)], "ticker STRING")
    for sel in (["A"], names):
        assert [r.ticker for r in store.delete_tickers(b, sel).collect()] == ["B"]
        assert [r.ticker for r in store.keep_tickers(b, sel).collect()] == ["A"]


def test_high_water(spark):
    b = canonical(spark, ("A", 3, 1.0, "x", 1))
    inc = canonical(
        spark, ("A", 3, 1.0, "y", 2), ("A", 4, 1.0, "y", 2), ("A", 9, 1.0, "y", 2),
        ("NEW", 0, 1.0, "y", 2), ("NEW", 2, 1.0, "y", 2),
    )
    got = increments.past_high_water(b, inc, build.day(8), default_start=build.day(1))
    assert sorted((r.ticker, r.date) for r in got.collect()) == [
        ("A", build.day(4)), ("NEW", build.day(2)),
    ]
    assert got.columns == inc.columns
    assert increments.past_high_water(b, inc, build.day(3), build.day(5)).count() == 0


def test_range_has_both_ends(spark):
    inc = canonical(spark, *[("A", n, 1.0, "y", 2) for n in range(5)])
    assert increments.in_range(inc, build.day(1), build.day(3)).count() == 3


def test_delivery_stats(spark):
    want = spark.createDataFrame([(f"T{i:02d}",) for i in range(15)], "ticker STRING")
    inc = canonical(spark, ("T01", 0, 1.0, "y", 2), ("T01", 1, 1.0, "y", 2), ("ZZ", 1, 1.0, "y", 2))
    r = increments.delivery_stats(increments.delivery(want, inc)).first()
    assert (r.success, r.failed, r.total) == (1, 14, 15)
    assert r.failed_first == [f"T{i:02d}" for i in (0, *range(2, 11))]
    none = increments.delivery_stats(increments.delivery(want.filter("ticker = 'T01'"), inc)).first()
    assert (none.success, none.failed, none.failed_first) == (1, 0, [])


def test_load_and_delivery_plans(spark, folder):
    bars = canonical(spark, ("GOOD", -500, 1.0, "x", 0), ("KEEP", 0, 1.0, "x", 0))
    meta = spark.createDataFrame([("KEEP", NOW, "x", 1)], LOAD_META)
    u = load_csv_folder(spark, folder, bars, meta, 1, NOW)
    assert u.bars.count() == 2 + 5
    assert {r.ticker: r.record_count for r in u.meta.collect()} == {
        "KEEP": 1, "GOOD": 3, "SWAP": 1, "OTHER": 1,
    }
    d = vendors.vendor_b_bars(
        vendor_b(spark, ("2024-01-02", "KEEP", "2.5", "20"), ("2024-01-02", "STRANGE", "2.5", "20")), 2
    )
    v = apply_delivery(bars, meta, d, "stocksurferbd", NOW)
    assert sorted(r.ticker for r in v.bars.collect()) == ["GOOD", "KEEP", "KEEP"]
    assert v.stats.first().failed_first == ["GOOD"]


def test_fundamentals_file(spark, tmp_path):
    f = tmp_path / "caps.csv"
    f.write_text('ticker,paid_up_capital\nA,45.5\nB,"1,200"\nC,n/a\nA,46\n')
    got = {r.ticker: r.paid_up_capital for r in csv_files.read_fundamentals(spark, str(f)).collect()}
    assert got == {"A": 46.0, "B": 1200.0}


def test_table_on_disk(spark, tmp_path):
    path = str(tmp_path / "bars")
    assert snapshots.read_bars(spark, path).count() == 0
    a = canonical(spark, ("A", 0, 1.0, "x", 1), ("A", -10, 1.0, "x", 1), ("B", 400, 2.0, "x", 1))
    snapshots.merge_bars(spark, path, a)
    first = snapshots.snapshot(spark, path).parts
    snapshots.merge_bars(spark, path, canonical(spark, ("A", 0, 7.0, "y", 2), ("C", 1, 3.0, "y", 2)))
    got = sorted((r.ticker, r.date, r.close) for r in snapshots.read_bars(spark, path).collect())
    assert got == [
        ("A", build.day(-10), 1.0), ("A", build.day(0), 7.0), ("B", build.day(400), 2.0),
        ("C", build.day(1), 3.0),
    ]
    now = snapshots.snapshot(spark, path).parts
    assert {p: b for p, b in now.items() if p[0] == 2025} == {p: b for p, b in first.items() if p[0] == 2025} != {}  # untouched year kept
    snapshots.merge_bars(spark, path, a.filter("false"))
    assert snapshots.read_bars(spark, path).count() == 4


def test_lookups(spark):
    b = canonical(spark, *[("A", n, float(n), "x", 1) for n in range(5)], ("B", 9, None, "x", 1))
    assert [r.close for r in store.bars_range(b, "A", build.day(1), build.day(2)).collect()] == [1.0, 2.0]
    assert [r.ticker for r in store.tickers(b).collect()] == ["A", "B"]
    assert build.by(store.latest_date(b))["A"].latest_date == build.day(4)
    assert build.by(store.latest_close(b))["A"].close == 4.0
    s = store.table_stats(b).first()
    assert tuple(s) == (2, 6, f"{build.day(0)} to {build.day(9)}")
    assert tuple(store.table_stats(b.filter("false")).first()) == (0, 0, "No data")
    many = canonical(spark, *[(f"T{n:03d}", 0, 1.0, "x", 1) for n in range(60)])
    r = store.ticker_preview(many).first()
    assert (len(r["first"]), r["first"][0], r["more"]) == (50, "T000", 10)
    assert store.ticker_preview(b).first()["more"] == 0


def test_small_increment_does_not_shuffle_history(spark, tmp_path):
    path = str(tmp_path / "old")
    canonical(spark, *[("A", n, 1.0, "x", 1) for n in range(50)]).write.parquet(path)
    # a landed increment, whose size Spark knows; a local table counts as of unknown size
    inc = str(tmp_path / "inc")
    canonical(spark, ("A", 1, 9.0, "y", 2)).write.parquet(inc)
    new = spark.read.parquet(inc)
    p = store.upsert(spark.read.parquet(path), new)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in p
    history = p[p.index("LeftAnti") :]
    assert "Exchange" not in history[: history.index("BroadcastExchange")]


def test_large_increment_is_joined_by_sort_merge(spark, tmp_path):
    path = str(tmp_path / "old")
    canonical(spark, *[("A", n, 1.0, "x", 1) for n in range(50)]).write.parquet(path)
    old = spark.read.parquet(path)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        new = old.withColumn("close", F.col("close") + 1)
        got = store.upsert(old, new)
        assert "SortMergeJoin" in got._jdf.queryExecution().executedPlan().toString()
        assert got.exceptAll(new).count() == 0 and got.count() == 50
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def _pack(spark, folder, path):
    """The files of ``folder`` as packed rows, by the lines that a packer would read."""
    import glob
    import os

    lines = []
    for f in sorted(glob.glob(f"{folder}/*.csv")):
        with open(f, newline="") as h:
            lines += [(os.path.basename(f), k, x) for k, x in enumerate(h.read().splitlines() or [None])]
    csv_files.packed(spark.createDataFrame(lines, "name STRING, _row LONG, value STRING")).write.parquet(path)
    return path


@pytest.mark.parametrize("only", [None, ["GOOD", "LACK"]])
def test_packed_files_load_as_the_folder_does(spark, folder, tmp_path, only):
    (tmp_path / "csv" / "DMY_data.csv").write_text("\n" + HEAD + "13-02-2024,1,1,1,1,1\n01-02-2024,2,2,2,2,2\n")
    (tmp_path / "csv" / "MDY_data.csv").write_text(HEAD + "02-13-2024,1,1,1,1,1\n02-01-2024,2,2,2,2,2\n")
    (tmp_path / "csv" / "GOOD_data_data.csv").write_text(HEAD + "2024-01-01,8,8,8,8,8\n")
    path = _pack(spark, folder, str(tmp_path / "packed"))
    want, got = csv_files.load_folder(spark, folder, 1, only), csv_files.load_packed(spark, path, 1, only)
    assert got.bars.schema == want.bars.schema and rows(got.bars) == rows(want.bars)
    key = lambda load: sorted((r.file.rsplit("/", 1)[-1], *r[1:]) for r in load.files.collect())
    assert key(got) == key(want) and len(key(got)) == 9


def test_packed_uniform_files(spark, tmp_path):
    f = tmp_path / "csv"
    f.mkdir()
    (f / "A_data.csv").write_text(HEAD + '2024-01-01,"1,000.5",1,1,1,"2,000"\n2024-01-02,1,1,1,1,1\n2024-01-02,2,2,2,2,2\n')
    (f / "A_data_data.csv").write_text(HEAD + "2024-01-01,3,3,3,3,3\n")
    (f / "B.csv").write_text(HEAD + "2024-01-01,4,4,4,4,4\n")
    want = csv_files.read_uniform(spark, str(f), 1, thousands=True)
    got = csv_files.read_packed(spark, _pack(spark, str(f), str(tmp_path / "packed")), 1, thousands=True)
    assert rows(got) == rows(want) and len(rows(got)) == 3
    (f / "C.csv").write_text("Open,Date,High,Low,Close,Volume\n1,2024-01-01,1,1,1,1\n")
    with pytest.raises(Exception, match="unexpected header in C.csv"):
        csv_files.read_packed(spark, _pack(spark, str(f), str(tmp_path / "odd")), 1).collect()


@pytest.mark.parametrize("name", ["csv_lines", "csv_uniform", "stream_ingest"])
def test_landed_files_do_not_grow_with_tickers(spark, sf, name, monkeypatch, tmp_path):
    import glob

    from volsignals.plans import catalog

    monkeypatch.setattr(catalog, "shared_folder", lambda _: str(tmp_path))
    big = sf.replace("sf0.001", "sf0.01")
    catalog.queries()[name](spark, big)
    tickers = catalog.queries()["tickers"](spark, big).count()
    landed = [p for p in glob.glob(f"{tmp_path}/land*/**/*", recursive=True) if p.endswith((".parquet", ".csv", ".txt")) and "/table/" not in p]
    assert 0 < len(landed) <= 2 * 8 < tickers

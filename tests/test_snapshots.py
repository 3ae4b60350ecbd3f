"""The table on disk: snapshots, failures between write and swap, writers at once, the newest bars."""

import random

import pytest
from pyspark.sql import functions as F

import build
from volsignals.operators import increments, newest, snapshots, store
from volsignals.schema import BARS


def bars(spark, *rows):
    """(ticker, day number, close, batch)"""
    return spark.createDataFrame([(t, build.day(n), c, c, c, c, int(c), "x", q) for t, n, c, q in rows], BARS)


def content(df):
    return {(r.ticker, (r.date - build.DAY0).days): r.close for r in df.collect()}


def newest_as_computed(df):
    full = {}
    for r in store.last_bars(df, newest.KEPT).collect():
        full[r.ticker, r.back] = (r.date, r.close, r.volume)
    return full


def newest_as_kept(df):
    return {(r.ticker, r.back): (r.date, r.close, r.volume) for r in newest.newest_rows(df).collect()}


@pytest.fixture
def table(spark, tmp_path):
    path = str(tmp_path / "bars")
    snapshots.merge_bars(spark, path, bars(spark, ("A", 0, 1.0, 1), ("A", 400, 2.0, 1), ("B", 0, 3.0, 1)), buckets=4)
    return path


def test_a_failure_between_write_and_swap_leaves_the_old_table(spark, table, monkeypatch):
    before = content(snapshots.read_bars(spark, table))

    def lost(*_):
        raise KeyboardInterrupt("the driver is gone")

    with monkeypatch.context() as m:
        m.setattr(snapshots, "_swap", lost)
        with pytest.raises(KeyboardInterrupt):
            snapshots.merge_bars(spark, table, bars(spark, ("A", 0, 9.0, 2), ("C", 5, 9.0, 2)))
    assert snapshots.numbers(spark, table) == [1]
    assert content(snapshots.read_bars(spark, table)) == before
    assert newest_as_kept(snapshots.read_newest(spark, table)) == newest_as_computed(snapshots.read_bars(spark, table))
    # the batch is repeated
    assert snapshots.merge_bars(spark, table, bars(spark, ("A", 0, 9.0, 2), ("C", 5, 9.0, 2))) == 2
    assert content(snapshots.read_bars(spark, table)) == before | {("A", 0): 9.0, ("C", 5): 9.0}


def test_a_failed_write_leaves_the_old_table(spark, table):
    bad = bars(spark, ("A", 0, 9.0, 2), ("B", 0, 9.0, 2)).withColumn(
        "close", F.when(F.col("ticker") == "B", F.raise_error(F.lit("broken"))).otherwise(F.col("close")).cast("double")
    )
    before = content(snapshots.read_bars(spark, table))
    with pytest.raises(Exception, match="broken"):
        snapshots.merge_bars(spark, table, bad)
    assert content(snapshots.read_bars(spark, table)) == before


def test_the_writer_that_comes_second_starts_again(spark, table, monkeypatch):
    real, calls = snapshots._swap, []

    def swap(spark_, path, number, text):
        if not calls:
            calls.append(number)
            snapshots.merge_bars(spark, table, bars(spark, ("B", 0, 7.0, 2), ("Z", 1, 1.0, 2)))
        real(spark_, path, number, text)

    monkeypatch.setattr(snapshots, "_swap", swap)
    assert snapshots.merge_bars(spark, table, bars(spark, ("A", 0, 5.0, 2))) == 3
    want = {("A", 0): 5.0, ("A", 400): 2.0, ("B", 0): 7.0, ("Z", 1): 1.0}
    assert content(snapshots.read_bars(spark, table)) == want


def test_a_number_is_given_once(spark, table):
    with pytest.raises(snapshots.Taken):
        snapshots._swap(spark, table, 1, "{}")
    assert snapshots.snapshot(spark, table).number == 1 and content(snapshots.read_bars(spark, table))


def test_a_frame_keeps_its_snapshot(spark, table):
    old = snapshots.read_bars(spark, table)
    snapshots.merge_bars(spark, table, bars(spark, ("A", 0, 9.0, 2)))
    assert content(old)["A", 0] == 1.0
    assert content(snapshots.read_bars(spark, table))["A", 0] == 9.0
    assert content(snapshots.read_bars(spark, table, number=1)) == content(old)


def test_only_touched_parts_are_written_and_only_wanted_years_read(spark, table):
    first = snapshots.snapshot(spark, table)
    snapshots.merge_bars(spark, table, bars(spark, ("A", 400, 9.0, 2)))
    second = snapshots.snapshot(spark, table)
    changed = {p for p in second.parts if second.parts[p] != first.parts[p]}
    assert {y for y, _ in changed} == {2025} and len(changed) == 1
    plan = snapshots.read_bars(spark, table, years=[2025])
    assert content(plan) == {("A", 400): 9.0}
    assert all("year=2025" in f for f in plan.inputFiles())


def test_stream_batches_count_once(spark, table):
    merge = lambda c, n: snapshots.merge_bars(spark, table, bars(spark, ("A", 0, c, 2)), stream=("s", n))
    assert [merge(5.0, 0), merge(6.0, 0), merge(7.0, 1)] == [2, 2, 3]
    assert content(snapshots.read_bars(spark, table))["A", 0] == 7.0


def test_delete_and_replace(spark, table):
    snapshots.replace_bars(spark, table, ["A"], bars(spark, ("A", 1, 4.0, 2), ("A", 1, 5.0, 3), ("B", 9, 1.0, 2)))
    now = snapshots.read_bars(spark, table)
    assert content(now) == {("A", 1): 5.0, ("B", 0): 3.0}
    assert newest_as_kept(snapshots.read_newest(spark, table)) == newest_as_computed(now)
    snapshots.delete_bars(spark, table, ["B", "nobody"])
    assert content(snapshots.read_bars(spark, table)) == {("A", 1): 5.0}
    snapshots.delete_bars(spark, table, ["A"])
    assert content(snapshots.read_bars(spark, table)) == {} == newest_as_kept(snapshots.read_newest(spark, table))
    snapshots.merge_bars(spark, table, bars(spark, ("A", 2, 2.0, 4)))
    assert content(snapshots.read_bars(spark, table)) == {("A", 2): 2.0}


def test_expired_snapshots_go_and_others_stay(spark, table, tmp_path):
    for k in range(4):
        snapshots.merge_bars(spark, table, bars(spark, ("A", 0, float(k), 2), (f"N{k}", k, 1.0, 2)))
    want = {n: content(snapshots.read_bars(spark, table, number=n)) for n in (4, 5)}
    orphan = tmp_path / "bars" / "data" / "batch=left"
    orphan.mkdir()
    snapshots.expire(spark, table, keep=2)
    assert snapshots.numbers(spark, table) == [4, 5]
    assert {n: content(snapshots.read_bars(spark, table, number=n)) for n in (4, 5)} == want
    assert newest_as_kept(snapshots.read_newest(spark, table, 4))
    assert orphan.exists()
    snapshots.expire(spark, table, keep=1, orphans_after=-1)
    assert not orphan.exists()
    assert content(snapshots.read_bars(spark, table)) == want[5]
    live = set(snapshots.snapshot(spark, table).parts.values())
    assert {p.name.removeprefix("batch=") for p in (tmp_path / "bars" / "data").iterdir() if not p.name.startswith(".")} == live


def test_merges_equal_a_dictionary(spark, tmp_path):
    """New, replaced and late bars in random increments; the newest bars stay those of the whole table."""
    rng, path, want = random.Random(7), str(tmp_path / "t"), {}
    for batch in range(5):
        rows = [(rng.choice("ABCDE"), rng.randrange(60 * (batch + 1)), float(rng.randrange(1, 99)), batch) for _ in range(50)]
        snapshots.merge_bars(spark, path, bars(spark, *rows), buckets=2)
        for t, n, c, _ in sorted(rows, key=lambda r: r[2]):  # of one batch's rows for a day the largest counts
            want[t, n] = c
    table = snapshots.read_bars(spark, path)
    assert content(table) == want
    kept = snapshots.read_newest(spark, path)
    assert newest_as_kept(kept) == newest_as_computed(table)
    assert {r.ticker: r.latest_date for r in newest.newest_dates(kept).collect()} == {
        r.ticker: r.latest_date for r in store.latest_date(table).collect()
    }
    assert {tuple(r) for r in newest.newest_closes(kept).collect()} == {tuple(r) for r in store.latest_close(table).collect()}


def test_marks_come_without_history(spark, table):
    """A high-water update plans with the small table; its plan has no scan of bars on disk."""
    landed = bars(spark, ("A", 401, 5.0, 2), ("A", 3, 5.0, 2), ("B", 1, 5.0, 2))
    marks = newest.newest_dates(snapshots.read_newest(spark, table))
    fresh = increments.past_high_water(None, landed, build.day(500), marks=marks)
    assert content(fresh) == {("A", 401): 5.0, ("B", 1): 5.0}
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.splitlines() if "FileScan" in x]
    assert scans and all("bars:array" in x for x in scans)


def test_newest_of_missing_prices_and_nothing(spark):
    rows = bars(spark, ("A", 0, 1.0, 1), ("A", 1, 2.0, 1)).withColumn("close", F.when(F.col("close") < 2, F.col("close")))
    kept = newest.newest_of(rows)
    assert [tuple(r)[1] for r in newest.newest_closes(kept).collect()] == [None]
    none = kept.limit(0)
    assert newest.merge_newest(none, rows.limit(0)).collect() == []
    assert newest_as_kept(newest.merge_newest(none, rows)) == newest_as_computed(rows)


def test_old_and_new_rows_meet_once(spark, table):
    old = snapshots._stored(spark, table, snapshots.snapshot(spark, table))
    new = bars(spark, ("A", 0, 9.0, 2), ("B", 1, 4.0, 2), ("C", 5, 9.0, 2)).select("*", *snapshots._part(4))
    rows = snapshots._merged(old, new, 4).sortWithinPartitions("year", "bucket", "ticker", "date")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert content(rows) == {("A", 0): 9.0, ("A", 400): 2.0, ("B", 0): 3.0, ("B", 1): 4.0, ("C", 5): 9.0}


def test_unique_batches_merge_as_others_do_and_nothing_adds_nothing(spark, tmp_path):
    found = {}
    for unique in (False, True):
        path = str(tmp_path / str(unique))
        assert snapshots.merge_bars(spark, path, bars(spark, ("A", 0, 1.0, 1)).limit(0), unique=unique) == 0
        merge = lambda *rows: snapshots.merge_bars(spark, path, bars(spark, *rows), buckets=2, unique=unique)
        merge(*[(f"T{k}", n, float(k + n), 1) for k in range(40) for n in range(30)])
        merge(*[(f"T{k}", n, 99.0, 2) for k in range(0, 40, 3) for n in (3, 29, 400)])
        assert newest_as_kept(snapshots.read_newest(spark, path)) == newest_as_computed(snapshots.read_bars(spark, path))
        found[unique] = content(snapshots.read_bars(spark, path))
    assert found[True] == found[False] and len(found[True]) == 40 * 30 + 14

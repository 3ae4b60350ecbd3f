import os
import random

import pytest
from pyspark.sql import functions as F

import build
from volsignals.operators import positions as pos
from volsignals.operators import snapshots
from volsignals.sources import csv_files
from volsignals.sources import driver_tables as src
from volsignals.streaming.ingest import start_ingest
from volsignals.streaming import ratchet
from volsignals.streaming.ratchet import moving_peaks

HEAD = "Date,Open,High,Low,Close,Volume\n"


def land(folder, name, *rows, stamp):
    f = folder / name
    f.write_text(HEAD + "".join(f"{d},{c},{c},{c},{c},{v}\n" for d, c, v in rows))
    os.utime(f, (stamp, stamp))


def test_stream_equals_batch_and_takes_late_bars(spark, tmp_path):
    landing, table, ckpt = tmp_path / "in", str(tmp_path / "bars"), str(tmp_path / "ckpt")
    landing.mkdir()
    land(landing, "A_data.csv", ("2024-01-01", 1, 1), ("2024-01-02", 2, 2), stamp=1000)
    land(landing, "B_data.csv", ("2024-01-02", 5, 5), ("bad", 5, 5), stamp=1001)
    start_ingest(spark, str(landing), table, ckpt).awaitTermination()
    key = lambda df: sorted((r.ticker, str(r.date), r.close, r.volume) for r in df.collect())
    batch = csv_files.load_folder(spark, str(landing), 0).bars
    assert key(snapshots.read_bars(spark, table)) == key(batch)

    # a bar years older and a replacement arrive later; nothing is too late
    sub = landing / "A_data_data.csv"
    land(landing, sub.name, ("2019-06-03", 9, 9), ("2024-01-02", 7, 7), stamp=2000)
    start_ingest(spark, str(landing), table, ckpt).awaitTermination()
    want = [
        ("A", "2019-06-03", 9.0, 9), ("A", "2024-01-01", 1.0, 1), ("A", "2024-01-02", 7.0, 7),
        ("B", "2024-01-02", 5.0, 5),
    ]
    assert key(snapshots.read_bars(spark, table)) == want
    start_ingest(spark, str(landing), table, ckpt).awaitTermination()
    assert key(snapshots.read_bars(spark, table)) == want


def test_stream_in_small_batches(spark, tmp_path):
    landing, table = tmp_path / "in", str(tmp_path / "bars")
    landing.mkdir()
    for i in range(4):
        name = "A" + "_data" * (i + 1) + ".csv"
        land(landing, name, ("2024-01-01", i, i), (f"2024-02-0{i + 1}", i, i), stamp=1000 + i)
    start_ingest(spark, str(landing), table, str(tmp_path / "c"), max_files=1).awaitTermination()
    got = {str(r.date): r.close for r in snapshots.read_bars(spark, table).collect()}
    assert got == {"2024-01-01": 3.0, **{f"2024-02-0{i + 1}": float(i) for i in range(4)}}


def test_streaming_ratchet_equals_batch(spark, sf, tmp_path):
    b = src.bars(spark, sf).cache()
    held = src.positions(b).cache()
    want = {r.ticker: r.highest_seen for r in pos.ratcheted(held, b).collect()}
    static = {r.ticker: r.highest_seen for r in moving_peaks(b, held).collect()}
    assert static == want

    path = str(tmp_path / "bars")
    b.repartition(6, F.rand(5)).write.parquet(path)
    stream = spark.readStream.schema(b.schema).option("maxFilesPerTrigger", 2).parquet(path)
    seen: dict[str, float] = {}

    def collect(batch, _):
        for r in batch.collect():
            assert r.highest_seen >= seen.get(r.ticker, 0.0)
            seen[r.ticker] = r.highest_seen

    (
        moving_peaks(stream, held)
        .writeStream.outputMode("update")
        .foreachBatch(collect)
        .option("checkpointLocation", str(tmp_path / "ckpt"))
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    assert seen == want


def test_bought_again_begins_anew(spark):
    bars = build.bars(spark, *[("A", build.day(i), c, c, c, c, 1) for i, c in enumerate([10.0, 50.0, 20.0, 15.0])])
    first = build.positions(spark, ("A", 10.0, 1, 10.0, build.day(0)))
    again = build.positions(spark, ("A", 20.0, 1, 20.0, build.day(2)))
    assert [r.highest_seen for r in moving_peaks(bars, first).collect()] == [50.0]
    assert [r.highest_seen for r in moving_peaks(bars, again).collect()] == [20.0]
    # both purchases of a table that lists them, each with its own peak
    both = moving_peaks(bars, first.unionByName(again)).collect()
    assert sorted(r.highest_seen for r in both) == [20.0, 50.0]


def _events(spark, *rows):
    day = lambda n: None if n is None else build.day(n)
    return spark.createDataFrame([(t, k, day(n), p, s) for t, k, n, p, s in rows], ratchet.EVENTS)


def _run(spark, tmp_path, batches):
    """Batches of events as files that land one after another; a new query goes on from the checkpoint."""
    landing = tmp_path / "events"
    for k, rows in enumerate(batches):
        _events(spark, *rows).coalesce(1).write.mode("append").parquet(str(landing))
        stream = spark.readStream.schema(ratchet.EVENTS).parquet(str(landing))
        out = ratchet.follow(stream, str(tmp_path / "out"), str(tmp_path / "ckpt"))
        yield {r.ticker: (r.held, r.highest_seen) for r in out.collect()}


def test_ratchet_takes_bars_back_and_starts_again(spark, tmp_path):
    steps = _run(spark, tmp_path, [
        [("A", "buy", 1, 11.0, 1), ("A", "bar", 0, 99.0, 1), ("A", "bar", 1, 12.0, 1), ("A", "bar", 2, 80.0, 1), ("B", "bar", 1, 5.0, 1)],
        [("A", "bar", 2, 18.0, 2)],  # the peak was a mistake
        [("A", "sell", None, None, 3), ("B", "buy", 0, 1.0, 3)],
        [("A", "buy", 2, 2.0, 4), ("A", "bar", 3, 3.0, 4), ("A", "bar", 2, 77.0, 1)],  # a stale copy of a corrected bar
    ])
    assert next(steps) == {"A": (True, 80.0), "B": (False, None)}
    assert next(steps) == {"A": (True, 18.0), "B": (False, None)}
    assert next(steps) == {"A": (False, None), "B": (True, 5.0)}
    assert next(steps) == {"A": (True, 18.0), "B": (True, 5.0)}


def test_ratchet_equals_batch_in_any_order(spark, tmp_path):
    """Random bars, corrections and trades, dealt to batches at random: the stream ends as W11 does."""
    rng = random.Random(3)
    seq, rows = iter(range(1, 10_000)), []
    bars, trades = {}, {}
    for _ in range(400):
        t, n, s = rng.choice("ABCDEFGH"), rng.randrange(40), next(seq)
        if rng.random() < 0.85:
            c = float(rng.randrange(1, 500))
            rows.append((t, "bar", n, c, s))
            bars[t, n] = c
        elif rng.random() < 0.7:
            rows.append((t, "buy", n, float(rng.randrange(1, 100)), s))
            trades[t] = rows[-1]
        else:
            rows.append((t, "sell", None, None, s))
            trades[t] = rows[-1]
    held = [x for x in trades.values() if x[1] == "buy"]
    table = build.bars(spark, *[(t, build.day(n), c, c, c, c, 1) for (t, n), c in bars.items()])
    positions = build.positions(spark, *[(t, 1.0, 1, p, build.day(n)) for t, _, n, p, _ in held])
    want = {r.ticker: r.highest_seen for r in pos.ratcheted(positions, table).collect()}
    assert len(want) > 2
    rng.shuffle(rows)
    *_, end = _run(spark, tmp_path, [rows[i::3] for i in range(3)])
    assert {t: peak for t, (is_held, peak) in end.items() if is_held} == want

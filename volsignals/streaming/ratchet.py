"""The position ratchet over a stream of bars and trades.

``moving_peaks`` joins a stream of bars with a table of positions and keeps a built-in streaming
maximum for each purchase: it stays in the JVM, and a ticker that is sold and bought again begins
anew. It cannot take a bar back. ``moving_ratchet`` can: bars, purchases and sales arrive as events
of one stream, and the state of a ticker holds its last trade and the last close of each day, so
that its result is that of the batch ratchet over everything that has arrived, corrected bars,
late ones and trades in any order included.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Events: kind is ``bar`` (date, price is the close), ``buy`` (date of purchase, price is the peak to
#: begin with) or ``sell``. Of several bars of a day, and of a ticker's trades, the highest seq counts.
EVENTS = "ticker STRING, kind STRING, date DATE, price DOUBLE, seq BIGINT"
PEAKS = "ticker STRING, held BOOLEAN, purchase_date DATE, highest_seen DOUBLE, date DATE"
_STATE = "days ARRAY<DATE>, closes ARRAY<DOUBLE>, seqs ARRAY<BIGINT>, held BOOLEAN, bought DATE, seed DOUBLE, trade BIGINT"


def moving_peaks(bars: DataFrame, positions: DataFrame) -> DataFrame:
    """``ticker, highest_seen, date``: the peak of each held ticker, for a streaming ``bars``
    in update mode. On a static table it equals the batch ratchet."""
    held = positions.select(
        "ticker", "purchase_date", F.col("highest_seen").alias("_seed")
    )
    return (
        bars.select("ticker", "date", "close")
        .join(held, "ticker")
        .filter(F.col("date") >= F.col("purchase_date"))
        .groupBy("ticker", "purchase_date", "_seed")
        .agg(F.max("close").alias("_peak"), F.max("date").alias("date"))
        .select("ticker", F.greatest("_seed", "_peak").alias("highest_seen"), "date")
    )


def bar_events(bars: DataFrame, seq: str = "ingest_seq") -> DataFrame:
    return bars.select("ticker", F.lit("bar").alias("kind"), "date", F.col("close").alias("price"), F.col(seq).cast("bigint").alias("seq"))


def buy_events(positions: DataFrame, seq: str = "seq") -> DataFrame:
    return positions.select(
        "ticker", F.lit("buy").alias("kind"), F.col("purchase_date").alias("date"), F.col("highest_seen").alias("price"),
        F.col(seq).cast("bigint").alias("seq"),
    )


def sell_events(sold: DataFrame, seq: str = "seq") -> DataFrame:
    none = lambda kind: F.lit(None).cast(kind)
    return sold.select("ticker", F.lit("sell").alias("kind"), none("date").alias("date"), none("double").alias("price"), F.col(seq).cast("bigint").alias("seq"))


def _advance(key: tuple, events: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """One ticker's events of a batch: the state after them, and its peak now."""
    if state.exists:
        days, closes, seqs, held, bought, seed, trade = state.get
        known = {d: (s, c) for d, c, s in zip(days, closes, seqs, strict=True)}
    else:
        known, held, bought, seed, trade = {}, False, None, None, None
    for part in events:
        for kind, day, price, seq in zip(part["kind"], part["date"], part["price"], part["seq"], strict=True):
            seq = int(seq) if pd.notna(seq) else 0
            price = float(price) if pd.notna(price) else None
            if kind == "bar":
                if pd.notna(day) and (day not in known or seq >= known[day][0]):
                    known[day] = seq, price
            elif trade is None or seq >= trade:
                held, trade = kind == "buy", seq
                bought, seed = (day if pd.notna(day) else None, price) if held else (None, None)
    order = sorted(known)
    state.update((order, [known[d][1] for d in order], [known[d][0] for d in order], held, bought, seed, trade))
    since = [(d, known[d][1]) for d in order if held and bought is not None and d >= bought]
    prices = [c for _, c in since if c is not None] + ([seed] if seed is not None else [])
    yield pd.DataFrame({
        "ticker": [key[0]], "held": [held], "purchase_date": [bought], "highest_seen": [max(prices, default=None)],
        "date": [since[-1][0] if since else None],
    })


def moving_ratchet(events: DataFrame) -> DataFrame:
    """The position of every ticker that had an event, with its peak: ``PEAKS``, in update mode.

    ``events`` as in ``EVENTS``. The state of a ticker is one close a day, which bounds it by the
    calendar whatever the number of its events, and is kept by Spark's state store in the
    checkpoint folder. A bar without a close replaces an earlier one of its day but moves no peak; a
    purchase without a date has no bars. Tickers that are not held come with ``held`` false.
    """
    return events.filter("ticker IS NOT NULL").groupBy("ticker").applyInPandasWithState(
        _advance, PEAKS, _STATE, "Update", "NoTimeout"
    )


def follow(events: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """Run the stream of ``events`` over all that is there and return the last row of each ticker.

    Every batch's rows are written under ``folder`` by batch number, so that a repeated batch
    replaces its own rows.
    """
    spark = events.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    query = (
        moving_ratchet(events).writeStream.outputMode("update").foreachBatch(keep)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    rows = spark.read.schema(PEAKS + ", batch INT").option("basePath", folder).parquet(folder)
    rest = [c for c in rows.columns if c not in ("ticker", "batch")]
    # one row of a ticker in a batch, so that a fixed-width number picks its row
    last = rows.groupBy("ticker").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["ticker", "batch"]).select("ticker", *rest)

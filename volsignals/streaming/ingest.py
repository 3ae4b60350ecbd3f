"""Bars from a folder that fills up over time.

No watermark: a late bar of any age replaces its key. Every batch is one snapshot of the table, which
also notes its number: a driver that is lost leaves the snapshot before, and a batch that is
repeated after its commit is not merged again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from volsignals.operators.snapshots import BUCKETS, merge_bars
from volsignals.sources.cleaning import canonical, parse
from volsignals.sources.csv_files import PACKED, TEXT_SCHEMA, file_name, folder_name, packed_fields, ticker_of
from volsignals.texts import CSV_SOURCE


def landing_rows(
    spark: SparkSession, folder: str, max_files: int | None = None, folders: bool = False, packed: bool = False
) -> DataFrame:
    """Stream of parsed rows of new files with the standard header; with ``folders`` each lies in a
    folder of its own name, as a partitioned writer leaves it; with ``packed`` many are one (``PACKED``)."""
    name = folder_name if folders else file_name
    reader = spark.readStream
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if packed:
        lines = reader.schema(PACKED).parquet(folder)
        return parse(packed_fields(lines.withColumn("_landed", F.col("_metadata.file_modification_time"))))
    reader = reader.schema(TEXT_SCHEMA).options(header=True, enforceSchema=False)
    raw = reader.csv(f"{folder}/*.csv" if folders else folder).select(
        "*",
        ticker_of(name(F.col("_metadata.file_path"))).alias("ticker"),
        F.col("_metadata.file_modification_time").alias("_landed"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.lit(None).cast("bigint").alias("_row"),
    )
    return parse(raw)


def start_ingest(
    spark: SparkSession,
    folder: str,
    table_path: str,
    checkpoint: str,
    source: str = CSV_SOURCE,
    max_files: int | None = None,
    buckets: int = BUCKETS,
    folders: bool = False,
    packed: bool = False,
) -> StreamingQuery:
    """Merge everything that has landed into the table at ``table_path`` and stop. The stream's name in the
    table is its checkpoint folder."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        # a packed line knows its place
        rows = batch.withColumn("_row", F.coalesce("_row", F.monotonically_increasing_id()))
        order = F.struct("_landed", "_file", "_block", "_row")
        bars = canonical(rows, source, batch_id, order)
        merge_bars(batch.sparkSession, table_path, bars, buckets, (checkpoint, batch_id), unique=True)

    return (
        landing_rows(spark, folder, max_files, folders, packed)
        .writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )

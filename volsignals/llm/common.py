"""What the corpus operators share: tables, tables written to cut lineage, text buffers."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from volsignals.session import shared_folder

#: Bytes of text that one step of a numpy kernel works on, unless one text alone is longer.
SLICE_BYTES = 1 << 20


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers, once per application, as ``--py-files`` would."""
    sc = spark.sparkContext
    if getattr(sc, "_volsignals_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="volsignals-code-"), "volsignals.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(path)
    sc._volsignals_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write to the folder all executors share and read again: computed once, lineage cut.

    Parquet rather than ``checkpoint()``: compressed, and later readers prune columns.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a ``stored`` table that nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def vocabulary(name: str) -> str:
    """Where the public tokenizer files lie; the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Rows of a membership bitmap; each has 64 bits. A broadcast of it is 2 MB whatever the input.
BITMAP_ROWS = 1 << 17


def maybe_in(rows: DataFrame, key: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` split by a bitmap of the hashes of ``wanted``'s keys: perhaps in it, surely not.

    Saves rows that a join would shuffle in vain; the join itself still decides. ``key`` is a
    long column of both, not null.
    """
    h = F.xxhash64(F.col(key), F.lit(7))
    row, bit = F.pmod(h, F.lit(BITMAP_ROWS)), F.pmod(F.shiftright(h, 40), F.lit(64))
    # powers of two by bit: the shift takes no column
    power = F.element_at(F.array(*[F.lit(1 << i if i < 63 else -(1 << 63)) for i in range(64)]), (bit + 1).cast("int"))
    bits = stored(
        wanted.groupBy(row.alias("_row")).agg(F.bit_or(power).alias("_bits")), "bitmap"
    )
    seen = rows.join(F.broadcast(bits), row == F.col("_row"), "left").withColumn(
        "_maybe", F.coalesce(F.getbit(F.coalesce("_bits", F.lit(0).cast("long")), bit.cast("int")) == 1, F.lit(False))
    )
    return (
        seen.filter("_maybe").drop("_row", "_bits", "_maybe"),
        seen.filter("NOT _maybe").drop("_row", "_bits", "_maybe"),
    )


def release(spark: SparkSession) -> None:
    """Let the driver collect garbage, upon which Spark deletes shuffle files of finished plans."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def width(spark: SparkSession, least: int = 1) -> int:
    """Partitions for explicit shuffles: the session's setting, so that it grows with the cluster."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def whole_text(text: str | Column = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def text_key(text: str | Column = "text") -> Column:
    """Identity of a text: 128 bits of its SHA-256. Null counts as empty."""
    return F.substring(F.sha2(whole_text(text), 256), 1, 32)


def row_slices(batch: pa.RecordBatch, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Runs of rows with up to ``SLICE_BYTES`` of text."""
    n = batch.num_rows
    if not n:
        return
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0)))
    start = 0
    while start < n:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a column one after another, and where each begins and ends."""
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1]
    offsets = offsets.astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]

"""Session settings and the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "volsignals", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; ``conf`` keys use ``__`` for dots."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session without the setting gets a folder of its own, set for the session; on a
    cluster a machine-local folder would be lost with the machine, so there it is an error.
    """
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if shared is None:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="volsignals-checkpoint-")
        sc.setCheckpointDir(shared)
        shared = sc.getCheckpointDir()
    return shared.rstrip("/")


def written(df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, its lineage cut.

    For what several steps read and no step may compute twice. A lost executor costs tasks that
    read the table, not the work that made it. ``by`` names a column of few values, of which steps
    read one each: every value gets a folder.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.partitionBy(*([by] if by else [])).parquet(path)
    return spark.read.schema(df.schema).parquet(path)

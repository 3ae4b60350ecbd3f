"""The corpus pipeline: raw documents to packed sequences, stage by stage.

Every stage takes (spark, docs, sf_dir), works on all that the one before it kept, and is written
and read again before the next. All but the last return the columns of ``documents``. Columns
that a stage does not know pass through; nulls, empty tables and repeated rows are as defined in
the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volsignals.llm import line_dedup, mixing, near_dedup, packing, quality
from volsignals.llm.common import ship, stored, table, vocabulary


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    ship(spark)
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.kept(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go; a document of which nothing is left goes too."""
    ship(spark)
    # under names of their own, so that columns called as the operator calls its own stay as they are
    others = {c: f"_kept{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    out = line_dedup.deduplicate(docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(k) for c, k in others.items()]))
    emptied = (F.col("n_removed") > 0) & (F.trim(F.col("text")) == "")
    out = out.filter(~F.coalesce(emptied, F.lit(False)))
    if "n_chars" in others:
        # what was removed changes the length; other lengths stay as given
        own = others["n_chars"]
        n_chars = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col(own))
        out = out.withColumn(own, n_chars.cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(others.get(c, c)).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    ship(spark)
    return near_dedup.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources get their target weights: a document comes as often as the mix takes it."""
    ship(spark)
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their sequence and place in it."""
    ship(spark)
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_repeated_lines),
    ("MinHash near-dedup", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: A fitted model and tokenizer ids are beyond SQL; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

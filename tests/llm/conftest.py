from __future__ import annotations

import pytest

from volsignals.llm.common import ship


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="session")
def texts(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()
    return sorted(((r.doc_id, r.text or "", r.source) for r in rows))


def docs(spark, *rows):
    """(doc_id, text) or (doc_id, text, source) rows, with columns of clashing names."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "s", "x", 7, 1.5) for r in rows]
    return spark.createDataFrame(
        full, "doc_id LONG, text STRING, source STRING, key STRING, size INT, score DOUBLE"
    )

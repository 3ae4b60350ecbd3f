"""The pipeline's stages against what their operators promise, each on its own input."""

from __future__ import annotations

import collections

import corpus_pipeline
import numpy as np
import pytest
from test_brute import _links

from volsignals.llm import quality
from volsignals.llm.common import stored, table


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    names, columns = [n for n, _ in corpus_pipeline.STAGES], docs.columns
    assert len(names) == 5
    inputs = {}
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = docs
        docs = stored(stage(spark, docs, sf), "test-stage")
        if name != names[-1]:
            assert docs.columns == columns
            assert [f.dataType for f in docs.schema] == [f.dataType for f in inputs[names[0]].schema]
    ids = lambda df: collections.Counter(r[0] for r in df.select("doc_id").collect())

    good = ids(inputs[names[1]])
    labels = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    assert np.mean([good[d] == 1 for d, q in labels.items() if q == 1]) > 0.97
    assert np.mean([good[d] == 0 for d, q in labels.items() if q == 0]) > 0.9
    assert quality.KEEP_FROM == 0.3

    rows = [(r.doc_id, r.text, r.source) for r in inputs[names[2]].orderBy("doc_id").collect()]
    kept = ids(inputs[names[3]])
    for a, b in _links(rows):
        assert kept[rows[a][0]] + kept[rows[b][0]] <= 1
    assert not _links([r for r in rows if kept[r[0]]])

    taken = ids(inputs[names[4]])
    assert set(taken) <= set(kept) and max(taken.values()) <= 3
    packed = docs.filter("piece = 0").groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in packed} == taken


FIELDS = "doc_id LONG, text STRING, source STRING, n_lines INT, n_removed STRING, score DOUBLE, `a.b` STRING, size STRING, row STRING"
RUN = "\n".join(f"a line with some words in it number {k}" for k in range(4))


def _odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, names that operators use; no n_chars."""
    long = "\n".join(f"word{i} and others, that go on." for i in range(9000))
    rows = [
        (1, None, "s"), (2, "", None), (3, "  \n\n", "s"), (4, long, "s"), (5, RUN, "t"), (6, "before\n" + RUN, "t"), (6, "before\n" + RUN, "t"),
        (None, "one two three four five six seven", None), (7, RUN + "\nafter it comes more", "u"), (8, "x", "s"), (8, "y", "s"),
    ]
    return spark.createDataFrame([(*r, i, f"r{i}", None if i % 2 else 0.5, "dot", None, "z") for i, r in enumerate(rows)], FIELDS)


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stage_on_odd_rows(spark, sf, stage):
    docs = _odd(spark)
    rows = docs.collect()
    out = stage[1](spark, docs, sf)
    got = out.collect()
    last = stage[0] == corpus_pipeline.STAGES[-1][0]
    if last:
        # every row is packed once: its pieces begin at 0 and have ids
        assert collections.Counter(r.doc_id for r in got if r.piece == 0) == collections.Counter(r.doc_id for r in rows)
        return
    assert out.columns == docs.columns and out.schema == docs.schema
    own = {r["n_removed"]: r for r in rows}  # every row has a number of its own there
    for r in got:
        was = own[r["n_removed"]]
        assert [r[c] for c in docs.columns if c != "text"] == [was[c] for c in docs.columns if c != "text"]
        assert r.text == was.text or stage[0] == "line dedup"
    times = collections.Counter(r["n_removed"] for r in got)
    if stage[0] == "line dedup":
        left = {r["n_removed"]: r.text for r in got}
        assert left["r4"] == RUN and left["r5"] == "before" and left["r8"] == "after it comes more" and left["r0"] is None
        assert max(times.values()) == 1
    elif stage[0] == "MinHash near-dedup":
        assert max(times.values()) == 1 and {"r3", "r7"} <= set(times) and len({"r4", "r5", "r6"} & set(times)) == 1
    elif stage[0].startswith("mixing"):
        assert max(times.values()) <= 3


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stage_on_an_empty_table(spark, sf, stage):
    assert stage[1](spark, _odd(spark).limit(0), sf).collect() == []


def test_lengths_follow_the_texts(spark, sf):
    docs = spark.createDataFrame([(1, RUN, 150), (2, "mine\n" + RUN, 999), (3, "short", -1)], "doc_id LONG, text STRING, n_chars INT")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.drop_repeated_lines(spark, docs, sf).collect()}
    assert got == {1: (RUN, 150), 2: ("mine", 4), 3: ("short", -1)}

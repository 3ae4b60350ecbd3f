"""Every operator over nulls, empty and very long texts, ties, repeated rows and empty tables."""

from __future__ import annotations

import pytest
from conftest import docs  # noqa: F401  (tests/llm/conftest.py comes first on the path)

from volsignals.llm import (
    embeddings, fingerprints, licenses, line_dedup, mixing, near_dedup, packing, quality, substring_dedup,
    token_counts,
)
from volsignals.llm.common import vocabulary

LONG = " ".join(f"w{i}" for i in range(30_000))
ROWS = [
    (1, None), (2, ""), (3, "   \n\n "), (4, LONG), (5, "one two three"), (5, "one two three"), (5, "other"),
    (None, "one two three four five six seven eight nine ten eleven"), (6, "é" * 500), (7, "a" * 900, None),
    (8, "<|endoftext|> don't it's İ ﬁ \u0000 end"), (9, "under the MIT License. CC BY-NC"),
]


def no_labels(spark):
    return spark.createDataFrame([], "doc_id LONG, quality INT")


WORDS = vocabulary("word_bpe_49k.json")
RANKS = vocabulary("byte_bpe_50k.tiktoken")
OPERATORS = {
    "pack": lambda s, d: packing.pack(d, WORDS),
    "tokens": lambda s, d: token_counts.attribute(d, RANKS),
    "mix": lambda s, d: mixing.mix(d),
    "mixed": lambda s, d: mixing.mixed_documents(d),
    "near": lambda s, d: near_dedup.near_classes(d),
    "one_of_each": lambda s, d: near_dedup.one_of_each(d),
    "prints": lambda s, d: fingerprints.edited_neighbours(d),
    "print": lambda s, d: fingerprints.fingerprint(d),
    "quality": lambda s, d: quality.classify(d, no_labels(s)),
    "licenses": lambda s, d: licenses.scan(d),
    "lines": lambda s, d: line_dedup.deduplicate(d),
    "bytes": lambda s, d: substring_dedup.without_repeats(d),
}
ONE_EACH = {"mix", "near", "prints", "print", "quality", "licenses", "lines", "bytes"}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    out = OPERATORS[name](spark, docs(spark, *ROWS)).collect()
    if name in ONE_EACH:
        key = lambda x: (x is None, x or 0)
        assert sorted((r.doc_id for r in out), key=key) == sorted((r[0] for r in ROWS), key=key)
    else:
        assert out


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, docs(spark).limit(0)).collect() == []


def test_columns_that_clash_stay(spark):
    d = docs(spark, (1, "a b c"), (2, "a b c"), (3, "d e f"))
    assert near_dedup.one_of_each(d).columns == d.columns
    assert mixing.mixed_documents(d).columns == d.columns
    kept = quality.kept(d, quality.RuleModel([], [], 0.0))
    assert [tuple(r) for r in kept.orderBy("doc_id").collect()] == [tuple(r) for r in d.orderBy("doc_id").collect()]
    assert line_dedup.deduplicate(d).columns == [*d.columns, "n_lines", "n_removed"]


def test_embeddings_edges(spark):
    v = [1.0] + [0.0] * 7
    rows = [
        (1, v), (2, v), (2, v), (3, None), (4, [0.0] * 8), (5, [float("nan")] + v[1:]), (6, [None] + v[1:]),
        (None, v), (7, [float("inf")] + v[1:]), (8, [0.0, 1.0] + [0.0] * 6), (9, [1.0]),
    ]
    got = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<DOUBLE>")).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id) for r in got if r.n_links) == [
        (0, 3, 1), (1, 3, 1), (2, 3, 1), (2, 3, 1),
    ]
    assert {r.vec_id: (r.component_id, r.kept) for r in got if not r.n_links} == {
        k: (k, True) for k in (3, 4, 5, 6, 7, 8, 9)
    }
    none = spark.createDataFrame([], "vec_id LONG, embedding ARRAY<DOUBLE>")
    assert embeddings.near_vectors(none).collect() == []

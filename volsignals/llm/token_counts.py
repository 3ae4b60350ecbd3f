"""Token counts of sections by offset-mapped attribution.

A document is encoded once, as a whole. The bytes of its tokens, one after another, are its text,
so running sums of their lengths are the tokens' spans; these are joined to the sections' spans by
search in the sorted section starts. Section counts of a document add up to its own count.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from volsignals.llm.common import row_slices, utf8, whole_text

#: Which section gets a token that crosses a boundary: that of its first byte, or of its last.
RULES = ("first", "last")

_loaded: dict[str, tuple] = {}


def _encoder(path: str):
    """The encoding of a rank file and the length in bytes of each token."""
    if path not in _loaded:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            lengths[rank] = len(token)
        encoding = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        _loaded[path] = encoding, lengths
    return _loaded[path]


def section_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each sentence or line and their number per text.

    A section ends after a line feed, or after a space that follows a full stop, an exclamation
    mark or a question mark. An empty text has one empty section.
    """
    ends = data == 10
    ends[1:] |= (data[1:] == 32) & np.isin(data[:-1], np.frombuffer(b".!?", np.uint8))
    # what ends or begins a text opens no further section
    begins = np.setdiff1d(np.flatnonzero(ends) + 1, offsets)
    texts = np.concatenate([np.searchsorted(offsets[1:], begins, side="right"), np.arange(len(offsets) - 1)])
    starts = np.concatenate([begins, offsets[:-1]])
    order = np.lexsort((starts, texts))
    return starts[order], np.bincount(texts, minlength=len(offsets) - 1)


def attribute(docs: DataFrame, vocabulary: str, rule: str = "last") -> DataFrame:
    """Tokens of each sentence of each row of ``docs`` (doc_id, text); see ``section_starts``.

    A token that crosses a boundary, such as a space with the word after it, goes by ``rule``.

    Returns doc_id, section (from 0), start and end (code points), tokens, crossing (tokens that
    begin here and end further on), doc_tokens. Null and empty texts are one section of 0 tokens;
    repeated rows give their sections each; an empty table gives an empty table; other columns are
    left out.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, lengths = _encoder(vocabulary)
        for batch in batches:
            for part in row_slices(batch):
                data, offsets = utf8(part.column("text"))
                lists = [encoding.encode_ordinary(t) for t in part.column("text").to_pylist()]
                counts = np.array([len(x) for x in lists], np.int64)
                size = lengths[np.fromiter((i for x in lists for i in x), np.int64, counts.sum())]
                token_end = np.cumsum(size)
                token_start = token_end - size
                if len(size) and token_end[-1] != len(data):
                    raise ValueError("tokens do not spell the text")
                starts, sections = section_starts(data, offsets)
                text = np.repeat(np.arange(len(sections)), sections)
                ends = np.concatenate([starts[1:], [len(data)]])
                # of equal starts, as of empty texts, the last one holds the bytes
                by_start = np.searchsorted(starts, token_start, side="right") - 1
                by_last = np.searchsorted(starts, token_end - 1, side="right") - 1
                n = len(starts)
                tokens = np.bincount(by_start if rule == "first" else by_last, minlength=n)
                crossing = np.bincount(by_start[by_start != by_last], minlength=n)
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                origin = points[offsets[:-1]][text]
                first = np.cumsum(sections) - sections
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(text)),
                        pa.array(np.arange(n) - first[text], pa.int32()),
                        pa.array(points[starts] - origin, pa.int64()),
                        pa.array(points[ends] - origin, pa.int64()),
                        pa.array(tokens, pa.int64()), pa.array(crossing, pa.int64()),
                        pa.array(counts[text], pa.int64()),
                    ],
                    names=["doc_id", "section", "start", "end", "tokens", "crossing", "doc_tokens"],
                )

    schema = f"doc_id {kind}, section int, start long, end long, tokens long, crossing long, doc_tokens long"
    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, schema)

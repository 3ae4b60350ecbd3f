"""Personal data: patterns, and a character-level bidirectional LSTM with CRF transitions.

The tagger learns on the driver, in numpy, from spans labelled by the patterns in a bounded sample
of windows and from other spellings of them (a phone number without its plus, a card number with
dots, an address with spaces). Tasks cut every text into overlapping windows, decode them in blocks
and reconcile the results over the whole text: runs that windows share are joined, what a kind's
own test rejects goes, and of spans that overlap the disjoint ones of the largest total stay. The
patterns' spans always stay.

A span needs an at sign or a digit, so windows without any cannot add one and are not decoded.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from volsignals.llm import bilstm
from volsignals.llm.common import row_slices, whole_text

KINDS = ("email", "ip", "card", "phone")
#: Characters of a window and from one window to the next.
WINDOW, STRIDE = 128, 64
#: Windows that the tagger learns from, those with the smallest hash, and documents they come from.
SAMPLE, SAMPLE_DOCS = 3000, 3000
#: Windows decoded at once.
BLOCK = 256
#: Mean certainty from which on a span of the tagger counts.
SURE = 0.9

#: The patterns of the kinds, fixed values; quantifiers keep what they took where that changes nothing.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_ANY = re.compile("[0-9@]")
_WIDE_EMAIL = re.compile(r"[^\s@]+ ?@ ?[^\s@]+")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _byte(text: str) -> bool:
    """Whether a run of digits of any length is at most 255."""
    own = text.lstrip("0")
    return len(own) <= 3 and int(own or 0) <= 255


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From at sign to at sign, so that each character is looked at a bounded number of times."""
    done, at = 0, text.find("@")
    while at >= 0:
        local = _LOCAL.match(text[done:at][::-1])
        domain = _DOMAIN.match(text, at + 1) if local else None
        if domain:
            yield at - local.end(), domain.end()
        # a later match begins after this one, and without one no local part goes past the sign
        done = domain.end() if domain else at + 1
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[Span]:
    """Matches of the patterns, leftmost and disjoint for each kind, that pass the kind's test."""
    found: list[Span] = []
    if "@" in text:
        found += [("email", a, b) for a, b in _emails(text)]
    if _ANY.search(text):
        found += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_byte, m.group().split(".")))]
        for m in _CARD.finditer(text):
            own = _digits(m.group())
            if 12 <= len(own) <= 19 and luhn(own):
                found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _accepted(kind: str, text: str, start: int, end: int) -> bool:
    """The test of a span that the tagger adds: whole words, and what makes the kind."""
    own = text[start:end]
    if start and text[start - 1].isalnum() and own[0].isalnum() or text[end : end + 1].isalnum() and own[-1].isalnum():
        return False
    digits = _digits(own)
    if kind == "email":
        return bool(_WIDE_EMAIL.fullmatch(own))
    if kind == "ip":
        parts = re.findall("[0-9]+", own)
        return len(parts) == 4 and all(map(_byte, parts))
    if re.search(r"[^0-9\s().+/-]", own):
        return False
    return 12 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15


def windows(text: str) -> np.ndarray:
    """Starts of the windows that hold an at sign or a digit."""
    if not _ANY.search(text):
        return np.zeros(0, np.int64)
    at = np.array([m.start() for m in _ANY.finditer(text)], np.int64)
    last = max(0, -(-(len(text) - WINDOW) // STRIDE))
    first = np.maximum(0, (at - WINDOW) // STRIDE + 1)
    every = [np.minimum(first + k, at // STRIDE) for k in range(-(-WINDOW // STRIDE))]
    return np.unique(np.minimum(np.concatenate(every), last)) * STRIDE


def _tags(length: int, spans: list[Span]) -> np.ndarray:
    """0 outside, for kind k 2k + 1 where a span begins and 2k + 2 inside; later spans only where free."""
    out = np.zeros(length, np.int64)
    for kind, a, b in spans:
        a, b, k = max(a, -1), min(b, length), KINDS.index(kind)
        if b > max(a, 0) and not out[max(a, 0) : b].any():
            out[max(a, 0) : b] = 2 * k + 2
            if a >= 0:
                out[a] = 2 * k + 1
    return out


def _runs(path: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the spans of one path of tags."""
    out, kind, start = [], -1, 0
    for i, tag in enumerate([*path.tolist(), 0]):
        now, begins = (tag - 1) // 2 if tag else -1, tag % 2 == 1
        if kind >= 0 and (now != kind or begins):
            out.append((kind, start, i))
            kind = -1
        if kind < 0 and now >= 0:
            kind, start = now, i
    return out


def reconciled(text: str, found: list[tuple[int, int, int, float]], fixed: list[Span]) -> list[tuple[str, int, int, float]]:
    """One disjoint set of spans from what all windows of a text found.

    Spans of a kind that overlap are one, as sure as its surest part; those that the kind's test or
    ``SURE`` rejects and those that meet a fixed span go; of the rest, the disjoint ones whose
    certainties add up to most stay, the earlier on ties.
    """
    whole: list[list] = []
    for kind, a, b, sure in sorted(found):
        if whole and whole[-1][0] == kind and a < whole[-1][2]:
            whole[-1][2] = max(whole[-1][2], b)
            whole[-1][3] = max(whole[-1][3], sure)
        else:
            whole.append([kind, a, b, sure])
    # fixed spans of all kinds as disjoint stretches
    taken: list[list[int]] = []
    for a, b in sorted((a, b) for _, a, b in fixed):
        if taken and a <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    starts = [a for a, _ in taken]
    free = []
    for kind, a, b, sure in whole:
        while a < b and text[a].isspace():
            a += 1
        while a < b and (text[b - 1].isspace() or text[b - 1] in ".,;:"):
            b -= 1
        if sure < SURE or a >= b:
            continue
        k = bisect_right(starts, b - 1) - 1
        if k >= 0 and taken[k][1] > a:
            continue
        if _accepted(KINDS[kind], text, a, b):
            free.append((b, a, kind, sure))
    free.sort()
    ends = [x[0] for x in free]
    best = [(0.0, 0)]  # of the first i spans: total, and how many stay before the last one that does
    chosen = []
    for i, (_, a, _, sure) in enumerate(free):
        before = bisect_right(ends, a, 0, i)
        with_it = best[before][0] + sure
        chosen.append(with_it > best[i][0])
        best.append((with_it, before) if chosen[i] else best[i])
    out, i = [], len(free)
    while i:
        if chosen[i - 1]:
            b, a, kind, sure = free[i - 1]
            out.append((KINDS[kind], a, b, sure))
            i = bisect_right(ends, a, 0, i - 1)
        else:
            i -= 1
    return out[::-1]


@dataclass
class Finder:
    """Patterns, and a tagger unless there was nothing to learn from."""

    tagger: bilstm.Tagger | None

    def added(self, texts: list[str], fixed: list[list[Span]]) -> list[list[tuple[str, int, int, float]]]:
        """What the tagger adds to each text's fixed spans; windows of all texts share blocks."""
        found: list[list] = [[] for _ in texts]
        if self.tagger is None:
            return found
        held: list[tuple[int, int, np.ndarray]] = []

        def decode() -> None:
            ids, real = bilstm.padded([x for _, _, x in held])
            path, sure = self.tagger.decode(ids, real)
            for (i, start, x), own, share in zip(held, path, sure, strict=True):
                if own.any():
                    for kind, a, b in _runs(own[: len(x)]):
                        found[i].append((kind, start + a, start + b, float(share[a:b].mean())))
            held.clear()

        for i, text in enumerate(texts):
            starts = windows(text)
            if len(starts):
                ids = bilstm.encoded(text)
                for start in starts.tolist():
                    held.append((i, start, ids[start : start + WINDOW]))
                    if len(held) == BLOCK:
                        decode()
        if held:
            decode()
        return [reconciled(t, f, b) if f else [] for t, f, b in zip(texts, found, fixed, strict=True)]


def other_spellings(text: str, spans: list[Span]) -> Iterator[tuple[str, list[Span]]]:
    """A window's text with one of its spans spelled as people also do."""
    for i, (kind, a, b) in enumerate(spans):
        own = text[a:b]
        new = {
            "phone": own.lstrip("+"),
            "card": ".".join(re.findall(".{1,4}", _digits(own))),
            "email": own.replace("@", " @ "),
            "ip": own.replace(".", "-"),
        }[kind]
        shift = len(new) - len(own)
        moved = [(k, c + shift * (c >= b), d + shift * (d >= b)) for k, c, d in spans if (k, c, d) != spans[i]]
        if all(d <= a or c >= a + len(new) for _, c, d in moved):
            yield text[:a] + new + text[b:], sorted([*moved, (kind, a, a + len(new))], key=lambda s: s[1])


def _labelled(text: str) -> Iterator[tuple[str, list[Span]]]:
    """Windows around spans and around other digits, at places given by the text itself."""
    spans = base_spans(text)
    covered = -1
    at = [a for _, a, _ in spans] + [m.start() for m in _ANY.finditer(text)]
    for a in sorted(set(at)):
        if a < covered:
            continue
        start = max(0, a - int(hashlib.sha256(f"{a}:{text[a : a + 40]}".encode(errors="replace")).hexdigest()[:4], 16) % (WINDOW * 3 // 4))
        end = min(len(text), start + WINDOW)
        covered = end
        yield text[start:end], [(k, x - start, y - start) for k, x, y in spans if y > start and x < end]


def labelled_windows(docs: DataFrame, sample: int = SAMPLE, sample_docs: int = SAMPLE_DOCS) -> list[tuple[str, list[Span]]]:
    """Up to ``sample`` windows with their spans, of about ``sample_docs`` texts that hold digits or at signs.

    Texts and windows are chosen by hashes of what is in them, equal windows count once.
    """
    own = docs.select(whole_text().alias("text")).filter(F.col("text").rlike("[0-9@]"))
    n = own.count()
    if n > sample_docs:
        own = own.filter(F.xxhash64("text") < -(1 << 63) + int((1 << 64) * (sample_docs / n)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch):
                out = [x for t in part.column("text").to_pylist() for x in _labelled(t.decode(errors="replace"))]
                if out:
                    texts, spans = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([t.encode(errors="replace").decode() for t in texts]), pa.array([joined(s) for s in spans])],
                        names=["window", "spans"],
                    )

    rows = own.select(F.col("text").cast("binary").alias("text")).mapInArrow(cut, "window string, spans string")
    rows = rows.distinct().orderBy(F.xxhash64("window"), "window", "spans").limit(sample).collect()
    split = lambda s: [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in s.split(",") if x)]
    return [(r.window, split(r.spans)) for r in rows]


def train(windows_: list[tuple[str, list[Span]]], steps: int = bilstm.STEPS) -> Finder:
    """Fit to windows and other spellings of their spans; without any span there is no tagger."""
    every = [(t, s) for t, s in windows_ if t]
    if not any(s for _, s in every):
        return Finder(None)
    every += [x for t, s in every for x in other_spellings(t, [y for y in s if y[1] >= 0 and y[2] <= len(t)])]
    sequences = [bilstm.encoded(t) for t, _ in every]
    return Finder(bilstm.train(sequences, [_tags(len(t), s) for t, s in every], 2 * len(KINDS) + 1, steps=steps))


def find(docs: DataFrame, finder: Finder, redact: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, base and added, lists of spans (kind, start, end, sure).

    Offsets count code points, the end is exclusive; ``base`` are the patterns' matches by start,
    then kind, ``added`` the tagger's, disjoint and apart from them. With ``redact`` also
    ``redacted``, the text with every stretch of spans replaced by its first span's kind in
    brackets. Null texts count as empty and have no spans; repeated rows get a row each; an empty
    table gives an empty one; other columns are not read; texts of any length are read whole.
    """
    field = docs.schema["doc_id"]
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("sure", pa.float64())])
    schema = pa.schema([
        ("doc_id", to_arrow_type(field.dataType)), ("base", pa.list_(span)), ("added", pa.list_(span)),
        *([("redacted", pa.string())] if redact else []),
    ])
    names = ("kind", "start", "end", "sure")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch):
                texts = [t.decode(errors="replace") for t in part.column("text").to_pylist()]
                base = [base_spans(t) for t in texts]
                added = finder.added(texts, base)
                columns = [
                    part.column("doc_id"),
                    pa.array([[dict(zip(names, (*s, 1.0), strict=True)) for s in own] for own in base], pa.list_(span)),
                    pa.array([[dict(zip(names, s, strict=True)) for s in own] for own in added], pa.list_(span)),
                ]
                if redact:
                    columns.append(pa.array([_redacted(*x) for x in zip(texts, base, added, strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    spans = "array<struct<kind: string, start: long, end: long, sure: double>>"
    texts = docs.select("doc_id", whole_text().cast("binary").alias("text"))
    return texts.mapInArrow(
        search, f"doc_id {field.dataType.simpleString()}, base {spans}, added {spans}" + ", redacted string" * redact
    )


def _redacted(text: str, base: list[Span], added: list[tuple]) -> str:
    out, at = [], 0
    for kind, a, b in sorted((s[:3] for s in (*base, *added)), key=lambda s: (s[1], KINDS.index(s[0]))):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def personal_data(docs: DataFrame, finder: Finder | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, the patterns' matches of each kind, their digest, all spans as text.

    n_email, n_ip, n_card and n_phone count the patterns' matches; base_sha256 is the digest of them
    as kind:start:end joined by commas, ``spans`` the same text of theirs and the tagger's. Odd
    rows as in ``find``. Without a finder one is trained on a bounded sample of ``docs``.
    """
    finder = finder or train(labelled_windows(docs))
    found = find(docs, finder)

    def text(spans: Column) -> Column:
        part = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
        return F.array_join(F.transform(spans, part), ",")

    order = F.array(*[F.lit(k) for k in KINDS])
    place = lambda s: F.struct(
        s["start"].alias("start"), F.array_position(order, s["kind"]).alias("k"), s["end"].alias("end"), s["kind"].alias("kind")
    )
    of_kind = lambda k: F.filter("base", lambda s: s["kind"] == k)
    kinds = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(
        "doc_id", *kinds, F.sha2(text(F.col("base")), 256).alias("base_sha256"),
        text(F.array_sort(F.transform(F.concat("base", "added"), place))).alias("spans"),
    )

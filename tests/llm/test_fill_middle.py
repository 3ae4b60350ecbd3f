"""Fill-in-the-middle against plain Python, and its round trip."""

from __future__ import annotations

import hashlib
import re

import pytest
from conftest import docs

from volsignals.llm import catalog, fill_middle

LONG_LINES = "".join(f"line {i} é {'x' * (i % 50)}\n" for i in range(6000))
ROWS = [
    (1, None), (2, ""), (3, "\n\n\n"), (4, LONG_LINES), (5, "ü" * 40_001), (6, "a\nb\nc"), (6, "a\nb\nc"), (6, "other\n"),
    (None, "no id\nat all\n"), (7, "has <P> in it\nx"), (8, "<M>"), (9, "almost <\n<S\n<P\nend<"), (10, "x\r\ny z\n"),
    (11, "\u0000\n\u0001"), (12, "<\n" * 5000), (-3, "a\nb"),
]


def plainly(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 100:
        return doc_id, n, "plain", None, None, sha(text), sha(text), text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    form = "spm" if h4 % 100 < 50 else "psm"
    out = f"<P>{pre}<S>{suf}<M>{mid}" if form == "psm" else f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, n, form, len(pre), len(mid), sha(out), sha(text), out


def test_op11(spark, sf, texts):
    got = catalog.op11_fill_in_middle(spark, sf).collect()
    assert sorted(map(tuple, got)) == sorted(plainly(d, t)[:-1] for d, t, _ in texts)
    assert {r.form for r in got} >= {"psm", "spm"}


@pytest.mark.parametrize("chunk", [fill_middle.CHUNK, 64, 2])
def test_odd_texts(spark, chunk):
    rows = ROWS if chunk > 2 else [r for r in ROWS if len(r[1] or "") < 100]
    key = lambda r: (r[0] is None, r[0] or 0, r[5])
    out = fill_middle.fill_in_middle(docs(spark, *rows), texts=True, chunk=chunk)
    assert sorted(map(tuple, out.collect()), key=key) == sorted((plainly(*r) for r in rows), key=key)
    laid = fill_middle.pieces(docs(spark, *rows), chunk=chunk).selectExpr("max(length(chunk))").first()[0]
    assert laid <= chunk + 9
    back = out.select("restored_sha256", fill_middle.F.sha2(fill_middle.original(), 256).alias("again")).collect()
    assert all(r.restored_sha256 == r.again for r in back)


def test_markers_across_pieces():
    out = b"<S>end <S\nof it<<P>pre<P\n<<M>mid<M"
    for size in range(1, 9):
        reader, parts = fill_middle._Reader("spm"), {0: b"", 1: b"", 2: b""}
        for i in range(0, len(out), size):
            for section, run in reader.read(out[i : i + size]):
                parts[section] += run
        for section, run in reader.close():
            parts[section] += run
        assert parts == {2: b"end <S\nof it<", 0: b"pre<P\n<", 1: b"mid<M"}


def test_repeated_rows_combine_before_the_shuffle(spark):
    many = docs(spark, *[(1, "a\nb\n")] * 500, *[(i, "c\nd") for i in range(2, 300)]).coalesce(1)
    laid = fill_middle.pieces(many)
    assert laid.filter("doc_id = 1").agg({"place": "max"}).first()[0] + 1 == laid.filter("doc_id = 1").count()
    got = fill_middle.fill_in_middle(many).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in got}[1] == 500 and len(got) == 299


def test_rate_and_order(spark):
    d = docs(spark, *[(i, "a\nb\nc\n") for i in range(400)])
    forms = lambda **k: {r.form: r["count"] for r in fill_middle.fill_in_middle(d, **k).groupBy("form").count().collect()}
    assert forms(rate=0) == {"plain": 400}
    assert set(forms(spm=100)) == {"spm"} and set(forms(spm=0)) == {"psm"}
    assert 120 < forms(rate=50)["plain"] < 280


def test_plan_has_one_exchange(spark, sf):
    plan = catalog.op11_fill_in_middle(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 2


def test_empty_table(spark):
    assert fill_middle.fill_in_middle(docs(spark).limit(0)).collect() == []

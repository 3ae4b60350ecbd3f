"""Operators against plain Python over the small tables."""

from __future__ import annotations

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from conftest import docs

from volsignals.llm import (
    catalog, components, embeddings, fingerprints, licenses, line_dedup, mixing, near_dedup, packing, quality, repeats,
    shingles, substring_dedup, token_counts, word_tokens,
)
from volsignals.llm.common import table, vocabulary

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def low(text):
    return "".join(c.lower() if c.isascii() else c for c in text)


def test_op1(spark, sf, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    got = catalog.op1_best_fit_packing(spark, sf).collect()
    want = {}
    for doc, text, _ in texts:
        ids = tok.encode(text, add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[doc, k] = (at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        own.sort()
        assert [o for o, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1]]
        assert sum(n for _, n in own) <= 4096
    assert len(by) <= -(-sum(w[1] for w in want.values()) // 4096) + 1


def test_word_tokens_equal_the_tokenizer():
    w = word_tokens.WordTokens(vocabulary("word_bpe_49k.json"))
    odd = [
        "Don't it's 'Tis rock'n'roll they'll I'd we've", "x<|endoftext|>y", "ÄÖÜß éèê ñ Ÿ İ ı ŉ ſ", "a1b22 ½²", "日本語 text",
        "###a%%% !!! --- a--b", "", " \t\n", "éa", "a b c", "\x00a\x1fb", "''s 'ss", "ﬁ ǅ",
    ]
    assert w.ids(odd) == w._encode(odd) == w.ids(odd)


def test_op1_crossover_keeps_every_piece():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 4096, 300).tolist()
    a = packing.evolve(lengths, [], 4096, [1])
    b = packing.evolve(lengths, [[[i] for i in range(300)]], 4096, [2])
    child = packing.crossed(a, b, lengths, 4096, rng)
    assert sorted(i for x in child for i in x) == list(range(300))
    assert all(sum(lengths[i] for i in x) <= 4096 for x in child)


def test_op2(spark, sf, texts):
    got = collections.defaultdict(list)
    for r in catalog.op2_token_counts(spark, sf).collect():
        got[r.doc_id].append(r)
    encoding, lengths = token_counts._encoder(vocabulary("byte_bpe_50k.tiktoken"))
    for doc, text, _ in texts:
        own = sorted(got[doc], key=lambda r: r.section)
        cuts = [m.end() for m in re.finditer(r"\n|(?<=[.!?]) ", text) if m.end() < len(text)]
        assert [(r.start, r.end) for r in own] == list(zip([0, *cuts], [*cuts, len(text)]))
        ends = np.cumsum([len(text[r.start : r.end].encode()) for r in own])
        count, at = [0] * len(own), 0
        for i in encoding.encode_ordinary(text):
            at += int(lengths[i])
            count[int(np.searchsorted(ends, at - 1, side="right"))] += 1
        assert [r.tokens for r in own] == count and sum(count) == own[0].doc_tokens


def test_op2_rules(spark):
    d = docs(spark, (1, "One two. Three four"))
    vocab = vocabulary("byte_bpe_50k.tiktoken")
    first = [r.tokens for r in token_counts.attribute(d, vocab, "first").orderBy("section").collect()]
    last = token_counts.attribute(d, vocab, "last").orderBy("section").collect()
    assert [r.crossing for r in last] == [1, 0]  # the space goes with the word after it
    assert first == [last[0].tokens + 1, last[1].tokens - 1]


def test_op3_targets(spark):
    d = docs(spark, *[(i, "w " * n, s) for i, (n, s) in enumerate([(10, "a"), (100, "b"), (1000, "c"), (5, None)])])
    got = {r.source: r.target for r in mixing.mix(d).collect()}
    # a and null stop at three times their size, b at 300; c takes the rest
    assert got == {"a": 30.0, "b": 300.0, "c": 770.0, None: 15.0}


def test_op3_targets_of_equal_sources(spark):
    """Sources that reach their caps at one level share it."""
    d = docs(spark, *[(i, "w " * 100, s) for i, s in enumerate("abcd")])
    got = {r.source: r.target for r in mixing.mix(d).collect()}
    assert got == pytest.approx({"a": 5 * 400 / 13, "b": 2 * 400 / 13, "c": 400 / 13, "d": 5 * 400 / 13})


@pytest.mark.parametrize("seed", range(3))
def test_op3_targets_of_many_sources(spark, seed):
    rng = np.random.default_rng(seed)
    sizes = rng.choice([0, 1, 2, 5, 5000, 10**6], 300).tolist()
    names = [f"s{i:03}" for i in range(299)] + [None]
    weights = [mixing.WEIGHTS[i % 3] for i in range(300)]
    per = spark.createDataFrame(list(zip(names, sizes)), "source string, size long").repartition(5)
    low, high = 0.0, 1e9
    for _ in range(200):
        level = (low + high) / 2
        short = sum(min(3 * n, w * level) for n, w in zip(sizes, weights)) < sum(sizes)
        low, high = (level, high) if short else (low, level)
    expected = {s: min(3 * n, w * high) for s, n, w in zip(names, sizes, weights)}
    got = {r.source: r.target for r in mixing.targets(per).collect()}
    assert got == pytest.approx(expected)


def test_op3_ties_refined_by_place(spark, monkeypatch):
    """A boundary bucket of equal rows is cut without adding them up one by one."""
    monkeypatch.setattr(mixing, "FEW", 2)
    rows = [(1, "a b c d", "x")] * 700 + [(i, "a b c", "y") for i in range(2, 100)]
    got = mixing.mix(docs(spark, *rows).repartition(5)).groupBy("source", "target").sum("taken").collect()
    assert len(got) == 2
    for r in got:
        assert 0 <= r.target - r["sum(taken)"] <= 4


def test_op3_hot_ties(spark):
    """Half of all rows are one row over and over; the source still comes near its target."""
    rows = [(1, "a b c d", "x")] * 3000 + [(i, "a b c", "y") for i in range(2, 400)]
    got = mixing.mix(docs(spark, *rows)).groupBy("source", "target").sum("taken").collect()
    for r in got:
        assert abs(r["sum(taken)"] - r.target) <= 4
    many = mixing.mixed_documents(docs(spark, *rows)).groupBy("source").count().collect()
    assert {r.source: r["count"] for r in many}["x"] * 4 == [r["sum(taken)"] for r in got if r.source == "x"][0]


def _links(texts):
    rows, sets, inverted = [], [], collections.defaultdict(list)
    for i, (_, text, _) in enumerate(texts):
        raw = np.frombuffer(text.encode(), np.uint8)
        h, f = shingles.words(raw, np.array([0, len(raw)]))
        rows.append((h >> np.uint64(32)).astype("<u4"))
        sets.append(set(shingles.shingles(h, f)[0].tolist()))
        for x in sets[-1]:
            inverted[x].append(i)
    pairs = {(a, b) for v in inverted.values() for k, b in enumerate(v) for a in v[:k]}
    return [(a, b) for a, b in pairs if near_dedup.likeness(rows[a], rows[b]) >= 0.8]


def test_op4(spark, sf, texts):
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    first = {}
    for i, (_, text, _) in enumerate(texts):
        root[i] = first.setdefault(text, i)
    for a, b in _links(texts):
        a, b = sorted((find(a), find(b)))
        root[b] = a
    want = {texts[i][0]: texts[find(i)][0] for i in range(len(texts))}
    got = catalog.op4_near_dedup(spark, sf).collect()
    assert {r.doc_id: r.class_id for r in got} == want
    assert {r.doc_id for r in got if r.kept} == set(want.values())


def test_op4_chain_and_hot_group(spark):
    """A chain of near copies is one class; so is a large group; other texts stay alone."""
    base = [f"w{i}" for i in range(100)]
    chain = [" ".join(base[k : k + 90] + [f"x{k}"] * 3) for k in range(8)]
    group = [" ".join([*(f"g{i}" for i in range(60)), f"tail{k}"]) for k in range(300)]
    rows = list(enumerate([*chain, *group, "alone in the world with these words"]))
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(docs(spark, *rows)).collect()}
    assert {got[i] for i in range(8, 308)} == {8} and got[308] == 308
    assert {got[i] for i in range(8)} == {0}


def test_op4_group_of_graded_copies(spark):
    """Copies with few to many edits, most too far from each other, some even from the original."""
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(150)]
    rows = [" ".join(base)]
    for k in range(160):
        own = list(base)
        for at in rng.choice(150, int(rng.integers(1, 12)), replace=False):
            own[at] = f"x{rng.integers(10**9)}"
        if k % 9 == 0:
            own[:40] = ["shared", *(f"s{k // 45}_{i}" for i in range(39))]  # families of their own
        rows.append(" ".join(own))
    rows = list(enumerate(rows))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in _links([(i, t, None) for i, t in rows]):
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(docs(spark, *rows)).collect()}
    assert got == {i: find(i) for i in range(len(rows))}
    assert 1 < len(set(got.values())) < 161


@pytest.mark.parametrize("seed", range(6))
def test_op4_alignment(seed):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 12 if seed % 2 else 10**6, 80).astype(np.uint64)
    b = np.delete(a, rng.integers(0, 80, 6))
    b[rng.integers(0, len(b), 4)] = 99
    best = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1, j + 1] = best[i, j] + 1 if a[i] == b[j] else max(best[i, j + 1], best[i + 1, j])
    assert near_dedup._matched(a, b, 100) == best[-1, -1] == near_dedup._matched_rows(a, b, 100)


def test_op5(spark, sf, texts):
    got = {r.doc_id: r for r in catalog.op5_fingerprints(spark, sf).collect()}

    def runs(text):
        w = WORD.findall(low(text))
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    off = []
    for (doc, a, _), (_, b, _) in zip(texts, texts[1:] + texts[:1]):
        edit = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
        assert got[doc].edited_sha256 == hashlib.sha256(edit.encode()).hexdigest()
        assert got[doc].n_chars == len(a)
        x, y = runs(a), runs(edit)
        if len(x) > 100:
            off.append(abs(got[doc].near_edited - len(x & y) / len(x | y)))
    assert np.mean(off) < 0.05
    same = collections.defaultdict(set)
    for doc, text, _ in texts:
        same[text].add(got[doc].fingerprint)
    assert all(len(v) == 1 for v in same.values())


def test_op5_merge():
    raw = [f"t{i} a b c d e f g {i}".encode() for i in range(2)]
    data = np.frombuffer(b"".join(raw), np.uint8)
    a, b = fingerprints.sketches(data, np.array([0, len(raw[0]), len(data)]), 1)
    assert fingerprints.compared(a, fingerprints.merged(a, b))[1] == 1.0
    assert (fingerprints.read(fingerprints.written(a)) == a).all()


def test_op6_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = catalog.op6_quality(spark, sf).join(table(spark, sf, "labels"), "doc_id").filter("held_out")
    rows = got.select("score", "predicted", "quality").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) >= 0.95
    good = [r.score for r in rows if r.quality == 1]
    bad = [r.score for r in rows if r.quality == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.98
    for doc in (0, 17, 123456):
        r = quality.held_out("doc_id")
        one = spark.createDataFrame([(doc,)], "doc_id LONG").select(r.alias("h")).first()
        assert one.h == (zlib.crc32(str(doc).encode()) % 5 == 0)


def test_op6_column_equals_the_model(spark, sf):
    model = quality.train(table(spark, sf, "documents"), table(spark, sf, "labels"))
    d = table(spark, sf, "documents").select("doc_id", "text")
    x = quality.measured(d, d["text"], d["doc_id"]).orderBy("doc_id").toPandas()
    got = quality.scored(d, model).orderBy("doc_id").toPandas()
    assert np.allclose(got["score"], model.predict(x[quality.STATISTICS].to_numpy()))


def test_op7(spark, sf, texts):
    got = {r.doc_id: r for r in catalog.op7_license_scan(spark, sf).collect()}
    for doc, text, _ in texts:
        w = WORD.findall(low(text))
        hits = [
            (k, label)
            for label, phrase in licenses.BASE
            for k in range(len(w))
            if w[k : k + len(phrase.split())] == phrase.split()
        ]
        r = got[doc]
        assert (r.n_words, r.n_base) == (len(w), len(hits))
        assert (r.first_word, r.last_word) == ((min(hits)[0], max(hits)[0]) if hits else (None, None))
        base = sorted({x for _, x in hits})
        assert r.base_labels == ",".join(base) and set(base) <= set(filter(None, r.labels.split(",")))


def test_op7_changed_template(spark):
    """A word put in moves the diagonal; the merged span still counts."""
    text = licenses.TEMPLATES[4][1].split()
    text.insert(8, "extra")
    r = licenses.scan(docs(spark, (1, "so " + " ".join(text) + " etc"))).first()
    assert r.labels == "bsd" and r.n_base == 0 and 0.6 <= r.score < 1
    assert [(s.label, s.start) for s in r.spans] == [("bsd", 1)]


def test_op7_long_template_with_edits(spark):
    """A template of 500 words, met with words changed, put in and left out, and once out of order."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in rng.integers(0, 300, 500)]
    edited = list(words)
    for at in (50, 120, 260, 400):
        edited[at] = "changed"
    edited.insert(200, "extra")
    del edited[330:332]
    shuffled = [w for k in rng.permutation(25) for w in words[20 * k : 20 * k + 20]]
    rows = [(1, "before " + " ".join(edited).upper() + " after"), (2, " ".join(words)), (3, " ".join(shuffled)), (4, " ".join(words[:250]))]
    got = {r.doc_id: r for r in licenses.scan(docs(spark, *rows), [], [("long", " ".join(words))]).collect()}
    assert [got[k].labels for k in (1, 2, 3, 4)] == ["long", "long", "", ""]
    assert got[2].score == 1 and 0.9 < got[1].score < 1 and [(s.start, s.end) for s in got[2].spans] == [(0, 500)]
    assert [(s.start, s.end) for s in got[1].spans] == [(1, 500)]


def test_op7_letters_that_fold_to_ascii(spark):
    """Only A-Z are lower-cased: a Kelvin sign is no k, a dotted capital I no i."""
    rows = [(1, "UNDER the MIT License"), (2, "under the M\u0130T license"), (3, "cc by nc CC BY NC"), (4, "cc by n\u0106")]
    got = {r.doc_id: (r.n_base, r.n_words) for r in licenses.scan(docs(spark, *rows)).collect()}
    assert got == {1: (1, 4), 2: (0, 4), 3: (2, 6), 4: (0, 3)}


def test_op8_against_all_pairs(spark):
    sf = "/root/testdata/sf0.1"
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding").orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    got = {r.vec_id: r for r in catalog.op8_embedding_dedup(spark, sf).collect()}
    n = np.array([got[r.vec_id].n_links for r in rows])
    assert n.sum() >= 0.9 * near.sum() and (n <= near.sum(1)).all()
    at = {r.vec_id: i for i, r in enumerate(rows)}
    for r in rows[:200]:
        assert got[r.vec_id].component_id <= r.vec_id
        assert r.vec_id == got[r.vec_id].component_id or near[at[r.vec_id]].any()


def test_op8_hot_cell_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    rng = np.random.default_rng(0)
    x = np.vstack([np.eye(8)[[0] * 120] + 0.02 * rng.standard_normal((120, 8)), rng.standard_normal((80, 8))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id LONG, embedding ARRAY<DOUBLE>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    got = {r.vec_id: r.n_links for r in embeddings.near_vectors(df).collect()}
    want = near.sum(1)
    assert [got[i] for i in range(120)] == want[:120].tolist()
    assert sum(got.values()) >= 0.9 * want.sum()


def _bytes_left(texts, n=repeats.LENGTH):
    seen, raw = collections.Counter(), [t.encode() for t in texts]
    for t in raw:
        seen.update(t[p : p + n] for p in range(len(t) - n + 1))
    out = []
    for t in raw:
        edge = np.zeros(len(t) + 1, int)
        for p in range(len(t) - n + 1):
            if seen[t[p : p + n]] > 1:
                edge[p] += 1
                edge[p + n] -= 1
        gone = np.cumsum(edge)[: len(t)] > 0
        spans = int((gone & ~np.append(False, gone[:-1])[: len(t)]).sum())
        out.append((int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [512, 1])
def test_op9(spark, sf, texts, hot, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    got = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in catalog.op9_substring_dedup(spark, sf).collect()}
    want = _bytes_left([t for _, t, _ in texts])
    assert got == {doc: w for (doc, _, _), w in zip(texts, want)}


def test_op9_edges(spark):
    rng = np.random.default_rng(3)
    word = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    p, q = word(400), word(399)
    rows = [
        word(50) + p + word(30), p + word(10), word(5) + q, q + word(7), "z" * 401, "ab" * 260, word(400), p[:399] + "!",
        word(20) + p + word(20) + p,
    ]
    got = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.without_repeats(docs(spark, *enumerate(rows))).collect()}
    assert got == dict(enumerate(_bytes_left(rows)))


def _suffixes(spark, *rows):
    full = [(prefix, 0, str(text), at, 0, 400) for prefix, text, at in rows]
    return spark.createDataFrame(full, substring_dedup.SUFFIX)


def test_op9_levels(spark):
    family = substring_dedup.IndexFamily(spark)
    for k in range(1, 6):
        family.add(_suffixes(spark, (k, k, 1), (99, k, 2), (50, k % 2, 3)))
    assert [size for size, _ in family.levels] == [4, 1]
    assert sorted(r.prefix for r in family.repeated().collect()) == [50, 99]
    top = {r.prefix: r.n for r in family.level(family.levels[0][1]).collect()}
    assert top == {1: 1, 2: 1, 3: 1, 4: 1, 50: 4, 99: 4}
    assert sorted(r.at for r in family.suffixes().collect()) == [1] * 5 + [2] * 5 + [3] * 5
    family.delete()


def test_op9_levels_meet_without_shuffle(spark):
    family = substring_dedup.IndexFamily(spark)
    for k in range(3):
        family.add(_suffixes(spark, (k, k, 1), (99, k, 2)))
    (_, old), (_, new) = family.levels
    for df in (family.scanned(new, old), family.merged(old, new)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    family.delete()


def test_op9_family_stays(spark, sf, texts, tmp_path):
    """A later call with new documents gives what one call over all gives; indexed texts are not read into it again."""
    rows = [(d, t) for d, t, _ in texts]
    rows = [*rows[: len(rows) // 2], *((d + 10_000, t) for d, t in rows[: len(rows) // 4]), *rows[len(rows) // 2 :]]
    folder = f"{tmp_path}/family"
    for part, grows in ((rows[: len(rows) // 2], True), (rows, True), (rows[len(rows) // 3 :], False)):
        family = substring_dedup.IndexFamily(spark, folder)
        before = family.suffixes().count() if family.arrays else 0
        out = substring_dedup.without_repeats(docs(spark, *part), 1, family).collect()
        got = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in out}
        assert got == {d: w for (d, _), w in zip(part, _bytes_left([t for _, t in part]))}
        after = substring_dedup.IndexFamily(spark, folder)
        assert len(after.arrays) == family.version == after.version
        assert (after.suffixes().count() > before) == grows


def test_op9_lost_driver(spark, tmp_path, monkeypatch):
    """A driver lost before the state is written leaves the family as it was; the batch can be added again."""
    folder = f"{tmp_path}/family"
    family = substring_dedup.IndexFamily(spark, folder)
    family.add(_suffixes(spark, (1, 1, 1), (2, 1, 2)))
    second = _suffixes(spark, (2, 2, 1), (3, 2, 2))

    def lost(self):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(substring_dedup.IndexFamily, "_write_state", lost)
        with pytest.raises(RuntimeError):
            family.add(second)
    again = substring_dedup.IndexFamily(spark, folder)
    assert [size for size, _ in again.levels] == [1] and again.repeated().count() == 0
    again.add(second)
    assert [r.prefix for r in again.repeated().collect()] == [2]
    assert {r.prefix: r.n for r in again.level(again.levels[0][1]).collect()} == {1: 1, 2: 2, 3: 1}


def test_op10(spark, sf, texts):
    windows, lines_of = collections.defaultdict(list), {}
    for doc, text, _ in texts:
        lines = lines_of[doc] = text.split("\n")
        full = [(i, x, len(WORD.findall(x))) for i, x in enumerate(lines) if WORD.search(x)]
        for k in range(len(full)):
            for step, stop in ((1, len(full)), (-1, -1)):
                n = 0
                for j in range(k, stop, step):
                    n += full[j][2]
                    if n >= line_dedup.MIN_WORDS:
                        a, b = min(j, k), max(j, k)
                        windows[tuple(x[1] for x in full[a : b + 1])].append((doc, full[a][0], full[b][0]))
                        break
    gone = collections.defaultdict(set)
    for places in windows.values():
        first = min(places)[:2]
        for doc, a, b in places:
            if (doc, a) > first:
                gone[doc].update(range(a, b + 1))
    for r in catalog.op10_line_dedup(spark, sf).collect():
        left = "\n".join(x for i, x in enumerate(lines_of[r.doc_id]) if i not in gone[r.doc_id])
        assert (r.n_removed, r.kept_sha256) == (len(gone[r.doc_id]), hashlib.sha256(left.encode()).hexdigest())
        assert r.n_lines == len(lines_of[r.doc_id])


def test_op10_runs_of_short_lines(spark):
    run = "one two three\nfour five six\nseven eight nine\nten eleven twelve"
    rows = [(1, f"first of all this text\n{run}\nend"), (2, f"{run}"), (3, "one two three\nfour five six"), (4, f"x\n\n{run}\ny")]
    got = {r.doc_id: r.text for r in line_dedup.deduplicate(docs(spark, *rows)).collect()}
    assert got == {1: rows[0][1], 2: "", 3: rows[2][1], 4: "x\n\ny"}


def test_op10_long_document_of_repeated_lines(spark):
    """Every second line goes; the work grows with the lines, not with lines times runs."""
    n = 60_000
    lines = [f"line number {i} has ten words in it or more" for i in range(n)]
    text = "\n".join(x for i, line in enumerate(lines) for x in (line, f"own {i}"))
    got = {r.doc_id: r for r in line_dedup.deduplicate(docs(spark, (1, "\n".join(lines)), (2, text))).collect()}
    assert (got[1].n_removed, got[2].n_removed) == (0, n)
    assert got[2].text == "\n".join(f"own {i}" for i in range(n))


def _pairs_at(n, dims, cosine):
    """n vectors and, for each, another one at the given cosine."""
    rng = np.random.default_rng(0)
    a, e = rng.standard_normal((2, n, dims))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    e -= (e * a).sum(1, keepdims=True) * a
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    return np.vstack([a, cosine * a + np.sqrt(1 - cosine**2) * e])


@pytest.mark.parametrize("queries", [16384, 300, 32])
def test_op8_visits_where_the_sample_has_no_links(spark, monkeypatch, queries):
    monkeypatch.setattr(embeddings, "SAMPLE", 64)
    monkeypatch.setattr(embeddings, "PER_CELL", 16)
    monkeypatch.setattr(embeddings, "QUERIES", queries, raising=False)
    monkeypatch.setattr(embeddings, "ENOUGH", 100, raising=False)
    x = _pairs_at(2000, 16, 0.92)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id LONG, embedding ARRAY<DOUBLE>")
    n = {r.vec_id: r.n_links for r in embeddings.near_vectors(df).collect()}
    n = np.array([n[i] for i in range(len(x))])
    assert (n <= near.sum(1)).all() and n.sum() >= 0.99 * near.sum()


def test_op8_groups_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 64)
    monkeypatch.setattr(embeddings, "PER_CELL", 16)
    monkeypatch.setattr(embeddings.Index, "fit_visits", lambda self, *_: setattr(self, "visits", 3))
    plain = embeddings._compare

    def bounded(*args):
        compare = plain(*args)

        def run(pdf):
            assert len(pdf) <= 4 * 64, f"{len(pdf)} rows in one group"
            return compare(pdf)

        return run

    monkeypatch.setattr(embeddings, "_compare", bounded)
    rng = np.random.default_rng(0)
    hot = np.eye(8)[[0] * 1500] + 0.02 * rng.standard_normal((1500, 8))
    x = np.vstack([hot, rng.standard_normal((500, 8))])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id LONG, embedding ARRAY<DOUBLE>")
    got = {r.vec_id: r.n_links for r in embeddings.near_vectors(df).collect()}
    n = np.array([got[i] for i in range(len(x))])
    assert (n <= near.sum(1)).all() and (n[:1500] >= 1499).all()


def test_op8_links_vectors_of_every_length(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "PER_CELL", 16)
    sets = [_pairs_at(300, 16, 0.95), _pairs_at(100, 12, 0.95), _pairs_at(1, 6, 0.95), np.ones((1, 3))]
    rows = [v.tolist() for x in sets for v in x]
    want = []
    for x in sets:
        near = x @ x.T / np.outer(*2 * [np.linalg.norm(x, axis=1)]) >= 0.9
        want += (near.sum(1) - 1).tolist()
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id LONG, embedding ARRAY<DOUBLE>")
    got = {r.vec_id: r.n_links for r in embeddings.near_vectors(df).collect()}
    assert [got[i] for i in range(600, len(rows))] == want[600:]
    assert sum(got.values()) >= 0.999 * sum(want)


def test_op1_open_bins_of_shards_merge(spark, monkeypatch):
    for name, value in (("SHARD", 8), ("LATER_SHARD", 8), ("LEVELS", 2)):
        monkeypatch.setattr(packing, name, value)
    df = docs(spark, *((i, "the " * 20) for i in range(160)))
    cut = packing.pieces(df, vocabulary("word_bpe_49k.json")).select("length").distinct().collect()
    (length,) = [r.length for r in cut]
    got = packing.pack(df, vocabulary("word_bpe_49k.json"), 3 * length - 1).collect()
    sizes = collections.Counter(r.sequence_id for r in got)
    assert len(got) == 160 and set(sizes.values()) == {2}, collections.Counter(sizes.values())


def test_components_end_when_nothing_changes(spark, monkeypatch):
    monkeypatch.setattr(components, "MOST_ROUNDS", 1, raising=False)
    df = spark.createDataFrame([(i, i + 1) for i in range(30)], "a LONG, b LONG")
    assert {r.node: r.root for r in components.components(df).collect()} == dict.fromkeys(range(31), 0)

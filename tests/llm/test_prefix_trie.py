"""The prefix trie against plain Python."""

from __future__ import annotations

import collections
import hashlib
import zlib

import pytest

from volsignals.llm import catalog, prefix_trie
from volsignals.llm.common import table

SCHEMA = "conv_id LONG, turn INT, role STRING, text STRING, depth INT, hi STRING, total DOUBLE"
EMPTY = hashlib.sha256(b"").hexdigest()


def turns(spark, *rows):
    """(conv_id, turn, role, text) with columns of clashing names."""
    return spark.createDataFrame([(*r, 3, "x", 0.5) for r in rows], SCHEMA)


def head(c):
    return zlib.crc32(str(c).encode()) % 6


def tie(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def plainly(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, tie(role, text), role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, v in own.items():
        h = head(c)
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        whole[c] = own.get(base, [])[:h] + v[h:]
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    ids = {(): 0}  # prefixes by number, so that long conversations stay cheap
    parent, depth, last = {0: None}, {0: 0}, {0: ""}
    for c in sorted(whole):
        node = 0
        members[0].append(c)
        for t in whole[c]:
            key = (node, t)
            if key not in ids:
                ids[key] = len(ids)
                parent[ids[key]], depth[ids[key]], last[ids[key]] = node, depth[node] + 1, t[1]
            node = ids[key]
            members[node].append(c)
        ends[node].append(c)
    if not whole:
        return []
    children = collections.Counter(p for n, p in parent.items() if n)
    saved = {n: (len(members[n]) - 1) * len(last[n]) for n in parent}
    leaves = {n: int(not children[n]) for n in parent}
    for n in sorted(parent, key=depth.get, reverse=True):
        if n:
            saved[parent[n]] += saved[n]
            leaves[parent[n]] += leaves[n]
    return sorted(
        (members[n][0], depth[n], members[parent[n]][0] if n else -1, len(members[n]), children[n], leaves[n], saved[n],
         hashlib.sha256(",".join(map(str, ends[n])).encode()).hexdigest())
        for n in parent
    )


def trie(df):
    rows = prefix_trie.prefix_trie(df).collect()
    assert all((r.parent_conv_id is None) == (r.depth == 0) for r in rows)
    return sorted((*r[:2], -1 if r[2] is None else r[2], *r[3:]) for r in rows)


ODD = [
    (0, 0, "user", "a"), (0, 1, "assistant", "b"), (0, 2, "user", "c"),
    (1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (1, 3, "user", "d"), (1, 4, "user", "e"), (1, 5, "u", "f"),
    (2, None, None, None), (2, 0, "user", "a"), (2, 0, "user", "a"), (2, 0, "assistant", "z"), (2, 9, "user", ""),
    (3, 0, "usera", ""), (4, 0, "user", "a"), (5, 7, "user", "é" * 3000), (5, 8, "user", "x"),
    (102, 0, "user", "a"), (102, 1, "user", "b"), (107, 0, "user", "a"), (107, 1, "user", "b"), (107, 2, "q", "b"),
    (-5, 0, "user", "a"), (-105, 0, "user", "a"), (-105, 1, "user", "n"), (None, 0, "user", "lost"),
    *[(200 + i, k, "user", f"same {k}") for i in range(40) for k in range(7)],
]


def test_op12(spark, sf):
    rows = [tuple(r) for r in table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = catalog.op12_prefix_trie(spark, sf)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert trie(table(spark, sf, "conversations")) == plainly(rows)


def test_odd_rows(spark):
    want = plainly(ODD)
    assert {head(r[0]) for r in ODD if r[0] is not None} == set(range(6))
    assert trie(turns(spark, *ODD)) == want


def test_head_without_base_and_without_own_turns(spark):
    # a conversation of which the head replaces all, with no base: a member of the root alone
    c = next(c for c in range(301, 400) if head(c) >= 2)
    assert trie(turns(spark, (c, 0, "u", "a"))) == [(c, 0, -1, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_long_conversation_lies_in_several_parts(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHAIN", 64)
    rows = [(400, k, "user", f"turn {k}") for k in range(3000)] + [(401, k, "user", f"turn {k}") for k in range(2990)]
    rows += [(402, k, "user", f"turn {k}" if k < 1700 else f"own {k}") for k in range(2100)] + [(9, 0, "u", "t")]
    df = turns(spark, *rows)
    stored = prefix_trie.numbered(df)
    assert stored.filter("conv_id = 400").select("part").distinct().count() > 1
    assert trie(df) == plainly(rows)


def test_groups_are_verified(spark):
    df = turns(spark, *ODD)
    stored = prefix_trie.numbered(df)
    carry = prefix_trie._carried(stored, 0)
    prefixes = prefix_trie.rebuilt(prefix_trie._whole(stored, carry, 0)).cache()

    def verdict(p):
        names = ["p_hi", "p_lo", "ref_conv", "ref_pos"]
        fn = prefix_trie.F
        nodes = p.groupBy("depth", "hi", "lo").agg(*[fn.min(c).alias(c) for c in names], *[fn.max(c).alias(f"{c}_max") for c in names])
        return prefix_trie._verified(nodes, p, stored, carry)

    assert verdict(prefixes)
    one = prefix_trie.F.lit(1).cast("long")
    # a collision of last turns with one parent, and one of parents
    assert not verdict(prefixes.withColumn("hi", one).withColumn("lo", one).filter("depth = 1"))
    assert not verdict(prefixes.filter("depth = 3").withColumn("hi", one).withColumn("lo", one))


def test_other_numbers_after_a_failed_check(spark, monkeypatch):
    real, calls = prefix_trie._verified, []

    def once_false(*args):
        calls.append(1)
        return len(calls) > 1 and real(*args)

    monkeypatch.setattr(prefix_trie, "_verified", once_false)
    assert trie(turns(spark, *ODD)) == plainly(ODD) and len(calls) == 2


def test_ends_of_a_node_are_joined_in_runs(spark, monkeypatch):
    rows = [(c, k, "user", f"t{k}") for c in range(1000, 10_000) for k in range(1)]
    got = {r[1]: r for r in trie(turns(spark, *rows))}
    want = {r[1]: r for r in plainly(rows)}
    assert got == want


@pytest.mark.parametrize("rows", [[], [(None, 0, "user", "a")]])
def test_no_conversations(spark, rows):
    assert trie(turns(spark, *rows) if rows else turns(spark, (1, 1, "a", "b")).limit(0)) == []

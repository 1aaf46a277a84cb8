"""Prefix trie against a trie built one conversation at a time."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from sitrep.llm import prefix_trie as P

DDL = "conv_id long, turn long, role string, text string"
COLUMNS = (
    "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256"
).split()


def brute(rows):
    """Rows of the result, from the definition; remainders have the sign of the id, as in SQL."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:]
    members = defaultdict(set)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    saved, leaves = {}, {}
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        saved[p] = (len(members[p]) - 1) * words + sum(saved[k] for k in children[p])
        leaves[p] = sum(leaves[k] for k in children[p]) or (0 if children[p] else 1)
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(p))
        parent = min(members[p[:-1]]) if p else None
        sha = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(m), len(p), parent, len(m), len(children[p]), leaves[p], saved[p], sha))
    return sorted(out, key=str)


def found(spark, rows):
    out = P.nodes_of(spark.createDataFrame(rows, DDL)).select(*COLUMNS).collect()
    return sorted((tuple(r) for r in out), key=str)


@pytest.fixture(scope="module")
def talks():
    draw = random.Random(7)
    texts = ["a b", "c", "", "d e f ", "Good day.\nHow are you"]
    rows = []
    for c in range(0, 70):
        if c in (20, 33):
            continue
        for turn in range(draw.randint(1, 6)):
            rows.append((c, turn, draw.choice(["user", "assistant"]), draw.choice(texts[: 2 + c % 4])))
    # one conversation much longer than the others, and one that shares most of it
    long = [(turn, draw.choice(["user", "assistant"]), draw.choice(texts)) for turn in range(90)]
    rows += [(80, *t) for t in long] + [(60 + 20, 500 + i, "user", "x y") for i in range(4)]
    rows += [(100 + k, *t) for k in (1, 2, 3) for t in long[: 60 + 10 * k]]
    return rows


def test_against_brute_force(spark, talks):
    assert found(spark, talks) == brute(talks)


def test_long_conversations_in_pieces(spark, talks, monkeypatch):
    """Pieces of 7 turns and shards of 40 rows give what whole conversations give."""
    monkeypatch.setattr(P, "PIECE", 7)
    monkeypatch.setattr(P, "SHARD", 40)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        assert found(spark, talks) == brute(talks)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def test_awkward_rows(spark):
    rows = [
        (None, 1, "user", "left out"),
        (0, None, None, None),
        (0, None, "", ""),
        (0, 3, "user", "b"),
        (0, 3, "user", "a"),
        (0, 3, "user", "a"),
        (1, 1, "user", "one"),  # its first turns are exchanged
        (2, 5, "system", "x " * 30_000),
        (3, 5, "system", "x " * 30_000),
        (-4, 0, "user", "negative"),
        (45, 0, "user", "its first conversation is absent"),
        (41, 0, "user", "its first conversation is absent"),
        (10**12, 0, "user", "far"),
    ]
    clash = [(*r, "k", 1, 2, 3) for r in rows]
    more = spark.createDataFrame(clash, DDL + ", a string, depth int, piece int, words int")
    out = P.nodes_of(more).select(*COLUMNS).collect()
    assert sorted((tuple(r) for r in out), key=str) == brute(rows)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_node_table_is_minimal_and_verified():
    draw = np.random.default_rng(1)
    a = draw.integers(0, 50, 20_000).astype(np.uint64)
    b = draw.integers(0, 500, 20_000).astype(np.uint64)
    table = P.NodeTable(a, b)
    distinct = len(set(zip(a.tolist(), b.tolist(), strict=True)))
    at = table.slots(a, b)
    assert len(table) == distinct and set(at) == set(range(distinct))
    assert (table.a[at] == a).all() and (table.b[at] == b).all()
    assert (table.slots(a[:100], b[:100] + np.uint64(1000)) == -1).all()


def test_equal_digests_of_different_prefixes_are_told():
    rows = {k: np.array([1, 1], dtype=np.int64) for k in [*P.NODE, "conv_id", "saved", "leaf"]}
    rows["pa"] = np.array([3, 4], dtype=np.int64)
    with pytest.raises(ValueError, match="one digest"):
        P.subtree_sums(rows)

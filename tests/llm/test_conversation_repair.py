"""Repair of conversations against all edits tried, and against one pass without segments."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import pairwise

import pytest

from sitrep.llm import conversation_repair as R

DDL = "conv_id long, turn long, role string, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]")


def damaged(rows):
    out = defaultdict(list)
    for c, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = f"{' ' if c is None else c}:{' ' if turn is None else turn}"
        k = zlib.crc32(key.encode()) % 20
        out[c]  # every conversation is known
        if k == 0:
            continue
        if k == 1:
            text = ""
        if k == 2:
            text = re.sub("[.!?]", "", text)
        if k == 4:
            role = "user"
        out[c] += [(turn is not None, turn or 0, role, text)] * (2 if k == 3 else 1)
    return {c: sorted(v) for c, v in out.items()}


def marks(turns):
    """b, d, t or '' for each (role, text)."""
    out, seen = [], set()
    for role, text in turns:
        words = WORD.findall(text)
        fault = "b" if not words else "d" if (role, text) in seen else "" if words[-1] in ".!?" else "t"
        seen.add((role, text))
        out.append(fault)
    return out


def cheapest(turns):
    """Edits of a conversation by full strings per state, without a tree."""
    faults = marks(turns)
    allowed = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    ways = {"": (0, "", ())}

    def better(found, state, way):
        if state not in found or way[:2] < found[state][:2]:
            found[state] = way

    def inserted(ways):
        found = dict(ways)
        for _ in range(3):
            for state, (cost, audit, made) in list(found.items()):
                for role in ("user", "assistant"):
                    if (state, role[0]) in allowed:
                        better(found, role[0], (cost + 5, audit + "I", (*made, f"{role}:")))
        return found

    for (role, text), fault in zip(turns, faults, strict=True):
        found = {}
        for state, (cost, audit, made) in inserted(ways).items():
            better(found, state, (cost + 2, audit + "D", made))
            if fault in ("b", "d"):
                continue
            stay = 5 if fault == "t" else 0
            for as_role, letter, more in ((role, "K", 0), ("user", "R", 1), ("assistant", "R", 1)):
                if (state, as_role[:1]) in allowed:
                    way = (cost + stay + more, audit + letter, (*made, f"{as_role}:{text}"))
                    better(found, as_role[0], way)
        ways = found
    ways = inserted(ways)
    return min((ways[s] for s in ("", "a") if s in ways), key=lambda w: w[:2])


def brute(rows):
    out = []
    for c, found in damaged(rows).items():
        turns = [x[2:] for x in found]
        faults = marks(turns)
        numbers = {x[1] for x in found if x[0]}
        pairs = [(x[0][:1] + y[0][:1]) for x, y in pairwise(turns)]
        cost, audit, made = cheapest(turns)
        out.append(
            (
                c,
                max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0,
                *[faults.count(x) for x in "bdt"],
                sum(p not in ("su", "ua", "au") for p in pairs),
                cost,
                audit,
                hashlib.sha256("\n".join(made).encode()).hexdigest(),
            )
        )
    return sorted(out, key=str)


def found(spark, rows, ddl=DDL):
    columns = [x.split()[0] for x in R.REPORT.split(", ")]
    out = R.report(R.repair(R.damaged(spark.createDataFrame(rows, ddl)))).select(*columns).collect()
    return sorted((tuple(r) for r in out), key=str)


def talks(seed, n, most):
    draw = random.Random(seed)
    texts = ["Yes.", "No!", "why", "", " \n", "Good day. ", "one. two", "Is it?", "x" * 40 + "."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None]
    rows = []
    for c in range(n):
        for turn in range(draw.randint(1, most)):
            if draw.random() < 0.9:
                role = draw.choice(roles[:3]) if c % 3 else draw.choice(roles)
                rows.append((c, turn * draw.choice([1, 1, 2]), role, draw.choice(texts) or None))
    return rows


def test_small_conversations_against_every_edit(spark):
    rows = talks(1, 300, 9)
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("limit", [1, 3, 1024])
def test_long_conversations_in_segments(spark, monkeypatch, limit):
    """Cut after every row, after three rows or not at all, and over many tasks: the same repair."""
    rows = talks(2, 12, 40) + [(99, i, x[2], x[3]) for i, x in enumerate(talks(3, 60, 9))]
    monkeypatch.setattr(R, "SEGMENT_ROWS", limit)
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(spark, rows) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_awkward_rows(spark):
    rows = [
        (None, None, None, None),
        (None, 3, "user", "Null conversation."),
        (1, None, "user", "No turn."),
        (1, None, "user", "No turn."),
        (1, 2, None, "No role."),
        (1, 2, "", "Empty role."),
        (2, 5, "system", "Only this."),
        (3, 1, "user", "w " * 50_000 + "."),
        (3, 2, "assistant", "漢字 ß ."),
        (4, 10, "user", None),
        (4, -10, "assistant", " \t"),
        *[(5, i, "user", f"{i}.") for i in range(30)],
    ]
    clash = [(*r, "p", "s", 1, "l") for r in rows]
    assert found(spark, clash, DDL + ", part string, seg string, kind int, letters string") == brute(rows)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_survivors_hold_unresolved_suffixes_only():
    """Edits are emitted as soon as all survivors share them; the tree does not grow with the rows."""
    draw = random.Random(5)
    rows = [(draw.choice(["user", "assistant"]), draw.choice([R.FREE, R.FREE, R.TRUNCATED])) for _ in range(5000)]
    path, done, most = R.Survivors([0]), 0, 0
    for role, kind in rows:
        done += len(path.step(R.MOVES[R.initial(role), kind]))
        held, size = [path.root], 0
        while held:
            size += 1
            held += held.pop().kids
        most = max(most, size)
    assert done > 4900 and most < 200


def test_dropped_survivors_never_win():
    """``INSTEAD`` holds for every short continuation, so that dropping changes no repair."""
    draw = random.Random(9)
    rows = [(r, k) for r in ("system", "user", "assistant", "x") for k in (R.FREE, R.TRUNCATED, R.BLANK_ROW)]

    def cost(state, after):
        ways = {state: 0}
        for role, kind in after:
            found = {}
            for s, t, c, _ in R.MOVES[R.initial(role), kind]:
                if s in ways:
                    found[t] = min(found.get(t, 10**9), ways[s] + c)
            ways = found
        return min(ways[s] + c for s, _, c, _ in R.LAST if s in ways)

    for _ in range(3000):
        after = draw.choices(rows, k=draw.randint(0, 7))
        for (u, t), more in R.INSTEAD.items():
            assert cost(u, after) <= cost(t, after) + more

"""Repair of conversations to an alternation of user and assistant, at least cost.

``faults`` marks rows, ``repair`` finds the cheapest edits of every conversation and makes them,
``report`` puts its pieces together to one row per conversation. ``damaged`` makes test input.

Rules. A row is blank (no word), a duplicate (role and text seen earlier in the conversation) or
truncated (does not end with ``. ! ?``); the first that holds counts. Edits: keep (cost 0), give the
role user or assistant (1), delete (2; the only edit of blank rows and duplicates), insert an empty
turn of either role anywhere (5). A truncated row that stays costs 5 more. Role initials must then
read ``(s?(ua)+)?``. Of equally cheap edits the ASCII-least string of their initials K R D I wins.

Method: Viterbi with survivor coalescence. There are four states (nothing yet, after system, after
user, after assistant) and one survivor for each. Steps hang in a tree of back pointers whose nodes
count what refers to them; nodes that no survivor comes from are released, and once all survivors
share an ancestor, the edits up to it are final and emitted. A survivor goes once another could go
on in its stead for less. So what is held are unresolved suffixes
alone. Tied paths are compared by their complete unresolved suffixes. Inserted turns belong to the
step of the next row, so no step's letters begin another's and earlier letters decide.

Scale. Rows are dealt by range of (conversation, turn, role, text), so a conversation of any length
lies over many tasks. Conversations that begin and end within one task are repaired there, in one
pass. The others (one or two for each task, and long ones) become segments of bounded size. Rows
seen earlier are found by an aggregate of digests; each segment then finds its cheapest edits for
every pair of first and last state, on its own, and one Viterbi over segments, which reads 16 costs
and 16 ranks of each, chooses among them by the same tree. A hash over a whole conversation is
sequential by nature: one task reads its repaired pieces in order and holds one at a time.

Awkward input: rows with a null ``conv_id`` are one conversation. Null turns come first; rows of one
turn are ordered by role, then text, so repeated rows follow each other. A role whose first letter
is not s, u or a (null and empty ones too) cannot be kept. An empty table has no result. Other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Hashable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitrep.llm.common import BLANK, NOT_BLANK, small_batches, stored

#: Rows and bytes after which a segment ends.
SEGMENT_ROWS = 1024
SEGMENT_BYTES = 4 << 20
#: Code points of a text by which rows of one turn are dealt to tasks; sorting uses whole texts.
DEALT = 64

# What may be done with a row.
FREE, TRUNCATED, BLANK_ROW, DUPLICATE, DROPPED = range(5)
STATES = range(4)
ROLES = {0: "user", 1: "user", 2: "assistant", 3: "user"}  # what may follow each state
INITIALS = "sua"


# --- test input --------------------------------------------------------------------------------
def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` with rows dropped, emptied, cut, repeated or given the role user.

    By crc32 of ``conv_id:turn`` modulo 20; nulls are one space. Dropped rows stay as rows with
    ``dropped``, so that their conversations are known.
    """

    def text(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    k = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(k == 4, F.lit("user")).otherwise(text("role")).alias("role"),
        F.when(k == 1, F.lit(""))
        .when(k == 2, F.regexp_replace(text("text"), "[.!?]", ""))
        .otherwise(text("text"))
        .alias("text"),
        (k == 0).alias("dropped"),
        F.explode(F.array_repeat(F.lit(0), F.when(k == 3, F.lit(2)).otherwise(F.lit(1)))).alias("copy"),
    )
    return rows.drop("copy")


# --- Viterbi -----------------------------------------------------------------------------------
class Node:
    """A step of a path: what was done, and who refers to it."""

    __slots__ = ("parent", "label", "kids")

    def __init__(self, parent: Node | None, label: Hashable):
        self.parent, self.label, self.kids = parent, label, []


class Survivors:
    """The cheapest path into every state; ``step`` returns what has become final.

    ``key`` is what of a label is compared between tied paths.
    """

    def __init__(self, states: Iterable[int], key: Callable[[Hashable], Hashable] = lambda label: label):
        self.key = key
        self.root = Node(None, None)
        self.alive: dict[int, tuple[int, Node]] = {s: (0, self.root) for s in states}

    def before(self, one: tuple[Node, Hashable], other: tuple[Node, Hashable]) -> bool:
        """Whether a path with a last label comes before another of equal cost.

        Both unresolved suffixes are walked back to their common ancestor; the earliest labels that
        differ decide.
        """
        (a, x), (b, y) = one, other
        x, y = self.key(x), self.key(y)
        earliest = (x, y) if x != y else None
        while a is not b:
            x, y = self.key(a.label), self.key(b.label)
            if x != y:
                earliest = (x, y)
            a, b = a.parent, b.parent
        return earliest is not None and earliest[0] < earliest[1]

    def step(self, moves: Iterable[tuple[int, int, int, Hashable]]) -> list[Hashable]:
        """Follow the cheapest of the moves (from, to, cost, label) into every state."""
        best: dict[int, tuple[int, Node, Hashable]] = {}
        for s, t, cost, label in moves:
            if s not in self.alive:
                continue
            total, node = self.alive[s]
            total += cost
            known = best.get(t)
            if (
                known is None
                or total < known[0]
                or total == known[0]
                and self.before((node, label), known[1:])
            ):
                best[t] = (total, node, label)
        old = [node for _, node in self.alive.values()]
        self.alive = {}
        for t, (total, node, label) in best.items():
            if any(u != t and way[0] + INSTEAD[u, t] < total for u, way in best.items()):
                continue
            new = Node(node, label)
            node.kids.append(new)
            self.alive[t] = (total, new)
        for node in old:  # nothing refers to a node without kids: release it, and what it alone kept
            while not node.kids and node is not self.root and node.parent is not None:
                above, node.parent = node.parent, None
                above.kids.remove(node)
                node = above
        return self._final()

    def _final(self) -> list[Hashable]:
        """Labels down to the last common ancestor of all survivors, which becomes the root."""
        out = []
        while len(self.root.kids) == 1:
            self.root = self.root.kids[0]
            self.root.parent = None
            out.append(self.root.label)
        return out

    def rest(self, state: int) -> tuple[int, list[Hashable]]:
        """Cost of the path into ``state`` and its labels not emitted yet."""
        cost, node = self.alive[state]
        labels = []
        while node is not self.root:
            labels.append(node.label)
            node = node.parent
        return cost, labels[::-1]


def _moves(initial: int, kind: int) -> list[tuple[int, int, int, str]]:
    """The cheapest edits of one row, with turns inserted before it, for each pair of states."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for s in STATES:
        at = [(s, "")]  # inserting turns alternates user and assistant; more than these change nothing
        while len(at) < 3 and at[-1][0] not in [x for x, _ in at[:-1]]:
            at.append((3 if at[-1][0] == 2 else 2, at[-1][1] + "I"))
        for x, inserted in at:
            edits = [(x, 2, "D")]
            stay = 5 if kind == TRUNCATED else 0
            if kind in (FREE, TRUNCATED):
                follows = 3 if x == 2 else 2
                edits.append((follows, stay + 1, "R"))
                if initial == 0 and x == 0:
                    edits.append((1, stay, "K"))
                if initial == follows - 1:
                    edits.append((follows, stay, "K"))
            for t, cost, letter in edits:
                found = (5 * len(inserted) + cost, inserted + letter)
                best[s, t] = min(best.get((s, t), found), found)
    return [(s, t, cost, label) for (s, t), (cost, label) in best.items()]


#: Moves by initial (s, u, a, other) and kind of row.
MOVES = {(i, k): _moves(i, k) for i in range(4) for k in (FREE, TRUNCATED, BLANK_ROW, DUPLICATE)}
#: What it costs at most to go on from the first state as one could from the second. From a state
#: that costs more than another and this together no cheapest path goes on: its survivor is dropped.
INSTEAD = {
    (0, 1): 0,
    (0, 2): 5,
    (0, 3): 0,
    (1, 0): 10,
    (1, 2): 5,
    (1, 3): 10,
    (2, 0): 7,
    (2, 1): 5,
    (2, 3): 5,
    (3, 0): 2,
    (3, 1): 0,
    (3, 2): 5,
}
#: Into the end, which only an empty or an answered conversation reaches.
LAST = [(0, 0, 0, ""), (1, 0, 10, "II"), (2, 0, 5, "I"), (3, 0, 0, "")]


def initial(role: str) -> int:
    found = INITIALS.find(role[:1]) if role else -1
    return found if found >= 0 else 3


def cheapest(rows: list[tuple[str, int]]) -> tuple[int, str]:
    """Cost and letters of the cheapest edits of a whole conversation of (role, kind)."""
    path, done = Survivors([0]), []
    for role, kind in rows:
        done += path.step(MOVES[initial(role), kind])
    done += path.step(LAST)
    cost, rest = path.rest(0)
    return cost, "".join(done + rest)


def transfer(rows: list[tuple[str, int]]) -> tuple[list[int | None], list[str | None]]:
    """Costs and letters of a segment for each first and last state (4 x 4; null: no way)."""
    costs, letters = [None] * 16, [None] * 16
    for s in STATES:
        path, done = Survivors([s]), []
        for role, kind in rows:
            done += path.step(MOVES[initial(role), kind])
        for t in path.alive:
            cost, rest = path.rest(t)
            costs[4 * s + t], letters[4 * s + t] = cost, "".join(done + rest)
    return costs, letters


def edited(turns: list[tuple[str, str]], letters: str, state: int = 0) -> list[tuple[str, str]]:
    """``turns`` after the edits."""
    out, rows = [], iter(turns)
    for letter in letters:
        role, text = ("", "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        if letter in "IR":
            role = ROLES[state]
        out.append((role, text))
        state = initial(role) + 1
    return out


# --- one pass over sorted rows -------------------------------------------------------------------
TURN = "struct<turn: bigint, role: string, text: string, kind: int>"
PIECE = (
    f"conv_id bigint, whole boolean, part int, seg bigint, turns array<{TURN}>, letters string, "
    "cost bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, least_turn bigint, "
    "last_turn bigint, n_turns bigint, first_role int, last_role int"
)


def _schema() -> pa.Schema:
    turn = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("kind", pa.int32())])
    longs = "cost blank duplicate truncated illegal least_turn last_turn n_turns".split()
    return pa.schema(
        [("conv_id", pa.int64()), ("whole", pa.bool_()), ("part", pa.int32()), ("seg", pa.int64())]
        + [("turns", pa.list_(turn)), ("letters", pa.string())]
        + [(k, pa.int64()) for k in longs]
        + [("first_role", pa.int32()), ("last_role", pa.int32())]
    )


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_schema())


Row = tuple[int | None, str, str, int]  # turn, role, text, kind


def figures(rows: list[Row]) -> dict[str, int | None]:
    """What is counted of the rows of one piece, before its repair."""
    kinds = [r[3] for r in rows]
    roles = [initial(r[1]) for r in rows]
    legal = {(0, 1), (1, 2), (2, 1)}
    turns = sorted({r[0] for r in rows if r[0] is not None})
    return {
        "blank": kinds.count(BLANK_ROW),
        "duplicate": kinds.count(DUPLICATE),
        "truncated": kinds.count(TRUNCATED),
        "illegal": sum(p not in legal for p in zip(roles, roles[1:], strict=False)),
        "least_turn": turns[0] if turns else None,
        "last_turn": turns[-1] if turns else None,
        "n_turns": len(turns),
        "first_role": roles[0] if rows else None,
        "last_role": roles[-1] if rows else None,
    }


def marked(rows: list[Row]) -> list[Row]:
    """Rows of a whole conversation, those seen earlier marked as duplicates."""
    seen, out = set(), []
    for turn, role, text, kind in rows:
        if kind != BLANK_ROW and (role, text) in seen:
            kind = DUPLICATE
        seen.add((role, text))
        out.append((turn, role, text, kind))
    return out


def repaired(rows: list[Row]) -> dict[str, object]:
    rows = marked(rows)
    cost, letters = cheapest([(r[1], r[3]) for r in rows])
    turns = edited([(r[1], r[2]) for r in rows], letters)
    return figures(rows) | {"letters": letters, "cost": cost, "turns": _turns(turns)}


def _turns(turns: list[tuple[str, str]]) -> list[dict]:
    return [{"turn": None, "role": r, "text": t, "kind": None} for r, t in turns]


def first_pass(limit_rows: int, limit_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Conversations within the task repaired; the first and last one, and long ones, as segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seg = TaskContext.get().partitionId(), 0
        current, rows, size = None, [], 0
        first, open_run = True, False  # the first conversation may have begun in an earlier task
        out, held = [], 0

        def segment() -> dict:
            nonlocal seg
            seg += 1
            turns = [dict(zip(("turn", "role", "text", "kind"), r, strict=True)) for r in rows]
            return {"conv_id": current[0], "whole": False, "part": part, "seg": seg, "turns": turns}

        for batch in batches:
            columns = [batch[k].to_pylist() for k in ("conv_id", "turn", "role", "text", "kind")]
            for conv_id, *row in zip(*columns, strict=True):
                if current is None or current[0] != conv_id:
                    if current is not None:
                        if first or open_run:
                            out.append(segment())
                        else:
                            out.append({"conv_id": current[0], "whole": True} | repaired(rows))
                        first = False
                        held += size
                    current, rows, size, open_run = (conv_id,), [], 0, False
                    if held >= limit_bytes or len(out) >= limit_rows:
                        yield _batch(out)
                        out, held = [], 0
                if row[3] == DROPPED:
                    continue
                rows.append(tuple(row))
                size += len(row[2]) + 64
                if len(rows) >= limit_rows or size >= limit_bytes:
                    out.append(segment())
                    yield _batch(out)
                    out, held, rows, size, open_run = [], 0, [], 0, True
        if current is not None:
            out.append(segment())
        if out:
            yield _batch(out)

    return run


def faults(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, kind`` of ``rows(conv_id, turn, role, text, dropped)``; duplicates come later."""
    text = F.col("text")
    return rows.select(
        "conv_id",
        "turn",
        "role",
        "text",
        F.when(F.col("dropped"), F.lit(DROPPED))
        .when(~text.rlike(NOT_BLANK), F.lit(BLANK_ROW))
        .when(~text.rlike(f"[.!?]{BLANK}*\\z"), F.lit(TRUNCATED))
        .otherwise(F.lit(FREE))
        .alias("kind"),
    )


# --- conversations over several tasks --------------------------------------------------------------
SEGMENT = ["conv_id", "part", "seg"]


def _joined(left: DataFrame, right: DataFrame) -> DataFrame:
    """``left`` with the further columns of ``right`` of the same segment; null conversations are equal."""
    keys = [F.col(k).alias(f"{k}_") for k in SEGMENT]
    right = right.select(*keys, *[c for c in right.columns if c not in SEGMENT])
    same = F.col("conv_id").eqNullSafe(F.col("conv_id_"))
    same &= (F.col("part") == F.col("part_")) & (F.col("seg") == F.col("seg_"))
    return left.join(right, same, "left").drop(*[f"{k}_" for k in SEGMENT])


def _duplicates(segments: DataFrame) -> DataFrame:
    """``conv_id, part, seg, fresh``: places in the segment of rows not seen earlier in the conversation.

    Rows meet as digests, the first place of each by partial aggregates, and return by segment, so
    a text that a long conversation repeats is one small row of each task. A place is one number:
    20 bits of task, 33 of segment, 10 of row.
    """
    rows = segments.select(*SEGMENT, F.posexplode("turns").alias("at", "row"))
    text = F.concat(F.octet_length("row.role").cast("string"), F.lit(":"), "row.role", "row.text")
    place = F.shiftleft(F.col("part").cast("long"), 43) + F.shiftleft("seg", 10) + F.col("at")
    thin = rows.select("conv_id", place.alias("place"), F.sha2(text.cast("binary"), 256).alias("d")).select(
        "conv_id",
        "place",
        *[F.conv(F.substring("d", i, 16), 16, -10).cast("long").alias(k) for k, i in (("d1", 1), ("d2", 17))],
    )
    firsts = thin.groupBy("conv_id", "d1", "d2").agg(F.min("place").alias("place"))
    return firsts.groupBy(
        "conv_id",
        F.shiftright("place", 43).cast("int").alias("part"),
        F.shiftright("place", 10).bitwiseAND(F.lit((1 << 33) - 1)).alias("seg"),
    ).agg(F.collect_list(F.col("place").bitwiseAND(F.lit(1023)).cast("int")).alias("fresh"))


def _transfers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments with marked rows, their figures, and what they do from each state to each."""
    for batch in batches:
        for i in range(batch.num_rows):
            got = batch.slice(i, 1).to_pylist()[0]
            fresh = set(got.pop("fresh") or [])
            rows = [
                (
                    x["turn"],
                    x["role"],
                    x["text"],
                    DUPLICATE if x["kind"] != BLANK_ROW and at not in fresh else x["kind"],
                )
                for at, x in enumerate(got["turns"])
            ]
            costs, letters = transfer([(r[1], r[3]) for r in rows])
            order = {x: k for k, x in enumerate(sorted({x for x in letters if x is not None}))}
            turns = [{"role": r[1], "text": r[2]} for r in rows]
            row = {k: got[k] for k in SEGMENT} | figures(rows) | {"turns": turns}
            row |= {"costs": costs, "letters": letters, "ranks": [order.get(x) for x in letters]}
            yield pa.RecordBatch.from_pylist([row], schema=_transfer_schema())


def _transfer_schema() -> pa.Schema:
    turn = pa.struct([("role", pa.string()), ("text", pa.string())])
    longs = "blank duplicate truncated illegal least_turn last_turn n_turns".split()
    return pa.schema(
        [("conv_id", pa.int64()), ("part", pa.int32()), ("seg", pa.int64())]
        + [(k, pa.int64()) for k in longs]
        + [("first_role", pa.int32()), ("last_role", pa.int32()), ("turns", pa.list_(turn))]
        + [("costs", pa.list_(pa.int64())), ("letters", pa.list_(pa.string())), ("ranks", pa.list_(pa.int32()))]
    )


TRANSFER = (
    "conv_id bigint, part int, seg bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
    "least_turn bigint, last_turn bigint, n_turns bigint, first_role int, last_role int, "
    "turns array<struct<role: string, text: string>>, costs array<bigint>, letters array<string>, ranks array<int>"
)
CHOICE = "conv_id bigint, part int, seg bigint, first_state int, last_state int, tail string, cost bigint"
#: Turns inserted after the last row of a conversation are a segment after all others.
AFTER = (1 << 31) - 1


def _choices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The states between segments on the cheapest way through each conversation.

    The tree over segments is the tree over rows: a label is the rank of a segment's letters, with
    its place, states and cost beside it, so ties are compared by complete unresolved suffixes too.
    """
    schema = pa.schema(
        [("conv_id", pa.int64()), ("part", pa.int32()), ("seg", pa.int64()), ("first_state", pa.int32())]
        + [("last_state", pa.int32()), ("tail", pa.string()), ("cost", pa.int64())]
    )
    current, path, out = None, None, []

    def emit(labels: list[tuple]) -> None:
        for _, at, s, t, tail, cost in labels:
            if at[0] != AFTER or tail:
                out.append((current[0], *at, s, t, tail, cost))

    def finish() -> None:
        emit(path.step([(s, t, c, (tail, (AFTER, 0), s, t, tail, c)) for s, t, c, tail in LAST]))
        emit(path.rest(0)[1])

    def ready() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [[]] * len(schema)
        out.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
        )

    for batch in batches:
        for got in batch.to_pylist():
            if current is None or current[0] != got["conv_id"]:
                if current is not None:
                    finish()
                current, path = (got["conv_id"],), Survivors([0], key=lambda label: label[0])
            at = (got["part"], got["seg"])
            moves = []
            for k, cost in enumerate(got["costs"]):
                if cost is not None:
                    s, t = divmod(k, 4)
                    moves.append((s, t, cost, (got["ranks"][k], at, s, t, None, cost)))
            emit(path.step(moves))
        yield ready()
    if current is not None:
        finish()
        yield ready()


def _made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces: segments with the chosen edits made."""
    for batch in batches:
        for i in range(batch.num_rows):
            got = batch.slice(i, 1).to_pylist()[0]
            s = got["first_state"]
            letters = got["tail"] or ""
            if got["letters"] is not None:
                letters = got["letters"][4 * s + got["last_state"]]
            turns = edited([(x["role"], x["text"]) for x in got["turns"] or []], letters, s)
            row = {k: got[k] for k in (*SEGMENT, *FIGURES)} | {"cost": got["cost"], "letters": letters}
            yield _batch([row | {"whole": False, "turns": _turns(turns)}])


FIGURES = "blank duplicate truncated illegal least_turn last_turn n_turns first_role last_role".split()


def repair(rows: DataFrame) -> DataFrame:
    """Repaired pieces (``PIECE``) of ``rows(conv_id, turn, role, text, dropped)``.

    A ``whole`` piece is a conversation. The others follow each other by ``part`` and ``seg``.
    ``turns`` are the repaired turns, ``letters`` the initials of the edits, ``cost`` their cost; what
    is counted (faults, illegal neighbours, turn numbers) is counted before the repair.
    """
    small_batches(rows.sparkSession)
    dealt = faults(rows).repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, DEALT))
    ordered = dealt.sortWithinPartitions("conv_id", "turn", "role", "text")
    first = stored(ordered.mapInArrow(first_pass(SEGMENT_ROWS, SEGMENT_BYTES), PIECE), "repaired")
    segments = first.where("not whole").select(*SEGMENT, "turns")
    known = _joined(segments, _duplicates(segments))
    moves = stored(known.mapInArrow(_transfers, TRANSFER), "segments")
    thin = moves.select(*SEGMENT, "costs", "ranks").repartition("conv_id")
    chosen = thin.sortWithinPartitions(*SEGMENT).mapInArrow(_choices, CHOICE)
    both = _joined(chosen, moves.select(*SEGMENT, "turns", "letters", *FIGURES))
    return first.where("whole").unionByName(both.mapInArrow(_made, PIECE))


# --- one row per conversation ------------------------------------------------------------------------
REPORT = (
    "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
    "cost bigint, audit string, repaired_sha256 string"
)


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order to one row per conversation."""
    names = [x.split()[0] for x in REPORT.split(", ")]
    current, out = None, []

    def finish() -> None:
        spread = last - least + 1 - n_turns if least is not None else 0
        out.append((current[0], spread, *[sums[k] for k in SUMMED], "".join(letters), sha.hexdigest()))

    def ready() -> pa.RecordBatch:
        kinds = [pa.int64()] * 7 + [pa.string()] * 2
        columns = list(zip(*out, strict=True)) or [[]] * len(names)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    for batch in batches:
        for i in range(batch.num_rows):
            got = batch.slice(i, 1).to_pylist()[0]
            if current is None or current[0] != got["conv_id"]:
                if current is not None:
                    finish()
                current, sums = (got["conv_id"],), dict.fromkeys(SUMMED, 0)
                least = last = role = None
                n_turns, letters, sha, some = 0, [], hashlib.sha256(), False
            for k in SUMMED:
                sums[k] += got[k] or 0
            if got["first_role"] is not None:
                if role is not None and (role, got["first_role"]) not in {(0, 1), (1, 2), (2, 1)}:
                    sums["illegal"] += 1
                role = got["last_role"]
            if got["least_turn"] is not None:
                n_turns += got["n_turns"] - (got["least_turn"] == last)
                least = got["least_turn"] if least is None else least
                last = got["last_turn"]
            letters.append(got["letters"])
            for turn in got["turns"]:
                sha.update(f"{chr(10) if some else ''}{turn['role']}:{turn['text']}".encode())
                some = True
        yield ready()
    if current is not None:
        finish()
        yield ready()


SUMMED = ["blank", "duplicate", "truncated", "illegal", "cost"]


def report(pieces: DataFrame) -> DataFrame:
    """One row (``REPORT``) per conversation. Whole pieces are a projection; the rest meet by conversation."""
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    whole = pieces.where("whole").select(
        "conv_id",
        F.coalesce(F.col("last_turn") - F.col("least_turn") + 1 - F.col("n_turns"), F.lit(0)).alias("gaps"),
        *SUMMED[:4],
        "cost",
        F.col("letters").alias("audit"),
        F.sha2(F.array_join(lines, "\n").cast("binary"), 256).alias("repaired_sha256"),
    )
    cut = pieces.where("not whole").repartition("conv_id").sortWithinPartitions(*SEGMENT)
    return whole.unionByName(cut.mapInArrow(_together, REPORT))

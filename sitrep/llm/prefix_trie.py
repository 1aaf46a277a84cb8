"""Prefix trie of conversations: which first turns conversations share, and what sharing saves.

``numbered`` puts the turns of every conversation in order, ``rebuilt`` exchanges the first turns of
a conversation for those of the first conversation of its block of twenty, ``trie`` makes one row
per distinct sequence of first turns.

Method: node table by minimal perfect hash. The digest of a prefix is the exclusive-or of 128-bit
hashes of (turn content, depth), so prefixes of one very long conversation are computed in pieces
(``PIECE`` turns) that tasks do not wait for each other. Conversations, or pieces of long ones, are
dealt to tasks, which cut them into shards of at most ``SHARD`` rows and a piece. In each shard the
distinct digests get slots of a minimal perfect hash; the digest stored in a slot is compared with
the one looked up, and rows of one slot must agree in depth and parent. Counts are scattered into flat
arrays by slot and accumulated through the array of parent slots, deepest nodes first. The sums of
shards that share a node are added by digest; a first turn that a third of all conversations share
is one row per shard there.

What makes shards additive: a node saves its tokens once for each member that does not own it (is
not its smallest). So each conversation brings its own words down to the depth from which it owns
its path, and the leaf at its end if it owns one. Both are known from the first aggregate.

Awkward input: rows with a null ``conv_id`` belong to no conversation and are left out; a null turn
comes first, null role or text is empty; rows of one turn are ordered by role, then text, so
repeated rows are turns one after the other. A conversation rebuilt from nothing is a member of the
root. An empty table has no nodes. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitrep.llm.common import n_words_of, stored

#: Turns of one conversation that meet in one shard.
PIECE = 1 << 16
#: Rows after which a shard is closed at the end of a conversation.
SHARD = 1 << 18
#: Code points of a text by which rows of one turn are dealt to tasks; sorting uses whole texts.
DEALT = 64

NODE = ["a", "b", "pa", "pb", "depth"]
NO_CONVERSATIONS = hashlib.sha256(b"").hexdigest()


# --- turns in order ------------------------------------------------------------------------------
def numbered(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn_no, t1, t2, words``: the turns of every conversation, numbered from 1.

    Rows are dealt by range, so the turns of one conversation may lie in many tasks; each task
    counts its own, and only those counts meet by conversation. ``t1, t2`` are 128 bits of the
    SHA-256 of role and text. Written once; texts are not.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    role = F.coalesce(F.col("role"), F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        text.alias("text"),
    )
    dealt = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, DEALT))
    digest = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    ordered = dealt.sortWithinPartitions("conv_id", "turn", "role", "text").select(
        "conv_id",
        F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().alias("place"),
        digest.alias("digest"),
        n_words_of(F.col("text")).alias("words"),
    )
    thin = stored(
        ordered.select(
            "conv_id",
            "part",
            "place",
            *[F.conv(F.substring("digest", at, 16), 16, -10).cast("long").alias(t) for t, at in (("t1", 1), ("t2", 17))],
            "words",
        ),
        "turns",
    )
    runs = thin.groupBy("conv_id", "part").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    return thin.join(runs, ["conv_id", "part"]).select(
        "conv_id", (F.col("place") - F.col("first") + F.col("before") + 1).alias("turn_no"), "t1", "t2", "words"
    )


def rebuilt(turns: DataFrame, block: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Turns ``conv_id, depth, t1, t2, words`` and lengths ``conv_id, length`` after the exchange.

    Conversation c gets the first h turns of conversation ``c - c % block`` (h: crc32 of its decimal
    number modulo ``most``) and keeps its own from h on. At most ``block`` times ``most - 1`` rows
    come from one conversation.
    """
    c = F.col("conv_id")
    own = turns.groupBy("conv_id").agg(F.max("turn_no").alias("own"))
    of = own.select("conv_id", "own", (c - c % block).alias("base"), (F.crc32(c.cast("string").cast("binary")) % most).alias("h"))
    bases = own.where(c % block == 0).select(c.alias("base"), F.col("own").alias("base_own"))
    of = of.join(bases, "base", "left").withColumn("given", F.least("h", F.coalesce("base_own", F.lit(0))))
    of = stored(of.select("conv_id", "base", "h", "given", (F.col("given") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length")), "rebuilt")
    heads = turns.where((c % block == 0) & (F.col("turn_no") < most)).withColumnRenamed("conv_id", "base")
    given = of.join(heads, "base").where("turn_no <= h").select("conv_id", F.col("turn_no").alias("depth"), "t1", "t2", "words")
    kept = turns.join(of.select("conv_id", "h", "given"), "conv_id").where("turn_no > h")
    kept = kept.select("conv_id", (F.col("turn_no") - F.col("h") + F.col("given")).alias("depth"), "t1", "t2", "words")
    return given.unionByName(kept), of.select("conv_id", "length")


# --- the node table of a shard ---------------------------------------------------------------------
def mixed(a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of digests under a seed."""
    with np.errstate(over="ignore"):
        x = a ^ (b * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64((seed * 0xD1342543DE82EF95) % (1 << 64))
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


class NodeTable:
    """A minimal perfect hash of distinct digests ``(a, b)``: n digests have slots 0 to n - 1.

    Each level hashes the digests still without a slot into twice as many places; those alone in
    their place stay, their slot is the number of taken places before. ``a`` and ``b`` keep the
    digest of every slot, so a lookup is verified and foreign digests are told from known ones.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray):
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.ones(len(a), dtype=bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        a, b = a[new], b[new]
        self.a, self.b = np.empty_like(a), np.empty_like(b)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        done = 0
        while len(a):
            size = 2 * len(a)
            place = (mixed(a, b, len(self.levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(place, minlength=size) == 1
            slots = done - 1 + np.cumsum(alone, dtype=np.int64)
            stay = alone[place]
            at = slots[place[stay]]
            self.a[at], self.b[at] = a[stay], b[stay]
            self.levels.append((alone, slots))
            done += int(stay.sum())
            a, b = a[~stay], b[~stay]

    def __len__(self) -> int:
        return len(self.a)

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of every digest, -1 for digests that are not in the table."""
        out = np.full(len(a), -1, dtype=np.int64)
        left = np.arange(len(a))
        for level, (alone, slots) in enumerate(self.levels):
            place = (mixed(a[left], b[left], level) % np.uint64(len(alone))).astype(np.int64)
            found = alone[place]
            out[left[found]] = slots[place[found]]
            left = left[~found]
        known = out >= 0
        known[known] = (self.a[out[known]] == a[known]) & (self.b[out[known]] == b[known])
        return np.where(known, out, -1)


def subtree_sums(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Nodes of one shard with members and subtree sums. ``rows``: ``NODE, conv_id, piece, saved, leaf``.

    Sums end at the first node of a piece: its parent has them from the rows of the piece before.
    """
    a, b, pa_, pb = (rows[k].view(np.uint64) for k in NODE[:4])
    nodes = NodeTable(a, b)
    at = nodes.slots(a, b)
    depth = np.zeros(len(nodes), dtype=np.int64)
    depth[at] = rows["depth"]
    up = [np.zeros(len(nodes), dtype=np.uint64) for _ in range(2)]
    up[0][at], up[1][at] = pa_, pb
    if ((depth[at] != rows["depth"]) | (up[0][at] != pa_) | (up[1][at] != pb)).any():
        raise ValueError("two prefixes have one digest")
    piece = np.zeros(len(nodes), dtype=np.int64)
    piece[at] = rows["piece"]
    parent = np.where(depth > 0, nodes.slots(*up), -1)
    parent[piece[parent] != piece] = -1
    n = np.bincount(at, minlength=len(nodes)).astype(np.int64)
    least = np.full(len(nodes), np.iinfo(np.int64).max)
    np.minimum.at(least, at, rows["conv_id"])
    saved, leaves = np.zeros(len(nodes), dtype=np.int64), np.zeros(len(nodes), dtype=np.int64)
    np.add.at(saved, at, rows["saved"])
    np.add.at(leaves, at, rows["leaf"])
    order = np.argsort(-depth, kind="stable")
    ends = np.flatnonzero(np.diff(depth[order])) + 1
    for level in np.split(order, ends):  # all nodes of one depth, deepest first
        level = level[parent[level] >= 0]
        np.add.at(saved, parent[level], saved[level])
        np.add.at(leaves, parent[level], leaves[level])
    return {
        "a": nodes.a.view(np.int64),
        "b": nodes.b.view(np.int64),
        "pa": up[0].view(np.int64),
        "pb": up[1].view(np.int64),
        "depth": depth,
        "owner": least,
        "n_convs": n,
        "saved_tokens": saved,
        "n_leaves": leaves,
    }


def sharded(limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Node sums of each shard; rows come sorted by conversation, piece and depth.

    A shard is closed at the end of a piece once it has ``limit`` rows.
    """
    names = [*NODE, "conv_id", "saved", "leaf", "piece"]

    def closed(parts: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
        sums = subtree_sums({k: np.concatenate([p[k] for p in parts]) for k in names})
        return pa.RecordBatch.from_arrays([pa.array(v) for v in sums.values()], list(sums))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        size = 0
        for batch in batches:
            rows = {k: np.array(batch[k].to_numpy(zero_copy_only=False)) for k in names}
            if size >= limit:
                last = held[-1]
                same = (rows["conv_id"] == last["conv_id"][-1]) & (rows["piece"] == last["piece"][-1])
                cut = len(same) if same.all() else int(same.argmin())
                held.append({k: v[:cut] for k, v in rows.items()})
                rows = {k: v[cut:] for k, v in rows.items()}
                if len(rows["a"]):
                    yield closed(held)
                    held, size = [], 0
            if len(rows["a"]):
                held.append(rows)
                size += len(rows["a"])
        if held:
            yield closed(held)

    return run


SUMS = "a long, b long, pa long, pb long, depth long, owner long, n_convs long, saved_tokens long, n_leaves long"


# --- the trie -------------------------------------------------------------------------------------
def prefixes(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """``conv_id, piece, length, NODE, words, t1, t2``: every prefix of every conversation, root included."""
    row = [F.xxhash64("t1", "t2", "depth"), F.xxhash64(F.lit(7), "depth", "t2", "t1")]
    rows = turns.select(
        "conv_id",
        "depth",
        F.floor((F.col("depth") - 1) / PIECE).cast("int").alias("piece"),
        "words",
        "t1",
        "t2",
        row[0].alias("ha"),
        row[1].alias("hb"),
    )
    totals = rows.groupBy("conv_id", "piece").agg(F.bit_xor("ha").alias("a0"), F.bit_xor("hb").alias("b0"))
    earlier = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("conv_id", "piece", *[F.bit_xor(x).over(earlier).alias(x) for x in ("a0", "b0")])
    within = Window.partitionBy("conv_id", "piece").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.select("*", F.bit_xor("ha").over(within).alias("la"), F.bit_xor("hb").over(within).alias("lb"))
    joined = local.join(starts.where("piece > 0"), ["conv_id", "piece"], "left")
    zero = F.lit(0).cast("long")
    a = F.col("la").bitwiseXOR(F.coalesce("a0", zero))
    b = F.col("lb").bitwiseXOR(F.coalesce("b0", zero))
    deep = joined.join(lengths, "conv_id").select(
        "conv_id",
        "piece",
        "length",
        a.alias("a"),
        b.alias("b"),
        a.bitwiseXOR(F.col("ha")).alias("pa"),
        b.bitwiseXOR(F.col("hb")).alias("pb"),
        F.col("depth").cast("long").alias("depth"),
        "words",
        "t1",
        "t2",
    )
    root = lengths.select(
        "conv_id", F.lit(0).alias("piece"), "length", *[zero.alias(k) for k in (*NODE, "words", "t1", "t2")]
    )
    return deep.unionByName(root)


def trie(turns: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and ends of the trie of ``turns(conv_id, depth, t1, t2, words)``.

    Nodes: ``a, b`` (digest), ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``,
    ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``. Ends: ``a, b, conv_id`` for the node
    at which each conversation ends. ``lengths(conv_id, length)`` names every conversation.
    """
    rows = stored(prefixes(turns, lengths), "prefixes")
    clash = F.raise_error(F.lit("two turns have one digest")).cast("long")
    owners = rows.groupBy(*NODE).agg(
        F.min("conv_id").alias("owner"),
        *[F.when(F.min(t) != F.max(t), clash).otherwise(F.lit(0)).alias(f"same_{t}") for t in ("t1", "t2")],
    )
    owners = stored(owners.where("same_t1 = 0 and same_t2 = 0").select(*NODE, "owner"), "owners")
    kids = owners.where("depth > 0").groupBy("pa", "pb").agg(F.count(F.lit(1)).alias("n_children"))
    kids = kids.select(F.col("pa").alias("a"), F.col("pb").alias("b"), "n_children")
    counted = owners.join(kids, ["a", "b"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    counted = stored(counted, "counted")

    # from which depth a conversation owns its path, and whether a leaf ends it
    marks = counted.groupBy("owner").agg(
        F.min("depth").alias("owns"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf")
    )
    marked = rows.join(marks.withColumnRenamed("owner", "conv_id"), "conv_id", "left")
    shared = F.when(F.col("owns").isNull() | (F.col("depth") < F.col("owns")), F.col("words")).otherwise(F.lit(0))
    ends = (F.col("depth") == F.col("length")).cast("long") * F.coalesce("leaf", F.lit(0))
    marked = marked.select("conv_id", "piece", "length", *NODE, shared.alias("saved"), ends.alias("leaf"))

    # what lies below a piece of a long conversation is added to the last row of the piece
    below = Window.partitionBy("conv_id").orderBy(F.col("piece").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        marked.where(F.col("length") > PIECE)
        .groupBy("conv_id", "piece")
        .agg(F.sum("saved").alias("s"), F.sum("leaf").alias("l"), F.max("depth").alias("depth"))
        .select("conv_id", "depth", F.sum("s").over(below).alias("s"), F.sum("l").over(below).alias("l"))
        .where("s is not null")
    )
    zero = F.lit(0).cast("long")
    whole = marked.join(carried, ["conv_id", "depth"], "left").select(
        *NODE,
        "conv_id",
        (F.col("saved") + F.coalesce("s", zero)).alias("saved"),
        (F.col("leaf") + F.coalesce("l", zero)).alias("leaf"),
        "piece",
    )
    dealt = whole.repartition("conv_id", "piece").sortWithinPartitions("conv_id", "piece", "depth")
    sums = dealt.mapInArrow(sharded(SHARD), SUMS).groupBy(*NODE).agg(
        F.min("owner").alias("conv_id"),
        *[F.sum(k).alias(k) for k in ("n_convs", "saved_tokens", "n_leaves")],
    )
    sums = sums.join(counted.select("a", "b", "n_children"), ["a", "b"])
    parents = counted.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("owner").alias("parent_conv_id"))
    # below the top of its chain a node has its parent's owner; only tops look theirs up
    chain = marks.select(F.col("owner").alias("conv_id"), "owns")
    placed = sums.join(chain, "conv_id")
    lower = placed.where("depth > owns").withColumn("parent_conv_id", F.col("conv_id"))
    tops = placed.where("depth = owns and depth > 0").join(parents, ["pa", "pb"])
    root = placed.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    out = [
        x.select("a", "b", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
        for x in (lower, tops, root)
    ]
    nodes = out[0].unionByName(out[1]).unionByName(out[2])
    return nodes, rows.where("depth = length").select("a", "b", "conv_id")


def ends_digest(ends: DataFrame) -> DataFrame:
    """``a, b, ends_sha256``: SHA-256 of the ascending, comma-joined ids of conversations that end there.

    Ids are dealt by range and joined into texts within a task; one task then hashes the texts of a
    node one after the other, in order, holding one of them.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "first", "ids"]
        for batch in batches:
            out: list[list] = []
            for a, b, c in zip(*(batch[k].to_pylist() for k in ("a", "b", "conv_id")), strict=True):
                if out and out[-1][0] == a and out[-1][1] == b:
                    out[-1][3].append(str(c))
                else:
                    out.append([a, b, c, [str(c)]])
            columns = [[r[0] for r in out], [r[1] for r in out], [r[2] for r in out], [",".join(r[3]) for r in out]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)],
                names,
            )

    dealt = ends.repartitionByRange("a", "b", "conv_id").sortWithinPartitions("a", "b", "conv_id")
    texts = dealt.mapInArrow(joined, "a long, b long, first long, ids string")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for batch in batches:
            out = []
            for a, b, ids in zip(*(batch[k].to_pylist() for k in ("a", "b", "ids")), strict=True):
                if (a, b) == key:
                    sha.update(b"," + ids.encode())
                    continue
                if key is not None:
                    out.append((*key, sha.hexdigest()))
                key, sha = (a, b), hashlib.sha256(ids.encode())
            yield _digests(out)
        if key is not None:
            yield _digests([(*key, sha.hexdigest())])

    together = texts.repartition("a", "b").sortWithinPartitions("a", "b", "first")
    return together.mapInArrow(hashed, "a long, b long, ends_sha256 string")


def _digests(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for r in rows], pa.int64()),
            pa.array([r[1] for r in rows], pa.int64()),
            pa.array([r[2] for r in rows], pa.string()),
        ],
        ["a", "b", "ends_sha256"],
    )


def nodes_of(conversations: DataFrame) -> DataFrame:
    """The nodes of the rebuilt conversations, with the digest of the conversations that end there."""
    nodes, ends = trie(*rebuilt(numbered(conversations)))
    out = nodes.join(ends_digest(ends), ["a", "b"], "left").drop("a", "b")
    return out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_CONVERSATIONS)))

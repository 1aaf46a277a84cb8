"""Documents that share most of their word n-grams: a blocked sparse product of incidences.

A document's row of the incidence matrix has its distinct n-grams as columns. Two documents link
when ``100 * intersection >= percent * union``, for n-grams of ``words`` words; the product of the matrix with its transpose would
hold all intersections. Size-derived bounds keep it sparse:

* equal rows are one row (a node) from the start;
* linked rows must meet in their first ``n - ceil(t n) + 1`` columns under any common order of
  columns (``t`` the threshold), so only these enter the product. The order puts heavy columns
  last (a bounded, broadcast set) and follows a hash otherwise;
* pairs whose sizes or column positions cannot reach the overlap they need are discarded, and
  after all blocks of columns are summed, so are pairs whose overlap is below its bound;
* rows known to be connected need no product. A first round links every node to one hub of each
  of its smallest column hashes, where the link holds, so that a group of thousands of near
  copies is one component before pairs are formed.

Every remaining pair is verified on its whole texts; no pair is dropped otherwise. Intersections
count 64-bit hashes of n-grams, and nodes are named by a 64-bit hash of their row.

Empty and null texts have no n-grams and link with nothing. A text of fewer words than ``n`` has
one n-gram, all of it. Rows with one ``doc_id`` are taken as one document with several texts, all
of which link it. Empty tables give no rows; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitrep.llm.common import small_batches, stored, utf8
from sitrep.llm.graph import components
from sitrep.llm.heavy import contained, heavy_keys

#: Words of an n-gram and least similarity, unless a caller asks for others.
WORDS = 4
PERCENT = 85
#: Smallest column hashes by which the first round links a node.
SKETCH = 6
#: Columns with a larger share of all entries come last; there are at most ``1 / HEAVY_SHARE``.
HEAVY_SHARE = 3e-6
#: Bytes of text for each group of texts or columns.
GROUP_BYTES = 1 << 20

#: Bytes of text whose words are hashed at a time; a longer text is one piece.
CHUNK = 1 << 20

U = np.uint64
ENTRY = np.dtype([("g", "<u8"), ("node", "<i8"), ("part", "<i8"), ("n", "<i4"), ("at", "<i4")])
PAIR = np.dtype(
    [("a", "<i8"), ("b", "<i8"), ("na", "<i4"), ("nb", "<i4"), ("ia", "<i4"), ("ib", "<i4"), ("c", "<i4")]
)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
FACTORS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(32))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, lower-cased, and the bounds of every row's words."""
    inside = ~_BLANK[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts[firsts] = inside[firsts]
    start = np.flatnonzero(starts)
    bounds = np.searchsorted(start, offsets)
    if not len(start):
        return np.zeros(0, U), bounds
    word = np.cumsum(starts) - 1
    place = (np.arange(len(data)) - start[np.maximum(word, 0)]).astype(U)
    letters = np.where(inside, mixed((_LOWER[data].astype(U) << U(32)) + place + U(7)), U(0))
    return mixed(np.add.reduceat(letters, start)), bounds


def rows_of(data: np.ndarray, offsets: np.ndarray, n: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of every row, some texts at a time."""
    out: list[np.ndarray] = []
    lo = 0
    while lo < len(offsets) - 1:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK, side="right")) - 1)
        out += _rows_of(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], n)
        lo = hi
    return out


def _rows_of(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    w, bounds = word_hashes(data, offsets)
    grams = np.zeros(max(0, len(w) - n + 1), U)
    for k in range(n):
        grams = grams * U(FACTORS[0]) + mixed(w[k : k + len(grams)] + U(k))
    grams = mixed(grams)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            h = np.array([b - a], U)
            for k in range(a, b):
                h = mixed(h * U(FACTORS[1]) + w[k : k + 1])
            out.append(h)
        else:
            out.append(np.zeros(0, U))
    return out


def node_of(row: np.ndarray) -> int:
    total = mixed(row ^ U(FACTORS[2])).sum(dtype=U, keepdims=True)
    return int(mixed(total * U(FACTORS[3]) + U(len(row))).view(np.int64)[0])


@dataclass(frozen=True)
class Rule:
    """What links: n-grams of ``words`` words, and at least ``percent`` of the union in common."""

    words: int = WORDS
    percent: int = PERCENT

    def __post_init__(self):
        if self.words < 1 or not 0 < self.percent <= 100:
            raise ValueError("words must be positive, percent between 1 and 100")

    def prefix(self, n: np.ndarray) -> np.ndarray:
        """How many first columns of a row of ``n`` must meet those of a linked row."""
        return n - -(-self.percent * n // 100) + 1

    def needed(self, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
        """The overlap at which rows of these sizes link."""
        return -(-self.percent * (na + nb) // (100 + self.percent))

    def linked(self, both: int, na: int, nb: int) -> bool:
        return 100 * both >= self.percent * (na + nb - both)


def sketched(docs: DataFrame, heavy: np.ndarray, rule: Rule) -> DataFrame:
    """``doc_id, n_shingles, node, rare, keys``: size, name, share of columns that are not heavy,
    and smallest column hashes of every row."""
    held = docs.sparkSession.sparkContext.broadcast(heavy)  # at most 1 / HEAVY_SHARE hashes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = rows_of(*utf8(b["text"]), rule.words)
            yield pa.RecordBatch.from_arrays(
                [
                    b["doc_id"],
                    pa.array([len(r) for r in rows], pa.int64()),
                    pa.array([node_of(r) if len(r) else None for r in rows], pa.int64()),
                    pa.array([1 - contained(r, held.value).sum() / max(1, len(r)) for r in rows], pa.float64()),
                    pa.array([r[:SKETCH].view(np.int64) for r in rows], pa.list_(pa.int64())),
                ],
                ["doc_id", "n_shingles", "node", "rare", "keys"],
            )

    schema = "doc_id long, n_shingles long, node long, rare double, keys array<long>"
    return docs.mapInArrow(run, schema)


def star_pairs(nodes: DataFrame, rule: Rule) -> DataFrame:
    """``a, b``: every node with one hub of each of its sketch columns, if sizes allow.

    The hub is the node with the smallest share of rare columns: in a large group of near copies
    edits are rare, so it is the text that the others were made from, or close to it. Once among
    all nodes of a column and once among those of about its size.
    """
    # at 100 percent all linked rows are of one size
    step = -math.log(min(rule.percent, 99) / 100)
    rows = nodes.select("node", "n", "rare", F.explode("keys").alias("g"))
    keyed = rows.withColumn("size_class", F.floor(F.log("n") / F.lit(step))).unionAll(
        rows.withColumn("size_class", F.lit(-1).cast("long"))
    )
    smallest = (
        keyed.groupBy("g", "size_class")
        .agg(F.min(F.struct("rare", "node", "n")).alias("hub"), F.count("*").alias("m"))
        .where("m > 1")
    )
    met = keyed.join(smallest, ["g", "size_class"]).select(
        F.col("node").alias("a"), F.col("hub.node").alias("b"), "n", F.col("hub.n").alias("hub_n")
    )
    fits = 100 * F.least("n", "hub_n") >= rule.percent * F.greatest("n", "hub_n")
    return met.where((F.col("a") != F.col("b")) & fits).select("a", "b").distinct()


def texts(docs: DataFrame, groups: int) -> DataFrame:
    """``key, doc_id, z``: texts, compressed for the shuffle, in groups by ``doc_id``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for b in batches:
            data, offsets = utf8(b["text"])
            joined = data.tobytes()
            z = [press.compress(joined[x:y]) for x, y in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b["key"], b["doc_id"], pa.array(z, pa.binary())], ["key", "doc_id", "z"]
            )

    return docs.select(_group("doc_id", groups).alias("key"), "doc_id", "text").mapInArrow(
        run, "key long, doc_id long, z binary"
    )


def _group(column: str, groups: int):
    return F.pmod(F.xxhash64(column), F.lit(groups))


def _rows(z: list[bytes], n: int) -> list[np.ndarray]:
    unpress = zstandard.ZstdDecompressor()
    plain = [unpress.decompress(x) for x in z]
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in plain], dtype=np.int64)])
    return rows_of(np.frombuffer(b"".join(plain), np.uint8), offsets, n)


def verified(docs: DataFrame, pairs: DataFrame, groups: int, rule: Rule) -> DataFrame:
    """The pairs ``a, b`` (with their ``doc_a, doc_b``) whose whole texts link."""
    per_task = 400
    tasks = pairs.count() // per_task + 13
    # pairs of one hub stay together in runs, so its text travels once for each run
    sizes = pairs.groupBy("b").agg(F.ceil(F.count("*") / per_task).cast("long").alias("runs"))
    dealt = pairs.join(sizes, "b").withColumn("run", F.pmod(F.xxhash64("a"), F.col("runs")))
    dealt = stored(
        dealt.select("a", "b", "doc_a", "doc_b", F.pmod(F.xxhash64("b", "run"), F.lit(tasks)).alias("task")),
        "pairs",
    )
    asked = dealt.select("task", F.col("doc_a").alias("doc_id")).unionAll(
        dealt.select("task", F.col("doc_b").alias("doc_id"))
    )
    asked = asked.distinct().withColumn("key", _group("doc_id", groups))

    def fetch(z: pa.Table, wanted: pa.Table) -> pa.Table:
        out = wanted.select(["task", "doc_id"]).join(z.select(["doc_id", "z"]), "doc_id", join_type="inner")
        return out.select(["task", "doc_id", "z"])

    def check(got: pa.Table, asked: pa.Table) -> pa.Table:
        # a document with several texts gives the text of the node
        row = {node_of(r): r for r in _rows(got["z"].to_pylist(), rule.words) if len(r)}
        keep = []
        for a, b in zip(asked["a"].to_pylist(), asked["b"].to_pylist(), strict=True):
            x, y = row[a], row[b]
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(rule.linked(both, len(x), len(y)))
        return asked.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    fetched = (
        texts(docs, groups)
        .groupBy("key")
        .cogroup(asked.groupBy("key"))
        .applyInArrow(fetch, "task long, doc_id long, z binary")
    )
    found = fetched.groupBy("task").cogroup(dealt.groupBy("task")).applyInArrow(check, "a long, b long")
    return stored(found, "links")


def _cut(keys: list[np.ndarray]) -> np.ndarray:
    """Bounds of runs of equal keys."""
    if not len(keys[0]):
        return np.zeros(1, np.int64)
    new = np.ones(len(keys[0]), dtype=bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.append(np.flatnonzero(new), len(new))


def _packed(key: np.ndarray, rows: np.ndarray) -> pa.Table:
    order = np.argsort(key, kind="stable")
    key, rows = key[order], rows[order]
    cut = _cut([key])
    spans = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
    blobs = [b"".join(rows[a:b][f].tobytes() for f in rows.dtype.names) for a, b in spans]
    return pa.table({"key": pa.array(key[cut[:-1]], pa.int64()), "data": pa.array(blobs, pa.binary())})


def _unpacked(t: pa.Table, dtype: np.dtype) -> np.ndarray:
    data = t["data"].to_pylist()
    out = np.empty(sum(len(d) for d in data) // dtype.itemsize, dtype)
    at = 0
    for d in data:
        n, place = len(d) // dtype.itemsize, 0
        for f in dtype.names:
            out[f][at : at + n] = np.frombuffer(d, dtype[f], n, place)
            place += n * dtype[f].itemsize
        at += n
    return out


def _products(e: np.ndarray, rule: Rule) -> np.ndarray:
    """Partial overlaps of all pairs of unconnected rows that meet in some columns, and the last
    positions at which they meet.

    In each column the rows outside its largest part meet the others; the largest part, most of a
    column that a family of copies shares, is never compared with itself.
    """
    e = e[np.lexsort((e["n"], e["g"]))]
    found = []
    cut = _cut([e["g"]])
    many = np.flatnonzero(np.diff(cut) > 1)
    for lo, hi in zip(cut[many].tolist(), cut[many + 1].tolist(), strict=True):
        x = e[lo:hi]
        if (x["part"] == x["part"][0]).all():
            continue
        part, counts = np.unique(x["part"], return_inverse=True, return_counts=True)[1:]
        largest = part == counts.argmax()
        # rows by size: a row meets only those whose size can still link with its own
        n = x["n"].astype(np.int64)
        least = np.searchsorted(n, -(-n * rule.percent // 100), side="left")
        greatest = np.searchsorted(n, n * 100 // rule.percent, side="right")
        for i in np.flatnonzero(~largest).tolist():
            span = slice(least[i], greatest[i])
            # two rows outside the largest part meet once, from the first of them
            later = np.arange(least[i], greatest[i]) > i
            y = x[span][(part[span] != part[i]) & (largest[span] | later)]
            need = rule.needed(n[i], y["n"].astype(np.int64))
            most = (
                np.minimum(x["at"][i], y["at"])
                + 1
                + np.minimum(x["n"][i] - x["at"][i], y["n"] - y["at"])
                - 1
            )
            y = y[most >= need]
            if not len(y):
                continue
            p = np.empty(len(y), PAIR)
            first = x["node"][i] < y["node"]
            for name, other, own in (("a", "b", "node"), ("na", "nb", "n"), ("ia", "ib", "at")):
                p[name] = np.where(first, x[own][i], y[own])
                p[other] = np.where(first, y[own], x[own][i])
            p["c"] = 1
            found.append(p)
    return _summed(np.concatenate(found)) if found else np.empty(0, PAIR)


def _summed(p: np.ndarray) -> np.ndarray:
    p = p[np.lexsort((p["b"], p["a"]))]
    cut = _cut([p["a"], p["b"]])
    out = p[cut[:-1]].copy()
    if len(out):
        out["c"] = np.add.reduceat(p["c"], cut[:-1])
        for last in ("ia", "ib"):
            out[last] = np.maximum.reduceat(p[last], cut[:-1])
    return out


def candidate_pairs(
    docs: DataFrame, nodes: DataFrame, heavy: np.ndarray, groups: int, rule: Rule
) -> DataFrame:
    """``a, b``: pairs of nodes of different parts whose overlap can reach what they need.

    ``nodes`` has ``node, n, doc_id, part``; ``doc_id`` is the document that gives its text.
    """
    held = docs.sparkSession.sparkContext.broadcast(heavy)  # at most 1 / HEAVY_SHARE hashes

    def incidence(z: pa.Table, known: pa.Table) -> pa.Table:
        t = known.select(["doc_id", "node", "part"]).join(z.select(["doc_id", "z"]), "doc_id", join_type="inner")
        parts = []
        node, part = t["node"].to_pylist(), t["part"].to_pylist()
        for k, row in enumerate(_rows(t["z"].to_pylist(), rule.words)):
            last = contained(row, held.value)
            # a document with several texts gives the text of its node
            if node_of(row) != node[k]:
                continue
            first = np.concatenate([row[~last], row[last]])[: rule.prefix(len(row))]
            e = np.empty(len(first), ENTRY)
            e["g"], e["node"], e["part"], e["n"] = first, node[k], part[k], len(row)
            e["at"] = np.arange(len(first))
            parts.append(e)
        e = np.concatenate(parts) if parts else np.empty(0, ENTRY)
        return _packed((mixed(e["g"]) % U(groups)).astype(np.int64), e)

    def multiply(t: pa.Table) -> pa.Table:
        p = _products(_unpacked(t, ENTRY), rule)
        return _packed((mixed(p["a"].view(U) * U(3) + p["b"].view(U)) % U(groups)).astype(np.int64), p)

    def accumulate(t: pa.Table) -> pa.Table:
        p = _summed(_unpacked(t, PAIR))
        na, nb = p["na"].astype(np.int64), p["nb"].astype(np.int64)
        # what is not counted here follows the last column that is, in both rows; and it lies
        # beyond the prefix of one of them
        rest = np.minimum(na - 1 - p["ia"], nb - 1 - p["ib"])
        rest = np.minimum(rest, np.maximum(na - rule.prefix(na), nb - rule.prefix(nb)))
        p = p[p["c"] + rest >= rule.needed(na, nb)]
        return pa.table({"a": p["a"], "b": p["b"]})

    entries = (
        texts(docs, groups)
        .groupBy("key")
        .cogroup(nodes.withColumn("key", _group("doc_id", groups)).groupBy("key"))
        .applyInArrow(incidence, "key long, data binary")
    )
    sums = entries.groupBy("key").applyInArrow(multiply, "key long, data binary")
    return sums.groupBy("key").applyInArrow(accumulate, "a long, b long")


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``doc_id, text``.

    Texts link that have ``percent`` of all their n-grams of ``words`` words in common, or more.
    """
    rule = Rule(words, percent)
    small_batches(docs.sparkSession)
    docs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = size // GROUP_BYTES + 13
    heavy = heavy_keys(
        docs.select("text"),
        lambda b: np.concatenate([np.zeros(0, U), *rows_of(*utf8(b["text"]), words)]),
        HEAVY_SHARE,
    )
    sketches = stored(sketched(docs, heavy, rule), "sketches")
    with_words = sketches.where("node is not null and doc_id is not null")
    nodes = stored(
        with_words.groupBy("node").agg(
            F.min("doc_id").alias("doc_id"),
            F.first("n_shingles").alias("n"),
            F.first("rare").alias("rare"),
            F.first("keys").alias("keys"),
        ),
        "nodes",
    )
    place = nodes.select("node", "doc_id")

    def with_texts(pairs: DataFrame) -> DataFrame:
        return pairs.join(place.withColumnsRenamed({"node": "a", "doc_id": "doc_a"}), "a").join(
            place.withColumnsRenamed({"node": "b", "doc_id": "doc_b"}), "b"
        )

    stars = verified(docs, with_texts(star_pairs(nodes, rule)), groups, rule)
    ids = nodes.select(F.col("node").alias("id"))
    parts = components(ids, stars).select(F.col("id").alias("node"), F.col("component_id").alias("part"))
    labelled = stored(nodes.drop("keys", "rare").join(parts, "node"), "parts")
    candidates = stored(candidate_pairs(docs, labelled, heavy, groups, rule), "candidates")
    rest = verified(docs, with_texts(candidates), groups, rule)
    whole = components(ids, stars.unionAll(rest)).select(
        F.col("id").alias("node"), F.col("component_id").alias("part")
    )
    grouped = with_words.select("doc_id", "node").join(whole, "node")
    smallest = grouped.groupBy("part").agg(F.min("doc_id").alias("component_id"))
    found = grouped.join(smallest, "part").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    return sketches.select("doc_id", "n_shingles").join(found, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )

"""Near-duplicate embeddings by cross-polytope hashing with multiprobe buckets.

Vectors are compared inside their label only. Equal vectors become one class first, so a vector
that a third of the rows share is one row afterwards. Class vectors are scaled to length one and
turned by pseudo-random rotations, each three rounds of sign flips and a fast Hadamard transform;
the largest coordinate with its sign is the hash. A table joins ``hashes`` such values to a bucket
and also probes the next best buckets. Vectors that meet in a bucket are verified by their cosine
in double precision. A pair that meets in several buckets is counted in the first of them, so
numbers of links add up without pairs ever being written; of the links only one per vector and
bucket (to the smallest linked id) leaves the task, which is all that components need.

A bucket larger than ``block`` is cut into blocks, and every pair of blocks is a task's work of
its own. Nothing is capped: the tables decide which pairs meet, blocks only how they are compared.

Vectors that are null, zero, or hold null or non-finite components, and vectors without a label,
link with nothing. So do vectors of different lengths. Rows that repeat an id together with its
vector count as other vectors of the same class; an id over different vectors is one node of the
links, and each of its rows counts the links of all of them. Every row has one row in the result,
also with a null id; a vector of which no row has an id links with equal ones only. Empty tables give no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitrep.llm.common import small_batches, stored
from sitrep.llm.graph import components

THRESHOLD = 0.98
PROBES = 3
#: The share of pairs at the threshold that meet in some bucket; closer pairs meet more surely.
RECALL = 0.9999
#: A bucket should hold about this many classes of evenly spread vectors.
BUCKET = 64
#: Classes of one bucket compared in one piece.
BLOCK = 1024
SEED = 29


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Hadamard transform of rows whose length is a power of two."""
    n, d = x.shape
    step = 1
    while step < d:
        y = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        step *= 2
    return x / np.sqrt(d)


def rotated(x: np.ndarray, table: int, turn: int) -> np.ndarray:
    """Rows turned by pseudo-random rotation ``(table, turn)``, padded to a power of two."""
    d = 1 << max(0, (x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), d))
    y[:, : x.shape[1]] = x
    signs = np.random.default_rng([SEED, table, turn, d]).choice([-1.0, 1.0], size=(3, d))
    for s in signs:
        y = hadamard(y * s)
    return y


def buckets_of(x: np.ndarray, table: int, hashes: int, probes: int) -> np.ndarray:
    """Bucket numbers of rows in one table: the own bucket and ``probes - 1`` further ones.

    A further bucket replaces one hash by its second best value; those that lose least come first.
    """
    n = len(x)
    best = np.empty((n, hashes), dtype=np.int64)
    second, loss = best.copy(), np.empty((n, hashes))
    rows, d = np.arange(n), 1
    for turn in range(hashes):
        y = rotated(x, table, turn)
        d = y.shape[1]
        size = np.abs(y)
        top = np.argpartition(-size, min(1, d - 1), axis=1)[:, :2] if d > 1 else np.zeros((n, 2), int)
        swap = size[rows, top[:, 0]] < size[rows, top[:, 1]]
        first = np.where(swap, top[:, 1], top[:, 0])
        other = np.where(swap, top[:, 0], top[:, 1])
        best[:, turn] = 2 * first + (y[rows, first] < 0)
        second[:, turn] = 2 * other + (y[rows, other] < 0)
        loss[:, turn] = size[rows, first] - size[rows, other]
    radix = (2 * d) ** np.arange(hashes, dtype=np.int64)
    own = best @ radix
    order = np.argsort(loss, axis=1)
    out = np.empty((n, probes), dtype=np.int64)
    out[:, 0] = own
    for k in range(1, probes):
        if k <= hashes:
            at = order[:, k - 1]
            out[:, k] = own + (second[rows, at] - best[rows, at]) * radix[at]
        else:
            out[:, k] = own
    return out


def tables_for(dim: int, hashes: int, probes: int, threshold: float, recall: float) -> int:
    """Tables that let a pair at the threshold meet with probability ``recall``, by trial."""
    draw = np.random.default_rng(SEED)
    a = draw.normal(size=(2000, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = draw.normal(size=a.shape)
    side -= (side * a).sum(1, keepdims=True) * a
    side /= np.maximum(np.linalg.norm(side, axis=1, keepdims=True), 1e-300)
    b = threshold * a + np.sqrt(1 - threshold**2) * side
    x, y = buckets_of(a, 0, hashes, probes), buckets_of(b, 0, hashes, probes)
    met = (x[:, :, None] == y[:, None, :]).any(axis=(1, 2)).mean()
    met = min(max(float(met), 1e-3), 1 - 1e-3)
    return max(1, int(np.ceil(np.log(1 - recall) / np.log(1 - met))))


def can_link() -> Column:
    """Whether a row of ``embedding, label`` can link: a label, and finite components, not all zero."""
    v = F.col("embedding").cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    sound = v.isNotNull() & F.col("label").isNotNull() & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0)
    return F.coalesce(sound, F.lit(False))


def linkable(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, v`` of the rows that can link; the label also names the length."""
    v = F.col("embedding").cast("array<double>")
    return vectors.where(can_link()).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.concat_ws("/", F.size("embedding"), F.col("label").cast("string")).alias("label"),
        # adding zero turns minus zero into zero, so that equal vectors are equal bit by bit
        F.transform(v, lambda x: x + F.lit(0.0)).alias("v"),
    )


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _new_pairs(
    x: np.ndarray, left: np.ndarray, right: np.ndarray, table: int, code: int, hashes: int, probes: int
) -> np.ndarray:
    """Of pairs of rows, those that share no bucket before bucket ``code`` of ``table``."""
    keep = np.ones(len(left), dtype=bool)
    used, place = np.unique(np.concatenate([left, right]), return_inverse=True)
    left, right = place[: len(left)], place[len(left) :]
    for t in range(table + 1):
        codes = buckets_of(x[used], t, hashes, probes)
        live = np.flatnonzero(keep)
        for at in range(0, len(live), 100_000):
            some = live[at : at + 100_000]
            same = codes[left[some]][:, :, None] == codes[right[some]][:, None, :]
            if t == table:
                same &= codes[left[some]][:, :, None] < code
            keep[some] &= ~same.any(axis=(1, 2))
    return keep


def _roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest row that each row is joined with, directly or through others."""
    root = np.arange(n)
    while len(left):
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        root = root[root]
        if (root == before).all():
            break
    return root


def _compare(rows: pa.Table, threshold: float, hashes: int, probes: int) -> pa.Table:
    """Numbers of links and local roots of the rows of some buckets or pairs of blocks."""
    keys = [("label", "ascending"), ("tab", "ascending"), ("code", "ascending"),
            ("i", "ascending"), ("j", "ascending"), ("class_id", "ascending")]
    rows = rows.sort_by(keys)
    ids, n = rows["class_id"].to_numpy(), rows["n"].to_numpy()
    tabs, codes, part = (rows[c].to_numpy() for c in ("tab", "code", "part"))
    own = [rows[k].to_numpy(zero_copy_only=False) for k, _ in keys[:5]]
    new = np.ones(len(ids), dtype=bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in own])
    starts = np.append(np.flatnonzero(new), len(ids))
    out_ids, out_links, out_root = [], [], []
    for lo, hi in zip(starts[:-1], starts[1:], strict=True):
        if hi - lo < 2:
            continue
        x = _unit(_matrix(rows["v"].slice(lo, hi - lo)))
        near = np.triu(x @ x.T >= threshold, 1)
        if own[3][lo] != own[4][lo]:  # two blocks meet: pairs inside a block are another task's
            near &= part[lo:hi][:, None] != part[lo:hi][None, :]
        left, right = np.nonzero(near)
        if not len(left):
            continue
        keep = _new_pairs(x, left, right, int(tabs[lo]), int(codes[lo]), hashes, probes)
        left, right = left[keep], right[keep]
        links = np.bincount(left, n[lo:hi][right], hi - lo) + np.bincount(
            right, n[lo:hi][left], hi - lo
        )
        got = np.flatnonzero(links)
        out_ids.append(ids[lo:hi][got])
        out_links.append(links[got])
        out_root.append(ids[lo:hi][_roots(hi - lo, left, right)[got]])
    cat = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts]).astype(np.int64)
    return pa.table({"a": cat(out_ids), "links": cat(out_links), "b": cat(out_root)})


def near_duplicates(
    vectors: DataFrame,
    threshold: float = THRESHOLD,
    probes: int = PROBES,
    recall: float = RECALL,
    bucket: int = BUCKET,
    block: int = BLOCK,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vec_id, embedding, label``."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = linkable(vectors)
    classes = stored(
        rows.groupBy("label", "v").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("n")),
        "vector-classes",
    )
    # one row of figures for each label and length; only the largest of each reach the driver
    shape = (
        classes.groupBy("label")
        .agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"))
        .agg(F.max("n").alias("n"), F.max("dim").alias("dim"), F.sum("n").alias("total"))
        .first()
    )
    dim, largest, total = shape["dim"] or 1, shape["n"] or 0, shape["total"] or 0
    width = 2 * (1 << max(0, (dim - 1).bit_length()))
    hashes = max(1, int(np.ceil(np.log(max(largest / bucket, 1)) / np.log(width))))
    tables = tables_for(dim, hashes, probes, threshold, recall)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.array([len(v) for v in b["v"]])
            for size in np.unique(sizes):
                same = b.filter(pa.array(sizes == size))
                x = _unit(_matrix(same["v"]))
                for t in range(tables):
                    codes = buckets_of(x, t, hashes, probes)
                    for p in range(probes):
                        fresh = (codes[:, :p] != codes[:, p : p + 1]).all(axis=1)
                        kept = same.filter(pa.array(fresh))
                        yield pa.RecordBatch.from_arrays(
                            [
                                kept["label"], kept["v"], kept["class_id"], kept["n"],
                                pa.array(np.full(kept.num_rows, t), pa.int32()),
                                pa.array(codes[fresh, p], pa.int64()),
                            ],
                            ["label", "v", "class_id", "n", "tab", "code"],
                        )

    probed = classes.where("class_id is not null").mapInArrow(
        hashed, "label string, v array<double>, class_id long, n long, tab int, code long"
    )
    place = ["label", "tab", "code"]
    # buckets larger than a block, and into how many blocks each is cut
    large = (
        probed.groupBy(*place)
        .agg(F.count("*").alias("m"))
        .where(F.col("m") > block)
        .select(*place, F.ceil(F.col("m") / block).cast("int").alias("blocks"))
    )
    dealt = probed.join(large, place, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int"))
    cells = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        *place, "v", "class_id", "n", "part", "blocks",
        F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"),
    )
    groups = max(1, total * tables * probes // 4000)
    together = F.when(
        F.col("blocks") == 1, F.pmod(F.xxhash64(*place), F.lit(groups))
    ).otherwise(F.xxhash64(*place, "i", "j"))
    found = stored(
        cells.withColumn("task", together)
        .drop("blocks")
        .groupBy("task")
        .applyInArrow(
            lambda t: _compare(t, threshold, hashes, probes), "a long, links long, b long"
        ),
        "vector-links",
    )
    linked = found.groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "id")
    nodes = classes.where("class_id is not null").select(F.col("class_id").alias("id")).distinct()
    of_class = components(nodes, found.select("a", "b")).join(linked, "id", "left")
    known = rows.join(classes, ["label", "v"]).select(
        "vec_id", F.col("class_id").alias("id"), (F.col("n") - 1).alias("copies")
    )
    # every row finds its own class, so rows that share an id are not joined with each other
    known = known.join(of_class, "id", "left").select(
        "vec_id",
        (F.col("copies") + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    )
    vec_id = F.col("vec_id").cast("long")
    alone = vectors.where(~can_link()).select(
        vec_id.alias("vec_id"), F.lit(0).cast("long").alias("n_links"), vec_id.alias("component_id")
    )
    return known.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))

"""Quality classifier: a factorisation machine over hashed words, text structure and metadata.

A document's features are hashed words (damped counts, scaled to length one), intervals of
structure statistics (means, ratios and counts of the text) and of the recorded length. Every
feature has a weight and a short vector; the score adds the inner products of all pairs of
vectors, in linear time by the identity ``sum_{i<j} <v_i,v_j> x_i x_j =
((sum v x)^2 - sum (v x)^2) / 2``. The model is fitted on a bounded sample of labelled rows
(``max_rows`` by hash of ``doc_id``) and has a fixed size; scoring is one pass without a shuffle.

Null texts are scored as empty ones, a null ``n_chars`` as an interval of its own. Rows with the
same text and ``n_chars`` get the same score. Without labelled rows every score is the neutral
0.5. Empty tables give no rows; extra columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitrep.llm.common import small_batches

#: Bound of the training sample; about this many rows reach the driver, as hashed features.
MAX_ROWS = 20_000
#: Buckets of hashed words.
BUCKETS = 1 << 14
RANK = 8
EPOCHS = 8
BATCH = 256
RATE = 0.08
DECAY = 1e-5
SEED = 17
#: Intervals of each structure statistic, set by quantiles of the sample.
INTERVALS = 16
#: Words whose buckets a task remembers.
CACHED_WORDS = 300_000
CUT = 0.7

STATISTICS = (
    "words", "chars_per_word", "distinct_words", "top_word", "symbols", "digits", "upper",
    "punctuation", "lines", "distinct_lines", "words_per_line", "recorded_chars",
)
_SYMBOL = re.compile(r"[#*$%&|<>{}\[\]\\^~=+_@]")
_DIGIT = re.compile(r"\d")
_UPPER = re.compile(r"[A-ZÄÖÜÉÈÀÇÑ]")
_PUNCTUATION = re.compile(r"[.,;:!?]")


class Features:
    """Bucket numbers and values of a text, and its structure statistics."""

    def __init__(self, buckets: int = BUCKETS):
        self.buckets = buckets
        self.known: dict[str, int] = {}

    def bucket(self, word: str) -> int:
        if len(self.known) >= CACHED_WORDS:
            self.known.clear()
        at = zlib.crc32(word.encode("utf-8", "surrogatepass")) % self.buckets
        self.known[word] = at
        return at

    def of(self, text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray, list[float]]:
        text = text or ""
        words = text.lower().split()
        counts = Counter(words)
        known = self.known
        at = np.fromiter(
            (known[w] if w in known else self.bucket(w) for w in counts), np.int32, len(counts)
        )
        x = np.log1p(np.fromiter(counts.values(), np.float64, len(counts)))
        norm = math.sqrt(float(x @ x)) or 1.0
        lines = text.split("\n")
        n, chars = max(len(words), 1), max(len(text), 1)
        stats = [
            math.log1p(len(words)),
            sum(map(len, words)) / n,
            len(counts) / n,
            max(counts.values(), default=0) / n,
            len(_SYMBOL.findall(text)) / chars,
            len(_DIGIT.findall(text)) / chars,
            len(_UPPER.findall(text)) / chars,
            len(_PUNCTUATION.findall(text)) / n,
            math.log1p(len(lines)),
            len(set(lines)) / len(lines),
            math.log1p(len(words) / len(lines)),
            math.nan if n_chars is None else math.log1p(max(n_chars, 0)),
        ]
        return at, x / norm, stats


@dataclass
class Machine:
    """``bias``, weights ``w`` and vectors ``v``: words first, then intervals of statistics."""

    buckets: int
    edges: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray

    def intervals(self, stats: np.ndarray) -> np.ndarray:
        """Feature numbers of rows of statistics; missing values have an interval of their own."""
        per = self.edges.shape[1] + 2
        out = np.empty(stats.shape, dtype=np.int64)
        for k in range(stats.shape[1]):
            place = np.searchsorted(self.edges[k], stats[:, k], side="right")
            place[np.isnan(stats[:, k])] = per - 1
            out[:, k] = self.buckets + k * per + place
        return out

    def raw(self, at: np.ndarray, x: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Scores before the logistic function; ``rows`` are the starts of each row's features."""
        linear = np.add.reduceat(self.w[at] * x, rows)
        vx = self.v[at] * x[:, None]
        s = np.add.reduceat(vx, rows)
        return self.bias + linear + 0.5 * ((s * s).sum(1) - np.add.reduceat((vx * vx).sum(1), rows))


def _joined(machine: Machine, items: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of several rows, one after another; every row has at least its intervals."""
    marks = machine.intervals(np.array([i[2] for i in items]))
    scale = 1 / math.sqrt(marks.shape[1])
    at, x, rows, n = [], [], [], 0
    for (words, values, _), own in zip(items, marks, strict=True):
        at += [words, own]
        x += [values, np.full(len(own), scale)]
        rows.append(n)
        n += len(words) + len(own)
    return np.concatenate(at), np.concatenate(x), np.array(rows)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _collected(rows: DataFrame) -> tuple[list[tuple], np.ndarray]:
    """Hashed features of the sample's rows in a fixed order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for b in batches:
            found = [
                features.of(t.as_py(), n.as_py())
                for t, n in zip(b["text"], b["n_chars"], strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    b["doc_id"],
                    b["quality"],
                    pa.array([f[0] for f in found], pa.list_(pa.int32())),
                    pa.array([f[1].astype(np.float32) for f in found], pa.list_(pa.float32())),
                    pa.array([f[2] for f in found], pa.list_(pa.float64())),
                ],
                ["doc_id", "quality", "at", "x", "stats"],
            )

    schema = "doc_id long, quality int, at array<int>, x array<float>, stats array<double>"
    got = rows.mapInArrow(run, schema).toArrow().sort_by([("doc_id", "ascending")])
    columns = [got[c].to_numpy(zero_copy_only=False) for c in ("at", "x", "stats")]
    items = [(a, v.astype(float), s.astype(float)) for a, v, s in zip(*columns, strict=True)]
    return items, got["quality"].to_numpy(zero_copy_only=False).astype(float)


def fit(labelled: DataFrame, max_rows: int = MAX_ROWS) -> Machine:
    """Fit on rows with ``doc_id``, ``text``, ``n_chars`` and ``quality`` (1 good, 0 not)."""
    small_batches(labelled.sparkSession)
    rows = labelled.where("quality is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "text",
        F.col("n_chars").cast("long").alias("n_chars"),
        F.col("quality").cast("int").alias("quality"),
    )
    n = rows.count()
    if n > max_rows:
        grid = 1 << 40
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(grid)) < int(grid * (max_rows / n)))
    items, y = _collected(rows)
    k = len(STATISTICS)
    edges = np.zeros((k, INTERVALS - 1))
    size = BUCKETS + k * (INTERVALS + 1)
    draw = np.random.default_rng(SEED)
    machine = Machine(BUCKETS, edges, 0.0, np.zeros(size), draw.normal(0, 0.01, (size, RANK)))
    if not items:
        machine.v[:] = 0
        return machine
    stats = np.array([i[2] for i in items])
    for j in range(k):
        own = stats[~np.isnan(stats[:, j]), j]
        if len(own):
            edges[j] = np.quantile(own, np.arange(1, INTERVALS) / INTERVALS)
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    machine.bias = math.log(share / (1 - share))
    gw, gv, gb = np.full(size, 1e-6), np.full((size, RANK), 1e-6), 1e-6
    for _ in range(EPOCHS):
        order = draw.permutation(len(items))
        for start in range(0, len(order), BATCH):
            picked = order[start : start + BATCH]
            at, x, first = _joined(machine, [items[i] for i in picked])
            error = (_logistic(machine.raw(at, x, first)) - y[picked]) / len(picked)
            lengths = np.diff(np.append(first, len(at)))
            e = np.repeat(error, lengths)
            vx = machine.v[at] * x[:, None]
            s = np.repeat(np.add.reduceat(vx, first), lengths, axis=0)
            touched, place = np.unique(at, return_inverse=True)
            dw = np.bincount(place, e * x, len(touched)) + DECAY * machine.w[touched]
            dv = np.empty((len(touched), RANK))
            for r in range(RANK):
                dv[:, r] = np.bincount(place, e * x * (s[:, r] - vx[:, r]), len(touched))
            dv += DECAY * machine.v[touched]
            db = error.sum()
            gw[touched] += dw * dw
            gv[touched] += dv * dv
            gb += db * db
            machine.w[touched] -= RATE * dw / np.sqrt(gw[touched])
            machine.v[touched] -= RATE * dv / np.sqrt(gv[touched])
            machine.bias -= RATE * db / math.sqrt(gb)
    return machine


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1) of every whole text."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(machine)  # fixed size: BUCKETS x RANK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(held.value.buckets)
        for b in batches:
            items = [
                features.of(t.as_py(), n.as_py())
                for t, n in zip(b["text"], b["n_chars"], strict=True)
            ]
            found = (
                _logistic(held.value.raw(*_joined(held.value, items))) if items else np.zeros(0)
            )
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(found)], ["doc_id", "score"])

    kept = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.col("n_chars").cast("long").alias("n_chars"),
    )
    return kept.mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, machine: Machine, cut: float = CUT) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score ``cut`` or more."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(machine)  # fixed size: BUCKETS x RANK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(held.value.buckets)
        for b in batches:
            if b.num_rows:
                items = [
                    features.of(t.as_py(), n.as_py())
                    for t, n in zip(b["text"], b["n_chars"], strict=True)
                ]
                good = _logistic(held.value.raw(*_joined(held.value, items))) >= cut
                yield b.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)

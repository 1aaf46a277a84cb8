"""Language identification by words first, backing off to character n-grams.

A word that the model knows is scored by its log frequency in every language. An unseen word is
scored by the longest character n-grams of it that the model knows, five characters down to one.
The model is fitted on a bounded sample of documents with a language: ``max_docs`` distinct
(language, text) pairs by hash. It keeps every word and every n-gram of the sample, as sorted hashes
and a row of log frequencies each. Its size does not grow with the input, so every task can hold it.

Texts that are null or have no letter are ``und`` with score 0. Texts without a known word or
n-gram get the most frequent language of the sample, scored by its share. Ties go to the first
language by name. Without any labelled row all texts are ``und``. Repeated rows are learned once and
judged alike, so no number of copies outgrows the sample; empty tables give no rows; extra columns
are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitrep.llm.common import small_batches, stored

#: Bound of the sample that the model is fitted on.
MAX_DOCS = 20_000
LONGEST_GRAM = 5
#: Added to every count.
SMOOTHING = 0.5
#: Words of earlier texts that a task remembers.
CACHED_WORDS = 500_000
#: Distinct words of a text that are looked up together.
PART = 50_000

UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_WORD = re.compile(r"[^\W\d_]+")


def grams_of(word: str, n: int) -> list[str]:
    """Character n-grams with blanks around the word; single characters are its own."""
    marked = f" {word} " if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def hash_of(item: str) -> int:
    return xxhash.xxh64_intdigest(item.encode("utf-8", "surrogatepass"))


@dataclass
class Table:
    """Sorted hashes of items and, for each, its log frequency in every language."""

    keys: np.ndarray
    logs: np.ndarray

    def find(self, items: list[str]) -> np.ndarray:
        """The row of every item; -1 for those that are not known."""
        asked = np.fromiter((hash_of(x) for x in items), np.uint64, len(items))
        if not len(self.keys):
            return np.full(len(items), -1)
        at = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
        return np.where(self.keys[at] == asked, at, -1)


@dataclass
class Model:
    """Languages, the logs of their shares, and the tables of words and n-grams."""

    langs: list[str]
    prior: np.ndarray
    words: Table
    grams: Table

    def logs_of(self, words: list[str]) -> np.ndarray:
        """A row for every word: its own, else the mean of its longest known n-grams, else zeros."""
        out = np.zeros((len(words), len(self.langs)))
        row = self.words.find(words)
        out[row >= 0] = self.words.logs[row[row >= 0]]
        left = np.flatnonzero(row < 0)
        for n in range(LONGEST_GRAM, 0, -1):
            if not len(left):
                break
            grams = [grams_of(words[i], n) for i in left.tolist()]
            found = self.grams.find([g for own in grams for g in own])
            word = np.repeat(np.arange(len(left)), [len(own) for own in grams])[found >= 0]
            times = np.bincount(word, minlength=len(left))
            known = times > 0
            for lang in range(len(self.langs)):
                total = np.bincount(word, self.grams.logs[found[found >= 0], lang], len(left))
                out[left[known], lang] = total[known] / times[known]
            left = left[~known]
        return out


class Scorer:
    """Scores texts with a model; words of earlier texts are remembered, up to a bound."""

    def __init__(self, model: Model, cached: int = CACHED_WORDS):
        self.model = model
        self.logs = np.zeros((max(cached, PART), len(model.langs)))
        self.row: dict[str, int] = {}

    def _rows(self, words: list[str]) -> list[int]:
        """Rows of ``logs`` of up to ``PART`` distinct words; new ones are looked up together."""
        get = self.row.get
        rows = [get(w) for w in words]
        new = [w for w, r in zip(words, rows, strict=True) if r is None]
        if not new:
            return rows
        if len(self.row) + len(new) > len(self.logs):
            self.row.clear()
            new = words
        at = len(self.row)
        self.logs[at : at + len(new)] = self.model.logs_of(new)
        self.row.update(zip(new, range(at, at + len(new)), strict=True))
        return [self.row[w] for w in words]

    def score(self, text: str | None) -> tuple[str, float]:
        langs = self.model.langs
        if not langs or not text or not _LETTER.search(text):
            return UNKNOWN, 0.0
        counts = Counter(_WORD.findall(text.lower()))
        total = self.model.prior.copy()
        words = list(counts)
        times = np.fromiter(counts.values(), float, len(words))
        # a text of more distinct words than are remembered is scored in parts
        for at in range(0, len(words), PART):
            total += times[at : at + PART] @ self.logs[self._rows(words[at : at + PART])]
        odds = np.exp(total - total.max())
        best = int(np.argmax(odds))
        return langs[best], float(odds[best] / odds.sum())


def sampled(docs: DataFrame, max_docs: int) -> DataFrame:
    """``lang, text``: about ``max_docs`` distinct pairs, chosen by hash; all if there are fewer.

    The pairs are counted within two percent or so, and only those chosen are shuffled.
    """
    pair = F.xxhash64("lang", "text")
    n = docs.agg(F.approx_count_distinct(pair, 0.02)).first()[0]
    rows = docs.select("lang", "text", pair.alias("pair"))
    if n > max_docs:
        # hashed again: rows are dealt to partitions and tables by the plain hash
        grid = 1 << 40
        rows = rows.where(F.pmod(F.xxhash64("pair"), F.lit(grid)) < int(grid * (max_docs / n)))
    return rows.dropDuplicates(["pair"]).select("lang", "text")


def _counted(docs: DataFrame) -> DataFrame:
    """``lang, is_word, item, times``: hashes of words and n-grams of the sample, counted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        for b in batches:
            for lang, text in zip(b["lang"].to_pylist(), b["text"].to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(_WORD.findall((text or "").lower()))
        for lang, counts in words.items():
            grams: Counter = Counter()
            for w, times in counts.items():
                for n in range(1, LONGEST_GRAM + 1):
                    for g in grams_of(w, n):
                        grams[g] += times
            for is_word, found in ((True, hashed(counts)), (False, hashed(grams))):
                hashes, times = found
                for at in range(0, len(hashes), 50_000):
                    part = pa.array(hashes[at : at + 50_000].view(np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([lang] * len(part), pa.string()),
                            pa.array([is_word] * len(part), pa.bool_()),
                            part,
                            pa.array(times[at : at + 50_000]),
                        ],
                        ["lang", "is_word", "item", "times"],
                    )

    parts = docs.mapInArrow(count, "lang string, is_word boolean, item long, times long")
    return parts.groupBy("lang", "is_word", "item").agg(F.sum("times").alias("times"))


def hashed(counts: Counter) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of counted items."""
    hashes = np.fromiter((hash_of(x) for x in counts), np.uint64, len(counts))
    return hashes, np.fromiter(counts.values(), np.int64, len(counts))


def fit(labelled: DataFrame, max_docs: int = MAX_DOCS) -> Model:
    """Fit on rows with ``text`` and a language ``lang`` that is not null."""
    small_batches(labelled.sparkSession)
    rows = labelled.where("lang is not null and text is not null").select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")
    )
    sample = stored(sampled(rows, max_docs), "language-sample")
    shares = {r["lang"]: r["n"] for r in sample.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(shares)
    # one entry for each distinct word or n-gram of the sample and language: bounded by the sample
    counted = _counted(sample).toArrow()

    def table(is_word: bool) -> Table:
        own = counted.filter(pc.equal(counted["is_word"], is_word))
        items = own["item"].to_numpy().view(np.uint64)
        keys, at = np.unique(items, return_inverse=True)
        counts = np.full((len(keys), len(langs)), SMOOTHING)
        lang = pc.index_in(own["lang"], pa.array(langs, pa.string())).to_numpy()
        counts[at, lang] += own["times"].to_numpy()
        sums = counts.sum(axis=0) if len(keys) else np.ones(len(langs))
        return Table(keys, np.log(counts / sums).astype(np.float32))

    n = np.array([shares[x] for x in langs], dtype=float)
    return Model(langs, np.log(n / n.sum()) if langs else n, table(True), table(False))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score``, the share of the best language, for every row."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample: see MAX_DOCS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for b in batches:
            found = [scorer.score(t) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    kept = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    return kept.mapInArrow(run, "doc_id long, lang_pred string, score double")

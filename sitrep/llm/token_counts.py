"""Token counts of whole texts under a unigram vocabulary, by one pass over a shared trie.

Distinct pre-tokens (words with a leading word mark) go into a trie. A node holds the best score
of the prefix that leads to it and the number of tokens of that segmentation. Both follow from the
nodes above it: the best over all vocabulary pieces that end there. So a prefix that many words
share is scored once, and a word's count is stored where the word ends. A worker keeps its trie
from row to row and from task to task and starts a new one when it has grown to ``max_nodes``, so
its memory is bounded; counts do not depend on that.

A character that no piece covers counts as its UTF-8 bytes, as byte fallback has it. Of equal
scores the longer last piece wins. Null and empty texts have no tokens. Repeated rows count alike;
empty tables give no rows; extra columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitrep.llm.common import small_batches

MARK = "▁"
MAX_NODES = 1_200_000
#: Distance of an uncovered character's score below the lowest score of a piece.
UNKNOWN_PENALTY = 10.0


def vocabulary(path: str) -> dict[str, float]:
    """Pieces of a sentencepiece file and log probabilities that fall with their rank.

    The file orders its pieces by rank; under Zipf's law the piece of rank ``r`` has a probability
    in proportion to ``1 / r``. Control and byte pieces are left out.
    """
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    pieces = [
        sp.id_to_piece(i)
        for i in range(sp.get_piece_size())
        if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i))
    ]
    total = sum(1 / r for r in range(1, len(pieces) + 1))
    return {p: -math.log(r * total) for r, p in enumerate(pieces, 1)}


class Trie:
    """Best unigram segmentations of all prefixes inserted so far."""

    def __init__(self, scores: dict[str, float], max_nodes: int = MAX_NODES):
        self.scores, self.max_nodes = scores, max_nodes
        self.longest = max(map(len, scores), default=1)
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.clear()

    def clear(self) -> None:
        # the child of a node by a character is found under node * 2^21 + code point
        self.children: dict[int, int] = {}
        self.best = [0.0]
        self.tokens = [0]
        #: counts of the words that end in the trie
        self.ends: dict[str, int] = {}

    def count(self, word: str) -> int:
        """Tokens of the best segmentation of ``word``; new prefixes are scored on the way."""
        known = self.ends.get(word)
        if known is not None:
            return known
        if len(self.best) > self.max_nodes:
            self.clear()
        node, path, children = 0, [0], self.children
        for end, char in enumerate(word, 1):
            key = node << 21 | ord(char)
            child = children.get(key)
            if child is None:
                child = children[key] = self._scored(word, end, path)
            node = child
            path.append(node)
        self.ends[word] = self.tokens[node]
        return self.tokens[node]

    def _scored(self, word: str, end: int, path: list[int]) -> int:
        best, tokens = -math.inf, 0
        for start in range(max(0, end - self.longest), end):
            score = self.scores.get(word[start:end])
            if score is None:
                if start < end - 1:
                    continue
                score, n = self.unknown, len(word[start:end].encode("utf-8", "surrogatepass"))
            else:
                n = 1
            above = path[start]
            if self.best[above] + score > best:
                best, tokens = self.best[above] + score, self.tokens[above] + n
        self.best.append(best)
        self.tokens.append(tokens)
        return len(self.best) - 1


_TRIES: dict[tuple, Trie] = {}


def _kept(scores: dict[str, float], max_nodes: int) -> Trie:
    """This worker's trie for a vocabulary."""
    key = (hash(frozenset(scores.items())), max_nodes)
    if key not in _TRIES:
        _TRIES.clear()
        _TRIES[key] = Trie(scores, max_nodes)
    return _TRIES[key]


def count_tokens(docs: DataFrame, scores: dict[str, float], max_nodes: int = MAX_NODES) -> DataFrame:
    """``doc_id``, ``n_pretokens``, ``n_distinct`` pre-tokens and ``n_tokens`` of every whole text."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(scores)  # one vocabulary, tens of thousands

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _kept(held.value, max_nodes)
        for b in batches:
            docs_words = [Counter((t or "").split()) for t in b["text"].to_pylist()]
            totals = [sum([trie.count(MARK + w) * n for w, n in c.items()]) for c in docs_words]
            yield pa.RecordBatch.from_arrays(
                [
                    b["doc_id"],
                    pa.array([sum(c.values()) for c in docs_words], pa.int64()),
                    pa.array([len(c) for c in docs_words], pa.int64()),
                    pa.array(totals, pa.int64()),
                ],
                ["doc_id", "n_pretokens", "n_distinct", "n_tokens"],
            )

    kept = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    return kept.mapInArrow(run, "doc_id long, n_pretokens long, n_distinct long, n_tokens long")

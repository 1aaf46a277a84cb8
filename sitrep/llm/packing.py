"""Pack tokenised documents into fixed-length sequences by harmonic classes.

A document of more than ``capacity`` ids fills whole sequences first. Its remainder of ``r`` ids
belongs to class ``j`` when ``capacity / (j + 1) < r <= capacity / j``: ``j`` remainders of the
class share one sequence. Every task packs the rows it reads, one open sequence per class, so
nothing is shuffled and memory does not grow with the input. The room that a class leaves is
filled with cut documents: the next document is cut into the sequences that wait for a filler, so
no room is left. At the end of a task the remainders of the open classes are laid end to end, and
what is left over becomes sequences whose lengths are powers of two, which need no padding.

Null text is an empty text. Every document ends with the end id, so an empty one has one id.
Repeated rows are packed as often as they occur. Empty tables give no rows; extra columns are
not read.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Callable, Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitrep.llm.common import small_batches, utf8

CAPACITY = 4096
END_ID = 2
#: Remainders shorter than ``capacity / CLASSES`` share the last class.
CLASSES = 64
#: Words whose ids a worker keeps; beyond that it starts anew.
CACHED_WORDS = 800_000

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long"
)

#: From an Arrow column of texts (null: empty) to all their ids, and where each text's ids begin.
Encoder = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]

#: Bytes of text that are encoded at a time; a longer text is one piece.
ENCODED = 4 << 20
#: Words whose ids are copied at a time.
COPIED = 500_000

# Fixed value: how a tokenizers file says that letters are split from punctuation.
LETTERS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

SPACE, LETTER, SIGN, OTHER = range(4)
_CLASS = np.full(256, OTHER, dtype=np.int8)
_CLASS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = SPACE
_CLASS[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'"]] = SIGN
_CLASS[65:91] = _CLASS[97:123] = LETTER


def folds(path: str) -> tuple[bool, list[str]]:
    """Whether a tokenizers file lower-cases and splits runs of letters from runs of signs, so that
    ``Word,`` has the ids of ``word`` and those of ``,``; and the tokens that it finds before that."""
    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    added = [x["content"] for x in rules.get("added_tokens") or []]
    steps = (rules.get("normalizer") or {}).get("normalizers") or []
    splits = (rules.get("pre_tokenizer") or {}).get("pretokenizers") or []
    pattern = (splits[0].get("pattern") or {}).get("Regex") if splits else None
    return "Lowercase" in [x["type"] for x in steps] and pattern == LETTERS, added


def split_words(data: np.ndarray, offsets: np.ndarray, fold: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of texts one after another, and where each text's words begin.

    Words end at ASCII white space, which no id reaches across. Where ``fold`` is set, texts of ASCII
    and Latin-1 characters alone are lower-cased, and also split between letters and ASCII signs other
    than the apostrophe: there every match of the pattern ends, and such texts hold nothing that
    composes or changes its length.
    """
    kind = _CLASS[data]
    cut = np.zeros(len(data), dtype=bool)
    if fold.any() and len(data):
        plain = fold.copy()
        plain[np.searchsorted(offsets, np.flatnonzero(data >= 0xC4), side="right") - 1] = False
        inside = np.repeat(plain, np.diff(offsets))
        # two-byte letters of Latin-1: 0xC3 and a byte that is not that of a multiplication or division sign
        lead = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7))
        kind[lead] = kind[lead + 1] = LETTER
        upper = (data >= 65) & (data <= 90)
        upper[lead + 1] = data[lead + 1] <= 0x9E
        data = data + (upper & inside).astype(np.uint8) * np.uint8(32)
        cut[1:] = inside[1:] & (kind[1:] + kind[:-1] == LETTER + SIGN) & (kind[1:] * kind[:-1] == LETTER * SIGN)
    word = kind != SPACE
    starts = word.copy()
    starts[1:] &= ~word[:-1] | cut[1:]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts[firsts] = word[firsts]
    at = np.flatnonzero(starts)
    ends = np.append(np.cumsum(word, dtype=np.int64)[at] - 1, word.sum()) if len(at) else np.zeros(1, np.int64)
    letters = np.ascontiguousarray(data[word])
    words = pa.Array.from_buffers(
        pa.large_binary(), len(at), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(letters)]
    )
    return words, np.searchsorted(at, offsets)


class WordIds:
    """Ids of whole texts, for tokenizers that drop white space and never join across it.

    A text's ids are its words' ids one after another. Words repeat: the distinct words of some
    texts are looked up once, those not known yet are encoded together, and the ids of all words are
    copied from one flat array by place.
    """

    def __init__(self, path: str, cached: int = CACHED_WORDS):
        # one thread per task; must be set before the library starts its pool
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.fold, self.added = folds(path)
        self.cached = cached
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 16, dtype=np.uint32)
        self.first = np.zeros(1 << 14, dtype=np.int64)  # where a known word's ids begin; ends follow

    def _learn(self, new: list[bytes]) -> None:
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            plain = [w.decode("utf-8", "replace") for w in some]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(plain, add_special_tokens=False)]
            n, end = len(self.known), self.first[len(self.known)]
            ends = end + np.cumsum([len(x) for x in ids], dtype=np.int64)
            self.first = _grown(self.first, n + len(some) + 1)
            self.flat = _grown(self.flat, ends[-1])
            self.first[n + 1 : n + len(some) + 1] = ends
            self.flat[end : ends[-1]] = np.fromiter(chain.from_iterable(ids), np.uint32, ends[-1] - end)
            self.known.update(zip(some, range(n, n + len(some)), strict=True))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = utf8(texts)
        fold = np.full(len(texts), self.fold)
        if self.fold:
            for token in self.added:  # found in texts as they are
                fold &= ~pc.fill_null(pc.match_substring(texts, token), False).to_numpy(zero_copy_only=False)
        ids, starts = [], [np.zeros(1, np.int64)]
        lo = 0
        while lo < len(offsets) - 1:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + ENCODED, side="right")) - 1)
            part = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            some, begin = self._encode(*split_words(*part, fold[lo:hi]))
            ids += some
            starts.append(starts[-1][-1] + begin[1:])
            lo = hi
        return np.concatenate([np.zeros(0, np.uint32), *ids]), np.concatenate(starts)

    def _encode(self, words: pa.Array, begin: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Ids of words one after another, and where those before each place begin."""
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        new = [w for w in distinct if w not in self.known]
        if len(self.known) + len(new) > self.cached:
            self._forget()
            new = distinct
        self._learn(new)
        place = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))
        which = place[coded.indices.to_numpy()]
        length = self.first[which + 1] - self.first[which]
        ends = np.concatenate([[0], np.cumsum(length)])
        ids = []
        for at in range(0, len(which), COPIED):
            n, first = length[at : at + COPIED], self.first[which[at : at + COPIED]]
            shift = first - (ends[at : at + len(n)] - ends[at])
            ids.append(self.flat[np.repeat(shift, n) + np.arange(n.sum())])
        return ids, ends[begin]


def _grown(a: np.ndarray, size: int) -> np.ndarray:
    """``a`` with room for ``size`` items."""
    return a if size <= len(a) else np.concatenate([a, np.zeros(max(size - len(a), len(a)), a.dtype)])


class Packer:
    """The sequences of one task; ``rows`` holds the pieces of finished ones.

    A segment is ``(doc_id, ids, start, doc_tokens)``, the ids from ``start`` of a document.
    """

    def __init__(self, first_id: int, capacity: int = CAPACITY, classes: int = CLASSES):
        self.next_id, self.capacity, self.classes = first_id, capacity, classes
        self.rows: list[tuple] = []
        self.open: dict[int, list[tuple]] = {}
        #: a sequence that has all documents of its class and still room, and its length
        self.waiting: list[tuple] = []
        self.used = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        total, start = len(ids) // 4, 0

        def cut(n: int) -> tuple:
            nonlocal start
            start += n
            return doc_id, ids[4 * (start - n) : 4 * start], start - n, total

        if self.waiting:
            n = min(self.capacity - self.used, total)
            self.waiting.append(cut(n))
            self.used += n
            if self.used == self.capacity:
                self._finish(self.waiting)
                self.waiting = []
        while total - start >= self.capacity:
            self._finish([cut(self.capacity)])
        if start < total:
            j = min(self.classes, self.capacity // (total - start))
            group = self.open.setdefault(j, [])
            group.append(cut(total - start))
            if len(group) == j:
                self._full_class(self.open.pop(j))

    def _full_class(self, group: list[tuple]) -> None:
        used = sum(len(ids) // 4 for _, ids, _, _ in group)
        if used == self.capacity:
            self._finish(group)
        else:
            self.waiting, self.used = group, used

    def close(self) -> None:
        """Lay what is open end to end; the last sequences have powers of two as lengths."""
        rest = self.waiting + [x for j in sorted(self.open) for x in self.open[j]]
        self.open, self.waiting = {}, []
        left = sum(len(ids) // 4 for _, ids, _, _ in rest)
        sizes = [self.capacity] * (left // self.capacity)
        left %= self.capacity
        sizes += [1 << k for k in range(left.bit_length() - 1, -1, -1) if left >> k & 1]
        rest.reverse()
        for size in sizes:
            parts = []
            while size:
                doc_id, ids, start, total = rest.pop()
                n = min(size, len(ids) // 4)
                parts.append((doc_id, ids[: 4 * n], start, total))
                if 4 * n < len(ids):
                    rest.append((doc_id, ids[4 * n :], start + n, total))
                size -= n
            self._finish(parts)

    def _finish(self, parts: list[tuple]) -> None:
        offset = 0
        for doc_id, ids, start, total in parts:
            n = len(ids) // 4
            self.rows.append((doc_id, start, n, ids, total, self.next_id, offset))
            offset += n
        self.next_id += 1


def pack(
    docs: DataFrame,
    make_encoder: Callable[[], Encoder],
    capacity: int = CAPACITY,
    classes: int = CLASSES,
    end_id: int = END_ID,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece: ``PIECES``, and with ``with_ids`` its ``ids`` themselves.

    ``make_encoder`` gives, once per task, a function from texts to their ids. Sequence
    ids are unique: the number of the task above a count. A task that is run again packs all of
    its documents again, so no piece is lost or doubled.
    """
    small_batches(docs.sparkSession)
    fields = pa.schema(
        [(x.split()[0], pa.int64()) for x in PIECES.split(", ")]
        + ([("ids", pa.list_(pa.int32()))] if with_ids else [])
    )

    def rows_of(rows: list[tuple]) -> pa.RecordBatch:
        doc, start, length, ids, total, seq, offset = zip(*rows, strict=True)
        columns = [doc, start, length, [zlib.crc32(x) for x in ids], total, seq, offset]
        arrays = [pa.array(c, pa.int64()) for c in columns]
        if with_ids:
            ends = pa.array([0, *accumulate(length)], pa.int32())
            flat = pa.Array.from_buffers(pa.int32(), sum(length), [None, pa.py_buffer(b"".join(ids))])
            arrays.append(pa.ListArray.from_arrays(ends, flat))
        return pa.RecordBatch.from_arrays(arrays, schema=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make_encoder()
        packer = Packer(TaskContext.get().partitionId() << 40, capacity, classes)
        for b in batches:
            ids, starts = encode(b["text"])
            data = np.insert(ids, starts[1:], end_id).astype("<u4").tobytes()
            bounds = (4 * (starts + np.arange(len(starts)))).tolist()
            for doc_id, lo, hi in zip(b["doc_id"].to_pylist(), bounds[:-1], bounds[1:], strict=True):
                packer.add(doc_id, data[lo:hi])
                if len(packer.rows) >= 2000:
                    yield rows_of(packer.rows)
                    packer.rows = []
        packer.close()
        if packer.rows:
            yield rows_of(packer.rows)

    kept = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    return kept.mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))


def word_encoder(path: str) -> Callable[[], Encoder]:
    """For ``pack``: ids by a tokenizers file; a worker keeps its cache from task to task."""

    def make() -> Encoder:
        if path not in _ENCODERS:
            _ENCODERS[path] = WordIds(path)
        return _ENCODERS[path].encode

    return make


_ENCODERS: dict[str, WordIds] = {}

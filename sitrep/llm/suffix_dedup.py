"""Remove repeated byte strings: every byte of a 100-byte string that also starts earlier.

The rule is the longest-previous-factor array with a threshold: in suffix order, the suffix before
the present one with a smaller text position is its nearest earlier match, and the match reaches
``LENGTH`` bytes or not. One suffix array over all text would not distribute; suffixes only have
to meet those they share ``LENGTH`` bytes with, so they are dealt by content:

1. Of every ``LENGTH``-byte string the gram of ``GRAM`` bytes with the smallest hash is its
   anchor. Equal strings have equal anchors, whatever surrounds them. Neighbouring starts share
   an anchor, so there is one record for about 35 bytes of text: anchor hash, hash of all text
   that its starts cover, document, first start, number of starts.
2. Records meet by anchor hash. Of records that agree in both hashes all but the earliest are
   repeated as a whole. Anchors whose texts differ are edges of repeated passages: these stay
   open. Anchors that occur once are done.
3. Open records fetch their text and meet again by anchor. There the suffixes are sorted and the
   longest-previous-factor rule marks the repeated starts.
4. Marked starts return to their documents, which drop the bytes they cover.

Anchors with more than a ten-thousandth of all records (there can be no more than ten thousand of
these, so their set is broadcast) would fill one task: their records meet by both hashes in step
2, and in step 3 every start meets its equals by a 128-bit hash of its own string.

Positions are ordered by ``doc_id``, then start. Null and empty texts have no bytes, texts below
``LENGTH`` lose none. Rows equal in ``doc_id`` and text are one document: they are judged alike
and do not count as copies of each other. Different texts under one ``doc_id``, or under none, are
documents of their own, in the order of a hash of the text. A null ``doc_id`` comes first. Empty
tables give no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitrep.llm.common import small_batches, stored, utf8
from sitrep.llm.heavy import contained, heavy_keys

LENGTH = 100
GRAM = 32
WINDOW = LENGTH - GRAM + 1
#: Bytes of text worked on at a time; longer documents are cut with an overlap.
CHUNK = 2 << 20
#: Bytes of text for each group of documents and each group of records. Records of one group that
#: go to the same group share a row; with small groups few would.
GROUP_BYTES = 2 << 20
#: Anchors with a larger share of all records are dealt by more than their hash.
HEAVY_SHARE = 1e-4
NO_ID = -(1 << 63)

U = np.uint64
RECORD = np.dtype([("h", "<u8"), ("c", "<u8"), ("doc", "<i8"), ("lo", "<i8"), ("n", "<i4")])
MARK = np.dtype([("doc", "<i8"), ("lo", "<i8"), ("n", "<i4")])
OPEN = np.dtype([("h", "<u8"), ("doc", "<i8"), ("lo", "<i8"), ("n", "<i4")])
START = np.dtype([("g", "<u8"), ("c", "<u8"), ("doc", "<i8"), ("lo", "<i8")])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(32))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every ``GRAM`` bytes, by doubling the length five times."""
    h = mixed(data.astype(U) + U(0x51ED270B))
    factor, size = 0xD6E8FEB86659FD93, 1
    while size < GRAM:
        if len(h) <= size:
            return np.zeros(0, U)
        h = h[:-size] * U(factor) + h[size:]
        factor = factor * factor % (1 << 64)
        size *= 2
    return mixed(h)


def text_hashes(h: np.ndarray, lo: np.ndarray, length: np.ndarray, salt: int) -> np.ndarray:
    """Hashes of whole strings ``[lo, lo + length)`` of at least ``GRAM`` bytes each."""
    out = mixed(length.astype(U) + U(salt))
    for t in range(int(length.max(initial=0)) // GRAM):
        at = GRAM * t
        inside = at + GRAM <= length
        here = h[np.where(inside, lo + at, 0)]
        out = np.where(inside, mixed(out * U(0x2545F4914F6CDD1D) + here), out)
    return mixed(out + h[lo + length - GRAM] * U(0x9FB21C651E98DF25))


def chunks(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Pieces of documents of about ``CHUNK`` bytes: (row, start) pairs and their texts.

    Yields arrays of rows, of starts inside the row's text and of the pieces' bounds in the
    joined bytes. Pieces of one document overlap so that every string lies whole in one of them.
    """
    rows, starts, parts, size = [], [], [], 0
    for row, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        at = lo
        while hi - at >= LENGTH:
            end = min(hi, at + CHUNK)
            rows.append(row)
            starts.append(at - lo)
            parts.append(data[at:end])
            size += end - at
            if size >= CHUNK:
                yield np.array(rows), np.array(starts), parts
                rows, starts, parts, size = [], [], [], 0
            if end == hi:
                break
            at = end - LENGTH + 1
    if rows:
        yield np.array(rows), np.array(starts), parts


def records_of(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray) -> Iterator[np.ndarray]:
    """``RECORD`` arrays: the anchors of all strings of some documents."""
    for rows, starts, parts in chunks(data, offsets):
        joined = np.concatenate(parts)
        bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        h = gram_hashes(joined)
        low = (h & U(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=U)
        step = 1
        while 2 * step <= WINDOW:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        if step < WINDOW:
            low = np.minimum(low[: step - WINDOW], low[WINDOW - step :])
        piece = np.repeat(np.arange(len(parts)), np.diff(bounds))[: len(low)]
        s = np.flatnonzero(np.arange(len(low)) + LENGTH <= bounds[1:][piece])
        anchor = (low[s] & U(0xFFFFFFFF)).astype(np.int64)
        owner = piece[s]
        new = np.ones(len(s), dtype=bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(s)))
        lo, at, own = s[first], anchor[first], owner[first]
        out = np.empty(len(first), RECORD)
        out["h"] = h[at]
        out["c"] = text_hashes(h, lo, n + LENGTH - 1, 1) + mixed((at - lo).astype(U))
        out["doc"] = ids[rows[own]]
        out["lo"] = lo - bounds[own] + starts[own]
        out["n"] = n
        yield out


def repeats(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Records sorted by hashes and place, and which of them have an equal one before them."""
    r = r[np.lexsort((r["lo"], r["doc"], r["c"], r["h"]))]
    new = np.ones(len(r), dtype=bool)
    new[1:] = (r["h"][1:] != r["h"][:-1]) | (r["c"][1:] != r["c"][:-1])
    head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(r) else np.zeros(0, np.int64)
    return r, (r["doc"] != r["doc"][head]) | (r["lo"] != r["lo"][head])


def marks_of(r: np.ndarray) -> np.ndarray:
    out = np.empty(len(r), MARK)
    for f in MARK.names:
        out[f] = r[f]
    return out


def previous_factors(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which suffixes, given in text order, have a previous factor of ``LENGTH`` bytes.

    Suffixes are sorted by their first ``LENGTH`` bytes, equal ones in text order. Then the
    previous smaller position of a suffix inside a run of equal ones is the one before it, and
    none but a run's first lacks a previous factor of that length.
    """
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    columns = []
    for at in range(0, LENGTH, 8):
        w = np.ascontiguousarray(words[starts + at]).view(">u8").ravel().astype(U)
        columns.append(w >> U(8 * max(0, at + 8 - LENGTH)))
    order = np.lexsort(columns[::-1])
    same = np.ones(max(0, len(order) - 1), dtype=bool)
    for c in columns:
        same &= c[order[1:]] == c[order[:-1]]
    out = np.zeros(len(starts), dtype=bool)
    out[order[1:]] = same
    return out, order, same


def _packed(key: np.ndarray, rows: np.ndarray, kind: int) -> list[tuple[int, int, bytes]]:
    """Rows ``(key, kind, data)``: records that go the same way travel together, by column."""
    order = np.argsort(key, kind="stable")
    key, rows = key[order], rows[order]
    cut = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key)) if len(key) else [0]
    return [
        (int(key[a]), kind, b"".join(rows[a:b][f].tobytes() for f in rows.dtype.names))
        for a, b in zip(cut[:-1], cut[1:], strict=True)
    ]


def _unpacked(data: list[bytes], dtype: np.dtype) -> np.ndarray:
    sizes = [len(d) // dtype.itemsize for d in data]
    out = np.empty(sum(sizes), dtype)
    at = 0
    for d, n in zip(data, sizes, strict=True):
        place = 0
        for f in dtype.names:
            out[f][at : at + n] = np.frombuffer(d, dtype[f], n, place)
            place += n * dtype[f].itemsize
        at += n
    return out


WIRE = pa.schema([("key", pa.int64()), ("kind", pa.int32()), ("data", pa.binary())])
WIRE_DDL = "key long, kind int, data binary"
RECORDS, MARKS, OPENED, SEGMENTS, STARTS = range(5)


def _wired(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    k, kind, data = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table(
        [pa.array(k, pa.int64()), pa.array(kind, pa.int32()), pa.array(data, pa.binary())], schema=WIRE
    )


def _of(t: pa.Table, kind: int) -> list[bytes]:
    kinds = t["kind"].to_numpy()
    return t.filter(pa.array(kinds == kind))["data"].to_pylist() if t.num_rows else []


def _mod(x: np.ndarray, groups: int) -> np.ndarray:
    return (mixed(x.astype(U)) % U(groups)).astype(np.int64)


def heavy_anchors(docs: DataFrame, share: float = HEAVY_SHARE) -> np.ndarray:
    """Anchors with a large share of the records that differ inside their batch."""

    def keys_of(b: pa.RecordBatch) -> np.ndarray:
        data, offsets = utf8(b["text"])
        parts = [r[["h", "c"]] for r in records_of(data, offsets, np.zeros(b.num_rows, np.int64))]
        return np.unique(np.concatenate(parts))["h"] if parts else np.zeros(0, U)

    return heavy_keys(docs.select("text"), keys_of, share)


def marked(docs: DataFrame, groups: int, heavy: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """Wire rows of marks, from whole records and from edges, keyed by groups of documents."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(heavy)  # at most 1 / HEAVY_SHARE hashes

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = utf8(b["text"])
            parts = list(records_of(data, offsets, b["id"].to_numpy()))
            if not parts:
                continue
            # of equal records of a batch one travels on; the others are marked already
            r, again = repeats(np.concatenate(parts))
            known, r = marks_of(r[again]), r[~again]
            far = contained(r["h"], held.value)
            rows = _packed(_mod(r["h"] + np.where(far, r["c"], U(0)), groups), r, RECORDS)
            rows += _packed(_mod(known["doc"], groups), known, MARKS)
            yield from _wired(rows).to_batches()

    def meet(t: pa.Table) -> pa.Table:
        r, again = repeats(_unpacked(_of(t, RECORDS), RECORD))
        marks = np.concatenate([_unpacked(_of(t, MARKS), MARK), marks_of(r[again])])
        first = r[~again]
        lone = np.ones(len(first), dtype=bool)
        same = first["h"][1:] == first["h"][:-1]
        lone[1:] &= ~same
        lone[:-1] &= ~same
        edges = first[~lone | contained(first["h"], held.value)]
        opened = np.empty(len(edges), OPEN)
        for f in OPEN.names:
            opened[f] = edges[f]
        return _wired(
            _packed(_mod(marks["doc"], groups), marks, MARKS)
            + _packed(_mod(opened["doc"], groups), opened, OPENED)
        )

    met = docs.select("id", "text").mapInArrow(emit, WIRE_DDL)
    first = stored(met.groupBy("key").applyInArrow(meet, WIRE_DDL), "marks")

    def fetch(texts: pa.Table, wires: pa.Table) -> pa.Table:
        o = _unpacked(_of(wires, OPENED), OPEN)
        o = o[np.lexsort((o["lo"], o["doc"]))]
        rows: list[tuple[int, int, bytes]] = []
        spans, kept, starts = [], [], []
        for doc_id, packed in _texts(texts):
            a, b = np.searchsorted(o["doc"], [doc_id, doc_id + 1]) if doc_id < 2**63 - 1 else (0, 0)
            own = o[a:b]
            if not len(own):
                continue
            text = np.frombuffer(packed(), np.uint8)
            own = own[own["lo"] + own["n"] + LENGTH - 1 <= len(text)]
            far = contained(own["h"], held.value)
            for x in own[~far]:
                spans.append(text[x["lo"] : x["lo"] + x["n"] + LENGTH - 1])
            kept.append(own[~far])
            if far.any():
                starts.append(_starts(text, own[far]))
        if kept and spans:
            o = np.concatenate(kept)
            sizes = o["n"] + LENGTH - 1
            ends = np.cumsum(sizes)
            joined = np.concatenate(spans)
            key = _mod(o["h"], groups)
            order = np.argsort(key, kind="stable")
            cut = np.append(np.flatnonzero(np.append(True, np.diff(key[order]) != 0)), len(o))
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                some = order[a:b]
                text = b"".join(joined[ends[i] - sizes[i] : ends[i]].tobytes() for i in some)
                header = b"".join(o[some][f].tobytes() for f in OPEN.names)
                rows.append((int(key[some[0]]), SEGMENTS, len(some).to_bytes(8, "little") + header + text))
        if starts:
            s = np.concatenate(starts)
            rows += _packed(_mod(s["g"], groups), s, STARTS)
        return _wired(rows)

    def settle(t: pa.Table) -> pa.Table:
        found = [_settled_segments(_of(t, SEGMENTS)), _settled_starts(_unpacked(_of(t, STARTS), START))]
        marks = np.concatenate(found)
        return _wired(_packed(_mod(marks["doc"], groups), marks, MARKS))

    segments = (
        grouped_texts(docs, groups)
        .groupBy("key")
        .cogroup(first.where(F.col("kind") == OPENED).groupBy("key"))
        .applyInArrow(fetch, WIRE_DDL)
    )
    second = segments.groupBy("key").applyInArrow(settle, WIRE_DDL)
    return first.where(F.col("kind") == MARKS), second


def _starts(text: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Every single start of some records, by a 128-bit hash of its string."""
    lo = np.concatenate([np.arange(x["lo"], x["lo"] + x["n"]) for x in own])
    lo = np.unique(lo)
    h = gram_hashes(text)
    out = np.empty(len(lo), START)
    size = np.full(len(lo), LENGTH)
    out["g"], out["c"] = text_hashes(h, lo, size, 2), text_hashes(h, lo, size, 3)
    out["doc"], out["lo"] = own["doc"][0], lo
    return out


def _settled_starts(s: np.ndarray) -> np.ndarray:
    s = s[np.lexsort((s["lo"], s["doc"], s["c"], s["g"]))]
    new = np.ones(len(s), dtype=bool)
    new[1:] = (s["g"][1:] != s["g"][:-1]) | (s["c"][1:] != s["c"][:-1])
    head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(s) else np.zeros(0, np.int64)
    s = s[(s["doc"] != s["doc"][head]) | (s["lo"] != s["lo"][head])]
    out = np.empty(len(s), MARK)
    out["doc"], out["lo"], out["n"] = s["doc"], s["lo"], 1
    return out


def _settled_segments(blobs: list[bytes]) -> np.ndarray:
    """Marks of the starts of open records that have a previous factor."""
    heads, texts = [], []
    for blob in blobs:
        n = int.from_bytes(blob[:8], "little")
        end = 8 + n * OPEN.itemsize
        heads.append(_unpacked([blob[8:end]], OPEN))
        texts.append(np.frombuffer(blob, np.uint8, offset=end))
    if not heads:
        return np.empty(0, MARK)
    o, text = np.concatenate(heads), np.concatenate(texts)
    sizes = o["n"].astype(np.int64) + LENGTH - 1
    base = np.cumsum(sizes) - sizes
    # text order of the starts: by document, then place
    order = np.lexsort((o["lo"], o["doc"]))
    o, base = o[order], base[order]
    n = o["n"].astype(np.int64)
    owner = np.repeat(np.arange(len(o)), n)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    again, by_suffix, same = previous_factors(text, base[owner] + step)
    doc, lo = o["doc"][owner], o["lo"][owner] + step
    # repeated rows bring the same start twice: it is not its own earlier match
    head = np.append(True, ~same)
    first = by_suffix[np.flatnonzero(head)[np.cumsum(head) - 1]]
    own = np.zeros(len(owner), dtype=bool)
    own[by_suffix] = (doc[by_suffix] == doc[first]) & (lo[by_suffix] == lo[first])
    again &= ~own
    out = np.empty(int(again.sum()), MARK)
    out["doc"], out["lo"], out["n"] = doc[again], lo[again], 1
    return joined_marks(out)


def joined_marks(m: np.ndarray) -> np.ndarray:
    """Marks in order, with adjoining and overlapping ones made one."""
    if not len(m):
        return m
    m = m[np.lexsort((m["lo"], m["doc"]))]
    end = m["lo"] + m["n"]
    # ends are compared inside a document; a running maximum over documents must not mix them
    doc_new = np.append(True, m["doc"][1:] != m["doc"][:-1])
    rank = np.cumsum(doc_new) - 1
    span = int(end.max()) + 2
    reach = np.maximum.accumulate(end + rank * span) - rank * span
    new = doc_new.copy()
    new[1:] |= m["lo"][1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(m)) - 1
    out = np.empty(len(first), MARK)
    out["doc"], out["lo"] = m["doc"][first], m["lo"][first]
    out["n"] = reach[last] - out["lo"]
    return out


def grouped_texts(docs: DataFrame, groups: int) -> DataFrame:
    """``key, id, z`` of every row: its group, and its text compressed for the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for b in batches:
            data, offsets = utf8(b["text"])
            joined = data.tobytes()
            z = [press.compress(joined[x:y]) for x, y in zip(offsets[:-1], offsets[1:], strict=True)]
            key = _mod(b["id"].to_numpy(), groups)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), b["row"], b["id"], pa.array(z, pa.binary())], ["key", "row", "id", "z"]
            )

    kept = docs.select("row", "id", "text")
    schema = T.StructType().add("key", "long").add(kept.schema["row"]).add("id", "long").add("z", "binary")
    return kept.mapInArrow(run, schema)


def _texts(t: pa.Table):
    unpress = zstandard.ZstdDecompressor()
    for doc_id, z in zip(t["id"].to_pylist(), t["z"], strict=True):
        yield doc_id, (lambda z=z: unpress.decompress(z.as_py()))


def spans_of(size: int, m: np.ndarray) -> list[tuple[int, int]]:
    """Maximal removed runs of a text of ``size`` bytes."""
    covered = m.copy()
    covered["n"] += LENGTH - 1
    return [(int(x["lo"]), min(size, int(x["lo"] + x["n"]))) for x in joined_marks(covered)]


def whole_characters(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """What is left when only whole UTF-8 characters inside the runs are removed."""
    at, kept = 0, []
    for x, y in spans:
        while x < y and data[x] & 0xC0 == 0x80:
            x += 1
        while y > x and y < len(data) and data[y] & 0xC0 == 0x80:
            y -= 1
        kept.append(data[at:x])
        at = max(at, y)
    return b"".join([*kept, data[at:]])


def _own_ids(keyed: DataFrame) -> DataFrame:
    """``keyed`` with an ``id`` for every document, in their order.

    Where no id is null or repeated, it stays. Otherwise the distinct pairs of id and text hash are
    numbered in order, and written once so that their numbers stay.
    """
    unfit = keyed.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | (F.col("id") == NO_ID))
    if unfit.isEmpty():
        return keyed
    named = keyed.withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256))
    pairs = named.select("id", "digest").distinct().orderBy("id", "digest")
    numbers = stored(pairs.withColumn("number", F.monotonically_increasing_id()), "ids")
    return named.join(numbers, ["id", "digest"]).select(F.col("number").alias("id"), "row", "text")


def deduplicate(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row of ``doc_id, text``.

    With ``with_text`` also ``spans``, the removed runs, ``kept_text``, the text without the whole
    characters inside them, and ``row``, the columns of the input row.
    """
    spark = docs.sparkSession
    small_batches(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # a prime-like count keeps groups even for ids with a common step
    groups = 2 * (size // GROUP_BYTES // 2) + 13
    keyed = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"),
        F.struct(
            F.col("doc_id").cast("long").alias("doc_id"),
            *([F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")] if with_text else []),
        ).alias("row"),
        F.col("text").cast("string").alias("text"),
    )
    keyed = _own_ids(keyed)
    first, second = marked(keyed, groups, heavy_anchors(keyed))
    out = (
        T.StructType()
        .add("doc_id", "long")
        .add("n_bytes", "long")
        .add("n_removed", "long")
        .add("n_spans", "long")
        .add("kept_sha256", "string")
    )
    if with_text:
        span = T.StructType().add("start", "long").add("end", "long")
        out = out.add("spans", T.ArrayType(span)).add("kept_text", "string")
        out = out.add("row", keyed.schema["row"].dataType)

    def drop(texts: pa.Table, wires: pa.Table) -> pa.Table:
        m = joined_marks(_unpacked(_of(wires, MARKS), MARK))
        columns: list[list] = [[] for _ in range(6)]
        for doc_id, text in _texts(texts):
            data = text()
            a, b = np.searchsorted(m["doc"], doc_id, "left"), np.searchsorted(m["doc"], doc_id, "right")
            spans = spans_of(len(data), m[a:b])
            at, digest, left = 0, hashlib.sha256(), 0
            for x, y in [*spans, (len(data), len(data))]:
                digest.update(data[at:x])
                left += x - at
                at = y
            found = [len(data), len(data) - left, len(spans), digest.hexdigest()]
            if with_text:
                found += [[{"start": x, "end": y} for x, y in spans], whole_characters(data, spans).decode()]
            for column, value in zip(columns, found, strict=False):
                column.append(value)
        row = texts["row"].combine_chunks()
        arrays = [row.field("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3])]
        arrays.append(pa.array(columns[3], pa.string()))
        if with_text:
            span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
            arrays += [pa.array(columns[4], pa.list_(span)), pa.array(columns[5], pa.string()), row]
        return pa.table(arrays, names=out.fieldNames())

    return (
        grouped_texts(keyed, groups)
        .groupBy("key")
        .cogroup(first.unionAll(second).groupBy("key"))
        .applyInArrow(drop, out)
    )

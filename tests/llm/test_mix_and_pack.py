"""Mixing and packing."""

import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sitrep.llm import mixing, packing, queries
from sitrep.llm.common import count_words, table

SMALL = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("word_bpe_49k.json")


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Shares by weight; what is above a cap is shared again among the others."""
    names = sorted(k for k in sizes if k is not None) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    fixed, free = {}, set(names)
    while True:
        left = share * sum(sizes.values()) - sum(fixed.values())
        total = sum(weight[s] for s in free)
        level = {s: left * weight[s] / total for s in free}
        over = {s for s in free if level[s] > most * sizes[s]}
        if not over:
            return fixed | level
        fixed |= {s: most * sizes[s] for s in over}
        free -= over


def test_mix_meets_its_targets(spark):
    got = queries.op8_mix_sources(spark, SMALL).cache()
    docs = table(spark, SMALL, "documents").select("doc_id", "source", "text").collect()
    sizes = {}
    for r in docs:
        sizes[r.source] = sizes.get(r.source, 0) + len(mixing_words(r.text))
    want = targets(sizes)
    source = {r.doc_id: r.source for r in docs}
    taken = {}
    for r in got.collect():
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 2 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 2
    again = queries.op8_mix_sources(spark, SMALL)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got.collect()))


def mixing_words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_flight_keeps_the_sums():
    draw = np.random.default_rng(5)
    for n in (0, 1, 2, 3, 50, 700):
        sizes = draw.integers(0, 900, n)
        p = mixing.fly(np.full(n, 0.37), sizes)
        assert ((p > 0) & (p < 1)).sum() <= 2
        assert p.sum() == pytest.approx(0.37 * n, abs=1e-6)
        assert p @ sizes == pytest.approx(0.37 * sizes.sum(), abs=1e-3)
    assert ((mixing.fly(np.full(40, 0.5), np.full(40, 7)) % 1) == 0).sum() >= 38


def test_blocks_of_a_hot_source(spark):
    rows = [(i, "w " * (1 + i % 37), "hot" if i % 3 else f"s{i % 5}") for i in range(900)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block=50)
    sums = got.groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert all(abs(r.taken - r.target) <= 20 for r in sums)


def test_mix_awkward(spark, awkward, empty):
    got = mixing.mix(awkward).collect()
    assert len(got) == 10 and all(0 <= r.taken <= 2 * r["size"] for r in got)
    rows = mixing.mixed_documents(awkward.where("doc_id is not null"))
    assert rows.columns == awkward.columns
    total = sum(len(mixing_words(r.text)) for r in rows.where("doc_id = 6").collect())
    assert total == next(r.taken for r in mixing.mix(awkward.where("doc_id is not null")).collect() if r.doc_id == 6)
    assert mixing.mix(empty).count() == 0


def test_words_by_bytes():
    import pyarrow as pa

    texts = [None, "", " ", "a", " a b", "a b c", "é\tß\x0b漢 ", "x" * 10]
    assert count_words(pa.array(texts)).tolist() == [len(mixing_words(t)) for t in texts]
    assert count_words(pa.array(texts).slice(3, 4)).tolist() == [1, 2, 2, 3]
    assert count_words(pa.array([], pa.string())).tolist() == []


def check_pieces(pieces, texts, capacity=4096):
    """Every id of every document in one piece, sequences gapless, no padding needed."""
    tokenizer = Tokenizer.from_file(PATH)
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    assert set(by_doc) == set(texts)
    for d, text in texts.items():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        at = 0
        for p in sorted(by_doc[d], key=lambda p: p["start"]):
            part = ids[p["start"] : p["start"] + p["length"]]
            assert (p["start"], p["doc_tokens"]) == (at, len(ids)) and len(part) == p["length"] > 0
            assert p["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            at += len(part)
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == capacity or at & (at - 1) == 0 and at < capacity


def test_pack_query_round_trip(spark):
    texts = {r.doc_id: r.text for r in table(spark, SMALL, "documents").collect()}
    check_pieces([r.asDict() for r in queries.op9_pack_sequences(spark, SMALL).collect()], texts)


def test_pack_awkward(spark, awkward, empty):
    unique = awkward.dropDuplicates(["doc_id"]).where("doc_id is not null").repartition(2)
    got = packing.pack(unique, packing.word_encoder(PATH)).collect()
    check_pieces([r.asDict() for r in got], {r.doc_id: r.text for r in unique.collect()})
    for r in got:
        assert zlib.crc32(struct.pack(f"<{r.length}I", *r.ids)) == r.ids_crc32
    twice = packing.pack(awkward, packing.word_encoder(PATH), with_ids=False)
    assert twice.where("doc_id = 7 and start = 0").count() == 2
    assert packing.pack(empty, packing.word_encoder(PATH)).count() == 0


@pytest.mark.parametrize("capacity", [16, 64])
def test_classes_fill_by_count(capacity):
    draw = np.random.default_rng(capacity)
    packer = packing.Packer(0, capacity, 8)
    sizes = draw.integers(1, 3 * capacity, 300)
    for d, n in enumerate(sizes):
        packer.add(d, np.arange(n, dtype="<u4").tobytes())
    packer.close()
    length, whole = {}, {}
    for doc, start, n, ids, total, seq, offset in packer.rows:
        assert offset == length.get(seq, 0) and total == sizes[doc]
        assert np.frombuffer(ids, "<u4").tolist() == list(range(start, start + n))
        length[seq] = offset + n
        whole[doc] = whole.get(doc, 0) + n
    assert whole == dict(enumerate(sizes))
    short = [n for n in length.values() if n < capacity]
    assert all(n & (n - 1) == 0 for n in short) and len(short) <= capacity.bit_length()


def test_mixed_rows_come_to_their_targets_with_repeated_and_null_ids(spark):
    rows = [(1, f"a{i % 3} b c d", "x") for i in range(30)] + [(None, "n " * (1 + i % 5), "y") for i in range(40)]
    rows += [(2, "one two three", "z"), (2, "four", "z"), (2, None, "z"), (3, "five six", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    want = targets({s: sum(len(mixing_words(t)) for _, t, x in rows if x == s) for s in "xyz"})
    got = mixing.mixed_documents(docs).collect()
    for s in "xyz":
        assert abs(sum(len(mixing_words(r.text)) for r in got if r.source == s) - want[s]) <= 2
    given = {(d, s, t[:1]) for d, t, s in rows if t}
    assert all((r.doc_id, r.source, r.text[:1]) in given for r in got)
    again = mixing.mixed_documents(docs.repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mixed_awkward_rows_are_those_of_the_mix(spark, awkward):
    shares, rows = mixing.mix(awkward).collect(), mixing.mixed_documents(awkward).collect()
    for d in {r.doc_id for r in shares}:
        mixed = sum(len(mixing_words(r.text)) for r in rows if r.doc_id == d)
        assert mixed == sum(r.taken for r in shares if r.doc_id == d), d
    assert any(r.doc_id is None for r in rows)


def test_words_are_folded_only_where_the_tokenizer_folds():
    """Signs, accents, apostrophes, characters that compose and odd white space: the tokenizer's ids."""
    draw = random.Random(3)
    letters = "aAbZzéÉß×÷ÿÀ«»¿.,;:!?'’ \t\n-_ 0 1µªº't's'll İΣςé漢字\U0001f600()\"&\x85\xa0\x1c ſ"
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 40))) for _ in range(3000)]
    texts += ["Don't, IT'S;we'LL 'tis ''s !'s x!'S", "", None, "A<|endoftext|>B <|ENDOFTEXT|>", "<|startoftext|>"]
    encoder = packing.WordIds(PATH, cached=500)
    assert encoder.fold
    ids, starts = encoder.encode(pa.array(texts))
    for k, text in enumerate(texts):
        want = encoder.tokenizer.encode(text or "", add_special_tokens=False).ids
        assert ids[starts[k] : starts[k + 1]].tolist() == want


def test_equal_rows_are_dealt_over_the_blocks(spark, monkeypatch):
    """Thousands of equal rows, with an id and without, fill no block beyond the others."""
    monkeypatch.setattr(mixing, "PIECE", 700)
    texts = [(1, "a b c", "s")] * 3000 + [(None, None, "s")] * 2000 + [(i, "x " * (i % 9), "s") for i in range(2, 1000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, source string").repartition(4)
    sizes = mixing.sizes_of(docs).cache()
    rows = mixing.placed(sizes)
    assert rows.count() == rows.select("doc_id", "text_hash", "size", "place").distinct().count() == len(texts)
    blocks = mixing.dealt(rows, mixing.targets_of(sizes), 200).groupBy("block").count().collect()
    assert len(blocks) == 30 and max(r["count"] for r in blocks) < 300
    got = mixing.mix(docs, block=200).collect()
    assert len(got) == len(texts) and all(0 <= r.taken <= 2 * r.size for r in got)
    assert abs(sum(r.taken for r in got) - got[0].target) <= len(blocks)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(7), block=200).collect()), key=str)

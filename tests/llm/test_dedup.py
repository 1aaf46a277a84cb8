"""Jaccard join, embedding and suffix dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from sitrep.llm import embedding_dedup, graph, jaccard_join, queries, suffix_dedup
from sitrep.llm.common import table

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def find(p, x):
    while p[x] != x:
        x = p[x]
    return x


def joined(ids, linked):
    p = {i: i for i in ids}
    for a, b in linked:
        a, b = find(p, a), find(p, b)
        p[max(a, b)] = min(a, b)
    return {i: find(p, i) for i in ids}


def brute_join(rows, n=4, percent=85):
    sets = {}
    for d, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}
    linked = [
        (a, b)
        for a in sets
        for b in sets
        if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    part = joined(sets, linked)
    return {d: (len(s), part[d]) for d, s in sets.items()}


def near_copies(seed):
    """Groups with few and many edits, shared passages, short texts, ties at the threshold."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(60)]
    rows = []
    for _ in range(12):
        body = [word() for _ in range(draw.choice([5, 20, 60, 200]))]
        for _ in range(draw.choice([1, 2, 8])):
            copy = list(body)
            for _ in range(draw.choice([0, 0, 1, 2, 6])):
                copy[draw.randrange(len(copy))] = word()
            if draw.random() < 0.4:
                copy = copy + passage
            rows.append((len(rows), draw.choice([" ", "\n", "  "]).join(copy).title()))
    return rows + [(900, "a b"), (901, "A  b"), (902, "a"), (903, None), (904, " ")]


@pytest.mark.parametrize(("seed", "rule"), [(1, (4, 85)), (2, (4, 85)), (1, (5, 80)), (2, (5, 80)), (3, (1, 100))])
def test_join_is_exact(spark, seed, rule, monkeypatch):
    rows = near_copies(seed)
    if seed == 2:  # no first round: all links must come from the product
        monkeypatch.setattr(jaccard_join, "star_pairs", lambda n, _: n.selectExpr("node a", "node b").limit(0))
    got = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string"), *rule).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_join(rows, *rule)


def test_one_column_of_a_large_family_and_a_stray_row():
    """Only rows of different parts meet; the pairs are those of all against all."""
    draw = np.random.default_rng(5)
    rule = jaccard_join.Rule()
    for m, parts in ((300, 4), (50, 50), (2, 2)):
        e = np.zeros(m, jaccard_join.ENTRY)
        e["node"], e["n"] = draw.permutation(m), draw.integers(5, 9, m)
        e["at"], e["part"] = draw.integers(0, 2, m), draw.integers(0, parts, m) * (draw.random(m) < 0.4)
        want = set()
        for x in e:
            for y in e:
                most = min(x["at"], y["at"]) + min(x["n"] - x["at"], y["n"] - y["at"])
                if x["node"] < y["node"] and x["part"] != y["part"] and most >= rule.needed(int(x["n"]), int(y["n"])):
                    want.add((x["node"], y["node"]))
        got = jaccard_join._products(e, rule)
        assert [(a, b) for a, b in zip(got["a"], got["b"], strict=True)] == sorted(want)
    e = np.zeros(100_000, jaccard_join.ENTRY)
    e["node"], e["n"] = np.arange(len(e)), 20
    e["part"][7] = 1
    assert len(jaccard_join._products(e, rule)) == len(e) - 1


def test_join_query(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SMALL, "documents").collect()]
    got = queries.op3_jaccard_join(spark, SMALL).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_join(rows)


def test_prefix_and_needed_overlap_are_those_of_the_threshold():
    for percent in (80, 85, 100):
        rule = jaccard_join.Rule(4, percent)
        for na in range(1, 60):
            for nb in range(1, 60):
                least = next((c for c in range(150) if 100 * c >= percent * (na + nb - c)))
                assert rule.needed(np.int64(na), np.int64(nb)) == least
                assert rule.linked(least, na, nb) and not rule.linked(least - 1, na, nb)


def test_join_awkward(spark, awkward, empty):
    got = jaccard_join.join(awkward).collect()
    assert len(got) == 10
    by = {r.doc_id: r for r in got}
    assert by[5].component_id == 4 and by[1].n_shingles == by[3].n_shingles == 0
    assert by[3].component_id == 3 and by[None].component_id is None
    assert jaccard_join.join(empty).count() == 0


@pytest.mark.parametrize("last", [0, 1])
def test_join_of_one_id_over_two_texts(spark, last):
    a, b = (" ".join(f"{k}{i}" for i in range(60)) for k in "ab")
    both = [(7, a), (7, b)]
    rows = [*both[last:], *both[:last], (8, a + " x"), (9, b + " y"), (10, "c " + a[:40]), (6, "")]
    got = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert {r.doc_id: r.component_id for r in got} == {6: 6, 7: 7, 8: 7, 9: 7, 10: 10}


def test_components(spark):
    draw = random.Random(4)
    ids = list(range(200))
    linked = [(i, i + 1) for i in range(60)] + [(draw.randrange(200), draw.randrange(200)) for _ in range(40)]
    got = graph.components(
        spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame(linked, "a long, b long")
    ).collect()
    assert {r.id: r.component_id for r in got} == joined(ids, linked)


def vectors(seed, n=260, dim=24):
    draw = np.random.default_rng(seed)
    centre = draw.normal(size=(20, dim))
    x = centre[draw.integers(0, 20, n)] + draw.choice([0, 0.02, 0.15], size=(n, 1)) * draw.normal(size=(n, dim))
    return [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, draw.integers(0, 3, n), strict=True))]


def brute_vectors(rows):
    ok = {}
    for i, v, label in rows:
        if v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, dtype=np.float32).astype(float)
            ok[i] = (x / np.linalg.norm(x), label)
    near = [
        (a, b) for a in ok for b in ok
        if a < b and ok[a][1] == ok[b][1] and len(ok[a][0]) == len(ok[b][0]) and ok[a][0] @ ok[b][0] >= 0.98
    ]
    part = joined([r[0] for r in rows], near)
    links = {r[0]: 0 for r in rows}
    for a, b in near:
        links[a] += 1
        links[b] += 1
    return {i: (links[i], part[i], part[i] == i) for i in links}


@pytest.mark.parametrize("block", [1024, 4])
def test_embeddings(spark, block):
    rows = vectors(block)
    rows += [(900 + k, rows[0][1], rows[0][2]) for k in range(12)]  # a group of equal vectors
    rows += [
        (950, None, 1), (951, [0.0] * 24, 1), (952, [None] + [1.0] * 23, 1),
        (953, [float("nan")] * 24, 1), (954, [float("inf")] * 24, 1), (955, rows[3][1], None),
        (956, [1.0, 2.0], 1), (957, [2.0, 4.0], 1), (958, [], 1), (959, [-0.0, 1.0], 2), (960, [0.0, 1.0], 2),
        (961, [3.0], 1), (962, [4.0], 1), (963, [-4.0], 1),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, v string, n int")
    got = embedding_dedup.near_duplicates(df, block=block).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == brute_vectors(rows)


def test_embeddings_of_repeated_and_null_ids(spark):
    """One row in the result for every row, whatever the ids."""
    rows = [
        (1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [0.0, 2.0], 1), (3, [1.0, 1.0], 1),
        (None, [5.0, 5.1], 1), (None, [-1.0, 1.0], 1), (4, None, 1), (4, None, 1), (4, [0.0, 0.0], 1),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = embedding_dedup.near_duplicates(df).collect()
    # ids 1 and 2 are linked by the second vector of 1
    found = sorted([tuple(r)[:3] for r in got], key=str)
    assert len(found) == len(rows) and [r for r in found if r[0] == 4] == [(4, 0, 4)] * 3
    assert sum(r[0] == 1 for r in found) == 3 and {r[2] for r in found if r[0] in (1, 2)} == {1}
    assert [r for r in found if r[0] == 2] == [(2, 1, 1)]


def test_embeddings_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.near_duplicates(df).count() == 0
    df = spark.createDataFrame([(1, None, None)], "vec_id long, embedding array<float>, label int")
    assert [tuple(r) for r in embedding_dedup.near_duplicates(df).collect()] == [(1, 0, 1, True)]


def brute_bytes(rows):
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        hit = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                hit[i : i + 100] = True
            seen.add(b[i : i + 100])
        runs = int((np.diff(np.concatenate([[0], hit.astype(int)])) == 1).sum())
        left = np.frombuffer(b, np.uint8)[~hit].tobytes()
        out[d] = (len(b), int(hit.sum()), runs, hashlib.sha256(left).hexdigest())
    return out


def passages(seed):
    draw = random.Random(seed)
    text = lambda n: "".join(draw.choice("abcd éß") for _ in range(n))
    shared = [text(n) for n in (90, 99, 100, 101, 140, 400)]
    rows = []
    for i in range(40):
        parts = [text(draw.choice([0, 3, 50, 300]))]
        for _ in range(draw.choice([0, 1, 3])):
            parts += [draw.choice(shared), text(draw.choice([0, 1, 40]))]
        rows.append((i, "".join(parts)))
    rows += [(50, rows[0][1]), (51, "a" * 500), (52, "a" * 100), (53, "ab" * 200), (54, None), (55, "")]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("case", ["plain", "heavy", "cut"])
def test_repeats_are_exact(spark, case, monkeypatch):
    rows = passages(len(case))
    if case == "heavy":  # every anchor by way of its single starts
        every = lambda docs, share=0: np.sort(
            np.unique(np.concatenate([suffix_dedup.gram_hashes(np.frombuffer((t or "").encode(), np.uint8)) for _, t in rows]))
        )
        monkeypatch.setattr(suffix_dedup, "heavy_anchors", every)
    if case == "cut":
        monkeypatch.setattr(suffix_dedup, "CHUNK", 150)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = suffix_dedup.deduplicate(df).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out}
    assert got == brute_bytes(rows)
    for r in out:
        text = next(t for d, t in rows if d == r.doc_id) or ""
        cut = [text.encode()[s.start : s.end] for s in r.spans]
        assert sum(map(len, cut)) == r.n_removed
        assert len(r.kept_text.encode()) >= r.n_bytes - r.n_removed


def test_repeats_awkward(spark, awkward, empty):
    rows = suffix_dedup.deduplicate(awkward).collect()
    assert len(rows) == 10
    by = {r.doc_id: r for r in rows}
    assert by[5].n_removed == by[5].n_bytes and by[4].n_removed == 0
    assert by[5].row["z"] == "z" and by[5].kept_text == ""
    long = spark.createDataFrame([(1, "xyz" * 200, 1), (1, "xyz" * 200, 2)], "doc_id long, text string, n long")
    assert len({r.n_removed for r in suffix_dedup.deduplicate(long).collect()}) == 1
    assert suffix_dedup.deduplicate(empty).count() == 0
    assert suffix_dedup.whole_characters("aéb".encode(), [(2, 4)]).decode() == "aé"


def test_repeats_under_shared_and_null_ids(spark):
    draw = random.Random(9)
    text = lambda n: "".join(draw.choice("abcdefgh ") for _ in range(n))
    x, a, b, c, d = text(200), text(150), text(400), text(150), text(330)
    rows = [(1, x), (7, x + a), (7, b), (7, b), (None, c + c), (None, d), (None, d), (9, d[:120]), (9, None), (9, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.deduplicate(df, with_text=False).collect()}
    # documents: the distinct pairs, null ids first, then in the order of the text's hash
    order = sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(r[1].encode()).hexdigest()))
    want = brute_bytes([(k, t) for k, (_, t) in enumerate(order)])
    assert got == {(i, *want[k]) for k, (i, _) in enumerate(order)}
    assert suffix_dedup.deduplicate(df, with_text=False).count() == len(rows)
    assert [r[2] for r in got if r[0] == 7 and r[1] == 400] == [0]

"""Language ID, quality classifier and token counts."""

import math
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from sitrep.llm import language_id, quality_classifier, queries, token_counts
from sitrep.llm.common import table

SMALL = "/root/testdata/sf0.01"
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def test_language_held_out_accuracy(spark):
    found = queries.op7_language_id(spark, SMALL)
    truth = table(spark, SMALL, "documents").select("doc_id", "lang")
    rows = found.join(truth, "doc_id").where("held_out").collect()
    assert len(rows) > 200
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_words_first_then_shorter_grams(spark):
    train = spark.createDataFrame(
        [(1, "the cat house", "en"), (2, "die katze haus", "de"), (3, None, "fr"), (4, "x", None)],
        "doc_id long, text string, lang string",
    )
    model = language_id.fit(train)
    assert model.langs == ["de", "en"]
    score_of = language_id.Scorer(model).score
    assert score_of("THE cat")[0] == "en"
    assert score_of("katzen")[0] == "de"  # unseen: its longest known n-grams decide
    assert not model.logs_of(["qqqq"]).any()
    assert score_of("12 34!") == ("und", 0.0)
    assert score_of("") == score_of(None) == ("und", 0.0)
    lang, score = score_of("qq")
    assert lang == "de" and score == pytest.approx(0.5)  # nothing known: shares, first name


def test_language_scores_do_not_depend_on_what_is_remembered(spark, monkeypatch):
    texts = [r.text for r in table(spark, SMALL, "documents").limit(40).collect()]
    model = language_id.fit(table(spark, SMALL, "documents").limit(20))
    plain = language_id.Scorer(model)
    want = [plain.score(t) for t in texts]
    monkeypatch.setattr(language_id, "PART", 7)
    small = language_id.Scorer(model, cached=10)
    for t, (lang, score) in zip(texts, want, strict=True):
        got = small.score(t)
        assert got[0] == lang and got[1] == pytest.approx(score)


def plain_language(train, text):
    """Language and score by the definition, one word after the other."""
    langs = sorted({lang for lang, t in set(train) if lang and t is not None})
    words, grams = {x: Counter() for x in langs}, {x: Counter() for x in langs}
    texts = {(lang, t) for lang, t in train if lang and t is not None}
    for lang, t in texts:
        for w in re.findall(r"[^\W\d_]+", t.lower()):
            words[lang][w] += 1
            grams[lang].update(g for n in range(1, 6) for g in language_id.grams_of(w, n))

    def log(counts, item):
        known = set().union(*counts.values())
        if item not in known:
            return None
        return [math.log((counts[x][item] + 0.5) / (sum(counts[x].values()) + 0.5 * len(known))) for x in langs]

    n = Counter(lang for lang, _ in texts)
    total = [math.log(n[x] / len(texts)) for x in langs]
    for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
        found = [log(words, w)] if log(words, w) else []
        for size in range(5, 0, -1):
            if found:
                break
            found = [x for x in (log(grams, g) for g in language_id.grams_of(w, size)) if x]
        for i in range(len(langs)):
            total[i] += sum(x[i] for x in found) / max(1, len(found))
    odds = [math.exp(x - max(total)) for x in total]
    best = odds.index(max(odds))
    return langs[best], odds[best] / sum(odds)


def test_language_equals_the_plain_definition(spark):
    docs = table(spark, SMALL, "documents").orderBy("doc_id").limit(40).selectExpr("doc_id", "left(text, 150) text", "lang")
    rows = docs.collect()
    train = [(r.lang, r.text) for r in rows[:12]] * 2 + [(None, "x"), ("xx", None)]
    labelled = spark.createDataFrame(train, "lang string, text string")
    found = language_id.identify(docs, language_id.fit(labelled)).collect()
    seen = 0
    for r, got in zip(rows, sorted(found, key=lambda x: x.doc_id), strict=True):
        if re.search(r"[^\W\d_]", r.text):
            lang, score = plain_language(train, r.text)
            assert got.score == pytest.approx(score, abs=1e-4) and got.lang_pred == lang
            seen += 1
    assert seen > 30


def test_language_sample_is_bounded_by_distinct_texts(spark):
    copies = spark.range(3000).selectExpr("'en' lang", "if(id < 1500, 'the one text', concat('text ', id)) text")
    assert 250 < language_id.sampled(copies, 400).count() < 550
    assert language_id.sampled(copies.where("id < 1500"), 400).count() == 1
    assert language_id.sampled(copies, 3000).count() == 1501


def test_language_awkward(spark, awkward, empty):
    model = language_id.fit(awkward)
    rows = language_id.identify(awkward, model).collect()
    assert len(rows) == 10
    assert [r.lang_pred for r in rows if r.doc_id in (1, 2, 3)] == ["und"] * 3
    assert language_id.identify(empty, model).count() == 0
    none = language_id.fit(empty)
    assert {r.lang_pred for r in language_id.identify(awkward, none).collect()} == {"und"}


def test_held_out_is_never_null(spark, tmp_path):
    docs = spark.createDataFrame([(None, "one two", "en"), (3, "drei vier", "de")], "doc_id long, text string, lang string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op7_language_id(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.held_out for r in rows}[None] is False


def test_quality_held_out(spark):
    found = queries.op4_quality_classifier(spark, SMALL)
    rows = found.join(table(spark, SMALL, "labels"), "doc_id").where("held_out").collect()
    good = np.array([r.score for r in rows if r.quality == 1])
    bad = np.array([r.score for r in rows if r.quality == 0])
    assert np.mean([(good > b).mean() for b in bad]) > 0.98
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert all(r.predicted == int(r.score >= 0.7) for r in rows)


def test_quality_pairs_by_the_identity():
    draw = np.random.default_rng(3)
    m = quality_classifier.Machine(8, np.zeros((0, 0)), 0.3, draw.normal(size=8), draw.normal(size=(8, 4)))
    at, x, rows = np.array([1, 3, 5, 2, 7]), draw.normal(size=5), np.array([0, 3])
    want = []
    for lo, hi in ((0, 3), (3, 5)):
        z = m.bias + sum(m.w[at[i]] * x[i] for i in range(lo, hi))
        for i in range(lo, hi):
            for j in range(i + 1, hi):
                z += m.v[at[i]] @ m.v[at[j]] * x[i] * x[j]
        want.append(z)
    assert m.raw(at, x, rows) == pytest.approx(want)


def test_quality_awkward(spark, awkward, empty):
    labelled = awkward.withColumn("quality", F.when(F.col("doc_id") % 2 == 0, 1).otherwise(0))
    machine = quality_classifier.fit(labelled)
    scores = quality_classifier.score(awkward, machine).collect()
    assert len(scores) == 10 and all(0 <= r.score <= 1 for r in scores)
    assert len({r.score for r in scores if r.doc_id == 7}) == 1
    kept = quality_classifier.keep_good(awkward, machine, cut=0.0)
    assert kept.columns == awkward.columns and kept.count() == 10
    blank = quality_classifier.fit(empty.withColumn("quality", F.lit(1)))
    assert {r.score for r in quality_classifier.score(awkward, blank).collect()} == {0.5}
    assert quality_classifier.score(empty, machine).count() == 0


def test_trie_counts_as_a_unigram_tokenizer(spark):
    scores = token_counts.vocabulary(PIECES)
    pieces = [("<unk>", 0.0), *scores.items(), *[(f"<0x{i:02X}>", -1e9) for i in range(256)]]
    tokenizer = Tokenizer(models.Unigram(pieces, 0, True))
    trie = token_counts.Trie(scores)
    small = token_counts.Trie(scores, max_nodes=50)
    seen = {w for r in table(spark, SMALL, "documents").limit(60).collect() for w in r.text.split()}
    for w in sorted(seen)[:3000] + ["漢字漢", "a\U0001f600b"]:
        want = len(tokenizer.encode("▁" + w).ids)
        assert trie.count("▁" + w) == small.count("▁" + w) == want, w


def test_token_counts_awkward(spark, awkward, empty):
    scores = token_counts.vocabulary(PIECES)
    rows = token_counts.count_tokens(awkward, scores).collect()
    trie = token_counts.Trie(scores)
    for r, d in zip(rows, awkward.collect(), strict=True):
        w = (d.text or "").split()
        assert (r.n_pretokens, r.n_distinct) == (len(w), len(set(w)))
        assert r.n_tokens == sum(trie.count("▁" + x) for x in w)
    assert token_counts.count_tokens(empty, scores).count() == 0

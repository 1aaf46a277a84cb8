"""The pipeline's stages, their registration, and the entry without the subpackage."""

import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry
import corpus_pipeline
from pyspark.sql import functions as F

from sitrep.llm.common import stored, table

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SMALL = "/root/testdata/sf0.001"


def test_every_dealt_query_is_registered():
    names = entry.queries()
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and corpus_pipeline.ORACLE_SQL is None


def test_stages_take_effect(spark):
    docs = table(spark, SMALL, "documents")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SMALL), "test-" + name.replace(" ", "-"))
        out[name] = docs
    names = list(out)
    for name in names[1:-1]:
        assert out[name].columns == out["documents"].columns
    good, one, cut, mix, packed = (out[n] for n in names[1:])
    labels = table(spark, SMALL, "labels")
    kept = good.join(labels, "doc_id")
    assert kept.where("quality = 1").count() == labels.where("quality = 1").count()
    assert kept.where("quality = 0").count() < labels.where("quality = 0").count()
    assert one.count() < good.count() and one.join(good, "doc_id", "left_anti").count() == 0
    assert cut.join(one, "doc_id", "left_anti").count() == 0
    texts = cut.select("doc_id", F.col("text").alias("cut")).join(one, "doc_id")
    assert texts.where("length(cut) > length(text)").count() == 0
    assert texts.where("length(cut) < length(text)").count() > 0
    assert mix.where("length(text) <> n_chars").count() == 0
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {
        r.doc_id for r in mix.select("doc_id").distinct().collect()
    }


def test_pipeline_of_nothing(spark, empty):
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SMALL), "test-empty")
    assert docs.count() == 0


def test_entry_without_the_subpackage(tmp_path):
    shutil.copytree(os.path.join(ROOT, "sitrep"), tmp_path / "sitrep", ignore=shutil.ignore_patterns("llm"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and len(q) > 90; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": ""})


def test_rows_with_null_and_repeated_ids_are_documents(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(3, text(1)), (7, text(2)), (7, text(2)), (7, text(3)), (9, text(3) + " end"), (None, text(4))]
    rows += [(None, text(4)), (None, text(5)), (None, text(1)), (None, None), (8, text(6)[:200] + " " + text(5))]
    docs = spark.createDataFrame([(*r, "en", "a", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.one_of_each_group(spark, docs, SMALL)
    left = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    want = [(3, text(1)), (7, text(2)), (7, text(3)), (8, rows[-1][1]), (None, None), (None, text(4)), (None, text(5))]
    assert left == sorted(want, key=str)
    cut = corpus_pipeline.without_repeats(spark, kept, SMALL).collect()
    # the passage of document 8 goes from the row without an id; other rows of that id keep all
    texts = {(r.doc_id, r.text) for r in cut}
    assert {(d, t) for d, t in want if t and t != text(5)} < texts
    assert sum(r.text is not None and text(5).endswith(r.text) and r.text != "" for r in cut) <= 1


def test_pipeline_of_awkward_rows(spark, awkward):
    docs, ids = awkward, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SMALL), "test-awkward")
        ids[name] = [r.doc_id for r in docs.collect()]
        assert name == "packing" or docs.columns == awkward.columns
    good, one = ids["quality classifier"], ids["n-gram Jaccard join"]
    assert one.count(None) == good.count(None) and one.count(7) == min(1, good.count(7))
    assert set(ids["packing"]) == set(ids["mixing to target weights"])


def test_awkward_rows_past_the_classifier(spark, awkward):
    kept = corpus_pipeline.one_of_each_group(spark, awkward, SMALL)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "6", "7", "8", "None"]
    assert kept.columns == awkward.columns
    mix = corpus_pipeline.mixed(spark, corpus_pipeline.without_repeats(spark, kept, SMALL), SMALL)
    assert {r.doc_id for r in mix.collect()} >= {4, 6, None}

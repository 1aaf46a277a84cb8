"""Every registered query against its SQL on the smallest tables, and the shape of key plans."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
import check  # noqa: E402

SMALL = "/root/testdata/sf0.001"
QUERIES = entry.queries()
ORACLES = entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return check.connect(SMALL)


def test_names_match():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, note = check.compare(spark, con, SMALL, name, QUERIES[name], ORACLES.get(name))
    assert ok, note


def plan(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_nested_loops(spark, name):
    text = plan(QUERIES[name](spark, SMALL))
    assert "CartesianProduct" not in text
    assert "NestedLoop" not in text


def test_filters_reach_the_scan(spark):
    text = plan(QUERIES["filter_min_text"](spark, SMALL))
    assert "IsNotNull(text)" in text or "ReadSchema: struct<doc_id:bigint,text:string>" in text
    text = plan(QUERIES["sentiment_counts_filtered"](spark, SMALL))
    assert "GreaterThanOrEqual(ts" in text and "LessThan(ts" in text


def test_consolidation_reads_no_text_and_reduces_before_the_shuffle(spark):
    text = plan(QUERIES["consolidate_events"](spark, SMALL))
    assert "props" not in text.split("ReadSchema:")[1].split("\n")[0]
    assert text.count("partial_") >= 3


def test_facets_share_one_shuffle(spark):
    df = QUERIES["dashboard_facets"](spark, SMALL)
    df.collect()
    assert "ReusedExchange" in plan(df)

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sitrep.operators import metrics
from sitrep.operators.search import day_presets

EVENT = (
    "event_id string, classification_type string, location_district string, location_state string, "
    "start_time timestamp, most_recent_report timestamp, "
    "geometry struct<type: string, coordinates: array<double>>, total_posts_count bigint"
)
T = datetime(2025, 3, 31, 23, 59, 59, 900000)


def event(i, kind="flood", district="klang", state="selangor", at=T, xy=(101.0, 3.0)):
    return (str(i), kind, district, state, at, at, ("Point", list(xy) if xy is not None else None), 1)


def counts(df):
    return {r[0]: r[1] for r in df.collect()}


def test_type_counts_keep_missing(spark):
    df = spark.createDataFrame([event(1, None), event(2, "none"), event(3), event(4)], EVENT)
    assert counts(metrics.type_counts(df)) == {None: 1, "flood": 2}


def test_ranking(spark):
    names = [None, "", "unknown", "Unknown District", "klang", "b", "a", "c", "d", "e", "f"]
    df = spark.createDataFrame([event(i, district=n) for i, n in enumerate(names)] + [event(99)], EVENT)
    got = [(r.district, r.event_count) for r in metrics.district_ranking(df).collect()]
    assert got == [("klang", 2), ("a", 1), ("b", 1), ("c", 1), ("d", 1)]


def test_end_day_is_inclusive(spark):
    df = spark.createDataFrame([event(1), event(2, at=datetime(2025, 4, 1))], EVENT)
    kept = metrics.events_between(df, "2025-03-01", "2025-03-31")
    assert [r.event_id for r in kept.collect()] == ["1"]


POST = (
    "post_id string, disaster_type string, start_time timestamp, keywords string, hashtags string, "
    "sentiment struct<label: string, confidence: double, reasoning: string>"
)


def posts(spark, *rows):
    return spark.createDataFrame(
        [(str(i), "flood", T, k, h, (s, 1.0, "") if s else None) for i, (k, h, s) in enumerate(rows)],
        POST,
    )


def test_severity_groups(spark):
    df = posts(spark, ("", "", "Urgent"), ("", "", None), ("", "", "Urgent"))
    assert counts(metrics.severity_counts(df)) == {"Urgent": 2, None: 1}
    assert counts(metrics.severity_counts(df, drop_missing=True)) == {"Urgent": 2}
    series = metrics.severity_series(metrics.severity_counts(df, True)).orderBy("position")
    assert [(r.name, r.value) for r in series.collect()] == [
        ("urgent", 2), ("warning", 0), ("informational", 0),
    ]


def test_trending(spark):
    df = posts(spark, ("a, ,B,a", "null", None), ("none", "x", None), (None, "#X", None))
    got = metrics.trending_terms(df, "2025-03-01", "2025-03-31")
    assert [(r.keyword, r.frequency) for r in got.collect()] == [("a", 2), ("b", 1)]
    tags = metrics.trending_terms(df, "2025-03-01", "2025-03-31", "Flood", "hashtags")
    assert counts(tags) == {"x": 1, "#x": 1}
    with pytest.raises(ValueError):
        metrics.trending_terms(df, "2025-04-01", "2025-03-31")


def test_hashtag_counts_from_lists_and_text(spark):
    df = spark.createDataFrame(
        [(["kilat"], None), (None, "kilat"), (None, "emergency"), (None, "null"), (None, "#Johor, #Help"),
         (["#Johor", "#Flood2024"], None), (None, None), (None, "")],
        "tags array<string>, tag_text string",
    )
    assert counts(metrics.hashtag_counts(df, "tags", "tag_text")) == {
        "kilat": 2, "emergency": 1, "johor": 2, "help": 1, "flood2024": 1,
    }


def test_topics_and_tracking(spark):
    df = spark.createDataFrame(
        [("forest fire", True), ("Burning trees.", True), ("fire in forest", True), ("x", False),
         ("quake!", True), (None, True), ("", True)],
        "keywords string, keywords_generated boolean",
    )
    mapping = spark.createDataFrame(
        [("forest fire", "Forest Fire"), ("burning trees", "Forest Fire"), ("fire in forest", "Forest Fire")],
        "topic string, canonical string",
    )
    words = metrics.topic_counts(df, mapping)
    assert counts(words) == {"Forest Fire": 3, "quake": 1}
    tags = spark.createDataFrame([("klflood", 1)], "term string, frequency bigint")
    both = metrics.tracking_terms(words, tags)
    assert {tuple(r) for r in both.collect()} == {
        ("Forest Fire", "keyword", 3), ("quake", "keyword", 1), ("#klflood", "hashtag", 1),
    }
    assert [r.keyword for r in metrics.top_keywords(both, 1).collect()] == ["Forest Fire"]


def test_series_are_zero_filled(spark):
    df = spark.createDataFrame([event(1), event(2), event(3, "storm", at=datetime(2024, 5, 1))], EVENT)
    months = metrics.monthly_series(metrics.monthly_events(df), 2025).orderBy("month").collect()
    assert [r.value for r in months] == [0, 0, 2] + [0] * 9
    cards = counts(metrics.type_cards(metrics.type_counts(df)))
    assert cards["flood"] == 2 and cards["storm"] == 1 and len(cards) == 8 and sum(cards.values()) == 3
    none = df.limit(0)
    for rows, empty in ((df, False), (none, True)):
        flag = metrics.is_empty_selection(metrics.type_counts(rows), metrics.monthly_events(rows))
        assert flag.first().is_empty is empty


def test_share_of_max(spark):
    chart = spark.createDataFrame([("a", 4), ("b", 1)], "k string, n bigint")
    assert counts(metrics.share_of_max(chart, "n").select("k", "share")) == {"a": 100.0, "b": 25.0}
    zero = spark.createDataFrame([("a", 0)], "k string, n bigint")
    assert metrics.share_of_max(zero, "n").first().share == 0.0


def test_dashboard_agrees_with_the_single_figures(spark):
    rows = [event(i, k, d) for i, (k, d) in enumerate(
        [("flood", "klang"), (None, "klang"), ("none", "klang"), ("storm", "unknown"), ("storm", "ipoh")])]
    df, p = spark.createDataFrame(rows, EVENT), posts(spark, ("", "", "Urgent"), ("", "", None))
    tidy = metrics.dashboard(df, p)
    got = {(r.facet, r.key, r.year, r.month): r.frequency for r in tidy.collect()}
    assert got == {
        ("type_counts", "flood", None, None): 1, ("type_counts", None, None, None): 1,
        ("type_counts", "storm", None, None): 1,
        ("district_ranking", "klang", None, None): 2, ("district_ranking", "ipoh", None, None): 1,
        ("monthly_events", None, 2025, 3): 3,
        ("sentiment_counts", "Urgent", None, None): 1, ("sentiment_counts", None, None, None): 1,
    }
    ranged = metrics.dashboard_between(df, p, "2025-01-01", "2025-12-31")
    got = {(r.facet, r.key): r.frequency for r in ranged.collect()}
    # the filtered ranking does not exclude lower-case 'unknown', and months count every type
    assert got[("district_ranking", "unknown")] == 1 and got[("monthly_events", None)] == 5
    assert ("sentiment_counts", None) not in got
    doc = metrics.dashboard_document(tidy, "2025-05-01 00:00:00").first()
    assert {(r.type, r.frequency) for r in doc.type_counts} == {("flood", 1), (None, 1), ("storm", 1)}
    assert doc.monthly_events[0].total_events == 3


def test_labels(spark):
    df = spark.createDataFrame([("shah alam", 1)], "k string, n bigint")
    assert metrics.display_labels(df, "k").first().label == "Shah Alam"
    assert metrics.display_labels(df, "k", hashtag=True).first().label == "#shahalam"


def test_presets(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 21, 23, 59, 59),), (datetime(2024, 1, 22),)], "start_time timestamp")
    got = {r.preset: r.event_count for r in day_presets(df, "2024-01-24").collect()}
    assert got == {"this-week": 1, "last-week": 1, "this-month": 2, "last-30-days": 2, "this-year": 2}


def test_month_summary(spark):
    df = spark.createDataFrame([event(1), event(2), event(3, "storm")], EVENT)
    assert {tuple(r) for r in metrics.month_summary(df).collect()} == {
        ("flood", "selangor", 2), ("storm", "selangor", 1),
    }
    assert metrics.month_summary(df).select(F.sum("event_count")).first()[0] == 3

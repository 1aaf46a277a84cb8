from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from sitrep.functions import dates, places, text
from sitrep.functions import predicates as P
from sitrep.operators import enrich

C = F.col("c")


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ("Flood in Selangor! http://bit.ly/123", "Flood in Selangor"),
        ("http://bit.ly/123 Flood in Selangor!", "Flood in Selangor"),
        ("Flood in http://bit.ly/123 Selangor!", "Flood in Selangor"),
        ("Flood in Selangor! @Lim123", "Flood in Selangor"),
        ("@Lim123 Flood in Selangor!", "Flood in Selangor"),
        ("Flood in @Lim123 Selangor!", "Flood in Selangor"),
        ("Forest fire in Kampung Batu \U0001f525\U0001f525\U0001f525", "Forest fire in Kampung Batu"),
        ("Forest fire!!!! OMGGG in Kampung Batu", "Forest fire OMGGG in Kampung Batu"),
        ("Forest fire OMGGG in Kampung Batu", "Forest fire OMGGG in Kampung Batu"),
        ("Flood        in Selangor!!!!!!", "Flood in Selangor"),
        ("a @caféx b", "a b"),
        ("1️⃣ ok", "ok"),
        ("a b", "a b"),
    ],
)
def test_clean_text(values, raw, clean):
    assert values(text.clean_text(C), [raw]) == [clean]


def test_clean_caption(values):
    raw = ["Banjir!!! \U0001f6a8⚠️ now, www.x.y #tag @me ok?", None, "@ab\U0001f525cd x"]
    assert values(text.clean_caption(C), raw) == ["Banjir!!! now, ok?", "", "x"]


def test_hashtags(values):
    got = values(text.hashtag_list(C), ["#Banjir Kilat!, #Ribut", "", None, "a,,b"])
    assert got == [["banjirkilat", "ribut"], [], [], ["a", "", "b"]]


def test_tokens(values):
    assert values(text.tokens(C), ["The flood is at Kuala Lumpur dan km48"]) == [
        ["flood", "kuala", "lumpur"]
    ]


def test_terms(values):
    got = values(text.normalise_terms(C), ["Banjir kilat di Ipoh", "kilat dan tanah runtuh"])
    assert got == ["flood di ipoh", "storm dan landslide"]
    inside = ["Contributions and distribution", "ribut-proof"]
    assert values(text.normalise_terms(C), inside) == ["contributions and distribution", "storm-proof"]
    found = values(text.term_matches(C, ["kilat", "banjir kilat"]), ["banjir kilat, kilat; akilat"])
    assert found == [["banjir kilat", "kilat"]]


def test_keywords_of_any_form(spark):
    cases = [
        ("k string", " a, b ", "a, b"), ("k array<int>", [1, None, 2], "1, 2"),
        ("k map<string,string>", {"topic": " flood ", "x": "y"}, "flood"),
        ("k map<string,string>", {"x": "y", "z": None}, "y"),
        ("k struct<topic: array<string>, x: string>", (["a", ""], "b"), "a"),
        ("k struct<topic: string, x: string>", (None, "b"), "b"), ("k string", None, ""),
    ]
    for ddl, value, want in cases:
        df = spark.createDataFrame([(value,)], ddl)
        assert enrich.keyword_column(df, "k").first()[0] == want, ddl


def test_topic_and_keywords(values, spark):
    assert values(text.tidy_topic(C), ["Flood, in KL."]) == ["flood in kl"]
    df = spark.createDataFrame([(["a", None, "", "b"],)], "k array<string>")
    assert df.select(text.keyword_text(F.col("k"))).first()[0] == "a, b"


def test_place_names(values):
    assert values(text.split_camel(C), ["KualaLumpur", "Unknown District", "", "Shah Alam"]) == [
        "kuala lumpur",
        "Unknown District",
        "",
        "shah alam",
    ]
    got = values(places.canonical_state(C), ["penang", "Melacca", "malacca", "atlantis", None])
    assert got == ["Pulau Pinang", "Melaka", "Melaka", "atlantis", None]
    assert values(places.is_known_state(C), ["Johor", "penang", None]) == [True, False, False]


def test_mentions(values):
    assert values(places.mentions_any(C), ["near KUALA lumpur", "", None, "Oslo"]) == [
        True, False, False, False,
    ]


def test_bounding_box(spark):
    df = spark.createDataFrame(
        [("8.0", "120.0"), ("8.1", "120.0"), (None, "100"), ("x", "100")], "lat string, lon string"
    )
    got = [r[0] for r in df.select(places.in_bounding_box(F.col("lat"), F.col("lon"))).collect()]
    assert got == [True, False, False, False]


def test_parse_dates(values):
    now = F.to_timestamp(F.lit("2030-01-01 00:00:00"))
    same = datetime(2025, 4, 11, 13, 57, 55)
    raw = ["Fri Apr 11 13:57:55 +0000 2025", "2025-04-11T13:57:55Z", "garbage", None]
    assert values(dates.parse_post_date(C, now), raw) == [
        same, same, datetime(2030, 1, 1), datetime(2030, 1, 1),
    ]


def test_epoch(values):
    got = values(dates.epoch_to_timestamp(C), ["1705915829", "soon", None])
    assert got == [datetime(2024, 1, 22, 9, 30, 29), None, None]


def test_months():
    assert dates.month_number("November 2025") == 11
    assert dates.month_number("Nov") is None
    assert dates.month_number(None) is None


def test_presets(spark):
    got = {}
    for preset in dates.PRESETS:
        first, last = dates.preset_range(preset, F.lit("2024-01-24"))
        got[preset] = tuple(spark.range(1).select(first, last).first())
    today = date(2024, 1, 24)
    assert got == {
        "this-week": (date(2024, 1, 22), today),
        "last-week": (date(2024, 1, 15), date(2024, 1, 21)),
        "this-month": (date(2024, 1, 1), today),
        "last-30-days": (date(2023, 12, 25), today),
        "this-year": (date(2024, 1, 1), today),
    }


def test_missing_and_null_rules(values):
    raw = ["null", "", "None", "nan", "Unknown District", "unknown", "klang", None]
    assert values(P.missing_to_null(C), raw) == [None] * 6 + ["klang", None]
    assert values(P.not_equal_or_null(C, "none"), ["none", None, "x"]) == [False, True, True]
    assert values(F.coalesce(P.not_in_and_present(C, ["a"]), F.lit(False)), ["a", None, "b"]) == [
        False, False, True,
    ]


def test_types_and_text_filters(values):
    assert P.normal_type("forestFire") == "forest fire"
    assert P.normal_type("Forest Fire") == "forest fire"
    assert P.type_is(C, "All") is None and P.type_is(C, "") is None
    assert values(P.text_matches(C, "a.c"), ["xA.Cx", "abc"]) == [True, False]
    assert values(P.text_matches(C, "a.c", regex=True), ["xA.Cx", "ABC"]) == [True, True]
    assert values(P.min_text(C, 5), ["abcd", "abcde", None]) == [False, True, False]


def test_coordinates(values):
    rows = [None, [1.0], [1.0, None], [1.0, float("nan")], [1.0, 2.0]]
    got = values(P.valid_coordinates(C), rows, "c array<double>")
    assert got == [False, False, False, False, True]

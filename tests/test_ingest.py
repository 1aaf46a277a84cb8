import json

from pyspark.sql import functions as F

from sitrep import schemas
from sitrep.operators import ingest
from sitrep.plans.batch import raw_from_feeds


def post(rest_id="1", location="Kuala Lumpur, Malaysia", followers=500, kind="TimelineTweet", **user):
    return {
        "content": {
            "itemContent": {
                "itemType": kind,
                "tweet_results": {
                    "result": {
                        "rest_id": rest_id,
                        "legacy": {
                            "full_text": "Banjir di KL!",
                            "created_at": "Fri Apr 11 13:57:55 +0000 2025",
                            "entities": {"hashtags": user.pop("tags", [{"text": "banjir"}])},
                        },
                        "core": {
                            "user_results": {
                                "result": {
                                    "rest_id": "u1",
                                    "location": {"location": location},
                                    "legacy": {
                                        "name": "N",
                                        "location": user.pop("legacy_location", ""),
                                        "followers_count": followers,
                                    },
                                    **user,
                                }
                            }
                        },
                    }
                },
            }
        }
    }


def timeline(spark, entries=(), added=()):
    doc = {
        "result": {
            "timeline": {"instructions": [{"entries": list(entries)}, {"addEntries": list(added)}]}
        }
    }
    return spark.createDataFrame([(json.dumps(doc),)], "value string")


def kept(spark, *entries, added=()):
    rows = ingest.clean_timeline_posts(ingest.flatten_timeline(timeline(spark, entries, added)))
    return sorted(rows.collect(), key=lambda r: r.tweet_id)


def test_timeline_rows(spark):
    rows = kept(
        spark,
        post("1"),
        post("2", followers=10000),
        post("3", followers=10001),
        post("4", location=""),
        post("5", verified=True),
        post("6", kind="TimelineModule"),
        post("7", location="", legacy_location="Ipoh"),
        post("8", professional={"professional_type": "Creator"}),
        post("9", verification_type="Government"),
        post("1"),
        added=[post("a", tags=[])],
    )
    assert [r.tweet_id for r in rows] == ["1", "2", "7", "a"]
    assert rows[0].tweet_hashtags == "banjir" and rows[3].tweet_hashtags is None
    assert rows[0].cleaned_text == "Banjir di KL" and rows[0].platform == "twitter"


def item(i, **changes):
    base = {
        "id": i,
        "taken_at": 1705915829,
        "caption": {"text": "Banjir!!! \U0001f6a8⚠️", "hashtags": ["#Banjir", "Help Me"]},
        "user": {"id": "u", "username": "n", "account_type": 1},
        "location": {"city": "Shah Alam", "lat": 3.0, "lng": 101.5},
    }
    return {**base, **changes}


def test_item_rows(spark):
    docs = [
        item("1"),
        None,
        item("2", user={"account_type": 2}),
        item("3", user={"id": "x"}),
        item("4", location=None),
        item("5", location={"city": "Oslo"}),
        item("6", caption=None),
        item("7", taken_at="bad"),
        item("1"),
    ]
    feed = spark.createDataFrame([(json.dumps({"data": {"items": docs}}),)], "value string")
    rows = ingest.clean_item_posts(ingest.flatten_items(feed)).orderBy("ig_post_id").collect()
    assert [r.ig_post_id for r in rows] == ["1", "3", "7"]
    assert str(rows[0].created_at) == "2024-01-22 09:30:29" and rows[2].created_at is None
    assert rows[0].cleaned_description == "Banjir!!!"
    assert rows[0].cleaned_hashtags == ["banjir", "helpme"]
    assert rows[0].cleaned_hashtags_str == "banjir, helpme" and rows[0].city == "shah alam"


def test_broken_json_is_kept(spark):
    df = spark.createDataFrame([('{"k": 1}',), ("{bad",), (None,)], "v string")
    rows = ingest.parse_json(df, "v", "k int").collect()
    assert [(r.v, r.data.k if r.data else None, r.is_broken) for r in rows] == [
        ('{"k": 1}', 1, False), ("{bad", None, True), (None, None, True),
    ]


def test_unify_both_platforms(spark):
    raw = raw_from_feeds(
        timeline(spark, [post("1")]),
        spark.createDataFrame([(json.dumps({"data": {"items": [item("9")]}}),)], "value string"),
    )
    rows = {r.postId: r for r in ingest.unify(raw, 5.0).collect()}
    assert rows["1"].source == "Twitter" and rows["9"].source == "Instagram"
    assert rows["1"].postText == "Banjir di KL" and rows["9"].postText == "Banjir!!!"
    assert rows["9"].createdAt == "2024-01-22T09:30:29Z"
    assert rows["1"].hashtags == ["banjir"] and rows["9"].hashtags == ["#Banjir", "Help Me"]
    assert rows["1"].processedAt == 5.0


def test_unify_prefers_filled_values(spark):
    names = spark.createDataFrame([("7", "", "x", "y")], "tweet_id string, translated_text string, cleaned_text string, raw_text string")
    row = ingest.unify(ingest.as_raw_topic(names), 1.0).first()
    assert (row.postText, row.hashtags, row.location, row.author_name, row.source) == (
        "x", [], "", "", "Unknown",
    )
    assert [f.name for f in ingest.unify(ingest.as_raw_topic(names), 1.0).schema] == [
        f.name for f in schemas.struct(schemas.POSTS)
    ]


def test_authentic_gate(spark):
    posts = spark.createDataFrame([("1",), ("2",), ("3",), ("4",)], "post_id string")
    checks = spark.createDataFrame(
        [("1", "AUTHENTIC"), ("2", "UNCERTAIN"), ("3", "MISINFORMATION")],
        "post_id string, check_label string",
    )
    assert [r.post_id for r in ingest.authentic(posts, checks, "post_id").collect()] == ["1"]


def test_drop_missing(spark):
    df = spark.createDataFrame(
        [("t", None, None), (None, "a", "b"), ("t", None, "b")], "text string, a string, b string"
    )
    assert ingest.drop_missing(df, ["text"], ["a", "b"]).select(F.count("*")).first()[0] == 1

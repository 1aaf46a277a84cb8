import csv
import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sitrep import schemas
from sitrep.operators import alerts, geo, search
from sitrep.sources import exports
from test_terms_and_metrics import EVENT, event

NOW = datetime(2025, 6, 30, 12)
TS = "2025-06-30 12:00:00"


def ids(df):
    return sorted(r.event_id for r in df.select("event_id").collect())


def test_events_filtered(spark):
    df = spark.createDataFrame(
        [
            event(1), event(2, "forest fire"), event(3, district="unknown"), event(4, state=None),
            event(5, xy=(1.0,)), event(6, xy=None), event(7, state="perak", district="ipoh"),
            event(8, district="ipoh"),
        ],
        EVENT,
    )
    assert ids(search.events_filtered(df)) == ["1", "2", "7", "8"]
    assert ids(search.events_filtered(df, kind="forestFire")) == ["2"]
    assert ids(search.events_filtered(df, state="Selangor")) == ["1", "2"]
    assert ids(search.events_filtered(df, "2025-03-31", "2025-03-31")) == ["1", "2", "7", "8"]
    assert ids(search.events_filtered(df, start="2025-04-01")) == []


def test_client_filter_and_markers(spark):
    df = spark.createDataFrame(
        [event(1), event(2, "None"), event(3, district="Unknown District"), event(4, "")], EVENT
    )
    assert ids(search.map_markers(df)) == ["1"]
    assert ids(search.events_by_start(df, "flood", "SELANGOR", "2025-03-01", "2025-03-31")) == ["1", "3"]


def test_events_by_ids(spark):
    df = spark.createDataFrame([event(1), event(2)], EVENT)
    wanted = spark.createDataFrame([("2",), ("2",), ("9",)], "event_id string")
    (row,) = search.events_by_ids(df, wanted).collect()
    assert (row.event_id, row.start_time) == ("2", "2025-03-31T23:59:59.900000")


@pytest.mark.parametrize(
    ("criteria", "expected"),
    [
        ({"location": "Johor", "kind": "Flood"}, ["3"]),
        ({"location": "jhor"}, ["3", "4"]),
        ({"location": "Malaysia"}, ["1", "2", "3", "4"]),
        ({"month": "October"}, ["2"]),
        ({"month": "November 2025"}, ["4"]),
        ({"month": "Nov"}, ["1", "2", "3", "4"]),
        ({"year": "2024"}, ["2"]),
        ({"year": "abc"}, ["1", "2", "3", "4"]),
        ({"day": "2025-03-31"}, ["1", "3"]),
        ({"latest": True}, ["4"]),
    ],
)
def test_retrieval(spark, criteria, expected):
    df = spark.createDataFrame(
        [
            event(1),
            event(2, at=datetime(2024, 10, 5)),
            event(3, state="johor", district="muar"),
            event(4, "storm", state="johor", district="muar", at=datetime(2025, 11, 2)),
        ],
        EVENT,
    )
    assert ids(search.retrieve(df, **criteria)) == expected


def test_retrieval_returns_newest_fifty(spark):
    df = spark.createDataFrame(
        [event(i, at=datetime(2025, 1, 1) + timedelta(hours=i)) for i in range(60)], EVENT
    )
    got = [int(r.event_id) for r in search.retrieve(df).collect()]
    assert got == list(range(59, 9, -1))


def post(i, **over):
    base = {
        "post_id": str(i), "classification_status": "Confirmed", "disaster_type": "flood",
        "start_time": datetime(2025, 1, i), "location": ("selangor", "klang", [101.0, 3.0]),
        "post_text": 'Water, "high"', "keywords": "flood in klang", "hashtags": "",
        "sentiment": ("Urgent", 0.9, "r"),
    }
    return tuple({**base, **over}.values())


@pytest.fixture
def found_posts(spark):
    return spark.createDataFrame(
        [post(1), post(2, disaster_type="Storm", location=("johor", "muar", None), sentiment=None),
         post(3, post_text="100% (wet)", keywords=None), post(4, location=None)],
        schemas.struct(schemas.DISASTER_POSTS),
    )


def test_search_posts(found_posts):
    def got(**c):
        return sorted(r.post_id for r in search.search_posts(found_posts, **c).collect())

    assert got() == ["1", "2", "3", "4"]
    assert got(location=["JOHOR", "Klang"]) == ["1", "2", "3"]
    assert got(category="storm") == ["2"] and got(category="All") == ["1", "2", "3", "4"]
    assert got(severity="urg") == ["1", "3", "4"]
    assert got(keyword="% (w") == ["3"]
    assert got(keyword="wat.r|we[a-z]", regex=True) == ["1", "2", "3", "4"]
    assert got(start="2025-01-02", end="2025-01-03", keyword="KLANG") == ["2"]


def test_exports(found_posts, tmp_path):
    newest = search.newest_first(found_posts, 2)
    assert [r.post_id for r in newest.collect()] == ["4", "3"]
    exports.write_export(found_posts.coalesce(1), str(tmp_path / "csv"), "csv")
    (part,) = (tmp_path / "csv").glob("*.csv")
    rows = list(csv.DictReader(part.open()))
    assert len(rows) == 4 and rows[0]["post_text"] == 'Water, "high"' and rows[0]["longitude"] == "101.0"
    assert list(rows[0]) == [
        "id", "post_id", "status", "disaster_type", "start_time", "post_text", "state", "district",
        "longitude", "latitude", "sentiment_label", "sentiment_confidence", "sentiment_reasoning",
        "keywords",
    ]
    exports.write_export(found_posts.coalesce(1), str(tmp_path / "json"), "json")
    (part,) = (tmp_path / "json").glob("*.json")
    docs = [json.loads(line) for line in part.open()]
    assert docs[0]["location"]["state"] == "selangor" and docs[0]["start_time"] == "2025-01-01T00:00:00"
    with pytest.raises(ValueError):
        exports.write_export(found_posts, str(tmp_path / "x"), "excel")


def test_index(found_posts, spark, tmp_path):
    rows = search.post_index_projection(found_posts)
    assert exports.write_index(rows, str(tmp_path / "i")).first().indexed == 4
    flat = search.index_projection(spark.createDataFrame([event(1), event(2, xy=None)], EVENT))
    assert {(r.lon, r.lat) for r in flat.collect()} == {(101.0, 3.0), (None, None)}


# --- alerts -----------------------------------------------------------------------------
ALERT = (
    "event_id string, classification_type string, location_state string, location_district string, "
    "start_time timestamp, last_alert_sent timestamp, alert_cooldown_mins int"
)


def alert_event(i, state="johor", age=timedelta(days=1), last=None, minutes=None):
    return (str(i), "flood", state, "muar", NOW - age, NOW - last if last else None, minutes)


def test_alerts_due(spark):
    rows = [
        alert_event(1), alert_event(2, age=timedelta(days=90)),
        alert_event(3, age=timedelta(days=90, seconds=1)), alert_event(4, state=None), alert_event(5, state=""),
        alert_event(6, last=timedelta(minutes=10)), alert_event(7, last=timedelta(minutes=60)),
        alert_event(8, last=timedelta(minutes=10), minutes=5),
        alert_event(9, last=timedelta(minutes=70), minutes=120),
    ]
    assert ids(alerts.alerts_due(spark.createDataFrame(rows, ALERT), TS)) == ["1", "2", "7", "8"]


def subscribers(spark, *rows):
    return spark.createDataFrame(
        [(e, list(l), 0.0, 0.0) for e, *l in rows], schemas.struct(schemas.SUBSCRIBERS)
    )


def test_recipients_and_outbox(spark):
    due = spark.createDataFrame([alert_event(1), alert_event(2, "pulau pinang"), alert_event(3, "sabah")], ALERT)
    subs = subscribers(spark, ("a@x", "Johor", "johor"), ("b@x", "Penang"), ("c@x", "kedah"), ("d@x", "Melacca"))
    sent = alerts.alert_recipients(due, subs)
    assert {(r.event_id, r.email) for r in sent.collect()} == {("1", "a@x"), ("2", "b@x")}
    counts = {r.event_id: r.emails for r in alerts.recipient_counts(due, subs).collect()}
    assert counts == {"1": 1, "2": 1, "3": 0}
    message = alerts.alert_messages(sent, "https://h/u").where("event_id = '2'").first()
    assert message.subject == "ALERT: FLOOD Detected in muar" and message.state == "Pulau Pinang"
    assert message.first_reported == "2025-06-29 12:00:00 UTC"
    assert message.unsubscribe_link == "https://h/u?email=b@x"
    marked = {r.event_id: r.last_alert_sent for r in alerts.mark_sent(due, sent, TS).collect()}
    assert marked == {"1": NOW, "2": NOW, "3": None}


def test_recipients_of_busy_states_stay_small(spark, tmp_path):
    """Every pair once, whatever the size of a state; written, a row takes a fraction of a byte."""
    due = spark.createDataFrame(
        [alert_event(i, ["johor", "Sabah", "kedah"][i % 3]) for i in range(600)], ALERT
    )
    many = [(f"person.{i:06d}.{i * 7919 % 100_003}@mail.example", "Johor") for i in range(9000)]
    subs = subscribers(spark, *many, *[(f"s{i}@x", "Sabah", "Johor") for i in range(100)], ("k@x", "Kedah"))
    sent = alerts.alert_recipients(due, subs).select("event_id", "email")
    sent.write.parquet(str(tmp_path / "sent"))
    back = spark.read.parquet(str(tmp_path / "sent"))
    rows = 200 * 9100 + 200 * 100 + 200
    assert (back.count(), back.distinct().count()) == (rows, rows)
    at_k = back.where("email = 'k@x'").select("event_id").collect()
    assert {r.event_id for r in at_k} == {str(i) for i in range(600) if i % 3 == 2}
    assert sum(f.stat().st_size for f in (tmp_path / "sent").glob("*.parquet")) < 0.8 * rows


def test_pairs_of_a_state_are_dealt_by_events_and_by_subscribers(spark):
    """Neither many events nor many subscribers of one state are left to a task, and large tasks are not paired."""
    wide, states = 12_000, ["Sabah", "Kedah", "Perak", "Pahang", "Perlis", "Johor"]
    state = F.when(F.col("id") < wide, "selangor").otherwise(F.get(F.array(*map(F.lit, states)), F.col("id").cast("int") % 6))
    due = spark.range(wide + 60).select(F.col("id").cast("string").alias("event_id"), state.alias("location_state"))
    due = due.unionByName(due.where("event_id = '7'").withColumn("event_id", F.lit(None)))
    few, many = [(f"w{i}@x", "Selangor") for i in range(9)], [(f"m{i}@x", *states) for i in range(5000)]
    sent = alerts.alert_recipients(due, subscribers(spark, *few, *many, ("k@x", "Kelantan")))
    assert sent.columns == ["event_id", "location_state", "email"]
    rows = [(r._p, r.location_state, r.n, r.m) for r in sent.groupBy(F.spark_partition_id().alias("_p"), "location_state").agg(
        F.count("*").alias("n"), F.count_distinct("event_id", "email").alias("m")).collect()]
    at = {s: [(p, n, m) for p, t, n, m in rows if t == s] for s in ["selangor", *states]}
    assert len(at.pop("selangor")) == 3 and max(n for _, t, n, _ in rows if t == "selangor") < 1.2 * 9 * 4_000
    assert sum(n for _, _, n, _ in rows) == (wide + 1) * 9 + 60 * 5000
    assert sum(m for _, _, _, m in rows) == wide * 9 + 60 * 5000
    assert all(len(x) == 2 and max(n for _, n, _ in x) < 0.6 * 10 * 5000 for x in at.values())
    assert len({p for p, *_ in rows}) == len(rows) == 3 + 2 * 6


def test_outbox_equals_messages_to_recipients(spark, tmp_path):
    """The same messages, their event fields made before events meet subscribers; a few bytes written for each."""
    due = spark.createDataFrame([alert_event(i, ["johor", "pulau pinang"][i % 2]) for i in range(400)], ALERT)
    subs = subscribers(spark, *[(f"person.{i * 7919 % 100_003}@mail.example", "Johor") for i in range(3000)], ("p@x", "Penang"))
    made = alerts.outbox(due, subs, "https://h/u")
    made.write.parquet(str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    want = alerts.alert_messages(alerts.alert_recipients(due, subs), "https://h/u")
    assert back.columns == want.columns and back.count() == want.count() == 200 * 3001
    assert back.exceptAll(want).isEmpty() and want.exceptAll(back).isEmpty()
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 1.5 * back.count()
    steps = made._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")
    assert "initcap" in steps[-1] and "initcap" not in steps[0]


def test_outbox_of_one_busy_state_is_written_by_many_tasks(spark):
    """Events of a state with few subscribers do not wait for one task to write all their messages."""
    due = spark.range(12_000).select(
        F.col("id").cast("string").alias("event_id"), F.lit("flood").alias("classification_type"),
        F.lit("johor").alias("location_state"), F.lit("muar").alias("location_district"),
        F.lit(TS).cast("timestamp").alias("start_time"),
    )
    made = alerts.outbox(due, subscribers(spark, ("a@x", "Johor"), ("b@x", "johor", "Sabah")), "https://h/u")
    rows = made.groupBy(F.spark_partition_id()).agg(
        F.count("*").alias("n"), F.count_distinct("event_id", "unsubscribe_link").alias("m")
    ).collect()
    assert sum(r.n for r in rows) == sum(r.m for r in rows) == 2 * 12_000
    assert len(rows) == 3 and max(r.n for r in rows) < 1.2 * 2 * 4_000


def test_cooldown_is_a_fold(spark):
    rows = [("e", NOW + timedelta(minutes=m)) for m in (0, 30, 60, 90, 120)]
    rows += [("f", NOW + timedelta(minutes=m)) for m in (0, 50, 100, 110, 160, 170)]
    df = spark.createDataFrame(rows, "event_id string, reported_at timestamp")
    got = {}
    for r in alerts.cooldown_alerts(df, 60).collect():
        got.setdefault(r.event_id, []).append(int((r.alert_at - NOW).total_seconds() / 60))
    assert {k: sorted(v) for k, v in got.items()} == {"e": [0, 60, 120], "f": [0, 100, 160]}
    # 59 minutes and 2 seconds lie between these: the second is too early
    rows = [("g", NOW + timedelta(seconds=s)) for s in (59, 59 + 3542, 59 + 3600)] + [("h", None)]
    df = spark.createDataFrame(rows, "event_id string, reported_at timestamp")
    sent = [r.alert_at for r in alerts.cooldown_alerts(df, 60).orderBy("alert_at").collect()]
    assert sent == [NOW + timedelta(seconds=s) for s in (59, 3659)]


def test_substring_join_equals_brute_force(spark):
    texts = ["Sungai Buloh, Selangor", "selangor", "KL", "x", None, "", "Kota Kinabalu, Sabah"]
    subs = [("a", "Selangor"), ("b", "sungai buloh"), ("b", "selangor"), ("c", "K"), ("d", "kl"), ("e", ""), ("f", None)]
    posts = spark.createDataFrame([(t,) for t in texts], "loc string")
    df = spark.createDataFrame(subs, "email string, place string")
    got = {(r.location, r.email) for r in alerts.subscribers_in_text(posts, "loc", df, "place").collect()}
    want = {
        (t.lower(), e) for t in texts if t is not None for e, p in subs if p and p.lower() in t.lower()
    }
    assert got == want


def test_substring_pairs_are_made_last(spark):
    """Several places of an e-mail, also of none, meet a text once; no task gathers the pairs to see to that."""
    texts = [f"{a}, {b}" for a in ("klang", "Kota Tinggi", "kota") for b in ("Johor", "selangor")] + [None]
    places = ["kota", "Kota", "johor", "o", "lang", "gor", "nowhere", "", None]
    draw = random.Random(5)
    subs = [(f"m{i}" if i % 50 else None, draw.choice(places)) for i in list(range(400)) * 3]
    posts = spark.createDataFrame([(t,) for t in texts * 2], "loc string")
    df = spark.createDataFrame(subs, "email string, place string")
    found = alerts.subscribers_in_text(posts, "loc", df, "place")
    got = [(r.location, r.email) for r in found.collect()]
    want = {(t.lower(), e) for t in texts if t for e, p in subs if p and p.lower() in t.lower()}
    assert len(got) == len(set(got)) and set(got) == want
    plan = [line.strip() for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines()]
    assert plan[0].startswith("Project") and plan[1].startswith("+- Join Inner")


def test_substring_counts_equal_brute_force(spark):
    texts = ["Sungai Buloh, Selangor", "selangor", "KL", "x", None, "", "Kota Kinabalu, Sabah", "kota bharu", "aaaa"]
    subs = [
        ("a", "Selangor"), ("b", "sungai buloh"), ("b", "selangor"), ("b", "SELANGOR"), ("c", "K"), ("c", "kota"),
        ("d", "kl"), ("e", ""), ("f", None), (None, "selangor"), ("g", "aaa"), ("g", "aa"), ("h", "kota bharu, sabah"),
    ]
    posts = spark.createDataFrame([(t,) for t in texts * 3], "loc string")
    df = spark.createDataFrame(subs, "email string, place string")
    got = {r.location: r.emails for r in alerts.subscriber_counts_in_text(posts, "loc", df, "place").collect()}
    want = {}
    for t in texts:
        found = {e for e, p in subs if t and e and p and p.lower() in t.lower()}
        if found:
            want[t.lower()] = len(found)
    assert got == want


def test_names_meet_texts_by_their_rarest_piece(spark):
    """A prefix that every text has brings no text to a name whose other pieces are rare."""
    texts = [f"kampung {i:05d}" for i in range(2000)]
    posts = spark.createDataFrame([(t,) for t in texts], "loc string")
    names = spark.createDataFrame([("kampung 00017",), ("kampung baru",), ("00",)], "name string")
    pairs = geo.place_names_in(posts, "loc", names, "name")
    got = {(r._text, r._name) for r in pairs.collect()}
    assert got == {(t, n) for t in texts for n in ("kampung 00017", "kampung baru", "00") if n in t}


def test_email_column_is_required(spark):
    subs = subscribers(spark, (None, "johor"))
    due = spark.createDataFrame([alert_event(1)], ALERT)
    assert alerts.alert_recipients(due, subs).select(F.count("*")).first()[0] == 0


@pytest.mark.parametrize("hot", [0, 100, 10_000])
def test_cooldown_of_one_hot_event_over_many_tasks(spark, hot):
    """One event with most reports lies over all tasks; alerts are those of a fold over each event."""
    draw = random.Random(11)
    start = datetime(2025, 1, 1)
    rows = [("hot", start + timedelta(seconds=draw.randint(0, 40 * 3600))) for _ in range(3000)]
    rows += [("hot", start + timedelta(days=9, minutes=30 * i)) for i in range(50)]
    rows += [(f"e{i % 40}", start + timedelta(minutes=draw.randint(0, 900))) for i in range(500)]
    rows += [(None, start + timedelta(minutes=i)) for i in range(130)] + [("no time", None)]
    want = []
    for event in {r[0] for r in rows}:
        last = None
        for t in sorted({t for e, t in rows if e == event and t is not None}):
            if last is None or t - last >= timedelta(minutes=60):
                want.append((event, t))
                last = t
    df = spark.createDataFrame(rows, "event_id string, reported_at timestamp")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [tuple(r) for r in alerts.cooldown_alerts(df, hot=hot).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted(got, key=str) == sorted(want, key=str)

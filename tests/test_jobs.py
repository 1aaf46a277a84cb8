"""The batch run and the streaming chain: same posts, same events."""

import json
from datetime import datetime

import pytest

from sitrep import schemas
from sitrep.plans import batch as B
from sitrep.streaming.chain import Chain
from test_geo_and_labels import OVERLAP, SQUARE, polygons
from test_ingest import item, post, timeline

NOW = "2025-04-20 00:00:00"


def raw_rows():
    texts = [
        ("1", "Banjir in Klang, water level 30 cm", "Fri Apr 11 13:57:55 +0000 2025"),
        ("2", "Flood in Klang, we are at 2 m", "Sat Apr 12 13:57:55 +0000 2025"),
        ("3", "Klang is sinking!", "Sat Apr 12 14:57:55 +0000 2025"),
        ("4", "Stay safe everyone", "Sat Apr 12 15:57:55 +0000 2025"),
        ("5", "NADMA: ribut near Muar, help", "2025-04-11T10:00:00Z"),
        ("6", "NADMA: banjir in Klang again, avoid", "Sun Apr 13 15:57:55 +0000 2025"),
        ("1", "Banjir in Klang, water level 30 cm", "Fri Apr 11 13:57:55 +0000 2025"),
    ]
    return [
        {"tweet_id": i, "cleaned_text": t, "raw_text": t, "tweet_created_at": at,
         "tweet_hashtags": "ribut" if "ribut" in t else "banjir", "location": "Klang",
         "platform": "twitter"}
        for i, t, at in texts
    ]


def land(folder, name, rows, extra=()):
    folder.mkdir(parents=True, exist_ok=True)
    lines = [json.dumps(r) for r in rows] + list(extra)
    (folder / name).write_text("\n".join(lines) + "\n")


def subscribers(spark):
    return spark.createDataFrame(
        [("a@x", ["Selangor"], 0.0, 0.0), ("b@x", ["johor"], 0.0, 0.0), ("c@x", ["kedah"], 0.0, 0.0)],
        schemas.struct(schemas.SUBSCRIBERS),
    )


def chain(spark, root, clock=NOW):
    return Chain(
        spark, str(root), polygons(spark, SQUARE, OVERLAP), subscribers(spark), "https://h/u",
        clock=lambda: clock,
    )


def batch_run(spark, root, rows):
    run = B.Batch(spark, str(root), polygons(spark, SQUARE, OVERLAP), NOW)
    raw = spark.createDataFrame([json_row(r) for r in rows], schemas.struct(schemas.RAW_TOPIC))
    return run, run.run(raw)


def json_row(r):
    return {f: r.get(f) for f in [p.split()[0] for p in schemas.RAW_TOPIC.split(", ")]}


def key(e):
    return (e.event_id, e.location_state, e.start_time, e.most_recent_report, e.total_posts_count,
            tuple(e.geometry.coordinates))


@pytest.fixture(scope="module")
def batch_events(spark, tmp_path_factory):
    run, report = batch_run(spark, tmp_path_factory.mktemp("batch"), raw_rows())
    return run, {r.stage: r for r in report.collect()}


def test_batch_report(batch_events):
    _, report = batch_events
    assert {s: r.status for s, r in report.items()} == {
        s: "ok" for s in ["reject", "check", "ingest", "topics", "places", "resweep", "incidents", "severities", "assemble",
                          "consolidate", "figures", "document", "indexes", "trends"]
    }, [r.message for r in report.values()]
    assert (report["ingest"].processed, report["ingest"].inserted, report["ingest"].skipped) == (5, 4, 1)
    assert report["consolidate"].inserted == 3 and report["assemble"].inserted == 4


def test_batch_events(batch_events):
    run, _ = batch_events
    events = {e.event_id[:20]: e for e in run.table("events", B.EVENTS).read().collect()}
    flood = events["FLOOD-KLANG-20250411"]
    assert flood.total_posts_count == 2 and flood.location_state == "selangor"
    assert flood.start_time == datetime(2025, 4, 11, 13, 57, 55)
    assert {k[:12] for k in events} == {"FLOOD-KLANG-", "STORM-MUAR-2"} and len(events) == 3
    assert run.table("event_posts", B.MEMBERS).read().count() == 4
    terms = {(r.term, r.type): r.frequency for r in run.table("tracking_keyword", B.TERMS).read().collect()}
    assert terms[("#banjir", "hashtag")] == 3 and terms[("#ribut", "hashtag")] == 1 and terms[("Flood In Klang", "keyword")] == 3


def test_batch_stores_every_check(batch_events):
    run, report = batch_events
    rows = run.checked.read_batch(0).collect()
    labelled = [r.check_label for r in rows]
    assert len(rows) == len(raw_rows()) == report["check"].processed and set(labelled) <= {"AUTHENTIC", "MISINFORMATION", "UNCERTAIN"}
    assert labelled.count("AUTHENTIC") == report["check"].inserted == report["ingest"].processed
    assert report["check"].skipped == len(rows) - labelled.count("AUTHENTIC") > 0
    assert all(r.confidence is not None for r in rows)


def test_batch_stores_what_it_rejects(spark, tmp_path):
    run = B.Batch(spark, str(tmp_path), polygons(spark, SQUARE, OVERLAP), NOW)
    rows = [json_row(r) for r in [*raw_rows()[:2], {**raw_rows()[0], "tweet_id": None}]]
    raw = spark.createDataFrame(rows, schemas.struct(schemas.RAW_TOPIC))
    feed = spark.createDataFrame([("{broken",), ('{"data": {"items": [3]}}',), (None,)], "value string")
    report = {r.stage: r for r in run.run(raw, {"items": feed}).collect()}
    found = {(r.stage, r.reason): r.text for r in run.rejected.read().collect()}
    assert set(found) == {("items", "document"), ("items", "item"), ("ingest", "no id")}
    assert found["items", "document"] == "{broken" and found["items", "item"] == "3"
    assert json.loads(found["ingest", "no id"])["cleaned_text"] == raw_rows()[0]["cleaned_text"]
    assert report["reject"].status == "ok" and report["reject"].inserted == 3


def test_batch_writes_its_indexes(batch_events):
    run, report = batch_events
    events = {r.event_id: r for r in run.table("event_index", B.EVENT_INDEX).read().collect()}
    posts = run.table("post_index", B.POST_INDEX).read().collect()
    stored = run.table("events", B.EVENTS).read().collect()
    assert {e.event_id for e in stored} == set(events) and len(posts) == run.disaster_posts.read().count() == 4
    for e in stored:
        assert [events[e.event_id].lon, events[e.event_id].lat] == list(e.geometry.coordinates)
        assert events[e.event_id].total_posts_count == e.total_posts_count
    assert {p.location_district for p in posts} >= {"klang"} and all(p.post_text for p in posts)
    assert report["indexes"].inserted == len(events) + len(posts)


def test_batch_stores_one_dashboard_document(batch_events):
    run, _ = batch_events
    figures = run.table("figures", B.FIGURES).read().collect()
    doc = run.table("dashboard", B.DOCUMENT).read().collect()
    at = datetime.fromisoformat(NOW)
    assert len(doc) == 1 and doc[0].timestamp == doc[0].updated_at == at
    want = {f: sorted((str(r.key), r.frequency) for r in figures if r.facet == f) for f in ("type_counts", "district_ranking", "sentiment_counts")}
    got = {f: sorted((str(x[0]), x[1]) for x in doc[0][f]) for f in want}
    assert got == want and want["type_counts"]
    months = sorted((r.year, r.month, r.frequency) for r in figures if r.facet == "monthly_events")
    assert [tuple(m) for m in doc[0].monthly_events] == months
    assert {r.updated_at for r in run.table("tracking_keyword", B.TERMS).read().collect()} == {at}


def test_batch_again_adds_nothing(spark, batch_events):
    run, _ = batch_events
    before = sorted(map(key, run.table("events", B.EVENTS).read().collect()))
    raw = spark.createDataFrame([json_row(r) for r in raw_rows()], schemas.struct(schemas.RAW_TOPIC))
    report = {r.stage: r for r in run.run(raw).collect()}
    assert (report["ingest"].inserted, report["ingest"].skipped) == (0, 5)
    assert report["topics"].inserted == 0 and report["places"].inserted == 0
    assert sorted(map(key, run.table("events", B.EVENTS).read().collect())) == before


def test_failed_stage_is_reported(spark, tmp_path):
    run = B.Batch(spark, str(tmp_path), polygons(spark, SQUARE).drop("rings"), NOW)
    raw = spark.createDataFrame([json_row(r) for r in raw_rows()], schemas.struct(schemas.RAW_TOPIC))
    report = {r.stage: r for r in run.run(raw).collect()}
    assert report["places"].status == "failed" and report["places"].message
    assert report["severities"].status == "ok" and report["ingest"].inserted == 4
    assert (report["assemble"].processed, report["consolidate"].inserted) == (0, 0)
    # the next run catches up, although it brings no new posts
    again = B.Batch(spark, str(tmp_path), polygons(spark, SQUARE, OVERLAP), NOW)
    report = {r.stage: r for r in again.run(raw).collect()}
    assert (report["ingest"].inserted, report["places"].inserted) == (0, 4)
    assert report["assemble"].inserted == 4 and report["consolidate"].inserted == 3


def test_feeds_to_raw_rows(spark):
    raw = B.raw_from_feeds(
        timeline(spark, [post("1")]),
        spark.createDataFrame([(json.dumps({"data": {"items": [item("9")]}}),)], "value string"),
    )
    assert sorted((r.tweet_id or r.ig_post_id, r.platform) for r in raw.collect()) == [
        ("1", "twitter"), ("9", "instagram"),
    ]
    with pytest.raises(ValueError):
        B.raw_from_feeds(None, None)


def test_stream_equals_batch(spark, tmp_path, batch_events):
    rows = raw_rows()
    first, second = rows[3:6] + rows[1:2], rows[:1] + rows[2:3]  # late posts arrive last
    c = chain(spark, tmp_path)
    land(tmp_path / "topics" / "raw", "a.json", first, extra=["{broken", "[1"])
    c.run_available()
    assert c.store.outbox.read().count() > 0
    sent = c.store.outbox.read().count()
    land(tmp_path / "topics" / "raw", "b.json", second)
    c.run_available()
    run, _ = batch_events
    want = sorted(map(key, run.table("events", B.EVENTS).read().collect()))
    assert sorted(map(key, c.store.events().collect())) == want
    kept = sorted(r.post_id for r in c.store.disaster_posts.read().collect())
    assert kept == sorted(r.post_id for r in run.disaster_posts.read().collect())
    # the flood got an earlier first post, hence another id, but stays on cooldown
    assert c.store.outbox.read().count() == sent
    deleted = c.store.changes.read().where("is_deleted").collect()
    assert len(deleted) == 1
    rejected = spark.read.text(str(tmp_path / "topics" / "rejected")).collect()
    assert len(rejected) == 2 and "broken" in rejected[0].value + rejected[1].value
    # replaying the same posts changes nothing, an hour later the alert may go out again
    land(tmp_path / "topics" / "raw", "c.json", rows)
    chain(spark, tmp_path, "2025-04-20 02:00:00").run_available()
    assert sorted(map(key, c.store.events().collect())) == want
    assert c.store.outbox.read().count() == sent


def test_alerts_after_cooldown(spark, tmp_path):
    c = chain(spark, tmp_path)
    rows = raw_rows()
    land(tmp_path / "topics" / "raw", "a.json", rows[:1])
    c.run_available()
    assert [(r.email) for r in c.store.outbox.read().collect()] == ["a@x"]
    land(tmp_path / "topics" / "raw", "b.json", rows[1:2])
    chain(spark, tmp_path, "2025-04-20 00:30:00").run_available()
    assert c.store.outbox.read().count() == 1
    land(tmp_path / "topics" / "raw", "c.json", [{**rows[1], "tweet_id": "77"}])
    chain(spark, tmp_path, "2025-04-20 01:00:00").run_available()
    assert c.store.outbox.read().count() == 2


@pytest.mark.parametrize("stage", ["ingest", "topics", "assemble"])
def test_a_stage_that_fails_once_loses_nothing(spark, tmp_path, stage):
    class Failing(B.Batch):
        broken = False

    def stage_of(self, *args):
        if self.broken:
            raise RuntimeError("lost")
        return getattr(B.Batch, stage)(self, *args)

    setattr(Failing, stage, stage_of)
    run = Failing(spark, str(tmp_path), polygons(spark, SQUARE, OVERLAP), NOW)
    rows = raw_rows()
    for part, broken in ((rows[:1], False), (rows[1:2], True), (rows[1:2], False), (rows[4:5], False)):
        run.broken = broken
        raw = spark.createDataFrame([json_row(r) for r in part], schemas.struct(schemas.RAW_TOPIC))
        report = {r.stage: r.status for r in run.run(raw).collect()}
        assert report[stage] == ("failed" if broken else "ok")
    assert sorted(r.post_id for r in run.disaster_posts.read().collect()) == ["1", "2", "5"]
    events = run.table("events", B.EVENTS).read().collect()
    assert sorted(e.total_posts_count for e in events) == [1, 2]


def test_committed_data_without_marker_is_not_taken_for_an_empty_table(spark, tmp_path):
    log = B.BatchLog(spark, str(tmp_path / "log"), schemas.struct("a int"))
    log.append(spark.createDataFrame([(1,)], "a int"), 0)
    folder = tmp_path / "log" / "batch=000000000000"
    kept = folder.rename(tmp_path / "kept")
    folder.mkdir(parents=True)
    for part in kept.glob("part-*"):
        (folder / part.name).write_bytes(part.read_bytes())
    with pytest.raises(ValueError, match="_SUCCESS"):
        log.read()
    (folder / "_temporary").mkdir()
    assert log.read().count() == 0


def test_unlocated_posts_are_tried_again(spark, tmp_path):
    """Found on the second try by a hashtag, on the third by a place field, or kept as pending."""
    text = "NADMA: banjir, water level 30 cm, post {}"
    at = "2025-04-11T10:00:00Z"

    def row(i, hashtags, location):
        return {"tweet_id": i, "cleaned_text": text.format(i), "raw_text": text.format(i), "tweet_created_at": at,
                "tweet_hashtags": hashtags, "location": location, "platform": "twitter"}

    rows = [row("1", "banjir,Klang", None), row("2", "banjir", "somewhere near Klang"), row("3", "banjir", None)]
    run, report = batch_run(spark, tmp_path, rows)
    report = {r.stage: r for r in report.collect()}
    assert report["resweep"].status == "ok", report["resweep"].message
    assert (report["resweep"].processed, report["resweep"].inserted, report["resweep"].skipped) == (5, 2, 1)
    found = {r.post_id: r for r in run.log("geo_found", B.FOUND).read().collect()}
    assert {i: (r.attempts, r.geo_data.district) for i, r in found.items()} == {"1": (2, "klang"), "2": (3, "klang")}
    assert found["2"].raw_geo.location == "somewhere near Klang" and found["1"].geo_processed
    (left,) = run.table("pending_geo", B.PENDING).read().collect()
    assert (left.postId, left.attempts) == ("3", 3) and left.last_processed_at == datetime(2025, 4, 20)
    events = {e.location_district: e.total_posts_count for e in run.table("events", B.EVENTS).read().collect()}
    assert events["klang"] == 2 and sum(events.values()) == 3
    # a run without new posts tries nothing again
    raw = spark.createDataFrame([json_row(r) for r in rows], schemas.struct(schemas.RAW_TOPIC))
    again = {r.stage: r for r in run.run(raw).collect()}["resweep"]
    assert (again.status, again.processed, again.inserted, again.skipped) == ("ok", 0, 0, 1)

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sitrep import schemas
from sitrep.operators import consolidate as C
from sitrep.streaming.events import EventStore

T0 = datetime(2025, 4, 11, 13, 57, 55)
HOUR = timedelta(hours=1)


def post(pid, at, kind="flood", district="Shah Alam", state="selangor", at_lon_lat=(101.5, 3.0)):
    return (pid, "Confirmed", kind, at, (state, district, list(at_lon_lat)), "text", "", "", None)


def frame(spark, rows):
    return spark.createDataFrame(rows, schemas.struct(schemas.DISASTER_POSTS))


def table(df):
    cols = ["event_id", "classification_type", "location_district", "location_state", "start_time",
            "most_recent_report", "geometry", "total_posts_count"]
    return sorted(str(tuple(r)) for r in df.select(*cols).collect())


def events(spark, rows):
    return C.consolidate(frame(spark, rows)).orderBy("start_time", "event_id").collect()


def test_gap_of_exactly_a_day_joins_and_a_microsecond_more_splits(spark):
    joined = events(spark, [post("a", T0), post("b", T0 + 24 * HOUR)])
    assert [e.total_posts_count for e in joined] == [2]
    late = T0 + 24 * HOUR + timedelta(microseconds=1)
    assert [e.total_posts_count for e in events(spark, [post("a", T0), post("b", late)])] == [1, 1]


def test_chain(spark):
    rows = [post(str(h), T0 + h * HOUR) for h in (0, 20, 40)]
    (e,) = events(spark, rows)
    assert (e.start_time, e.most_recent_report, e.total_posts_count) == (T0, T0 + 40 * HOUR, 3)


def test_keys_separate_and_case_does_not(spark):
    rows = [post("a", T0), post("b", T0, district="shah alam"), post("c", T0, kind="storm"),
            post("d", T0, district="klang")]
    assert sorted(e.total_posts_count for e in events(spark, rows)) == [1, 1, 2]


def test_repeated_post_counts_once(spark):
    (e,) = events(spark, [post("a", T0), post("a", T0), post("a", T0 + HOUR)])
    assert e.total_posts_count == 1


def test_state_of_last_and_geometry_of_first(spark):
    rows = [post("a", T0, state="Johor", at_lon_lat=(1.0, 2.0)), post("b", T0 + HOUR, state="Perak")]
    (e,) = events(spark, rows)
    assert e.location_state == "perak" and e.geometry.coordinates == [1.0, 2.0]


def test_event_id(spark):
    (e,) = events(spark, [post("abc", T0)])
    assert e.event_id == "FLOOD-SHAHALAM-20250411-135755-9001"
    row = spark.range(1).select(
        C.event_id(F.lit("flood"), F.lit("klang"), F.lit(T0), F.lit(""))
    ).first()
    assert row[0].endswith("-0000")


def test_unusable_posts_and_missing_places(spark):
    rows = [post("a", T0, kind=None), post("b", None), post("c", T0, district=None, state=None)]
    (e,) = events(spark, rows)
    assert (e.location_district, e.location_state) == ("unknown", "unknown")


def test_before_1970(spark):
    base = datetime(1969, 12, 31, 20)
    rows = [post("a", base - 23 * HOUR), post("b", base), post("c", base + 48 * HOUR)]
    assert [e.total_posts_count for e in events(spark, rows)] == [2, 1]


def random_posts(seed, n=250):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        at = T0 + timedelta(minutes=rng.randrange(0, 60 * 24 * 30))
        # a third of all posts share one key
        hot = rng.random() < 0.34
        rows.append(
            post(
                f"p{i}", at,
                "flood" if hot else rng.choice(["flood", "storm"]),
                "Klang" if hot else rng.choice([f"d{k}" for k in range(12)]),
                rng.choice(["johor", "perak"]),
                (float(i), float(i)),
            )
        )
    return rows


def fold(rows):
    """The rule itself, one post at a time in time order."""
    out = []
    for r in sorted(rows, key=lambda r: (r[3], r[0])):
        kind, district, at = r[2], r[4][1].lower(), r[3]
        hit = next((e for e in out if e["key"] == (kind, district)
                    and e["recent"] >= at - timedelta(hours=24)), None)
        if hit is None:
            hit = {"key": (kind, district), "start": at, "ids": [], "geo": r[4][2]}
            out.append(hit)
        hit.update(recent=at, state=r[4][0])
        hit["ids"].append(r[0])
    return sorted(
        (e["key"], e["start"], e["recent"], e["state"], e["geo"], len(e["ids"]), sorted(e["ids"]))
        for e in out
    )


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_the_fold_in_any_order(spark, seed):
    rows = random_posts(seed)
    shuffled = rows[:]
    random.Random(seed).shuffle(shuffled)
    df = frame(spark, shuffled).repartition(7)
    members = {}
    for r in C.event_posts(df).collect():
        members.setdefault(r.event_id, []).append(r.post_id)
    got = sorted(
        ((e.classification_type, e.location_district), e.start_time, e.most_recent_report,
         e.location_state, e.geometry.coordinates, e.total_posts_count, sorted(members[e.event_id]))
        for e in C.consolidate(df).collect()
    )
    assert got == fold(rows)
    assert sum(e[5] for e in got) == len(rows)


def test_a_changed_post_is_noticed(spark):
    rows = random_posts(3)
    changed = [*rows[:-1], post("p249", T0 + timedelta(days=200), "storm", "d1")]
    assert table(C.consolidate(frame(spark, rows))) != table(C.consolidate(frame(spark, changed)))
    assert table(C.consolidate(frame(spark, rows))) != table(C.consolidate(frame(spark, rows[1:])))


def test_pages_hold_every_id_once(spark):
    df = frame(spark, [post(f"p{i}", T0 + i * timedelta(minutes=1)) for i in range(300)])
    pages = C.event_post_pages(C.event_posts(df), per_page=40).collect()
    ids = [i for p in pages for i in p.related_post_ids]
    assert len(ids) == 300 and len(set(ids)) == 300 and {p.pages for p in pages} == {8}
    small = C.event_post_pages(C.event_posts(df)).collect()
    assert len(small) == 1 and len(small[0].related_post_ids) == 300


@pytest.mark.parametrize("seed", [5])
def test_micro_batches_reach_the_batch_result(spark, tmp_path, seed):
    rows = random_posts(seed, 160)
    random.Random(seed).shuffle(rows)
    store = EventStore(spark, str(tmp_path / "s"), fan=2)
    cuts = [0, 30, 60, 80, 100, 160]
    for batch, (a, b) in enumerate(zip(cuts, cuts[1:])):
        # each batch repeats some posts of the batch before
        store.settle(batch)
        store.add(frame(spark, rows[max(0, a - 10):b]), batch)
    assert not (tmp_path / "s" / "arrivals" / "batch=000000000001").exists()
    whole = frame(spark, rows)
    assert table(store.events()) == table(C.consolidate(whole))
    assert sorted(map(tuple, store.event_posts().collect())) == sorted(
        map(tuple, C.event_posts(whole).collect())
    )
    store.settle(4)
    store.add(frame(spark, rows[100:160]), 4)  # the last batch is run again
    assert table(store.events()) == table(C.consolidate(whole))
    # replaying the published changes gives the same set of events
    live = {}
    for r in sorted(store.changes.read().withColumn("b", F.input_file_name()).collect(),
                    key=lambda r: (r.b.split("batch=")[1][:12], not r.is_deleted)):
        if r.is_deleted:
            live.pop(r.event_id, None)
        else:
            live[r.event_id] = r.total_posts_count
    assert live == {e.event_id: e.total_posts_count for e in store.events().collect()}


def test_late_post_bridges_two_events(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "s"))
    store.add(frame(spark, [post("a", T0), post("b", T0 + 40 * HOUR)]), 0)
    ids = {e.start_time: e.event_id for e in store.events().collect()}
    store.add(frame(spark, [post("c", T0 + 20 * HOUR)]), 1)
    (e,) = store.events().collect()
    assert e.event_id == ids[T0] and e.total_posts_count == 3
    changes = {(r.event_id, r.is_deleted) for r in store.changes.read_batch(1).collect()}
    assert changes == {(ids[T0], False), (ids[T0 + 40 * HOUR], True)}
    assert table(store.events()) == table(C.consolidate(frame(
        spark, [post("a", T0), post("b", T0 + 40 * HOUR), post("c", T0 + 20 * HOUR)])))


def test_set_cooldown_stays_with_a_merged_event(spark, tmp_path):
    """A cooldown set for an event holds after an earlier event has swallowed it."""
    people = spark.createDataFrame(
        [("a@x", ["Selangor"], 0.0, 0.0)], schemas.struct(schemas.SUBSCRIBERS)
    )
    store = EventStore(spark, str(tmp_path / "s"))

    def step(rows, batch, now):
        store.settle(batch)
        store.add(frame(spark, rows), batch)
        store.alert(people, batch, str(now), "https://h/u")
        return store.outbox.read_batch(batch).count()

    later = T0 + 40 * HOUR
    assert step([post("b", later, state="Selangor")], 0, later) == 1
    (event,) = store.events().collect()
    own = spark.createDataFrame([(event.event_id, 300)], "event_id string, alert_cooldown_mins int")
    store.set_cooldown(own, str(later))
    # two hours on, the default of one hour would let it go out again
    assert step([post("c", T0 + 20 * HOUR, state="Selangor")], 1, later + 2 * HOUR) == 0
    assert step([post("a", T0, state="Selangor")], 2, later + 3 * HOUR) == 0
    (event,) = store.alerted_events().collect()
    assert (event.start_time, event.alert_cooldown_mins, event.last_alert_sent) == (T0, 300, later)
    assert step([post("d", T0 + 21 * HOUR, state="Selangor")], 3, later + 5 * HOUR) == 1


def test_a_repeated_batch_has_its_first_time(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "s"))
    assert store.moment(0, lambda: "2025-01-01 00:00:00") == "2025-01-01 00:00:00"
    assert store.moment(0, lambda: "2025-01-02 00:00:00") == "2025-01-01 00:00:00"
    assert store.moment(1, lambda: "2025-01-02 00:00:00") == "2025-01-02 00:00:00"

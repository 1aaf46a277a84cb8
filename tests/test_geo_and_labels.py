import json
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitrep import schemas
from sitrep.operators import geo, labels
from sitrep.sources import dimensions
from test_terms_and_metrics import EVENT, event


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def polygons(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.struct(schemas.POLYGONS))


SQUARE = (1, "selangor", "klang", [ring((100, 1), (102, 1), (102, 3), (100, 3))])
OVERLAP = (2, "johor", "muar", [ring((101, 2), (104, 2), (104, 4), (101, 4))])
RING = (3, "perak", "ipoh", [ring((105, 1), (109, 1), (109, 5), (105, 5)), ring((106, 2), (108, 2), (108, 4), (106, 4))])


def test_points(spark):
    points = spark.createDataFrame(
        [("in", 2.0, 100.5), ("both", 2.5, 101.5), ("out", 5.5, 118.0), ("none", None, 101.0),
         ("hole", 3.0, 107.0), ("rim", 1.5, 105.5), ("box", 8.5, 101.0)],
        "post_id string, lat double, lon double",
    )
    got = {
        r.post_id: r.gps.polygon_id if r.gps else None
        for r in geo.locate_points(points, polygons(spark, SQUARE, OVERLAP, RING)).collect()
    }
    assert got == {"in": 1, "both": 1, "out": None, "none": None, "hole": None, "rim": 3, "box": None}


@pytest.mark.parametrize("cell", [0.3, 1.0, 7.0])
def test_points_equal_brute_force(spark, cell):
    rng = random.Random(7)
    shapes = []
    for i in range(12):
        cx, cy = rng.uniform(100, 119), rng.uniform(1, 7)
        pts = [(cx + rng.uniform(-3, 3), cy + rng.uniform(-2, 2)) for _ in range(rng.choice([3, 5, 9]))]
        shapes.append((i, "s", str(i), [ring(*pts)]))
    pts = [(str(i), rng.uniform(0, 8), rng.uniform(99, 120)) for i in range(400)]

    def inside(shape, lat, lon):
        r = [(p["x"], p["y"]) for p in shape[3][0]]
        n = 0
        for (x1, y1), (x2, y2) in zip(r, r[1:] + r[:1]):
            if (y1 > lat) != (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1:
                n += 1
        return n % 2 == 1

    want = {p: next((s[0] for s in shapes if inside(s, lat, lon)), None) for p, lat, lon in pts}
    df = spark.createDataFrame(pts, "post_id string, lat double, lon double")
    got = geo.locate_points(df, polygons(spark, *shapes), cell=cell).collect()
    assert {r.post_id: r.gps.polygon_id if r.gps else None for r in got} == want
    assert sum(v is not None for v in want.values()) > 50


def test_decision(spark):
    posts = spark.createDataFrame(
        [("verified", "flood in Klang", 2.0, 100.5), ("conflict", "flood in Muar", 2.0, 100.5),
         ("text", "banjir di johor", None, None), ("gps", "flood", 2.0, 100.5),
         ("nowhere", "flood", None, None), ("sea", "flood", 5.5, 118.0),
         ("unresolved", "flood in Kuching", 2.0, 100.5)],
        "post_id string, postText string, latitude double, longitude double",
    )
    got = {
        r.post_id: (r.geo_data.state, r.geo_data.district, r.geo_data.confidence_score,
                    r.geo_data.inference, r.geo_data.is_malaysia)
        for r in geo.resolve_geo(posts, polygons(spark, SQUARE, OVERLAP)).collect()
    }
    unknown = ("Unknown State", "Unknown District", 0.0, "none")
    assert got == {
        "verified": ("selangor", "klang", 1.0, "gps_verified_by_ai", True),
        "conflict": ("johor", "muar", 0.8, "ai_opencage_rescue", True),
        "text": ("johor", "muar", 0.8, "ai_opencage_rescue", True),
        "gps": ("selangor", "klang", 0.6, "gps_only", True),
        "nowhere": (*unknown, False),
        "sea": (*unknown, True),
        "unresolved": ("selangor", "klang", 0.6, "gps_only", True),
    }
    # states in two spellings, and a district without an outline of its own
    states = spark.createDataFrame(
        [("both", "flood in Penang", 2.0, 100.5), ("state", "flood in George Town", None, None)],
        "post_id string, postText string, latitude double, longitude double",
    )
    pulau = polygons(spark, SQUARE).withColumn("state", F.lit("pulau pinang"))
    found = {r.post_id: r.geo_data for r in geo.resolve_geo(states, pulau).collect()}
    assert found["both"].confidence_score == 1.0 and found["state"].confidence_score == 0.8
    rescued = geo.resolve_geo(posts, polygons(spark, SQUARE, OVERLAP)).where("post_id = 'text'").first()
    assert (rescued.geo_data.lat, rescued.geo_data.lon) == (3.0, 102.5)


def test_geojson(spark, tmp_path):
    square = [[[100, 1], [102, 1], [102, 3], [100, 3], [100, 1]]]
    doc = {"features": [
        {"properties": {"NAME_1": "Selangor", "NAME_2": "HuluLangat"},
         "geometry": {"type": "Polygon", "coordinates": square}},
        {"properties": {"NAME_1": "Johor", "NAME_2": "Muar"},
         "geometry": {"type": "MultiPolygon", "coordinates": [square, [[[110, 1], [111, 1], [111, 2]]]]}},
    ]}
    (tmp_path / "p.json").write_text(json.dumps(doc, indent=1))
    shapes = dimensions.read_polygons(spark, str(tmp_path / "p.json"))
    rows = {r.polygon_id: r for r in shapes.collect()}
    assert (rows[0].state, rows[0].district) == ("selangor", "hulu langat") and len(rows[1].rings) == 2
    points = spark.createDataFrame([("a", 2.0, 101.0), ("b", 1.2, 110.9)], "post_id string, lat double, lon double")
    got = {r.post_id: r.gps.district for r in geo.locate_points(points, shapes).collect()}
    assert got == {"a": "hulu langat", "b": "muar"}


def test_gazetteer(spark):
    posts = spark.createDataFrame(
        [("a", " Shah Alam "), ("b", "johor"), ("c", "oslo"), ("d", None)], "post_id string, loc string"
    )
    got = {r.post_id: (r.state, r.district) for r in geo.lookup_places(posts, "loc").collect()}
    assert got == {
        "a": ("selangor", "shah alam"), "b": ("johor", "Unknown District"), "c": (None, None), "d": (None, None),
    }
    named = spark.createDataFrame(
        [("a", "Johor: banjir di Batu Pahat"), ("b", "selangor klang"), ("c", "johorian"), ("d", "KEDAH!")],
        "post_id string, t string",
    )
    got = {r.post_id: r.intent and tuple(r.intent) for r in geo.with_place_intent(named, "t").collect()}
    assert got == {
        "a": ("johor", "batu pahat"), "b": ("selangor", "klang"), "c": None, "d": ("kedah", "Unknown District"),
    }
    names = dimensions.gazetteer(spark)
    assert names.count() == names.select("name").distinct().count() < 200
    assert dimensions.search_queries(dimensions.place_keywords(spark), "place").count() == 15 * 28


def test_map(spark):
    def extent(*rows):
        return geo.map_extent(spark.createDataFrame(list(rows), EVENT)).first()

    many = extent(event(1), event(2, xy=(103.0, 5.0)), event(3, xy=None))
    assert (many["mode"], many.west, many.east, many.centre_lat, many.zoom) == ("box", 101.0, 103.0, 4.0, None)
    one = extent(event(1), event(2, xy=(1.0,)))
    assert (one["mode"], one.centre_lon, one.zoom) == ("point", 101.0, 12)
    none = extent(event(1, xy=None))
    assert (none["mode"], none.centre_lat, none.centre_lon, none.zoom) == ("default", 4.21, 101.69, 6)
    rows = [event(i, xy=(101.5, 3.5)) for i in range(50)] + [event(99, xy=(104.5, 3.5))]
    grid = {r.cell_x: (r.events, r.size_class) for r in
            geo.marker_grid(spark.createDataFrame(rows, EVENT)).collect()}
    assert grid == {101: (50, "large"), 104: (1, "small")}


# --- labels ---------------------------------------------------------------------------------
def labelled(spark, fn, texts, *columns):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, postText string")
    return [tuple(r[c] for c in columns) for r in fn(df, "postText").orderBy("i").collect()]


def test_severity(spark):
    texts = [
        "Help! The water is rising fast and we are trapped on the roof!",
        "Heavy rain expected tonight, please avoid low-lying areas.",
        "The local government has opened three new relief centers for flood victims.",
    ]
    got = labelled(spark, labels.label_severity, texts, "sentiment_label")
    assert got == [("Urgent",), ("Warning",), ("Informational",)]


def test_incident(spark):
    texts = ["Banjir kilat di KL", "kilat besar", "flooding and a landslide; floods", "hello there", "abc", None]
    got = labelled(spark, labels.label_incident, texts, "classification_type", "confidence_score")
    assert got == [("flood", 1.0), ("storm", 1.0), ("flood", 0.6667), ("none", 1.0), ("none", 1.0), ("none", 1.0)]


def test_authenticity(spark):
    texts = [
        "Water up to my knees, 30 cm, in Shah Alam", "Penang is sinking!", "Penang ribut, everyone stay safe",
        "NADMA warning issued", None,
    ]
    got = labelled(spark, labels.label_authenticity, texts, "check_label")
    assert [g[0] for g in got] == ["AUTHENTIC", "MISINFORMATION", "UNCERTAIN", "AUTHENTIC", "UNCERTAIN"]


def test_topics(spark):
    texts = ["Banjir di Johor", "gempa bumi!!", "Nothing at all here", "banjir", "Tanah runtuh near Ipoh"]
    got = labelled(spark, labels.topic_phrase, texts, "topic")
    assert [g[0] for g in got] == ["flood in johor", "earthquake", None, None, "landslide in ipoh"]


def test_incident_needs_whole_words(spark):
    texts = ["hazel likes stormtroopers and Thunderbolt laptops", "Thunderstorms tonight"]
    assert labelled(spark, labels.label_incident, texts, "classification_type") in (
        ["none", "storm"], [("none",), ("storm",)],
    )


def test_topics_of_fillers_stand_for_themselves(spark):
    df = spark.createDataFrame([("in",), ("!!!",), ("At Road",)], "topic string")
    got = {r.topic: r.canonical for r in labels.canonical_topics(df).collect()}
    assert got == {"in": "In", "!!!": "!!!", "At Road": "At Road"}


def test_canonical_topics(spark):
    topics = ["landslide sibu", "Landslide in Sibu Road", "sibu landslide", "flood kl", None, ""]
    df = spark.createDataFrame([(t,) for t in topics], "topic string")
    got = {r.topic: r.canonical for r in labels.canonical_topics(df).collect()}
    assert got == {
        "landslide sibu": "Landslide In Sibu Road", "Landslide in Sibu Road": "Landslide In Sibu Road",
        "sibu landslide": "Landslide In Sibu Road", "flood kl": "Flood Kl",
    }


LABEL = T.StructType([T.StructField("label", T.StringType())])


def hook(spark, labeller):
    df = spark.createDataFrame([("1", "a"), ("2", "b")], "post_id string, t string").coalesce(1)
    out = labels.label_posts(df, labeller, LABEL, backoff=lambda attempt: 0.0)
    return {r.post_id: (r.label, r.error) for r in out.collect()}


def test_labellers_get_small_portions(spark):
    """Many rows, or few long ones: a labeller gets a bounded part of Spark's batch, and every row comes back once."""
    many = spark.range(0, 5000, 1, 1).selectExpr("id", "'x' AS t", "timestamp_seconds(id) AS at")
    long = spark.range(9000, 9012, 1, 1).selectExpr("id", "repeat('word ', 300000) AS t", "timestamp_seconds(id) AS at")
    size = T.StructType.fromDDL("n long, mb double, at timestamp")

    def sizes(batch):
        mb = batch["t"].str.len().sum() / 1e6
        return batch[["id", "at"]].assign(n=len(batch), mb=float(mb))

    for df in (many, long):
        out = labels.label_posts(df, sizes, size, key="id").cache()
        assert out.where("error IS NOT NULL").isEmpty()
        assert out.select("id", "at").exceptAll(df.select("id", "at")).isEmpty() and out.count() == df.count()
        most = out.agg(F.max("n"), F.max("mb")).first()
        assert most[0] <= labels.PORTION_ROWS and most[1] <= labels.PORTION_MB
    kind = T.StructType.fromDDL("n long")
    got = labels.gather_labels(many.select("id", "t"), {"a": (lambda b: b[["id"]].assign(n=len(b)), kind)}, key="id")
    assert got.where("error IS NULL AND n <= 16").select("id").distinct().count() == 5000


def test_hook(spark, tmp_path):
    assert hook(spark, lambda b: pd.DataFrame({"post_id": b.post_id, "label": b.t.str.upper()})) == {
        "1": ("A", None), "2": ("B", None),
    }
    tries = str(tmp_path / "tries")

    def limited(batch, succeed_at):
        with open(tries, "a") as f:
            f.write("x")
        if len(open(tries).read()) < succeed_at:
            raise labels.RateLimited("slow down")
        return pd.DataFrame({"post_id": batch.post_id, "label": "ok"})

    assert hook(spark, lambda b: limited(b, 3)) == {"1": ("ok", None), "2": ("ok", None)}
    open(tries, "w").close()
    got = hook(spark, lambda b: limited(b, 9))
    assert got["1"] == (None, "rate limited: slow down") and len(open(tries).read()) == 3
    open(tries, "w").close()

    def broken(batch):
        with open(tries, "a") as f:
            f.write("x")
        raise ValueError("no")

    # the batch, then each of its halves
    assert hook(spark, broken)["2"] == (None, "ValueError: no") and open(tries).read() == "xxx"

    def choosy(batch):
        if (batch.post_id == "1").any():
            raise ValueError("not this one")
        return pd.DataFrame({"post_id": batch.post_id, "label": "ok"})

    assert hook(spark, choosy) == {"1": (None, "ValueError: not this one"), "2": ("ok", None)}
    got = hook(spark, lambda b: pd.DataFrame({"post_id": ["2"], "label": ["ok"]}))
    assert got == {"1": (None, "not returned"), "2": ("ok", None)}


@pytest.mark.parametrize(
    "frame, error",
    [
        (lambda b: b[["post_id"]], "KeyError"),
        (lambda b: b.assign(label=[{"no": "text"}] * len(b)), "Arrow"),
        (lambda b: pd.concat([b.assign(label="x")] * 2), "ValueError: a key is returned twice"),
        (lambda b: b.assign(label="x", post_id="9"), "ValueError: a key is returned that"),
        (lambda b: None, "TypeError"),
    ],
)
def test_hook_checks_what_its_labeller_returns(spark, frame, error):
    got = hook(spark, frame)
    assert set(got) == {"1", "2"} and all(label is None and error in e for label, e in got.values())


def test_split_valid(spark):
    df = spark.createDataFrame(
        [("1", "Urgent", None), ("2", "Odd", None), ("3", None, "x"), ("4", "Urgent", "x")],
        "post_id string, label string, error string",
    )
    good, bad = labels.split_valid(df, "label", ["Urgent"])
    assert [r.post_id for r in good.collect()] == ["1"]
    assert sorted(r.post_id for r in bad.select(F.col("post_id")).collect()) == ["2", "3", "4"]


def test_gather_is_all_or_nothing(spark):
    """A slow, a failing and a malformed labeller leave one error row per post and no crash."""
    def slow(b):
        if (b.t == "slow").any():
            time.sleep(3)
        return pd.DataFrame({"post_id": b.post_id, "a": b.t})

    def failing(b):
        if (b.t == "fails").any():
            raise KeyError("gone")
        return pd.DataFrame({"post_id": b.post_id, "b": 1.5})

    def malformed(b):
        if (b.t == "odd").any():
            return pd.DataFrame({"post_id": b.post_id, "other": 1})
        if (b.t == "typed").any():
            return pd.DataFrame({"post_id": b.post_id, "c": ["no number"]})
        if (b.t == "none").any():
            return None
        if (b.t == "empty").any():
            return pd.DataFrame({"post_id": [], "c": []})
        return pd.DataFrame({"post_id": b.post_id, "c": 7})

    texts = ["ok", "slow", "fails", "odd", "typed", "none", "empty", "fine"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "post_id string, t string").coalesce(1)
    kinds = {"slow": (slow, "a string"), "failing": (failing, "b double"), "malformed": (malformed, "c int")}
    asked = {n: (f, T.StructType.fromDDL(k)) for n, (f, k) in kinds.items()}
    out = labels.gather_labels(df, asked, seconds=1.0, rows_at_once=3)
    rows = {texts[int(r.post_id)]: r for r in out.collect()}
    assert len(rows) == len(texts)
    assert [tuple(rows[t])[1:] for t in ("ok", "fine")] == [("ok", 1.5, 7, None), ("fine", 1.5, 7, None)]
    assert rows["slow"].error == "slow: no answer within 1 s" and rows["fails"].error.startswith("failing: KeyError")
    assert all(rows[t].error.startswith("malformed: ") for t in ("odd", "typed", "none", "empty"))
    assert all(rows[t][c] is None for t in texts if t not in ("ok", "fine") for c in "abc")
    done, rejected = labels.split_gathered(out)
    assert done.columns == ["post_id", "a", "b", "c"] and rejected.columns == ["post_id", "error"]
    # one id twice, and none: rows are asked alone
    twice = spark.createDataFrame([("1", "ok"), ("1", "fails"), (None, "fine")], "post_id string, t string").coalesce(1)
    got = [(r.post_id, r.a, r.error and r.error[:7]) for r in labels.gather_labels(twice, asked, seconds=5.0).collect()]
    assert got == [("1", "ok", None), ("1", None, "failing"), (None, "fine", None)]
    with pytest.raises(ValueError):
        labels.gather_labels(df, {"x": asked["slow"], "y": asked["slow"]})


def test_gather_stops_asking_those_who_never_answer(spark, monkeypatch):
    monkeypatch.setattr(labels, "MAX_LEFT", 2)
    df = spark.range(0, 6, 1, 1).select(F.col("id").cast("string").alias("post_id"))

    def silent(b):
        time.sleep(20)

    out = labels.gather_labels(df, {"silent": (silent, LABEL)}, seconds=0.2, rows_at_once=1).collect()
    assert len(out) == 6 and all(r.label is None and r.error for r in out)
    assert sum(r.error.startswith("silent: not asked") for r in out) == 4

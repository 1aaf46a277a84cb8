"""The shapes this library works on, derived from the general-purpose test tables.

Each view exists twice: as a DataFrame here and as a SQL expression in ``oracles``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitrep import constants as K
from sitrep.functions.text import literal_array
from sitrep.operators.ingest import as_raw_topic
from sitrep.session import tune

# places an event may name: every (state, district) pair, then unusable ones
PAIRS: list[tuple[str | None, str | None]] = [
    (s, d) for s, ds in K.STATE_DISTRICTS.items() for d in ds
] + [
    ("unknown state", "unknown district"),
    ("Unknown State", "Unknown District"),
    (None, None),
    ("", "klang"),
    ("perak", ""),
    ("johor", "unknown"),
]

TYPES: list[str | None] = [*K.INCIDENT_TYPES, "none", None]

# sentences put behind the text of a document, so that labellers find something to label
PHRASES = [
    "Banjir kilat di Shah Alam, water level 30 cm, up to my knees",
    "Penang is sinking! viral news",
    "NADMA alert: landslide near Ipoh, avoid the road",
    "Stay safe everyone",
    "Heavy rain expected tonight in Johor Bahru, please avoid low-lying areas",
    "Help! We are trapped on the roof in Klang, banjir everywhere",
    "ribut and kilat over Kuching, taufan soon",
    "Jerebu di Kuala Lumpur",
    "Huge sinkhole (mendapan tanah) at George Town, we are 2 km away",
    "See http://bit.ly/123 and www.example.com @Lim123 \U0001f525 1️⃣ #banjir now!",
    "gempa bumi felt in Ranau, Sabah. tsunami warning for Langkawi",
    "floods and flooding in Sarawak; donations welcome",
    "hazel likes stormtroopers and Thunderbolt laptops",
    "contributions and distribution of ribut-proof tents, banjir-kilat and kilat",
    "",
]

SUBSCRIBER_STATES = [
    "Kuala Lumpur", "Selangor", "Johor", "Sabah", "Sarawak", "Kedah", "Penang", "Pahang",
    "Terengganu", "Melacca", "Kelantan", "Perak", "Negeri Sembilan", "Perlis",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list, index: Column) -> Column:
    """The value at a zero-based index of a short constant list."""
    return F.get(literal_array(values), index.cast("int"))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disaster posts, one per row of ``events``."""
    e, n = table(spark, sf_dir, "events"), table(spark, sf_dir, "nation")
    kind = (
        F.when(F.col("event_type") == "click", "flood")
        .when(F.col("event_type") == "view", "storm")
        .when(F.col("event_type") == "purchase", "landslide")
        .when(F.col("event_type") == "signup", "haze")
        .otherwise("none")
    )
    k = F.get_json_object("props", "$.k").cast("int")
    severity = (
        F.when(F.col("value") < 60, "Informational")
        .when(F.col("value") < 150, "Warning")
        .otherwise("Urgent")
    )
    lat, lon = point(F.col("event_id"))
    return e.join(n, n["n_nationkey"] == (e["user_id"] % 25).cast("int")).select(
        F.col("event_id").cast("string").alias("post_id"),
        F.lit("Confirmed").alias("classification_status"),
        kind.alias("disaster_type"),
        F.col("ts").alias("start_time"),
        F.struct(
            F.col("n_name").alias("state"),
            F.when(F.col("user_id") % 12 == 0, "Unknown District")
            .otherwise(F.concat(F.lit("District "), F.col("user_id").cast("string")))
            .alias("district"),
            F.when(F.col("value") >= 2, F.array(lon, lat)).alias("lat_lon"),
        ).alias("location"),
        F.concat(
            F.lit("Report "), F.col("event_id").cast("string"), F.lit(" level "), k.cast("string")
        ).alias("post_text"),
        F.when(k < 5, "null")
        .otherwise(F.concat(kind, F.lit(", Topic "), (k % 17).cast("string"), F.lit(", ,Rain")))
        .alias("keywords"),
        F.when(k < 10, "null")
        .otherwise(F.concat(F.lit("#Tag"), (k % 23).cast("string"), F.lit(", #Help")))
        .alias("hashtags"),
        F.when(
            F.col("value") >= 10,
            F.struct(
                severity.alias("label"),
                F.round(F.col("value") / 500, 4).alias("confidence"),
                F.lit("value").alias("reasoning"),
            ),
        ).alias("sentiment"),
    )


def point(key: Column) -> tuple[Column, Column]:
    """Coordinates from an id: most inside the bounding box, some outside."""
    lat = F.lit(-0.5) + (key * 37 % 900).cast("double") / 100
    lon = F.lit(98.5) + (key * 53 % 2200).cast("double") / 100
    return lat, lon


def hot_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same posts in twelve districts only, so that every event is large."""
    return posts(spark, sf_dir).withColumn(
        "location",
        F.struct(
            F.col("location.state").alias("state"),
            F.concat(F.lit("Zone "), (F.col("post_id").cast("bigint") % 12).cast("string")).alias(
                "district"
            ),
            F.col("location.lat_lon").alias("lat_lon"),
        ),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consolidated events, one per row of ``orders``."""
    o = table(spark, sf_dir, "orders")
    place = F.col("o_custkey") % len(PAIRS)
    _, lon = point(F.col("o_orderkey"))
    lat, _ = point(F.col("o_orderkey"))
    price = F.col("o_totalprice")
    none_d = F.lit(None).cast("double")
    hour = lambda n: F.make_dt_interval(F.lit(0), n.cast("int"))
    start = F.col("o_orderdate") + hour(F.col("o_orderkey") % 24)
    recent = start + hour(F.col("o_custkey") % 72)
    size = (F.col("o_custkey") % 5 + 1).cast("bigint")
    return o.select(
        F.concat(F.lit("EV-"), F.col("o_orderkey").cast("string")).alias("event_id"),
        pick(TYPES, (F.col("o_orderkey") * 7 + F.col("o_custkey")) % len(TYPES)).alias(
            "classification_type"
        ),
        pick([d for _, d in PAIRS], place).alias("location_district"),
        pick([s for s, _ in PAIRS], place).alias("location_state"),
        start.alias("start_time"),
        recent.alias("most_recent_report"),
        F.struct(
            F.lit("Point").alias("type"),
            F.when(price < 5000, F.lit(None).cast("array<double>"))
            .when(price < 10000, F.array(lon))
            .when(price < 15000, F.array(lon, none_d))
            .otherwise(F.array(lon, lat))
            .alias("coordinates"),
        ).alias("geometry"),
        size.alias("total_posts_count"),
        F.when(
            F.col("o_orderstatus") == "P", recent + F.expr("INTERVAL '80' DAY")
        ).alias("last_alert_sent"),
        F.when(F.col("o_orderpriority") == "1-URGENT", 1440).cast("int").alias(
            "alert_cooldown_mins"
        ),
    )


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with long texts: a document followed by one of the phrases, with coordinates."""
    d = table(spark, sf_dir, "documents")
    lat, lon = point(F.col("doc_id"))
    return d.select(
        F.col("doc_id").cast("string").alias("post_id"),
        F.concat(F.col("text"), F.lit(" "), pick(PHRASES, F.col("doc_id") % len(PHRASES))).alias(
            "post_text"
        ),
        F.when(F.col("n_chars") >= 100, lat).alias("latitude"),
        F.when(F.col("n_chars") >= 100, lon).alias("longitude"),
    )


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authenticity checks, one per row of ``labels``."""
    l = table(spark, sf_dir, "labels")
    return l.select(
        F.concat(F.lit("C"), F.col("doc_id").cast("string")).alias("check_id"),
        F.col("doc_id").cast("string").alias("post_id"),
        F.when(F.col("toxic") == 1, "MISINFORMATION")
        .when(F.col("quality") == 1, "AUTHENTIC")
        .otherwise("UNCERTAIN")
        .alias("check_label"),
    )


def raw_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed raw topic: English documents as one platform, the rest as the other."""
    d = table(spark, sf_dir, "documents")
    key = F.col("doc_id").cast("string")
    first = d.where(F.col("lang") == "en").select(
        key.alias("tweet_id"),
        F.lit("").alias("translated_text"),
        F.when(F.col("n_chars") > 200, F.col("text")).alias("cleaned_text"),
        F.col("text").alias("raw_text"),
        F.lit("Fri Apr 11 13:57:55 +0000 2025").alias("tweet_created_at"),
        F.when(F.col("doc_id") % 3 == 0, "null").otherwise("Flood, #Help,").alias("tweet_hashtags"),
        F.concat(F.lit("Place "), F.col("source")).alias("location"),
        F.concat(F.lit("u"), key).alias("user_id"),
        F.lit("").alias("user_name"),
        F.lit("twitter").alias("platform"),
    )
    second = d.where(F.col("lang") != "en").select(
        key.alias("ig_post_id"),
        F.col("text").alias("description"),
        F.lit("2025-04-11T13:57:55Z").alias("created_at"),
        F.lit(None).cast("string").alias("hashtags"),
        F.concat(F.lit("Spot "), F.col("source")).alias("location_name"),
        F.col("lang").alias("city"),
        point(F.col("doc_id"))[0].alias("latitude"),
        point(F.col("doc_id"))[1].alias("longitude"),
        F.concat(F.lit("a"), key).alias("author_id"),
        F.concat(F.lit("name "), key).alias("author_username"),
        F.lit("instagram").alias("platform"),
    )
    return as_raw_topic(first).unionByName(as_raw_topic(second))


def subscribers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subscribers, one per customer, with one or two states each."""
    c = table(spark, sf_dir, "customer")
    n = len(SUBSCRIBER_STATES)
    one = pick(SUBSCRIBER_STATES, F.col("c_nationkey") % n)
    two = pick(SUBSCRIBER_STATES, (F.col("c_nationkey") + 7) % n)
    return c.select(
        F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@example.com")).alias(
            "email"
        ),
        F.array_distinct(F.array(one, two)).alias("locations"),
        F.lit(1000.0).alias("createdAt"),
        F.lit(1000.0).alias("updatedAt"),
        "c_acctbal",
        "c_mktsegment",
    )


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One outline per nation on a 5 x 5 grid: rectangles and triangles that overlap a little."""
    n = table(spark, sf_dir, "nation")
    key = F.col("n_nationkey").cast("bigint")
    x0 = F.lit(99.005) + (key % 5).cast("double") * 4.2
    y0 = F.lit(0.005) + F.floor(key / 5).cast("double") * 1.6
    x1, y1 = x0 + 4.5, y0 + 1.8

    def p(x: Column, y: Column) -> Column:
        return F.struct(x.alias("x"), y.alias("y"))

    ring = F.when(key % 2 == 0, F.array(p(x0, y0), p(x1, y0), p(x1, y1), p(x0, y1))).otherwise(
        F.array(p(x0, y0), p(x1, y0), p((x0 + x1) / 2, y1))
    )
    return n.select(
        key.alias("polygon_id"),
        pick([s for s, _ in PAIRS], key * 4).alias("state"),
        pick([d for _, d in PAIRS], key * 4).alias("district"),
        F.array(ring).alias("rings"),
    )


def located_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts before and after the place sweep, for predicates over its results."""
    d = table(spark, sf_dir, "documents")
    n = F.col("n_chars")
    lat, lon = point(F.col("doc_id"))
    return d.select(
        F.col("doc_id").cast("string").alias("postId"),
        F.col("text").alias("postText"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") * 60)
        .cast("timestamp_ntz")
        .alias("createdAt"),
        F.split(F.concat(F.col("lang"), F.lit(","), F.col("source")), ",").alias("hashtags"),
        F.when(n < 50, F.lit(None).cast("boolean")).when(n < 200, False).otherwise(True).alias(
            "geo_processed"
        ),
        F.when(
            n >= 100,
            F.struct(
                F.when(n % 7 == 0, "Unknown State").otherwise(F.col("lang")).alias("state"),
                F.col("source").alias("district"),
                lat.alias("lat"),
                lon.alias("lon"),
                ((n % 11).cast("double") / 10).alias("confidence_score"),
            ),
        ).alias("geo_data"),
        F.when(n % 3 == 0, "old topic").when(n % 3 == 1, "null").alias("keywords"),
        F.when(n % 5 == 0, True).alias("keywords_generated"),
    )


def incident_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incident labels, two runs for some posts, and posts that do not exist."""
    l = table(spark, sf_dir, "labels")
    once = l.select(
        F.col("doc_id").cast("string").alias("post_id"),
        F.when(F.col("quality") == 1, "flood").otherwise("storm").alias("classification_type"),
    )
    again = l.where(F.col("toxic") == 1).select(
        F.col("doc_id").cast("string").alias("post_id"),
        F.lit("earthquake").alias("classification_type"),
    )
    lost = l.where(F.col("quality") == 0).select(
        F.concat(F.lit("lost-"), F.col("doc_id").cast("string")).alias("post_id"),
        F.lit("haze").alias("classification_type"),
    )
    return once.unionByName(again).unionByName(lost)


def severity_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity checks: one per turn of a conversation, so posts have several."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.col("conv_id").cast("string").alias("post_id"),
        F.when(F.length("text") < 200, "Informational")
        .when(F.length("text") < 400, "Warning")
        .otherwise("Urgent")
        .alias("sentiment_label"),
        (F.col("turn").cast("double") / 10).alias("confidence_level"),
        F.col("role").alias("reasoning"),
    )

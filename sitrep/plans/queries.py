"""The registered queries: every operator over the test tables, whole."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitrep import constants as K
from sitrep.functions import dates, places, text
from sitrep.functions import predicates as P
from sitrep.operators import (
    alerts,
    assemble,
    consolidate,
    geo,
    ingest,
    labels,
    metrics,
    search,
    tables,
)
from sitrep.plans import proxies as X
from sitrep.skew import one_per_key
from sitrep.sources import dimensions

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

ALERT_NOW = "2001-10-28 12:00:00"
UNSUBSCRIBE = "https://alerts.example.org/unsubscribe"


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def _flat_events(events: DataFrame) -> DataFrame:
    at = F.col("geometry.coordinates")
    return events.select(
        "event_id",
        "classification_type",
        "location_district",
        "location_state",
        "start_time",
        "most_recent_report",
        F.get(at, 0).alias("lon"),
        F.get(at, 1).alias("lat"),
        "total_posts_count",
    )


# --- events ------------------------------------------------------------------------------
@query
def consolidate_events(spark, d):
    return _flat_events(consolidate.consolidate(X.posts(spark, d)))


@query
def consolidate_incremental(spark, d):
    """Slices of three parts of the posts, merged: what streams and batches do over time."""
    posts = X.posts(spark, d)
    part = F.pmod(F.xxhash64("post_id"), F.lit(3))
    parts = [
        consolidate.slices(
            consolidate.keyed_posts(one_per_key(posts.where(part == i), ["post_id"], ["start_time"]))
        )
        for i in range(3)
    ]
    merged = consolidate.merge_slices(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    return _flat_events(consolidate.events_from_slices(merged))


@query
def consolidate_hot_districts(spark, d):
    return _flat_events(consolidate.consolidate(X.hot_posts(spark, d)))


@query
def event_posts(spark, d):
    return consolidate.event_posts(X.posts(spark, d))


@query
def event_post_pages(spark, d):
    members = consolidate.event_posts(X.hot_posts(spark, d))
    return consolidate.event_post_pages(members, per_page=50).select(
        "event_id", "page", "pages", F.array_join("related_post_ids", ",").alias("ids")
    )


@query
def event_ids(spark, d):
    return X.posts(spark, d).select(
        "post_id",
        consolidate.event_id(
            F.col("disaster_type"),
            F.lower("location.district"),
            F.col("start_time"),
            F.col("post_id"),
        ).alias("event_id"),
    )


# --- metrics -----------------------------------------------------------------------------
@query
def type_counts(spark, d):
    return metrics.type_counts(X.events(spark, d))


@query
def district_ranking(spark, d):
    return metrics.district_ranking(X.events(spark, d))


@query
def district_ranking_consolidated(spark, d):
    return metrics.district_ranking(consolidate.consolidate(X.posts(spark, d)))


@query
def monthly_events(spark, d):
    return metrics.monthly_events(X.events(spark, d))


@query
def sentiment_counts_all(spark, d):
    return metrics.severity_counts(X.posts(spark, d))


@query
def sentiment_counts_filtered(spark, d):
    posts = metrics.posts_between(X.posts(spark, d), "2024-01-05", "2024-01-20", "flood")
    return metrics.severity_counts(posts, drop_missing=True)


@query
def dashboard_facets(spark, d):
    return metrics.dashboard(X.events(spark, d), X.posts(spark, d))


@query
def dashboard_facets_filtered(spark, d):
    return metrics.dashboard_between(
        X.events(spark, d), X.posts(spark, d), "1997-01-01", "2024-01-20"
    )


@query
def dashboard_document(spark, d):
    tidy = metrics.dashboard(X.events(spark, d), X.posts(spark, d))
    doc = metrics.dashboard_document(tidy, "2024-02-01 00:00:00")

    def listed(column: str, *fields: str) -> Column:
        def one(x: Column) -> Column:
            return F.concat_ws(":", *[F.coalesce(x[f].cast("string"), F.lit("-")) for f in fields])

        return F.array_join(F.transform(column, one), ",").alias(column)

    return doc.select(
        F.col("timestamp").cast("string").alias("timestamp"),
        listed("type_counts", "type", "frequency"),
        listed("district_ranking", "district", "event_count"),
        listed("monthly_events", "year", "month", "total_events"),
        listed("sentiment_counts", "label", "frequency"),
    )


@query
def trending_terms(spark, d):
    return metrics.trending_terms(X.posts(spark, d), "2024-01-03", "2024-01-25")


@query
def trending_hashtags(spark, d):
    return metrics.trending_terms(
        X.posts(spark, d), "2024-01-03", "2024-01-25", kind="flood", field="hashtags", size=5
    )


def _topics(spark, d) -> tuple[DataFrame, DataFrame]:
    part = X.table(spark, d, "part")
    posts = part.select(
        F.concat("p_name", F.lit("!")).alias("keywords"),
        (F.col("p_size") > 3).alias("keywords_generated"),
        F.concat(F.lit("#"), F.col("p_brand"), F.lit(", #"), F.col("p_type")).alias("hashtags"),
    )
    mapping = (
        part.where(F.col("p_name").startswith("red") | F.col("p_name").startswith("blue"))
        .select(
            F.col("p_name").alias("topic"),
            F.concat(F.lit("Group "), F.split("p_name", " ")[0]).alias("canonical"),
        )
        .distinct()
    )
    return posts, mapping


@query
def canonical_topic_counts(spark, d):
    return metrics.topic_counts(*_topics(spark, d))


@query
def hashtag_counts(spark, d):
    return metrics.hashtag_counts(X.posts(spark, d), as_list=None, as_text="hashtags")


@query
def tracking_terms(spark, d):
    posts, mapping = _topics(spark, d)
    return metrics.tracking_terms(
        metrics.topic_counts(posts, mapping),
        metrics.hashtag_counts(posts, as_list=None, as_text="hashtags"),
    )


@query
def top_keywords(spark, d):
    return metrics.top_keywords(tracking_terms(spark, d))


@query
def monthly_series_filled(spark, d):
    return metrics.monthly_series(metrics.monthly_events(X.events(spark, d)), 2001)


@query
def sentiment_series_filled(spark, d):
    posts = metrics.posts_between(X.posts(spark, d), "2024-01-01", "2024-01-02", "haze")
    return metrics.severity_series(metrics.severity_counts(posts, drop_missing=True))


@query
def type_cards_filled(spark, d):
    kept = metrics.events_between(X.events(spark, d), "2000-01-01", "2000-01-03")
    return metrics.type_cards(metrics.type_counts(kept))


@query
def empty_selection(spark, d):
    kept = metrics.events_between(X.events(spark, d), "2030-01-01", "2030-12-31")
    return metrics.is_empty_selection(metrics.type_counts(kept), metrics.monthly_events(kept))


@query
def month_summary(spark, d):
    october = X.events(spark, d).where(search.retrieval_filter(month="October 1998"))
    return metrics.month_summary(october)


@query
def share_of_max(spark, d):
    chart = metrics.share_of_max(metrics.district_ranking(X.events(spark, d)), "event_count")
    return chart.withColumn("share", F.round("share", 6))


@query
def display_labels(spark, d):
    ranked = metrics.display_labels(metrics.district_ranking(X.events(spark, d)), "district")
    tags = metrics.display_labels(
        metrics.district_ranking(X.events(spark, d)), "district", hashtag=True
    )
    return ranked.select("district", "label").unionByName(tags.select("district", "label"))


# --- filtered lists, retrieval, exports -----------------------------------------------------
@query
def events_in_date_range(spark, d):
    kept = metrics.events_between(X.events(spark, d), "1998-03-01", "1998-06-30")
    return kept.select("event_id", "most_recent_report")


@query
def events_filtered(spark, d):
    kept = search.events_filtered(X.events(spark, d), "1996-01-01", "1999-12-31", "forestFire")
    return _flat_events(kept)


@query
def events_filtered_by_state(spark, d):
    return _flat_events(search.events_filtered(X.events(spark, d), state="Johor"))


@query
def events_valid_geometry(spark, d):
    kept = X.events(spark, d).where(P.valid_coordinates(F.col("geometry.coordinates")))
    return kept.select("event_id")


@query
def events_filter_start_time(spark, d):
    kept = search.events_by_start(
        X.events(spark, d), "haze", "SELANGOR", "1997-01-01", "1999-06-30"
    )
    return kept.select("event_id", "start_time")


@query
def map_markers(spark, d):
    return search.map_markers(X.events(spark, d)).select("event_id")


@query
def events_by_ids(spark, d):
    line = X.table(spark, d, "lineitem")
    ids = line.where((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 49)).select(
        F.concat(F.lit("EV-"), F.col("l_orderkey").cast("string")).alias("event_id")
    )
    found = search.events_by_ids(X.events(spark, d), ids)
    return found.select("event_id", "start_time", "total_posts_count")


@query
def event_index_projection(spark, d):
    return search.index_projection(X.events(spark, d))


@query
def post_index_projection(spark, d):
    return search.post_index_projection(X.posts(spark, d))


@query
def search_posts(spark, d):
    found = search.search_posts(
        X.posts(spark, d),
        start="2024-01-02",
        end="2024-01-28",
        location=["nation_1", "nation_7", "district 44"],
        category="Flood",
        severity="warn",
        keyword="topic 1",
    )
    return found.select("post_id")


@query
def search_posts_by_pattern(spark, d):
    found = search.search_posts(
        X.posts(spark, d), keyword="report [0-9]*7 level", category="all", regex=True
    )
    return found.select("post_id")


@query
def export_flat_posts(spark, d):
    found = search.search_posts(X.posts(spark, d), start="2024-01-10", category="storm")
    return search.export_rows(search.newest_first(found, 500))


@query
def retrieve_events(spark, d):
    found = search.retrieve(
        X.events(spark, d), location="Jhor", kind="Flood", month="March 1998", year="1998"
    )
    return found.select("event_id", "start_time")


@query
def retrieve_latest(spark, d):
    found = search.retrieve(X.events(spark, d), latest=True, location="Malaysia", year="abc")
    return found.select("event_id", "start_time")


@query
def retrieve_day(spark, d):
    found = X.events(spark, d).where(search.retrieval_filter(day="1998-10-03"))
    return found.select("event_id", "start_time")


@query
def fuzzy_place_match(spark, d):
    near = places.fuzzy_place(
        [F.col("location_state"), F.col("location_district")], "selangr, kota tingi"
    )
    return X.events(spark, d).where(near).select("event_id", "location_state", "location_district")


@query
def date_presets(spark, d):
    return search.day_presets(X.posts(spark, d), "2024-01-24")


# --- text ------------------------------------------------------------------------------------
@query
def clean_text(spark, d):
    return X.docs(spark, d).select("post_id", text.clean_text(F.col("post_text")).alias("cleaned"))


@query
def clean_caption(spark, d):
    return X.docs(spark, d).select(
        "post_id", text.clean_caption(F.col("post_text")).alias("cleaned")
    )


@query
def clean_hashtags(spark, d):
    part = X.table(spark, d, "part")
    raw = F.concat(F.lit("#"), F.col("p_brand"), F.lit(", #"), F.col("p_name"), F.lit("!,,"))
    return part.select(
        "p_partkey", F.array_join(text.hashtag_list(raw), ", ").alias("hashtags")
    )


@query
def tokenize(spark, d):
    return X.docs(spark, d).select(
        "post_id", F.array_join(text.tokens(F.col("post_text")), " ").alias("tokens")
    )


@query
def normalise_terms(spark, d):
    return X.docs(spark, d).select(
        "post_id", text.normalise_terms(F.col("post_text")).alias("text")
    )


@query
def tidy_topics(spark, d):
    return X.docs(spark, d).select("post_id", text.tidy_topic(F.col("post_text")).alias("topic"))


@query
def format_place(spark, d):
    part = X.table(spark, d, "part")
    camel = F.replace(F.initcap("p_name"), F.lit(" "), F.lit(""))
    raw = F.when(F.col("p_size") <= 3, "Unknown District").otherwise(camel)
    return part.select("p_partkey", text.split_camel(raw).alias("place"))


@query
def canonical_state(spark, d):
    return X.events(spark, d).select(
        "event_id",
        places.canonical_state(F.col("location_state")).alias("state"),
        places.is_known_state(F.col("location_state")).alias("known"),
    )


@query
def parse_dates(spark, d):
    e = X.table(spark, d, "events")
    at = F.col("ts")
    written = (
        F.when(
            F.col("event_type") == "click", F.date_format(at, "EEE MMM dd HH:mm:ss '+0000' yyyy")
        )
        .when(F.col("event_type") == "view", F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .otherwise("garbage")
    )
    now = F.to_timestamp(F.lit("2024-06-01 00:00:00"))
    return e.select(
        "event_id", dates.parse_post_date(written, now).cast("timestamp_ntz").alias("parsed")
    )


@query
def epoch_to_ts(spark, d):
    e = X.table(spark, d, "events")
    written = F.when(F.col("event_type") == "error", "soon").otherwise(
        F.unix_seconds(F.col("ts").cast("timestamp")).cast("string")
    )
    return e.select(
        "event_id", dates.epoch_to_timestamp(written).cast("timestamp_ntz").alias("at")
    )


@query
def normalise_missing(spark, d):
    cols = ["classification_type", "location_state", "location_district"]
    return X.events(spark, d).select(
        "event_id", *[P.missing_to_null(F.col(c)).alias(c) for c in cols]
    )


# --- ingest -------------------------------------------------------------------------------------
@query
def parse_event_props(spark, d):
    parsed = ingest.parse_json(X.table(spark, d, "events"), "props", "k int")
    return parsed.select("event_id", F.col("data.k").alias("k"), "is_broken")


def _timeline(spark, d) -> DataFrame:
    """One timeline document per customer: the same post under both item lists."""
    c = X.table(spark, d, "customer")
    key = F.col("c_custkey").cast("string")
    place = X.pick([*K.PLACE_KEYWORDS, "nowhere", ""], F.col("c_custkey") % 30)
    user = F.struct(
        F.concat(F.lit("u"), key).alias("rest_id"),
        (F.col("c_acctbal") > 9000).alias("verified"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "Government").alias("verification_type"),
        F.struct(
            F.when(F.col("c_mktsegment") == "BUILDING", "Business").alias("professional_type")
        ).alias("professional"),
        F.struct(F.initcap(place).alias("location")).alias("location"),
        F.struct(
            F.col("c_name").alias("name"),
            F.lower("c_name").alias("screen_name"),
            F.lit("Ipoh").alias("location"),
            (F.col("c_acctbal") * 2).cast("int").alias("followers_count"),
        ).alias("legacy"),
    )
    post = F.struct(
        key.alias("rest_id"),
        F.struct(
            F.concat(F.lit("Flood @"), F.col("c_mktsegment"), F.lit(" http://x.y/"), key).alias(
                "full_text"
            ),
            F.lit("Fri Apr 11 13:57:55 +0000 2025").alias("created_at"),
            F.struct(
                F.when(
                    F.col("c_nationkey") > 5,
                    F.array(F.struct(F.lit("banjir").alias("text"))),
                ).alias("hashtags")
            ).alias("entities"),
        ).alias("legacy"),
        F.struct(F.struct(user.alias("result")).alias("user_results")).alias("core"),
    )
    kind = F.when(F.col("c_nationkey") == 3, "TimelineNotice").otherwise("TimelineTweet")
    item = F.struct(
        F.struct(
            F.struct(
                kind.alias("itemType"), F.struct(post.alias("result")).alias("tweet_results")
            ).alias("itemContent")
        ).alias("content")
    )
    both = F.struct(
        F.array(item).alias("entries"), F.array(item).alias("addEntries")
    )
    doc = F.struct(
        F.struct(F.struct(F.array(both).alias("instructions")).alias("timeline")).alias("result")
    )
    return c.select(F.to_json(doc).alias("value"))


@query
def ingest_timeline_feed(spark, d):
    rows = ingest.clean_timeline_posts(ingest.flatten_timeline(_timeline(spark, d)))
    return rows.select("tweet_id", "location", "tweet_hashtags", "cleaned_text")


def _items(spark, d) -> DataFrame:
    """One item document per customer: two items that are no objects, a valid and a null one."""
    c = X.table(spark, d, "customer")
    item = F.struct(
        F.col("c_custkey").cast("string").alias("id"),
        (F.lit(1_705_915_829) + F.col("c_custkey")).alias("taken_at"),
        F.struct(
            F.when(F.col("c_acctbal") > 0, F.concat(F.lit("Banjir!!! "), F.col("c_name"))).alias(
                "text"
            ),
            F.array(F.lit("#Banjir"), F.col("c_mktsegment")).alias("hashtags"),
        ).alias("caption"),
        F.struct((F.col("c_nationkey") % 3).cast("int").alias("account_type")).alias("user"),
        F.when(
            F.col("c_nationkey") > 4,
            F.struct(
                F.initcap(X.pick([*K.PLACE_NAMES, "elsewhere"], F.col("c_custkey") % 41)).alias(
                    "city"
                )
            ),
        ).alias("location"),
    )
    doc = F.struct(F.struct(F.array(item, F.lit(None)).alias("items")).alias("data"))
    odd = F.replace(F.to_json(doc), F.lit('"items":['), F.lit('"items":[5,"x",'))
    return c.select(odd.alias("value"))


@query
def ingest_rejects(spark, d):
    c = X.table(spark, d, "customer").where("c_custkey % 7 = 0")
    broken = c.select(F.concat(F.lit('{"data": '), F.col("c_custkey").cast("string")).alias("value"))
    return ingest.rejects(_items(spark, d).unionAll(broken))


@query
def ingest_item_feed(spark, d):
    rows = ingest.clean_item_posts(ingest.flatten_items(_items(spark, d)))
    return rows.select(
        "ig_post_id",
        F.col("created_at").cast("timestamp_ntz").alias("created_at"),
        "city",
        "cleaned_description",
        "cleaned_hashtags_str",
    )


@query
def unify_posts(spark, d):
    rows = ingest.unify(X.raw_topic(spark, d), processed_at=1000.0)
    return rows.withColumn("hashtags", F.array_join("hashtags", ","))


@query
def filter_place_mention(spark, d):
    kept = X.docs(spark, d).where(places.mentions_any(F.col("post_text")))
    return kept.select("post_id")


@query
def filter_any_place_column(spark, d):
    cols = [F.col("location_state"), F.col("location_district")]
    return X.events(spark, d).where(places.any_mentions(cols)).select("event_id")


@query
def filter_authority_accounts(spark, d):
    c = X.table(spark, d, "customer")
    kept = c.where(
        P.not_authority(
            F.col("c_acctbal") > 9000,
            F.when(F.col("c_mktsegment") == "MACHINERY", "Government").when(
                F.col("c_mktsegment") == "HOUSEHOLD", "null"
            ),
            F.when(F.col("c_mktsegment") == "BUILDING", "Creator"),
            (F.col("c_acctbal") * 2).cast("int"),
        )
    )
    return kept.select("c_custkey")


@query
def filter_null_safe_ne(spark, d):
    c = X.table(spark, d, "customer").withColumn(
        "account_type", F.nullif(F.col("c_nationkey") % 4, F.lit(3))
    )
    kept = c.where(P.not_equal_or_null(F.col("account_type"), K.PROFESSIONAL_ACCOUNT))
    return kept.select("c_custkey", "account_type")


@query
def drop_all_null(spark, d):
    rows = X.events(spark, d).withColumn("type", F.col("classification_type"))
    kept = ingest.drop_missing(
        rows, any_of=["type"], all_of=["location_state", "location_district", "last_alert_sent"]
    )
    return kept.select("event_id")


@query
def filter_min_text(spark, d):
    rows = X.table(spark, d, "documents")
    return rows.where(P.min_text(F.col("text"), 10)).select("doc_id")


@query
def filter_bounding_box(spark, d):
    rows = X.posts(spark, d).select(
        "post_id",
        F.get("location.lat_lon", 1).alias("lat"),
        F.get("location.lat_lon", 0).alias("lon"),
    )
    return rows.where(places.in_bounding_box(F.col("lat"), F.col("lon")))


@query
def authentic_posts(spark, d):
    return ingest.authentic(X.docs(spark, d), X.checks(spark, d), "post_id").select(
        "post_id", "check_id", "post_text"
    )


@query
def dedupe_first(spark, d):
    e = X.table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    return one_per_key(e, ["user_id"], ["ts", "event_id"])


# --- keyed tables -----------------------------------------------------------------------------
def _new_lines(spark, d) -> tuple[DataFrame, DataFrame]:
    line = X.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_suppkey"
    )
    known = X.table(spark, d, "orders").where(F.col("o_orderstatus") == "F").select("o_orderkey")
    return line, known


@query
def insert_if_absent(spark, d):
    line, known = _new_lines(spark, d)
    order = ["l_linenumber", "l_partkey", "l_suppkey"]
    return tables.absent_rows(line, known, ["o_orderkey"], order)


@query
def insert_counts(spark, d):
    return tables.insert_counts(*_new_lines(spark, d), ["o_orderkey"])


@query
def upsert_by_key(spark, d):
    c = X.table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    o = X.table(spark, d, "orders").select(
        (F.col("o_custkey") + 100).alias("c_custkey"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("c_acctbal"),
        F.col("o_orderdate").alias("last_order"),
        "o_orderkey",
    )
    latest = one_per_key(o, ["c_custkey"], ["last_order", "o_orderkey"], keep="last")
    return tables.upsert(c, latest.drop("o_orderkey"), ["c_custkey"])


@query
def subscription_upsert(spark, d):
    subs = X.subscribers(spark, d)
    target = subs.where(F.col("c_mktsegment") != "BUILDING").drop("c_acctbal", "c_mktsegment")
    requests = subs.where(F.col("c_mktsegment").isin("BUILDING", "HOUSEHOLD")).select(
        "email",
        F.when(F.col("c_acctbal") < 0, F.array().cast("array<string>"))
        .otherwise(F.array(F.lit("Perlis")))
        .alias("locations"),
    )
    # e-mails that ask validly have asked before; the later request counts
    earlier = requests.where(F.size("locations") > 0).select(
        "email", F.array(F.lit("Kedah")).alias("locations"), F.lit(1).alias("at")
    )
    asked = requests.withColumn("at", F.lit(2)).unionByName(earlier)
    out = tables.upsert_subscriptions(target, asked, now=2000.0, order_by=["at"])
    return out.withColumn("locations", F.array_join("locations", ","))


def _doomed(spark, d) -> tuple[DataFrame, DataFrame]:
    c = X.table(spark, d, "customer").select("c_custkey", "c_name")
    o = X.table(spark, d, "orders").where(F.col("o_orderstatus") == "P")
    return c, o.select((F.col("o_custkey") * 2).alias("c_custkey"))


@query
def delete_by_key(spark, d):
    return tables.delete_keys(*_doomed(spark, d), ["c_custkey"])


@query
def delete_report(spark, d):
    return tables.delete_report(*_doomed(spark, d), ["c_custkey"])


@query
def bulk_keyed_update(spark, d):
    topics = X.table(spark, d, "labels").select(
        F.col("doc_id").cast("string").alias("post_id"),
        F.when(F.col("toxic") == 1, "").otherwise(
            F.concat(F.lit("topic "), F.col("quality").cast("string"))
        ).alias("topic"),
    )
    updated = tables.set_topics(X.located_docs(spark, d), topics)
    return updated.select("postId", "keywords", "keywords_generated")


@query
def pending_posts(spark, d):
    return tables.pending(X.docs(spark, d), X.checks(spark, d), "post_id").select("post_id")


@query
def pending_batch(spark, d):
    waiting = tables.pending(X.docs(spark, d), X.checks(spark, d), "post_id").select("post_id")
    return tables.oldest_batch(waiting, "post_id", 100)


@query
def pending_geo(spark, d):
    return tables.needs_geo(X.located_docs(spark, d), K.GEO_MIN_CONFIDENCE).select("postId")


@query
def move_raw_geo(spark, d):
    lat, lon = F.col("geo_data.lat"), F.col("geo_data.lon")
    posts = X.located_docs(spark, d).where("geo_data is not null").select(
        "postId",
        F.col("geo_data.state").alias("state"),
        lat.alias("latitude"),
        lon.alias("longitude"),
        F.element_at("hashtags", 2).alias("location"),
        F.lit(None).cast("string").alias("address"),
        F.element_at("hashtags", 1).alias("city"),
    )
    moved = tables.move_raw_geo(posts)
    return moved.select("postId", "state", "raw_geo.longitude", "raw_geo.location", "raw_geo.address", "raw_geo.city")


@query
def stage_counts(spark, d):
    return tables.stage_counts(X.located_docs(spark, d))


@query
def assemble_posts(spark, d):
    rows = assemble.assemble(
        X.located_docs(spark, d),
        X.incident_labels(spark, d),
        X.severity_labels(spark, d),
        F.lit(None).cast("timestamp_ntz"),
    )
    return rows.select(
        "post_id",
        "disaster_type",
        "start_time",
        F.col("location.state").alias("state"),
        F.col("location.district").alias("district"),
        F.get("location.lat_lon", 0).alias("lon"),
        "post_text",
        "keywords",
        "hashtags",
        F.col("sentiment.label").alias("label"),
        F.col("sentiment.confidence").alias("confidence"),
    )


@query
def assembly_gaps(spark, d):
    return assemble.assembly_gaps(
        X.located_docs(spark, d), X.incident_labels(spark, d), X.severity_labels(spark, d)
    )


# --- places -------------------------------------------------------------------------------------
@query
def gazetteer_lookup(spark, d):
    found = geo.lookup_places(X.events(spark, d).select("event_id", "location_district"), "location_district")
    return found.select("event_id", "state", "district")


@query
def place_intent(spark, d):
    found = geo.with_place_intent(X.docs(spark, d), "post_text")
    return found.select(
        "post_id",
        F.col("intent.state").alias("state"),
        F.col("intent.district").alias("district"),
    )


@query
def query_matrix(spark, d):
    return dimensions.search_queries(X.table(spark, d, "nation"), "n_name")


@query
def point_in_polygon(spark, d):
    points = X.posts(spark, d).select(
        "post_id",
        F.get("location.lat_lon", 1).alias("lat"),
        F.get("location.lat_lon", 0).alias("lon"),
    )
    found = geo.locate_points(points, X.polygons(spark, d))
    return found.select(
        "post_id",
        F.col("gps.polygon_id").alias("polygon_id"),
        F.col("gps.state").alias("state"),
        F.col("gps.district").alias("district"),
    )


@query
def resolve_geo(spark, d):
    found = geo.resolve_geo(X.docs(spark, d), X.polygons(spark, d), "post_text")
    g = F.col("geo_data")
    return found.select(
        "post_id",
        g["state"].alias("state"),
        g["district"].alias("district"),
        F.round(g["lat"], 6).alias("lat"),
        F.round(g["lon"], 6).alias("lon"),
        g["is_malaysia"].alias("is_malaysia"),
        g["confidence_score"].alias("confidence_score"),
        g["inference"].alias("inference"),
    )


@query
def map_extent(spark, d):
    return geo.map_extent(X.events(spark, d))


@query
def marker_grid(spark, d):
    return geo.marker_grid(X.events(spark, d), cell=1.0)


# --- labels ----------------------------------------------------------------------------------------
@query
def label_incident(spark, d):
    return labels.label_incident(X.docs(spark, d), "post_text").select(
        "post_id", "classification_type", "confidence_score"
    )


@query
def label_severity(spark, d):
    return labels.label_severity(X.docs(spark, d), "post_text").select(
        "post_id", "sentiment_label", "confidence_level"
    )


@query
def label_authenticity(spark, d):
    return labels.label_authenticity(X.docs(spark, d), "post_text").select(
        "post_id", "check_label", "confidence"
    )


@query
def topic_phrase(spark, d):
    return labels.topic_phrase(X.docs(spark, d), "post_text").select("post_id", "topic")


@query
def canonical_topics(spark, d):
    part = X.table(spark, d, "part")
    words = F.split("p_name", " ")
    variants = part.select(
        F.explode(
            F.array(
                F.col("p_name"),
                F.concat(words[1], F.lit(" in "), words[0]),
                F.concat(words[0], F.lit(" "), words[1], F.lit(" Road")),
            )
        ).alias("topic")
    )
    return labels.canonical_topics(variants)


def shout_labeller(batch: pd.DataFrame) -> pd.DataFrame:
    """A sample labeller for the hook: posts with an exclamation mark are urgent."""
    loud = batch["post_text"].str.contains("!", regex=False)
    return pd.DataFrame(
        {
            "post_id": batch["post_id"],
            "label": loud.map({True: "Urgent", False: "Informational"}),
            "score": loud.map({True: 1.0, False: 0.5}),
        }
    )


@query
def label_hook(spark, d):
    out = T.StructType(
        [T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType())]
    )
    rows = X.docs(spark, d).select("post_id", "post_text")
    return labels.label_posts(rows, shout_labeller, out)


def choosy_labeller(batch: pd.DataFrame) -> pd.DataFrame:
    """Refuses some rows, with everything that comes beside them, and leaves others out."""
    ids = batch["post_id"].astype("int64")
    if (ids % 97 == 7).any():
        raise ValueError("refused")
    return shout_labeller(batch)[ids % 10 != 3]


@query
def label_hook_rejects(spark, d):
    out = T.StructType(
        [T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType())]
    )
    rows = X.docs(spark, d).select("post_id", "post_text")
    return labels.label_posts(rows, choosy_labeller, out)


def tone_labeller(batch: pd.DataFrame) -> pd.DataFrame:
    """A second sample labeller; it answers some rows with nothing."""
    length = batch["post_text"].str.len()
    tone = (length > 40).map({True: "long", False: "short"})
    out = pd.DataFrame({"post_id": batch["post_id"], "tone": tone})
    return out[batch["post_id"].astype("int64") % 13 != 5]


def refusing_labeller(batch: pd.DataFrame) -> pd.DataFrame:
    if (batch["post_id"].astype("int64") % 97 == 7).any():
        raise ValueError("refused")
    return shout_labeller(batch)


@query
def label_gather(spark, d):
    """Two labellers side by side: all labels of a post, or its error."""
    rows = X.docs(spark, d).select("post_id", "post_text").where("post_text is not null")
    kinds = {"shout": "label string, score double", "tone": "tone string"}
    asked = {"shout": refusing_labeller, "tone": tone_labeller}
    return labels.gather_labels(rows, {n: (asked[n], T.StructType.fromDDL(k)) for n, k in kinds.items()})


# --- alerts ------------------------------------------------------------------------------------------
@query
def alerts_due(spark, d):
    return alerts.alerts_due(X.events(spark, d), ALERT_NOW).select(
        "event_id", "location_state", "start_time"
    )


@query
def alert_recipients(spark, d):
    due = alerts.alerts_due(X.events(spark, d), ALERT_NOW)
    return alerts.alert_recipients(due, X.subscribers(spark, d)).select("event_id", "email")


@query
def alert_recipient_counts(spark, d):
    return alerts.recipient_counts(X.events(spark, d), X.subscribers(spark, d))


@query
def alert_outbox(spark, d):
    due = alerts.alerts_due(X.events(spark, d), ALERT_NOW)
    return alerts.outbox(due, X.subscribers(spark, d), UNSUBSCRIBE)


@query
def alert_marks(spark, d):
    events = X.events(spark, d)
    sent = alerts.recipient_counts(alerts.alerts_due(events, ALERT_NOW), X.subscribers(spark, d))
    marked = alerts.mark_sent(events, sent.where(F.col("emails") > 0), ALERT_NOW)
    return marked.select("event_id", "last_alert_sent")


@query
def alert_cooldown(spark, d):
    reports = X.table(spark, d, "events").select(
        F.col("event_type").alias("event_id"), F.col("ts").alias("reported_at")
    )
    sent = alerts.cooldown_alerts(reports, cooldown_minutes=60)
    return sent.withColumn("alert_at", F.col("alert_at").cast("timestamp_ntz"))


def _spots_and_places(spark, d) -> tuple[DataFrame, DataFrame]:
    posts = X.events(spark, d).select(
        F.concat_ws(", ", "location_district", "location_state").alias("location")
    )
    subs = X.table(spark, d, "customer").select(
        F.col("c_name").alias("email"),
        X.pick([*X.SUBSCRIBER_STATES, "Kota", "Pi", "shah alam"], F.col("c_custkey") % 17).alias(
            "place"
        ),
    )
    return posts, subs


@query
def substring_location_join(spark, d):
    posts, subs = _spots_and_places(spark, d)
    return alerts.subscribers_in_text(posts, "location", subs, "place")


@query
def substring_location_counts(spark, d):
    """Some subscribers list a second place, often inside the same texts as the first."""
    posts, subs = _spots_and_places(spark, d)
    more = X.table(spark, d, "customer").where(F.col("c_custkey") % 3 == 0).select(
        F.col("c_name").alias("email"),
        X.pick([*X.SUBSCRIBER_STATES, "Kota", "Pi", "shah alam"], F.col("c_custkey") % 5).alias("place"),
    )
    return alerts.subscriber_counts_in_text(posts, "location", subs.unionByName(more), "place")

"""Feed rows to clean posts: flattening, account and place filters, one unified schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitrep import constants as K
from sitrep import schemas
from sitrep.functions import dates, places, predicates, text
from sitrep.skew import one_per_key

IG_PLACE_FIELDS = [
    "city", "address", "latitude", "longitude", "location_name", "location_short_name",
]


# --- feeds -----------------------------------------------------------------------
def parse_json(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Adds ``data`` (typed) and ``is_broken``; broken rows keep their text for a reject table."""
    text_ok = F.try_parse_json(F.col(column)).isNotNull()
    return df.withColumn("data", F.from_json(F.col(column), schema)).withColumn(
        "is_broken", ~F.coalesce(text_ok, F.lit(False))
    )


def flatten_timeline(feed: DataFrame, column: str = "value") -> DataFrame:
    """Timeline documents (JSON text) to one flat row per post item."""
    doc = feed.select(F.from_json(F.col(column), schemas.TIMELINE_FEED).alias("d"))
    none = F.array()
    items = F.flatten(
        F.transform(
            F.col("d.result.timeline.instructions"),
            lambda i: F.concat(
                F.coalesce(i.entries, none.cast(f"array<{schemas.TIMELINE_ITEM}>")),
                F.coalesce(i.addEntries, none.cast(f"array<{schemas.TIMELINE_ITEM}>")),
            ),
        )
    )
    item = doc.select(F.explode(items).alias("i")).where(
        F.col("i.content.itemContent.itemType") == "TimelineTweet"
    )
    post = F.col("i.content.itemContent.tweet_results.result")
    user = post["core"]["user_results"]["result"]
    tags = F.transform(post["legacy"]["entities"]["hashtags"], lambda h: h["text"])
    return item.select(
        post["rest_id"].alias("tweet_id"),
        F.coalesce(post["legacy"]["full_text"], F.lit("")).alias("raw_text"),
        post["legacy"]["created_at"].alias("tweet_created_at"),
        F.nullif(F.array_join(tags, ","), F.lit("")).alias("tweet_hashtags"),
        F.coalesce(
            F.nullif(user["location"]["location"], F.lit("")), user["legacy"]["location"]
        ).alias("location"),
        user["rest_id"].alias("user_id"),
        user["legacy"]["name"].alias("user_name"),
        user["legacy"]["screen_name"].alias("user_screen_name"),
        F.coalesce(user["verified"], F.lit(False)).alias("verified"),
        user["verification_type"].alias("verification_type"),
        F.coalesce(user["legacy"]["followers_count"], F.lit(0)).alias("user_followers_count"),
        user["professional"]["professional_type"].alias("professional_type"),
        F.lit("twitter").alias("platform"),
    ).where(F.col("tweet_id").isNotNull() & (F.col("tweet_id") != ""))


def clean_timeline_posts(posts: DataFrame) -> DataFrame:
    """Ordinary accounts at a known place, cleaned, one row per post id."""
    kept = posts.where(
        places.mentions_any(F.col("location"), K.PLACE_KEYWORDS)
        & predicates.not_authority(
            F.col("verified"),
            F.col("verification_type"),
            F.col("professional_type"),
            F.col("user_followers_count"),
        )
    ).withColumn("cleaned_text", text.clean_text(F.col("raw_text")))
    return one_per_key(kept, ["tweet_id"], ["tweet_created_at", "raw_text"])


def _items_of(feed: DataFrame, column: str) -> DataFrame:
    """``text`` and ``is_object`` of every item, each taken from its document as it stands."""
    text_of = F.from_json(F.col(column), schemas.ITEM_LIST)["data"]["items"]
    item = feed.select(F.explode(text_of).alias("text")).where(F.col("text").isNotNull())
    return item.withColumn("is_object", F.coalesce(F.col("text").startswith("{"), F.lit(False)))


def flatten_items(feed: DataFrame, column: str = "value") -> DataFrame:
    """Item documents (JSON text) to one flat row per item.

    Items are parsed one by one, so one that is no object costs only itself.
    """
    objects = _items_of(feed, column).where("is_object")
    item = objects.select(F.from_json("text", schemas.ITEM).alias("i"))
    return item.select(
        F.col("i.id").alias("ig_post_id"),
        F.col("i.taken_at").alias("created_at"),
        F.col("i.caption.id").alias("caption_id"),
        F.col("i.caption.text").alias("description"),
        F.col("i.caption.did_report_as_spam").alias("reported_as_spam"),
        F.col("i.user.id").alias("author_id"),
        F.col("i.user.username").alias("author_username"),
        F.col("i.user.full_name").alias("author_full_name"),
        F.col("i.user.account_type").alias("account_type"),
        F.col("i.user.is_verified").alias("account_is_verified"),
        F.array_join("i.caption.hashtags", ", ").alias("hashtags"),
        F.col("i.gen_ai_detection_method.detection_method").alias("gen_ai_detection_method"),
        F.col("i.has_high_risk_gen_ai_inform_treatment").alias("high_risk_genai_flag"),
        F.col("i.integrity_review_decision").alias("integrity_review_decision"),
        F.col("i.location.address").alias("address"),
        F.col("i.location.city").alias("city"),
        F.col("i.location.lat").alias("latitude"),
        F.col("i.location.lng").alias("longitude"),
        F.col("i.location.name").alias("location_name"),
        F.col("i.location.short_name").alias("location_short_name"),
        F.lit("instagram").alias("platform"),
    )


def rejects(feed: DataFrame, column: str = "value") -> DataFrame:
    """``reason, text`` of what a feed's parsers pass over: documents that are no JSON, and items
    that are no objects."""
    whole = F.try_parse_json(F.col(column)).isNotNull()
    documents = feed.where(F.col(column).isNotNull() & ~whole).select(
        F.lit("document").alias("reason"), F.col(column).alias("text")
    )
    items = _items_of(feed, column).where("not is_object").select(F.lit("item").alias("reason"), "text")
    return documents.unionAll(items)


def clean_item_posts(posts: DataFrame) -> DataFrame:
    """Personal accounts with a text and a known place, cleaned, one row per post id."""
    kept = posts.where(
        predicates.not_equal_or_null(F.col("account_type"), K.PROFESSIONAL_ACCOUNT)
    )
    kept = drop_missing(kept, any_of=["description"], all_of=IG_PLACE_FIELDS)
    kept = one_per_key(kept, ["ig_post_id"], ["created_at", "description"])
    kept = kept.where(places.any_mentions([F.col(c) for c in IG_PLACE_FIELDS], K.PLACE_NAMES))
    tags = text.hashtag_list(F.col("hashtags"))
    lowered = {
        c: F.lower(F.col(c)) for c in ["city", "address", "location_name", "location_short_name"]
    }
    return kept.withColumns(
        {
            "created_at": dates.epoch_to_timestamp(F.col("created_at")),
            "cleaned_description": text.clean_caption(F.col("description")),
            "cleaned_hashtags": tags,
            "cleaned_hashtags_str": F.array_join(tags, ", "),
            **lowered,
        }
    )


def drop_missing(df: DataFrame, any_of: list[str], all_of: list[str]) -> DataFrame:
    """Drop rows with a null in ``any_of``, or with only nulls in ``all_of``."""
    return df.na.drop(subset=any_of).na.drop(how="all", subset=all_of)


# --- one schema for both platforms --------------------------------------------------
def _hashtags(c: Column) -> Column:
    filled = predicates.missing_to_null(c)
    parts = F.transform(F.split(filled, ","), lambda t: F.trim(t))
    return F.coalesce(F.filter(parts, lambda t: t != ""), F.array().cast("array<string>"))


def unify(raw: DataFrame, processed_at: float | Column) -> DataFrame:
    """Rows of the mixed raw topic, from either platform, in the unified post schema."""
    c = F.col
    platform = c("platform")
    return raw.select(
        predicates.first_filled(c("tweet_id"), c("ig_post_id")).alias("postId"),
        predicates.first_filled(
            c("translated_text"),
            c("cleaned_text"),
            c("cleaned_description"),
            c("description"),
            c("raw_text"),
        ).alias("postText"),
        predicates.first_filled(c("tweet_created_at"), c("created_at")).alias("createdAt"),
        _hashtags(predicates.first_filled(c("tweet_hashtags"), c("hashtags"))).alias("hashtags"),
        F.coalesce(
            predicates.first_filled(c("location"), c("location_name")), F.lit("")
        ).alias("location"),
        c("address"),
        c("city"),
        c("latitude"),
        c("longitude"),
        predicates.first_filled(c("user_id"), c("author_id")).alias("author_id"),
        F.coalesce(
            predicates.first_filled(c("user_name"), c("author_username")), F.lit("")
        ).alias("author_name"),
        (F.lit(processed_at) if not isinstance(processed_at, Column) else processed_at)
        .cast("double")
        .alias("processedAt"),
        F.when(platform.isNull() | (platform == ""), "Unknown")
        .otherwise(
            F.concat(F.upper(F.substring(platform, 1, 1)), F.lower(F.substr(platform, F.lit(2))))
        )
        .alias("source"),
    )


def as_raw_topic(df: DataFrame) -> DataFrame:
    """Any platform's rows in the columns of the raw topic; absent ones are null."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schemas.struct(schemas.RAW_TOPIC).fields
        ]
    )


def authentic(posts: DataFrame, checks: DataFrame, key: str) -> DataFrame:
    """Posts whose check says AUTHENTIC. The label filter runs before the join."""
    passed = checks.where(F.col("check_label") == "AUTHENTIC")
    return posts.join(passed, key, "inner")

"""One fixed schema per table and feed."""

from __future__ import annotations

import functools

from pyspark.sql import types as T


@functools.cache
def struct(ddl: str) -> T.StructType:
    """The parsed form of a schema below; needs a running session."""
    return T.StructType.fromDDL(ddl)


# --- feeds ----------------------------------------------------------------------
TIMELINE_ITEM = """struct<content: struct<itemContent: struct<
    itemType: string,
    tweet_results: struct<result: struct<
        rest_id: string,
        legacy: struct<full_text: string, created_at: string,
            entities: struct<hashtags: array<struct<text: string>>>>,
        core: struct<user_results: struct<result: struct<
            rest_id: string, verified: boolean, verification_type: string,
            professional: struct<professional_type: string>,
            location: struct<location: string>,
            legacy: struct<name: string, screen_name: string, location: string,
                followers_count: int>>>>>>>>>"""

TIMELINE_FEED = f"""struct<result: struct<timeline: struct<instructions: array<struct<
    entries: array<{TIMELINE_ITEM}>,
    addEntries: array<{TIMELINE_ITEM}>>>>>>"""

ITEM = """struct<
    id: string, taken_at: string,
    caption: struct<id: string, text: string, hashtags: array<string>, did_report_as_spam: boolean>,
    user: struct<id: string, username: string, full_name: string, account_type: int, is_verified: boolean>,
    location: struct<name: string, short_name: string, address: string, city: string, lat: double, lng: double>,
    gen_ai_detection_method: struct<detection_method: string>,
    has_high_risk_gen_ai_inform_treatment: boolean,
    integrity_review_decision: string>"""
ITEM_FEED = f"struct<data: struct<items: array<{ITEM}>>>"
# items as their JSON text
ITEM_LIST = "struct<data: struct<items: array<string>>>"

# --- topics ---------------------------------------------------------------------
RAW_TOPIC = (
    "tweet_id string, ig_post_id string, raw_text string, cleaned_text string, "
    "translated_text string, description string, cleaned_description string, "
    "tweet_created_at string, created_at string, tweet_hashtags string, hashtags string, "
    "location string, location_name string, address string, city string, "
    "latitude double, longitude double, user_id string, author_id string, user_name string, "
    "author_username string, platform string"
)

POSTS = (
    "postId string, postText string, createdAt string, hashtags array<string>, "
    "location string, address string, city string, latitude double, longitude double, "
    "author_id string, author_name string, processedAt double, source string"
)

DISASTER_POSTS = (
    "post_id string, classification_status string, disaster_type string, start_time timestamp, "
    "location struct<state: string, district: string, lat_lon: array<double>>, "
    "post_text string, keywords string, hashtags string, "
    "sentiment struct<label: string, confidence: double, reasoning: string>"
)

SUBSCRIBERS = (
    "email string, locations array<string>, createdAt double, updatedAt double"
)

POLYGONS = (
    "polygon_id bigint, state string, district string, "
    "rings array<array<struct<x: double, y: double>>>"
)

GEOJSON = (
    "features array<struct<properties: struct<NAME_1: string, NAME_2: string>, "
    "geometry: struct<type: string, coordinates: string>>>"
)

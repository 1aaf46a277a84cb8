"""Filtered lists, retrieval and exports."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitrep import constants as K
from sitrep.functions import dates, places
from sitrep.functions import predicates as P


# --- events --------------------------------------------------------------------------
def events_filtered(
    events: DataFrame,
    start: date | str | None = None,
    end: date | str | None = None,
    kind: str | None = None,
    state: str | None = None,
) -> DataFrame:
    """Events for the map: date range on the latest report, type, state, known place, usable
    coordinates. A state also limits the district to the districts listed for it."""
    district_ok = P.not_in_and_present(F.col("location_district"), K.UNKNOWN_TERMS)
    if state:
        place = (F.col("location_state") == state.lower()) & ~F.col("location_state").isin(
            K.UNKNOWN_TERMS
        )
        listed = K.STATE_DISTRICTS.get(state.lower())
        if listed:
            place = place & F.col("location_district").isin(listed) & district_ok
    else:
        # an event without a place is not a valid response row, so null is excluded as well
        place = P.not_in_and_present(F.col("location_state"), K.UNKNOWN_TERMS) & district_ok
    return events.where(
        P.all_of(
            [
                P.in_days(F.col("most_recent_report"), start, end),
                P.type_is(F.col("classification_type"), kind),
                place,
                P.valid_coordinates(F.col("geometry.coordinates")),
            ]
        )
    )


def events_by_start(
    events: DataFrame,
    kind: str | None = None,
    state: str | None = None,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Client-side list filter: exact type, state in any case, start time in the range."""
    return events.where(
        P.all_of(
            [
                (F.col("classification_type") == kind) if kind else None,
                (F.lower("location_state") == state.lower()) if state else None,
                P.in_days(F.col("start_time"), start, end),
            ]
        )
    )


def map_markers(events: DataFrame) -> DataFrame:
    """Events worth a marker: a real type at a known place."""
    kind, district, state = (
        F.lower(c) for c in ("classification_type", "location_district", "location_state")
    )
    return events.where(
        P.not_in_and_present(kind, ["none", ""])
        & P.not_in_and_present(district, ["unknown district", ""])
        & P.not_in_and_present(state, ["unknown state", ""])
    )


def events_by_ids(events: DataFrame, ids: DataFrame) -> DataFrame:
    """Events of an id list, with ISO time. No order is promised, so none is computed."""
    return events.join(ids.select("event_id").distinct(), "event_id", "left_semi").withColumn(
        "start_time", dates.iso_string(F.col("start_time"))
    )


def index_projection(events: DataFrame) -> DataFrame:
    """Flat event rows for the search index."""
    return events.select(
        "event_id",
        "classification_type",
        "location_district",
        "location_state",
        dates.iso_string(F.col("start_time")).alias("start_time"),
        F.try_element_at("geometry.coordinates", F.lit(1)).alias("lon"),
        F.try_element_at("geometry.coordinates", F.lit(2)).alias("lat"),
        "total_posts_count",
    )


def post_index_projection(posts: DataFrame) -> DataFrame:
    return posts.select(
        "post_id",
        "disaster_type",
        "post_text",
        F.col("location.state").alias("location_state"),
        F.col("location.district").alias("location_district"),
        dates.iso_string(F.col("start_time")).alias("start_time"),
        F.col("sentiment.label").alias("sentiment"),
    )


# --- retrieval ------------------------------------------------------------------------
def retrieval_filter(
    location: str | None = None,
    kind: str | None = None,
    month: str | None = None,
    year: str | int | None = None,
    day: str | None = None,
) -> Column:
    """Place (fuzzy), type, month of any year, year, exact day; all optional, all required."""
    at = F.col("start_time")
    month_no = dates.month_number(month)
    try:
        year_no = int(year) if year else None
    except ValueError:
        year_no = None
    return P.all_of(
        [
            places.fuzzy_place([F.col("location_state"), F.col("location_district")], location),
            (F.col("classification_type") == kind.lower()) if kind else None,
            (F.month(at) == month_no) if month_no else None,
            P.in_days(at, f"{year_no:04d}-01-01", f"{year_no:04d}-12-31") if year_no else None,
            P.in_days(at, day, day) if day else None,
        ]
    )


def retrieve(events: DataFrame, latest: bool = False, **criteria) -> DataFrame:
    """Newest matching events: one when ``latest``, else the first fifty."""
    return (
        events.where(retrieval_filter(**criteria))
        .orderBy(F.desc("start_time"), "event_id")
        .limit(1 if latest else K.RETRIEVAL_SIZE)
    )


# --- posts ----------------------------------------------------------------------------
def search_posts(
    posts: DataFrame,
    start: date | str | None = None,
    end: date | str | None = None,
    location: str | list[str] | None = None,
    category: str | None = None,
    severity: str | None = None,
    keyword: str | None = None,
    regex: bool = False,
) -> DataFrame:
    """Posts by any combination of date, place, category, severity and keyword."""
    severity_term = None if not severity or severity.lower() == "all" else severity
    return posts.where(
        P.all_of(
            [
                P.in_days(F.col("start_time"), start, end),
                P.any_text_matches(
                    [F.col("location.state"), F.col("location.district")], location, regex
                ),
                P.type_is(F.lower("disaster_type"), category),
                P.any_text_matches([F.col("sentiment.label")], severity_term, regex),
                P.any_text_matches([F.col("post_text"), F.col("keywords")], keyword, regex),
            ]
        )
    )


def export_rows(posts: DataFrame) -> DataFrame:
    """Posts flattened to the thirteen export columns plus the id."""
    blank = F.lit("")
    has_pair = F.size("location.lat_lon") >= 2
    return posts.select(
        F.col("post_id").alias("id"),
        F.coalesce("post_id", blank).alias("post_id"),
        F.coalesce("classification_status", blank).alias("status"),
        F.coalesce("disaster_type", F.lit("none")).alias("disaster_type"),
        F.coalesce(dates.iso_string(F.col("start_time")), blank).alias("start_time"),
        F.coalesce("post_text", blank).alias("post_text"),
        F.coalesce("location.state", blank).alias("state"),
        F.coalesce("location.district", blank).alias("district"),
        F.when(has_pair, F.try_element_at("location.lat_lon", F.lit(1))).alias("longitude"),
        F.when(has_pair, F.try_element_at("location.lat_lon", F.lit(2))).alias("latitude"),
        F.coalesce("sentiment.label", blank).alias("sentiment_label"),
        F.col("sentiment.confidence").alias("sentiment_confidence"),
        F.coalesce("sentiment.reasoning", blank).alias("sentiment_reasoning"),
        F.coalesce("keywords", blank).alias("keywords"),
    )


def newest_first(posts: DataFrame, size: int | None = None) -> DataFrame:
    """Newest posts first; a positive size keeps that many."""
    ordered = posts.orderBy(F.desc("start_time"), "post_id")
    return ordered.limit(size) if size and size > 0 else ordered


def day_presets(events: DataFrame, today: str) -> DataFrame:
    """Events per calendar preset: five conditional counts in one pass."""
    day = F.to_date(F.lit(today))
    at = F.col("start_time")
    counts, spans = [], []
    for preset in dates.PRESETS:
        first, last = dates.preset_range(preset, day)
        counts.append(
            F.count_if((at >= first) & (at < F.date_add(last, 1))).alias(preset.replace("-", "_"))
        )
        spans.append((preset, first, last))
    totals = events.agg(*counts)
    return totals.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(p).alias("preset"),
                        first.alias("first_day"),
                        last.alias("last_day"),
                        F.col(p.replace("-", "_")).alias("event_count"),
                    )
                    for p, first, last in spans
                ]
            )
        ).alias("r")
    ).select("r.*")

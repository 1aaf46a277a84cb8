"""Dashboard figures over events and posts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitrep import constants as K
from sitrep.functions import predicates as P
from sitrep.functions import text


# --- single figures -------------------------------------------------------------------
def type_counts(events: DataFrame) -> DataFrame:
    """Events per type. 'none' is left out, a missing type is a group of its own."""
    kept = events.where(P.not_equal_or_null(F.col("classification_type"), K.NO_INCIDENT))
    return kept.groupBy(F.col("classification_type").alias("type")).agg(
        F.count("*").alias("frequency")
    )


def district_ranking(
    events: DataFrame, size: int = K.RANKING_SIZE, unknown: list[str] = K.RANKING_UNKNOWN
) -> DataFrame:
    """Districts with most events; ties go to the name that sorts first."""
    kept = events.where(P.not_in_and_present(F.col("location_district"), unknown))
    return (
        kept.groupBy(F.col("location_district").alias("district"))
        .agg(F.count("*").alias("event_count"))
        .orderBy(F.desc("event_count"), "district")
        .limit(size)
    )


def monthly_events(events: DataFrame) -> DataFrame:
    return events.groupBy(
        F.year("start_time").alias("year"), F.month("start_time").alias("month")
    ).agg(F.count("*").alias("total_events"))


def severity_counts(posts: DataFrame, drop_missing: bool = False) -> DataFrame:
    """Posts per severity. All-time figures keep the group without severity, filtered ones
    drop posts without one."""
    kept = posts.where(F.col("sentiment").isNotNull()) if drop_missing else posts
    return kept.groupBy(F.col("sentiment.label").alias("label")).agg(
        F.count("*").alias("frequency")
    )


def posts_between(posts: DataFrame, start: date, end: date, kind: str | None = None) -> DataFrame:
    return posts.where(
        P.all_of(
            [P.in_days(F.col("start_time"), start, end), P.type_is(F.col("disaster_type"), kind)]
        )
    )


def events_between(events: DataFrame, start: date, end: date, kind: str | None = None) -> DataFrame:
    return events.where(
        P.all_of(
            [
                P.in_days(F.col("most_recent_report"), start, end),
                P.type_is(F.col("classification_type"), kind),
            ]
        )
    )


# --- several figures of one input -------------------------------------------------------
FACET_COLUMNS = ["facet", "key", "year", "month", "frequency"]


def _facets(events: DataFrame, typed: Column, ranked: Column) -> DataFrame:
    """Type counts, top districts and months out of one scan.

    The events are first counted by (type, district, year, month): one pass, reduced in each
    task before the shuffle. The three figures are then sums over that small table, whose
    shuffle is shared. The conditions sit inside the sums to keep it shareable.
    """
    base = events.groupBy(
        "classification_type",
        "location_district",
        F.year("start_time").alias("year"),
        F.month("start_time").alias("month"),
    ).agg(F.count("*").alias("n"))
    none_s, none_i = F.lit(None).cast("string"), F.lit(None).cast("int")
    by_type = (
        base.groupBy("classification_type")
        .agg(F.sum(F.when(typed, F.col("n"))).alias("frequency"))
        .where(F.col("frequency").isNotNull())
        .select(
            F.lit("type_counts").alias("facet"),
            F.col("classification_type").alias("key"),
            none_i.alias("year"),
            none_i.alias("month"),
            "frequency",
        )
    )
    by_district = (
        base.groupBy("location_district")
        .agg(F.sum(F.when(ranked, F.col("n"))).alias("frequency"))
        .where(F.col("frequency").isNotNull())
        .orderBy(F.desc("frequency"), "location_district")
        .limit(K.RANKING_SIZE)
        .select(
            F.lit("district_ranking").alias("facet"),
            F.col("location_district").alias("key"),
            none_i.alias("year"),
            none_i.alias("month"),
            "frequency",
        )
    )
    by_month = (
        base.groupBy("year", "month")
        .agg(F.sum("n").alias("frequency"))
        .select(
            F.lit("monthly_events").alias("facet"), none_s.alias("key"), "year", "month", "frequency"
        )
    )
    return by_type.unionByName(by_district).unionByName(by_month)


def _with_severity(facets: DataFrame, severity: DataFrame) -> DataFrame:
    none_i = F.lit(None).cast("int")
    rows = severity.select(
        F.lit("sentiment_counts").alias("facet"),
        F.col("label").alias("key"),
        none_i.alias("year"),
        none_i.alias("month"),
        "frequency",
    )
    return facets.unionByName(rows)


def dashboard(events: DataFrame, posts: DataFrame) -> DataFrame:
    """All-time figures in tidy rows. Unknown districts and 'none' count nowhere."""
    kept = events.where(
        P.not_in_and_present(F.col("location_district"), K.RANKING_UNKNOWN)
        & P.not_equal_or_null(F.col("classification_type"), K.NO_INCIDENT)
    )
    return _with_severity(_facets(kept, F.lit(True), F.lit(True)), severity_counts(posts))


def dashboard_between(
    events: DataFrame, posts: DataFrame, start: date, end: date, kind: str | None = None
) -> DataFrame:
    """The figures of a date range and optional type; each has its own exclusions."""
    facets = _facets(
        events_between(events, start, end, kind),
        P.not_equal_or_null(F.col("classification_type"), K.NO_INCIDENT),
        P.not_in_and_present(F.col("location_district"), K.FILTERED_RANKING_UNKNOWN),
    )
    return _with_severity(
        facets, severity_counts(posts_between(posts, start, end, kind), drop_missing=True)
    )


def dashboard_document(tidy: DataFrame, now: str) -> DataFrame:
    """The tidy rows as one nested row, ready to replace the stored document.

    Arrays are short: incident types, five districts, months, severities.
    """
    def rows(facet: str, *fields: Column) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("facet") == facet, F.struct(*fields))))

    n = F.col("frequency")
    return tidy.agg(
        F.to_timestamp(F.lit(now)).alias("timestamp"),
        rows("type_counts", F.col("key").alias("type"), n).alias("type_counts"),
        rows("district_ranking", F.col("key").alias("district"), n.alias("event_count")).alias(
            "district_ranking"
        ),
        rows("monthly_events", F.col("year"), F.col("month"), n.alias("total_events")).alias(
            "monthly_events"
        ),
        rows("sentiment_counts", F.col("key").alias("label"), n).alias("sentiment_counts"),
    )


# --- terms ------------------------------------------------------------------------------
def trending_terms(
    posts: DataFrame,
    start: date | str,
    end: date | str,
    kind: str | None = None,
    field: str = "keywords",
    size: int = 10,
) -> DataFrame:
    """Most used keywords or hashtags of a date range."""
    if str(start) > str(end):
        raise ValueError("start cannot be after end")
    kept = posts.where(
        P.all_of(
            [
                P.in_days(F.col("start_time"), start, end),
                P.type_is(F.col("disaster_type"), kind),
                P.not_in_and_present(F.col(field), K.NO_TERM),
            ]
        )
    )
    term = text.strip_space(F.lower(F.col("token")))
    return (
        kept.select(F.explode(F.split(field, ",")).alias("token"))
        .select(term.alias("keyword"))
        .where(F.col("keyword") != "")
        .groupBy("keyword")
        .agg(F.count("*").alias("frequency"))
        .orderBy(F.desc("frequency"), "keyword")
        .limit(size)
    )


def topic_counts(posts: DataFrame, mapping: DataFrame) -> DataFrame:
    """Posts per canonical topic; topics without a mapping stand for themselves.

    Topics are counted before they are mapped, so the join sees each topic once.
    """
    topics = (
        posts.where(F.col("keywords_generated"))
        .select(text.tidy_topic(F.col("keywords")).alias("topic"))
        .where(F.col("topic") != "")
        .groupBy("topic")
        .agg(F.count("*").alias("_n"))
    )
    return (
        topics.join(mapping.select("topic", "canonical"), "topic", "left")
        .groupBy(F.coalesce("canonical", "topic").alias("term"))
        .agg(F.sum("_n").alias("frequency"))
    )


def hashtag_counts(posts: DataFrame, as_list: str | None, as_text: str | None) -> DataFrame:
    """Posts per hashtag, from a list column, a comma-joined column, or both."""
    sources = []
    if as_list:
        sources.append(F.col(as_list))
    if as_text:
        filled = F.when(~F.col(as_text).isin("null", ""), F.col(as_text))
        sources.append(F.split(filled, ","))
    tag = F.regexp_replace(text.strip_space(F.lower(F.col("tag"))), "#", "")
    return (
        posts.select(F.explode(F.coalesce(*sources)).alias("tag"))
        .select(tag.alias("term"))
        .where(F.col("term") != "")
        .groupBy("term")
        .agg(F.count("*").alias("frequency"))
    )


def tracking_terms(keywords: DataFrame, hashtags: DataFrame) -> DataFrame:
    """Both counts in one table with a type tag; hashtags get their '#' back."""
    words = keywords.select("term", F.lit("keyword").alias("type"), "frequency")
    tags = hashtags.select(
        F.concat(F.lit("#"), "term").alias("term"), F.lit("hashtag").alias("type"), "frequency"
    )
    return words.unionByName(tags)


def top_keywords(tracking: DataFrame, size: int = 10) -> DataFrame:
    return (
        tracking.where(F.col("type") == "keyword")
        .select(F.col("term").alias("keyword"), "frequency")
        .orderBy(F.desc("frequency"), "keyword")
        .limit(size)
    )


# --- chart series -------------------------------------------------------------------------
def _spine(df: DataFrame, name: str, values: list) -> DataFrame:
    spark = df.sparkSession
    return spark.range(1).select(
        F.posexplode(F.array(*[F.lit(v) for v in values])).alias("position", name)
    )


def monthly_series(months: DataFrame, year: int) -> DataFrame:
    """Twelve months of one year, zero where nothing happened."""
    wanted = months.where(F.col("year") == year).select("month", "total_events")
    return (
        _spine(months, "month", list(range(1, 13)))
        .join(wanted, "month", "left")
        .select("month", F.coalesce("total_events", F.lit(0)).cast("bigint").alias("value"))
    )


def severity_series(counts: DataFrame) -> DataFrame:
    """The three severities in fixed order, zero where absent."""
    return (
        _spine(counts, "label", K.SEVERITIES)
        .join(counts, "label", "left")
        .select(
            "position",
            F.lower("label").alias("name"),
            F.coalesce("frequency", F.lit(0)).cast("bigint").alias("value"),
        )
    )


def type_cards(counts: DataFrame) -> DataFrame:
    """One card per incident type, zero where absent."""
    return (
        _spine(counts, "type", K.INCIDENT_TYPES)
        .join(counts, "type", "left")
        .select("type", F.coalesce("frequency", F.lit(0)).cast("bigint").alias("value"))
    )


def is_empty_selection(counts: DataFrame, months: DataFrame) -> DataFrame:
    """One row: neither types nor months to show."""
    tagged = counts.select(F.lit(1).alias("x")).unionByName(months.select(F.lit(1).alias("x")))
    return tagged.agg((F.count("*") == 0).alias("is_empty"))


def share_of_max(chart: DataFrame, value: str) -> DataFrame:
    """Bar width in percent of the largest bar. For results of a few rows, such as a top-k."""
    top = F.max(value).over(Window.partitionBy())
    return chart.withColumn(
        "share", F.when(top > 0, F.col(value) / top * 100).otherwise(F.lit(0.0))
    )


def month_summary(events: DataFrame) -> DataFrame:
    """Events by type and place, for a selection made by ``search.retrieval_filter``."""
    return events.groupBy("classification_type", "location_state").agg(
        F.count("*").alias("event_count")
    )


def display_labels(chart: DataFrame, column: str, hashtag: bool = False) -> DataFrame:
    label = text.hashtag_label(F.col(column)) if hashtag else text.title_label(F.col(column))
    return chart.withColumn("label", label)

"""The batch run: landed feeds to posts, labels, disaster posts, events and figures.

Stages meet at written tables. A stage that fails is reported and the next ones still run on
the tables that exist. Each table is read back from storage, never recomputed.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sitrep import constants as K
from sitrep import schemas
from sitrep.functions import text
from sitrep.operators import (
    assemble,
    consolidate,
    enrich,
    geo,
    ingest,
    labels,
    metrics,
    search,
    tables,
)
from sitrep.skew import one_per_key
from sitrep.sources.tables import BatchLog, VersionedTable

log = logging.getLogger(__name__)

CHECKED = schemas.RAW_TOPIC + ", check_label string, confidence double"
INCIDENTS = "post_id string, classification_type string, confidence_score double"
SEVERITIES = (
    "post_id string, sentiment_label string, confidence_level double, reasoning string"
)
TOPICS = "post_id string, topic string"
GEO = (
    "post_id string, geo_data struct<state: string, district: string, lat: double, lon: double, "
    "is_malaysia: boolean, confidence_score: double, inference: string>"
)
PENDING = schemas.POSTS + ", keywords string, attempts int, last_processed_at timestamp"
TRIED = PENDING + GEO.removeprefix("post_id string") + ", geo_processed boolean"
FOUND = GEO + (
    ", geo_processed boolean, attempts int, last_processed_at timestamp, "
    "raw_geo struct<latitude: double, longitude: double, location: string, address: string, city: string>"
)
EVENTS = (
    "event_id string, classification_type string, location_district string, "
    "location_state string, start_time timestamp, most_recent_report timestamp, "
    "geometry struct<type: string, coordinates: array<double>>, total_posts_count bigint"
)
MEMBERS = "event_id string, post_id string"
TERMS = "term string, type string, frequency bigint, updated_at timestamp"
FIGURES = "facet string, key string, year int, month int, frequency bigint"
DOCUMENT = (
    "timestamp timestamp, type_counts array<struct<type: string, frequency: bigint>>, "
    "district_ranking array<struct<district: string, event_count: bigint>>, "
    "monthly_events array<struct<year: int, month: int, total_events: bigint>>, "
    "sentiment_counts array<struct<label: string, frequency: bigint>>, updated_at timestamp"
)
REJECTED = "stage string, reason string, text string"
EVENT_INDEX = (
    "event_id string, classification_type string, location_district string, location_state string, "
    "start_time string, lon double, lat double, total_posts_count bigint"
)
POST_INDEX = (
    "post_id string, disaster_type string, post_text string, location_state string, "
    "location_district string, start_time string, sentiment string"
)
REPORT = "stage string, status string, processed bigint, inserted bigint, skipped bigint, message string"


@dataclass
class Batch:
    """One run over a shared folder."""

    spark: SparkSession
    root: str
    polygons: DataFrame
    now: str
    number: int = 0

    def table(self, name: str, ddl: str) -> VersionedTable:
        """A derived table, replaced by each run."""
        return VersionedTable(self.spark, f"{self.root}/{name}", schemas.struct(ddl))

    def log(self, name: str, ddl: str) -> BatchLog:
        """A table each run only appends to, in a folder of its own."""
        return BatchLog(self.spark, f"{self.root}/{name}", schemas.struct(ddl))

    @property
    def posts(self) -> BatchLog:
        return self.log("posts", schemas.POSTS)

    @property
    def disaster_posts(self) -> BatchLog:
        return self.log("disaster_posts", schemas.DISASTER_POSTS)

    @property
    def rejected(self) -> BatchLog:
        """What a run could not use: the stage, the reason, and the text or row as it came."""
        return self.log("rejected", REJECTED)

    # --- stages: each returns (processed, inserted, skipped) -----------------------------
    def reject(self, raw: DataFrame, feeds: dict[str, DataFrame]) -> tuple[int, int, int]:
        """Documents and items that no parser took, and checked rows without an id, are stored."""
        keyless = tables.keyless_rows(raw, ["tweet_id"]).select(
            F.lit("ingest").alias("stage"), F.lit("no id").alias("reason"), F.to_json(F.struct("*")).alias("text")
        )
        parts = [keyless]
        for name, feed in feeds.items():
            found = ingest.rejects(feed)
            parts.append(found.select(F.lit(name).alias("stage"), "reason", "text"))
        out = parts[0]
        for more in parts[1:]:
            out = out.unionByName(more)
        self.rejected.append(out, self.number)
        stored = self.rejected.read_batch(self.number).count()
        return stored, stored, 0

    @property
    def checked(self) -> BatchLog:
        """Every raw row that arrived, with its authenticity label and confidence."""
        return self.log("checked", CHECKED)

    def check(self, raw: DataFrame) -> tuple[int, int, int]:
        """Raw rows are judged once and stored with their label, also those that go no further."""
        self.checked.append(enrich.checked(raw), self.number)
        judged = self.checked.read_batch(self.number)
        authentic = F.count_if(F.col("check_label") == "AUTHENTIC")
        rows, kept = judged.agg(F.count(F.lit(1)), authentic).first()
        return rows, kept, rows - kept

    def ingest(self) -> tuple[int, int, int]:
        """Authentic raw rows become posts; ids the table has are skipped.

        The rows are counted while they are written.
        """
        seen = Observation("ingest")
        at = F.lit(self.now).cast("timestamp")
        judged = self.checked.read_batch(self.number)
        unified = enrich.admitted(judged, F.unix_timestamp(at).cast("double")).observe(
            seen, F.count(F.lit(1)).alias("rows")
        )
        known = self.posts.read(before=self.number)
        fresh = tables.absent_rows(unified, known, ["postId"], ["createdAt", "postText"])
        self.posts.append(fresh, self.number)
        inserted = self.posts.read_batch(self.number).count()
        return seen.get["rows"], inserted, seen.get["rows"] - inserted

    def _label(
        self,
        name: str,
        ddl: str,
        rule: Callable[[DataFrame], DataFrame],
    ) -> tuple[int, int, int]:
        """Label the posts of the batches this table has not seen, in one pass.

        A label batch covers every post up to its number, so finished work is recognised by
        folder; no id of an older post is read. It is never numbered above the posts there are:
        when posts fail to land, the run that lands them later uses the same number.
        """
        out = self.log(name, ddl)
        done, through = out.last(), self.posts.last()
        if through <= done:
            return 0, 0, 0
        out.append(rule(self.posts.read(after=done, before=through + 1)), through)
        added = out.read_batch(through).count()
        return added, added, 0

    def topics(self) -> tuple[int, int, int]:
        return self._label(
            "topics",
            TOPICS,
            lambda p: labels.topic_phrase(p, "postText").withColumnRenamed("postId", "post_id"),
        )

    def places(self) -> tuple[int, int, int]:
        def rule(posts: DataFrame) -> DataFrame:
            return geo.resolve_geo(posts, self.polygons, "postText").withColumnRenamed(
                "postId", "post_id"
            )

        return self._label("geo", GEO, rule)

    def incidents(self) -> tuple[int, int, int]:
        def rule(posts: DataFrame) -> DataFrame:
            words = F.concat_ws(" ", "postText", F.array_join("hashtags", " "))
            return labels.label_incident(
                posts.withColumn("_text", words), "_text"
            ).withColumnRenamed("postId", "post_id")

        return self._label("incidents", INCIDENTS, rule)

    def severities(self) -> tuple[int, int, int]:
        return self._label(
            "severities",
            SEVERITIES,
            lambda p: labels.label_severity(p, "postText")
            .withColumn("reasoning", F.lit("rules"))
            .withColumnRenamed("postId", "post_id"),
        )

    def assemble(self) -> tuple[int, int, int]:
        """Posts of the batches that all label tables have covered are put together.

        Posts whose labelling failed wait for the run that catches up.
        """
        out = self.disaster_posts
        place, topic = self.log("geo", GEO), self.log("topics", TOPICS)
        incident, severity = self.log("incidents", INCIDENTS), self.log("severities", SEVERITIES)
        done = out.last()
        through = min(log.last() for log in (place, topic, incident, severity))
        if through <= done:
            return 0, 0, 0
        span = {"after": done, "before": through + 1}
        complete = (
            self.posts.read(**span)
            .join(place.read(**span).withColumnRenamed("post_id", "postId"), "postId", "left")
            .join(
                topic.read(**span).select(
                    F.col("post_id").alias("postId"), F.col("topic").alias("keywords")
                ),
                "postId",
                "left",
            )
        )
        incidents, severities = incident.read(**span), severity.read(**span)
        now = F.lit(self.now).cast("timestamp")
        out.append(assemble.assemble(complete, incidents, severities, now), through)
        made = out.read_batch(through).count()
        gaps = assemble.assembly_gaps(complete, incidents, severities).count()
        return made + gaps, made, gaps

    def resweep(self) -> tuple[int, int, int]:
        """Posts located nowhere are tried again, with more of their text, until none is left to try.

        The pending table holds them alone, so a run never reads located posts again. Each round
        reads what the one before has written: a run that breaks off goes on where it stopped, and
        a post that was found but not yet taken off the table is not tried twice.
        """
        place, topic = self.log("geo", GEO), self.log("topics", TOPICS)
        entered, found = self.log("geo_entered", "through bigint"), self.log("geo_found", FOUND)
        waiting, tried = self.table("pending_geo", PENDING), self.table("geo_tried", TRIED)
        now = F.lit(self.now).cast("timestamp")
        done, through = entered.last(), min(place.last(), topic.last())
        left = waiting.read()
        if through > done:
            span = {"after": done, "before": through + 1}
            posts = self.posts.read(**span).join(
                topic.read(**span).select(F.col("post_id").alias("postId"), F.col("topic").alias("keywords")),
                "postId",
                "left",
            )
            swept = place.read(**span).withColumnRenamed("post_id", "postId")
            swept = tables.needs_geo(swept.withColumn("geo_processed", F.lit(True)), K.GEO_MIN_CONFIDENCE)
            fresh = posts.join(swept.select("postId"), "postId", "left_semi")
            fresh = fresh.withColumns({"attempts": F.lit(1), "last_processed_at": now})
            # posts that an earlier run has entered, but not marked as entered, are there twice
            left = one_per_key(left.unionByName(fresh), ["postId"], ["attempts"], keep="last")
        known = found.read().select(F.col("post_id").alias("postId"))
        waiting.write(left.join(known, "postId", "left_anti"))
        if through > done:
            entered.append(self.spark.createDataFrame([(through,)], "through bigint"), through)
        processed = located = 0
        for _ in range(K.GEO_TRIES):
            rows = waiting.read()
            due = rows.where(F.col("attempts") < K.GEO_TRIES)
            n = due.count()
            if not n:
                break
            tried.write(geo.retry_geo(due, self.polygons, now))
            missed = tables.needs_geo(tried.read(), K.GEO_MIN_CONFIDENCE)
            hits = tried.read().join(missed.select("postId"), "postId", "left_anti")
            number = found.last() + 1
            found.append(tables.move_raw_geo(hits.withColumnRenamed("postId", "post_id")), number)
            rest = missed.select(*rows.columns).unionByName(rows.where(F.col("attempts") >= K.GEO_TRIES))
            waiting.write(rest)
            processed += n
            located += found.read_batch(number).count()
        return processed, located, waiting.read().count()

    def located_posts(self) -> DataFrame:
        """Disaster posts, with the place that a later try has found."""
        posts, found = self.disaster_posts.read(), self.log("geo_found", FOUND)
        if found.last() < 0:
            return posts
        g = F.col("geo_data")
        moved = F.struct(
            g["state"].alias("state"),
            g["district"].alias("district"),
            F.array(g["lon"], g["lat"]).alias("lat_lon"),
        )
        places = found.read().select("post_id", moved.alias("_moved"))
        joined = posts.join(places, "post_id", "left")
        return joined.withColumn("location", F.coalesce("_moved", "location")).drop("_moved")

    def consolidate(self) -> tuple[int, int, int]:
        posts = self.located_posts()
        events = self.table("events", EVENTS)
        events.write(consolidate.consolidate(posts, keyed_by_post=True))
        members = self.table("event_posts", MEMBERS)
        members.write(consolidate.event_posts(posts, keyed_by_post=True))
        taken, all_posts = members.read().count(), posts.count()
        return all_posts, events.read().count(), all_posts - taken

    def figures(self) -> tuple[int, int, int]:
        events = self.table("events", EVENTS).read()
        out = self.table("figures", FIGURES)
        out.write(metrics.dashboard(events, self.disaster_posts.read()))
        return events.count(), out.read().count(), 0

    def document(self) -> tuple[int, int, int]:
        """The stored dashboard document, replaced as a whole: readers see the last or the new one."""
        tidy = self.table("figures", FIGURES).read()
        out = self.table("dashboard", DOCUMENT)
        at = F.lit(self.now).cast("timestamp")
        out.write(metrics.dashboard_document(tidy, self.now).withColumn("updated_at", at))
        return tidy.count(), out.read().count(), 0

    def indexes(self) -> tuple[int, int, int]:
        """Flat rows of events and disaster posts for a search index, replaced by each run."""
        events, posts = self.table("events", EVENTS).read(), self.located_posts()
        event_index, post_index = self.table("event_index", EVENT_INDEX), self.table("post_index", POST_INDEX)
        event_index.write(search.index_projection(events))
        post_index.write(search.post_index_projection(posts))
        made = event_index.read().count() + post_index.read().count()
        return made, made, 0

    def trends(self) -> tuple[int, int, int]:
        posts = self.disaster_posts.read().withColumn("keywords_generated", F.lit(True))
        topics = posts.select(text.tidy_topic(F.col("keywords")).alias("topic"))
        keywords = metrics.topic_counts(posts, labels.canonical_topics(topics))
        hashtags = metrics.hashtag_counts(posts, as_list=None, as_text="hashtags")
        out = self.table("tracking_keyword", TERMS)
        at = F.lit(self.now).cast("timestamp")
        out.write(metrics.tracking_terms(keywords, hashtags).withColumn("updated_at", at))
        return posts.count(), out.read().count(), 0

    # --- the run ------------------------------------------------------------------------
    def run(self, raw: DataFrame, feeds: dict[str, DataFrame] | None = None) -> DataFrame:
        """All stages in order; returns one report row per stage.

        ``feeds`` are the landed documents that ``raw`` comes from, by name, with their JSON text in
        ``value``; what their parsers pass over is stored as rejected.
        """
        stages: list[tuple[str, Callable[[], tuple[int, int, int]]]] = [
            ("reject", lambda: self.reject(raw, feeds or {})),
            ("check", lambda: self.check(raw)),
            ("ingest", self.ingest),
            ("topics", self.topics),
            ("places", self.places),
            ("resweep", self.resweep),
            ("incidents", self.incidents),
            ("severities", self.severities),
            ("assemble", self.assemble),
            ("consolidate", self.consolidate),
            ("figures", self.figures),
            ("document", self.document),
            ("indexes", self.indexes),
            ("trends", self.trends),
        ]
        self.number = self.posts.last() + 1
        report = []
        for name, stage in stages:
            try:
                processed, inserted, skipped = stage()
                report.append((name, "ok", processed, inserted, skipped, None))
            except Exception as failed:
                log.exception("stage %s failed", name)
                report.append((name, "failed", 0, 0, 0, f"{type(failed).__name__}: {failed}"))
        return self.spark.createDataFrame(report, REPORT)


def raw_from_feeds(timeline: DataFrame | None, items: DataFrame | None) -> DataFrame:
    """Raw topic rows from landed feed documents of either platform."""
    parts = []
    if timeline is not None:
        rows = ingest.clean_timeline_posts(ingest.flatten_timeline(timeline))
        parts.append(ingest.as_raw_topic(rows))
    if items is not None:
        rows = ingest.clean_item_posts(ingest.flatten_items(items)).withColumn(
            "created_at", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
        )
        parts.append(ingest.as_raw_topic(rows))
    if not parts:
        raise ValueError("no feed given")
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


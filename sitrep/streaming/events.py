"""Incremental consolidation: each micro-batch of disaster posts updates the event table.

State is a log of partial slices (one row per type, district and day of the batch), merged
when read. Merging is associative and commutative, so any arrival order and any split into
batches ends in the table the batch job computes, late posts included. Every folder written is
named by its batch number: a batch that is run again replaces its own folders.

A batch reads the buckets of the state that its own keys are in, not the history: post ids, slices
and sent alerts are logs looked up by key (``sitrep.sources.keyed``), merged and cleaned up as the
batches go on.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitrep import constants as K
from sitrep import schemas
from sitrep.operators import alerts
from sitrep.operators import consolidate as C
from sitrep.skew import one_per_key
from sitrep.sources.keyed import KeyedLog
from sitrep.sources.tables import BatchLog

KEYED = (
    "post_id string, classification_type string, location_district string, slice bigint, "
    "start_time timestamp, state string, coordinates array<double>"
)
SLICES = (
    "classification_type string, location_district string, slice bigint, start_time timestamp, "
    "most_recent_report timestamp, "
    "first struct<start_time: timestamp, post_id: string, coordinates: array<double>>, "
    "last struct<start_time: timestamp, post_id: string, state: string>, posts bigint"
)
CHANGES = (
    "event_id string, classification_type string, location_district string, "
    "location_state string, start_time timestamp, most_recent_report timestamp, "
    "geometry struct<type: string, coordinates: array<double>>, total_posts_count bigint, "
    "first_slice bigint, last_slice bigint, is_deleted boolean"
)
ALERT_LOG = (
    "classification_type string, location_district string, slice bigint, sent_at timestamp"
)
ATTRIBUTES = (
    "classification_type string, location_district string, slice bigint, "
    "alert_cooldown_mins int, set_at timestamp"
)
OUTBOX = (
    "event_id string, email string, subject string, state string, first_reported string, "
    "unsubscribe_link string"
)


def latest_sent(rows: DataFrame) -> DataFrame:
    """One row per slice with an alert: the last time one went out."""
    return rows.groupBy(*C.SLICE_KEYS).agg(F.max("sent_at").alias("sent_at"))


def latest_attributes(rows: DataFrame) -> DataFrame:
    """One row per slice with attributes: those set last."""
    by_time = F.max(F.struct("set_at", "alert_cooldown_mins"))
    return rows.groupBy(*C.SLICE_KEYS).agg(by_time.alias("_a")).select(
        *C.SLICE_KEYS, "_a.alert_cooldown_mins", "_a.set_at"
    )


@dataclass
class EventStore:
    """The tables of one running consolidation, below one shared folder.

    ``disaster_posts`` holds every post once, for the figures over posts; ``posts`` its event
    keys; ``slices`` the state; ``attributes`` what was set for events by hand; ``changes``,
    ``outbox`` and ``alert_log`` what was published; ``times`` the moment at which a batch was taken.
    What belongs to an event is kept by one of its slices, so it stays with the event when a late
    post gives it another id or joins it to a neighbour.
    """

    spark: SparkSession
    root: str
    gap_hours: float = K.EVENT_GAP_HOURS
    fan: int = 8

    def __post_init__(self) -> None:
        def log(name: str, ddl: str) -> BatchLog:
            return BatchLog(self.spark, f"{self.root}/{name}", schemas.struct(ddl))

        def keyed(name: str, ddl: str, keys: list[str], **options) -> KeyedLog:
            return KeyedLog(
                self.spark, f"{self.root}/{name}", schemas.struct(ddl), keys, fan=self.fan, **options
            )

        self.arrivals = log("arrivals", schemas.DISASTER_POSTS)
        self.disaster_posts = log("disaster_posts", schemas.DISASTER_POSTS)
        self.posts = keyed("posts", KEYED, ["post_id"])
        self.slices = keyed("slices", SLICES, C.EVENT_KEYS, merge=C.merge_slices)
        self.changes = log("changes", CHANGES)
        self.alert_log = keyed("alert_log", ALERT_LOG, C.EVENT_KEYS, merge=latest_sent)
        self.attributes = keyed("attributes", ATTRIBUTES, C.EVENT_KEYS, merge=latest_attributes)
        self.outbox = log("outbox", OUTBOX)
        self.times = log("times", "now string")

    # --- reading ---------------------------------------------------------------------
    def events(self) -> DataFrame:
        """The current event table."""
        return C.events_from_slices(C.merge_slices(self.slices.read()), self.gap_hours)

    def event_posts(self) -> DataFrame:
        """The current link table of events and posts."""
        sliced = C.merge_slices(self.slices.read())
        return C.posts_of_slices(self.posts.read(), sliced, self.gap_hours)

    def alerted_events(self) -> DataFrame:
        """The current events with ``last_alert_sent`` and ``alert_cooldown_mins`` (null: the default)."""
        owner = C.slice_events(C.merge_slices(self.slices.read()), self.gap_hours)
        return self._with_alerts(self.events(), owner, self.alert_log.read(), self.attributes.read())

    @staticmethod
    def _with_alerts(
        events: DataFrame, owner: DataFrame, sent: DataFrame, attributes: DataFrame
    ) -> DataFrame:
        """Events with what is known of their slices (``owner``: the event of each slice)."""
        last = (
            latest_sent(sent).join(owner, C.SLICE_KEYS).groupBy("event_id").agg(F.max("sent_at").alias("last_alert_sent"))
        )
        newest = F.max(F.struct("set_at", "alert_cooldown_mins"))
        own = latest_attributes(attributes).join(owner, C.SLICE_KEYS).groupBy("event_id").agg(newest.alias("_own"))
        return (
            events.join(last, "event_id", "left")
            .join(own, "event_id", "left")
            .withColumn("alert_cooldown_mins", F.col("_own.alert_cooldown_mins"))
            .drop("_own")
        )

    # --- writing ---------------------------------------------------------------------
    def add(self, disaster_posts: DataFrame, batch: int) -> None:
        """Take in one micro-batch of disaster posts and publish what changed.

        The batch is computed once, when it is written as it arrived; all that follows reads
        that folder, which may be removed when the batch is done.
        """
        self.arrivals.append(disaster_posts, batch)
        arrived = self.arrivals.read_batch(batch)
        order = ["start_time", "classification_type", "location_district"]
        rows = one_per_key(C.keyed_posts(arrived, self.gap_hours), ["post_id"], order)
        # one column of the buckets that this batch's ids are in; it meets them, not the reverse
        known = self.posts.near(rows.select("post_id"), before=batch).select("post_id")
        repeats = known.join(rows.select("post_id"), "post_id", "left_semi").distinct()
        self.posts.append(rows.join(repeats, "post_id", "left_anti"), batch)
        fresh = self.posts.read_batch(batch)
        once = one_per_key(
            arrived, ["post_id"], ["start_time", "disaster_type", F.lower("location.district")]
        )
        self.disaster_posts.append(
            once.join(fresh.select("post_id"), "post_id", "left_semi"), batch
        )
        self.slices.append(C.slices(fresh), batch)
        before, after = self._touched_events(batch)
        self.changes.append(C.event_changes(before, after), batch)

    def _touched_events(self, batch: int) -> tuple[DataFrame, DataFrame]:
        """Events of the (type, district) keys this batch touched, before and after it."""
        fresh = self.slices.read_batch(batch)
        touched = fresh.select(*C.EVENT_KEYS).distinct()
        old = self.slices.near(touched, before=batch).join(touched, C.EVENT_KEYS, "left_semi")
        return (
            C.events_from_slices(C.merge_slices(old), self.gap_hours),
            C.events_from_slices(C.merge_slices(old.unionByName(fresh)), self.gap_hours),
        )

    def alert(
        self, subscribers: DataFrame, batch: int, now: str, unsubscribe_base: str
    ) -> None:
        """Messages for the events this batch changed that are fresh and not on cooldown.

        The alert log remembers a slice of the event, not its id, so the cooldown survives when
        a late post gives the event another id or joins it to a neighbour.
        """
        changed = self.changes.read_batch(batch).where(~F.col("is_deleted")).drop("is_deleted")
        keys = changed.select(*C.EVENT_KEYS).distinct()
        parts = self.slices.near(keys, before=batch + 1).join(keys, C.EVENT_KEYS, "left_semi")
        owner = C.slice_events(C.merge_slices(parts), self.gap_hours)
        ready = self._with_alerts(
            changed,
            owner,
            self.alert_log.near(keys, before=batch),
            self.attributes.near(keys, before=self.attributes.last() + 1),
        )
        due = alerts.alerts_due(ready, now)
        self.outbox.append(alerts.outbox(due, subscribers, unsubscribe_base), batch)
        reached = self.outbox.read_batch(batch).select("event_id").distinct()
        self.alert_log.append(
            due.join(reached, "event_id", "left_semi").select(
                *C.EVENT_KEYS,
                F.col("first_slice").alias("slice"),
                F.lit(now).cast("timestamp").alias("sent_at"),
            ),
            batch,
        )

    def set_cooldown(self, cooldowns: DataFrame, at: str) -> None:
        """Cooldowns of their own for events: ``(event_id, alert_cooldown_mins)``, null for the default.

        The last one set counts, also when the event has merged with another since.
        """
        rows = self.events().join(cooldowns, "event_id").select(
            *C.EVENT_KEYS,
            F.col("first_slice").alias("slice"),
            "alert_cooldown_mins",
            F.lit(at).cast("timestamp").alias("set_at"),
        )
        number = self.attributes.last() + 1
        self.attributes.append(rows, number)
        self.attributes.settle(number)

    def moment(self, batch: int, clock: Callable[[], str]) -> str:
        """When a batch was first taken; a batch that is run again gets the same time."""
        if batch > self.times.last():
            now = self.spark.createDataFrame([(clock(),)], "now string")
            self.times.append(now, batch)
        return self.times.read_batch(batch).first()[0]

    def settle(self, batch: int) -> None:
        """Before a batch is taken: merge finished logs, remove what only earlier batches needed."""
        for log in (self.posts, self.slices, self.alert_log):
            log.settle(batch)
        for log in (self.arrivals, self.times):
            if batch > 1:
                log.forget(batch - 2)

"""The streaming chain: raw topic -> authentic -> processed -> events and alerts.

One query per durable boundary, each with its own checkpoint. The steps are the batch
operators; only sources, sinks and state are particular to streaming.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from sitrep import schemas
from sitrep.operators import enrich
from sitrep.sources import topics
from sitrep.sources.tables import Folder
from sitrep.streaming.events import EventStore

PROCESSED = schemas.POSTS + (
    ", keywords string, sentiment struct<label: string, confidence: double, reasoning: string>"
)


#: What the chain reads, and its columns.
TOPICS = {"raw": schemas.RAW_TOPIC, "authentic": schemas.POSTS, "processed": PROCESSED}


def utc_now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")


@dataclass
class Chain:
    """Folders and fixed inputs of one running chain."""

    spark: SparkSession
    root: str
    polygons: DataFrame
    subscribers: DataFrame
    unsubscribe_base: str
    clock: Callable[[], str] = utc_now
    repeat_window: str = "1 hour"
    files_per_batch: int | None = None

    def topic(self, name: str) -> str:
        return f"{self.root}/topics/{name}"

    def _checkpoint(self, name: str) -> str:
        return f"{self.root}/checkpoints/{name}"

    def _read(self, name: str, ddl: str) -> DataFrame:
        Folder(self.spark, self.topic(name)).make()  # a stage may start before anything was written
        return topics.read_topic(
            self.spark, self.topic(name), schemas.struct(ddl), self.files_per_batch
        )

    @property
    def store(self) -> EventStore:
        return EventStore(self.spark, f"{self.root}/events")

    # --- stages -----------------------------------------------------------------------
    def rejected(self) -> DataStreamWriter:
        """Lines of any topic that do not fit its schema, with the topic's name: ``(topic, value)``."""
        bad = None
        for name, ddl in TOPICS.items():
            rows = topics.bad_rows(self._read(name, ddl)).select(F.lit(name).alias("topic"), "value")
            bad = rows if bad is None else bad.unionByName(rows)
        return topics.write_topic(bad, self.topic("rejected"), self._checkpoint("rejected"))

    def gated(self) -> DataStreamWriter:
        """Raw to authentic. Repeats close in time are dropped here to save work; the event
        store drops all of them. The watermark is on arrival, so late posts are kept."""
        raw = topics.good_rows(self._read("raw", schemas.RAW_TOPIC))
        posts = enrich.gate(raw, F.unix_timestamp().cast("double"))
        once = (
            posts.withColumn("arrived", F.timestamp_seconds("processedAt"))
            .withWatermark("arrived", self.repeat_window)
            .dropDuplicatesWithinWatermark(["postId"])
            .drop("arrived")
        )
        return topics.write_topic(once, self.topic("authentic"), self._checkpoint("gate"))

    def analysed(self) -> DataStreamWriter:
        """Authentic to processed."""
        posts = topics.good_rows(self._read("authentic", schemas.POSTS))
        return topics.write_topic(
            enrich.analyse(posts), self.topic("processed"), self._checkpoint("analyse")
        )

    def consolidated(self) -> DataStreamWriter:
        """Processed posts to events and alerts."""
        posts = topics.good_rows(self._read("processed", PROCESSED))
        return (
            posts.writeStream.foreachBatch(self.take)
            .option("checkpointLocation", self._checkpoint("events"))
            .outputMode("append")
        )

    def take(self, processed: DataFrame, batch: int) -> None:
        """One micro-batch: finish the posts, update the events, write the messages."""
        store = self.store
        store.settle(batch)
        now = store.moment(batch, self.clock)
        finished = enrich.locate_and_classify(processed, self.polygons)
        posts = enrich.disaster_posts(finished, F.to_timestamp(F.lit(now)))
        store.add(posts, batch)
        store.alert(self.subscribers, batch, now, self.unsubscribe_base)

    # --- running ----------------------------------------------------------------------
    def run_available(self) -> None:
        """Process everything that has arrived, stage by stage, then stop."""
        for stage in (self.gated, self.analysed, self.consolidated, self.rejected):
            stage().trigger(availableNow=True).start().awaitTermination()

    def start(self, every: str = "1 minute") -> list[StreamingQuery]:
        """Run all stages continuously; the caller awaits or stops the queries."""
        stages = (self.gated, self.analysed, self.consolidated, self.rejected)
        return [stage().trigger(processingTime=every).start() for stage in stages]

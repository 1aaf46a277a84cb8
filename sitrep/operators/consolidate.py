"""Posts to events: same incident type, same district, reports at most 24 hours apart.

How it scales. Time is cut into slices exactly one gap wide. Two posts of one type and
district in the same slice are always less than a gap apart, so they belong to the same event
whatever else happens. Each task therefore reduces its own posts to one row per (type,
district, slice) before anything is shuffled, and chaining slices into events only ever sees
one row per slice: a district holding a third of all posts has as many rows here as it has
days of history. Slices merge in any order, which is also what makes late posts and
micro-batches give the same table (see ``sitrep.streaming.events``).

Post ids stay in a link table (``event_posts``), not in one array per event, because an event
may hold any share of all posts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitrep import constants as K
from sitrep.functions.dates import epoch_micros
from sitrep.skew import one_per_key, salted_join

SLICE_KEYS = ["classification_type", "location_district", "slice"]
EVENT_KEYS = ["classification_type", "location_district"]


def event_id(kind: Column, district: Column, at: Column, post_id: Column) -> Column:
    """``TYPE-DISTRICT-yyyymmdd-hhmmss-<first 4 of md5(post id)>``."""
    suffix = F.when(
        F.coalesce(post_id, F.lit("")) == "", F.lit("0000")
    ).otherwise(F.substring(F.md5(post_id.cast("binary")), 1, 4))
    return F.concat_ws(
        "-",
        F.upper(kind),
        F.upper(F.replace(district, F.lit(" "), F.lit(""))),
        F.date_format(at, "yyyyMMdd"),
        F.date_format(at, "HHmmss"),
        suffix,
    )


def _gap_micros(gap_hours: float) -> int:
    return int(gap_hours * 3600 * 1_000_000)


def time_slice(at: Column, gap_hours: float) -> Column:
    """Number of the gap-wide slice an instant falls in; exact, also before 1970."""
    width = F.lit(_gap_micros(gap_hours))
    micros = epoch_micros(at)
    return ((micros - F.pmod(micros, width)) / width).cast("bigint")


def keyed_posts(posts: DataFrame, gap_hours: float = K.EVENT_GAP_HOURS) -> DataFrame:
    """Disaster posts with their event keys and time slice; posts without a type or time
    cannot join an event."""
    at = F.col("start_time")
    return posts.where(F.col("disaster_type").isNotNull() & at.isNotNull()).select(
        "post_id",
        F.col("disaster_type").alias("classification_type"),
        F.lower(F.coalesce(F.col("location.district"), F.lit("unknown"))).alias(
            "location_district"
        ),
        time_slice(at, gap_hours).alias("slice"),
        at.alias("start_time"),
        F.lower(F.coalesce(F.col("location.state"), F.lit("unknown"))).alias("state"),
        F.coalesce(F.col("location.lat_lon"), F.array(F.lit(0.0), F.lit(0.0))).alias("coordinates"),
    )


def slices(keyed: DataFrame) -> DataFrame:
    """Posts (one row per post id) reduced to one row per type, district and slice."""
    return keyed.groupBy(*SLICE_KEYS).agg(
        F.min("start_time").alias("start_time"),
        F.max("start_time").alias("most_recent_report"),
        F.min(F.struct("start_time", "post_id", "coordinates")).alias("first"),
        F.max(F.struct(F.col("start_time"), F.col("post_id"), F.col("state"))).alias("last"),
        F.count("*").alias("posts"),
    )


def merge_slices(parts: DataFrame) -> DataFrame:
    """Partial slices of disjoint posts merged; associative and commutative."""
    return parts.groupBy(*SLICE_KEYS).agg(
        F.min("start_time").alias("start_time"),
        F.max("most_recent_report").alias("most_recent_report"),
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        F.sum("posts").alias("posts"),
    )


def chain_slices(sliced: DataFrame, gap_hours: float = K.EVENT_GAP_HOURS) -> DataFrame:
    """Adds ``session``: slices whose gap to the previous one is at most the limit share it."""
    in_time = Window.partitionBy(*EVENT_KEYS).orderBy("slice")
    previous = F.lag("most_recent_report").over(in_time)
    limit = F.expr(f"INTERVAL '{_gap_micros(gap_hours) // 1_000_000}' SECOND")
    starts = previous.isNull() | (F.col("start_time") > previous + limit)
    flagged = sliced.withColumn("_starts", starts.cast("int"))
    return flagged.withColumn("session", F.sum("_starts").over(in_time)).drop("_starts")


def events_from_slices(sliced: DataFrame, gap_hours: float = K.EVENT_GAP_HOURS) -> DataFrame:
    """Event rows. Start, id and geometry come from the first post, the state from the last."""
    grouped = (
        chain_slices(sliced, gap_hours)
        .groupBy(*EVENT_KEYS, "session")
        .agg(
            F.min("start_time").alias("start_time"),
            F.max("most_recent_report").alias("most_recent_report"),
            F.min("first").alias("first"),
            F.max("last").alias("last"),
            F.sum("posts").alias("total_posts_count"),
            F.min("slice").alias("first_slice"),
            F.max("slice").alias("last_slice"),
        )
    )
    return grouped.select(
        event_id(
            F.col("classification_type"),
            F.col("location_district"),
            F.col("start_time"),
            F.col("first.post_id"),
        ).alias("event_id"),
        "classification_type",
        "location_district",
        F.col("last.state").alias("location_state"),
        "start_time",
        "most_recent_report",
        F.struct(
            F.lit("Point").alias("type"), F.col("first.coordinates").alias("coordinates")
        ).alias("geometry"),
        "total_posts_count",
        "first_slice",
        "last_slice",
    )


def event_rows(posts: DataFrame, gap_hours: float, keyed_by_post: bool) -> DataFrame:
    """Keyed posts, one row per post id: the earliest, because ids enter an event once.

    Columns are narrowed before rows are compared, so texts are neither read nor shuffled.
    """
    rows = keyed_posts(posts, gap_hours)
    if keyed_by_post:
        return rows
    return one_per_key(rows, ["post_id"], ["start_time", "classification_type", "location_district"])


def consolidate(
    posts: DataFrame, gap_hours: float = K.EVENT_GAP_HOURS, keyed_by_post: bool = False
) -> DataFrame:
    """All events of a table of disaster posts.

    ``keyed_by_post`` says the table already holds one row per post id (a table kept with
    ``upsert`` does), which saves the shuffle that removes repeats.
    """
    rows = event_rows(posts, gap_hours, keyed_by_post)
    return events_from_slices(slices(rows), gap_hours).drop("first_slice", "last_slice")


def slice_events(sliced: DataFrame, gap_hours: float = K.EVENT_GAP_HOURS) -> DataFrame:
    """Which event each (type, district, slice) belongs to.

    The chained table has one row per slice; the first post of a session gives the id, carried
    to its slices with a window over those few rows.
    """
    session = Window.partitionBy(*EVENT_KEYS, "session")
    first = F.min("first").over(session)
    return chain_slices(sliced, gap_hours).select(
        *SLICE_KEYS,
        event_id(
            F.col("classification_type"),
            F.col("location_district"),
            first["start_time"],
            first["post_id"],
        ).alias("event_id"),
    )


def event_posts(
    posts: DataFrame, gap_hours: float = K.EVENT_GAP_HOURS, keyed_by_post: bool = False
) -> DataFrame:
    """The link table ``(event_id, post_id)``: the set of posts of every event.

    Posts look their slice up in a table that is smaller by orders of magnitude; a slice with
    very many posts is spread by post id.
    """
    rows = event_rows(posts, gap_hours, keyed_by_post)
    sliced = slices(rows)
    return posts_of_slices(rows, sliced, gap_hours)


def posts_of_slices(rows: DataFrame, sliced: DataFrame, gap_hours: float) -> DataFrame:
    """``(event_id, post_id)`` of keyed posts, by the event of their slice.

    A slice knows how many posts it has, so those to split are known without counting again.
    """
    return salted_join(
        rows.select("post_id", *SLICE_KEYS),
        slice_events(sliced, gap_hours),
        SLICE_KEYS,
        spread=["post_id"],
        counts=sliced.select(*SLICE_KEYS, F.col("posts").alias("n")),
    ).select("event_id", "post_id")


def event_post_pages(members: DataFrame, per_page: int = 1000) -> DataFrame:
    """Post ids as arrays: ``(event_id, page, pages, related_post_ids)``.

    Ids are dealt to pages by hash, about ``per_page`` to each, so no row or task holds a whole
    large event. Small events have exactly one page: the full array.
    """
    sizes = members.groupBy("event_id").agg(
        F.ceil(F.count("*") / F.lit(per_page)).cast("bigint").alias("pages")
    )
    posts = sizes.select("event_id", (F.col("pages") * F.lit(per_page)).alias("n"))
    spread = salted_join(members, sizes, ["event_id"], spread=["post_id"], counts=posts)
    number = F.conv(F.substring(F.md5(F.col("post_id").cast("binary")), 1, 8), 16, 10)
    return (
        spread.withColumn("page", F.pmod(number.cast("bigint"), F.col("pages")))
        .groupBy("event_id", "page", "pages")
        .agg(F.array_sort(F.collect_set("post_id")).alias("related_post_ids"))
    )


def event_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows to publish after a batch: new or changed events, and tombstones of merged ones."""
    compared = [c for c in after.columns if c != "event_id"]
    fingerprint = F.md5(F.to_json(F.struct(*compared)))
    old = before.select("event_id", fingerprint.alias("_old"))
    upserts = (
        after.withColumn("_new", fingerprint)
        .join(old, "event_id", "left")
        .where(~F.col("_new").eqNullSafe(F.col("_old")))
        .drop("_new", "_old")
        .withColumn("is_deleted", F.lit(False))
    )
    gone = before.join(after.select("event_id"), "event_id", "left_anti").withColumn(
        "is_deleted", F.lit(True)
    )
    return upserts.unionByName(gone)

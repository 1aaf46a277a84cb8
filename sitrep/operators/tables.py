"""Keyed table maintenance as set operations: each returns the next state of the table."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitrep.skew import one_per_key


def absent_rows(
    source: DataFrame, target: DataFrame, keys: Sequence[str], order_by: Sequence[str | Column]
) -> DataFrame:
    """Source rows to append: one per key, only for keys the target does not have.

    Rows without a whole key are left out; ``keyless_rows`` has them.
    """
    whole = source.where(functools.reduce(operator.and_, [F.col(k).isNotNull() for k in keys]))
    fresh = one_per_key(whole, keys, order_by)
    return fresh.join(target.select(*keys), list(keys), "left_anti")


def keyless_rows(source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Source rows that lack a key and cannot be stored under one."""
    return source.where(functools.reduce(operator.or_, [F.col(k).isNull() for k in keys]))


def insert_counts(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(inserted, skipped)`` of an insert-if-absent.

    Source keys are counted where they are, before the shuffle, so a hot key is one row.
    """
    per_key = source.groupBy(*keys).agg(F.count("*").alias("_n"))
    known = target.select(*keys).distinct().withColumn("_known", F.lit(True))
    merged = per_key.join(known, list(keys), "left")
    return merged.agg(
        F.count_if(F.col("_known").isNull()).alias("inserted"),
        F.coalesce(F.sum("_n") - F.count_if(F.col("_known").isNull()), F.lit(0)).alias("skipped"),
    )


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Field-level update or insert.

    Columns the source has replace the target's, nulls included; columns it lacks keep the
    old value. Both sides hold one row per key (see ``one_per_key``).
    """
    fields = [c for c in source.columns if c not in keys]
    marked = source.select(
        *keys, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in fields]
    )
    joined = target.join(marked, list(keys), "full_outer")
    columns = [*target.columns, *[c for c in fields if c not in target.columns]]
    out = []
    for c in columns:
        if c in keys:
            out.append(F.col(c))
        elif c in fields and c in target.columns:
            out.append(F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c))
        elif c in fields:
            out.append(F.col(f"_new_{c}").alias(c))
        else:
            out.append(F.col(c))
    return joined.select(*out)


def upsert_subscriptions(
    subscribers: DataFrame,
    requests: DataFrame,
    now: float,
    order_by: Sequence[str | Column] = ("locations",),
) -> DataFrame:
    """New or changed subscriptions: ``createdAt`` is set once, ``updatedAt`` every time.

    Requests without locations or an e-mail are rejected. Of several requests for one e-mail the
    last in ``order_by`` counts.
    """
    asked = requests.where((F.size("locations") > 0) & F.col("email").isNotNull())
    valid = one_per_key(asked, ["email"], order_by, keep="last").select(
        "email", F.col("locations").alias("_new_locations"), F.lit(True).alias("_hit")
    )
    joined = subscribers.join(valid, "email", "full_outer")
    at = F.lit(now).cast("double")
    return joined.select(
        "email",
        F.when(F.col("_hit"), F.col("_new_locations"))
        .otherwise(F.col("locations"))
        .alias("locations"),
        F.coalesce(F.col("createdAt"), at).alias("createdAt"),
        F.when(F.col("_hit"), at).otherwise(F.col("updatedAt")).alias("updatedAt"),
    )


def rejected_subscriptions(requests: DataFrame) -> DataFrame:
    return requests.where(
        F.col("locations").isNull() | (F.size("locations") == 0) | F.col("email").isNull()
    )


def delete_keys(target: DataFrame, doomed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table without the listed keys."""
    return target.join(doomed.select(*keys), list(keys), "left_anti")


def delete_report(target: DataFrame, doomed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each requested key with whether the table had it."""
    had = target.select(*keys).distinct().withColumn("_had", F.lit(True))
    return (
        doomed.select(*keys)
        .distinct()
        .join(had, list(keys), "left")
        .select(*keys, F.coalesce("_had", F.lit(False)).alias("deleted"))
    )


def set_topics(posts: DataFrame, topics: DataFrame) -> DataFrame:
    """Bulk keyed update: a processed post is marked, and gets its topic when there is one."""
    marks = topics.select(
        F.col("post_id").alias("postId"), F.col("topic"), F.lit(True).alias("_done")
    )
    joined = posts.join(marks, "postId", "left")
    return joined.select(
        *[F.col(c) for c in posts.columns if c not in ("keywords", "keywords_generated")],
        F.coalesce(F.nullif("topic", F.lit("")), F.col("keywords")).alias("keywords"),
        F.coalesce(F.col("_done"), F.col("keywords_generated"), F.lit(False)).alias(
            "keywords_generated"
        ),
    )


def move_raw_geo(posts: DataFrame) -> DataFrame:
    """Original place fields move into one struct once a post has resolved ``geo_data``."""
    fields = ["latitude", "longitude", "location", "address", "city"]
    return posts.withColumn("raw_geo", F.struct(*fields)).drop(*fields)


def pending(posts: DataFrame, done: DataFrame, key: str, done_key: str | None = None) -> DataFrame:
    """Posts that have no result yet."""
    finished = done.select(F.col(done_key or key).alias(key))
    return posts.join(finished, key, "left_anti")


def oldest_batch(df: DataFrame, key: str, size: int) -> DataFrame:
    """Head of the work queue, in key order."""
    return df.orderBy(key).limit(size)


def not_flagged(c: Column) -> Column:
    """The flag is false, null or absent."""
    return ~c.eqNullSafe(F.lit(True))


def needs_geo(posts: DataFrame, min_confidence: float) -> DataFrame:
    """Posts never located, located nowhere, or located with little confidence."""
    geo = F.col("geo_data")
    return posts.where(
        not_flagged(F.col("geo_processed"))
        | F.coalesce(geo["state"] == "Unknown State", F.lit(False))
        | F.coalesce(geo["confidence_score"] < min_confidence, F.lit(False))
    )


def stage_counts(posts: DataFrame) -> DataFrame:
    """Counts with predicates, in one pass."""
    geo = F.col("geo_data")
    return posts.agg(
        F.count("*").alias("total"),
        F.count_if(not_flagged(F.col("geo_processed"))).alias("pending_geo"),
        F.count_if(geo["state"] == "Unknown State").alias("unknown_state"),
        F.count_if(not_flagged(F.col("keywords_generated"))).alias("pending_keywords"),
    )

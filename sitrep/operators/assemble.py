"""Post + incident label + severity -> disaster post, with a report of what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitrep.functions import dates, predicates
from sitrep.skew import one_per_key


def _parts(
    posts: DataFrame, incidents: DataFrame, severities: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three sides with one row per post; label tables may hold repeated runs.

    Each side is reduced on ``post_id``, so the joins reuse that partitioning.
    """
    label = one_per_key(
        incidents.select("post_id", "classification_type"), ["post_id"], ["classification_type"]
    )
    severity = one_per_key(
        severities.select("post_id", "sentiment_label", "confidence_level", "reasoning"),
        ["post_id"],
        ["sentiment_label", "confidence_level"],
    )
    return posts.withColumnRenamed("postId", "post_id"), label, severity


def assemble(
    posts: DataFrame, incidents: DataFrame, severities: DataFrame, now: Column
) -> DataFrame:
    """Disaster posts of every post that has a label, a severity and a place."""
    post, label, severity = _parts(posts.where(F.col("geo_data").isNotNull()), incidents, severities)
    joined = label.join(severity, "post_id").join(post, "post_id")
    created = F.col("createdAt")
    if dict(posts.dtypes)["createdAt"] == "string":
        created = dates.parse_post_date(created, now)
    return joined.select(
        "post_id",
        F.lit("Confirmed").alias("classification_status"),
        F.col("classification_type").alias("disaster_type"),
        created.alias("start_time"),
        F.struct(
            F.col("geo_data.state").alias("state"),
            F.col("geo_data.district").alias("district"),
            F.array("geo_data.lon", "geo_data.lat").alias("lat_lon"),
        ).alias("location"),
        F.col("postText").alias("post_text"),
        F.coalesce(predicates.missing_to_null(F.col("keywords")), F.lit("")).alias("keywords"),
        F.coalesce(F.array_join("hashtags", ","), F.lit("")).alias("hashtags"),
        F.struct(
            F.col("sentiment_label").alias("label"),
            F.col("confidence_level").cast("double").alias("confidence"),
            F.col("reasoning").alias("reasoning"),
        ).alias("sentiment"),
    )


def assembly_gaps(posts: DataFrame, incidents: DataFrame, severities: DataFrame) -> DataFrame:
    """Labelled posts that cannot be assembled, with a flag per missing part."""
    post, label, severity = _parts(posts, incidents, severities)
    has_post = post.select(
        "post_id", F.lit(True).alias("_post"), F.col("geo_data").isNotNull().alias("_geo")
    )
    has_severity = severity.select("post_id", F.lit(True).alias("_severity"))
    flags = (
        label.select("post_id")
        .join(has_post, "post_id", "left")
        .join(has_severity, "post_id", "left")
        .select(
            "post_id",
            F.coalesce("_post", F.lit(False)).alias("has_post"),
            F.coalesce("_geo", F.lit(False)).alias("has_geo"),
            F.coalesce("_severity", F.lit(False)).alias("has_severity"),
        )
    )
    return flags.where(~(F.col("has_post") & F.col("has_geo") & F.col("has_severity")))

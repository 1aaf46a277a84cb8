"""The steps between a raw row and a disaster post, used by the batch job and the streams.

Every step is row-local apart from joins with small tables, so it works on a stream as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitrep.functions import dates, text
from sitrep.operators import geo, ingest, labels


def checked(raw: DataFrame) -> DataFrame:
    """Raw rows with their authenticity label; text, hashtags and place are judged together."""
    judged = raw.withColumn(
        "_judged",
        F.concat_ws(
            " ",
            "translated_text",
            "cleaned_text",
            "cleaned_description",
            "description",
            "raw_text",
            "tweet_hashtags",
            "hashtags",
            "location",
            "location_name",
        ),
    )
    return labels.label_authenticity(judged, "_judged").drop("_judged")


def gate(raw: DataFrame, processed_at: float | Column) -> DataFrame:
    """Authentic rows only, in the unified schema, with a named place where one is known."""
    return admitted(checked(raw), processed_at)


def admitted(judged: DataFrame, processed_at: float | Column) -> DataFrame:
    """``gate`` of rows that carry their authenticity label already."""
    kept = ingest.unify(judged.where(F.col("check_label") == "AUTHENTIC"), processed_at)
    named = geo.lookup_places(kept, "location")
    unlocated = F.col("latitude").isNull() | F.col("longitude").isNull()
    return named.withColumns(
        {
            "city": F.when(unlocated, F.coalesce("district", "city")).otherwise(F.col("city")),
            "address": F.when(
                unlocated, F.coalesce(F.concat_ws(", ", "district", "state"), "address")
            ).otherwise(F.col("address")),
        }
    ).drop("state", "district")


def analyse(posts: DataFrame) -> DataFrame:
    """Severity and topic of unified posts, side by side on the row."""
    scored = labels.label_severity(posts, "postText")
    named = labels.topic_phrase(scored, "postText")
    return named.withColumn(
        "sentiment",
        F.struct(
            F.col("sentiment_label").alias("label"),
            F.col("confidence_level").alias("confidence"),
            F.lit("rules").alias("reasoning"),
        ),
    ).withColumnRenamed("topic", "keywords").drop("sentiment_label", "confidence_level")


def locate_and_classify(posts: DataFrame, polygons: DataFrame) -> DataFrame:
    """Place and incident type of analysed posts. Hashtags and keywords count as text."""
    located = geo.resolve_geo(
        posts.withColumn("_text", F.concat_ws(" ", "postText", "keywords")), polygons, "_text"
    ).drop("_text")
    judged = located.withColumn(
        "_text", F.concat_ws(" ", "postText", F.array_join("hashtags", " "))
    )
    return labels.label_incident(judged, "_text").drop("_text")


def disaster_posts(finished: DataFrame, now: Column) -> DataFrame:
    """The stored form of a finished post. The coordinate is the resolved one."""
    g = F.col("geo_data")
    return finished.select(
        F.col("postId").alias("post_id"),
        F.lit("Confirmed").alias("classification_status"),
        F.col("classification_type").alias("disaster_type"),
        dates.parse_post_date(F.col("createdAt"), now).alias("start_time"),
        F.struct(
            g["state"].alias("state"),
            g["district"].alias("district"),
            F.array(g["lon"], g["lat"]).alias("lat_lon"),
        ).alias("location"),
        F.col("postText").alias("post_text"),
        F.coalesce("keywords", F.lit("")).alias("keywords"),
        F.coalesce(F.array_join("hashtags", ","), F.lit("")).alias("hashtags"),
        "sentiment",
    )


def keyword_column(df: DataFrame, column: str) -> DataFrame:
    """Keywords as the comma-joined text the tables store, whatever form they come in.

    A list loses empty items, a string its outer blanks. Of a struct or a map the topic counts, or
    without one all values. Missing keywords are the empty text.
    """
    value, kind = F.col(column), df.schema[column].dataType
    if isinstance(kind, T.ArrayType):
        out = text.keyword_text(value.cast("array<string>"))
    elif isinstance(kind, T.MapType):
        values = F.map_values(value).cast("array<string>")
        out = F.coalesce(_topic(F.try_element_at(value, F.lit("topic")), kind.valueType), text.keyword_text(values))
    elif isinstance(kind, T.StructType):
        parts = [F.col(f"{column}.`{f.name}`").cast("string") for f in kind if f.name != "topic"]
        out = text.keyword_text(F.array(*parts)) if parts else F.lit("")
        if "topic" in kind.fieldNames():
            out = F.coalesce(_topic(F.col(f"{column}.topic"), kind["topic"].dataType), out)
    else:
        out = F.trim(value.cast("string"))
    return df.withColumn(column, F.coalesce(out, F.lit("")))


def _topic(value: Column, kind: T.DataType) -> Column:
    """The topic's text, or null for none."""
    if isinstance(kind, T.ArrayType):
        return F.nullif(text.keyword_text(value.cast("array<string>")), F.lit(""))
    return F.nullif(F.trim(value.cast("string")), F.lit(""))

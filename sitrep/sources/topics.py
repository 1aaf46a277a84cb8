"""Topics as JSON files or, where the connector is installed, as a message stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

CORRUPT = "_corrupt_record"


def _parsed(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """Typed columns plus the text of lines that do not fit the schema."""
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = F.from_json(F.col("value"), full, {"columnNameOfCorruptRecord": CORRUPT})
    return lines.where(F.trim("value") != "").select(parsed.alias("d")).select("d.*")


def read_topic(
    spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None
) -> DataFrame:
    """A stream of JSON lines with a fixed schema; unparsable lines land in one column."""
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return _parsed(reader.text(path), schema)


def read_broker(spark: SparkSession, schema: T.StructType, **options: str) -> DataFrame:
    """The same rows from a message broker (needs the connector package on the classpath)."""
    rows = spark.readStream.format("kafka").options(**options).load()
    return _parsed(rows.select(F.col("value").cast("string").alias("value")), schema)


def good_rows(topic: DataFrame) -> DataFrame:
    return topic.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def bad_rows(topic: DataFrame) -> DataFrame:
    return topic.where(F.col(CORRUPT).isNotNull()).select(F.col(CORRUPT).alias("value"))


def write_topic(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """JSON sink with exactly-once file commits; the caller sets the trigger and starts it."""
    return (
        stream.writeStream.format("json")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )


def key_value(df: DataFrame, key: str) -> DataFrame:
    """Rows as ``(key, value)`` with a JSON value, the shape a keyed topic takes."""
    return df.select(
        F.col(key).cast("string").alias("key"), F.to_json(F.struct(*df.columns)).alias("value")
    )

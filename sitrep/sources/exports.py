"""File exports. Each task writes its own part file; nothing passes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitrep.operators.search import export_rows

FORMATS = ("csv", "json", "raw")


def write_export(posts: DataFrame, path: str, fmt: str) -> None:
    """CSV holds the flat columns, JSON the nested documents with ISO times."""
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}, not {fmt!r}")
    if fmt == "csv":
        export_rows(posts).write.mode("errorifexists").option("header", True).option(
            "escape", '"'
        ).csv(path)
    else:
        iso = posts.withColumn(
            "start_time", F.date_format("start_time", "yyyy-MM-dd'T'HH:mm:ss")
        )
        iso.write.mode("errorifexists").json(path)


def write_index(rows: DataFrame, path: str) -> DataFrame:
    """Replace an index table and report its size."""
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.parquet(path).agg(F.count("*").alias("indexed"))

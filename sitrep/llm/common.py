"""Shared pieces of the corpus operators: tables, durable intermediate results, let-bindings."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitrep.session import importable

#: One character that ends a word in the contracts: blank, or tab to carriage return.
BLANK = "[\\x20\\x09-\\x0D]"
NOT_BLANK = "[^\\x20\\x09-\\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only for a local master."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    root = spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set on a cluster")
        root = tempfile.mkdtemp(prefix="corpus-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends, and executors may be lost."""
    path = f"{shared_dir(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keyed_rows(docs: DataFrame) -> DataFrame:
    """``key, row``: every row under a key of its own, in the order of ``doc_id``.

    Where no ``doc_id`` is null or repeated, it is the key. Otherwise rows are numbered by
    ``doc_id`` (nulls last) and text, and written once so that their numbers stay.
    """
    doc_id = F.col("doc_id").cast("long")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    unfit = docs.groupBy(doc_id.alias("doc_id")).agg(F.count("*").alias("n")).where("n > 1 or doc_id is null")
    if unfit.isEmpty():
        return docs.select(doc_id.alias("key"), row)
    # exact copies of one row, however many, are spread by their place in the input
    rows = docs.select(row, F.monotonically_increasing_id().alias("place"))
    order = F.col("row.doc_id").cast("long").asc_nulls_last(), F.xxhash64("row.text"), "place"
    return stored(rows.orderBy(*order).select(F.monotonically_increasing_id().alias("key"), "row"), "rows")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df.checkpoint()`` for small, iterated tables; Spark's cleaner removes the files."""
    shared_dir(df.sparkSession)
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once for each row, wherever the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK + "+"), "")


def n_words_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(NOT_BLANK + "+")).cast("long")


_IS_WORD = np.ones(256, dtype=np.int8)
_IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column and its ``n + 1`` offsets; null is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[
        texts.offset : texts.offset + len(texts) + 1
    ]
    if not len(texts) or offsets[-1] == offsets[0]:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(texts) + 1, dtype=np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def count_words(texts: pa.Array) -> np.ndarray:
    """Words ``[^\\x20\\x09-\\x0D]+`` of every text of an Arrow column."""
    data, offsets = utf8(texts)
    inside = _IS_WORD[data]
    starts = inside.copy()
    starts[1:] &= 1 - inside[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts[first] = inside[first]
    total = np.concatenate([[0], np.cumsum(starts, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, so that very long texts do not gather in one batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))

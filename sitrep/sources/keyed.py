"""A log that is looked up by key, without reading its history.

Batches append folders. Whenever ``fan`` consecutive folders of one level are finished, they are
merged into one run of the next level, so a row is rewritten once for each level, and what is read
for any batch is at most ``fan - 1`` runs of each level. A run of level L holds ``fan ** L`` batches in
as many hash buckets of the key (up to ``most``), so a bucket stays about as large as one batch however
long the history is. ``near`` reads only the buckets in which the keys of a batch can be; Spark's
partition pruning leaves the others out.

Runs cover aligned intervals of batch numbers: run k of level L holds the batches from
``k * fan ** L`` on. So a batch that is run again reads and writes the same folders, and which folders
make up the history follows from numbers, not from listing it. The parts of a run are removed when
the next run of its level has been written, so readers that began before it still finish.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitrep.sources.tables import Folder

BUCKET = "bucket_of_key"


class KeyedLog:
    """An append-only table with one folder per batch and merged, bucketed runs of older ones.

    ``merge`` may reduce rows (to one per key, say); it must not matter in which groups and in which
    order rows are merged. Batch numbers start at 0 and rise; numbers may be left out.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        schema: T.StructType,
        keys: Sequence[str],
        merge: Callable[[DataFrame], DataFrame] = lambda rows: rows,
        fan: int = 8,
        most: int = 1024,
    ):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.keys, self.merge, self.fan, self.most = list(keys), merge, fan, most
        self._folder = Folder(spark, self.path)

    # --- folders -------------------------------------------------------------------------
    def _name(self, level: int, number: int) -> str:
        return f"batch={number:012d}" if level == 0 else f"run{level}={number:012d}"

    def _dir(self, level: int, number: int) -> str:
        return f"{self.path}/{self._name(level, number)}"

    def _finished(self, level: int, number: int) -> bool:
        return self._folder.finished(self._name(level, number))

    def buckets(self, level: int) -> int:
        n = 1
        for _ in range(level):
            n = n * self.fan if n * self.fan <= self.most else n
        return n

    def parts(self, before: int) -> list[tuple[int, int]]:
        """The folders ``(level, number)`` that hold all batches below ``before``: the largest
        finished runs that fit, then single batches."""
        out, at = [], 0
        while at < before:
            level = 0
            while at % self.fan ** (level + 1) == 0 and at + self.fan ** (level + 1) <= before:
                level += 1
            while level and not self._finished(level, at // self.fan**level):
                level -= 1
            if level or self._finished(0, at):
                out.append((level, at // self.fan**level))
            at += self.fan**level
        return out

    def last(self) -> int:
        """Number of the newest batch, -1 when there is none; older ones may be in runs."""
        newest = self._folder.newest("batch=")
        return -1 if newest is None else newest

    # --- reading -------------------------------------------------------------------------
    def read(self, before: int | None = None) -> DataFrame:
        """Rows of all batches, or of those numbered below ``before``."""
        paths = [self._dir(*p) for p in self.parts(self.last() + 1 if before is None else before)]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        # one reader over several runs: bucket folders below them are not columns of the table
        reader = self.spark.read.schema(self.schema).option("recursiveFileLookup", "true")
        return reader.parquet(*paths)

    def read_batch(self, batch: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self._dir(0, batch))

    def near(self, keys: DataFrame, before: int) -> DataFrame:
        """Rows of batches below ``before`` that may have one of ``keys``: all that do, and others of
        the same buckets.

        Only bucket numbers come to the driver, at most ``most``.
        """
        parts = self.parts(before)
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        wide = max(self.buckets(level) for level, _ in parts)
        wanted = [r[0] for r in keys.select(self._bucket(wide).alias("b")).distinct().collect()]
        out = None
        for level, number in parts:
            n = self.buckets(level)
            if n == 1:
                rows = self.spark.read.schema(self.schema).parquet(self._dir(level, number))
            else:
                with_bucket = T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())])
                rows = self.spark.read.schema(with_bucket).parquet(self._dir(level, number))
                rows = rows.where(F.col(BUCKET).isin(sorted({b % n for b in wanted}))).drop(BUCKET)
            out = rows if out is None else out.unionByName(rows)
        return out

    def _bucket(self, n: int) -> Column:
        # the bucket count of a level divides that of the next, so one number gives all of them
        return F.pmod(F.xxhash64(*self.keys), F.lit(n)).cast("int")

    # --- writing -------------------------------------------------------------------------
    def append(self, rows: DataFrame, batch: int) -> None:
        self._ordered(rows).write.mode("overwrite").parquet(self._dir(0, batch))

    def settle(self, before: int) -> None:
        """Merge what is complete below ``before``, a batch whose predecessors are all committed, and
        remove what merged runs have made superfluous."""
        level = 0
        while before >= self.fan ** (level + 1):
            number = before // self.fan ** (level + 1) - 1
            if not self._finished(level + 1, number):
                self._settle(level + 1, number)
            level += 1

    def _settle(self, level: int, number: int) -> None:
        span = self.fan**level
        whole = [p for p in self.parts((number + 1) * span) if p[1] * self.fan ** p[0] >= number * span]
        if not whole:
            return
        reader = self.spark.read.schema(self.schema).option("recursiveFileLookup", "true")
        rows = self._ordered(self.merge(reader.parquet(*[self._dir(*p) for p in whole])))
        n = self.buckets(level)
        if n == 1:
            rows.write.mode("overwrite").parquet(self._dir(level, number))
        else:
            dealt = rows.withColumn(BUCKET, self._bucket(n)).repartition(BUCKET)
            writer = dealt.sortWithinPartitions(BUCKET, *self.keys).write.mode("overwrite")
            writer.partitionBy(BUCKET).parquet(self._dir(level, number))
        if number and self._finished(level, number - 1):
            for child in range((number - 1) * self.fan, number * self.fan):
                self._folder.remove(self._name(level - 1, child))

    def _ordered(self, rows: DataFrame) -> DataFrame:
        return rows.select(*[rows[f.name].cast(f.dataType) for f in self.schema.fields])

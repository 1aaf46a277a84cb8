"""Tables without a table format: a new folder per write, readers take the last finished one.

A folder is finished once Spark's ``_SUCCESS`` file is in it, so a lost executor or driver
leaves the previous version in place, and a version being read is never overwritten.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class Folder:
    """Numbered folders below a path, on any file system Spark can reach."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._root = self._path(path)
        self._fs = self._root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def numbers(self, prefix: str, above: int = -1) -> list[int]:
        """Numbers of the finished folders with a prefix. Only those above a limit are looked
        into, so a long history costs one listing."""
        if not self._fs.exists(self._root):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._root)]
        listed = [int(n.removeprefix(prefix)) for n in names if n.startswith(prefix)]
        finished = sorted(n for n in listed if n > above and self._finished(prefix, n))
        if not finished and any(self._unmarked(prefix, n) for n in listed if n > above):
            raise ValueError(f"{self._root}: folders with data but without _SUCCESS; turn the marker on")
        return finished

    def _finished(self, prefix: str, number: int) -> bool:
        return self.finished(f"{prefix}{number:012d}")

    def finished(self, name: str) -> bool:
        return self._fs.exists(self._path(self._root, f"{name}/_SUCCESS"))

    def newest(self, prefix: str) -> int | None:
        """The highest number of a finished folder with a prefix."""
        if not self._fs.exists(self._root):
            return None
        names = [s.getPath().getName() for s in self._fs.listStatus(self._root)]
        listed = sorted((int(n.removeprefix(prefix)) for n in names if n.startswith(prefix)), reverse=True)
        return next((n for n in listed if self._finished(prefix, n)), None)

    def remove(self, name: str) -> None:
        """Delete one folder below this one, if it is there."""
        self._fs.delete(self._path(self._root, name), True)

    def make(self) -> None:
        self._fs.mkdirs(self._root)

    def _unmarked(self, prefix: str, number: int) -> bool:
        """Committed data without a marker; a write that broke off leaves none, or _temporary."""
        folder = self._path(self._root, f"{prefix}{number:012d}")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return "_temporary" not in names and any(n.startswith("part-") for n in names)


class VersionedTable:
    """A table replaced as a whole by each write."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def versions(self) -> list[int]:
        return Folder(self.spark, self.path).numbers("v")

    def read(self, version: int | None = None) -> DataFrame:
        """The given or the latest version; an unwritten table is empty."""
        known = self.versions()
        wanted = version if version is not None else (known[-1] if known else None)
        if wanted is None or wanted not in known:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self._dir(wanted))

    def write(self, df: DataFrame, version: int | None = None) -> int:
        """Write the next version (or a named one, so that a repeated batch repeats itself)."""
        known = self.versions()
        number = version if version is not None else (known[-1] + 1 if known else 0)
        ordered = df.select(*[df[f.name].cast(f.dataType) for f in self.schema.fields])
        ordered.write.mode("overwrite").parquet(self._dir(number))
        return number

    def _dir(self, version: int) -> str:
        return f"{self.path}/v{version:012d}"


class BatchLog:
    """An append-only table with one folder per batch; a repeated batch replaces its own folder,
    so nothing is written twice. ``compact`` keeps the number of folders to read small."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def batches(self) -> list[int]:
        return Folder(self.spark, self.path).numbers("batch=")

    def append(self, df: DataFrame, batch: int) -> None:
        self._write(df, "batch=", batch)

    def last(self) -> int:
        """Number of the newest finished batch, -1 when there is none."""
        return max(self.batches(), default=-1)

    def read(self, before: int | None = None, after: int | None = None) -> DataFrame:
        """Rows of all batches, or of those numbered below ``before`` and above ``after``.

        Without ``after`` reading starts at the newest usable base.
        """
        folder = Folder(self.spark, self.path)
        paths = []
        if after is None:
            bases = [n for n in folder.numbers("base=") if before is None or n < before]
            after = bases[-1] if bases else -1
            paths = [self._dir("base=", after)] if bases else []
        later = [n for n in folder.numbers("batch=", after) if before is None or n < before]
        paths += [self._dir("batch=", n) for n in later]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read_batch(self, batch: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self._dir("batch=", batch))

    def forget(self, batch: int) -> None:
        """Remove the folder of a batch that nothing reads any more."""
        Folder(self.spark, self.path).remove(f"batch={batch:012d}")

    def compact(
        self, through: int, merge: Callable[[DataFrame], DataFrame] = lambda df: df
    ) -> None:
        """Write all rows up to a finished batch to one base; later reads start there."""
        self._write(merge(self.read(before=through + 1)), "base=", through)

    def _write(self, df: DataFrame, prefix: str, number: int) -> None:
        ordered = df.select(*[df[f.name].cast(f.dataType) for f in self.schema.fields])
        ordered.write.mode("overwrite").parquet(self._dir(prefix, number))

    def _dir(self, prefix: str, number: int) -> str:
        return f"{self.path}/{prefix}{number:012d}"

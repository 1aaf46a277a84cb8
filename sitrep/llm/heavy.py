"""Keys that hold a large share of all occurrences, by summaries of fixed size."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Occurrences that a task gathers before it adds them to its summary.
GATHERED = 2_000_000
#: Tasks that merge the summaries of all tasks before one merges theirs.
MERGERS = 32

PARTS = "part int, total long, keys binary, counts binary"


class Summary:
    """Counts of the most frequent keys (Misra and Gries, mergeable).

    At most ``size`` keys are held. When there are more, the count of the first key too many is
    taken from all, so no count is too high and none is too low by more than ``total / size``. What
    summaries are merged, and in which order, does not change that bound.
    """

    def __init__(self, size: int):
        self.size, self.total = size, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray, counts: np.ndarray, total: int) -> None:
        """``keys`` are sorted and distinct; ``total`` is what the counts stand for."""
        self.total += total
        keys = np.concatenate([self.keys, keys])
        order = np.argsort(keys, kind="stable")  # two sorted runs: a merge
        keys, counts = keys[order], np.concatenate([self.counts, counts])[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
        self.keys, self.counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
        if len(self.keys) > self.size:
            spare = len(self.keys) - self.size - 1
            self.counts -= np.partition(self.counts, spare)[spare]
            held = self.counts > 0
            self.keys, self.counts = self.keys[held], self.counts[held]

    def row(self, part: int) -> pa.RecordBatch:
        data = [self.keys.astype("<u8").tobytes(), self.counts.astype("<i8").tobytes()]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([part], pa.int32()),
                pa.array([self.total], pa.int64()),
                *[pa.array([d], pa.binary()) for d in data],
            ],
            ["part", "total", "keys", "counts"],
        )


def heavy_keys(
    rows: DataFrame, keys_of: Callable[[pa.RecordBatch], np.ndarray], share: float
) -> np.ndarray:
    """Sorted unsigned keys: all with over twice ``share`` of the total, and at most ``1 / share``.

    Every task keeps a summary of ``1 / share`` keys over all its batches and sends one row; some
    tasks merge these rows one after the other, and one merges theirs. So what leaves a task, and
    what reaches the driver, has a fixed bound, whatever the number of keys, batches and tasks.
    """
    size = math.ceil(1 / share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, waiting = Summary(size), [np.zeros(0, np.uint64)]

        def settle() -> None:
            keys, n = np.unique(np.concatenate(waiting), return_counts=True)
            found.add(keys, n, int(n.sum()))
            waiting[:] = [np.zeros(0, np.uint64)]

        for b in batches:
            waiting.append(keys_of(b))
            if sum(map(len, waiting)) >= GATHERED:
                settle()
        settle()
        if found.total:
            yield found.row(TaskContext.get().partitionId())

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Summary(size)
        for b in batches:
            for total, keys, counts in zip(
                b["total"].to_pylist(), b["keys"].to_pylist(), b["counts"].to_pylist(), strict=True
            ):
                found.add(np.frombuffer(keys, "<u8"), np.frombuffer(counts, "<i8"), total)
        if found.total:
            yield found.row(TaskContext.get().partitionId())

    parts = rows.mapInArrow(run, PARTS).repartition(MERGERS, "part").mapInArrow(merge, PARTS)
    last = parts.repartition(1, F.lit(0)).mapInArrow(merge, PARTS).toArrow()
    if not last.num_rows:
        return np.zeros(0, np.uint64)
    keys = np.frombuffer(last["keys"][0].as_py(), "<u8")
    counts = np.frombuffer(last["counts"][0].as_py(), "<i8")
    return np.sort(keys[counts > share * last["total"][0].as_py()])


def contained(keys: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    if not len(heavy):
        return np.zeros(len(keys), dtype=bool)
    return heavy[np.minimum(np.searchsorted(heavy, keys), len(heavy) - 1)] == keys

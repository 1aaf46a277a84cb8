"""Building blocks that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one key that one task joins; keys with more are split.
TARGET_ROWS = 1_000_000
#: Keys that are split, the heaviest ones. Bounds what is broadcast.
MAX_HEAVY = 10_000


def one_per_key(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[str | Column], keep: str = "first"
) -> DataFrame:
    """One row per key: the first (or last) in ``order_by``.

    An aggregate, not a ``row_number`` window: each task reduces its own rows to one per key
    before the shuffle, so a hot key never gathers in one task.
    """
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by if keep == "first" else F.max_by
    order = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order_by])
    if not rest:
        return df.select(*keys).distinct()
    kept = df.groupBy(*keys).agg(pick(F.struct(*rest), order).alias("_row"))
    return kept.select(*[F.col(c) if c in keys else F.col(f"_row.{c}") for c in df.columns])


def heavy_keys(counts: DataFrame, on: Sequence[str], target: int = TARGET_ROWS) -> DataFrame:
    """Keys with more than ``target`` rows, with their number of ``salts``; at most ``MAX_HEAVY``.

    ``counts`` has one row per key, with its rows as ``n``. The heaviest come first: a key that
    is left out has less than one part in ``MAX_HEAVY`` of all rows, and is joined as it is.
    """
    many = counts.where(F.col("n") > target).dropna(subset=list(on))
    heaviest = many.orderBy(F.col("n").desc(), *on).limit(MAX_HEAVY)
    return heaviest.select(*on, F.ceil(F.col("n") / F.lit(target)).cast("int").alias("_salts"))


def salted_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    spread: Sequence[str] | None = None,
    salts: int | None = None,
    counts: DataFrame | None = None,
    target: int = TARGET_ROWS,
    hint: str | None = None,
) -> DataFrame:
    """Equi-join in which the heavy keys of ``big`` are split over several partitions.

    Heavy keys are found by their counts (``counts``: keys and rows ``n``, where the caller has
    them; else counted here, reduced before the shuffle). A key with ``n`` rows is cut into
    ``ceil(n / target)`` parts, and only its rows of ``small`` are repeated, once per part. All
    other rows are joined plainly. With ``salts``, every key is cut into so many parts instead.

    The part is a hash of ``spread`` columns, so a task that is run again after an executor
    loss produces the same rows. Only the list of heavy keys is broadcast: ``MAX_HEAVY`` at most.
    ``hint`` names the kind of join. With "merge" Spark does not broadcast ``big`` where it happens
    to be known first and small, which would leave all rows to the few tasks of ``small``.
    """
    spread = list(spread or big.columns)
    if salts is None:
        if counts is None:
            counts = big.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
        heavy = F.broadcast(heavy_keys(counts, on, target))
        big, small = big.join(heavy, list(on), "left"), small.join(heavy, list(on), "left")
        parts = F.coalesce("_salts", F.lit(1))
    else:
        parts = F.lit(salts)
    # never null, so that no null filter is pushed below a shuffle others could share
    salt = F.coalesce(F.pmod(F.xxhash64(*spread), parts).cast("int"), F.lit(0))
    left = big.withColumn("_salt", salt).drop("_salts")
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_salts")
    right = right.hint(hint) if hint else right
    return left.join(right, [*on, "_salt"], how).drop("_salt")

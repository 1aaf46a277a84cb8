"""Mix sources to target weights by cube-method balanced sampling.

Every source gets a target of words; its documents share it by one rate, ``target / size``. The
whole part of the rate is taken from every document, the fractional part is an inclusion
probability. The cube method moves these probabilities inside the null space of the balancing
constraints (words taken, documents taken) until almost all are zero or one. Blocks of documents
are dealt by a hash, so a source with a third of all rows is as many blocks as it needs; a block
leaves at most two documents between zero and one, which are taken in part: that is its landing.

Null texts have size 0 and nothing is taken from them. A null source is a source, the last one.
Repeated rows, and rows with a null ``doc_id``, are documents of their own; however many are equal,
they are dealt over all blocks. Empty tables give no rows. Only ``doc_id``, ``text``
and ``source`` are read, so extra columns do not matter. Reruns agree: the hash and the order
inside a block depend on the rows alone.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitrep.llm.common import count_words, keyed_rows, small_batches, stored, words_of

#: Weights of the sources in their order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
#: The mix holds this share of all words.
SHARE = 1.5
#: No source, and no document, is taken more often than this.
MAX_REPEATS = 2.0
#: Documents that are balanced together.
BLOCK = 2000

#: Probabilities this close to zero or one have arrived.
NEAR = 1e-9


def sizes_of(docs: DataFrame, key: Column | None = None) -> DataFrame:
    """``key``, ``doc_id``, ``source``, ``text_hash`` and ``size``, the words of the whole text.

    ``key`` names the row for who asks for it; the mix does not depend on it.
    """
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [
                    *(b[c] for c in ("key", "doc_id", "source", "text_hash")),
                    pa.array(count_words(b["text"]), pa.int64()),
                ],
                ["key", "doc_id", "source", "text_hash", "size"],
            )

    kept = docs.select(
        (F.lit(0) if key is None else key).cast("long").alias("key"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.xxhash64(F.col("text").cast("string")).alias("text_hash"),
        F.col("text").cast("string").alias("text"),
    )
    return kept.mapInArrow(count, "key long, doc_id long, source string, text_hash long, size long")


def targets_of(
    sizes: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    max_repeats: float = MAX_REPEATS,
) -> DataFrame:
    """One row per source: ``source_size``, ``n_docs`` and ``target``.

    Shares beyond a source's cap go to the others by weight until none is above its cap. With
    sources ordered by cap per weight, that level is the largest of the levels at which a source
    and all after it share what those before it leave.
    """
    per_source = sizes.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count("*").alias("n_docs")
    )
    # one row per source, not per document, meets in these windows
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weighted = per_source.withColumn(
        "weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), turn)
    ).withColumn("cap", F.lit(float(max_repeats)) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.lit(float(share)) * F.sum("source_size").over(everything)
    spent = F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    leveled = weighted.withColumn("level", (budget - spent) / F.sum("weight").over(onward))
    level = F.max("level").over(everything)
    return leveled.withColumn(
        "target", F.least(F.col("cap"), level * F.col("weight"))
    ).select("source", "source_size", "n_docs", "target")


def fly(p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The flight phase: probabilities moved to zero or one, all but two at most.

    Three documents at a time have a direction in which neither the expected words nor the
    expected number of documents change; they move along it until one arrives, then the next
    takes its place. The side is chosen by a fixed generator, by the odds the cube method asks.
    """
    p = p.astype(float).copy()
    odds = np.random.default_rng(len(p)).random(len(p) + 3)
    hand: list[int] = []
    for k in range(len(p)):
        if not NEAR < p[k] < 1 - NEAR:
            p[k] = round(p[k])
            continue
        hand.append(k)
        if len(hand) < 3:
            continue
        a, b, c = (float(sizes[i]) for i in hand)
        # orthogonal to the rows (1, 1, 1) and (a, b, c); equal sizes leave the plane to (1, -1, 0)
        u = [b - c, c - a, a - b] if not a == b == c else [1.0, -1.0, 0.0]
        up = min(
            (1 - p[i]) / x if x > 0 else p[i] / -x for i, x in zip(hand, u, strict=True) if x
        )
        down = min(p[i] / x if x > 0 else (1 - p[i]) / -x for i, x in zip(hand, u, strict=True) if x)
        step = up if odds[k] * (up + down) < down else -down
        for i, x in zip(hand, u, strict=True):
            p[i] = min(1.0, max(0.0, p[i] + step * x))
        hand = [i for i in hand if NEAR < p[i] < 1 - NEAR]
    for i in np.flatnonzero((p <= NEAR) | (p >= 1 - NEAR)):
        p[i] = round(p[i])
    return p


def _balance(block: pd.DataFrame) -> pd.DataFrame:
    block = block.sort_values(["order", "doc_id", "size", "text_hash"], kind="stable")
    rate = np.where(
        block["source_size"] > 0, block["target"] / np.maximum(block["source_size"], 1), 0.0
    )
    whole = np.floor(rate)
    p = fly(rate - whole, block["size"].to_numpy())
    # landing: what is still between zero and one is taken in part
    taken = np.rint((whole + p) * block["size"].to_numpy()).astype("int64")
    return block[["key", "doc_id", "size", "source_size", "target"]].assign(taken=taken)


#: Equal rows that one row is turned back into at a time.
PIECE = 10_000


def placed(sizes: DataFrame) -> DataFrame:
    """``sizes`` with each row's ``place`` among the rows that are equal to it.

    Equal rows are counted, which reduces them before the shuffle, and made rows again from their
    count: none meet. The pieces of a count above ``PIECE`` are dealt out before they are rows.
    """
    columns = ["key", "doc_id", "source", "text_hash", "size"]
    counted = sizes.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    few = counted.where(F.col("n") <= PIECE).select(*columns, F.explode(F.expr("sequence(0L, n - 1)")).alias("place"))
    pieces = counted.where(F.col("n") > PIECE).select(
        *columns, "n", F.explode(F.expr(f"sequence(0L, (n - 1) div {PIECE})")).alias("piece")
    )
    many = pieces.repartition(*columns, "piece").select(
        *columns,
        F.explode(F.expr(f"sequence(piece * {PIECE}, least(n, (piece + 1) * {PIECE}) - 1)")).alias("place"),
    )
    return few.unionByName(many)


def dealt(sizes: DataFrame, targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows with the figures of their source, an ``order`` and a ``block`` of about ``block`` rows.

    ``place`` tells equal rows apart, so that they are dealt like any others.
    """
    joined = sizes.alias("d").join(
        targets.alias("t"), F.expr("d.source <=> t.source"), "inner"
    ).select("d.*", "t.source_size", "t.target", "t.n_docs")
    named = F.coalesce("doc_id", "text_hash")
    own = F.xxhash64(named, "size")
    order = F.when(F.col("place") == 0, own).otherwise(F.xxhash64(named, "size", "place"))
    return joined.withColumn("order", order).withColumn(
        "block", F.pmod(F.xxhash64("order"), F.ceil(F.col("n_docs") / block).cast("long"))
    )


def mix_sizes(sizes: DataFrame, targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """``taken`` words for every row of ``sizes``, with its ``place``, so that each source comes to
    its target."""
    return dealt(sizes, targets, block).drop("place").groupBy("source", "block").applyInPandas(
        _balance, "key long, doc_id long, size long, source_size long, target double, taken long"
    )


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    max_repeats: float = MAX_REPEATS,
    block: int = BLOCK,
) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every document."""
    sizes = stored(sizes_of(docs), "sizes")
    return mix_sizes(placed(sizes), targets_of(sizes, weights, share, max_repeats), block).drop("key")


def mixed_documents(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    max_repeats: float = MAX_REPEATS,
    block: int = BLOCK,
) -> DataFrame:
    """The mix itself: rows of ``docs``, whole as often as they are taken, the rest in part.

    A document of ``size`` words of which ``taken`` are mixed gives ``taken // size`` whole rows
    and, for what remains, one row with its first words. ``text`` and ``n_chars`` are of the rows.
    Shares find their rows by a key of the row, so repeated and null ids are mixed as they count.
    """
    # the input's row stays in a column of its own, whatever its columns are called
    rows = keyed_rows(docs)
    own_columns = [F.col(f"row.{c}").alias(c) for c in ("doc_id", "source", "text")]
    sizes = stored(sizes_of(rows.select("key", *own_columns), F.col("key")), "sizes")
    # keys tell equal rows apart
    shares = mix_sizes(
        sizes.withColumn("place", F.col("key")), targets_of(sizes, weights, share, max_repeats), block
    )
    joined = rows.join(shares.select("key", "size", "taken").where("taken > 0"), "key")
    text, part = F.col("row.text"), F.expr("taken % size").cast("int")
    texts = F.concat(
        F.array_repeat(text, F.expr("taken div size").cast("int")),
        F.when(
            part > 0, F.array(F.array_join(F.slice(words_of(text), F.lit(1), part), " "))
        ).otherwise(F.array().cast("array<string>")),
    )
    rows = joined.select("row", F.explode(texts).alias("text"))
    own = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return rows.select(*[own.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])

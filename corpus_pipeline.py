"""The corpus pipeline: five stages, each applying one corpus operator to what its predecessor kept.

Quality classifier, near duplicates, repeated passages, mixing of sources, packing. Every stage
takes ``(spark, docs, sf_dir)``; all but the last return the columns of ``documents``, and each
result is written as Parquet and read again as the next stage's input. Null and empty texts,
repeated rows and empty tables are handled as the operators' docstrings say: an empty text is
rejected or kept by its score, is no near duplicate of anything, and leaves with the mix, which
takes no words from it.

No stage joins rows by ``doc_id``: rows with a null or repeated ``doc_id`` are documents of their
own, ordered by ``doc_id`` (nulls last), then text. So of exact copies under one id, or under none,
one row stays, and different texts under one id all stay.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitrep.llm import jaccard_join, mixing, packing, quality_classifier, suffix_dedup
from sitrep.llm.common import keyed_rows, stored, table
from sitrep.llm.queries import quality_machine


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    machine = quality_machine(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.keep_good(docs, machine)


#: Near duplicates in the pipeline: shingles of five words, a similarity of 0.8 or more.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of every group of near duplicates; texts without words all stay."""
    rows = keyed_rows(docs)
    texts = rows.select(F.col("key").alias("doc_id"), "row.text")
    found = jaccard_join.join(texts, NEAR_WORDS, NEAR_PERCENT)
    stay = found.where("doc_id = component_id").select(F.col("doc_id").alias("key"))
    return rows.join(stay, "key", "left_semi").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that start earlier; those left without any text go."""
    others = F.struct(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != "text"])
    keyed = keyed_rows(docs).select(F.col("key").alias("doc_id"), "row.text", others.alias("own"))
    found = suffix_dedup.deduplicate(keyed).withColumn("row", F.col("row.own"))
    left = found.where("n_removed = 0 or kept_text <> ''")
    columns = {
        "text": F.col("kept_text"),
        "n_chars": F.when(F.col("n_removed") > 0, F.char_length("kept_text").cast("long")).otherwise(
            F.col("row.n_chars")
        ),
    }
    return left.select(*[columns.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens in sequences of 4096."""
    encoder = packing.word_encoder(public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(docs, encoder, with_ids=False)


STAGES = [
    ("quality classifier", good_documents),
    ("n-gram Jaccard join", one_of_each_group),
    ("suffix-array dedup", without_repeats),
    ("mixing to target weights", mixed),
    ("packing", packed),
]

#: A trained model, a random walk and a tokenizer decide: beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; every result but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

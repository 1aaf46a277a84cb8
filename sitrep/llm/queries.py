"""The registered corpus queries: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitrep.llm import (
    conversation_repair,
    embedding_dedup,
    jaccard_join,
    language_id,
    licenses,
    mixing,
    packing,
    prefix_trie,
    quality_classifier,
    quality_rules,
    suffix_dedup,
    token_counts,
    warc,
)
from sitrep.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


@query
def op2_quality_rules(spark, d):
    out = quality_rules.apply_rules(table(spark, d, "documents"))
    return out.drop(*[r.name for r in quality_rules.RULES])


@query
def op8_mix_sources(spark, d):
    return mixing.mix(table(spark, d, "documents"))


@query
def op9_pack_sequences(spark, d):
    encoder = packing.word_encoder(public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(table(spark, d, "documents"), encoder, with_ids=False)


def _fold(modulus: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % modulus


@query
def op6_token_counts(spark, d):
    scores = token_counts.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    return token_counts.count_tokens(table(spark, d, "documents"), scores)


@query
def op7_language_id(spark, d):
    """Rows without a ``doc_id`` have no remainder: not learned from, and not held out."""
    docs = table(spark, d, "documents")
    model = language_id.fit(docs.where(_fold(3) != 1))
    found = language_id.identify(docs, model)
    held_out = F.coalesce(_fold(3) == 1, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def quality_machine(docs: DataFrame, labels: DataFrame) -> quality_classifier.Machine:
    """Fitted on the labelled rows outside the held-out fold."""
    known = labels.where("quality is not null").select("doc_id", "quality")
    text = docs.where(_fold(4) != 2).select("doc_id", "text", "n_chars")
    return quality_classifier.fit(text.join(known, "doc_id"))


@query
def op4_quality_classifier(spark, d):
    docs = table(spark, d, "documents")
    machine = quality_machine(docs, table(spark, d, "labels"))
    found = quality_classifier.score(docs, machine)
    return found.select(
        "doc_id",
        (_fold(4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= quality_classifier.CUT).cast("int").alias("predicted"),
    )


@query
def op1_license_scan(spark, d):
    return licenses.scan(table(spark, d, "documents"))


@query
def op5_embedding_dedup(spark, d):
    return embedding_dedup.near_duplicates(table(spark, d, "embeddings"))


@query
def op10_suffix_dedup(spark, d):
    return suffix_dedup.deduplicate(table(spark, d, "documents"), with_text=False)


@query
def op3_jaccard_join(spark, d):
    return jaccard_join.join(table(spark, d, "documents"))


@query
def op11_repair_conversations(spark, d):
    rows = conversation_repair.damaged(table(spark, d, "conversations"))
    return conversation_repair.report(conversation_repair.repair(rows))


@query
def op12_prefix_trie(spark, d):
    return prefix_trie.nodes_of(table(spark, d, "conversations"))


@query
def op13_warc_round_trip(spark, d):
    return warc.round_trip(table(spark, d, "pages")).drop("url")

"""Connected components of a table of links, by distributed label propagation with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitrep.llm.common import checkpointed


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``id, component_id`` for every row of ``nodes(id)``; links are rows ``(a, b)``.

    Each round every node takes the smallest label around it, then the label of that label, so
    labels travel twice as far each round. Nodes and labels stay in Spark; the driver sees one
    number per round. Rounds are checkpointed, so a lost executor does not replay them all.
    """
    both = checkpointed(
        links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).where("a <> b").distinct()
    )
    touched = both.select(F.col("a").alias("id")).distinct()
    labels = checkpointed(touched.select("id", F.col("id").alias("label")))
    while True:
        label_of = labels.select(F.col("id").alias("b"), F.col("label").alias("around"))
        near = both.join(label_of, "b").groupBy(F.col("a").alias("id")).agg(F.min("around").alias("around"))
        lower = labels.join(near, "id").select("id", "label", F.least("label", "around").alias("next"))
        # a node's old label may itself have found a lower one: hang both below the lowest
        hung = (
            lower.where("next < label").groupBy(F.col("label").alias("id")).agg(F.min("next").alias("hung"))
        )
        pulled = lower.join(hung, "id", "left").select(
            "id", "label", F.least("next", F.coalesce("hung", "next")).alias("next")
        )
        pulled = checkpointed(pulled)
        jump = pulled.select(F.col("id").alias("next"), F.col("next").alias("jump"))
        after = checkpointed(
            pulled.join(jump, "next", "left").select(
                "id", "label", F.least("next", F.coalesce("jump", "next")).alias("next")
            )
        )
        changed = after.where("next <> label").limit(1).count()
        labels = after.select("id", F.col("next").alias("label"))
        if not changed:
            break
    return nodes.select("id").join(labels, "id", "left").select(
        "id", F.coalesce("label", "id").alias("component_id")
    )

"""Top-down pruning as anti-joins on ancestors.

A node survives if and only if it and all its ancestors are selected, so the walk over the
tree is one explode of ancestor keys and one aggregation, whatever the depth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEPT, PRUNED = "kept", "pruned"


def survivors(tree: DataFrame, selected: DataFrame) -> DataFrame:
    """tree (with depth and ancestors) and status, reason and judged.

    selected is (doc_id, node_seq, reason): what the selector kept at each parent. Top nodes
    that have a lone root with children are not judged: the root counts as kept. A pruned
    node below another carries that one's title; only the topmost was judged.
    """
    roots = tree.where("depth = 0").groupBy("doc_id").agg(F.count("*").alias("n"), F.max(~F.col("is_leaf")).alias("inner"))
    lone = roots.where("n = 1 AND inner").select("doc_id", F.lit(True).alias("lone"))
    picks = selected.select("doc_id", "node_seq", F.col("reason").alias("why"), F.lit(True).alias("picked")).dropDuplicates(["doc_id", "node_seq"])
    marked = tree.join(lone, "doc_id", "left").join(picks, ["doc_id", "node_seq"], "left")
    chosen = F.col("picked").isNotNull() | (F.col("lone").isNotNull() & (F.col("depth") == 0))
    marked = marked.withColumn("chosen", chosen)
    out = marked.where("NOT chosen").select(
        "doc_id", F.col("node_seq").alias("__up"), F.struct(F.col("depth").alias("d"), F.col("title").alias("t")).alias("__cut")
    )
    chains = marked.select("doc_id", "node_seq", F.explode("ancestors").alias("__up"))
    above = chains.join(out, ["doc_id", "__up"]).groupBy("doc_id", "node_seq").agg(F.min("__cut").alias("top"))
    joined = marked.join(above, ["doc_id", "node_seq"], "left")
    gone = F.col("top").isNotNull() | ~F.col("chosen")
    reason = F.when(
        F.col("top").isNotNull(),
        F.concat(F.lit("Pruned because ancestor section '"), F.col("top.t"), F.lit("' was pruned.")),
    ).otherwise(F.col("why"))
    return (
        joined.withColumn("status", F.when(gone, F.lit(PRUNED)).when(~F.col("is_leaf"), F.lit(KEPT)))
        .withColumn("reason", reason)
        .withColumn("judged", F.col("top").isNull() & ~(F.col("lone").isNotNull() & (F.col("depth") == 0)))
        .drop("lone", "why", "picked", "chosen", "top")
    )


def leads_to(tree: DataFrame, targets: DataFrame) -> DataFrame:
    """Inner nodes above any target (doc_id, node_seq)."""
    up = tree.join(targets.select("doc_id", "node_seq"), ["doc_id", "node_seq"], "left_semi")
    above = up.select("doc_id", F.explode("ancestors").alias("node_seq")).distinct()
    return tree.join(above, ["doc_id", "node_seq"], "left_semi")


def drop_empty(tree: DataFrame) -> DataFrame:
    """tree without nodes that have neither content nor a descendant with content."""
    full = tree.where("trim(coalesce(content, '')) != ''")
    keep = full.select("doc_id", "node_seq").unionByName(full.select("doc_id", F.explode("ancestors").alias("node_seq"))).distinct()
    return tree.join(keep, ["doc_id", "node_seq"], "left_semi")


#: Which of a node's states the reader shows, first wins.
DISPLAY_ORDER = ["expected-hit", "expected-miss", "retrieved", "kept", "pruned", "deferred", "error", "rejected", "internal", "neutral"]


def display_status(states: DataFrame) -> DataFrame:
    """(doc_id, node_seq, status): of several states of a node the one shown."""
    place = F.array_position(F.array(*[F.lit(s) for s in DISPLAY_ORDER]), F.col("status"))
    known = states.where(place > 0)
    return known.groupBy("doc_id", "node_seq").agg(F.min_by("status", place).alias("status"))


def parse_selection(batches: DataFrame, children: DataFrame) -> DataFrame:
    """(parent, node_id, reason, errored): what the replies (parent, batch, reply) keep of children (parent, batch, node_id).

    A reply lists ids, or objects with an id and a reason. An id of another batch of the same parent is taken as well, an unknown
    one is dropped. A reply that holds no list keeps its whole batch, as pruning on a failed call would lose content.
    """
    from leafline.functions.parsing import json_of
    from leafline.functions.text import clean_node_id

    parsed = batches.withColumn("__items", F.from_json(json_of(F.col("reply")), "array<string>"))
    item = F.col("__item")
    told = F.startswith(item, F.lit("{"))
    ids = F.when(told, F.get_json_object(item, "$.id")).otherwise(item)
    reason = F.coalesce(F.trim(F.when(told, F.get_json_object(item, "$.reason"))), F.lit(""))
    named = parsed.where("__items IS NOT NULL").select("parent", F.posexplode("__items").alias("__no", "__item"))
    named = named.select("parent", "__no", clean_node_id(ids).alias("node_id"), reason.alias("reason"))
    known = named.join(children.select("parent", "node_id").distinct(), ["parent", "node_id"])
    whole = children.join(parsed.where("__items IS NULL").select("parent", "batch"), ["parent", "batch"])
    failed = whole.select("parent", "node_id", F.lit(-1).alias("__no"), F.lit("Kept after a failed selection call").alias("reason"))
    both = known.select("parent", "node_id", "__no", "reason").unionByName(failed)
    return both.groupBy("parent", "node_id").agg(F.max_by("reason", "__no").alias("reason"), (F.max("__no") < 0).alias("errored"))

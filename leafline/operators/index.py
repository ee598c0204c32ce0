"""Incremental index: summaries are reused where the text, model and prompt they came from are unchanged."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafline.store import before, stored

FORMAT_VERSION = 2
PROMPT_VERSION = 2003


def stale_documents(meta: DataFrame) -> DataFrame:
    """Documents whose index is of an older format; one that can't be read counts as version 1."""
    version = F.coalesce(F.col("format_version").try_cast("int"), F.lit(1))
    return meta.where(version < FORMAT_VERSION).select("doc_id")


def changed_documents(new: DataFrame, old: DataFrame) -> DataFrame:
    """(doc_id, state) of documents by content hash: added, changed, unchanged or removed."""
    both = new.select("doc_id", F.col("sha256").alias("__new")).join(
        old.select("doc_id", F.col("sha256").alias("__old")), "doc_id", "full"
    )
    state = (
        F.when(F.col("__old").isNull(), F.lit("added"))
        .when(F.col("__new").isNull(), F.lit("removed"))
        .when(F.col("__new") == F.col("__old"), F.lit("unchanged"))
        .otherwise(F.lit("changed"))
    )
    return both.select("doc_id", state.alias("state"))


def fingerprint(files: DataFrame, width: int = 1024) -> DataFrame:
    """One row: a hash over the sorted names and hashes of all files (name, sha256), 32 hex digits.

    A tree of digests: each takes ``width`` neighbours in the order of names, then of those digests, until one is left. So no task
    sees more than ``width`` of them at a time, and how the table is partitioned does not matter. Names are distinct.
    """
    level = files.select(F.concat("name", "sha256").alias("text"), "name")
    ranked = before(level, [], [F.col("name")], F.lit(1), "rank").select("rank", "text")
    while True:
        listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"])
        grouped = ranked.groupBy(F.floor(F.col("rank") / width).alias("of")).agg(F.sha2(F.array_join(listed, ""), 256).alias("text"))
        ranked = stored(grouped.select(F.col("of").alias("rank"), "text"))
        if ranked.limit(2).count() < 2:
            break
    digest = F.coalesce(F.max("text"), F.sha2(F.lit(""), 256))
    return ranked.agg(F.substr(digest, F.lit(1), F.lit(32)).alias("fingerprint"))


def summary_inputs(level: DataFrame, below: DataFrame) -> DataFrame:
    """level with summary_input: a leaf's title and content, a section's title and its children's summaries."""
    label = F.when(F.col("synthetic"), F.lit("(section prose)")).otherwise(F.col("title"))
    bullets = below.select(
        "doc_id", F.col("parent_seq").alias("node_seq"), F.struct("node_seq", F.concat(F.lit("- "), label, F.lit(": "), "summary").alias("b")).alias("x")
    )
    listed = bullets.groupBy("doc_id", "node_seq").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["b"]), "\n").alias("__children")
    )
    own = F.when(F.col("is_leaf"), F.coalesce("content", F.lit(""))).otherwise(F.coalesce("__children", F.lit("")))
    return level.join(listed, ["doc_id", "node_seq"], "left").withColumn("summary_input", F.concat("title", F.lit("\n"), own)).drop("__children")


def summarise(
    tree: DataFrame, previous: DataFrame, summariser: Callable[[Column], Column], model: str, prompt_version: int = PROMPT_VERSION
) -> DataFrame:
    """tree (with depth) with summary, content_hash, summary_source, summary_model and summary_prompt_version.

    Levels go bottom-up, deepest first, at most seven of them. A model's earlier summary is reused where
    hash, model and prompt version agree; only the other rows reach the summariser. A section whose
    children's summaries came out the same is not summarised again.
    """
    prior = previous.where("summary_source = 'llm'").select(
        "doc_id", "node_id", "content_hash", "summary_model", "summary_prompt_version", F.col("summary").alias("__old")
    ).dropDuplicates(["doc_id", "node_id"])
    depths = [r["depth"] for r in tree.select("depth").distinct().orderBy(F.desc("depth")).collect()]  # seven at most
    done: DataFrame | None = None
    for depth in depths:
        level = tree.where(F.col("depth") == depth)
        below = done.where(F.col("depth") == depth + 1) if done is not None else level.limit(0).withColumn("summary", F.lit(""))
        hashed = summary_inputs(level, below).withColumn("content_hash", F.sha2("summary_input", 256))
        hashed = hashed.withColumn("summary_model", F.lit(model)).withColumn("summary_prompt_version", F.lit(prompt_version))
        joined = hashed.join(prior, ["doc_id", "node_id", "content_hash", "summary_model", "summary_prompt_version"], "left")
        fresh = joined.where("__old IS NULL").withColumn("summary", summariser(F.col("summary_input"))).withColumn("reused", F.lit(False))
        kept = joined.where("__old IS NOT NULL").withColumn("summary", F.col("__old")).withColumn("reused", F.lit(True))
        out = fresh.unionByName(kept).withColumn("summary_source", F.lit("llm")).drop("__old")
        out = stored(out)  # a model is asked once, and the plan of a level does not hold those of the levels below
        done = out if done is None else done.unionByName(out)
    return done if done is not None else tree

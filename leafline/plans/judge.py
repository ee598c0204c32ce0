"""Judgements as a table: a judge is a function of columns, and what it said is kept by the hash of what it read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafline.functions.text import tokenize
from leafline.operators.tree import section_texts

#: query, text -> struct<relevant boolean, reason string, quote string>
Judge = Callable[[Column, Column], Column]


def lexical_judge(share: float = 0.5) -> Judge:
    """The offline default: relevant if at least that share of the query's terms are in the text."""

    def judge(query: Column, text: Column) -> Column:
        asked = F.array_distinct(tokenize(query))
        both = F.array_intersect(asked, tokenize(text))
        fits = (F.size(asked) > 0) & (F.size(both) >= F.size(asked) * share)
        reason = F.concat(F.lit("shares "), F.size(both), F.lit(" of "), F.size(asked), F.lit(" terms"))
        return F.struct(fits.alias("relevant"), reason.alias("reason"), F.array_join(both, " ").alias("quote"))

    return judge


def input_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\u001f", *parts), 256)


def judged(rows: DataFrame, judge: Judge, kind: str, model: str, version: int, store: DataFrame | None = None) -> DataFrame:
    """rows (query, text, ...) with verdict and input_hash; only rows that the store lacks reach the judge.

    store is (kind, model, prompt_version, input_hash, verdict).
    """
    hashed = rows.withColumn("input_hash", input_hash(F.col("query"), F.col("text")))
    if store is None:
        return hashed.withColumn("verdict", judge(F.col("query"), F.col("text")))
    known = store.where((F.col("kind") == kind) & (F.col("model") == model) & (F.col("prompt_version") == version))
    known = known.select("input_hash", "verdict").dropDuplicates(["input_hash"])
    old = hashed.join(known, "input_hash")
    new = hashed.join(known, "input_hash", "left_anti").withColumn("verdict", judge(F.col("query"), F.col("text")))
    return old.unionByName(new)


def to_store(rows: DataFrame, kind: str, model: str, version: int) -> DataFrame:
    return rows.select(
        F.lit(kind).alias("kind"), F.lit(model).alias("model"), F.lit(version).alias("prompt_version"), "input_hash", "verdict"
    ).dropDuplicates(["input_hash"])


def explained(tree: DataFrame, queries: DataFrame, judge: Judge, limit: int = 4000) -> DataFrame:
    """(query_id, doc_id, node_seq, topic, addresses_query, reason): why nodes were not selected, from what they really say.

    tree has ancestors, queries are (query_id, query, doc_id, node_seq): a node that a reader asks about. The judge reads the node's
    section_texts; the topic is the node's title. A judge that gives null says no, with empty texts.
    """
    texts = section_texts(tree, limit)
    asked = queries.join(texts, ["doc_id", "node_seq"]).join(tree.select("doc_id", "node_seq", "title"), ["doc_id", "node_seq"])
    told = asked.withColumn("v", judge(F.col("query"), F.col("text")))
    topic = F.when(F.col("v").isNull(), F.lit("")).otherwise(F.col("title"))
    return told.select(
        "query_id", "doc_id", "node_seq", topic.alias("topic"), F.coalesce("v.relevant", F.lit(False)).alias("addresses_query"),
        F.coalesce("v.reason", F.lit("")).alias("reason"),
    )

"""Matching names, labels and returned ids to what the corpus has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafline.functions.text import normalise_file, quote_is_verbatim
from leafline.store import stored

#: Keys of needles up to which they are broadcast to the documents; more are joined by a shuffle.
BROADCAST_KEYS = 100_000


def match_documents(named: DataFrame, docs: DataFrame) -> DataFrame:
    """named (name) with doc_id: the first document whose normalised id equals, or ends with or is the end of, the name.

    Names are a stated, short list, so they are compared with all documents.
    """
    left = F.broadcast(named.select("name", normalise_file("name").alias("n")).distinct())
    right = docs.select("doc_id", normalise_file("doc_id").alias("d")).distinct()
    fits = right.join(left, F.endswith("d", "n") | F.endswith("n", "d")).where("n != '' AND d != ''")
    best = fits.groupBy("name").agg(F.min_by("doc_id", F.struct(F.col("n") != F.col("d"), "doc_id")).alias("doc_id"))
    return named.join(best, "name", "left")


def labels_by_page(labels: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, page, labels) of labels (name, page, label), and (name, n) of names that match no document."""
    matched = match_documents(labels, docs)
    found = matched.where("doc_id IS NOT NULL").groupBy("doc_id", "page").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    missing = matched.where("doc_id IS NULL").groupBy("name").agg(F.count("*").alias("n"))
    return found, missing


def scored_ids(returned: DataFrame, chunks: DataFrame, gold: DataFrame) -> DataFrame:
    """returned (query_id, pos, chunk_id, quote) with known, is_gold, same_document, verbatim and rank.

    chunks are (chunk_id, doc, body), gold (query_id, chunk_id, doc). Ids count once, where they come first;
    verbatim is null for an unknown chunk.
    """
    first = W.partitionBy("query_id", "chunk_id").orderBy("pos")
    once = returned.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    once = once.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("pos")))
    known = once.join(chunks, "chunk_id", "left")
    truth = gold.select("query_id", F.col("chunk_id").alias("__gold"), F.col("doc").alias("__doc"))
    return known.join(truth, "query_id", "left").select(
        "query_id",
        "chunk_id",
        "rank",
        F.col("doc").isNotNull().alias("known"),
        F.coalesce(F.col("chunk_id") == F.col("__gold"), F.lit(False)).alias("is_gold"),
        F.coalesce(F.col("doc") == F.col("__doc"), F.lit(False)).alias("same_document"),
        quote_is_verbatim("body", "quote").alias("verbatim"),
    )


def gold_rank(scored: DataFrame) -> DataFrame:
    """(query_id, rank): the first place of the gold chunk, null if it was not returned."""
    return scored.groupBy("query_id").agg(F.min(F.when(F.col("is_gold"), F.col("rank"))).alias("rank"))


def gold_map(pins: DataFrame, queries: DataFrame, tree: DataFrame) -> DataFrame:
    """(query_id, doc_id, target_leaf, section_level, problem) of queries (query_id, label, doc_id, node_id).

    pins are (doc_id, label, node_id). problem tells a label without a pin, with several, or
    with one that disagrees with the query; null if all is well.
    """
    from leafline.operators.tree import gold_leaves

    per = pins.groupBy("label").agg(F.countDistinct("doc_id", "node_id").alias("n"), F.first("node_id").alias("pinned"))
    joined = gold_leaves(tree, queries).join(per, "label", "left")
    problem = (
        F.when(F.col("n").isNull(), F.lit("label has no pin"))
        .when(F.col("n") > 1, F.lit("label has several pins"))
        .when(F.col("pinned") != F.col("node_id"), F.lit("pin disagrees with query"))
        .when(F.col("target_leaf").isNull(), F.lit("section has no prose of its own"))
    )
    return joined.select(
        "query_id", "doc_id", "target_leaf", (F.col("target_leaf") != F.col("node_id")).alias("section_level"), problem.alias("problem")
    )


def disambiguate(ids: DataFrame, nodes: DataFrame) -> DataFrame:
    """ids (id, node_id, preferred) with doc_id: the preferred document if it has the node, otherwise the first that has."""
    fits = ids.join(nodes.select("doc_id", "node_id").distinct(), "node_id", "left")
    order = F.struct(~F.coalesce(F.col("doc_id") == F.col("preferred"), F.lit(False)), "doc_id")
    return fits.groupBy("id", "node_id").agg(F.min_by("doc_id", order).alias("doc_id"))


def _candidates(docs: DataFrame, words: Column, keys: DataFrame) -> DataFrame:
    """(doc_id, item_id) of documents that have a key (item_id, word) among their words."""
    hint = F.broadcast if keys.count() <= BROADCAST_KEYS else (lambda df: df)
    return docs.select("doc_id", F.explode(F.array_distinct(words)).alias("word")).join(hint(keys), "word").select("doc_id", "item_id").distinct()


def _longest(words: Column) -> Column:
    """Words from the longest on, which are the rarest as a rule."""
    sized = F.transform(words, lambda w: F.struct(-F.char_length(w), w.alias("w")))
    return F.transform(F.array_sort(sized), lambda x: x["w"])


def contained(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) of docs (doc_id, body) whose body contains an item's needle (item_id, needle) as it stands.

    The inner words of a needle must be words of the body, so documents meet only items whose longest inner word they
    have. Needles of one or two words have none; they are compared with all documents, as a stated set of queries.
    Null bodies and needles contain nothing; an empty needle is in every body.
    """
    split = items.where("needle IS NOT NULL").withColumn("words", F.split("needle", " "))
    inner = F.slice("words", F.lit(2), F.greatest(F.size("words") - 2, F.lit(0)))
    keyed = split.withColumn("word", F.get(_longest(F.filter(inner, lambda w: w != "")), F.lit(0)))
    keys = stored(keyed.where("word IS NOT NULL").select("item_id", "word"))
    found = _candidates(docs, F.split("body", " "), keys)
    long = found.join(docs, "doc_id").join(items, "item_id").where(F.contains("body", "needle")).select("doc_id", "item_id")
    short = keyed.where("word IS NULL").select("item_id", "needle")
    return long.unionByName(docs.crossJoin(short).where(F.contains("body", "needle")).select("doc_id", "item_id"))


def mentioned(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) of docs (doc_id, h) that have at least half of an item's distinct words (item_id, n).

    Words are dealt by document once, and what each document shares with an item is counted there. The work is the number of shared
    words of all pairs, so it grows with the documents for a stated set of items.
    """
    told = items.where(F.size("n") > 0).withColumn("item", F.monotonically_increasing_id())  # before the words are spread
    spread = stored(told.select("item", "item_id", F.size("n").alias("k"), F.explode("n").alias("word")))
    hint = F.broadcast if spread.count() <= BROADCAST_KEYS else (lambda df: df)
    rows = docs.repartition("doc_id").select("doc_id", F.monotonically_increasing_id().alias("row"), "h")  # rows of one doc_id stay apart
    words = rows.select("doc_id", "row", F.explode(F.array_distinct("h")).alias("word"))
    shared = words.join(hint(spread), "word").groupBy("doc_id", "row", "item", "item_id", "k").agg(F.count("*").alias("both"))
    return shared.where(2 * F.col("both") >= F.col("k")).select("doc_id", "item_id")

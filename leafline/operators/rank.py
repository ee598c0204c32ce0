"""Okapi BM25 over any candidates.

Statistics are those of the rows passed in, or of each partition if a scope is named:
the whole corpus, the dropped leaves of one document or the surviving candidates. Terms
are exploded only where they occur in a query; lengths come from the term arrays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafline.functions.text import tokenize
from leafline.store import before, stored

K1, B = 1.5, 0.75
#: Scores that agree to so many places are ties: sums depend on the order of their terms.
PLACES = 9
#: Query terms up to which they are broadcast to the candidates; more are joined by a shuffle.
BROADCAST_TERMS = 100_000


def terms(items: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, term, tf) of every term of every item."""
    return items.select(*key, F.explode(tokenize(text)).alias("term")).groupBy(*key, "term").agg(F.count("*").alias("tf"))


def scores(
    items: DataFrame, queries: DataFrame, key: list[str], text: str, scope: list[str] | None = None
) -> DataFrame:
    """(query_id, scope, key, score) for each item that shares a term with a query.

    items need the columns of key, scope and text; queries are (query_id, query). A term that
    a query repeats counts as often. An item's length is its number of terms.
    """
    scope = scope or []
    own = list(dict.fromkeys([*scope, *key]))
    asked = queries.select("query_id", F.explode(tokenize("query")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qn"))
    asked = stored(asked)
    hint = F.broadcast if asked.count() <= BROADCAST_TERMS else (lambda df: df)
    # each item also carries one mark, the empty term, so that one pass over the texts gives lengths and counts
    wanted = asked.select("term").distinct().unionByName(items.sparkSession.createDataFrame([("",)], "term string"))
    listed = items.select(*own, F.explode(F.array(tokenize(text))).alias("__terms"))
    sized = listed.select(*own, F.size("__terms").alias("__dl"), F.explode(F.array_append("__terms", F.lit(""))).alias("term"))
    tf = stored(sized.join(hint(wanted), "term").groupBy(*own, "__dl", "term").agg(F.count("*").alias("tf")))
    marks, tf = tf.where("term = ''"), tf.where("term != ''")
    totals = marks.groupBy(*scope).agg(F.sum("tf").alias("__n"), (F.sum(F.col("__dl") * F.col("tf")) / F.sum("tf")).alias("__avgdl"))
    df = tf.groupBy(*scope, "term").agg(F.count("*").alias("df"))
    joined = tf.join(hint(df) if not scope else df, [*scope, "term"])
    joined = joined.join(totals, scope) if scope else joined.crossJoin(F.broadcast(totals))  # one row of totals
    idf = F.log1p((F.col("__n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("__dl") / F.col("__avgdl")))
    weighed = joined.select(*own, "term", weight.alias("__weight"))  # once for each item and term, not for each query that has it
    return weighed.join(hint(asked), "term").groupBy("query_id", *own).agg(F.sum(F.col("__weight") * F.col("qn")).alias("score"))


def ranked(
    items: DataFrame, queries: DataFrame, key: list[str], text: str, order: list[str], scope: list[str] | None = None
) -> DataFrame:
    """(query_id, scope, key, order, score, rank) of every item for every query, 0 without a common term; ties in the given order.

    Ranks count from 0. Rows are slim and dealt by ranges of the score, so no task holds a whole query.
    """
    scope = scope or []
    own = list(dict.fromkeys([*scope, *key]))
    found = scores(items, queries, key, text, scope)
    # a stated set of queries against all candidates is what a ranking is
    base = items.select(*dict.fromkeys([*own, *order])).crossJoin(F.broadcast(queries.select("query_id")))
    joined = base.join(found, ["query_id", *own], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    place = [F.desc(F.round("score", PLACES)), *[F.col(c) for c in order]]
    return before(joined, ["query_id", *scope], place, F.lit(1), "rank").withColumn("rank", F.col("rank").cast("int"))


def top(items: DataFrame, queries: DataFrame, key: list[str], text: str, k: int, scope: list[str] | None = None) -> DataFrame:
    """(query_id, scope, key, score, rank) of the k best with a score; ties by key. Each task keeps its own k best first."""
    scope = scope or []
    place = W.partitionBy("query_id", *scope).orderBy(F.desc(F.round("score", PLACES)), *key)
    found = scores(items, queries, key, text, scope).where("score > 0")
    best = found.withColumn("__nth", F.row_number().over(place)).where(F.col("__nth") <= k)
    return best.withColumn("rank", F.col("__nth") - 1).drop("__nth")


def rescue(dropped: DataFrame, queries: DataFrame, key: list[str], text: str, most: int = 5) -> DataFrame:
    """The best dropped leaves of each document, by statistics of that document's dropped leaves."""
    return top(dropped, queries, key, text, most, ["doc_id"])

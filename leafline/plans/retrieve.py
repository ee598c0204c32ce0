"""Question to numbered sources: filter, prune, rescue, rank, judge within a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafline.functions.text import leaf_cost, ranking_text
from leafline.operators.budget import MAX_EVALS, budget_scan
from leafline.operators.prune import survivors
from leafline.operators.rank import ranked, rescue
from leafline.plans.judge import Judge, lexical_judge
from leafline.store import stored

#: Leaves that are judged before the budget is looked at again.
EVAL_BLOCK = 100
#: Keys of leaves to be judged up to which they are broadcast to the texts; more are joined by a shuffle.
BROADCAST_BEST = 100_000


def select_sections(tree: DataFrame, query: Column, judge: Judge) -> DataFrame:
    """(doc_id, node_seq, reason) of the nodes the judge keeps by title and summary; content is not read."""
    verdict = judge(query, F.concat_ws("\n", "title", F.coalesce("summary", F.lit(""))))
    return tree.withColumn("__v", verdict).where("__v.relevant").select("doc_id", "node_seq", F.col("__v.reason").alias("reason"))


def retrieve(
    tree: DataFrame, queries: DataFrame, budget: int, judge: Judge | None = None, selected: DataFrame | None = None,
    per_document: bool = False, most_rescued: int = 5, max_evals: int = MAX_EVALS,
) -> DataFrame:
    """(query_id, doc_id, node_seq, node_id, status, reason, rank, score, rehydrated, judged_relevant, source_no).

    tree has title, summary, content, is_leaf, depth and ancestors. One query at a time is pruned
    if ``selected`` is given (doc_id, node_seq, reason), otherwise all leaves are candidates. Leaves that pruning
    dropped come back if they are among the best of their document. Ranks and the budget
    span the corpus, or each document; what comes after the budget's end or max_evals is deferred and not judged. Sources are numbered in tree order.
    """
    judge = judge or lexical_judge()
    key = ["doc_id", "node_seq"]
    leaves = tree.where("is_leaf").withColumn("text", ranking_text("title", "summary", "content"))
    gone = None
    if selected is None:
        slim = leaves.select(*key, "node_id", F.lit(False).alias("rehydrated"))
    else:
        walked = survivors(tree, selected).where("is_leaf").select(*key, "node_id", F.col("status").alias("walk"), F.col("reason").alias("walk_reason"))
        walked = stored(walked)
        dropped = walked.where("walk = 'pruned'").select(*key)
        back = rescue(leaves.join(dropped, key, "left_semi"), queries, key, "text", most_rescued).select(*key).distinct().withColumn("rehydrated", F.lit(True))
        walked = stored(walked.join(back, key, "left").withColumn("rehydrated", F.coalesce("rehydrated", F.lit(False))))
        slim, gone = walked.where("walk IS NULL OR rehydrated"), walked.where("walk = 'pruned' AND NOT rehydrated")
        leaves = leaves.join(slim.select(*key), key, "left_semi")
    scope = ["doc_id"] if per_document else []

    by = ["query_id", *scope]
    listed = stored(ranked(leaves, queries, key, "text", key, scope).select("query_id", *key, "rank", "score"))
    best = listed.where(F.col("rank") < max_evals).select("query_id", *key, "rank")
    best = F.broadcast(best) if best.count() <= BROADCAST_BEST else best
    texts = stored(leaves.select(*key, "title", "content", "text").join(best, key))  # only what may be judged is copied
    scanned = budget_scan(_judged(texts, queries, key, judge, by, budget, max_evals), budget, by=by, max_evals=max_evals)
    scanned = scanned.select("query_id", *key, "status", F.col("v.reason").alias("reason"), "judged_relevant")
    named = listed.join(slim.select(*key, "node_id", "rehydrated"), key).join(scanned, ["query_id", *key], "left")
    status = F.coalesce("status", F.lit("deferred"))
    verdicts = named.select(
        "query_id", *key, "node_id", status.alias("status"), F.when(status != "deferred", F.col("reason")).alias("reason"), "rank",
        F.round("score", 4).alias("score"), "rehydrated", F.coalesce("judged_relevant", F.lit(False)).alias("judged_relevant"),
    )
    if gone is not None:
        lost = gone.crossJoin(F.broadcast(queries.select("query_id"))).select(
            "query_id", *key, "node_id", F.lit("pruned").alias("status"), F.col("walk_reason").alias("reason"),
            F.lit(None).cast("int").alias("rank"), F.lit(None).cast("double").alias("score"), F.lit(False).alias("rehydrated"),
            F.lit(False).alias("judged_relevant"),
        )
        verdicts = verdicts.unionByName(lost)
    verdicts = stored(verdicts)
    # sources are few: what a budget holds
    order = W.partitionBy("query_id").orderBy(*key)
    sources = verdicts.where("status = 'retrieved'").select("query_id", *key, F.row_number().over(order).alias("source_no"))
    return verdicts.join(sources, ["query_id", *key], "left")


def _judged(
    texts: DataFrame, queries: DataFrame, key: list[str], judge: Judge, by: list[str], budget: int, max_evals: int
) -> DataFrame:
    """The best leaves (query_id, key, rank, title, content, text) with v, relevant and cost, judged a block of ranks at a time until each budget is passed.

    What the judge says is stored, so it is asked once about a leaf, and not about leaves behind the end of a budget. At most
    max_evals leaves of a query are judged.
    """
    out, still = None, None
    for first in range(0, max_evals, EVAL_BLOCK):
        block = texts.where((F.col("rank") >= first) & (F.col("rank") < min(first + EVAL_BLOCK, max_evals)))
        block = block if still is None else block.join(still, by, "left_semi")
        said = block.join(F.broadcast(queries.select("query_id", "query")), "query_id")
        said = said.withColumn("v", judge(F.col("query"), F.col("text"))).withColumn("cost", leaf_cost("title", "content"))
        said = stored(said.select("query_id", *key, "rank", "v", F.col("v.relevant").alias("relevant"), "cost"))
        out = said if out is None else out.unionByName(said)
        used = out.groupBy(*by).agg(F.sum(F.when(F.col("relevant"), F.col("cost"))).alias("used"), F.max("rank").alias("last"))
        still = used.where((F.coalesce("used", F.lit(0)) <= budget) & (F.col("last") == first + EVAL_BLOCK - 1)).select(*by)
        if still.isEmpty():
            break
    return out


def passages(sources: DataFrame) -> DataFrame:
    """(query_id, passages): numbered passages of (query_id, source_no, doc, breadcrumb, excerpt) as one prompt text."""
    block = F.concat(
        F.lit("["), F.col("source_no"), F.lit("] "), F.replace("doc", F.lit("_"), F.lit(" ")), F.lit(" › "), "breadcrumb", F.lit("\n"),
        F.coalesce(F.nullif("excerpt", F.lit("")), F.lit("(no content)")),
    )
    listed = F.transform(F.array_sort(F.collect_list(F.struct("source_no", block.alias("b")))), lambda x: x["b"])
    return sources.groupBy("query_id").agg(F.array_join(listed, "\n\n").alias("passages"))


def template_answer(sources: DataFrame) -> DataFrame:
    """(query_id, answer): a deterministic answer in place of a model's, which cites every source."""
    cites = F.transform(F.array_sort(F.collect_list("source_no")), lambda n: F.concat(F.lit("["), n, F.lit("]")))
    return sources.groupBy("query_id").agg(
        F.concat(
            F.lit("SHORT_ANSWER: See "), F.array_join(cites, ""), F.lit(".\nEVIDENCE_SUFFICIENT: yes\nSTILL_NEEDED:")
        ).alias("answer")
    )

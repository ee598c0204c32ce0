"""Multiple-choice judgements of leaves, kept by content hash, as filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANY, ALL = "any", "all"


def normalise_mode(mode: str | None) -> str:
    return mode if mode in (ANY, ALL) else ANY


def trusted(facets: DataFrame, model: str, key: str) -> DataFrame:
    """Judgements of this model and question set only; others count as never made."""
    return facets.where((F.col("model") == model) & (F.col("key") == key))


def _judged(facets: DataFrame) -> DataFrame:
    """(leaf_hash, judgements): one row for each judged hash, a map of question to answers."""
    pairs = F.collect_list(F.struct("question_id", F.coalesce("answer_ids", F.array().cast("array<string>")).alias("a")))
    return facets.dropDuplicates(["leaf_hash", "question_id"]).groupBy("leaf_hash").agg(F.map_from_entries(pairs).alias("judgements"))


def select_leaves(
    leaves: DataFrame, facets: DataFrame, selected: list[str], questions: dict[str, list[str]], mode: str | None = ANY
) -> DataFrame:
    """leaves (with leaf_hash) and kept, unjudged and matched, the selected answers each was judged to fit.

    Without a selection all are kept. A leaf never judged is kept and flagged. ANY keeps a leaf
    that fits any selected answer. ALL asks for one of the selected answers of each question; a question
    the leaf was not asked passes, an answer of no known question never does.
    """
    joined = leaves.join(_judged(facets), "leaf_hash", "left")
    unjudged = F.col("judgements").isNull()
    none = F.array().cast("array<string>")
    wanted = F.array(*[F.lit(s) for s in selected]).cast("array<string>")
    hit = F.coalesce(F.array_distinct(F.flatten(F.map_values("judgements"))), none)
    matched = F.array_sort(F.array_intersect(hit, wanted)) if selected else F.array_sort(hit)
    owner = {a: q for q, answers in questions.items() for a in answers}
    groups: dict[str, list[str]] = {}
    for answer in selected:
        groups.setdefault(owner.get(answer, answer), []).append(answer)
    if not selected:
        kept: Column = F.lit(True)
        unjudged = F.lit(False)
    elif normalise_mode(mode) == ANY:
        kept = unjudged | F.arrays_overlap(hit, wanted)
    else:
        fits = F.lit(True)
        for question, answers in groups.items():
            stored = F.element_at("judgements", question)
            overlap = F.arrays_overlap(stored, F.array(*[F.lit(a) for a in answers]))
            fits = fits & F.when(stored.isNull(), F.lit(question in questions)).otherwise(F.coalesce(overlap, F.lit(False)))
        kept = unjudged | fits
    return (
        joined.withColumn("kept", kept).withColumn("unjudged", unjudged).withColumn("matched", matched).drop("judgements")
    )


def pending(leaves: DataFrame, facets: DataFrame, questions: DataFrame) -> DataFrame:
    """(leaf_hash, question_id) still to be judged: leaves by questions (a stated, short list) less what is stored."""
    asked = leaves.select("leaf_hash").distinct().crossJoin(F.broadcast(questions.select("question_id").distinct()))
    return asked.join(facets.select("leaf_hash", "question_id"), ["leaf_hash", "question_id"], "left_anti")


def coverage(leaves: DataFrame, facets: DataFrame, model: str, key: str) -> DataFrame:
    """(doc_id, state, leaves, judged): missing, stale, partial or ready for each document.

    A document is missing without any judgement, and stale if all that it has are of
    another model or question set.
    """
    known = facets.groupBy("leaf_hash").agg(F.max((F.col("model") == model) & (F.col("key") == key)).alias("valid"))
    per = leaves.join(known, "leaf_hash", "left").groupBy("doc_id").agg(
        F.count("*").alias("leaves"),
        F.count_if(F.coalesce("valid", F.lit(False))).alias("judged"),
        F.count("valid").alias("stored"),
    )
    state = (
        F.when(F.col("stored") == 0, F.lit("missing"))
        .when(F.col("judged") == 0, F.lit("stale"))
        .when(F.col("judged") >= F.col("leaves"), F.lit("ready"))
        .otherwise(F.lit("partial"))
    )
    return per.select("doc_id", state.alias("state"), "leaves", "judged")


def drop_stale(facets: DataFrame, leaves: DataFrame) -> DataFrame:
    """Judgements of live leaves only."""
    return facets.join(leaves.select("leaf_hash").distinct(), "leaf_hash", "left_semi")


def payload(selected: DataFrame) -> DataFrame:
    """One row of facts of a selection: kept, total, unjudged, documents left out."""
    per = selected.groupBy("doc_id").agg(
        F.count_if("kept").alias("kept"), F.count("*").alias("total"), F.count_if("unjudged").alias("unjudged")
    )
    return per.agg(
        F.sum("kept").alias("kept"),
        F.sum("total").alias("total"),
        F.sum("unjudged").alias("unjudged"),
        F.count_if(F.col("kept") == 0).alias("excluded_docs"),
        F.count_if(F.col("unjudged") == F.col("total")).alias("unfiltered_docs"),
    )

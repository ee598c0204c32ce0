"""What a run's report is made of, and the small joins around it: arms, baselines, transitions, cases, listings."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafline.functions.text import key_words, normalise_title, numbers, strip
from leafline.store import stored

# Outcomes that a budget may have cut short, and those that a baseline's rank explains.
CENSORED = ["deferred", "deferred_judged_relevant"]
EXPLAINED = ["pruned", "rejected", "deferred"]
#: Least score of a sentence that settles a citation, and the pages around the cited one that count as near.
SURE, NEAR = 8, 1
#: Questions that a chunk meets at once, and runs of letters that a batch keeps in mind.
ASKED, MOST_RUNS = 2_000, 500_000


def capped_by(runs: DataFrame) -> DataFrame:
    """(capped_by, n) of runs (capped_by); none where nothing cut a run short."""
    return runs.groupBy(F.coalesce("capped_by", F.lit("none")).alias("capped_by")).agg(F.count("*").alias("n"))


def raised_arm(main: DataFrame, raised: DataFrame) -> DataFrame:
    """(gold_outcome, n, recovered) of the main arm's deferred queries (id, gold_outcome) when run again with the cap raised."""
    deferred = main.where(F.col("gold_outcome").isin(*CENSORED)).select("id")
    after = raised.select("id", "gold_outcome").join(deferred, "id", "left_semi")
    return after.groupBy("gold_outcome").agg(F.count("*").alias("n")).withColumn("recovered", F.col("gold_outcome") == "retrieved")


def baseline_ranks(records: DataFrame, baseline: DataFrame) -> DataFrame:
    """(gold_outcome, n, median_rank): where a ranking over the whole corpus (id, gold_rank) has the gold that a run lost."""
    lost = records.where(F.col("gold_outcome").isin(*EXPLAINED)).select("id", "gold_outcome")
    ranked = lost.join(baseline.where("gold_rank > 0").select("id", "gold_rank"), "id")
    return ranked.groupBy("gold_outcome").agg(F.count("*").alias("n"), F.median("gold_rank").alias("median_rank"))


def system_recall(records: DataFrame) -> DataFrame:
    """One row (n, recall) over the records whose outcome no budget censored."""
    known = records.where(~F.col("gold_outcome").isin(*CENSORED))
    return known.agg(F.count("*").alias("n"), F.round(F.avg(F.col("gold_retrieved").cast("int")), 4).alias("recall"))


def transitions(drift: DataFrame) -> DataFrame:
    """(label_a, label_b, same_set, n) of paired edits."""
    return drift.groupBy("label_a", "label_b", "same_set").agg(F.count("*").alias("n"))


def forced_floor(answers: DataFrame) -> DataFrame:
    """(label, n, passed, grounded) of answers (label, passed, grounding_status) to passages that were forced on them."""
    return answers.groupBy("label").agg(
        F.count("*").alias("n"), F.count_if("passed").alias("passed"), F.count_if(F.col("grounding_status") == "grounded").alias("grounded")
    )


def eligible(leaves: DataFrame, content: str = "content", least: int = 80) -> DataFrame:
    """Leaves with prose enough to be asked about."""
    return leaves.where(F.char_length(strip(content)) >= least)


def deferred_before(queries: DataFrame, prior: DataFrame) -> DataFrame:
    """The queries (id) whose gold an earlier run (id, gold_outcome) deferred."""
    return queries.join(prior.where(F.col("gold_outcome").isin(*CENSORED)).select("id"), "id", "left_semi")


def near_page(pages: Column, page: Column, window: int = NEAR) -> Column:
    """Is any of the pages within the window around a page?"""
    return F.exists(pages, lambda p: F.abs(p - page) <= window)


class _Questions:
    """Questions as parts, one string for each: what a text's sentences score for them."""

    def __init__(self, asked: str) -> None:
        listed = [q.split() for q in asked.split("\n")]
        self.at = {p: i for i, p in enumerate(sorted({p for q in listed for p in q}))}
        self.lengths = sorted({len(p) for p in self.at})
        self.weights = np.zeros((len(self.at), len(listed)), np.int32)
        for n, q in enumerate(listed):
            for p in q:
                self.weights[self.at[p], n] = 5 if p[0].isdigit() else 1
        self.known: dict[str, list[int]] = {}

    def held(self, run: str) -> list[int]:
        """The parts that lie in a run of letters or of digits and points."""
        if run not in self.known:
            if len(self.known) > MOST_RUNS:
                self.known.clear()
            cut = {run[i : i + n] for n in self.lengths for i in range(len(run) - n + 1)}
            self.known[run] = [self.at[c] for c in cut if c in self.at]
        return self.known[run]

    def best(self, text: str) -> np.ndarray:
        """For each question the score of the best sentence, the first of those, times 2^32, plus its number."""
        split = re.split(r"(?<=[.;:])[ \t\n\x0B\f\r]+", text)
        digit = [2 if re.search("[0-9]", s) else 0 for s in split]
        found = {(no, p) for no, s in enumerate(split) for run in set(re.findall(r"[a-z]+|[0-9.]+", s)) for p in self.held(run)}
        scores = np.repeat(np.array(digit, np.int32)[:, None], self.weights.shape[1], axis=1)
        if found:
            places = np.array(list(found))
            np.add.at(scores, places[:, 0], self.weights[places[:, 1]])
        no = scores.argmax(axis=0)
        return (scores[no, np.arange(len(no))].astype(np.int64) << 32) + no


@F.pandas_udf(T.ArrayType(T.LongType()))
def _best_sentences(bodies: pd.Series, asked: pd.Series) -> pd.Series:
    """_Questions.best of lower-cased texts."""
    told = {q: _Questions(q) for q in asked.unique()}
    return pd.Series([told[q].best(b) for b, q in zip(bodies, asked, strict=True)])


def sentence_verdicts(asked: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, verdict, chunk_id, score) of asked (id, doc, question, page) among the chunks (doc, chunk_id, pages, body) of its document.

    A sentence scores 5 for each number and 1 for each key word of the question that is in it, and 2 for any digit. OK: a sentence
    near the cited page is sure. Otherwise the best one anywhere is WEAK if its chunk is near the page and OFFPAGE if not; NONE
    without any. Ties go to the first chunk and sentence.

    A chunk meets its document's questions in blocks of some ASKED. A part of a question lies within a run of letters or of digits
    and points; which parts a run holds is looked up once for each run in a batch.
    """
    parts = F.concat_ws(" ", numbers("question"), key_words("question"))
    blocks = F.pmod(F.xxhash64("id"), F.lit(1 + asked.count() // ASKED))
    listed = asked.groupBy("doc", blocks.alias("block")).agg(F.collect_list(F.struct("id", "page", F.coalesce(parts, F.lit("")).alias("parts"))).alias("of"))
    named = stored(listed.select("doc", "of", F.array_join(F.transform("of", lambda x: x["parts"]), "\n").alias("asked")))
    met = chunks.where("body IS NOT NULL").select("doc", "chunk_id", "pages", F.lower("body").alias("body")).join(named, "doc")
    found = met.select("chunk_id", "pages", "of", _best_sentences("body", "asked").alias("found"))
    each = found.select("chunk_id", "pages", F.explode(F.arrays_zip("of", "found")).alias("x")).select("chunk_id", "pages", "x.of.id", "x.of.page", "x.found")
    scored = each.select("id", "page", "chunk_id", "pages", F.shiftright("found", 32).cast("int").alias("score"), F.col("found").bitwiseAND(F.lit(0xFFFFFFFF)).alias("no"))
    both = scored.where("score > 0").withColumn("near", near_page(F.col("pages"), F.col("page")))
    order = F.struct(-F.col("score"), "chunk_id", "no")
    best = both.groupBy("id").agg(
        F.min_by(F.struct("chunk_id", "score", "near"), order).alias("any"),
        F.min_by(F.struct("chunk_id", "score"), F.when(F.col("near"), order)).alias("close"),
    )
    sure = F.coalesce(F.col("close.score") >= SURE, F.lit(False))
    verdict = (
        F.when(F.col("any").isNull(), F.lit("NONE")).when(sure, F.lit("OK")).when(F.col("any.near"), F.lit("WEAK")).otherwise(F.lit("OFFPAGE"))
    )
    of = lambda c: F.when(sure, F.col(f"close.{c}")).otherwise(F.col(f"any.{c}"))
    return asked.select("id").join(best, "id", "left").select(
        "id", verdict.alias("verdict"), of("chunk_id").alias("chunk_id"), F.coalesce(of("score"), F.lit(0)).alias("score")
    )


def retrieval_ratio(leaves: DataFrame) -> DataFrame:
    """(doc_id, leaves, retrieved, percent) of leaves (doc_id, retrieved); halves round up."""
    per = leaves.groupBy("doc_id").agg(F.count("*").alias("leaves"), F.count_if("retrieved").alias("retrieved"))
    return per.withColumn("percent", F.floor(100 * F.col("retrieved") / F.col("leaves") + 0.5))


def deferred_listing(verdicts: DataFrame, by: list[str]) -> DataFrame:
    """Deferred rows with place, from 1 by rank; those without a rank come last."""
    place = F.row_number().over(W.partitionBy(*by).orderBy(F.asc_nulls_last("rank"), "node_id"))
    return verdicts.where("status = 'deferred'").withColumn("place", place)


def worst(ranked: DataFrame, n: int = 8) -> DataFrame:
    """The n rows of the largest rank."""
    return ranked.orderBy(F.desc("rank"), "id").limit(n)


def kept_runs(runs: DataFrame, n: int = 32) -> DataFrame:
    """The n newest runs (run_id, started); older ones leave the registry."""
    return runs.orderBy(F.desc("started"), "run_id").limit(n)


def find_breadcrumb(tree: DataFrame, title: str) -> DataFrame:
    """(doc_id, breadcrumb) of each document's first node whose normalised title is that of the given one."""
    same = normalise_title("title") == normalise_title(F.lit(title))
    return tree.where(same).groupBy("doc_id").agg(F.min_by("breadcrumb", "node_seq").alias("breadcrumb"))


def inherited_status(tree: DataFrame, statuses: DataFrame) -> DataFrame:
    """(doc_id, node_seq, status) of every node of tree (with ancestors): retrieved, rejected or pruned as it or any ancestor is, in that order."""
    order = ["retrieved", "rejected", "pruned", "pending"]
    chain = tree.select("doc_id", F.col("node_seq").alias("of"), F.explode(F.array_append("ancestors", F.col("node_seq"))).alias("node_seq"))
    place = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in order]), F.col("status")), F.lit(len(order)))
    least = chain.join(statuses.select("doc_id", "node_seq", "status"), ["doc_id", "node_seq"], "left").groupBy("doc_id", "of").agg(
        F.min(F.when(place == 0, len(order)).otherwise(place)).alias("p")
    )
    return least.select("doc_id", F.col("of").alias("node_seq"), F.element_at(F.array(*[F.lit(s) for s in order]), F.col("p").cast("int")).alias("status"))


def legacy_manifest(old: DataFrame) -> DataFrame:
    """Manifest rows of an old registry (stem, pdf, module): the stem is the id, there are no tags."""
    pdf = F.coalesce("pdf", F.lit(""))
    none = F.array().cast("array<string>")
    return old.select(
        F.col("stem").alias("doc_id"), F.col("stem").alias("title"), pdf.alias("source_path"), none.alias("tags"), none.alias("manual_tags"),
        F.when(pdf == "", F.concat("stem", F.lit(".md"))).otherwise(F.element_at(F.split(pdf, "/"), -1)).alias("rel_path"),
        F.coalesce("module", F.lit("")).alias("ingest_module"),
    )


def manifest_of(new: DataFrame | None, old: DataFrame) -> DataFrame:
    """The manifest; the old registry is read only where there is none."""
    return legacy_manifest(old) if new is None else new


def unindexed(stems: DataFrame, indexed: DataFrame) -> DataFrame:
    """Stems of source files without an index; the index is stale unless this is empty."""
    return stems.select("stem").distinct().join(indexed.select("stem"), "stem", "left_anti")


def cases(a: DataFrame, b: DataFrame, c: DataFrame) -> DataFrame:
    """A rows (id, ...) with b and c, structs of the B and C row that name them as pair_id; null where there is none."""
    one = lambda rows, name: rows.groupBy("pair_id").agg(F.max_by(F.struct(*[x for x in rows.columns if x != "pair_id"]), "id").alias(name)).withColumnRenamed("pair_id", "id")
    return a.join(one(b, "b"), "id", "left").join(one(c, "c"), "id", "left")


def replay(verdicts: DataFrame, run: str, into: str) -> DataFrame:
    """A finished run's verdicts as the events of a fresh run, in their order."""
    return verdicts.where(F.col("run_id") == run).withColumn("run_id", F.lit(into)).orderBy("ts", "node_id")


def report_lines(title: str, facts: DataFrame, label: str, value: str) -> DataFrame:
    """(line_no, line) of a report's section in Markdown: a heading, an empty line and a bullet for each of a few facts."""
    listed = F.array_sort(F.collect_list(F.concat(F.lit("- "), F.col(label).cast("string"), F.lit(": "), F.col(value).cast("string"))))
    lines = facts.agg(F.concat(F.array(F.lit(f"## {title}"), F.lit("")), listed).alias("lines"))
    return lines.select(F.posexplode("lines").alias("line_no", "line"))


def prompt_files(prompts: DataFrame) -> DataFrame:
    """(name, prompt, sha256) of prompts (id, prompt), one file for each."""
    return prompts.select(F.concat("id", F.lit(".txt")).alias("name"), "prompt", F.sha2("prompt", 256).alias("sha256"))


def suggestions(cases: DataFrame, text: str = "", group: str | None = None, n: int = 8) -> DataFrame:
    """The first n of cases (id, pos, question, category) whose question has the text or whose id is it, of one category if given."""
    q = F.lit(text.strip().lower())
    fits = (q == "") | F.contains(F.lower("question"), q) | (F.lower("id") == q)
    return cases.where(fits & (F.lit(True) if group is None else F.col("category") == group)).orderBy("pos", "id").limit(n)


def evidence_groups(messages: DataFrame) -> DataFrame:
    """(chat_id, answer_id, label, query, status, n_sources) of a chat's answers: messages (chat_id, pos, id, role, query, status, sources).

    Answers without an id don't count; those without sources do.
    """
    answers = messages.where("role = 'assistant' AND id IS NOT NULL")
    nth = F.row_number().over(W.partitionBy("chat_id").orderBy("pos"))
    return answers.select(
        "chat_id", F.col("id").alias("answer_id"), F.concat(F.lit("Answer "), nth).alias("label"), "query",
        F.coalesce("status", F.lit("not_connected")).alias("status"), F.coalesce(F.size("sources"), F.lit(0)).alias("n_sources"),
    )


def preflight(state: dict, allow_busy: bool = False) -> list[str]:
    """What speaks against a measured run: a stale index, no fingerprint, the sufficiency check turned off, another run."""
    problems = [f"index is stale for {state['stale_docs']}"] if state.get("stale_docs") else []
    problems += [] if state.get("fingerprint") else ["index has no fingerprint"]
    problems += [] if state.get("completeness_check", True) else ["completeness check is off"]
    return problems + (["another run is under way"] if state.get("busy") and not allow_busy else [])

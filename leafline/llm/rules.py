"""Quality rules with host-level verdicts, in DataFrame functions only.

Each document is measured in one pass without a shuffle of text. Failures are then
counted by host with map-side combining, each host's rate is shrunk towards the rate of
all hosts with a beta prior whose two parameters come from the hosts' own mean and
variance, and the verdict on the host is joined back to the measured rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafline.llm.common import SPACE, checkpointed, table, words

MIN_WORDS = 20
WINDOW = 8
#: Percent of a text's words that may lie in repeated windows.
MAX_REPEAT = 30
#: Percent of symbols to words, and of repeated to all lines, over which a document counts against its host.
MAX_SYMBOLS = 10
MAX_DUP_LINES = 30
#: A host is rejected if its shrunken failure rate is above this.
MAX_HOST_RATE = 0.5
#: Bounds of the prior's weight, in documents.
PRIOR_WEIGHT = (1.0, 10_000.0)
#: Hosts up to which their verdicts are broadcast (some 5 MB); beyond it they are joined by a shuffle.
BROADCAST_HOSTS = 100_000


def measures(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """(doc_id, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words) per row.

    A null text has no words, symbols or lines. A line counts if it has a word.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    split = docs.select("doc_id", F.col(host).alias("host"), body.alias("body"), words(F.col(text)).alias("w"))
    lines = F.filter(F.split("body", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    starts = F.when(F.size("w") >= WINDOW, F.sequence(F.lit(0), F.size("w") - WINDOW)).otherwise(
        F.array().cast("array<int>")
    )
    hashed = F.transform(starts, lambda i: F.xxhash64(F.slice("w", i + 1, F.lit(WINDOW))))
    first = split.select(
        "doc_id",
        "host",
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("body", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        hashed.alias("h"),
    )
    second = first.select(
        "doc_id",
        "host",
        "n_words",
        "word_chars",
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.size(F.array_distinct("h")) < F.size("h"),
            F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i")))),
        ).alias("s"),
    )
    return second.withColumn("n_repeat_words", F.when(F.col("s").isNull(), F.lit(0)).otherwise(_covered("s"))).drop("s")


def _covered(sorted_windows: str) -> Column:
    """Words inside windows whose hash occurs again, from the windows sorted by hash."""

    def twin(x: Column, j: Column) -> Column:
        hash_at = lambda k: F.get(F.col(sorted_windows), k)["x"]
        return F.coalesce(x["x"] == hash_at(j - 1), F.lit(False)) | F.coalesce(x["x"] == hash_at(j + 1), F.lit(False))

    repeated = F.sort_array(F.transform(F.filter(sorted_windows, twin), lambda x: x["i"]))
    return F.aggregate(
        repeated,
        F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("end")),
        lambda acc, i: F.struct(
            (acc["total"] + i + WINDOW - F.greatest(i.cast("long"), acc["end"])).alias("total"),
            (i.cast("long") + WINDOW).alias("end"),
        ),
        lambda acc: acc["total"],
    )


def host_verdicts(measured: DataFrame) -> DataFrame:
    """(host, n_docs, n_failed, rate, host_kept): failure rates shrunk by the empirical beta prior.

    With k the prior's weight and m the mean of the hosts' rates, the rate is
    (failed + k m) / (documents + k); k = m (1 - m) / variance - 1 by the method of
    moments, within PRIOR_WEIGHT (the upper bound if all rates are equal).
    """
    counted = checkpointed(
        measured.groupBy("host").agg(
            F.count("*").alias("n_docs"), F.sum(F.col("failed").cast("long")).alias("n_failed")
        )
    )
    raw = F.col("n_failed") / F.col("n_docs")
    prior = counted.agg(F.avg(raw).alias("m"), F.var_pop(raw).alias("v")).select(
        "m",
        F.when(F.col("v") > 0, F.least(F.greatest(F.col("m") * (1 - F.col("m")) / F.col("v") - 1, F.lit(PRIOR_WEIGHT[0])), F.lit(PRIOR_WEIGHT[1])))
        .otherwise(F.lit(PRIOR_WEIGHT[1]))
        .alias("k"),
    )
    m, k = prior.first()  # two numbers
    rate = (F.col("n_failed") + F.lit(k) * F.lit(m)) / (F.col("n_docs") + F.lit(k))
    return counted.select("host", "n_docs", "n_failed", rate.alias("rate"), (rate <= MAX_HOST_RATE).alias("host_kept"))


def judged(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """measures() with base_failed, host_rate and kept, one row for each row of docs.

    Nulls: a null text has no words and fails; rows of a null host form a host of
    their own; doc_id is carried as it is. Repeated rows are measured and counted each.
    Ties do not arise; a host at the limit stays. An empty table gives an empty result.
    """
    rows = measures(docs, host, text)
    rows = rows.withColumn(
        "base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    )
    rows = checkpointed(
        rows.withColumn(
            "failed",
            F.col("base_failed")
            | (100 * F.col("n_symbols") > MAX_SYMBOLS * F.col("n_words"))
            | (100 * F.col("n_dup_lines") > MAX_DUP_LINES * F.col("n_lines")),
        )
    )
    hosts = checkpointed(host_verdicts(rows).select(F.col("host").alias("of"), "rate", "host_kept"))
    side = F.broadcast(hosts) if hosts.count() <= BROADCAST_HOSTS else hosts
    joined = rows.join(side, rows["host"].eqNullSafe(side["of"]))
    return joined.select(
        "doc_id",
        "host",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        F.col("rate").alias("host_rate"),
        (~F.col("base_failed") & F.col("host_kept")).alias("kept"),
    )


def op6_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).drop("host", "host_rate")


OP6_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS body,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT rid, i, list_slice(w, i + 1, i + {WINDOW}) AS win
  FROM (SELECT rid, w, unnest(range(0, len(w) - {WINDOW - 1})) AS i FROM d WHERE len(w) >= {WINDOW})
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT rid, count(DISTINCT p) AS n
  FROM (SELECT rid, unnest(range(i, i + {WINDOW})) AS p FROM twice) GROUP BY rid
), m AS (
  SELECT d.rid, doc_id, source, len(w)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(body, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN covered USING (rid)
), f AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed FROM m
), g AS (
  SELECT *, base_failed OR 100 * n_symbols > {MAX_SYMBOLS} * n_words OR 100 * n_dup_lines > {MAX_DUP_LINES} * n_lines AS failed
  FROM f
), h AS (
  SELECT source, count(*) AS n, count(*) FILTER (failed) AS bad FROM g GROUP BY source
), p AS (
  SELECT avg(bad / n) AS m, CASE WHEN var_pop(bad / n) > 0
    THEN least(greatest(avg(bad / n) * (1 - avg(bad / n)) / var_pop(bad / n) - 1, {PRIOR_WEIGHT[0]}), {PRIOR_WEIGHT[1]})
    ELSE {PRIOR_WEIGHT[1]} END AS k
  FROM h
)
SELECT g.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (bad + k * m) / (n + k) <= {MAX_HOST_RATE} AS kept
FROM g JOIN h ON g.source IS NOT DISTINCT FROM h.source CROSS JOIN p
"""

"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

A window of an item occurs in a text only if all its shingles do. Required overlap is
the whole set, so the prefix that must be joined is one shingle: the window's rarest,
by counts over all texts. Joining it at position p with a window that has it at offset j
leaves one possible start, p - j, which must lie within the text (positional and
length bounds); the words of the text from there are then compared with the window.

The item side is broadcast in parts of at most ``BROADCAST_ROWS`` rows, so its size
is bounded whatever the benchmark's; texts are never shuffled. Every text also carries
one end mark, which gives its row in the result with its number of words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafline.llm.common import KEY, checkpointed, decision_key, keyed, table, text_key, unkeyed

WINDOW = 13
SHINGLE = 3
#: Rows of the item side that are broadcast at a time (at most some 40 MB).
BROADCAST_ROWS = 100_000
#: A text is contaminated if at least one word in this many is hit.
ONE_IN = 20
#: Key of the end marks; a shingle that hashes to it is told apart by its word.
END = -1

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def plain_words(text: Column) -> Column:
    """Words of ASCII digits and letters and of any other characters, A to Z lower-cased (null: none)."""
    body = F.coalesce(text, F.lit(""))
    only_ascii = F.octet_length(body) == F.char_length(body)
    folded = F.when(only_ascii, F.lower(body)).otherwise(F.translate(body, UPPER, LOWER))
    return F.array_remove(F.split(folded, NOT_WORD), "")


def _key(size: int, at: Column, words: str = "w") -> Column:
    """Hash of the shingle of that size from position ``at`` of an array."""
    return F.xxhash64(F.lit(size), *[F.get(F.col(words), at + i) for i in range(size)])


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(item, window_id, words): all windows of all items, as often as they occur in different items."""
    items = benchmark.where("item_id IS NOT NULL").select(
        F.col("item_id").cast("string").alias("item"), plain_words(F.col("text")).alias("w")
    )
    starts = items.where(F.size("w") > 0).select(
        "item", "w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - WINDOW, F.lit(0)))).alias("i")
    )
    cut = starts.select("item", F.slice("w", F.col("i") + 1, F.lit(WINDOW)).alias("words"))
    return cut.select("item", F.xxhash64("words").alias("window_id"), "words").distinct()


def _positions(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """(doc_id, text_key, w, pos, word, key) for every word of every text, and for its end mark.

    The end mark is the empty word after the last; its key is END.
    """
    split = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text_key("text").alias("text_key"),
        plain_words(F.col("text")).alias("w"),
    )
    # an expression, not a column: Spark would infer a filter on a column and make the words twice
    marked = F.array_append("w", "")
    placed = split.select("doc_id", "text_key", "w", F.posexplode(marked).alias("pos", "word"))
    end, keys = F.lit(END).cast("long"), [_key(s, F.col("pos")) for s in sizes]
    if len(keys) > 1:
        key = F.explode(F.when(F.col("word") == "", F.array(end)).otherwise(F.array(*keys)))
    else:
        key = F.when(F.col("word") == "", end).otherwise(keys[0]) if keys else end
    return placed.select("doc_id", "text_key", "w", "pos", "word", key.alias("key"))


def _parts(side: DataFrame) -> list[DataFrame]:
    """The side cut by key into parts that may each be broadcast."""
    n = max(1, -(-side.count() // BROADCAST_ROWS))
    return [side.where(F.pmod(F.xxhash64("key"), F.lit(n)) == i) if n > 1 else side for i in range(n)]


def hits(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Occurrences (doc_id, text_key, n_words, start, length, window_id) and item_windows().

    Each row of docs has one more row in the first, with a null start.
    """
    pairs = checkpointed(item_windows(benchmark))
    windows = pairs.select("window_id", "words").distinct()
    size = F.least(F.size("words"), F.lit(SHINGLE))
    shingled = windows.select(
        "window_id", "words", size.alias("size"), F.explode(F.sequence(F.lit(0), F.size("words") - size)).alias("offset")
    )
    key = reduce(
        lambda otherwise, s: F.when(F.col("size") == s, _key(s, F.col("offset"), "words")).otherwise(otherwise),
        range(1, SHINGLE + 1),
        F.lit(None).cast("long"),
    )
    shingles = checkpointed(shingled.withColumn("key", key))
    sizes = sorted(r["size"] for r in shingles.select("size").distinct().collect())  # SHINGLE values at most

    positions = _positions(docs, sizes)
    seen = [
        positions.where("word != ''").join(F.broadcast(part), "key").groupBy("key").agg(F.count("*").alias("n"))
        for part in _parts(checkpointed(shingles.select("key").distinct()))
    ]
    counts = reduce(DataFrame.unionByName, seen)
    rarest = (
        shingles.join(counts, "key")
        .groupBy("window_id")
        .agg(F.min(F.struct("n", "offset", "key")).alias("r"), F.first("words").alias("words"))
    )
    ends = docs.sparkSession.range(1).select(
        F.lit(None).cast("long").alias("window_id"),
        F.array().cast("array<string>").alias("words"),
        F.lit(0).alias("offset"),
        F.lit(END).cast("long").alias("key"),
    )
    prefixes = checkpointed(rarest.select("window_id", "words", "r.offset", "r.key").unionByName(ends))

    start, length, n_words = F.col("pos") - F.col("offset"), F.size("words"), F.size("w")
    found = [
        positions.join(F.broadcast(part), "key")
        .where((length == 0) == (F.col("word") == ""))
        .where((start >= 0) & (start + length <= n_words))
        .where(F.slice("w", start + 1, length) == F.col("words"))
        .select(
            "doc_id",
            "text_key",
            n_words.alias("n_words"),
            F.when(length > 0, start).alias("start"),
            F.when(length > 0, length).alias("length"),
            "window_id",
        )
        for part in _parts(prefixes)
    ]
    return checkpointed(reduce(DataFrame.unionByName, found)), pairs


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_words, n_hit, n_items, items_sha256, contaminated), one row for each row of docs.

    A word is hit if it lies inside any occurrence of any window. Null and wordless
    texts have no words and are clean; items without words or with a null item_id have
    no windows; repeated rows of docs appear as often as given, repeated items count
    once; an empty table on either side gives no hits. Only doc_id and text (item_id
    and text) are looked at, so other columns may have any names.
    """
    occurrences, pairs = hits(docs, benchmark)
    spans = F.sort_array(F.collect_set(F.when(F.col("start").isNotNull(), F.struct("start", "length"))))
    per_row = occurrences.groupBy("doc_id", "text_key").agg(
        F.count_if(F.col("start").isNull()).alias("copies"),
        F.max("n_words").cast("long").alias("n_words"),
        spans.alias("spans"),
    )
    n_hit = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("total"), F.lit(0).alias("end")),
        lambda acc, x: F.struct(
            (acc["total"] + F.greatest(x["start"] + x["length"] - F.greatest(x["start"], acc["end"]), F.lit(0))).alias("total"),
            F.greatest(acc["end"], x["start"] + x["length"]).alias("end"),
        ),
        lambda acc: acc["total"].cast("long"),
    )
    items = (
        occurrences.where("start IS NOT NULL")
        .select("doc_id", "text_key", "window_id")
        .distinct()
        .join(pairs.select("window_id", "item"), "window_id")
        .groupBy(F.col("doc_id").alias("of"), F.col("text_key").alias("of_key"))
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    )
    joined = per_row.join(
        items, per_row["doc_id"].eqNullSafe(items["of"]) & (per_row["text_key"] == items["of_key"]), "left"
    ).select(
        "doc_id",
        "text_key",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.coalesce("items", F.array().cast("array<string>"))), 256).alias("items_sha256"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"),
    )
    dirty = (F.col("n_hit") > 0) & (ONE_IN * F.col("n_hit") >= F.col("n_words"))
    return joined.drop("copy").withColumn("contaminated", dirty)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated rows; columns and their order are those of docs.

    Null and empty texts have no words and stay, repeated rows all stay or all go, an empty benchmark drops none and an empty table stays
    empty. Any column names may be there but those that begin with __leafline.
    """
    dirty = contamination(docs, benchmark).where("contaminated").select(*decision_key()).distinct()
    return unkeyed(keyed(docs).join(dirty, KEY, "left_anti"), docs)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("text_key")


_SPLIT = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP5_SQL = rf"""
WITH b AS (
  SELECT item_id, {_SPLIT} AS w FROM benchmark WHERE item_id IS NOT NULL
), win AS (
  SELECT DISTINCT item_id, len(w2) AS n, w2 AS words
  FROM (SELECT item_id, list_slice(w, i + 1, i + {WINDOW}) AS w2
        FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - {WINDOW}, 0) + 1)) AS i FROM b WHERE len(w) > 0))
), d AS (
  SELECT row_number() OVER () AS rid, doc_id, {_SPLIT} AS w FROM documents
), p AS (
  SELECT rid, w, n, unnest(range(0, len(w) - n + 1)) AS i
  FROM d CROSS JOIN (SELECT DISTINCT n FROM win) WHERE len(w) >= n
), hit AS (
  SELECT p.rid, p.i, p.n, win.item_id
  FROM (SELECT rid, i, n, list_slice(w, i + 1, i + n) AS words FROM p) p JOIN win USING (n, words)
), words AS (
  SELECT rid, count(DISTINCT x) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS x FROM hit) GROUP BY rid
), items AS (
  SELECT rid, count(DISTINCT item_id) AS n_items,
         string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM hit GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND {ONE_IN} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""

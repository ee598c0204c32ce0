"""Mixing sources to target weights by a low-discrepancy schedule.

A source's documents are shuffled by a hash into one stream of words, and the stream
is cut into blocks of equal length. Slot k of the schedule belongs to the source whose
share of the cumulative targets holds the k-th golden-ratio point, frac(k / phi), so
that every stretch of the schedule is close to the targets. A source's r-th slot takes its
block r modulo the number of its blocks: after the last block it begins again. The last
slot of a source is cut where its target ends, and points are drawn until every source
has the slots it needs.

Streams are laid out by prefix sums over hash ranges within each source, and ranks
of slots by prefix sums over stretches of the schedule, so no source is ever gathered in
one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafline.llm.common import KEY, checkpointed, decision_key, keyed, table, text_key, unkeyed, words

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
#: Words of a block; tables of fewer words than MIN_SLOTS blocks get shorter ones.
BLOCK_WORDS = 4096
MIN_SLOTS = 256
#: Rows of a source that are laid out by one task, and slots that are ranked by one.
RANGE_ROWS = 1024
STRETCH = 16384
PHI = (math.sqrt(5) - 1) / 2


def targets(sizes: list[int], weights: list[float], max_epochs: int = MAX_EPOCHS) -> list[float]:
    """Shares of the sum of sizes by weight; what would pass max_epochs times a size is reshared by weight."""
    out: list[float] = [0.0] * len(sizes)
    left, active = float(sum(sizes)), list(range(len(sizes)))
    while active:
        total = sum(weights[i] for i in active)
        over = [i for i in active if left * weights[i] / total > max_epochs * sizes[i]]
        if not over:
            for i in active:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(max_epochs * sizes[i])
        left = max(0.0, left - sum(out[i] for i in over))
        active = [i for i in active if i not in set(over)]
    return out


def _plan(rows: DataFrame, weights: tuple[float, ...]) -> tuple[list[tuple], int]:
    """Per source (name, size, target, quota, blocks) in schedule order, and the block's words.

    Gathers one row for each source.
    """
    sums = {r["source"]: int(r["s"]) for r in rows.groupBy("source").agg(F.sum("size").alias("s")).collect()}
    names = sorted((n for n in sums if n is not None), key=lambda n: n.encode("utf-8", "surrogatepass")) + [None] * (None in sums)
    size = [sums[n] for n in names]
    target = targets(size, [weights[i % len(weights)] for i in range(len(names))])
    block = max(1, min(BLOCK_WORDS, sum(size) // MIN_SLOTS))
    return [(n, s, t, min(round(t), MAX_EPOCHS * s), -(-s // block)) for n, s, t in zip(names, size, target, strict=True)], block


def _epoch_slots(quota: int, size: int, block: int) -> int:
    """Slots that hold quota words: those of whole passes and of the part after them."""
    return quota // size * -(-size // block) + -(-(quota % size) // block) if size else 0


def schedule(spark: SparkSession, plan: list[tuple], block: int) -> DataFrame:
    """(slot, source_no, epoch, block, first, last): the words [first, last) of a source's stream, in slot order."""
    quotas = [p[3] for p in plan]
    total = sum(quotas)
    schema = "slot long, source_no int, epoch long, block long, first long, last long"
    if not total:
        return spark.createDataFrame([], schema)
    needed = [_epoch_slots(q, p[1], block) for q, p in zip(quotas, plan, strict=True)]
    edges, at = [], 0
    for n in needed[:-1]:
        at += n
        edges.append(at / sum(needed))
    # golden-ratio points leave any interval at most a logarithm short of its share
    n_slots = sum(needed) + 8 * len(plan) * (2 + sum(needed).bit_length())
    point = F.col("slot") * F.lit(PHI)
    cut = F.array(*[F.lit(float(e)) for e in edges]) if edges else F.array().cast("array<double>")
    number = F.size(F.filter(cut, lambda e: e <= point - F.floor(point)))
    of = (
        spark.range(n_slots)
        .select(F.col("id").alias("slot"))
        .withColumn("source_no", number.cast("int"))
        .withColumn("stretch", F.floor(F.col("slot") / STRETCH))
    )
    per_stretch = of.groupBy("source_no", "stretch").agg(F.count("*").alias("n"))
    before = per_stretch.withColumn(
        "before", F.sum("n").over(W.partitionBy("source_no").orderBy("stretch")) - F.col("n")
    ).drop("n")
    in_stretch = F.row_number().over(W.partitionBy("source_no", "stretch").orderBy("slot")) - 1
    ranked = of.withColumn("r", in_stretch).join(before, ["source_no", "stretch"]).withColumn("r", F.col("r") + F.col("before"))
    facts = spark.createDataFrame(
        [(i, p[1], p[3], p[4], n) for i, (p, n) in enumerate(zip(plan, needed, strict=True))],
        "source_no int, size long, quota long, blocks long, needed long",
    )
    out = ranked.join(F.broadcast(facts), "source_no").where(F.col("r") < F.col("needed"))
    epoch, number = F.floor(F.col("r") / F.col("blocks")), F.pmod("r", "blocks")
    first = number * block
    return out.select(
        "slot",
        "source_no",
        epoch.alias("epoch"),
        number.alias("block"),
        first.alias("first"),
        F.least(first + block, F.col("size"), F.col("quota") - epoch * F.col("size")).alias("last"),
    )


def laid_out(rows: DataFrame, plan: list[tuple]) -> DataFrame:
    """rows with source_no and the start of each in its source's shuffled stream of words."""
    spark = rows.sparkSession
    names = spark.createDataFrame(
        [(p[0], i) for i, p in enumerate(plan)],
        T.StructType([T.StructField("name", T.StringType()), T.StructField("source_no", T.IntegerType(), False)]),
    )
    n_ranges = max(1, -(-rows.count() // RANGE_ROWS))
    known = rows.join(F.broadcast(names), rows["source"].eqNullSafe(names["name"])).drop("name")
    # hash ranges: the unsigned order of the top 31 bits, in equal ranges
    high = F.shiftrightunsigned("h", 33)
    known = known.withColumn("range", F.floor(high * F.lit(n_ranges) / F.lit(1 << 31)))
    sums = known.groupBy("source_no", "range").agg(F.sum("size").alias("n"))
    before = sums.withColumn("before", F.sum("n").over(W.partitionBy("source_no").orderBy("range")) - F.col("n")).drop("n")
    inside = F.sum("size").over(
        W.partitionBy("source_no", "range").orderBy("h", "row").rowsBetween(W.unboundedPreceding, -1)
    )
    placed = known.withColumn("inside", F.coalesce(inside, F.lit(0)))
    return placed.join(before, ["source_no", "range"]).withColumn("start", F.col("before") + F.col("inside"))


def mixture(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(doc_id, text_key, source, row, size, source_size, target, taken), one row for each row of docs.

    size is the number of words (null text: none); taken the words that the schedule takes
    of the row, repeats counted: at most MAX_EPOCHS times its size, and in sum over a source
    its target to the nearest word. A null source is a source. Equal rows are told apart only
    by position, so a rerun gives the same multiset of rows. An empty table, and sources
    without words, give no slots and taken = 0. The plan gathers one row for each source.
    """
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text_key("text").alias("text_key"),
        F.col("source").cast("string").alias("source"),
        F.size(words(F.col("text"))).cast("long").alias("size"),
    ).withColumn("h", F.xxhash64(F.lit("mix"), "doc_id", "source", "text_key"))
    rows = checkpointed(sized.withColumn("row", F.monotonically_increasing_id()))
    plan, block = _plan(rows, weights)
    placed = checkpointed(laid_out(rows, plan))
    end = F.col("start") + F.col("size")
    pieces = placed.where("size > 0").select(
        "row",
        "source_no",
        "start",
        end.alias("end"),
        F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))).alias("block"),
    )
    # a block's passes differ only in the last, which may be cut
    slots = (
        schedule(docs.sparkSession, plan, block)
        .groupBy("source_no", "block", "first", "last")
        .agg(F.count("*").alias("times"))
    )
    overlap = F.greatest(F.lit(0), F.least("end", "last") - F.greatest("start", "first"))
    taken = (
        pieces.join(slots, ["source_no", "block"])
        .groupBy("row")
        .agg(F.sum(overlap * F.col("times")).alias("taken"))
    )
    facts = docs.sparkSession.createDataFrame(
        [(i, p[1], p[2]) for i, p in enumerate(plan)], "source_no int, source_size long, target double"
    )
    return (
        placed.join(taken, "row", "left")
        .join(F.broadcast(facts), "source_no")
        .select("doc_id", "text_key", "source", "row", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))
    )


def _first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, as written."""
    parts = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    return F.array_join(F.slice(parts, F.lit(1), n.cast("int")), "")


#: Beside KEY: rows that differ in their source only are taken apart.
SOURCE_KEY = "__leafline_source"


def _source_key() -> Column:
    return F.coalesce(F.xxhash64(F.when(F.col("source").isNotNull(), F.concat(F.lit("s"), F.col("source").cast("string")))), F.lit(0)).alias(SOURCE_KEY)


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """The mixture itself: each row of docs as often as whole passes take it, and once more
    cut to the words that a last, partial pass takes. Rows that no slot takes go.

    Rows of equal doc_id, text and source are one row that appears as often as all of them are taken. Null and
    empty texts have no words and go, as all rows of an empty table do; null ids and sources stay as they are.
    n_chars, if there, follows a cut text. Columns and their order are those of docs; names that
    start with __leafline are reserved.
    """
    size = F.greatest("size", F.lit(1))
    taken = mixture(docs, weights)
    one = taken.groupBy("doc_id", "text_key", _source_key()).agg(
        F.sum(F.floor(F.col("taken") / size)).alias("__leafline_whole"),
        F.collect_list(F.when(F.col("taken") % size > 0, F.col("taken") % size)).alias("__leafline_cuts"),
    )
    found = F.col("__leafline_whole"), F.col("__leafline_cuts")
    one = one.where((found[0] > 0) | (F.size(found[1]) > 0)).select(*decision_key(), SOURCE_KEY, *found)
    # equal rows are counted in the decision; the join has hashed them by the key
    joined = keyed(docs).withColumn(SOURCE_KEY, _source_key()).join(one, [*KEY, SOURCE_KEY]).dropDuplicates([*KEY, SOURCE_KEY])
    whole = F.transform(F.sequence(F.lit(1).cast("long"), found[0]), lambda _: F.lit(-1).cast("long"))
    times = F.concat(F.when(found[0] > 0, whole).otherwise(F.array().cast("array<long>")), found[1])
    out = joined.withColumn("__leafline_n", F.explode(times))
    n = F.col("__leafline_n")
    out = out.withColumn("text", F.when(n < 0, F.col("text")).otherwise(_first_words(F.col("text"), n)))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(n < 0, F.col("n_chars")).otherwise(F.char_length("text").cast(kind)))
    return unkeyed(out, docs)


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")

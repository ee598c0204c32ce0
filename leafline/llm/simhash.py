"""Near-duplicates by SimHash, searched in the space of segment popcounts.

A 64-bit fingerprint is cut into 16 segments of four bits, and the counts of set
bits are its coordinates. Each changed bit changes one count by one, so the
Manhattan distance of two points is at most the Hamming distance of their
fingerprints. Two lattice points at distance two or less have a lattice point
at distance one or less of both. Each fingerprint is therefore entered in the grid
cells of its own point and of the points one step away, 33 at most, and an
equi-join on the cell finds every pair within range. Pairs are then verified on the
fingerprints themselves.

Only distinct fingerprints take part, so copies cost one row. A cell with more than
``CROWD`` fingerprints is not paired at all: its members are linked through the
exact analogue of the cell, the 65 bit strings at most one bit away. Two
fingerprints differ in at most two bits if and only if they share such a string, and
a string has at most 65 fingerprints around it, so the links stay in proportion to the
members.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafline.llm.common import KEY, checkpointed, components, decision_key, keyed, table, text_key, unkeyed

SHINGLE = 3
SEED = 42
MAX_BITS = 2
#: Fingerprints of a cell up to which they are compared in pairs.
CROWD = 48
#: Shingles hashed at a time, which bounds the memory a long text takes.
BLOCK = 1 << 15


def simhash(text: str | None, size: int = SHINGLE) -> int:
    """The unsigned fingerprint: a bit is set if more than half of the shingles' hashes set it.

    Null, empty and blank texts have fingerprint zero; a text of fewer words than a
    shingle is one shingle.
    """
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= size:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = list(accumulate(len(w) + 1 for w in found))
    starts = [0, *ends[: len(found) - size]]
    n, counts, digest = len(starts), np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        part = starts[at : at + BLOCK]
        hashes = np.array(
            [digest(joined[s : e - 1], SEED) for s, e in zip(part, ends[at + size - 1 :], strict=False)], dtype="<u8"
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", size: int = SHINGLE) -> DataFrame:
    """(doc_id, text_key, fp as a signed long), one row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([simhash(t.as_py(), size) for t in batch.column(2)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(fps)], names=["doc_id", "text_key", "fp"]
            )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(text).alias("text_key"), F.col(text))
    return source.mapInArrow(run, "doc_id long, text_key long, fp long")


def popcounts(fp: Column) -> Column:
    """The embedding, packed: each nibble of the result holds the set bits of that nibble."""
    bit = F.lit(0x1111111111111111)
    return (
        fp.bitwiseAND(bit)
        + F.shiftrightunsigned(fp, 1).bitwiseAND(bit)
        + F.shiftrightunsigned(fp, 2).bitwiseAND(bit)
        + F.shiftrightunsigned(fp, 3).bitwiseAND(bit)
    )


def near_cells(point: Column) -> Column:
    """The packed points at Manhattan distance one or less, within 0 to 4 in each coordinate."""
    cells = [point]
    for i in range(16):
        step = 1 << (4 * i)
        count = F.shiftrightunsigned(point, 4 * i).bitwiseAND(F.lit(15))
        cells.append(F.when(count < 4, point + F.lit(step)))
        cells.append(F.when(count > 0, point - F.lit(step)))
    return F.array_compact(F.array(*cells))


def near_strings(fp: Column) -> Column:
    """The bit strings at Hamming distance one or less."""
    return F.array(fp, *[fp.bitwiseXOR(F.lit((1 << i) if i < 63 else -(1 << 63))) for i in range(64)])


def close_pairs(distinct: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) between the distinct fingerprints fp that join all within MAX_BITS.

    From cells of up to ``crowd`` members come all verified pairs, from fuller ones a
    set of verified links with the same connected components.
    """
    cells = distinct.select("fp", F.explode(near_cells(popcounts(F.col("fp")))).alias("cell"))
    shared = checkpointed(cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1"))
    entered = cells.join(shared, "cell")
    few = entered.where(F.col("n") <= crowd)
    pairs = (
        few.select("cell", F.col("fp").alias("a"))
        .join(few.select("cell", F.col("fp").alias("b")), "cell")
        .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS))
        .select("a", "b")
    )
    around = (
        entered.where(F.col("n") > crowd)
        .select("fp")
        .distinct()
        .select("fp", F.explode(near_strings(F.col("fp"))).alias("string"))
    )
    stars = around.groupBy("string").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("all"))
    linked = stars.where(F.size("all") > 1).select("a", F.explode("all").alias("b")).where("a != b")
    return pairs.unionByName(linked).distinct()


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, text_key, fp, component_id), one row for each row of docs.

    component_id is the least doc_id among the rows whose fingerprints are reachable
    over links of at most MAX_BITS bits, the row's own included. Null, empty and blank
    texts have fingerprint zero and are linked like any other. Null doc_ids are never
    the least unless a component has no other; repeated rows appear as often as given;
    other columns of docs are not looked at. An empty table gives an empty result.
    """
    rows = checkpointed(fingerprints(docs, text))
    distinct = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    rooted = components(close_pairs(distinct))
    member = distinct.join(rooted.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "least"
    )
    heads = member.groupBy("root").agg(F.min("least").alias("component_id"))
    named = checkpointed(member.join(heads, "root").select("fp", "component_id"))
    return rows.join(named, "fp").select("doc_id", "text_key", "fp", "component_id")


def deduplicate(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with one row of each near-duplicate group: that of the least doc_id.

    Rows with equal doc_id and text count as one row. In a group of only null doc_ids,
    one of the least text_key stays. Columns and their order are those of docs, and any names may be there but those that begin with __leafline.
    Null, empty and blank texts are one group; an empty table stays empty.
    """
    found = near_duplicates(docs, text)
    order = F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "text_key", "fp")
    stay = found.groupBy(F.col("component_id"), F.when(F.col("component_id").isNull(), F.col("fp")).alias("lone")).agg(
        F.min(order).alias("first")
    )
    stay = stay.select("first.doc_id", "first.text_key").select(*decision_key())
    # the join has hashed the rows by the key, so dropping repeated rows needs no further exchange
    return unkeyed(keyed(docs, text).join(stay, KEY).dropDuplicates(KEY), docs)


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")

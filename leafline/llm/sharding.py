"""Shards of near equal bytes for groups that must stay whole, by differencing.

Karmarkar and Karp's differencing for k parts keeps partial partitions, each with k sums;
it takes the two with the largest spread, adds the largest part of one to the smallest of
the other and so on in opposite order, subtracts the least sum and goes on with the result
until one is left. It needs all items in one heap, so the items are bounded first: groups that
weigh more than one part in ``PARTS`` of all bytes (there are at most ``PARTS`` of them) are items
of their own, and the others are dealt by hash into at most ``PARTS`` parcels. The assignment of
these items is the only thing the driver holds; rows look it up by a broadcast.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafline.llm.common import checkpointed, stored, table

SHARDS = 16
#: Heavy groups and parcels are at most so many each.
PARTS = 4096
#: Rows of a shard that are numbered by one task.
RANGE_ROWS = 8192


def differencing(weights: list[int], k: int) -> list[int]:
    """The part, 0 to k - 1, of each item; ties go by the items' order, so reruns agree."""
    parent = list(range(len(weights) * k))  # a set of items for each part of each partial partition
    heap: list[tuple[int, int, list[tuple[int, int]]]] = []
    for i, w in enumerate(weights):
        # sums in descending order with their sets; all but the first are empty
        heap.append((-w, i, [(w, i * k)] + [(0, i * k + j) for j in range(1, k)]))
    heapq.heapify(heap)
    serial = len(weights)

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        merged = []
        for (x, s), (y, t) in zip(a, reversed(b), strict=True):
            parent[find(t)] = find(s)
            merged.append((x + y, s))
        merged.sort(reverse=True)
        low = merged[-1][0]
        merged = [(x - low, s) for x, s in merged]
        heapq.heappush(heap, (-merged[0][0], serial, merged))
        serial += 1
    if not heap:
        return []
    part = {find(s): j for j, (_, s) in enumerate(heap[0][2])}
    return [part[find(i * k)] for i in range(len(weights))]


def _group() -> list[Column]:
    return [F.col("text_key"), F.col("text_crc32"), F.col("size")]


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), one row for each row of docs.

    law is "bytes": rows of equal text share a shard, and the shards' sums of size are as
    near as those groups allow. slot numbers a shard's rows from 0 without gaps, in hash order of
    doc_id and text. A null text has no bytes and size 1, and is grouped with the empty
    text, which has the same; null doc_ids are carried; repeated rows are members of one
    group with a slot each; an empty table gives an empty result. grown_shard is null. Other columns are not looked at.
    """
    return _placed(docs, shards).drop("row")


def _placed(docs: DataFrame, shards: int, row: Column | None = None) -> DataFrame:
    """sharded() with row, a number that is carried along."""
    crc = F.crc32(F.coalesce("text", F.lit("")))
    rows = checkpointed(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size"),
            crc.cast("long").alias("text_crc32"),
            F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"),
            (F.lit(None) if row is None else row).cast("long").alias("row"),
        )
    )
    groups = checkpointed(rows.groupBy(*_group()).agg(F.sum("size").alias("bytes"), F.count("*").alias("n")))
    total, n_rows = groups.agg(F.sum("bytes"), F.sum("n")).first()
    least = max(1, (total or 0) // PARTS)  # at most PARTS groups are larger
    heavy = groups.where(F.col("bytes") > least)
    parcel = F.pmod(F.xxhash64(F.lit("parcel"), "text_key"), F.lit(PARTS)).cast("long")
    parcels = groups.where(F.col("bytes") <= least).groupBy(parcel.alias("parcel")).agg(F.sum("bytes").alias("bytes"))
    items = (
        heavy.select("text_key", "text_crc32", "size", F.lit(None).cast("long").alias("parcel"), "bytes")
        .unionByName(parcels, allowMissingColumns=True)
        .orderBy(F.desc("bytes"), "parcel", "text_key", "text_crc32", "size")
        .collect()
    )
    part = differencing([r["bytes"] for r in items], shards)
    spark = docs.sparkSession
    of_heavy = spark.createDataFrame(
        [(r["text_key"], r["text_crc32"], r["size"], p) for r, p in zip(items, part, strict=True) if r["parcel"] is None],
        "text_key long, text_crc32 long, size long, heavy_shard int",
    )
    of_parcel = spark.createDataFrame(
        [(r["parcel"], p) for r, p in zip(items, part, strict=True) if r["parcel"] is not None],
        "parcel long, parcel_shard int",
    )
    placed = (
        rows.withColumn("parcel", parcel)
        .join(F.broadcast(of_heavy), ["text_key", "text_crc32", "size"], "left")
        .join(F.broadcast(of_parcel), "parcel", "left")
        .withColumn("shard", F.coalesce("heavy_shard", "parcel_shard"))
    )
    n_ranges = max(1, -(-(n_rows or 0) // (RANGE_ROWS * shards)))
    order = F.xxhash64(F.lit("slot"), "doc_id", "text_key")
    placed = placed.withColumn("order", order).withColumn(
        "range", F.floor(F.shiftrightunsigned("order", 33) * F.lit(n_ranges) / F.lit(1 << 31))
    )
    counts = placed.groupBy("shard", "range").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(W.partitionBy("shard").orderBy("range")) - F.col("n")).drop("n")
    inside = F.row_number().over(W.partitionBy("shard", "range").orderBy("order", "doc_id", "text_key")) - 1
    return (
        placed.withColumn("inside", inside)
        .join(before, ["shard", "range"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("before") + F.col("inside")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            "row",
        )
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Writes docs with their shard and slot as Parquet, a folder for each shard.

    Every row is written once, repeated rows with a slot each; null ids and texts are written as they are, and an empty
    table gives an empty folder. Columns named shard or slot are replaced. Rows are numbered and stored first, so that
    their places can be joined back by number.
    """
    number = "__leafline_row"
    held = stored(docs.withColumn(number, F.monotonically_increasing_id()))
    place = _placed(held, shards, F.col(number)).select(F.col("row").alias(number), "shard", "slot")
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    out = held.select(number, *[F.col(f"`{c}`") for c in kept]).join(place, number).drop(number)
    out.write.partitionBy("shard").parquet(path)


def op10_shard_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents"))

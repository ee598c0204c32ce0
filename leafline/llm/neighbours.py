"""Nearest neighbours by multi-index hashing over learned binary codes.

Vectors are centred and turned by rotations that are learned from a bounded sample (iterative quantisation: rotate, take
signs, turn towards the signs), and the signs are the code; several rotations make it longer than the vector. A task cuts its rows into shards
of bounded size. In a shard the code's bytes are substrings, each with a table from its 256 values to the rows that have them.
A query probes, in every table, the values that differ from its own byte in 0, 1, 2, ... bits. If codes of m bytes differ in
fewer than m (r + 1) bits, one byte differs in at most r: after the probes of r bits the shard's codes
within m (r + 1) - 1 bits have all been met. Probing ends once CANDIDATES of them are within that radius (or all rows met);
every code up to the radius of the last of these, ties included, is then compared on the original vectors.

A shard's CANDIDATES nearest codes contain all of its rows that are among the CANDIDATES nearest of the table, so cutting rows into
shards only adds candidates. A code or vector that very many rows share is no hot key, as rows are never dealt by their values.

Queries go through in blocks of bounded size, each sent to all tasks; a task keeps the best of a block's queries over its
shards, and a window for each query merges what the tasks found. The work is queries times rows, though only codes of a shard's
probed values and vectors of its candidates are looked at; with a query set that is a share of the rows, it grows with their product.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafline.llm.common import finite_vectors, stored, table

#: Bits of a code, at least: rotations are added until there are as many.
BITS = 256
#: Rows that rotations are learned from, at most: those of the least hashes of their key.
SAMPLE = 5_000
#: Rounds of learning a rotation.
LEARNED = 20
#: Rows of a shard, and codes of it that are retrieved for each query, at least.
SHARD = 8_192
CANDIDATES = 512
#: Queries that are sent to the tasks at a time, about.
BLOCK = 4_096
NEAREST = 10


@lru_cache(maxsize=1)
def _shells() -> list[np.ndarray]:
    """By number of bits: the bytes with that many."""
    every = np.arange(256, dtype=np.uint8)
    return [every[np.bitwise_count(every) == r] for r in range(9)]


def learn_rotation(centred: np.ndarray, rounds: int, seed: int) -> np.ndarray:
    """An orthogonal matrix, begun at random, that brings the rows close to corners of a cube."""
    d = centred.shape[1]
    rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))[0]
    for _ in range(rounds):
        u, _, v = np.linalg.svd(centred.T @ np.where(centred @ rotation > 0, 1.0, -1.0))
        rotation = u @ v
    return rotation


@dataclass(frozen=True)
class Coder:
    """What makes codes of vectors."""

    mean: np.ndarray
    rotations: np.ndarray

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Bytes by row; the length is a multiple of 8."""
        bits = np.packbits((x - self.mean) @ self.rotations > 0, axis=1)
        return np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8)))


def fit(sample: np.ndarray, bits: int = BITS) -> Coder:
    """Learns from rows of a sample; equal ones count once."""
    sample = np.unique(sample, axis=0)
    mean = sample.mean(0)
    turns = max(1, math.ceil(bits / sample.shape[1]))
    return Coder(mean, np.concatenate([learn_rotation(sample - mean, LEARNED, seed) for seed in range(turns)], axis=1))


class Shard:
    """Rows of a task with their tables."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, codes: np.ndarray) -> None:
        self.x, self.ids, self.codes = x, ids, codes.view(np.uint64)
        n, m = codes.shape
        self.rows = np.argsort(codes, axis=0, kind="stable").T.ravel()  # by substring, then value
        counts = np.stack([np.bincount(codes[:, j], minlength=256) for j in range(m)])
        ends = counts.cumsum(1) + n * np.arange(m)[:, None]
        self.starts, self.counts = ends - counts, counts

    def probed(self, code: np.ndarray, r: int) -> np.ndarray:
        """Rows with a byte that differs from the code's in r bits, some more than once."""
        values = code[:, None] ^ _shells()[r][None]
        which = np.arange(len(code))[:, None]
        counts, starts = self.counts[which, values].ravel(), self.starts[which, values].ravel()
        places = np.repeat(starts - (counts.cumsum() - counts), counts) + np.arange(counts.sum())
        return self.rows[places]

    def within(self, code: np.ndarray, candidates: int) -> np.ndarray:
        """All rows up to the radius of the ``candidates`` nearest codes."""
        n, m = len(self.x), len(code)
        wide = code.view(np.uint64)
        distance = np.full(n, np.iinfo(np.int32).max, np.int32)
        met = np.zeros(n, bool)
        for r in range(9):
            seen = met.copy()
            met[self.probed(code, r)] = True
            new = np.flatnonzero(met & ~seen)
            distance[new] = np.bitwise_count(self.codes[new] ^ wide).sum(1, dtype=np.int32)
            if met.all() or np.count_nonzero(distance < m * (r + 1)) >= candidates:
                break
        if n <= candidates:
            return np.arange(n)
        return np.flatnonzero(distance <= np.partition(distance, candidates - 1)[candidates - 1])

    def nearest(self, q: np.ndarray, code: np.ndarray, k: int, candidates: int) -> tuple[np.ndarray, np.ndarray]:
        """(distance, place) of the k nearest candidates, ties by id, and then all that tie with the last in distance are counted."""
        rows = self.within(code, candidates)
        apart = np.sqrt(((self.x[rows] - q) ** 2).sum(1))
        if len(rows) > k:
            close = apart <= np.partition(apart, k - 1)[k - 1]
            rows, apart = rows[close], apart[close]
        order = np.lexsort((self.ids[rows], apart))[:k]
        return apart[order], rows[order]


@dataclass(frozen=True)
class Index:
    """rows (key, vector, code) of all vectors that take part, and what made their codes."""

    rows: DataFrame
    key: str
    vector: str
    width: int
    coder: Coder | None


def _floats(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def build(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", bits: int = BITS) -> Index:
    """Indexes every row of (key, vector), stored in the shared folder.

    Vectors that are null, zero, hold null or non-finite components or are of another length than the first row's
    take no part. Keys may be null or repeat, rows may be equal; other columns are not looked at. An empty table has an empty index.
    """
    own = rows.select(F.col(f"`{key}`").cast("long").alias(key), F.col(f"`{vector}`").cast("array<double>").alias(vector))
    good, order, width = finite_vectors(own.where(F.exists(vector, lambda c: c != 0)), key, vector)
    if not width:
        return Index(good.withColumn("code", F.lit(None).cast("binary")).limit(0), key, vector, 0, None)
    sample = [r[0] for r in good.orderBy(F.xxhash64(key), *order).limit(SAMPLE).select(vector).collect()]
    coder = fit(np.array(sample, np.float64), bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                code = coder.codes(_floats(batch.column(vector), width))
                columns = [batch.column(key), batch.column(vector), pa.array([c.tobytes() for c in code], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[key, vector, "code"])

    return Index(stored(good.mapInArrow(run, f"`{key}` long, `{vector}` array<double>, code binary")), key, vector, width, coder)


def _found(index: Index, block: list[tuple], k: int, candidates: int) -> DataFrame:
    """(number, near_null, near, score): the k nearest rows of each task for the queries (number, id, vector) of a block."""
    coder, key, vector, width = index.coder, index.key, index.vector, index.width
    numbers = [b[0] for b in block]
    queries = np.array([b[1] for b in block], np.float64).reshape(len(block), width)
    last = np.iinfo(np.int64).max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = coder.codes(queries)
        best = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, bool)) for _ in numbers]

        def search(part: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> None:
            x, ids, nulls, code = (np.concatenate(c) for c in zip(*part, strict=True))
            shard = Shard(x, np.where(nulls, last, ids), code)
            for i, q in enumerate(queries):
                apart, rows = shard.nearest(q, codes[i], k, candidates)
                a, b, c = best[i]
                a, b, c = np.concatenate([a, apart]), np.concatenate([b, shard.ids[rows]]), np.concatenate([c, nulls[rows]])
                order = np.lexsort((c, b, a))[:k]
                best[i] = a[order], b[order], c[order]

        part, held = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, SHARD):
                rows = batch.slice(at, SHARD)
                ids = rows.column(key)
                code = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(rows.num_rows, -1)
                part.append((_floats(rows.column(vector), width), ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), code))
                held += rows.num_rows
                if held >= SHARD:
                    search(part)
                    part, held = [], 0
        if part:
            search(part)
        for number, (a, b, c) in zip(numbers, best, strict=True):
            if len(a):
                yield pa.RecordBatch.from_pydict(
                    {"number": pa.array([number] * len(a), pa.int64()), "near": pa.array(b, mask=c), "score": pa.array(a)}
                )

    return index.rows.mapInArrow(run, "number long, near long, score double")


def search(index: Index, queries: DataFrame, k: int = NEAREST, candidates: int = CANDIDATES, own: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest rows found for each row of queries (key, vector, as in the index).

    Nearness is Euclidean distance on the original vectors in double precision, ties go to the smaller id, null ids last. With ``own``
    queries are rows of the index, and one row of the query's id and vector is not among its results. Fewer rows give fewer
    results; queries whose vector can't be in the index have none; repeated queries have theirs each; an empty table gives none.
    """
    spark, vector = queries.sparkSession, index.vector
    shape = "query_id long, rank int, vec_id long, score double"
    if not index.width:
        return spark.createDataFrame([], shape)
    usable = queries.select(F.col(f"`{index.key}`").cast("long").alias("query_id"), F.col(f"`{vector}`").cast("array<double>").alias(vector))
    usable = usable.where((F.size(vector) == index.width) & F.exists(vector, lambda c: c != 0) & F.forall(vector, lambda c: c.isNotNull() & (F.abs(c) < float("inf"))))
    usable = stored(usable)
    blocks = math.ceil(usable.count() / BLOCK)
    numbered = usable.repartition(max(1, blocks)).withColumn("block", F.spark_partition_id())
    numbered = stored(numbered.withColumn("number", F.monotonically_increasing_id()))
    out = [spark.createDataFrame([], shape)]
    by_query = W.partitionBy("number")
    for b in range(blocks):
        part = numbered.where(F.col("block") == b)
        rows = [(r["number"], r[vector]) for r in part.collect()]
        if not rows:
            continue
        ranked = _found(index, rows, k + own, candidates).withColumn(
            "place", F.row_number().over(by_query.orderBy("score", F.col("near").isNull(), "near"))
        )
        named = ranked.where(F.col("place") <= k + own).join(F.broadcast(part.select("number", "query_id")), "number")
        if own:
            itself = F.min(F.when((F.col("score") == 0) & F.col("near").eqNullSafe(F.col("query_id")), F.col("place"))).over(by_query)
            named = named.withColumn("itself", F.coalesce(itself, F.lit(k + 1)))
            named = named.where("place != itself").withColumn("place", F.col("place") - (F.col("place") > F.col("itself")).cast("int"))
        out.append(stored(named.select("query_id", F.col("place").alias("rank"), F.col("near").alias("vec_id"), "score")))
    return reduce(DataFrame.unionByName, out[1:] or out)


def op13_hashed_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(build(rows), rows.where("vec_id % 100 = 0"), own=True)

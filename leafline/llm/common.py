"""What the training-data operators share: lineage cuts, row keys, links to components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafline.store import folder as shared_folder
from leafline.store import remove as remove_path
from leafline.store import scratch, stored, stored_at

__all__ = [
    "checkpointed", "components", "decision_key", "finite_vectors", "in_bucket", "keyed", "remove_path", "scratch", "shared_folder", "stored", "stored_at", "table",
    "text_key", "unkeyed", "words",
]

#: Java and Python pattern of one word: anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Writes df to the checkpoint folder and returns a frame that reads it.

    The folder is shared_folder().
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def text_key(text: str | Column = "text") -> Column:
    """64 bits of the text; with doc_id it identifies a row up to equal copies of it."""
    return F.xxhash64(text)


#: Columns that a decision is joined by: no nulls, so that plain equality and its partitioning serve.
KEY = ["__leafline_id", "__leafline_null", "__leafline_text"]


def _key(doc_id: Column, text: Column) -> list[Column]:
    number = doc_id.cast("long")
    return [
        F.coalesce(number, F.lit(0).cast("long")).alias(KEY[0]),
        number.isNull().alias(KEY[1]),
        text.alias(KEY[2]),
    ]


def keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the key of each row beside its columns."""
    return docs.select("*", *_key(F.col("doc_id"), text_key(text)))


def decision_key() -> list[Column]:
    """The same key from a table of (doc_id, text_key)."""
    return _key(F.col("doc_id"), F.col("text_key"))


def unkeyed(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, in their order."""
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


def words(text: Column) -> Column:
    """The words of a text as an array (null: none)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), "")


def in_bucket(column: Column, modulus: int, remainder: int) -> Column:
    """Is crc32 of the value as text that remainder? A null value never is."""
    return F.coalesce(F.pmod(F.crc32(column.cast("string")), F.lit(modulus)) == remainder, F.lit(False))


def finite_vectors(rows: DataFrame, key: str, vector: str) -> tuple[DataFrame, list[Column], int]:
    """(rows whose vector is there, holds finite components only and is as long as the first such row's; the order; that length).

    The order is by key, nulls last, ties by the vector's components. Without such rows the length is 0.
    """
    bad = F.exists(F.col(vector), lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    good = rows.where(F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True)))
    order = [F.col(key).isNull(), F.col(key), F.col(vector)]
    first = good.orderBy(*order).select(F.size(vector)).first()
    width = first[0] if first else 0
    return good.where(F.size(vector) == width), order, width


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the ends of edges (a, b); root is the least node reachable.

    Alternates the large-star and small-star steps: each is two aggregations with
    map-side combining and a join, edges stay at most as many as they were, and
    rounds grow with the logarithm of the longest chain. Every round is cut by a
    checkpoint, so a lost executor costs one round. Joins keep plain exchanges on
    both sides, which lets Spark split a node with very many edges.
    """
    now = checkpointed(
        edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.explode(
                F.array(
                    F.struct(F.col("u"), F.col("m").alias("v")),
                    F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                )
            ).alias("e")
        )
        now = checkpointed(small.select("e.u", "e.v").where("u != v").distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    rooted = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return rooted.unionByName(rooted.select(F.col("root").alias("node"), "root").distinct())

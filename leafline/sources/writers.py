"""Sinks: partition-wise overwrites, caches by key, checked outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_partitions(df: DataFrame, path: str, by: str) -> None:
    """Overwrites the partitions that df has and leaves the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def put_cache(entries: DataFrame, path: str) -> None:
    write_partitions(entries, path, "key")


def cache_entries(entries: DataFrame, fingerprint: str) -> DataFrame:
    """Entries of the current corpus, newest first, with their age in seconds."""
    age = F.greatest(F.lit(0), F.unix_timestamp() - F.col("cached_at").cast("long"))
    return entries.where(F.col("fingerprint") == fingerprint).withColumn("age_s", age).orderBy(F.desc("cached_at"))


def cache_key(*parts: str):
    """The key of a cached run: everything its result depends on."""
    return F.substr(F.sha2(F.concat_ws("\u001f", *parts), 256), F.lit(1), F.lit(32))


def write_queries(leaves: DataFrame, path: str) -> None:
    """An A row and a paired B row for each leaf, to be filled in by hand."""
    pair = F.posexplode(F.array(F.lit("A"), F.lit("B"))).alias("n", "set")
    rows = leaves.select("doc_id", "node_id", "order", pair)
    ident = lambda s: F.concat(F.lit(s), F.lpad((F.col("order") + 1).cast("string"), 3, "0"))
    rows.select(
        F.when(F.col("n") == 0, ident("A")).otherwise(ident("B")).alias("id"),
        "set",
        F.when(F.col("n") == 1, ident("A")).otherwise(F.lit("")).alias("pair_id"),
        F.col("doc_id").alias("doc"),
        "node_id",
        F.lit("").alias("question"),
        F.lit("").alias("edit_term"),
    ).write.option("header", "true").csv(path)


def audited(df: DataFrame, text: str, forbidden: list[str]) -> DataFrame:
    """df, which fails when read if any text has a forbidden pattern."""
    out = df
    for pattern in forbidden:
        found = F.col(text).rlike(pattern)
        out = out.where(F.when(found, F.raise_error(F.lit(f"forbidden pattern {pattern}")).isNull()).otherwise(F.lit(True)))
    return out


def clear_cache(spark: SparkSession, path: str, keys: list[str] | None = None) -> None:
    """Removes the entries of these keys, or all."""
    for folder in [path] if keys is None else [f"{path}/key={key}" for key in keys]:
        there = spark._jvm.org.apache.hadoop.fs.Path(folder)
        there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def write_markdown(docs: DataFrame, path: str) -> None:
    """The texts of docs (doc_id, text) as they are, a partition for each document; documents that were there and are not in docs stay."""
    write_partitions(docs.select("doc_id", "text"), path, "doc_id")


def write_corpus(chunks: DataFrame, path: str, forbidden: list[str], text: str = "text") -> None:
    """Writes chunks, or nothing but an error if a text has a forbidden pattern."""
    audited(chunks, text, forbidden).write.mode("overwrite").parquet(path)


def write_gold_map(found: DataFrame, path: str) -> None:
    """Writes gold_map's rows unless one has a problem or a query has several."""
    bad = found.groupBy("query_id").agg(F.count("*").alias("n"), F.max("problem").alias("problem")).where("n > 1 OR problem IS NOT NULL")
    several = F.coalesce("problem", F.lit("several leaves"))
    told = bad.orderBy("query_id").select(F.concat_ws(": ", "query_id", several)).limit(8).collect()
    if told:
        raise ValueError("gold map not written: " + "; ".join(r[0] for r in told))
    found.drop("problem").write.mode("overwrite").parquet(path)


def write_archive(results: DataFrame, prompts: DataFrame, gold: DataFrame, path: str) -> None:
    """Results (query_id, n, ...) with their prompts (query_id, ...) and gold (query_id, ...); of a query's results that of the greatest n."""
    last = results.groupBy("query_id").agg(F.max_by(F.struct(*[c for c in results.columns if c != "query_id"]), "n").alias("r"))
    last.select("query_id", "r.*").join(prompts, "query_id", "left").join(gold, "query_id", "left").write.mode("overwrite").parquet(path)

"""Document manifest: ids and tags from paths, filters by tag, upserts that keep manual tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafline.functions.text import sanitise


def folders(path: Column) -> Column:
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    return F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))


def tags_for(path: Column) -> Column:
    """One tag for each folder of a relative path."""
    return F.transform(folders(path), sanitise)


def doc_ids(files: DataFrame, path: str = "rel_path") -> DataFrame:
    """files with doc_id: sanitised parts joined by "__", later paths of one id numbered from -2."""
    stem = F.regexp_replace(F.element_at(F.split(F.col(path), "/"), -1), r"(?<=.)\.[^.]*$", "")
    base = F.array_join(F.concat(tags_for(F.col(path)), F.array(sanitise(stem))), "__")
    nth = F.row_number().over(W.partitionBy("__base").orderBy(path))
    numbered = files.withColumn("__base", base).withColumn("__nth", nth)
    name = F.when(F.col("__nth") > 1, F.concat("__base", F.lit("-"), "__nth")).otherwise(F.col("__base"))
    return numbered.withColumn("doc_id", name).drop("__base", "__nth")


def effective_tags(tags: str = "tags", manual: str = "manual_tags") -> Column:
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_union(F.coalesce(F.col(tags), none), F.coalesce(F.col(manual), none)))


def filter_by_tags(manifest: DataFrame, wanted: list[str]) -> DataFrame:
    """Documents with any of the tags, all if none is wanted."""
    if not wanted:
        return manifest
    asked = F.transform(F.array(*[F.lit(w) for w in wanted]), sanitise)
    return manifest.where(F.arrays_overlap(effective_tags(), asked))


def tag_counts(manifest: DataFrame) -> DataFrame:
    return manifest.select(F.explode(effective_tags()).alias("tag")).groupBy("tag").agg(F.count("*").alias("doc_count"))


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """The manifest after registering new rows by source_path: ids and manual tags stay, the rest is new."""
    kept = old.join(new.select("source_path"), "source_path", "left_anti")
    prior = old.select("source_path", F.col("doc_id").alias("__id"), F.col("manual_tags").alias("__manual"))
    merged = new.join(prior, "source_path", "left")
    merged = merged.withColumn("doc_id", F.coalesce("__id", "doc_id")).withColumn(
        "manual_tags", F.coalesce("__manual", "manual_tags", F.array().cast("array<string>"))
    )
    return kept.unionByName(merged.select(*old.columns))


def set_manual_tags(manifest: DataFrame, doc_id: str, tags: list[str]) -> DataFrame:
    clean = F.array_sort(F.array_distinct(F.transform(F.array(*[F.lit(t) for t in tags]).cast("array<string>"), sanitise)))
    return manifest.withColumn("manual_tags", F.when(F.col("doc_id") == doc_id, clean).otherwise(F.col("manual_tags")))


def remove(manifest: DataFrame, doc_ids: DataFrame) -> DataFrame:
    return manifest.join(doc_ids.select("doc_id"), "doc_id", "left_anti")


def folder_rollup(manifest: DataFrame, path: str = "rel_path") -> DataFrame:
    """(folder, depth, docs): documents at or below every folder; the root is the empty folder."""
    parts = folders(F.col(path))
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    listed = manifest.select(F.posexplode(prefixes).alias("depth", "folder"))
    return listed.groupBy("folder", "depth").agg(F.count("*").alias("docs"))


def library_filter(manifest: DataFrame, text: str, tags: list[str]) -> DataFrame:
    """The library's search box: text in title or id, any case, and any of the tags."""
    found = F.contains(F.lower("title"), F.lit(text.lower())) | F.contains(F.lower("doc_id"), F.lit(text.lower()))
    return filter_by_tags(manifest.where(found), tags)

"""Sources as data frames: markdown folders, index files, manifests, evaluation files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafline.operators.layout import SESSION_SCHEMA

QUERY_SCHEMA = "id string, set string, pair_id string, doc string, node_id string, question string, edit_term string"
MANIFEST_SCHEMA = (
    "doc_id string, title string, rel_path string, source_path string, sha256 string, tags array<string>, "
    "manual_tags array<string>, ingest_module string, ingested_at string"
)


def discover(spark: SparkSession, root: str, pattern: str = "*.md") -> DataFrame:
    """(path, rel_path, sha256, content) of files below root, without those in hidden folders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    plain = F.regexp_replace("path", r"^[a-z]+:/*", "/")
    rel = F.regexp_replace(plain, "^.*?" + root.rstrip("/").replace(".", r"\.") + "/", "")
    listed = files.select("path", rel.alias("rel_path"), F.sha2("content", 256).alias("sha256"), "content")
    return listed.where(~F.col("rel_path").rlike(r"(^|/)\."))


def markdown(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, text) of the markdown files below root; the id is the file's stem."""
    files = discover(spark, root)
    stem = F.regexp_replace(F.element_at(F.split("rel_path", "/"), -1), r"\.md$", "")
    return files.select(stem.alias("doc_id"), F.decode("content", "UTF-8").alias("text"))


def index_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, format_version, nodes as JSON) of index files; a bare array is version 1, what can't be read is null."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), "value")
    bare = F.ltrim("value").startswith("[")
    return files.select(
        F.regexp_replace("name", r"\.json$", "").alias("doc_id"),
        F.when(bare, F.lit(1)).otherwise(F.coalesce(F.get_json_object("value", "$.formatVersion").try_cast("int"), F.lit(1))).alias("format_version"),
        F.when(bare, F.col("value")).otherwise(F.get_json_object("value", "$.nodes")).alias("nodes"),
    )


def queries_csv(spark: SparkSession, path: str, sets: list[str] | None = None) -> DataFrame:
    """Evaluation queries; blank rows are skipped, sets are compared in upper case."""
    rows = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').schema(QUERY_SCHEMA).csv(path)
    rows = rows.where(F.trim(F.coalesce("id", F.lit(""))) != "").withColumn("set", F.upper(F.trim("set")))
    return rows.where(F.col("set").isin([s.upper() for s in sets])) if sets else rows


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a missing file is an empty table."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest; unknown fields are dropped and missing ones null."""
    return spark.read.option("multiLine", "true").schema(MANIFEST_SCHEMA).json(path)


def questions(spark: SparkSession, text: str, default: str | None = None) -> DataFrame:
    """(question_id, prompt, answer_id, label, facet) of a question set's JSON.

    Where it can't be read, those of the default set, if one is given, else none.
    """
    schema = "question_id string, prompt string, answer_id string, label string, facet string"
    try:
        value = json.loads(text)
        rows = [
            (q["id"], q["prompt"], a["id"], a.get("label", ""), a.get("facet", ""))
            for q in value["questions"]
            for a in q["answers"]
        ]
    except (ValueError, KeyError, TypeError):
        if default is not None:
            return questions(spark, default)
        rows = []
    return spark.createDataFrame(rows, schema)


def label_pins(docs: DataFrame) -> DataFrame:
    """(doc_id, label, pin_id) of the golden labels in pin blocks."""
    body = F.explode(F.regexp_extract_all("text", F.lit(r"(?ms)^```pin[ \t]*$\n(.*?)^```"), F.lit(1)))
    pins = docs.select("doc_id", body.alias("body"))
    pins = pins.select(
        "doc_id",
        F.regexp_extract("body", r"(?m)^id:[ \t]*(.*)$", 1).alias("pin_id"),
        F.regexp_extract("body", r"(?m)^golden:[ \t]*(.*)$", 1).alias("golden"),
    )
    labels = F.explode(F.split(F.regexp_replace("golden", r"[\[\]\"]", ""), r"[ \t]*,[ \t]*"))
    return pins.select("doc_id", labels.alias("label"), "pin_id").where("label != ''")


def unique_labels(pins: DataFrame) -> DataFrame:
    """pins (doc_id, label, pin_id) as they are; an error that names them if labels stand on several pins, as a label marks one chunk."""
    twice = pins.groupBy("label").agg(F.countDistinct("doc_id", "pin_id").alias("n")).where("n > 1").orderBy("label").limit(10).collect()
    if twice:
        raise ValueError("labels on several pins: " + ", ".join(r["label"] for r in twice))
    return pins


def narration(lines: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, line_no, line, case_id): log lines (line_no, line) with the case of the result line that follows them.

    ``by`` names the columns of a log, such as its file. Within a log, result lines are numbered from the end, and a line
    belongs to the one before it in that order.
    """
    from pyspark.sql import Window as W

    found = F.nullif(F.regexp_extract("line", r"^\[([A-Z][0-9]+)\]", 1), F.lit(""))
    backwards = W.partitionBy(*(by or [])).orderBy(F.desc("line_no")).rowsBetween(W.unboundedPreceding, 0)
    return lines.withColumn("case_id", F.last(found, ignorenulls=True).over(backwards))


def sessions(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, document, regions) of annotation sessions: folders below root, or root itself, that hold final_state.json.

    doc_id is the folder's path below root, "" for root, below which then nothing else counts. Hidden folders are skipped, unreadable files are null.
    """
    found = discover(spark, root, "final_state.json")
    own = found.where("rel_path = 'final_state.json'")
    found = found if own.isEmpty() else own
    state = F.from_json(F.decode("content", "UTF-8"), SESSION_SCHEMA)
    return found.select(F.regexp_replace("rel_path", "/?final_state\\.json$", "").alias("doc_id"), state.alias("s")).select("doc_id", "s.*")


def recognised(files: DataFrame, cache: DataFrame, config: str) -> tuple[DataFrame, DataFrame]:
    """files (path, sha256, ...) with the blocks that cache (sha256, config, blocks) has for them under config, and those without."""
    known = cache.where(F.col("config") == config).groupBy("sha256").agg(F.max("blocks").alias("blocks"))
    return files.join(known, "sha256"), files.join(known, "sha256", "left_anti")

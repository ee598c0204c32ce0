"""From raw documents to packed token sequences: the stages of a training corpus.

Each stage takes the documents that its predecessor kept and returns documents again; the
last returns packed sequences. run() writes each stage's result as Parquet into
the shared folder that the cluster names in spark.checkpoint.dir and reads it back as the next
one's input, so a lost executor never costs more than a stage. A stage's files go when the next one's are there;
the last one's are the result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafline.llm import decontaminate, language, mixing, simhash, tokens
from leafline.llm.common import remove_path, shared_folder


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is close to a learned language; learns from the labelled ones among docs.

    Null texts and texts without a letter are rejected; where no row is labelled, nothing is learned and all go. Repeated
    rows all stay or all go. Columns stay as they are, and an empty table stays empty.
    """
    return language.keep_identified(docs, language.fit(docs, F.lit(True)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that of the least doc_id, nulls last, ties by a hash of the text.

    Null, empty and blank texts are one group; repeated rows are one document. Columns stay as they are, names that start
    with __leafline are reserved, and an empty table stays empty.
    """
    return simhash.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated with the benchmark.

    Null and empty texts have no words and stay, repeated rows all stay or all go, an empty benchmark drops none.
    Columns stay as they are, names that start with __leafline are reserved, and an empty table stays empty.
    """
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of sources: documents as often as it takes them, a source's last one cut.

    A null source is a source; null and empty texts have no words and go; rows of equal doc_id, text and source count as
    one that is taken as often as all. Columns stay as they are, and an empty table stays empty.
    """
    return mixing.mix(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token sequences of all documents.

    Null and empty texts are one end mark, repeated rows have a piece each; texts longer than a sequence are
    split without loss. An empty table gives none.
    """
    return tokens.pack(docs)


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", pack_tokens),
]

#: Fingerprints, centroids and merges are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    shared = shared_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for number, (_, stage) in enumerate(STAGES):
        path = f"{shared}/pipeline-{uuid.uuid4().hex}-{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            remove_path(spark, last)
        last = path
    return docs

"""Run events as streams: the last status of each node, progress, and an append-only log.

The state is one row for each node of a run. Re-marking moves a node, so every node has
exactly one status, and progress is derived from the states rather than counted.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from leafline.store import drop_at_exit, folder, names

# States that end a node's run.
TERMINAL = ["kept", "pruned", "retrieved", "rejected", "deferred", "error"]

LOG_SCHEMA = T.StructType(
    [
        T.StructField("ts", T.DoubleType()),
        T.StructField("kind", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("query", T.StringType()),
        T.StructField("timing", T.MapType(T.StringType(), T.LongType())),
        T.StructField("grounding_status", T.StringType()),
        T.StructField("answer_text", T.StringType()),
        T.StructField("index_fingerprint", T.StringType()),
    ]
)


def read_log(spark: SparkSession, path: str, stream: bool = True) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    return reader.schema(LOG_SCHEMA).json(path)


def append_log(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def last_statuses(events: DataFrame, key: list[str], order: list[str], status: str = "status") -> DataFrame:
    """The current status of each key; works on streams (complete or update mode) and tables."""
    return events.groupBy(*key).agg(F.max_by(status, F.struct(*order)).alias("status"), F.count("*").alias("marks"))


def progress(statuses: DataFrame, run: str = "run_id") -> DataFrame:
    """(run, total, done, <status> counts) of the last statuses of a finished batch."""
    return statuses.groupBy(run).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status").isin(*TERMINAL)).alias("done"),
        *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in TERMINAL],
    )


def windowed_counts(events: DataFrame, ts: str, kind: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, kind, n) by tumbling windows of event time, with a watermark for late events."""
    marked = events.withWatermark(ts, late) if events.isStreaming else events
    return marked.groupBy(F.window(ts, width).alias("w"), kind).agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("start"), kind, "n"
    )


def run_available(df: DataFrame, name: str, mode: str = "complete", at: str | None = None) -> DataFrame:
    """Drains what is there of a stream into Parquet and returns it: the last state in complete mode, else all rows, in update mode with their batch.

    Each batch writes its own folder in the shared store, so the state never passes the driver. With ``at``, a folder of the
    shared store, another call goes on where the last one stopped; else the folder goes when the driver's Python ends.
    """
    spark = df.sparkSession
    if at is None:
        at = f"{folder(spark)}/leafline-stream-{uuid.uuid4().hex}"
        drop_at_exit(spark, at)

    def write(batch: DataFrame, number: int) -> None:
        (batch.withColumn("batch", F.lit(number).cast("long")) if mode == "update" else batch).write.mode("overwrite").parquet(f"{at}/batch-{number}")

    stream = df.writeStream.queryName(name).outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True)
    query: StreamingQuery = stream.foreachBatch(write).start()
    query.awaitTermination()
    batches = sorted(int(n.partition("-")[2]) for n in names(spark, at) if n.startswith("batch-"))
    kept = batches[-1:] if mode == "complete" else batches
    schema = T.StructType([*df.schema, T.StructField("batch", T.LongType())]) if mode == "update" else df.schema
    if not kept:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{at}/batch-{n}" for n in kept])


def single_fingerprint(log: DataFrame) -> DataFrame:
    """(run_id, fingerprints, stable): did the corpus stay the same while a run went on?"""
    seen = F.countDistinct("index_fingerprint")
    return log.groupBy("run_id").agg(seen.alias("fingerprints"), (seen <= 1).alias("stable"))

"""A log of records that ends where the corpus changes under a run.

Each record carries the fingerprint of the index it was made on. A run's first record says which index the run is about; its
first record of another index is kept, as the sign of the change, and nothing after it. What was written
before stays. The decisions of each batch are written with it, one row for each run, so that a restart keeps to them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafline.store import names, scratch, stored

FINGERPRINT = "index_fingerprint"


def _batches(spark: SparkSession, at: str) -> list[int]:
    """Committed batches: those whose decisions are written, which is done last."""
    found = [n for n in names(spark, f"{at}/runs") if "_SUCCESS" in names(spark, f"{at}/runs/{n}")]
    return sorted(int(n.partition("-")[2]) for n in found)


def runs(spark: SparkSession, at: str) -> DataFrame | None:
    """(run, expected, stop): each run with its fingerprint and the place of its first record of another one, null if there is none."""
    done = _batches(spark, at)
    return spark.read.parquet(f"{at}/runs/batch-{done[-1]}") if done else None


def kept(spark: SparkSession, at: str) -> DataFrame | None:
    """The records that were kept."""
    done = _batches(spark, at)
    return spark.read.parquet(*[f"{at}/records/batch-{n}" for n in done]) if done else None


def keep(records: DataFrame, number: int, at: str, run: str, order: list[str], fingerprint: str = FINGERPRINT) -> bool:
    """Writes a batch's records up to each run's change; are all runs seen so far stopped? A batch that is committed is left alone.

    A record that comes late counts if it lies before its run's stop. A null fingerprint is one of its own; a null run is a run.
    """
    spark = records.sparkSession
    with scratch(spark):
        if number not in _batches(spark, at):
            place = F.struct(*order)
            known = runs(spark, at)
            first = records.groupBy(F.col(run).alias("run")).agg(F.min_by(F.struct(fingerprint), place).alias("first"))
            if known is None:
                state = first.select("run", F.col("first")[fingerprint].alias("expected"), F.lit(None).cast(records.select(place.alias("p")).schema["p"].dataType).alias("stop"))
            else:
                new = first.alias("n").join(known.alias("o"), F.col("n.run").eqNullSafe(F.col("o.run")), "left_anti")
                fresh = new.select("run", F.col("first")[fingerprint].alias("expected"))
                state = known.unionByName(fresh, allowMissingColumns=True)
            state = stored(state)
            told = records.withColumn("__place", place).join(state, F.col(run).eqNullSafe(F.col("run")))
            told = stored(told.where("stop IS NULL OR __place < stop"))
            other = told.where(~F.col(fingerprint).eqNullSafe(F.col("expected"))).groupBy(F.col("run").alias("of")).agg(F.min("__place").alias("cut"))
            other = stored(other)
            inside = told.join(other, F.col("run").eqNullSafe(F.col("of")), "left").where("cut IS NULL OR __place <= cut")
            inside.select(*[F.col(f"`{c}`") for c in records.columns]).write.mode("overwrite").parquet(f"{at}/records/batch-{number}")
            after = state.join(other, F.col("run").eqNullSafe(F.col("of")), "left").select("run", "expected", F.least("stop", "cut").alias("stop"))
            after.write.mode("overwrite").parquet(f"{at}/runs/batch-{number}")
        now = runs(spark, at)
        return not now.isEmpty() and now.where("stop IS NULL").isEmpty()


def guarded(records: DataFrame, at: str, run: str, order: list[str], fingerprint: str = FINGERPRINT, one_run: bool = False, name: str = "guard") -> DataFrame:
    """Drains what is there of a stream of records into ``at`` and returns what is kept there; call it again for more.

    With ``one_run`` the stream is of one run, and it is stopped at the first batch that holds a change, later batches unread.
    Columns named run, expected, stop, of or cut and those that begin with __ are reserved.
    """
    spark = records.sparkSession
    over: list[int] = []

    def bring(batch: DataFrame, number: int) -> None:
        if not over and keep(batch, number, at, run, order, fingerprint) and one_run:
            over.append(number)

    stream = records.writeStream.queryName(name).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True)
    stopped = one_run and (now := runs(spark, at)) is not None and now.where("stop IS NULL").isEmpty()
    if not stopped:
        query = stream.foreachBatch(bring).start()
        while not query.awaitTermination(1):
            if over:
                query.stop()
    found = kept(spark, at)
    return spark.createDataFrame([], records.schema) if found is None else found

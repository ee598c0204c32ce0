"""Intermediate tables in the folder that driver and executors share, and order over whole tables built on them."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names. Unset, one machine gets a temporary folder and a cluster an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="leafline-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared store, if it is there."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of the shared store, sorted; none if it is not there."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = there.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in system.listStatus(there)) if system.exists(there) else []


def drop_at_exit(spark: SparkSession, path: str) -> None:
    """Removes a folder when the driver's Python ends."""

    def drop() -> None:
        with contextlib.suppress(Exception):  # the session may have ended first
            remove(spark, path)

    atexit.register(drop)


_open = threading.local()


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes the tables that this thread stores within, at the end; what outlives it has to be written elsewhere."""
    outer, _open.paths = getattr(_open, "paths", None), []
    try:
        yield
    finally:
        for path in _open.paths:
            remove(spark, path)
        _open.paths = outer


def stored_at(df: DataFrame) -> tuple[DataFrame, str]:
    """Writes df as Parquet into the shared folder and reads it back; also the path, for whoever knows its last reader.

    Else the files go with the scratch that is open, or when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/leafline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    mine = getattr(_open, "paths", None)
    if mine is None:
        drop_at_exit(spark, path)
    else:
        mine.append(path)
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame) -> DataFrame:
    """The table of stored_at."""
    return stored_at(df)[0]


def before(df: DataFrame, by: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """df with the sum of value over the rows before each, in order within ``by``; without one task for a whole group.

    Rows are dealt by ranges of the order; sums run within a range and one row for each range carries them on. df should
    be slim, as it is stored twice. The order should be total.
    """
    keyed = [F.col(c) for c in by]
    ranged = stored(df).repartitionByRange(*keyed, *order).withColumn("__range", F.spark_partition_id()).withColumn("__value", value)
    ranged = stored(ranged)
    within = W.partitionBy(*by, "__range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    sums = ranged.groupBy(*by, "__range").agg(F.sum("__value").alias("__s"))
    carried = F.sum("__s").over(W.partitionBy(*by).orderBy("__range").rowsBetween(W.unboundedPreceding, -1))
    earlier = sums.select(*by, "__range", F.coalesce(carried, F.lit(0)).alias("__earlier"))
    both = ranged.withColumn("__own", F.coalesce(F.sum("__value").over(within), F.lit(0)))
    named = earlier.select(*[F.col(c).alias(f"__of_{c}") for c in [*by, "__range"]], "__earlier")
    joined = both.join(named, [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in [*by, "__range"]])
    return joined.select(*df.columns, (F.col("__own") + F.col("__earlier")).alias(name))

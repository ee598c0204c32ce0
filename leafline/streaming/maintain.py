"""An index of document trees that is kept up to date from a stream of changes.

The index is stored in buckets of documents. A batch of changes parses only documents whose text differs from the stored one, asks
the summariser only for nodes whose input is new (a changed leaf, and the sections above it as long as their
children's summaries change), and writes anew only the buckets that a changed document lies in. Each batch writes its
buckets into a folder of its own and then one table that says which folder holds each bucket; that table is
the commit. A reader sees the last commit, a batch that is run again writes the same folder, one that is committed is skipped.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leafline.operators.index import PROMPT_VERSION, summarise
from leafline.operators.tree import nodes, with_ancestors
from leafline.store import names, remove, scratch, stored

#: Buckets of an index: a batch's cost is in proportion to those that it touches. One row for each comes to the driver.
BUCKETS = 64

Summariser = Callable[[Column], Column]


@dataclass(frozen=True)
class IndexStore:
    """A stored index at a path of the shared folder."""

    spark: SparkSession
    path: str
    buckets: int = BUCKETS

    def commits(self) -> list[int]:
        """Numbers of the committed batches, ascending."""
        done = [int(n.partition("-")[2]) for n in names(self.spark, f"{self.path}/commits") if n.startswith("batch-")]
        return sorted(n for n in done if "_SUCCESS" in names(self.spark, f"{self.path}/commits/batch-{n}"))

    def places(self, number: int | None = None) -> dict[int, int]:
        """The batch that wrote each bucket, as of a commit (the last one); buckets without rows are not there."""
        done = self.commits()
        if not done:
            return {}
        at = self.spark.read.parquet(f"{self.path}/commits/batch-{done[-1] if number is None else number}")
        return {r["bucket"]: r["batch"] for r in at.collect()}

    def read(self, only: list[int] | None = None) -> DataFrame | None:
        """The rows of the index, or of some buckets of it; None if there are none."""
        found = {b: n for b, n in self.places().items() if only is None or b in only}
        if not found:
            return None
        return self.spark.read.parquet(*[f"{self.path}/rows/batch-{n}/bucket={b}" for b, n in sorted(found.items())])

    def bucket_of(self, doc_id: str = "doc_id") -> Column:
        return F.pmod(F.xxhash64(doc_id), F.lit(self.buckets)).cast("int")

    def upsert(self, changes: DataFrame, number: int, summariser: Summariser, model: str, prompt_version: int = PROMPT_VERSION, order: str = "version") -> None:
        """Brings in changes (doc_id, text, deleted, ``order``); of several changes of a document the last counts.

        A change that leaves a text as it was does nothing; a null text counts as deleted. Documents without a heading have no rows.
        """
        if number not in self.commits():
            with scratch(self.spark):
                self._commit(self._brought(changes, number, summariser, model, prompt_version, order), number)

    def _brought(self, changes: DataFrame, number: int, summariser: Summariser, model: str, prompt_version: int, order: str) -> dict[int, int]:
        """Writes the buckets that a batch changes; returns which batch holds each bucket from now on."""
        state = F.struct("text", "deleted")
        last = changes.groupBy("doc_id").agg(F.max_by(state, F.col(order)).alias("s")).select("doc_id", "s.text", "s.deleted")
        gone = F.coalesce("deleted", F.lit(False)) | F.col("text").isNull()
        last = last.select("doc_id", "text", gone.alias("gone"), F.sha2("text", 256).alias("doc_hash"), self.bucket_of().alias("bucket"))
        last = stored(last)
        near = [r["bucket"] for r in last.select("bucket").distinct().collect()]  # no more than there are buckets
        old = self.read(near)
        if old is None:
            touched = last.where("NOT gone")
        else:
            known = old.select("doc_id", F.col("doc_hash").alias("known")).distinct()
            touched = last.join(known, "doc_id", "left").where("(gone AND known IS NOT NULL) OR (NOT gone AND NOT doc_hash <=> known)").drop("known")
        touched = stored(touched)
        hit = [r["bucket"] for r in touched.select("bucket").distinct().collect()]
        places = self.places()
        if hit:
            fresh = stored(with_ancestors(nodes(touched.where("NOT gone").select("doc_id", "text"))))
            parts = []
            if not fresh.isEmpty():
                known = _nothing(fresh) if old is None else old.join(touched, "doc_id", "left_semi")
                told = summarise(fresh, known, summariser, model, prompt_version)
                told = told.join(touched.select("doc_id", "doc_hash", "bucket"), "doc_id").withColumn("batch", F.lit(number).cast("long"))
                parts.append(told.select(*COLUMNS))
            carried = self.read(hit)
            if carried is not None:
                parts.append(carried.join(touched, "doc_id", "left_anti").withColumn("bucket", self.bucket_of()).select(*COLUMNS))
            if not parts:
                return {b: n for b, n in places.items() if b not in hit}
            rows = reduce(DataFrame.unionByName, parts)
            here = f"{self.path}/rows/batch-{number}"
            rows.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(here)
            written = {int(n.partition("=")[2]) for n in names(self.spark, here) if n.startswith("bucket=")}
            places = {b: n for b, n in places.items() if b not in hit} | {b: number for b in written}
        return places

    def _commit(self, places: dict[int, int], number: int) -> None:
        table = self.spark.createDataFrame(list(places.items()), "bucket int, batch long")
        table.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/batch-{number}")

    def vacuum(self, keep: int = 2) -> None:
        """Removes what no commit but the last ``keep`` needs."""
        done = self.commits()
        used = {(b, n) for c in done[-keep:] for b, n in self.places(c).items()}
        for folder in names(self.spark, f"{self.path}/rows"):
            for part in names(self.spark, f"{self.path}/rows/{folder}"):
                bucket = part.partition("=")[2]
                if bucket and (int(bucket), int(folder.partition("-")[2])) not in used:
                    remove(self.spark, f"{self.path}/rows/{folder}/{part}")
        for c in done[:-keep]:
            remove(self.spark, f"{self.path}/commits/batch-{c}")


#: What is stored of a node. ``batch`` is the one that wrote its document; reused says whether its summary was known before.
COLUMNS = (
    "doc_id node_seq node_id parent_seq title heading_level line_idx is_leaf synthetic parent_title content depth ancestors breadcrumb "
    "summary content_hash summary_source summary_model summary_prompt_version reused doc_hash batch bucket"
).split()


def _nothing(tree: DataFrame) -> DataFrame:
    """No earlier summaries."""
    more = {"content_hash": "string", "summary": "string", "summary_model": "string", "summary_prompt_version": "int", "summary_source": "string"}
    return tree.limit(0).select("doc_id", "node_id", *[F.lit(None).cast(kind).alias(name) for name, kind in more.items()])


def maintain(
    changes: DataFrame, store: IndexStore, summariser: Summariser, model: str, prompt_version: int = PROMPT_VERSION, name: str = "index"
) -> StreamingQuery:
    """Starts a stream of changes (doc_id, text, deleted, version) into the store, for what is there; await it, then start it again for more.

    The checkpoint lies beside the index, so a restart goes on after the last batch.
    """

    def bring(batch: DataFrame, number: int) -> None:
        store.upsert(batch, number, summariser, model, prompt_version)
        store.vacuum()

    stream = changes.writeStream.queryName(name).option("checkpointLocation", f"{store.path}/checkpoint")
    return stream.trigger(availableNow=True).foreachBatch(bring).start()

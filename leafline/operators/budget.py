"""Token budgets as running sums in rank order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAX_EVALS = 400


def budget_scan(
    judged: DataFrame, budget: int | Column, cost: str = "cost", relevant: str = "relevant", rank: str = "rank",
    by: list[str] | None = None, max_evals: int = MAX_EVALS,
) -> DataFrame:
    """judged with status, judged_relevant, tokens_used and capped_by.

    Rows are committed in rank order. The first relevant row that would overflow the budget is
    deferred though judged relevant, and all after it are deferred unread; cheaper rows are not
    squeezed in. Null relevance is an error, which costs nothing. After max_evals rows the
    rest is deferred too; at the same rank the budget is named first.
    """
    by = by or []
    order = W.partitionBy(*by).orderBy(rank)
    admitted = F.coalesce(F.col(relevant), F.lit(False))
    running = F.sum(F.when(admitted, F.col(cost)).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, 0))
    whole = W.partitionBy(*by)
    out = judged.withColumn("__sum", running).withColumn("__nth", F.row_number().over(order))
    budget = F.lit(budget) if isinstance(budget, int) else budget
    out = out.withColumn("__cut", F.min(F.when(admitted & (F.col("__sum") > budget), F.col("__nth"))).over(whole))
    out = out.withColumn("__last", F.count("*").over(whole))
    by_evals = F.when(F.col("__last") >= max_evals, F.lit(max_evals))
    by_budget = F.coalesce(F.col("__cut") <= F.coalesce(by_evals, F.col("__cut")), F.lit(False))
    limit = F.coalesce(F.when(by_budget, F.col("__cut") - 1), by_evals, F.col("__last"))
    boundary = by_budget & (F.col("__nth") == F.col("__cut"))
    status = (
        F.when(F.col("__nth") > limit, F.lit("deferred"))
        .when(F.col(relevant).isNull(), F.lit("error"))
        .when(admitted, F.lit("retrieved"))
        .otherwise(F.lit("rejected"))
    )
    used = F.max(F.when(F.col("__nth") <= limit, F.col("__sum")).otherwise(0)).over(whole)
    return (
        out.withColumn("status", status)
        .withColumn("judged_relevant", boundary)
        .withColumn("tokens_used", used)
        .withColumn("capped_by", F.when(by_budget, F.lit("context")).when(by_evals.isNotNull(), F.lit("max_evals")))
        .drop("__sum", "__nth", "__cut", "__last")
    )


def budget_fit(items: DataFrame, budget: int, cost: str, order: list, by: list[str] | None = None, overhead: int = 0) -> DataFrame:
    """items with fitted: the longest prefix within the budget; once an item does not fit, none after it does."""
    window = W.partitionBy(*(by or [])).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return (
        items.withColumn("running", F.sum(cost).over(window))
        .withColumn("fitted", F.max(F.col("running") > budget - overhead).over(window))
        .withColumn("fitted", ~F.col("fitted"))
    )


def child_batches(children: DataFrame, cap: int, by: list[str], order: list[str]) -> DataFrame:
    """children with batch: groups of at most cap in order, all in one if cap is 0."""
    nth = F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1
    return children.withColumn("batch", F.floor(nth / cap) if cap else F.lit(0).cast("long"))


def packed_batches(children: DataFrame, cap: int, available: int, cost: str, by: list[str], order: str) -> DataFrame:
    """(by, order, batch): sequential packing; a batch closes before it would pass the available tokens or the cap.

    The fold runs over one parent's children, which are few.
    """
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(cost).cast("long").alias("c"))))
    start = F.struct(
        F.lit(0).cast("long").alias("batch"), F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("n"),
        F.array().cast("array<bigint>").alias("out"),
    )

    def add(acc, x):
        full = (acc["n"] > 0) & ((acc["used"] + x["c"] > available) | (acc["n"] >= (cap or 1 << 40)))
        batch = acc["batch"] + F.when(full, F.lit(1)).otherwise(F.lit(0))
        return F.struct(
            batch.alias("batch"),
            (F.when(full, F.lit(0)).otherwise(acc["used"]) + x["c"]).alias("used"),
            (F.when(full, F.lit(0)).otherwise(acc["n"]) + F.lit(1).cast("long")).alias("n"),
            F.array_append(acc["out"], batch).alias("out"),
        )

    grouped = children.groupBy(*by).agg(rows.alias("rows"))
    folded = grouped.withColumn("batches", F.aggregate("rows", start, add, lambda acc: acc["out"]))
    zipped = F.explode(F.arrays_zip(F.col("rows"), F.col("batches")))
    return folded.select(*by, zipped.alias("z")).select(*by, F.col("z.rows.o").alias(order), F.col("z.batches").alias("batch"))


def calibration(samples: DataFrame, order: str, chars: str, tokens: str, by: list[str] | None = None) -> DataFrame:
    """(by, ratio, n, mean_abs_error) of the token estimator after its samples in order.

    Each observed ratio moves the estimate a fifth of the way, which is then lowered by seven
    percent and kept within 2 and 5. Samples without characters or tokens do not count.
    """
    usable = samples.where((F.col(chars) > 0) & (F.col(tokens) > 0))
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(chars).cast("double").alias("c"), F.col(tokens).cast("double").alias("t"))))
    start = F.struct(F.lit(3.4).cast("double").alias("ratio"), F.lit(0.0).cast("double").alias("error"))

    def add(acc, x):
        guess = F.greatest(F.lit(1.0), F.floor(x["c"] / acc["ratio"]) + 1.0)
        moved = (acc["ratio"] * 0.8 + x["c"] / x["t"] * 0.2) * 0.93
        return F.struct(
            F.greatest(F.lit(2.0), F.least(F.lit(5.0), moved)).alias("ratio"),
            (acc["error"] + F.abs(guess - x["t"]) / x["t"]).alias("error"),
        )

    grouped = usable.groupBy(*(by or [])).agg(rows.alias("rows"))
    folded = grouped.withColumn("f", F.aggregate("rows", start, add))
    return folded.select(
        *(by or []),
        F.round("f.ratio", 3).alias("ratio"),
        F.size("rows").cast("long").alias("n"),
        F.round(F.col("f.error") / F.size("rows"), 4).alias("mean_abs_error"),
    )


def context_window(turns: DataFrame, budget: int, cost: str, by: list[str], turn: str = "turn", base: int = 0) -> DataFrame:
    """turns with kept: the newest that fit after the frame's tokens; once one does not fit, none before it does."""
    return budget_fit(turns, budget, cost, [F.desc(turn)], by, base).withColumnRenamed("fitted", "kept")

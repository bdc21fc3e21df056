"""Ranks over all rows without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernel.plans.cluster import spill_table


def ranged(rows: DataFrame, *order) -> DataFrame:
    """``rows`` in ranges of ``order``, written once, with the number of the range (``_p``, rising with the order)."""
    return spill_table(rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranges")


def global_rank(rows: DataFrame, *order, name: str = "rank") -> DataFrame:
    """``rows`` with their place (from 1) in ``order``, which must end on a unique key.

    Rows are cut into ranges; a row's place is its place in the range plus the rows of the ranges before. Only the counts
    of the ranges meet in one task.
    """
    parts = ranged(rows, *order)
    counts = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return parts.withColumn("_own", own).join(F.broadcast(before), "_p").withColumn(name, (F.col("_own") + F.col("_before")).cast("int")).drop("_p", "_own", "_before")


def top_ranked(rows: DataFrame, limit: int, *order, name: str = "rank") -> DataFrame:
    """The first ``limit`` rows in ``order`` (a top-k report) with their place; only those rows meet in one task."""
    return rows.orderBy(*order).limit(limit).withColumn(name, F.row_number().over(Window.orderBy(*order)))

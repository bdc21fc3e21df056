"""Readers of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quernel.plans.cluster import ensure_importable


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a directory of Parquet tables; columns are pruned and filters pushed by Catalyst."""
    ensure_importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

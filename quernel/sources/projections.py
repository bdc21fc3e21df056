"""The logical tables of a repository index as fixed projections of the given tables, in Spark and in SQL.

Commits are orders, their file changes the suppliers (or parts) of their lines, edges the pairs of lines of one
order between different suppliers, documents the searchable texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.sources.tables import table


def epoch_seconds(column: str) -> Column:
    """Seconds since 1970 of a zone-less timestamp, whatever the session's zone."""
    return F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', {column})")


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(hash, author, authored_at_s, priority)."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("hash"), F.col("o_custkey").alias("author"), epoch_seconds("o_orderdate").alias("authored_at_s"), F.col("o_orderpriority").alias("subject")
    )


def file_changes(spark: SparkSession, sf_dir: str, path: str = "l_suppkey") -> DataFrame:
    """(hash, path, additions, deletions), one row per commit and path."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("hash"), F.col(path).alias("path"))
        .agg(F.sum("l_quantity").cast("bigint").alias("additions"), F.sum("l_linenumber").cast("bigint").alias("deletions"))
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, kind, confidence): parallel edges stay."""
    line = table(spark, sf_dir, "lineitem")
    a = line.select("l_orderkey", F.col("l_linenumber").alias("n"), F.col("l_suppkey").alias("src"))
    b = line.select("l_orderkey", F.col("l_linenumber").alias("m"), F.col("l_suppkey").alias("dst"), "l_returnflag", "l_linestatus")
    kind = F.when(F.col("l_returnflag") == "A", "calls_name").when(F.col("l_returnflag") == "N", "references_type").otherwise("imports")
    return a.join(b, "l_orderkey").where("n < m and src <> dst").select("src", "dst", kind.alias("kind"), F.when(F.col("l_linestatus") == "O", "Exact").otherwise("NameOnly").alias("confidence"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol_id, name, file_id)."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("symbol_id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("file_id"))


SQL_COMMITS = "SELECT o_orderkey AS hash, o_custkey AS author, CAST(epoch(o_orderdate) AS BIGINT) AS authored_at_s, o_orderpriority AS subject FROM orders"
SQL_CHANGES = "SELECT l_orderkey AS hash, l_suppkey AS path, CAST(sum(l_quantity) AS BIGINT) AS additions, CAST(sum(l_linenumber) AS BIGINT) AS deletions FROM lineitem GROUP BY ALL"
SQL_EDGES = """SELECT a.l_suppkey AS src, b.l_suppkey AS dst,
  CASE b.l_returnflag WHEN 'A' THEN 'calls_name' WHEN 'N' THEN 'references_type' ELSE 'imports' END AS kind,
  CASE WHEN b.l_linestatus = 'O' THEN 'Exact' ELSE 'NameOnly' END AS confidence
FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber AND a.l_suppkey <> b.l_suppkey"""
SQL_SYMBOLS = "SELECT s_suppkey AS symbol_id, s_name AS name, s_nationkey AS file_id FROM supplier"

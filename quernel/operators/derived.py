"""Derived tables: synthesised dispatch edges, uncovered calls, coverage gaps of notes, retention of feed prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernel.operators.graph import pagerank, ranked_edges
from quernel.sources.projections import SQL_EDGES, edges
from quernel.sources.tables import table

#: Pairs of one variant beyond which its dispatch says nothing (the operator's own rule).
VARIANT_PAIRS = 64


def dispatch_edges(constructs: DataFrame, handles: DataFrame) -> DataFrame:
    """(src, dst): who constructs a variant calls who handles it, for facts (enum, owner, variant, symbol).

    An enum name with several owners is ambiguous and left out, as is a variant with more than 64 pairs.
    Pair counts are products of two aggregates, so such a variant is dropped before anything is paired.
    """
    owners = handles.groupBy("enum").agg(F.countDistinct("owner").alias("n")).where("n = 1").select("enum")
    key = ["enum", "variant"]
    a, b = constructs.select(*key, F.col("symbol").alias("src")).distinct(), handles.select(*key, F.col("symbol").alias("dst")).distinct()
    small = a.groupBy(*key).agg(F.count(F.lit(1)).alias("x")).join(b.groupBy(*key).agg(F.count(F.lit(1)).alias("y")), key).where(F.col("x") * F.col("y") <= VARIANT_PAIRS).select(*key)
    kept = small.join(owners, "enum", "left_semi")
    return a.join(kept, key).join(b, key).where("src <> dst").select("src", "dst").distinct()


def uncovered(occurrences: DataFrame, matched: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct occurrences (``keys``) that no matched edge accounts for; null keys are never matched."""
    return occurrences.select(*keys).distinct().join(matched.select(*keys).distinct(), keys, "left_anti")


def coverage_gap(ranks: DataFrame, noted: DataFrame, most: int = 500) -> DataFrame:
    """(node, place): of the ``most`` highest ranked nodes (a top-k report) those without a note (node)."""
    best = ranks.orderBy(F.desc("rank"), "node").limit(most).withColumn("place", F.row_number().over(Window.orderBy(F.desc("rank"), "node")))
    return best.join(noted.select("node").distinct(), "node", "left_anti").select("node", "place")


def droppable_prefix(entries: DataFrame, pinned: DataFrame) -> DataFrame:
    """(stream_id, n_droppable): entries below the lowest pinned lamport of their stream (stream_id, lamport); unpinned streams keep all."""
    floor = pinned.groupBy("stream_id").agg(F.min("lamport").alias("floor"))
    rows = entries.select("entry_hash", "stream_id", "lamport").distinct().join(floor, "stream_id")
    return rows.groupBy("stream_id").agg(F.sum((F.col("lamport") < F.col("floor")).cast("bigint")).alias("n_droppable"))


def _facts(s: SparkSession, d: str, flag: str) -> DataFrame:
    line = table(s, d, "lineitem").where(F.col("l_returnflag") == flag)
    return line.select((F.col("l_partkey") % 97).alias("enum"), (F.col("l_partkey") % 97 % 5 * (F.col("l_linenumber") % 2)).alias("owner"), F.col("l_partkey").alias("variant"), F.col("l_suppkey").alias("symbol"))


def _gap(s, d):
    ranks = pagerank(ranked_edges(edges(s, d))).select("node", F.round("rank", 6).alias("rank"))
    return coverage_gap(ranks, table(s, d, "supplier").where("s_nationkey < 12").select(F.col("s_suppkey").alias("node")))


QUERIES = {
    "dispatch_edges": lambda s, d: dispatch_edges(_facts(s, d, "A"), _facts(s, d, "R")),
    "uncovered_calls": lambda s, d: uncovered(edges(s, d).where("kind = 'calls_name'"), edges(s, d).where("confidence = 'Exact'"), ["src", "dst"]),
    "coverage_gap": _gap,
    "droppable_prefix": lambda s, d: droppable_prefix(table(s, d, "table_sync_entries"), table(s, d, "table_sync_chain_tips")),
}


def _sql() -> dict[str, str]:
    from quernel.operators.graph import _pagerank_sql

    fact = "SELECT l_partkey % 97 AS enum, l_partkey % 97 % 5 * (l_linenumber % 2) AS owner, l_partkey AS variant, l_suppkey AS symbol FROM lineitem WHERE l_returnflag = "
    ranks = _pagerank_sql(12)
    return {
        "dispatch_edges": f"""WITH c AS ({fact}'A'), h AS ({fact}'R'), o AS (SELECT enum FROM h GROUP BY enum HAVING count(DISTINCT owner) = 1), a AS (SELECT DISTINCT enum, variant, symbol AS src FROM c), b AS (SELECT DISTINCT enum, variant, symbol AS dst FROM h),
k AS (SELECT enum, variant FROM (SELECT enum, variant, count(*) AS x FROM a GROUP BY ALL) JOIN (SELECT enum, variant, count(*) AS y FROM b GROUP BY ALL) USING (enum, variant) WHERE x * y <= 64)
SELECT DISTINCT src, dst FROM a JOIN k USING (enum, variant) JOIN b USING (enum, variant) JOIN o USING (enum) WHERE src <> dst""",
        "uncovered_calls": f"WITH e AS ({SQL_EDGES}) SELECT DISTINCT src, dst FROM e x WHERE kind = 'calls_name' AND NOT EXISTS (SELECT 1 FROM e y WHERE y.confidence = 'Exact' AND y.src = x.src AND y.dst = x.dst)",
        "coverage_gap": f"WITH k AS (SELECT * FROM ({ranks}) ORDER BY rank DESC, node LIMIT 500), p AS (SELECT node, CAST(row_number() OVER (ORDER BY rank DESC, node) AS INTEGER) AS place FROM k) SELECT * FROM p WHERE node NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 12)",
        "droppable_prefix": "WITH f AS (SELECT stream_id, min(lamport) AS floor FROM table_sync_chain_tips GROUP BY stream_id), e AS (SELECT DISTINCT entry_hash, stream_id, lamport FROM table_sync_entries) SELECT stream_id, CAST(count(*) FILTER (lamport < floor) AS BIGINT) AS n_droppable FROM e JOIN f USING (stream_id) GROUP BY stream_id",
    }


SQL = _sql()

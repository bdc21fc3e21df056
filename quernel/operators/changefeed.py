"""Applying a stream of inserts, updates and deletes: last-writer-wins state of a replicated table.

Every change carries a clock (lamport, device). Per key the change with the highest lamport wins, on
equal lamports that of the smaller device, at the same clock a removal beats an insert. That order is
total, so the fold is associative, commutative and idempotent: order of arrival, repetition and the
way the feed is cut into tasks never matter.

The fold runs in an embedded DuckDB per bucket, as ``INSERT ... ON CONFLICT DO UPDATE`` whose WHERE
compares the stored clock with the new one. It runs twice: on each input partition before the shuffle
(so a key that holds a third of the feed shrinks to one row per partition), and per key bucket after
it. Tombstones stay in the state. ``publish_state`` writes all buckets as one generation and flips a
pointer, so readers see all or nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.plans.cluster import broadcast_if_small, scratch, tasks_for
from quernel.plans.generations import publish, read_current
from quernel.sources.tables import table

#: Aggregated tips up to this many rows (about 200 bytes each) are broadcast; more are joined by shuffle.
TIPS_BROADCAST_ROWS = 200_000
#: Changes per bucket, which bounds the memory of one embedded database.
ROWS_PER_BUCKET = 1_000_000
#: Rows handed to one upsert statement.
UPSERT_ROWS = 200_000

KEY = ("repo_id", "table_name", "row_pk")
STATE_COLUMNS = (*KEY, "lamport", "device_fingerprint", "removed", "synced_hash")


def _winner(new: str, old: str) -> str:
    """SQL: the clock ``new`` beats the clock ``old``; the last term only makes conflicting writes deterministic."""
    return f"""
        ({new}.lamport > {old}.lamport) OR ({new}.lamport = {old}.lamport AND (
          {new}.device_fingerprint < {old}.device_fingerprint OR ({new}.device_fingerprint = {old}.device_fingerprint AND (
            ({new}.removed AND NOT {old}.removed) OR ({new}.removed = {old}.removed AND
              coalesce({new}.synced_hash, '') > coalesce({old}.synced_hash, ''))))))"""


def _upsert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import duckdb

    db = duckdb.connect(":memory:", config={"threads": 1, "temp_directory": ""})
    db.execute(
        "CREATE TABLE state(repo_id VARCHAR, table_name VARCHAR, row_pk VARCHAR, lamport BIGINT,"
        " device_fingerprint VARCHAR, removed BOOLEAN, synced_hash VARCHAR, PRIMARY KEY (repo_id, table_name, row_pk))"
    )

    def flush(held: list[pa.RecordBatch]) -> None:
        db.register("feed", pa.Table.from_batches(held))
        db.execute(f"""
            INSERT INTO state SELECT {", ".join(STATE_COLUMNS)} FROM feed
            QUALIFY row_number() OVER (PARTITION BY repo_id, table_name, row_pk
              ORDER BY lamport DESC, device_fingerprint, removed DESC, coalesce(synced_hash, '') DESC) = 1
            ON CONFLICT DO UPDATE SET lamport = excluded.lamport, device_fingerprint = excluded.device_fingerprint,
              removed = excluded.removed, synced_hash = excluded.synced_hash
            WHERE {_winner("excluded", "state")}""")
        db.unregister("feed")

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= UPSERT_ROWS:
            flush(held)
            held = []
    if held:
        flush(held)
    yield from db.sql("SELECT * FROM state").to_arrow_table().to_batches(max_chunksize=10_000)
    db.close()


def accepted_changes(entries: DataFrame, tips: DataFrame) -> DataFrame:
    """Entries whose own lamport is at most the highest tip of their (stream_id, device), as clocked changes.

    A ``restate`` is a removal at the clock it states. Entries that can't have a place in the order (null
    key, lamport, device or stated clock), have no tip or an unknown ``op`` don't count.
    """
    top = tips.groupBy(F.col("stream_id").alias("_s"), F.col("device_fingerprint").alias("_d")).agg(F.max("lamport").alias("_tip"))
    restated = F.col("op") == "restate"
    changes = entries.select(
        F.col("stream_id").alias("_s"),
        F.col("device_fingerprint").alias("_d"),
        F.col("lamport").alias("_own"),
        *KEY,
        F.when(restated, F.col("stated_lamport")).otherwise(F.col("lamport")).alias("lamport"),
        F.when(restated, F.col("stated_device_fingerprint")).otherwise(F.col("device_fingerprint")).alias("device_fingerprint"),
        (F.col("op") != "upsert").alias("removed"),
        F.when(F.col("op") == "upsert", F.col("synced_hash")).alias("synced_hash"),
    ).where(F.col("op").isin("upsert", "remove", "restate"))
    for name in (*KEY, "lamport", "device_fingerprint"):
        changes = changes.where(F.col(name).isNotNull())
    return changes.join(broadcast_if_small(top, TIPS_BROADCAST_ROWS), ["_s", "_d"]).where(F.col("_own") <= F.col("_tip")).select(*STATE_COLUMNS)


def fold_changes(changes: DataFrame, state: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """State after all ``changes``, tombstones (``removed``) kept, one row per key.

    ``state`` is an earlier result to continue from; its clocks compete like any change. Both need the
    columns ``STATE_COLUMNS``; others are ignored. No changes give an empty state. ``most``: an upper bound of the
    number of changes where one is known without reading them (the buckets' number follows it).
    """
    spark = changes.sparkSession
    changes = changes.select(*STATE_COLUMNS)
    rows = (changes.count() if most is None else most) + (0 if state is None else state.count())
    if state is not None:
        changes = changes.unionByName(state.select(*STATE_COLUMNS))
    folded = changes.mapInArrow(_upsert, changes.schema)
    return folded.repartition(tasks_for(spark, rows, ROWS_PER_BUCKET), *KEY).mapInArrow(_upsert, changes.schema)


def publish_state(state: DataFrame, root: str) -> DataFrame:
    """Publish a folded state atomically under ``root`` and return the published snapshot."""
    publish(state, root)
    return read_current(state.sparkSession, root)


def live_rows(state: DataFrame) -> DataFrame:
    """The rows that exist: keys whose winner isn't a removal."""
    return state.where(~F.col("removed")).select(*KEY, "synced_hash")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current rows of the replicated tables after the whole feed."""
    entries = table(spark, sf_dir, "table_sync_entries")
    changes = accepted_changes(entries, table(spark, sf_dir, "table_sync_chain_tips"))
    return live_rows(publish_state(fold_changes(changes, most=entries.count()), scratch(spark, "p5-state")))


def p5_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current rows against ``sync_published_rows``: how many keys are new, changed, removed or the same, per table."""
    now = p5_found(spark, sf_dir).withColumnRenamed("synced_hash", "now_hash").withColumn("_now", F.lit(True))
    before = table(spark, sf_dir, "sync_published_rows").groupBy(*KEY).agg(F.max("synced_hash").alias("old_hash")).withColumn("_old", F.lit(True))
    kind = (
        F.when(F.col("_old").isNull(), "new")
        .when(F.col("_now").isNull(), "removed")
        .when(F.col("now_hash").eqNullSafe(F.col("old_hash")), "same")
        .otherwise("changed")
    )
    return now.join(before, list(KEY), "full_outer").groupBy("table_name", kind.alias("change")).agg(F.count(F.lit(1)).alias("n_rows"))


_P5_SQL = """
WITH tips AS (SELECT stream_id, device_fingerprint, max(lamport) AS tip FROM table_sync_chain_tips GROUP BY ALL),
changes AS (
  SELECT e.repo_id, e.table_name, e.row_pk, e.op, CASE WHEN op = 'upsert' THEN e.synced_hash END AS synced_hash,
    CASE WHEN op = 'restate' THEN stated_lamport ELSE e.lamport END AS l,
    CASE WHEN op = 'restate' THEN stated_device_fingerprint ELSE e.device_fingerprint END AS d
  FROM table_sync_entries e JOIN tips t ON e.stream_id = t.stream_id AND e.device_fingerprint = t.device_fingerprint
  WHERE e.lamport <= t.tip),
winners AS (
  SELECT * FROM changes WHERE repo_id IS NOT NULL AND table_name IS NOT NULL AND row_pk IS NOT NULL AND l IS NOT NULL AND d IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY repo_id, table_name, row_pk
    ORDER BY l DESC, d, CASE WHEN op = 'upsert' THEN 1 ELSE 0 END, coalesce(synced_hash, '') DESC) = 1)
SELECT repo_id, table_name, row_pk, synced_hash FROM winners WHERE op = 'upsert'
"""
_P5_DRIFT_SQL = f"""
WITH now AS ({_P5_SQL}),
old AS (SELECT repo_id, table_name, row_pk, max(synced_hash) AS synced_hash FROM sync_published_rows GROUP BY ALL)
SELECT coalesce(n.table_name, o.table_name) AS table_name,
  CASE WHEN o.row_pk IS NULL THEN 'new' WHEN n.row_pk IS NULL THEN 'removed'
    WHEN n.synced_hash IS NOT DISTINCT FROM o.synced_hash THEN 'same' ELSE 'changed' END AS change,
  count(*) AS n_rows
FROM now n FULL OUTER JOIN old o ON n.repo_id = o.repo_id AND n.table_name = o.table_name AND n.row_pk = o.row_pk
GROUP BY ALL
"""

QUERIES = {"p5_found": p5_found, "p5_drift": p5_drift}
SQL = {"p5_found": _P5_SQL, "p5_drift": _P5_DRIFT_SQL}

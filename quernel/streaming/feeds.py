"""Streaming counterparts: incremental last-writer-wins state, debounced watcher events, incremental index of files.

Batches are applied with ``foreachBatch`` on top of the batch operators, so a stream and a batch over the same
rows give the same state. States are kept in buckets of their keys: a batch reads and writes those it touches and publishes
them at once with the others as they were; a replayed batch changes nothing.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quernel.operators.changefeed import KEY, TIPS_BROADCAST_ROWS, accepted_changes, fold_changes
from quernel.plans.cluster import broadcast_if_small, scratch, spill_table
from quernel.plans.generations import current, publish, publish_buckets, read_buckets, read_current

#: Quiet time that ends a burst of events, and the longest a burst may last (milliseconds, fixed values).
QUIET_MS, LATENCY_MS = 400, 2_500


#: Buckets of a streamed state.
STATE_BUCKETS = 64

#: The columns of a feed entry that its change depends on.
ENTRY_COLUMNS = ("stream_id", "device_fingerprint", "lamport", *KEY, "op", "stated_lamport", "stated_device_fingerprint", "synced_hash")


def apply_feed(entries: DataFrame, tips: DataFrame | Callable[[], DataFrame], root: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Fold a stream of feed entries into the state published under ``root``.

    Entries above their chain's tip, or of a chain without one, are parked in the table published under ``root``
    with the suffix ``-parked`` and are folded again at the start and with each batch. ``tips``: a table, or a
    function that reads it anew for each batch.
    """
    spark, aside = entries.sparkSession, root.rstrip("/") + "-parked"

    def fold(batch: DataFrame | None, _: int) -> None:
        session = spark if batch is None else batch.sparkSession
        parked = read_current(session, aside).select(*ENTRY_COLUMNS) if current(session, aside) else None
        rows = [x for x in (parked, None if batch is None else batch.select(*ENTRY_COLUMNS)) if x is not None]
        rows = (rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])).distinct()
        now = tips() if callable(tips) else tips
        changes = spill_table(accepted_changes(rows, now), "changes")
        # the state first: what is parked twice after a failure in between is folded again and changes nothing
        publish_buckets(fold_changes(changes, read_buckets(session, root, changes, list(KEY))), root, list(KEY), STATE_BUCKETS)
        top = now.groupBy("stream_id", "device_fingerprint").agg(F.max("lamport").alias("_tip"))
        above = rows.join(broadcast_if_small(top, TIPS_BROADCAST_ROWS), ["stream_id", "device_fingerprint"], "left").where(F.col("_tip").isNull() | (F.col("lamport") > F.col("_tip")))
        publish(above.select(*ENTRY_COLUMNS), aside)

    if current(spark, aside):
        fold(None, -1)
    writer = entries.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def upsert_files(files: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Keep the newest row of every (repo_id, path) of a stream of file rows published under ``root``; tombstones stay as rows."""

    def fold(batch: DataFrame, _: int) -> None:
        batch = spill_table(batch, "file-rows")
        state = read_buckets(batch.sparkSession, root, batch, ["repo_id", "path"])
        rows = batch if state is None else state.unionByName(batch)
        names = [c for c in batch.columns if c not in ("repo_id", "path")]
        order = F.struct(F.coalesce("indexed_at_ms", F.lit(-1)), F.to_json(F.struct(*names)))
        best = rows.groupBy("repo_id", "path").agg(F.max_by(F.struct(*names), order).alias("_r"))
        publish_buckets(best.select("repo_id", "path", "_r.*").select(*batch.columns), root, ["repo_id", "path"], STATE_BUCKETS)

    return files.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling_counts(events: DataFrame, width: str = "1 day", late: str = "7 days") -> DataFrame:
    """(start, event_type, n) of a stream (or batch) of events with a watermark."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


DEBOUNCED = "key string, started_ms bigint, fired_ms bigint, n_events bigint"


def debounce(events: DataFrame, quiet_ms: int = QUIET_MS, latency_ms: int = LATENCY_MS) -> DataFrame:
    """Bursts of (key, at_ms): a burst fires ``quiet_ms`` after its last event, at ``latency_ms`` after its first at the latest.

    An event at the very moment a burst fires starts the next one. Null keys or times are ignored. Events of a key are
    read in order of time from sorted partitions, so a key may hold any number of events.
    """
    rows = events.select(F.col("key").cast("string").alias("key"), F.col("at_ms").cast("bigint").alias("at_ms")).where("key is not null and at_ms is not null")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = first = last = None
        n = 0
        for b in batches:
            out = []
            for k, t in zip(b.key, b.at_ms, strict=True):
                if n and (k != key or t >= min(last + quiet_ms, first + latency_ms)):
                    out.append((key, first, min(last + quiet_ms, first + latency_ms), n))
                    n = 0
                if not n:
                    key, first = k, t
                last, n = t, n + 1
            yield pd.DataFrame(out, columns=["key", "started_ms", "fired_ms", "n_events"])
        if n:
            yield pd.DataFrame([(key, first, min(last + quiet_ms, first + latency_ms), n)], columns=["key", "started_ms", "fired_ms", "n_events"])

    return rows.repartition("key").sortWithinPartitions("key", "at_ms").mapInPandas(run, DEBOUNCED)


def _watcher(s, d):
    from quernel.sources.tables import table

    return table(s, d, "events").select(F.col("user_id").alias("key"), F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("at_ms"))


def maintenance_pass(stages: list[tuple[str, Callable[[], bool]]], budget_s: float, clock: Callable[[], float] = time.monotonic) -> list[tuple[str, str]]:
    """Run maintenance stages in order: (name, outcome) of each, ``done``, ``idle`` (it had nothing to do) or ``deferred``.

    A stage returns whether it changed anything; one that raises ends the pass. Stages that don't begin within the budget wait for the next pass.
    """
    began, out = clock(), []
    for name, stage in stages:
        if clock() - began >= budget_s:
            out.append((name, "deferred"))
            continue
        out.append((name, "done" if stage() else "idle"))
    return out


def _stream(s, d, name):
    """A given table as a stream."""
    from quernel.sources.tables import table

    # a pattern, since a stream takes no single file
    return s.readStream.schema(table(s, d, name).schema).parquet(f"{d}/{name}.parquet*")


def _streamed_feed(s, d):
    """The feed's rows through the stream, half of the tips at first, then all."""
    from quernel.operators.changefeed import live_rows
    from quernel.sources.tables import table

    root, tips = scratch(s, "feed-state"), table(s, d, "table_sync_chain_tips")
    early = tips.withColumn("lamport", F.floor(F.col("lamport") / 2).cast("bigint"))
    for now in (early, tips):
        apply_feed(_stream(s, d, "table_sync_entries"), now, root, f"{root}-checkpoint").awaitTermination()
    return live_rows(read_buckets(s, root))


def _streamed_files(s, d):
    root = scratch(s, "file-state")
    upsert_files(_stream(s, d, "files"), root, f"{root}-checkpoint").awaitTermination()
    return read_buckets(s, root).select("repo_id", "path", "indexed_at_ms")


def _tumbling(s, d):
    from quernel.sources.tables import table

    day = F.expr("unix_date(cast(start as date))").cast("bigint")
    return tumbling_counts(table(s, d, "events").select("event_id", "ts", "event_type")).select(day.alias("day"), "event_type", "n")


#: Event gaps of the given tables are hours, so the queries count seconds and use half a day and two days.
QUERIES = {"debounced_events": lambda s, d: debounce(_watcher(s, d), 43_200, 172_800), "daily_events": _tumbling, "streamed_feed": _streamed_feed, "streamed_files": _streamed_files}


def _sql() -> dict[str, str]:
    from quernel.operators.changefeed import SQL as FEED

    return {
        "daily_events": "SELECT CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
        "streamed_feed": FEED["p5_found"],
        "streamed_files": "SELECT repo_id, path, max(coalesce(indexed_at_ms, -1)) AS indexed_at_ms FROM files GROUP BY ALL",
    }


SQL = _sql()

"""Evidence: verdict metrics, retrieval quality, references and identifiers in prose, finding lifecycles, replicated row changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernel.operators.changefeed import KEY
from quernel.operators.search import dot
from quernel.plans.ranks import ranged
from quernel.sources.tables import table


def ratio(part, whole):
    """part / whole, 1 where the whole is 0."""
    return F.when(whole == 0, F.lit(1.0)).otherwise(part / whole)


def nearest_rank(rows: DataFrame, value: str, share: float, keys: list[str]) -> DataFrame:
    """(keys, value): the value at index ceil((n - 1) * share) of the sorted values; nulls don't count.

    Values are counted first and ranged by key and value, so neither a group nor a frequent value meets in one task.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    parts = ranged(counts, *keys, value)
    own = parts.groupBy("_p", *keys).agg(F.sum("_n").alias("_own"))
    group = Window.partitionBy(*keys)
    before = own.withColumn("_before", F.coalesce(F.sum("_own").over(group.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_all", F.sum("_own").over(group))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}"))
    placed = parts.alias("x").join(before.drop("_own").alias("y"), (F.col("x._p") == F.col("y._p")) & same).select("x.*", "_before", "_all")
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy("_p", *keys).orderBy(value))
    index = F.ceil((F.col("_all") - 1) * share)
    return placed.withColumn("_upto", upto).where((F.col("_upto") > index) & (F.col("_upto") - F.col("_n") <= index)).select(*keys, value)


def recall_at(ranking: DataFrame, gold: DataFrame, k: int, suffix: bool = False) -> DataFrame:
    """(query_id, recall): share of the gold items among the first k of (query_id, item, rank); 1 for a query without gold.

    With ``suffix`` an item also counts where it ends on the gold item (symbols by their last parts).
    """
    first = ranking.where(F.col("rank") <= k).select("query_id", F.col("item").alias("found")).distinct()
    gold = gold.select("query_id", "item").distinct()
    same = (F.col("found") == F.col("item")) | (F.col("found").endswith(F.col("item")) if suffix else F.lit(False))
    met = gold.join(first, "query_id").where(same).select("query_id", "item").distinct() if suffix else gold.join(first.withColumnRenamed("found", "item"), ["query_id", "item"], "left_semi")
    counts = gold.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).join(met.groupBy("query_id").agg(F.count(F.lit(1)).alias("m")), "query_id", "left")
    every = ranking.select("query_id").union(gold.select("query_id")).distinct()
    return every.join(counts, "query_id", "left").select("query_id", F.round(F.when(F.col("n").isNull(), 1.0).otherwise(F.coalesce("m", F.lit(0)) / F.col("n")), 6).alias("recall"))


def reciprocal_rank(ranking: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rr): 1 / rank of the first gold item within k, 0 without one."""
    hits = ranking.where(F.col("rank") <= k).join(gold, ["query_id", "item"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("first"))
    return ranking.select("query_id").distinct().join(hits, "query_id", "left").select("query_id", F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("rr"))


def duplicate_notes(notes: DataFrame) -> DataFrame:
    """(content_hash, first_id, n): notes (id, text) with the same trimmed text."""
    return notes.where("trim(text) <> ''").groupBy(F.sha2(F.trim("text"), 256).alias("content_hash")).agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")


def sync_findings(old: DataFrame, new: DataFrame) -> DataFrame:
    """(kind, subject, action): open, refresh, supersede or resolve by (kind, subject) and claim."""
    key = ["kind", "subject"]
    both = old.select(*key, F.col("claim").alias("was"), F.lit(True).alias("o")).join(new.select(*key, F.col("claim").alias("now"), F.lit(True).alias("n")), key, "full_outer")
    action = F.when(F.col("o").isNull(), "open").when(F.col("n").isNull(), "resolve").when(F.col("was").eqNullSafe(F.col("now")), "refresh").otherwise("supersede")
    return both.select(*key, action.alias("action"))


def effective_rank(findings: DataFrame, now_s: int, half_life_days: float = 14.0) -> DataFrame:
    """(id, rank): base rank halved every 14 days; what is seen later than now has no age."""
    age = F.greatest(F.lit(now_s) - F.col("seen_at_s"), F.lit(0)) / 86_400.0
    return findings.select("id", F.round(F.col("base") * F.pow(F.lit(0.5), age / half_life_days), 4).alias("rank"))


def row_ops(live: DataFrame, published: DataFrame) -> DataFrame:
    """(key, op, synced_hash): changes that bring the published rows to the live ones; of repeated published rows the greatest hash counts."""
    old = published.groupBy(*KEY).agg(F.max("synced_hash").alias("old_hash")).withColumn("_old", F.lit(True))
    both = live.select(*KEY, "synced_hash").withColumn("_live", F.lit(True)).join(old, list(KEY), "full_outer")
    op = F.when(F.col("_live").isNull(), "remove").when(F.col("_old").isNull() | ~F.col("synced_hash").eqNullSafe(F.col("old_hash")), "upsert")
    return both.select(*KEY, op.alias("op"), "synced_hash").where("op is not null")


def forks(entries: DataFrame) -> DataFrame:
    """(stream_id, device_fingerprint, lamport, n): places of a chain that hold more than one entry."""
    return entries.groupBy("stream_id", "device_fingerprint", "lamport").agg(F.countDistinct("entry_hash").alias("n")).where("n > 1")


def pending_entries(entries: DataFrame, tips: DataFrame) -> DataFrame:
    """(entry_hash, stream_id, lamport): entries above their chain's tip, or of a chain without one; parked until it moves."""
    top = tips.groupBy("stream_id", "device_fingerprint").agg(F.max("lamport").alias("tip"))
    rows = entries.select("entry_hash", "stream_id", "device_fingerprint", "lamport").distinct().join(top, ["stream_id", "device_fingerprint"], "left")
    return rows.where(F.col("tip").isNull() | (F.col("lamport") > F.col("tip"))).select("entry_hash", "stream_id", "lamport")


def chain_cursors(entries: DataFrame) -> DataFrame:
    """(stream_id, low, high, resume_ms): lowest and highest arrival of a stream; reading resumes one second before the high mark."""
    return entries.groupBy("stream_id").agg(F.min("received_at_ms").alias("low"), F.max("received_at_ms").alias("high"), (F.max("received_at_ms") - 1000).alias("resume_ms"))


def latest_refs(events: DataFrame) -> DataFrame:
    """(user_id, event_type, event_id, value): the last event of each identity, ties by id."""
    place = Window.partitionBy("user_id", "event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    return events.withColumn("_k", F.row_number().over(place)).where("_k = 1").select("user_id", "event_type", "event_id", "value")


def sessions(events: DataFrame, quiet_s: int = 6 * 3600) -> DataFrame:
    """(user_id, session, n_events, started): runs of events of a user no more than ``quiet_s`` apart."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.expr("timestampdiff(SECOND, _before, ts)")
    rows = events.select("user_id", "event_id", "ts").withColumn("_before", F.lag("ts").over(w))
    rows = rows.withColumn("_new", (F.col("_before").isNull() | (gap > quiet_s)).cast("int")).withColumn("session", F.sum("_new").over(w))
    return rows.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n_events"), F.min("event_id").alias("first_event"))


def event_lww(events: DataFrame) -> DataFrame:
    """(pk, value): last-writer-wins of events as row operations; the highest id wins, an error removes the row."""
    best = events.groupBy(F.col("user_id").alias("pk")).agg(F.max_by(F.struct("event_type", "value"), F.col("event_id")).alias("w"))
    return best.where("w.event_type <> 'error'").select("pk", F.round("w.value", 4).alias("value"))


def eval_summary(ranking: DataFrame, gold: DataFrame, latencies: DataFrame) -> DataFrame:
    """One row over the queries of ``ranking``: reciprocal rank within 10, recall at 3 and 10, share of queries with all gold within 10, p50 and p95 of ``latencies`` (ms)."""
    three, ten, rr = recall_at(ranking, gold, 3).withColumnRenamed("recall", "r3"), recall_at(ranking, gold, 10).withColumnRenamed("recall", "r10"), reciprocal_rank(ranking, gold)
    one = three.join(ten, "query_id").join(rr, "query_id").agg(
        F.round(F.avg("rr"), 6).alias("mrr_at_10"), F.round(F.avg("r3"), 6).alias("recall_at_3"), F.round(F.avg("r10"), 6).alias("recall_at_10"), F.round(F.avg((F.col("r10") >= 1).cast("double")), 6).alias("hit_rate"), F.count(F.lit(1)).alias("n_queries")
    )
    rows = latencies.select(F.lit(1).alias("g"), "ms")
    for name, share in (("latency_p50", 0.5), ("latency_p95", 0.95)):
        one = one.join(F.broadcast(nearest_rank(rows, "ms", share, ["g"]).select(F.col("ms").alias(name))))
    return one


#: Queries that are compared with all rows at once.
QUERY_BLOCK = 4_096


def _ranking(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The ten nearest of every hundredth vector, and the vectors of its label as gold (none for every third query)."""
    vectors = table(s, d, "embeddings")
    asked = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.col("label").alias("want"))
    blocks, ranking = max(1, -(-asked.count() // QUERY_BLOCK)), None
    place = Window.partitionBy("query_id").orderBy(F.desc("s"), "item")
    for block in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        pairs = vectors.select(F.col("vec_id").alias("item"), "embedding").join(F.broadcast(own), F.col("item") != F.col("query_id"))
        # the ten best of each task come first, so that no query's pairs are sorted as a whole
        best = pairs.select("query_id", "item", F.round(dot("embedding", "q"), 6).alias("s")).withColumn("rank", F.row_number().over(place)).where("rank <= 10").select("query_id", "item", "rank")
        ranking = best if ranking is None else ranking.unionByName(best)
    gold = vectors.select(F.col("vec_id").alias("item"), F.col("label").alias("want")).join(asked.where("query_id % 300 <> 0").select("query_id", "want"), "want").where("item <> query_id").select("query_id", "item")
    return ranking, gold


def _halves(s, d):
    events = table(s, d, "events")
    shape = lambda df: df.groupBy(F.col("event_type").alias("kind"), F.col("user_id").alias("subject")).agg(F.max(F.floor("value")).alias("claim"))
    return shape(events.where("event_id % 2 = 0")), shape(events.where("event_id % 2 = 1"))


def _forked(s, d):
    """The feed with a second entry at every fiftieth lamport."""
    e = table(s, d, "table_sync_entries").select("stream_id", "device_fingerprint", "lamport", "entry_hash")
    return e.unionByName(e.where("lamport % 50 = 0").withColumn("entry_hash", F.concat("entry_hash", F.lit("x"))))


def _documents(s, d):
    return table(s, d, "documents")


def _row_ops(s, d):
    from quernel.operators.changefeed import p5_found

    return row_ops(p5_found(s, d), table(s, d, "sync_published_rows"))


def _findings(s, d):
    return table(s, d, "events").select(F.col("event_id").alias("id"), F.col("value").alias("base"), F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("seen_at_s"))


QUERIES = {
    "percentiles": lambda s, d: nearest_rank(table(s, d, "events"), "value", 0.95, ["event_type"]),
    "recall_at_10": lambda s, d: recall_at(*_ranking(s, d), 10),
    "reciprocal_rank": lambda s, d: reciprocal_rank(*_ranking(s, d)),
    "eval_summary": lambda s, d: eval_summary(*_ranking(s, d), table(s, d, "events").select(F.col("value").alias("ms"))),
    "duplicate_notes": lambda s, d: duplicate_notes(_documents(s, d).select(F.col("doc_id").alias("id"), "text")),
    "sync_findings": lambda s, d: sync_findings(*_halves(s, d)),
    "effective_rank": lambda s, d: effective_rank(_findings(s, d), 1_735_689_600),
    "row_ops": _row_ops,
    "chain_forks": lambda s, d: forks(_forked(s, d)),
    "pending_entries": lambda s, d: pending_entries(table(s, d, "table_sync_entries"), table(s, d, "table_sync_chain_tips")),
    "chain_cursors": lambda s, d: chain_cursors(table(s, d, "table_sync_entries")),
    "latest_refs": lambda s, d: latest_refs(table(s, d, "events")),
    "sessions": lambda s, d: sessions(table(s, d, "events")),
    "event_lww": lambda s, d: event_lww(table(s, d, "events")),
}
_RANK = """WITH q AS (SELECT vec_id AS query_id, embedding AS q, label AS want FROM embeddings WHERE vec_id % 100 = 0), x AS (SELECT query_id, vec_id AS item, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 6) AS s, label = want AND query_id % 300 <> 0 AS good FROM embeddings JOIN q ON vec_id <> query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item) AS rank FROM x)"""


def _row_ops_sql() -> str:
    from quernel.operators.changefeed import SQL as FEED

    return f"""WITH live AS ({FEED["p5_found"]}), old AS (SELECT repo_id, table_name, row_pk, max(synced_hash) AS h FROM sync_published_rows GROUP BY ALL),
b AS (SELECT coalesce(l.repo_id, o.repo_id) AS repo_id, coalesce(l.table_name, o.table_name) AS table_name, coalesce(l.row_pk, o.row_pk) AS row_pk, l.synced_hash,
  CASE WHEN l.row_pk IS NULL THEN 'remove' WHEN o.row_pk IS NULL OR l.synced_hash IS DISTINCT FROM o.h THEN 'upsert' END AS op FROM live l FULL JOIN old o ON l.repo_id = o.repo_id AND l.table_name = o.table_name AND l.row_pk = o.row_pk)
SELECT * FROM b WHERE op IS NOT NULL"""


SQL = {
    "percentiles": "WITH p AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, value FROM p WHERE k = ceil((n - 1) * CAST(0.95 AS DOUBLE))",
    "recall_at_10": f"{_RANK} SELECT query_id, CASE WHEN count(*) FILTER (good) = 0 THEN 1 ELSE round(count(*) FILTER (good AND rank <= 10) / CAST(count(*) FILTER (good) AS DOUBLE), 6) END AS recall FROM r GROUP BY query_id",
    "reciprocal_rank": f"{_RANK} SELECT query_id, round(coalesce(1 / CAST(min(CASE WHEN good AND rank <= 10 THEN rank END) AS DOUBLE), 0), 6) AS rr FROM r GROUP BY query_id",
    "eval_summary": f"""{_RANK}, p AS (SELECT query_id, count(*) FILTER (good) AS n, count(*) FILTER (good AND rank <= 3) AS a, count(*) FILTER (good AND rank <= 10) AS b, min(CASE WHEN good AND rank <= 10 THEN rank END) AS f FROM r GROUP BY query_id),
k AS (SELECT round(CASE WHEN n = 0 THEN 1 ELSE a / CAST(n AS DOUBLE) END, 6) AS r3, round(CASE WHEN n = 0 THEN 1 ELSE b / CAST(n AS DOUBLE) END, 6) AS r10, round(coalesce(1 / CAST(f AS DOUBLE), 0), 6) AS rr FROM p), v AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS m FROM events WHERE value IS NOT NULL)
SELECT round(avg(rr), 6) AS mrr_at_10, round(avg(r3), 6) AS recall_at_3, round(avg(r10), 6) AS recall_at_10, round(avg(CASE WHEN r10 >= 1 THEN 1 ELSE 0 END), 6) AS hit_rate, count(*) AS n_queries, (SELECT max(value) FROM v WHERE i = ceil((m - 1) * CAST(0.5 AS DOUBLE))) AS latency_p50, (SELECT max(value) FROM v WHERE i = ceil((m - 1) * CAST(0.95 AS DOUBLE))) AS latency_p95 FROM k""",
    "duplicate_notes": "SELECT sha256(trim(text, ' ')) AS content_hash, min(doc_id) AS first_id, count(*) AS n FROM documents WHERE trim(text, ' ') <> '' GROUP BY 1 HAVING count(*) > 1",
    "sync_findings": """WITH h AS (SELECT event_type AS kind, user_id AS subject, event_id % 2 AS half, max(floor(value)) AS claim FROM events GROUP BY ALL), a AS (SELECT * FROM h WHERE half = 0), b AS (SELECT * FROM h WHERE half = 1)
SELECT coalesce(a.kind, b.kind) AS kind, coalesce(a.subject, b.subject) AS subject, CASE WHEN a.kind IS NULL THEN 'open' WHEN b.kind IS NULL THEN 'resolve' WHEN a.claim IS NOT DISTINCT FROM b.claim THEN 'refresh' ELSE 'supersede' END AS action FROM a FULL JOIN b ON a.kind = b.kind AND a.subject = b.subject""",
    "effective_rank": "SELECT event_id AS id, round(value * pow(CAST(0.5 AS DOUBLE), greatest(1735689600 - CAST(floor(epoch(ts)) AS BIGINT), 0) / CAST(86400 AS DOUBLE) / 14), 4) AS rank FROM events",
    "row_ops": _row_ops_sql(),
    "chain_forks": "SELECT stream_id, device_fingerprint, lamport, count(DISTINCT entry_hash) AS n FROM (SELECT * FROM table_sync_entries UNION ALL SELECT * REPLACE (entry_hash || 'x' AS entry_hash) FROM table_sync_entries WHERE lamport % 50 = 0) GROUP BY ALL HAVING count(DISTINCT entry_hash) > 1",
    "pending_entries": "WITH t AS (SELECT stream_id, device_fingerprint, max(lamport) AS tip FROM table_sync_chain_tips GROUP BY ALL), e AS (SELECT DISTINCT entry_hash, stream_id, device_fingerprint, lamport FROM table_sync_entries) SELECT entry_hash, e.stream_id, e.lamport FROM e LEFT JOIN t USING (stream_id, device_fingerprint) WHERE tip IS NULL OR e.lamport > tip",
    "chain_cursors": "SELECT stream_id, min(received_at_ms) AS low, max(received_at_ms) AS high, max(received_at_ms) - 1000 AS resume_ms FROM table_sync_entries GROUP BY stream_id",
    "latest_refs": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    "sessions": """WITH g AS (SELECT user_id, event_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR floor(epoch(ts) - epoch(lag(ts) OVER w)) > 21600 THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, event_id, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM g) SELECT user_id, session, count(*) AS n_events, min(event_id) AS first_event FROM s GROUP BY ALL""",
    "event_lww": "WITH w AS (SELECT user_id AS pk, arg_max(event_type, event_id) AS t, arg_max(value, event_id) AS v FROM events GROUP BY user_id) SELECT pk, round(v, 4) AS value FROM w WHERE t <> 'error'",
}

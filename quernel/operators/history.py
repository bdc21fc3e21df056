"""History: commits and churn per path, change coupling, replay cases, clusters of files.

Each operator takes DataFrames of the logical schema (``sources.projections``). Ties always end on a unique key,
so that a different plan can't change a result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernel.functions.exprs import round4
from quernel.plans.cluster import spill_table
from quernel.sources.projections import SQL_CHANGES, SQL_COMMITS, commits, file_changes
from quernel.sources.tables import table

#: Commits of the coupling window, file counts that take part, least shared commits and lift.
WINDOW, FEWEST, MOST, LEAST_SHARED, LEAST_LIFT = 1_000, 2, 40, 2, 1.5
RECENT_SECONDS = 90 * 24 * 60 * 60


def history_for_path(changes: DataFrame, commit_table: DataFrame, path) -> DataFrame:
    """Commits that touched ``path``, newest first (ties by hash)."""
    own = changes.where(F.col("path") == path).join(commit_table, "hash")
    return own.orderBy(F.desc("authored_at_s"), "hash")


def history_for_symbols(hits: DataFrame, changes: DataFrame, commit_table: DataFrame, most: int) -> DataFrame:
    """(symbol_id, hash, rank): the newest ``most`` commits of the file of each looked-up symbol (symbol_id, path); all symbols in one join."""
    rows = hits.select("symbol_id", "path").distinct().join(changes.select("hash", "path").distinct(), "path").join(commit_table.select("hash", "authored_at_s"), "hash")
    place = Window.partitionBy("symbol_id").orderBy(F.desc("authored_at_s"), "hash")
    return rows.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= most).select("symbol_id", "hash", "rank")


def indexed_cases(cases: DataFrame, indexed: DataFrame) -> DataFrame:
    """(hash, path): the gold of replay cases (hash, path) that is indexed (path); a case without any is dropped."""
    return cases.select("hash", "path").distinct().join(indexed.select("path").distinct(), "path", "left_semi").select("hash", "path")


def recently_changed(changes: DataFrame, commit_table: DataFrame) -> DataFrame:
    """(path, changed_at_s): the last change of every path."""
    return changes.select("hash", "path").join(commit_table.select("hash", "authored_at_s"), "hash").groupBy("path").agg(F.max("authored_at_s").alias("changed_at_s"))


def churn(changes: DataFrame, commit_table: DataFrame) -> DataFrame:
    """Per path: distinct commits, rows within 90 days of the newest commit, additions and deletions."""
    newest = commit_table.agg(F.coalesce(F.max("authored_at_s"), F.lit(0)).alias("newest"))
    rows = changes.join(commit_table.select("hash", "authored_at_s"), "hash").join(F.broadcast(newest))
    return rows.groupBy("path").agg(
        F.countDistinct("hash").alias("commit_touch_count"),
        F.sum((F.col("authored_at_s") >= F.col("newest") - RECENT_SECONDS).cast("bigint")).alias("recent_touch_count"),
        F.coalesce(F.sum("additions"), F.lit(0)).alias("additions"),
        F.coalesce(F.sum("deletions"), F.lit(0)).alias("deletions"),
    )


def graded_git_scores(churned: DataFrame, recent_cap: float = 5.0, total_cap: float = 20.0) -> DataFrame:
    """(path, git_score): 0.6 of the capped recent touches and 0.4 of the capped total."""
    score = 0.6 * F.least(F.col("recent_touch_count") / recent_cap, F.lit(1.0)) + 0.4 * F.least(F.col("commit_touch_count") / total_cap, F.lit(1.0))
    return churned.select("path", round4(score).alias("git_score"))


def eligible_window(changes: DataFrame, commit_table: DataFrame, window: int | None = WINDOW) -> DataFrame:
    """(hash, path, authored_at_s) of the last ``window`` commits (all if None) that touch 2 to 40 paths."""
    sized = changes.groupBy("hash").agg(F.countDistinct("path").alias("n")).where(F.col("n").between(FEWEST, MOST)).select("hash")
    kept = sized.join(commit_table.select("hash", "authored_at_s"), "hash")
    if window is not None:
        kept = kept.orderBy(F.desc("authored_at_s"), F.desc("hash")).limit(window)
    return changes.select("hash", "path").distinct().join(kept, "hash")


def path_pairs(rows: DataFrame) -> DataFrame:
    """(path_a, path_b, hash, authored_at_s), path_a < path_b; a commit has at most 40 paths, so at most 780 pairs."""
    a, b = rows.withColumnRenamed("path", "path_a"), rows.select("hash", F.col("path").alias("path_b"))
    return a.join(b, "hash").where("path_a < path_b")


def change_couplings(changes: DataFrame, commit_table: DataFrame, window: int | None = WINDOW, least_lift: float = LEAST_LIFT) -> DataFrame:
    """Pairs of paths that change together at least twice and ``least_lift`` times as often as by chance.

    Counts are within the window; n_commits is its number of eligible commits.
    """
    rows = spill_table(eligible_window(changes, commit_table, window), "coupling-window")
    ends = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.countDistinct("hash").alias("n_commits"))
    pairs = path_pairs(rows).groupBy("path_a", "path_b").agg(F.count(F.lit(1)).alias("co_change_count"), F.max("authored_at_s").alias("last_at_s"))
    pairs = pairs.where(F.col("co_change_count") >= LEAST_SHARED)
    both = pairs.join(ends.toDF("path_a", "count_a"), "path_a").join(ends.toDF("path_b", "count_b"), "path_b").join(F.broadcast(total))
    return both.where(F.col("co_change_count") * F.col("n_commits") >= least_lift * F.col("count_a") * F.col("count_b"))


def coupled_files(couplings: DataFrame) -> DataFrame:
    """(path, partner, confidence, co_change_count, rank): both sides of every coupling, ranked for each path."""
    a = couplings.select(F.col("path_a").alias("path"), F.col("path_b").alias("partner"), "co_change_count", F.col("count_a").alias("own"))
    b = couplings.select(F.col("path_b").alias("path"), F.col("path_a").alias("partner"), "co_change_count", F.col("count_b").alias("own"))
    both = a.union(b).withColumn("confidence", round4(F.col("co_change_count") / F.col("own"))).drop("own")
    place = Window.partitionBy("path").orderBy(F.desc("confidence"), F.desc("co_change_count"), "partner")
    return both.withColumn("rank", F.row_number().over(place))


def replay_cases(changes: DataFrame, commit_table: DataFrame, most_files: int = 3) -> DataFrame:
    """(hash, n_files, gold): commits of 1 to ``most_files`` paths that aren't merges, with their sorted paths."""
    gold = changes.groupBy("hash").agg(F.countDistinct("path").alias("n_files")).where(F.col("n_files").between(1, most_files))
    paths = changes.join(gold, "hash").groupBy("hash", "n_files").agg(F.array_join(F.transform(F.sort_array(F.collect_set("path")), lambda p: p.cast("string")), ",").alias("gold"))
    return paths.join(commit_table.where(~F.col("subject").startswith("Merge ")).select("hash"), "hash", "left_semi")


def co_touch(changes: DataFrame, commit_table: DataFrame) -> DataFrame:
    """(path_a, path_b, n): commits of 2 to 40 paths that touch both, over all history."""
    return path_pairs(eligible_window(changes, commit_table, None)).groupBy("path_a", "path_b").agg(F.count(F.lit(1)).alias("n"))


def _tables(spark: SparkSession, sf_dir: str, path: str = "l_suppkey") -> tuple[DataFrame, DataFrame]:
    return file_changes(spark, sf_dir, path), commits(spark, sf_dir)


def q_history_for_path(spark, sf_dir):
    return history_for_path(*_tables(spark, sf_dir), 7).select("hash", "path", "additions", "deletions", "author", "authored_at_s")


def q_recently_changed(spark, sf_dir):
    return recently_changed(*_tables(spark, sf_dir))


def q_churn(spark, sf_dir):
    return churn(*_tables(spark, sf_dir))


def q_git_scores(spark, sf_dir):
    return graded_git_scores(churn(*_tables(spark, sf_dir)))


def q_couplings(spark, sf_dir):
    return change_couplings(*_tables(spark, sf_dir)).select("path_a", "path_b", "co_change_count", "count_a", "count_b", "n_commits", "last_at_s")


def q_coupled_files(spark, sf_dir):
    return coupled_files(change_couplings(*_tables(spark, sf_dir)))


def q_part_couplings(spark, sf_dir):
    return change_couplings(*_tables(spark, sf_dir, "l_partkey")).select("path_a", "path_b", "co_change_count")


def q_history_for_symbols(spark, sf_dir):
    hits = table(spark, sf_dir, "supplier").where("s_nationkey < 5").select(F.col("s_suppkey").alias("path"), (F.col("s_suppkey") * 3).alias("symbol_id"))
    return history_for_symbols(hits, *_tables(spark, sf_dir), 6)


def q_indexed_cases(spark, sf_dir):
    changes, commit_table = _tables(spark, sf_dir)
    cases = changes.join(replay_cases(changes, commit_table).select("hash"), "hash", "left_semi")
    return indexed_cases(cases, table(spark, sf_dir, "supplier").where("s_nationkey % 2 = 0").select(F.col("s_suppkey").alias("path")))


def q_replay_cases(spark, sf_dir):
    return replay_cases(*_tables(spark, sf_dir))


def q_co_touch(spark, sf_dir):
    return co_touch(*_tables(spark, sf_dir))


QUERIES = {
    "history_for_path": q_history_for_path, "recently_changed": q_recently_changed, "churn": q_churn, "git_scores": q_git_scores, "change_couplings": q_couplings,
    "coupled_files": q_coupled_files, "part_couplings": q_part_couplings, "replay_cases": q_replay_cases, "co_touch": q_co_touch, "history_for_symbols": q_history_for_symbols, "indexed_cases": q_indexed_cases,
}
_BASE = f"WITH commits AS ({SQL_COMMITS}), changes AS ({SQL_CHANGES})"
_CHURN = """, churned AS (SELECT path, count(DISTINCT hash) AS commit_touch_count,
  CAST(sum(CASE WHEN authored_at_s >= (SELECT max(authored_at_s) FROM commits) - 7776000 THEN 1 ELSE 0 END) AS BIGINT) AS recent_touch_count,
  CAST(sum(additions) AS BIGINT) AS additions, CAST(sum(deletions) AS BIGINT) AS deletions FROM changes JOIN commits USING (hash) GROUP BY path)"""


def _coupling_sql(path: str = "l_suppkey") -> str:
    return f"""{_BASE.replace("l_suppkey", path)}, sized AS (SELECT hash FROM changes GROUP BY hash HAVING count(DISTINCT path) BETWEEN 2 AND 40),
kept AS (SELECT hash, authored_at_s FROM sized JOIN commits USING (hash) ORDER BY authored_at_s DESC, hash DESC LIMIT 1000),
r AS (SELECT DISTINCT hash, path, authored_at_s FROM changes JOIN kept USING (hash)),
ends AS (SELECT path, count(*) AS n FROM r GROUP BY path),
pairs AS (SELECT a.path AS path_a, b.path AS path_b, count(*) AS co_change_count, max(a.authored_at_s) AS last_at_s
  FROM r a JOIN r b ON a.hash = b.hash AND a.path < b.path GROUP BY ALL HAVING count(*) >= 2),
couplings AS (SELECT p.*, x.n AS count_a, y.n AS count_b, (SELECT count(DISTINCT hash) FROM r) AS n_commits FROM pairs p JOIN ends x ON x.path = path_a JOIN ends y ON y.path = path_b
  WHERE co_change_count * (SELECT count(DISTINCT hash) FROM r) >= CAST(1.5 AS DOUBLE) * x.n * y.n)"""


SQL = {
    "history_for_symbols": f"{_BASE} SELECT path * 3 AS symbol_id, hash, CAST(row_number() OVER (PARTITION BY path ORDER BY authored_at_s DESC, hash) AS INTEGER) AS rank FROM changes JOIN commits USING (hash) WHERE path IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 5) QUALIFY row_number() OVER (PARTITION BY path ORDER BY authored_at_s DESC, hash) <= 6",
    "indexed_cases": f"{_BASE} SELECT hash, path FROM changes WHERE hash IN (SELECT hash FROM changes GROUP BY hash HAVING count(DISTINCT path) BETWEEN 1 AND 3) AND hash IN (SELECT hash FROM commits WHERE subject NOT LIKE 'Merge %') AND path IN (SELECT s_suppkey FROM supplier WHERE s_nationkey % 2 = 0)",
    "history_for_path": f"{_BASE} SELECT hash, path, additions, deletions, author, authored_at_s FROM changes JOIN commits USING (hash) WHERE path = 7",
    "recently_changed": f"{_BASE} SELECT path, max(authored_at_s) AS changed_at_s FROM changes JOIN commits USING (hash) GROUP BY path",
    "churn": f"{_BASE}{_CHURN} SELECT * FROM churned",
    "git_scores": f"{_BASE}{_CHURN} SELECT path, floor((CAST(0.6 AS DOUBLE) * least(recent_touch_count / CAST(5 AS DOUBLE), 1) + CAST(0.4 AS DOUBLE) * least(commit_touch_count / CAST(20 AS DOUBLE), 1)) * 10000 + 0.5) / 10000 AS git_score FROM churned",
    "change_couplings": _coupling_sql() + " SELECT path_a, path_b, co_change_count, count_a, count_b, n_commits, last_at_s FROM couplings",
    "part_couplings": _coupling_sql("l_partkey") + " SELECT path_a, path_b, co_change_count FROM couplings",
    "coupled_files": _coupling_sql()
    + """, b AS (SELECT path_a AS path, path_b AS partner, co_change_count, count_a AS own FROM couplings UNION ALL SELECT path_b, path_a, co_change_count, count_b FROM couplings),
c AS (SELECT path, partner, co_change_count, floor(co_change_count / CAST(own AS DOUBLE) * 10000 + 0.5) / 10000 AS confidence FROM b)
SELECT *, CAST(row_number() OVER (PARTITION BY path ORDER BY confidence DESC, co_change_count DESC, partner) AS INTEGER) AS rank FROM c""",
    "replay_cases": f"{_BASE} SELECT hash, count(DISTINCT path) AS n_files, array_to_string(list_sort(list(DISTINCT path)), ',') AS gold FROM changes JOIN commits USING (hash) WHERE subject NOT LIKE 'Merge %' GROUP BY hash HAVING count(DISTINCT path) BETWEEN 1 AND 3",
    "co_touch": f"{_BASE}, sized AS (SELECT hash FROM changes GROUP BY hash HAVING count(DISTINCT path) BETWEEN 2 AND 40), r AS (SELECT DISTINCT hash, path FROM changes JOIN sized USING (hash)) SELECT a.path AS path_a, b.path AS path_b, count(*) AS n FROM r a JOIN r b ON a.hash = b.hash AND a.path < b.path GROUP BY ALL",
}

"""Files at a glance: the measures of every file, ranked views of them, ownership clusters, totals and the tree map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernel.functions.exprs import capped, common_prefix, is_test_path, path_bucket, path_parts, path_similarity, round4
from quernel.operators.graph import connected_components
from quernel.operators.history import RECENT_SECONDS
from quernel.operators.index import latest
from quernel.plans.cluster import spill_table
from quernel.sources.tables import table

#: Weights of the measures in each view, and what a test keeps there (fixed values).
BRIEF_WEIGHTS = {
    "spine": {"coupling": 0.35, "symbols": 0.18, "size": 0.12, "churn": 0.15, "memories": 0.15, "papertrail": 0.05},
    "churn": {"churn": 0.65, "coupling": 0.15, "size": 0.10, "memories": 0.07, "papertrail": 0.03},
    "god_modules": {"size": 0.30, "symbols": 0.25, "coupling": 0.25, "churn": 0.12, "memories": 0.08},
    "refactor_candidates": {"size": 0.20, "symbols": 0.18, "coupling": 0.25, "churn": 0.25, "memories": 0.09, "papertrail": 0.03},
}
TEST_FACTOR = {"spine": 0.70, "churn": 1.0, "god_modules": 0.45, "refactor_candidates": 0.45}
GENERATED_FACTOR = 0.25
#: Weights of the likeness of two files of one directory, the likeness that joins them, files of a directory that are all paired (fixed values).
PAIR_WEIGHTS = {"path": 0.43, "co_touch": 0.24, "graph": 0.22, "language": 0.06, "kind": 0.03, "churn": 0.02}
LEAST_LIKENESS, BUCKET_FILES = 0.34, 120
FEWEST, MOST = 2, 40
COUNTS = ("chunk_count", "line_count", "symbol_count", "fan_in", "fan_out", "commit_touch_count", "recent_touch_count", "additions", "deletions", "papertrail_ref_count", "active_notes", "stale_notes", "obsolete_notes")


def file_metrics(files: DataFrame, chunks: DataFrame, symbols: DataFrame, edges: DataFrame, changes: DataFrame, refs: DataFrame, notes: DataFrame) -> DataFrame:
    """``files`` (file_id, repo_id, path, ...) with all measures, 0 where there is nothing; each is aggregated before it is joined.

    ``chunks``: file_id, end_line; ``symbols``: symbol_id, file_id; ``edges``: src, dst, hidden; ``changes``: repo_id, path, hash,
    authored_at_s, additions, deletions; ``refs``: repo_id, path; ``notes``: repo_id, path, status. Recent is within 90 days of the repository's newest commit.
    """
    n = F.count(F.lit(1))
    size = chunks.groupBy("file_id").agg(n.alias("chunk_count"), F.coalesce(F.max("end_line"), F.lit(0)).alias("line_count"))
    owner = symbols.select("symbol_id", "file_id")
    shown = edges.where(F.coalesce("hidden", F.lit(0)) == 0)
    ends = lambda c, out: shown.groupBy(F.col(c).alias("symbol_id")).agg(n.alias("n")).join(owner, "symbol_id").groupBy("file_id").agg(F.sum("n").alias(out))
    newest = changes.groupBy("repo_id").agg(F.max("authored_at_s").alias("newest"))
    touched = changes.join(F.broadcast(newest), "repo_id").groupBy("repo_id", "path").agg(
        F.countDistinct("hash").alias("commit_touch_count"), F.sum((F.col("authored_at_s") >= F.col("newest") - RECENT_SECONDS).cast("bigint")).alias("recent_touch_count"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions")
    )
    of = lambda s: F.sum((F.col("status") == s).cast("bigint")).alias(f"{s}_notes")
    noted = notes.groupBy("repo_id", "path").agg(of("active"), of("stale"), of("obsolete"))
    rows = files
    for part in (size, symbols.groupBy("file_id").agg(n.alias("symbol_count")), ends("dst", "fan_in"), ends("src", "fan_out")):
        rows = rows.join(part, "file_id", "left")
    for part in (touched, refs.groupBy("repo_id", "path").agg(n.alias("papertrail_ref_count")), noted):
        rows = rows.join(part, ["repo_id", "path"], "left")
    return rows.select(*files.columns, *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in COUNTS])


def measures(metrics: DataFrame) -> DataFrame:
    """The capped measures of a file that the views weigh."""
    c = F.col
    churn = capped(c("commit_touch_count") / 25) * 0.5 + capped(c("recent_touch_count") / 8) * 0.25 + capped((c("additions") + c("deletions")) / 5000) * 0.25
    return metrics.select(
        "*", capped(c("line_count") / 800).alias("size"), capped(c("symbol_count") / 40).alias("symbols"), capped((c("fan_in") + c("fan_out")) / 50).alias("coupling"), capped(churn).alias("churn"),
        capped(capped(c("active_notes") / 5) + capped(c("stale_notes") / 3) * 0.5).alias("memories"), capped(c("papertrail_ref_count") / 8).alias("papertrail"),
    )


def category(mode: str) -> Column:
    """What a file of a view is taken for."""
    c, links = F.col, F.col("fan_in") + F.col("fan_out")
    return {
        "spine": F.when(links >= 25, "central_coupling_point").when(c("active_notes") > 0, "source_anchored_context").otherwise("structural_spine"),
        "churn": F.when(c("recent_touch_count") >= 2, "recent_churn_hotspot").otherwise("historical_churn_hotspot"),
        "god_modules": F.when((c("symbol_count") >= 40) & (c("fan_in") > 0) & (c("fan_out") > 0), "large_mixed_module").otherwise("large_module_candidate"),
        "refactor_candidates": F.when((c("commit_touch_count") >= 10) & (links >= 15), "high_churn_coupling_point").otherwise("needs_human_review"),
    }[mode]


def file_brief(metrics: DataFrame, mode: str) -> DataFrame:
    """(file_id, path, score, category) of every file in a view; generated files count a quarter, tests less in most views."""
    score = sum((F.col(n) * w for n, w in BRIEF_WEIGHTS[mode].items()), F.lit(0.0))
    score = F.when(F.col("generated") != 0, score * GENERATED_FACTOR).otherwise(score)
    score = F.when(is_test_path(F.col("path")), score * TEST_FACTOR[mode]).otherwise(score)
    return measures(metrics).select("file_id", "path", round4(score).alias("score"), category(mode).alias("category"))


def summary_counts(files: DataFrame, edges: DataFrame, changes: DataFrame, notes: DataFrame) -> DataFrame:
    """One row: files, generated ones, shown edges, commits, file changes and notes by status."""
    c = F.count(F.lit(1))
    rows = files.agg(c.alias("total_files"), F.coalesce(F.sum((F.col("generated") != 0).cast("bigint")), F.lit(0)).alias("generated_files"))
    rows = rows.join(edges.where(F.coalesce("hidden", F.lit(0)) == 0).agg(c.alias("graph_edges")))
    rows = rows.join(changes.agg(F.countDistinct("repo_id", "hash").alias("git_commits"), c.alias("git_file_changes")))
    of = lambda s: F.coalesce(F.sum((F.col("status") == s).cast("bigint")), F.lit(0)).alias(f"{s}_notes")
    return rows.join(notes.agg(of("active"), of("stale"), of("obsolete")))


def symbol_kinds(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(path, kinds): how many symbols of each kind a file has, ``kind=n`` joined by commas."""
    counts = symbols.join(files.select("file_id", "path"), "file_id").groupBy("path", "kind").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("path").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "kind", F.col("n").cast("string")))), ",").alias("kinds"))


def _churn_likeness() -> Column:
    near = lambda a, b: F.when(F.greatest(a, b) == 0, 0.0).otherwise(1 - F.abs(a - b) / F.greatest(a, b))
    c = F.col
    return (near(c("l_lines"), c("r_lines")) + near(c("l_touches"), c("r_touches"))) * 0.5


def co_touch_pairs(changes: DataFrame, files: DataFrame) -> DataFrame:
    """(a, b, t): pairs of files that commits of 2 to 40 files touch together; other commits don't count."""
    rows = changes.select("repo_id", "hash", "path").distinct().join(files.select("repo_id", "path", "file_id"), ["repo_id", "path"])
    sized = rows.groupBy("repo_id", "hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(FEWEST, MOST)).select("repo_id", "hash")
    own = rows.join(sized, ["repo_id", "hash"])
    pairs = own.select("repo_id", "hash", F.col("file_id").alias("a")).join(own.select("repo_id", "hash", F.col("file_id").alias("b")), ["repo_id", "hash"]).where("a < b")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("t"))


def graph_pairs(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(a, b, g): shown edges between symbols of two files, either way; edges are counted by their ends first."""
    owner = symbols.select("symbol_id", "file_id")
    ends = edges.where(F.coalesce("hidden", F.lit(0)) == 0).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    rows = ends.join(owner.toDF("src", "f"), "src").join(owner.toDF("dst", "h"), "dst").where("f <> h")
    return rows.groupBy(F.least("f", "h").alias("a"), F.greatest("f", "h").alias("b")).agg(F.sum("n").alias("g"))


def likeness(metrics: DataFrame, touched: DataFrame, linked: DataFrame) -> DataFrame:
    """(a, b, t, g, score) of the pairs of files of one directory (five parts deep at most) of a repository.

    Candidates are pairs with common commits or edges, and all pairs of a directory of 2 to 120 files. Other pairs score 0.
    """
    own = metrics.select("file_id", "repo_id", "path", path_bucket(F.col("path")).alias("bucket"), "language", "kind", (F.col("additions") + F.col("deletions")).alias("lines"), F.col("commit_touch_count").alias("touches"))
    sized = own.groupBy("repo_id", "bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(2, BUCKET_FILES)).select("repo_id", "bucket")
    few = own.join(sized, ["repo_id", "bucket"]).select("repo_id", "bucket", "file_id")
    near = few.withColumnRenamed("file_id", "a").join(few.withColumnRenamed("file_id", "b"), ["repo_id", "bucket"]).where("a < b").select("a", "b")
    zero = F.lit(0).cast("bigint")
    every = near.select("a", "b", zero.alias("t"), zero.alias("g")).unionByName(touched.select("a", "b", "t", zero.alias("g"))).unionByName(linked.select("a", "b", zero.alias("t"), "g"))
    pairs = every.groupBy("a", "b").agg(F.sum("t").alias("t"), F.sum("g").alias("g"))
    side = lambda x, k: own.select(F.col("file_id").alias(k), *[F.col(c).alias(f"{x}_{c}") for c in ("repo_id", "path", "bucket", "language", "kind", "lines", "touches")])
    both = pairs.join(side("l", "a"), "a").join(side("r", "b"), "b").where("l_bucket = r_bucket and l_repo_id = r_repo_id")
    w, c = PAIR_WEIGHTS, F.col
    same = lambda n: F.when(c(f"l_{n}").eqNullSafe(c(f"r_{n}")), 1.0).otherwise(0.0)
    score = path_similarity(c("l_path"), c("r_path")) * w["path"] + capped(c("t") / 4) * w["co_touch"] + capped(c("g") / 6) * w["graph"] + same("language") * w["language"] + same("kind") * w["kind"] + _churn_likeness() * w["churn"]
    return both.select("a", "b", "t", "g", capped(score).alias("score"))


def file_clusters(metrics: DataFrame, pairs: DataFrame, least: int = 2) -> DataFrame:
    """Clusters of files joined by a likeness of 0.34 or more: (cluster, name, n_files, score, category, confidence, co_touch_edges, graph_edges).

    A cluster is named by its smallest file and by the directory its files share (else its most frequent language).
    """
    kept = spill_table(pairs.where(F.col("score") >= LEAST_LIKENESS), "cluster-pairs")
    parts = spill_table(connected_components(kept.select(F.col("a").alias("src"), F.col("b").alias("dst"))).toDF("file_id", "cluster"), "clusters")
    links = kept.join(parts.withColumnRenamed("file_id", "a"), "a").groupBy("cluster").agg(F.avg("score").alias("likeness"), F.sum("t").alias("co_touch_edges"), F.sum("g").alias("graph_edges"))
    own = metrics.join(parts, "file_id")
    parent = F.slice(path_parts(F.col("path")), 1, F.greatest(F.size(path_parts(F.col("path"))) - 1, F.lit(0)))
    c = F.col
    rolled = own.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum(c("fan_in") + c("fan_out")).alias("links"), F.sum("commit_touch_count").alias("touches"), F.sum("symbol_count").alias("symbols"), F.min(parent).alias("lo"), F.max(parent).alias("hi")
    ).where(c("n_files") >= max(least, 2))
    spoken = own.groupBy("cluster", "language").agg(F.count(F.lit(1)).alias("n")).groupBy("cluster").agg(F.max_by(F.coalesce("language", F.lit("source")), F.struct("n", F.expr("-hash(language)"))).alias("language"))
    rows = rolled.join(links, "cluster").join(spoken, "cluster")
    score = c("likeness") * 0.35 + capped(c("n_files") / 12) * 0.12 + capped(c("links") / 100) * 0.18 + capped(c("touches") / 60) * 0.15 + capped(c("symbols") / 120) * 0.12 + capped((c("co_touch_edges") + c("graph_edges")) / 20) * 0.08
    t, g = c("co_touch_edges") > 0, c("graph_edges") > 0
    kind = F.when(t & g, "graph_and_churn_ownership").when(t, "co_touch_ownership").when(g, "graph_neighborhood").otherwise("path_proximity")
    sure = F.when((t & g) | (c("likeness") >= 0.55), "high").when(t | g | (c("likeness") >= 0.42), "medium").otherwise("low")
    shared = F.array_join(F.slice("lo", 1, common_prefix(c("lo"), c("hi"))), "/")
    name = F.when(shared != "", shared).otherwise(F.concat("language", F.lit(" files")))
    return rows.select("cluster", name.alias("name"), "n_files", round4(capped(score)).alias("score"), kind.alias("category"), sure.alias("confidence"), "co_touch_edges", "graph_edges")


def treemap(metrics: DataFrame, edges: DataFrame, symbols: DataFrame, clones: DataFrame, bindings: DataFrame, changes: DataFrame) -> DataFrame:
    """Per file: lines, changes, cross-file links in and out, clone partners and their best similarity, distinct notes over all ways of binding.

    ``clones``: a, b (file ids), similarity; ``bindings``: note_id, kind (path, dir, symbol, chunk, logical), repo_id, path, file_id. A directory binds
    all files below it (the repository's root if empty): directories of a file are matched by equality, not by prefix.
    """
    owner = symbols.select("symbol_id", "file_id")
    shown = edges.where(F.coalesce("hidden", F.lit(0)) == 0).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    cross = shown.join(owner.toDF("src", "f"), "src").join(owner.toDF("dst", "h"), "dst").where("f <> h")
    both = clones.select("a", "b", "similarity").union(clones.select("b", "a", "similarity")).groupBy(F.col("a").alias("file_id")).agg(F.countDistinct("b").alias("dup_partners"), F.max("similarity").alias("dup_max_similarity"))
    files = metrics.select("file_id", "repo_id", "path")
    parts = F.split("path", "/")
    above = files.select("file_id", "repo_id", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("path"))
    by_path = bindings.where("path is not null").select("note_id", "repo_id", "path").join(files, ["repo_id", "path"]).select("note_id", "file_id")
    by_dir = bindings.where("kind = 'dir'").select("note_id", "repo_id", F.coalesce("path", F.lit("")).alias("path")).join(above, ["repo_id", "path"]).select("note_id", "file_id")
    by_id = bindings.where("kind in ('symbol', 'chunk', 'logical') and file_id is not null").select("note_id", "file_id")
    noted = by_path.union(by_dir).union(by_id).distinct().groupBy("file_id").agg(F.count(F.lit(1)).alias("notes"))
    moved = changes.groupBy("repo_id", "path").agg(F.count(F.lit(1)).alias("churn_commits"), F.sum(F.coalesce("additions", F.lit(0)) + F.coalesce("deletions", F.lit(0))).alias("churn_lines"))
    rows = metrics.select("file_id", "repo_id", "path", F.col("line_count").alias("loc")).join(moved, ["repo_id", "path"], "left")
    for part in (cross.groupBy(F.col("h").alias("file_id")).agg(F.sum("n").alias("links_in")), cross.groupBy(F.col("f").alias("file_id")).agg(F.sum("n").alias("links_out")), both, noted):
        rows = rows.join(part, "file_id", "left")
    whole = ("churn_commits", "churn_lines", "links_in", "links_out", "dup_partners", "notes")
    return rows.select("file_id", "path", "loc", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in whole], F.coalesce("dup_max_similarity", F.lit(0.0)).alias("dup_max_similarity"))


# -- the given tables as files with measures; paths keep their first part and their file, so that directories hold several files
def _near(path: str) -> Column:
    return F.concat_ws("/", F.substring_index(path, "/", 1), F.concat(F.lit("d"), (F.length(path) % 5).cast("string")), F.element_at(F.split(path, "/"), -1))


def _files(s: SparkSession, d: str) -> DataFrame:
    f = latest(table(s, d, "files"), ["id"], ["indexed_at_ms", "indexed_revision"]).where("kind <> 'deleted'").withColumn("path", _near("path"))
    return latest(f, ["repo_id", "path"], ["indexed_at_ms", "id"]).select(F.col("id").alias("file_id"), "repo_id", "path", "language", "kind", "generated")


def _chunks(s, d):
    return table(s, d, "chunks").select("id", "file_id", "symbol_path", "chunk_kind", "end_line").distinct()


def _symbols(s, d):
    return _chunks(s, d).where("symbol_path is not null").select(F.col("id").alias("symbol_id"), "file_id", F.col("chunk_kind").alias("kind"))


def _edges(s, d):
    own = _symbols(s, d).select(F.col("symbol_id").alias("dst"))
    rows = _symbols(s, d).select(F.col("symbol_id").alias("src"), F.explode(F.array(F.col("symbol_id") + 1, F.col("symbol_id") * 13 % 1009)).alias("dst"))
    return rows.join(own, "dst").select("src", "dst", (F.col("src") % 11 == 0).cast("int").alias("hidden"))


def _changes(s, d):
    at = F.floor(F.col("modified_at_ms") / 1000)
    return table(s, d, "files").where("commit_sha <> ''").select("repo_id", _near("path").alias("path"), F.floor(F.col("modified_at_ms") / 604_800_000).cast("string").alias("hash"), at.alias("authored_at_s"), (F.col("id") % 50).alias("additions"), (F.col("id") % 20).alias("deletions"))


def _bound(s, d):
    at = table(s, d, "files").groupBy(F.col("id").alias("doc_id")).agg(F.min("repo_id").alias("r"), F.min(_near("path")).alias("path"))
    return table(s, d, "documents").select("doc_id", "doc_kind").join(at, "doc_id").withColumnRenamed("r", "repo_id")


def _refs(s, d):
    return _bound(s, d).where("doc_kind in ('issue', 'review')").select("repo_id", "path")


def _notes(s, d):
    status = F.when(F.col("doc_id") % 6 == 0, "obsolete").when(F.col("doc_id") % 6 == 1, "stale").otherwise("active")
    return _bound(s, d).select("doc_id", "repo_id", "path", status.alias("status"))


def _metrics(s, d):
    return spill_table(file_metrics(_files(s, d), _chunks(s, d), _symbols(s, d), _edges(s, d), _changes(s, d), _refs(s, d), _notes(s, d)), "file-metrics")


def _likeness(s, d, metrics=None):
    metrics = _metrics(s, d) if metrics is None else metrics
    return likeness(metrics, co_touch_pairs(_changes(s, d), _files(s, d)), graph_pairs(_edges(s, d), _symbols(s, d)))


def _clusters(s, d):
    metrics = _metrics(s, d)
    return file_clusters(metrics, _likeness(s, d, metrics))


def _treemap(s, d):
    clones = table(s, d, "files").select(F.col("id").alias("a"), (F.col("id") + 3).alias("b"), (F.col("id") % 10 / 10.0).alias("similarity")).distinct()
    notes = _notes(s, d).where("status = 'active'")
    kind = F.when(F.col("doc_id") % 4 == 0, "dir").when(F.col("doc_id") % 4 == 1, "symbol").otherwise("path")
    path = F.when(kind == "dir", F.substring_index("path", "/", 2)).when(kind == "path", F.col("path"))
    bindings = notes.select(F.col("doc_id").alias("note_id"), kind.alias("kind"), "repo_id", path.alias("path"), F.when(kind == "symbol", F.col("doc_id")).alias("file_id"))
    return treemap(_metrics(s, d), _edges(s, d), _symbols(s, d), clones, bindings, _changes(s, d))


QUERIES = {
    "file_metrics": lambda s, d: _metrics(s, d),
    **{f"brief_{m}": (lambda s, d, m=m: file_brief(_metrics(s, d), m)) for m in BRIEF_WEIGHTS},
    "summary_counts": lambda s, d: summary_counts(_files(s, d), _edges(s, d), _changes(s, d), _notes(s, d)),
    "symbol_kinds": lambda s, d: symbol_kinds(_symbols(s, d), _files(s, d)),
    "file_likeness": lambda s, d: _likeness(s, d).select("a", "b", "t", "g", F.round("score", 6).alias("score")),
    "file_clusters": _clusters,
    "treemap_files": _treemap,
}
_M = """WITH RECURSIVE f AS (SELECT id AS file_id, repo_id, path, language, kind, generated FROM (SELECT * FROM (SELECT * REPLACE (split_part(path, '/', 1) || '/d' || (length(path) % 5) || '/' || parse_filename(path) AS path) FROM files QUALIFY row_number() OVER (PARTITION BY id ORDER BY indexed_at_ms DESC NULLS LAST, indexed_revision DESC NULLS LAST) = 1) WHERE kind <> 'deleted' QUALIFY row_number() OVER (PARTITION BY repo_id, path ORDER BY indexed_at_ms DESC NULLS LAST, id DESC) = 1)),
c AS (SELECT DISTINCT id, file_id, symbol_path, chunk_kind, end_line FROM chunks), s AS (SELECT id AS symbol_id, file_id, chunk_kind AS kind FROM c WHERE symbol_path IS NOT NULL),
e AS (SELECT src, dst FROM (SELECT symbol_id AS src, unnest([symbol_id + 1, symbol_id * 13 % 1009]) AS dst FROM s) WHERE dst IN (SELECT symbol_id FROM s) AND src % 11 <> 0),
ch AS (SELECT repo_id, split_part(path, '/', 1) || '/d' || (length(path) % 5) || '/' || parse_filename(path) AS path, CAST(modified_at_ms // 604800000 AS VARCHAR) AS hash, modified_at_ms // 1000 AS at_s, id % 50 AS additions, id % 20 AS deletions FROM files WHERE commit_sha <> ''),
fb AS (SELECT id, min(repo_id) AS repo_id, min(split_part(path, '/', 1) || '/d' || (length(path) % 5) || '/' || parse_filename(path)) AS path FROM files GROUP BY id), bd AS (SELECT doc_id, doc_kind, repo_id2 AS repo_id, path FROM documents JOIN (SELECT id, repo_id AS repo_id2, path FROM fb) ON id = doc_id),
nt AS (SELECT doc_id, repo_id, path, CASE doc_id % 6 WHEN 0 THEN 'obsolete' WHEN 1 THEN 'stale' ELSE 'active' END AS status FROM bd), nw AS (SELECT repo_id, max(at_s) AS newest FROM ch GROUP BY 1),
m1 AS (SELECT file_id, count(*) AS chunk_count, coalesce(max(end_line), 0) AS line_count FROM c GROUP BY 1), m2 AS (SELECT file_id, count(*) AS symbol_count FROM s GROUP BY 1), m3 AS (SELECT file_id, count(*) AS fan_in FROM e JOIN s ON dst = symbol_id GROUP BY 1), m4 AS (SELECT file_id, count(*) AS fan_out FROM e JOIN s ON src = symbol_id GROUP BY 1),
m5 AS (SELECT repo_id, path, count(DISTINCT hash) AS commit_touch_count, sum(CASE WHEN at_s >= newest - 7776000 THEN 1 ELSE 0 END) AS recent_touch_count, sum(additions) AS additions, sum(deletions) AS deletions FROM ch JOIN nw USING (repo_id) GROUP BY ALL),
m6 AS (SELECT repo_id, path, count(*) AS papertrail_ref_count FROM bd WHERE doc_kind IN ('issue', 'review') GROUP BY ALL), m7 AS (SELECT repo_id, path, count(*) FILTER (status = 'active') AS active_notes, count(*) FILTER (status = 'stale') AS stale_notes, count(*) FILTER (status = 'obsolete') AS obsolete_notes FROM nt GROUP BY ALL),
m AS (SELECT f.*, CAST(coalesce(chunk_count, 0) AS BIGINT) AS chunk_count, CAST(coalesce(line_count, 0) AS BIGINT) AS line_count, CAST(coalesce(symbol_count, 0) AS BIGINT) AS symbol_count, CAST(coalesce(fan_in, 0) AS BIGINT) AS fan_in, CAST(coalesce(fan_out, 0) AS BIGINT) AS fan_out, CAST(coalesce(commit_touch_count, 0) AS BIGINT) AS commit_touch_count,
  CAST(coalesce(recent_touch_count, 0) AS BIGINT) AS recent_touch_count, CAST(coalesce(additions, 0) AS BIGINT) AS additions, CAST(coalesce(deletions, 0) AS BIGINT) AS deletions, CAST(coalesce(papertrail_ref_count, 0) AS BIGINT) AS papertrail_ref_count, CAST(coalesce(active_notes, 0) AS BIGINT) AS active_notes, CAST(coalesce(stale_notes, 0) AS BIGINT) AS stale_notes, CAST(coalesce(obsolete_notes, 0) AS BIGINT) AS obsolete_notes
  FROM f LEFT JOIN m1 USING (file_id) LEFT JOIN m2 USING (file_id) LEFT JOIN m3 USING (file_id) LEFT JOIN m4 USING (file_id) LEFT JOIN m5 ON m5.repo_id = f.repo_id AND m5.path = f.path LEFT JOIN m6 ON m6.repo_id = f.repo_id AND m6.path = f.path LEFT JOIN m7 ON m7.repo_id = f.repo_id AND m7.path = f.path)"""
_D = lambda x: f"CAST({x} AS DOUBLE)"
_CAP = lambda a, n: f"least({a} / CAST({n} AS DOUBLE), 1)"
_TEST = r"(regexp_matches(lower(path), '(^|/)(tests|test|__tests__|__test__|__mocks__|spec|specs)(/|$)') OR parse_filename(path) = 'conftest.py' OR contains(lower(parse_filename(path)), '.test.') OR contains(lower(parse_filename(path)), '.spec.') OR regexp_matches(string_split(parse_filename(path), '.')[1], '^tests?$|^test_|_tests?$|Tests?$|TestCase$'))"
_PARTS = {
    "size": _CAP("line_count", 800), "symbols": _CAP("symbol_count", 40), "coupling": _CAP("(fan_in + fan_out)", 50), "papertrail": _CAP("papertrail_ref_count", 8),
    "churn": f"least({_CAP('commit_touch_count', 25)} * {_D(0.5)} + {_CAP('recent_touch_count', 8)} * {_D(0.25)} + {_CAP('(additions + deletions)', 5000)} * {_D(0.25)}, 1)", "memories": f"least({_CAP('active_notes', 5)} + {_CAP('stale_notes', 3)} * {_D(0.5)}, 1)",
}
# the weights and thresholds again, apart from the operator's own
_SPELLED = {
    "spine": ("0.35 coupling 0.18 symbols 0.12 size 0.15 churn 0.15 memories 0.05 papertrail", "0.7", "CASE WHEN fan_in + fan_out >= 25 THEN 'central_coupling_point' WHEN active_notes > 0 THEN 'source_anchored_context' ELSE 'structural_spine' END"),
    "churn": ("0.65 churn 0.15 coupling 0.1 size 0.07 memories 0.03 papertrail", "1", "CASE WHEN recent_touch_count >= 2 THEN 'recent_churn_hotspot' ELSE 'historical_churn_hotspot' END"),
    "god_modules": ("0.3 size 0.25 symbols 0.25 coupling 0.12 churn 0.08 memories", "0.45", "CASE WHEN symbol_count >= 40 AND fan_in > 0 AND fan_out > 0 THEN 'large_mixed_module' ELSE 'large_module_candidate' END"),
    "refactor_candidates": ("0.2 size 0.18 symbols 0.25 coupling 0.25 churn 0.09 memories 0.03 papertrail", "0.45", "CASE WHEN commit_touch_count >= 10 AND fan_in + fan_out >= 15 THEN 'high_churn_coupling_point' ELSE 'needs_human_review' END"),
}


def _brief_sql(mode: str) -> str:
    words, test, kind = _SPELLED[mode]
    pairs = words.split()
    total = " + ".join(f"{_PARTS[n]} * {_D(w)}" for w, n in zip(pairs[::2], pairs[1::2], strict=True))
    return f"{_M} SELECT file_id, path, floor((CAST(0 AS DOUBLE) + {total}) * CASE WHEN generated <> 0 THEN {_D(0.25)} ELSE 1 END * CASE WHEN {_TEST} THEN {_D(test)} ELSE 1 END * 10000 + 0.5) / 10000 AS score, {kind} AS category FROM m"


_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda x: length(x) > 1))"
_PREFIX = "coalesce(nullif(list_position(list_transform(range(1, greatest(len({0}), len({1})) + 1), lambda i: coalesce({0}[i] = {1}[i], false)), false), 0) - 1, greatest(len({0}), len({1})))"
_L = f"""{_M}, o AS (SELECT m.*, list_filter(string_split(path, '/'), lambda x: x <> '') AS a, additions + deletions AS lines FROM m), k AS (SELECT *, CASE WHEN len(a) <= 1 THEN '.' ELSE array_to_string(a[1:least(len(a) - 1, 5)], '/') END AS bucket FROM o),
zb AS (SELECT repo_id, bucket FROM k GROUP BY ALL HAVING count(*) BETWEEN 2 AND 120), np AS (SELECT x.file_id AS a, y.file_id AS b FROM k x JOIN zb USING (repo_id, bucket) JOIN k y ON y.repo_id = x.repo_id AND y.bucket = x.bucket AND x.file_id < y.file_id),
cr AS (SELECT DISTINCT repo_id, hash, file_id FROM ch JOIN f USING (repo_id, path)), cz AS (SELECT repo_id, hash FROM cr GROUP BY ALL HAVING count(*) BETWEEN 2 AND 40), ct AS (SELECT x.file_id AS a, y.file_id AS b, count(*) AS t FROM cr x JOIN cz USING (repo_id, hash) JOIN cr y ON y.repo_id = x.repo_id AND y.hash = x.hash AND x.file_id < y.file_id GROUP BY ALL),
gp AS (SELECT least(x.file_id, y.file_id) AS a, greatest(x.file_id, y.file_id) AS b, count(*) AS g FROM e JOIN s x ON x.symbol_id = src JOIN s y ON y.symbol_id = dst WHERE x.file_id <> y.file_id GROUP BY ALL),
ap AS (SELECT a, b, CAST(sum(t) AS BIGINT) AS t, CAST(sum(g) AS BIGINT) AS g FROM (SELECT a, b, 0 AS t, 0 AS g FROM np UNION ALL SELECT a, b, t, 0 FROM ct UNION ALL SELECT a, b, 0, g FROM gp) GROUP BY ALL),
bp AS (SELECT ap.a, ap.b, t, g, l.path AS lp, r.path AS rp, l.a AS la, r.a AS ra, l.language IS NOT DISTINCT FROM r.language AS sl, l.kind IS NOT DISTINCT FROM r.kind AS sk, l.lines AS ll, r.lines AS rl, l.commit_touch_count AS lt, r.commit_touch_count AS rt FROM ap JOIN k l ON l.file_id = ap.a JOIN k r ON r.file_id = ap.b AND r.repo_id = l.repo_id AND r.bucket = l.bucket),
li AS (SELECT a, b, t, g, least(({_PREFIX.format("la", "ra")} / {_D("greatest(len(la), len(ra))")} * {_D(0.65)} + CASE WHEN len(list_distinct(list_concat({_WORDS.format("lp")}, {_WORDS.format("rp")}))) = 0 THEN 0 ELSE len(list_intersect({_WORDS.format("lp")}, {_WORDS.format("rp")})) / {_D(f"len(list_distinct(list_concat({_WORDS.format('lp')}, {_WORDS.format('rp')})))")} END * {_D(0.35)}) * {_D(0.43)}
  + least(t / {_D(4)}, 1) * {_D(0.24)} + least(g / {_D(6)}, 1) * {_D(0.22)} + CASE WHEN sl THEN {_D(0.06)} ELSE 0 END + CASE WHEN sk THEN {_D(0.03)} ELSE 0 END
  + (CASE WHEN greatest(ll, rl) = 0 THEN 0 ELSE 1 - abs(ll - rl) / {_D("greatest(ll, rl)")} END + CASE WHEN greatest(lt, rt) = 0 THEN 0 ELSE 1 - abs(lt - rt) / {_D("greatest(lt, rt)")} END) * {_D(0.5)} * {_D(0.02)}, 1) AS score FROM bp)"""
SQL = {
    "file_metrics": f"{_M} SELECT * FROM m",
    **{f"brief_{m}": _brief_sql(m) for m in _SPELLED},
    "summary_counts": f"""{_M} SELECT (SELECT count(*) FROM f) AS total_files, (SELECT count(*) FROM f WHERE generated <> 0) AS generated_files, (SELECT count(*) FROM e) AS graph_edges, (SELECT count(*) FROM (SELECT DISTINCT repo_id, hash FROM ch)) AS git_commits, (SELECT count(*) FROM ch) AS git_file_changes,
  (SELECT count(*) FROM nt WHERE status = 'active') AS active_notes, (SELECT count(*) FROM nt WHERE status = 'stale') AS stale_notes, (SELECT count(*) FROM nt WHERE status = 'obsolete') AS obsolete_notes""",
    "symbol_kinds": f"{_M}, x AS (SELECT path, s.kind, count(*) AS n FROM s JOIN f USING (file_id) GROUP BY ALL) SELECT path, string_agg(kind || '=' || n, ',' ORDER BY kind || '=' || n) AS kinds FROM x GROUP BY path",
    "file_likeness": f"{_L} SELECT a, b, t, g, round(score, 6) AS score FROM li",
    "file_clusters": f"""{_L}, kp AS (SELECT * FROM li WHERE score >= {_D(0.34)}), un AS (SELECT a AS x, b AS y FROM kp UNION SELECT b, a FROM kp), cc(id, root) AS (SELECT x, x FROM un UNION SELECT un.y, cc.root FROM cc JOIN un ON un.x = cc.id WHERE cc.root < un.y), cl AS (SELECT id AS file_id, min(root) AS cluster FROM cc GROUP BY id),
lk AS (SELECT cluster, avg(score) AS likeness, CAST(sum(t) AS BIGINT) AS co_touch_edges, CAST(sum(g) AS BIGINT) AS graph_edges FROM kp JOIN cl ON cl.file_id = kp.a GROUP BY cluster),
ro AS (SELECT cluster, count(*) AS n_files, sum(fan_in + fan_out) AS links, sum(commit_touch_count) AS touches, sum(symbol_count) AS symbols, min(CASE WHEN len(a) <= 1 THEN [] ELSE a[1:len(a) - 1] END) AS lo, max(CASE WHEN len(a) <= 1 THEN [] ELSE a[1:len(a) - 1] END) AS hi FROM k JOIN cl USING (file_id) GROUP BY cluster)
SELECT cluster, array_to_string(lo[1:{_PREFIX.format("lo", "hi")}], '/') AS name, n_files, floor(least(likeness * {_D(0.35)} + {_CAP("n_files", 12)} * {_D(0.12)} + {_CAP("links", 100)} * {_D(0.18)} + {_CAP("touches", 60)} * {_D(0.15)} + {_CAP("symbols", 120)} * {_D(0.12)} + {_CAP("(co_touch_edges + graph_edges)", 20)} * {_D(0.08)}, 1) * 10000 + 0.5) / 10000 AS score,
  CASE WHEN co_touch_edges > 0 AND graph_edges > 0 THEN 'graph_and_churn_ownership' WHEN co_touch_edges > 0 THEN 'co_touch_ownership' WHEN graph_edges > 0 THEN 'graph_neighborhood' ELSE 'path_proximity' END AS category,
  CASE WHEN (co_touch_edges > 0 AND graph_edges > 0) OR likeness >= {_D(0.55)} THEN 'high' WHEN co_touch_edges > 0 OR graph_edges > 0 OR likeness >= {_D(0.42)} THEN 'medium' ELSE 'low' END AS confidence, co_touch_edges, graph_edges FROM ro JOIN lk USING (cluster)""",
    "treemap_files": f"""{_M}, x AS (SELECT a.file_id AS f1, b.file_id AS f2 FROM e JOIN s a ON a.symbol_id = src JOIN s b ON b.symbol_id = dst WHERE a.file_id <> b.file_id), cn AS (SELECT DISTINCT id AS a, id + 3 AS b, id % 10 / {_D(10)} AS sim FROM files), cb AS (SELECT a AS file_id, count(DISTINCT b) AS p, max(sim) AS q FROM (SELECT a, b, sim FROM cn UNION ALL SELECT b, a, sim FROM cn) GROUP BY 1),
an AS (SELECT doc_id, doc_id % 4 AS k, repo_id, path FROM nt WHERE status = 'active'), nb AS (SELECT DISTINCT doc_id, file_id FROM (SELECT doc_id, f.file_id FROM an JOIN f ON f.repo_id = an.repo_id AND f.path = CASE WHEN k = 0 THEN array_to_string(string_split(an.path, '/')[1:2], '/') WHEN k > 1 THEN an.path END
  UNION ALL SELECT doc_id, f.file_id FROM an JOIN f ON k = 0 AND f.repo_id = an.repo_id AND starts_with(f.path, array_to_string(string_split(an.path, '/')[1:2], '/') || '/') UNION ALL SELECT doc_id, doc_id FROM an WHERE k = 1)),
cm AS (SELECT repo_id, path, count(*) AS n, sum(additions + deletions) AS l FROM ch GROUP BY ALL)
SELECT m.file_id, m.path, line_count AS loc, coalesce(cm.n, 0) AS churn_commits, CAST(coalesce(cm.l, 0) AS BIGINT) AS churn_lines, (SELECT count(*) FROM x WHERE f2 = m.file_id) AS links_in, (SELECT count(*) FROM x WHERE f1 = m.file_id) AS links_out, coalesce(p, 0) AS dup_partners, (SELECT count(*) FROM nb WHERE nb.file_id = m.file_id) AS notes, coalesce(q, 0) AS dup_max_similarity
FROM m LEFT JOIN cb ON cb.file_id = m.file_id LEFT JOIN cm ON cm.repo_id = m.repo_id AND cm.path = m.path""",
}

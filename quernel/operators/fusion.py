"""Hybrid search over chunks: BM25 and vector candidates, fused with the symbol, graph, git and thread lanes, and demoted.

Candidates are at most ``OVERFETCH`` x the hits asked for from each side, whatever the collection, so all that is joined to
them afterwards sees a broadcast of a bounded number of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernel.functions.exprs import SEARCH_CONFIDENCE, SEARCH_RELATION, ascii_lower, capped, lookup, query_terms, rank_score, round4
from quernel.operators.history import RECENT_SECONDS
from quernel.operators.index import latest
from quernel.operators.search import LEAST_FETCH, OVERFETCH, QUERY, bm25, symbol_path_boost, top, vector_scores
from quernel.plans.cluster import spill_table
from quernel.plans.ranks import top_ranked
from quernel.sources.tables import table

#: Weights of the six lanes, the weight of graded history in place of git, and what demoted hits keep (fixed values).
WEIGHTS = {"bm25": 0.45, "vector": 0.35, "symbol": 0.10, "graph": 0.05, "git": 0.03, "papertrail": 0.02}
GRADED_GIT, GENERATED_FACTOR, TEST_FACTOR = 0.10, 0.6, 0.8
#: Edges of a symbol that its boost looks at, what an edge without a term counts, what all but the strongest count (fixed values).
BOOST_EDGES, OTHER_TERM, SECONDARY = 64, 0.35, 0.15
#: Similarity below which a note found by its vector alone isn't shown (fixed value).
NOTE_SIMILARITY = 0.45


@dataclass(frozen=True)
class Store:
    """What the search reads: chunks (doc_id, repo_id, path, symbol_path, text, generated, is_test), vectors (doc_id, embedding), edges (edge_id,
    from_name, to_name, kind, confidence, hidden), changes (repo_id, path, hash, authored_at_s), refs (repo_id, path)."""

    chunks: DataFrame
    vectors: DataFrame
    edges: DataFrame
    changes: DataFrame
    refs: DataFrame


def match_any(documents: DataFrame, query: str) -> DataFrame:
    """(doc_id): documents that hold any term of the query; a query without terms matches none."""
    from quernel.functions.exprs import terms

    wanted = query_terms(query)
    return documents.where(F.exists(terms("text"), lambda t: t.isin(wanted)) if wanted else F.lit(False)).select("doc_id")


def short_symbol(symbol_path) -> Column:
    """A symbol path without a leading file (``src/a.rs::b::c`` is ``b::c``)."""
    return F.regexp_replace(symbol_path, r"^[^:]*(?::[^:]+)*?\.(?:rs|ts|tsx|mts|py|pyi|go|kt|kts|c|h|cc|cpp|hpp|cxx|swift|md)::", "")


def graph_boost(candidates: DataFrame, edges: DataFrame, wanted: list[str]) -> DataFrame:
    """(doc_id, graph): evidence of the edges around each candidate's symbol, 1 at most.

    Of the 64 surest edges the strongest counts in full, the others 0.15; an edge whose other end holds no term counts 0.35.
    """
    own = candidates.where("symbol_path is not null").select("doc_id", F.explode(F.array_distinct(F.array("symbol_path", short_symbol(F.col("symbol_path"))))).alias("name"))
    shown = edges.where(F.coalesce("hidden", F.lit(0)) == 0).select("edge_id", "from_name", "to_name", "kind", "confidence")
    # the end that isn't the symbol; where both are, the target
    out = shown.join(F.broadcast(own), F.col("from_name") == F.col("name")).select("doc_id", "edge_id", "kind", "confidence", F.col("to_name").alias("other"), F.lit(0).alias("side"))
    into = shown.join(F.broadcast(own), F.col("to_name") == F.col("name")).select("doc_id", "edge_id", "kind", "confidence", F.coalesce("from_name", F.lit("")).alias("other"), F.lit(1).alias("side"))
    once = out.unionByName(into).groupBy("doc_id", "edge_id", "kind", "confidence").agg(F.min_by("other", "side").alias("other"))
    place = Window.partitionBy("doc_id").orderBy(lookup(F.col("confidence"), {"Exact": 0.0, "Syntactic": 1.0, "NameOnly": 2.0}, 3.0), "kind", "edge_id")
    kept = once.withColumn("_k", F.row_number().over(place)).where(F.col("_k") <= BOOST_EDGES)
    hit = F.lit(False)
    for t in wanted:
        hit = hit | ascii_lower(F.col("other")).contains(t)
    evidence = lookup(F.col("confidence"), SEARCH_CONFIDENCE, 0.0) * lookup(F.col("kind"), SEARCH_RELATION, 0.0) * F.when(hit, 1.0).otherwise(OTHER_TERM)
    sums = kept.groupBy("doc_id").agg(F.max(evidence).alias("m"), F.sum(evidence).alias("s"))
    return sums.select("doc_id", F.least(F.col("m") + SECONDARY * (F.col("s") - F.col("m")), F.lit(1.0)).alias("graph"))


def historical_boost(candidates: DataFrame, changes: DataFrame, refs: DataFrame) -> DataFrame:
    """(doc_id, git, papertrail): 1 where the candidate's path has any commit, any thread."""
    flag = lambda rows, n: candidates.select("doc_id", "repo_id", "path").join(F.broadcast(candidates.select("repo_id", "path").distinct()).join(rows.select("repo_id", "path").distinct(), ["repo_id", "path"]), ["repo_id", "path"], "left_semi").select("doc_id", F.lit(1.0).alias(n))
    return candidates.select("doc_id").join(flag(changes, "git"), "doc_id", "left").join(flag(refs, "papertrail"), "doc_id", "left").select("doc_id", F.coalesce("git", F.lit(0.0)).alias("git"), F.coalesce("papertrail", F.lit(0.0)).alias("papertrail"))


def graded_history(candidates: DataFrame, changes: DataFrame, recent_cap: float = 5.0, total_cap: float = 20.0) -> DataFrame:
    """(doc_id, git): 0.6 of the capped changes within 90 days of the repository's newest commit, 0.4 of the capped commits."""
    newest = changes.groupBy("repo_id").agg(F.max("authored_at_s").alias("newest"))
    own = changes.join(F.broadcast(candidates.select("repo_id", "path").distinct()), ["repo_id", "path"]).join(newest, "repo_id")
    counts = own.groupBy("repo_id", "path").agg(F.countDistinct("hash").alias("total"), F.sum((F.col("authored_at_s") >= F.col("newest") - RECENT_SECONDS).cast("bigint")).alias("recent"))
    part = lambda n, cap: F.least(F.coalesce(n, F.lit(0)) / cap, F.lit(1.0))
    score = 0.6 * part("recent", recent_cap) + 0.4 * part("total", total_cap)
    return candidates.select("doc_id", "repo_id", "path").join(counts, ["repo_id", "path"], "left").select("doc_id", score.alias("git"))


def semantic_search(store: Store, query: str, embedding: list[float] | None, limit: int = 10, graded: bool = False, include_generated: bool = False) -> DataFrame:
    """(doc_id, score, mode, bm25, vector, symbol, graph, git, papertrail, rank): the best ``limit`` chunks and what their score is made of.

    Without an embedding lexical only. ``graded`` replaces the git flag by graded history and demotes generated chunks (x 0.6) and
    tests (x 0.8). Ties: the smaller id.
    """
    fetch, wanted = OVERFETCH * max(limit, LEAST_FETCH), query_terms(query)
    chunks = store.chunks if include_generated else store.chunks.where("generated = 0")
    found = bm25(chunks.select("doc_id", "text"), query, fetch).select("doc_id", rank_score(F.col("rank")).alias("bm25"))
    if embedding is not None:
        near = vector_scores(store.vectors.join(chunks.select("doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("vec_id"), "embedding"), embedding)
        near = top(near, "similarity", "vec_id", fetch).select(F.col("vec_id").alias("doc_id"), capped(F.col("similarity")).alias("vector"))
        found = found.join(near, "doc_id", "full_outer")
    else:
        found = found.withColumn("vector", F.lit(0.0))
    found = found.select("doc_id", F.coalesce("bm25", F.lit(0.0)).alias("bm25"), F.coalesce("vector", F.lit(0.0)).alias("vector"))
    rows = chunks.select("doc_id", "repo_id", "path", "symbol_path", "generated", "is_test").join(F.broadcast(found), "doc_id")
    rows = spill_table(rows, "search-candidates")
    git = graded_history(rows, store.changes) if graded else historical_boost(rows, store.changes, store.refs).select("doc_id", "git")
    trail = historical_boost(rows, store.changes, store.refs).select("doc_id", "papertrail")
    rows = rows.join(F.broadcast(git), "doc_id").join(F.broadcast(trail), "doc_id").join(F.broadcast(graph_boost(rows, store.edges, wanted)), "doc_id", "left")
    lanes = {**WEIGHTS, "git": GRADED_GIT} if graded else WEIGHTS
    value = {"symbol": symbol_path_boost(F.col("symbol_path"), F.col("path"), wanted), "graph": F.coalesce("graph", F.lit(0.0))}
    parts = rows.select("doc_id", "generated", "is_test", *[(value.get(n, F.col(n)) * w).alias(n) for n, w in lanes.items()])
    score = round4(sum((F.col(n) for n in lanes), F.lit(0.0)))
    if graded:
        score = round4(score * F.when(F.col("generated") != 0, GENERATED_FACTOR).otherwise(1.0) * F.when(F.col("is_test") != 0, TEST_FACTOR).otherwise(1.0))
    mode = F.when((F.col("bm25") > 0) & (F.col("vector") > 0), "hybrid").when(F.col("vector") > 0, "vector").otherwise("lexical")
    best = top_ranked(parts.withColumn("score", score).withColumn("mode", mode), limit, F.desc("score"), "doc_id")
    return best.select("doc_id", "score", "mode", *[F.round(n, 6).alias(n) for n in lanes], "rank")


def bounded_summary(text) -> Column:
    """A text's words joined by single blanks, 240 characters of it."""
    return F.substring(F.array_join(F.filter(F.split(text, r"[ \t\n\r\f]+"), lambda w: w != ""), " "), 1, 240)


def rank_docs(hits: DataFrame, path: str, name: str, qualified: str, limit: int) -> DataFrame:
    """(doc_id, locality, rank): hits (doc_id, path, symbol_path, text, score, start_line) by nearness to a symbol, then score, path and line.

    0 the symbol itself, 1 its file, 2 a path with its module that names it, 3 its qualified name, 4 its name, 5 a path with its module, 9 others.
    """
    module = path.rsplit("/", 1)[-1].rsplit(".", 1)[0].lower()
    low_path, summary, own = ascii_lower(F.col("path")), ascii_lower(bounded_summary(F.col("text"))), ascii_lower(F.coalesce("symbol_path", F.lit("")))
    name, long = name.lower(), qualified.lower()
    near = F.lit(bool(module)) & low_path.contains(module)
    named = summary.contains(name) | own.contains(name)
    locality = (
        F.when((F.col("path") == path) & (own == long), 0).when(F.col("path") == path, 1).when(near & named, 2)
        .when(summary.contains(long) | own.contains(long), 3).when(named, 4).when(near, 5).otherwise(9)
    )
    rows = hits.withColumn("locality", F.coalesce(locality, F.lit(9)))
    return top_ranked(rows, limit, "locality", F.desc("score"), "path", "start_line", "doc_id").select("doc_id", "locality", "rank")


def note_search(notes: DataFrame, vectors: DataFrame, query: str, embedding: list[float] | None, limit: int = 10) -> DataFrame:
    """(doc_id, score, rank): notes by the lexical and the vector lane; one found by its vector alone must be similar by 0.45."""
    found = bm25(notes.select("doc_id", "text"), query, OVERFETCH * max(limit, LEAST_FETCH)).select("doc_id", rank_score(F.col("rank")).alias("b"))
    if embedding is None:
        rows = found.withColumn("v", F.lit(0.0))
    else:
        near = vector_scores(vectors.join(notes.select("doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("vec_id"), "embedding"), embedding).select(F.col("vec_id").alias("doc_id"), F.col("similarity").alias("v"))
        rows = near.join(F.broadcast(found), "doc_id", "full_outer").where(F.col("b").isNotNull() | (F.col("v") >= NOTE_SIMILARITY))
    score = WEIGHTS["bm25"] * F.coalesce("b", F.lit(0.0)) + WEIGHTS["vector"] * capped(F.coalesce("v", F.lit(0.0)))
    return top_ranked(rows.select("doc_id", round4(score).alias("score")), limit, F.desc("score"), "doc_id").select("doc_id", "score", "rank")


def best_hits(scored: DataFrame, limit: int) -> DataFrame:
    """(id, score, rank): the least (best) score of each id of rows (id, score), which repeat ids, cut to ``limit`` only afterwards."""
    return top_ranked(scored.groupBy("id").agg(F.min("score").alias("score")), limit, "score", "id")


# -- the given tables as a store
def chunk_store(s: SparkSession, d: str) -> Store:
    """Chunks with their texts; edges lead from each named chunk of a file to the next; changes are the delivered file rows."""
    files = latest(table(s, d, "files"), ["id"], ["indexed_at_ms", "indexed_revision"]).where("kind <> 'deleted'").select(F.col("id").alias("file_id"), "repo_id", "path", "generated", F.col("has_test_code").alias("is_test"))
    chunks = table(s, d, "chunks").select(F.col("id").alias("doc_id"), "file_id", "symbol_path", "start_byte").distinct()
    texts = table(s, d, "chunk_text").groupBy(F.col("chunk_id").alias("doc_id")).agg(F.max("blob").alias("b")).select("doc_id", F.decode("b", "UTF-8").alias("text"))
    rows = chunks.join(files, "file_id").join(texts, "doc_id")
    named = chunks.where("symbol_path is not null")
    after = Window.partitionBy("file_id").orderBy("start_byte", "doc_id")
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("calls_name", "imports", "references_type", "contains", "constructs")]), (F.col("doc_id") % 5 + 1).cast("int"))
    sure = F.element_at(F.array(*[F.lit(k) for k in ("Exact", "Syntactic", "NameOnly", "Ambiguous")]), (F.col("doc_id") % 4 + 1).cast("int"))
    edges = named.withColumn("to_name", F.lead("symbol_path").over(after)).where("to_name is not null").select(F.col("doc_id").alias("edge_id"), F.col("symbol_path").alias("from_name"), "to_name", kinds.alias("kind"), sure.alias("confidence"), (F.col("doc_id") % 11 == 0).cast("int").alias("hidden"))
    changes = table(s, d, "files").where("commit_sha <> ''").select("repo_id", "path", F.col("commit_sha").alias("hash"), F.floor(F.col("modified_at_ms") / 1000).alias("authored_at_s"))
    refs = table(s, d, "documents").where("doc_kind in ('issue', 'review')").select(F.col("doc_id").alias("file_id")).join(files, "file_id").select("repo_id", "path")
    vectors = table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return Store(rows, vectors, edges, changes, refs)


def _vector(s, d):
    return [float(x) for x in table(s, d, "embeddings").where("vec_id = 0").first()["embedding"]]


def _doc_hits(s, d):
    rows = chunk_store(s, d).chunks
    found = bm25(rows.select("doc_id", "text"), QUERY, 200).select("doc_id", "score")
    return rows.withColumn("start_line", F.col("start_byte")).join(F.broadcast(found), "doc_id")


def _notes(s, d):
    return table(s, d, "documents").where("doc_kind = 'memory'").select("doc_id", "text")


SYMBOL = {"path": "crates/severity/src/shard/stale_branch.rs", "name": "Shard", "qualified": "stale_branch::Shard"}
QUERIES = {
    "semantic_search": lambda s, d: semantic_search(chunk_store(s, d), QUERY, _vector(s, d), 40),
    "semantic_search_graded": lambda s, d: semantic_search(chunk_store(s, d), QUERY, _vector(s, d), 40, True, True),
    "semantic_search_lexical": lambda s, d: semantic_search(chunk_store(s, d), QUERY, None, 40),
    "match_any": lambda s, d: match_any(table(s, d, "documents"), QUERY),
    "docs_for_symbol": lambda s, d: rank_docs(_doc_hits(s, d), limit=60, **SYMBOL),
    "note_search": lambda s, d: note_search(_notes(s, d), chunk_store(s, d).vectors, QUERY, _vector(s, d), 20),
    "best_hits": lambda s, d: best_hits(table(s, d, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_extendedprice").alias("score")), 100),
}
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_STORE = """WITH f AS (SELECT id AS file_id, repo_id, path, generated, has_test_code AS is_test FROM (SELECT * FROM files QUALIFY row_number() OVER (PARTITION BY id ORDER BY indexed_at_ms DESC NULLS LAST, indexed_revision DESC NULLS LAST) = 1) WHERE kind <> 'deleted'),
c AS (SELECT DISTINCT id AS doc_id, file_id, symbol_path, start_byte FROM chunks), tx AS (SELECT chunk_id AS doc_id, decode(max(blob)) AS text FROM chunk_text GROUP BY 1), r AS (SELECT c.*, f.repo_id, f.path, f.generated, f.is_test, tx.text FROM c JOIN f USING (file_id) JOIN tx USING (doc_id)),
e AS (SELECT doc_id AS edge_id, symbol_path AS from_name, to_name, CASE doc_id % 5 WHEN 0 THEN 'calls_name' WHEN 1 THEN 'imports' WHEN 2 THEN 'references_type' WHEN 3 THEN 'contains' ELSE 'constructs' END AS kind, CASE doc_id % 4 WHEN 0 THEN 'Exact' WHEN 1 THEN 'Syntactic' WHEN 2 THEN 'NameOnly' ELSE 'Ambiguous' END AS confidence
  FROM (SELECT *, lead(symbol_path) OVER (PARTITION BY file_id ORDER BY start_byte, doc_id) AS to_name FROM c WHERE symbol_path IS NOT NULL) WHERE to_name IS NOT NULL AND doc_id % 11 <> 0),
ch AS (SELECT repo_id, path, commit_sha AS hash, modified_at_ms // 1000 AS at_s FROM files WHERE commit_sha <> ''), rf AS (SELECT DISTINCT f.repo_id, f.path FROM documents d JOIN f ON f.file_id = d.doc_id WHERE doc_kind IN ('issue', 'review'))"""


def _bm_sql(source: str) -> str:
    return f""", tt AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOW.format("text")}, '[^\\p{{L}}\\p{{N}}_-]+'), lambda x: x <> '') AS t FROM {source}), zz AS (SELECT doc_id, coalesce(len(t), 0) AS len, list_filter(t, lambda x: x IN ('stale', 'shard', 'manifest')) AS hits FROM tt),
st AS (SELECT count(*) AS n, avg(len) AS avg_len FROM zz), mm AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len, unnest(hits) AS term FROM zz) GROUP BY ALL), fq AS (SELECT term, count(*) AS df FROM mm GROUP BY term),
bm AS (SELECT doc_id, floor(sum(greatest(ln((n - df + CAST(0.5 AS DOUBLE)) / (df + CAST(0.5 AS DOUBLE)) + 1), CAST(1e-6 AS DOUBLE)) * tf * CAST(2.2 AS DOUBLE) / (tf + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * len / avg_len))) * 10000 + 0.5) / 10000 AS score FROM mm JOIN fq USING (term), st GROUP BY doc_id),
bk AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM bm)"""


def _search_sql(graded: bool, vector: bool, generated: bool, fetch: int, limit: int) -> str:
    d = lambda x: f"CAST({x} AS DOUBLE)"
    other = " OR ".join(f"contains({_LOW.format('other')}, '{t}')" for t in ("stale", "shard", "manifest"))
    boost = " + ".join(f"CASE WHEN contains({_LOW.format(chr(99) + 'oalesce(symbol_path, ' + chr(39) * 2 + ')')}, '{t}') THEN {d(0.5)} ELSE 0 END + CASE WHEN contains({_LOW.format('u.path')}, '{t}') THEN {d(0.2)} ELSE 0 END" for t in ("stale", "shard", "manifest"))
    git = f"{d(0.1)} * coalesce(gs.g, 0)" if graded else f"CASE WHEN EXISTS (SELECT 1 FROM ch WHERE ch.repo_id = u.repo_id AND ch.path = u.path) THEN {d(0.03)} ELSE 0 END"
    total = "floor((bm25 + vector + symbol + graph + git + papertrail) * 10000 + 0.5) / 10000"
    score = f"floor({total} * CASE WHEN generated <> 0 THEN {d(0.6)} ELSE 1 END * CASE WHEN is_test <> 0 THEN {d(0.8)} ELSE 1 END * 10000 + 0.5) / 10000" if graded else total
    return f"""{_STORE}, q AS (SELECT * FROM r {"" if generated else "WHERE generated = 0"}){_bm_sql("q")},
vv AS (SELECT vec_id AS doc_id, list_dot_product(CAST(embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 0) AS DOUBLE[])) AS s FROM embeddings WHERE vec_id IN (SELECT doc_id FROM q)),
vb AS (SELECT * FROM vv WHERE s > 0 ORDER BY s DESC, doc_id LIMIT {fetch if vector else 0}), ff AS (SELECT doc_id, coalesce(1 / sqrt(rank), 0) AS bm25, least(coalesce(s, 0), 1) AS vector FROM (SELECT * FROM bk WHERE rank <= {fetch}) FULL JOIN vb USING (doc_id)),
u AS (SELECT q.*, bm25, vector FROM ff JOIN q USING (doc_id)),
nm AS (SELECT doc_id, symbol_path AS name FROM u WHERE symbol_path IS NOT NULL UNION SELECT doc_id, regexp_replace(symbol_path, '^[^:]*(?::[^:]+)*?\\.(?:rs|ts|tsx|mts|py|pyi|go|kt|kts|c|h|cc|cpp|hpp|cxx|swift|md)::', '') FROM u WHERE symbol_path IS NOT NULL),
ed AS (SELECT doc_id, edge_id, kind, confidence, arg_min(other, side) AS other FROM (SELECT doc_id, edge_id, kind, confidence, to_name AS other, 0 AS side FROM e JOIN nm ON from_name = name UNION ALL SELECT doc_id, edge_id, kind, confidence, from_name, 1 FROM e JOIN nm ON to_name = name) GROUP BY ALL),
ek AS (SELECT * FROM ed QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CASE confidence WHEN 'Exact' THEN 0 WHEN 'Syntactic' THEN 1 WHEN 'NameOnly' THEN 2 ELSE 3 END, kind, edge_id) <= 64),
ev AS (SELECT doc_id, CASE confidence WHEN 'Exact' THEN {d(1)} WHEN 'Syntactic' THEN {d(0.7)} WHEN 'NameOnly' THEN {d(0.15)} ELSE 0 END * CASE kind WHEN 'calls_name' THEN {d(1)} WHEN 'constructs' THEN 1 WHEN 'imports' THEN {d(0.6)} WHEN 'references_type' THEN {d(0.4)} ELSE {d(0.2)} END * CASE WHEN {other} THEN {d(1)} ELSE {d(0.35)} END AS v FROM ek),
gb AS (SELECT doc_id, least(max(v) + {d(0.15)} * (sum(v) - max(v)), 1) AS g FROM ev GROUP BY doc_id),
nw AS (SELECT repo_id, max(at_s) AS newest FROM ch GROUP BY 1), gs AS (SELECT repo_id, path, {d(0.6)} * least(sum(CASE WHEN at_s >= newest - 7776000 THEN 1 ELSE 0 END) / {d(5)}, 1) + {d(0.4)} * least(count(DISTINCT hash) / {d(20)}, 1) AS g FROM ch JOIN nw USING (repo_id) GROUP BY ALL),
p AS (SELECT u.doc_id, generated, is_test, {d(0.45)} * bm25 AS bm25, {d(0.35)} * vector AS vector, {d(0.1)} * least({boost}, {d(1)}) AS symbol, {d(0.05)} * coalesce(gb.g, 0) AS graph, {git} AS git,
  CASE WHEN EXISTS (SELECT 1 FROM rf WHERE rf.repo_id = u.repo_id AND rf.path = u.path) THEN {d(0.02)} ELSE 0 END AS papertrail FROM u LEFT JOIN gb ON gb.doc_id = u.doc_id LEFT JOIN gs ON gs.repo_id = u.repo_id AND gs.path = u.path),
o AS (SELECT *, {score} AS score, CASE WHEN bm25 > 0 AND vector > 0 THEN 'hybrid' WHEN vector > 0 THEN 'vector' ELSE 'lexical' END AS mode FROM p), k AS (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM o)
SELECT doc_id, score, mode, round(bm25, 6) AS bm25, round(vector, 6) AS vector, round(symbol, 6) AS symbol, round(graph, 6) AS graph, round(git, 6) AS git, CAST(round(papertrail, 6) AS DOUBLE) AS papertrail, rank FROM k WHERE rank <= {limit}"""


_SUMMARY = _LOW.format("left(array_to_string(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f]+'), lambda x: x <> ''), ' '), 240)")
SQL = {
    "semantic_search": _search_sql(False, True, False, 320, 40),
    "semantic_search_graded": _search_sql(True, True, True, 320, 40),
    "semantic_search_lexical": _search_sql(False, False, False, 320, 40),
    "match_any": f"SELECT doc_id FROM documents WHERE list_has_any(regexp_split_to_array({_LOW.format('text')}, '[^\\p{{L}}\\p{{N}}_-]+'), ['stale', 'shard', 'manifest'])",
    "docs_for_symbol": f"""{_STORE}{_bm_sql("r")}, h AS (SELECT r.doc_id, path, start_byte, score, {_SUMMARY} AS sm, {_LOW.format("coalesce(symbol_path, '')")} AS sy, {_LOW.format("path")} AS lp FROM r JOIN bk USING (doc_id) WHERE rank <= 200),
l AS (SELECT *, CASE WHEN path = 'crates/severity/src/shard/stale_branch.rs' AND sy = 'stale_branch::shard' THEN 0 WHEN path = 'crates/severity/src/shard/stale_branch.rs' THEN 1 WHEN contains(lp, 'stale_branch') AND (contains(sm, 'shard') OR contains(sy, 'shard')) THEN 2
  WHEN contains(sm, 'stale_branch::shard') OR contains(sy, 'stale_branch::shard') THEN 3 WHEN contains(sm, 'shard') OR contains(sy, 'shard') THEN 4 WHEN contains(lp, 'stale_branch') THEN 5 ELSE 9 END AS locality FROM h),
k AS (SELECT doc_id, locality, CAST(row_number() OVER (ORDER BY locality, score DESC, path, start_byte, doc_id) AS INTEGER) AS rank FROM l) SELECT * FROM k WHERE rank <= 60""",
    "note_search": f"""WITH m AS (SELECT doc_id, text FROM documents WHERE doc_kind = 'memory'){_bm_sql("m")}, v AS (SELECT vec_id AS doc_id, list_dot_product(CAST(embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 0) AS DOUBLE[])) AS s FROM embeddings WHERE vec_id IN (SELECT doc_id FROM m)),
u AS (SELECT doc_id, rank, CASE WHEN s > 0 THEN s END AS s FROM (SELECT * FROM bk WHERE rank <= 160) FULL JOIN v USING (doc_id) WHERE rank IS NOT NULL OR s >= CAST(0.45 AS DOUBLE)),
o AS (SELECT doc_id, floor((CAST(0.45 AS DOUBLE) * coalesce(1 / sqrt(rank), 0) + CAST(0.35 AS DOUBLE) * least(coalesce(s, 0), 1)) * 10000 + 0.5) / 10000 AS score FROM u), k AS (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM o) SELECT * FROM k WHERE rank <= 20""",
    "best_hits": "WITH b AS (SELECT l_partkey AS id, min(l_extendedprice) AS score FROM lineitem GROUP BY 1), k AS (SELECT *, CAST(row_number() OVER (ORDER BY score, id) AS INTEGER) AS rank FROM b) SELECT * FROM k WHERE rank <= 100",
}

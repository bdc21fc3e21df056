"""Notes, symbols and clusters: staged symbol resolution, logical symbols, typed note edges, bindings, clusters of files, briefs, usage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.functions.exprs import round4
from quernel.operators.index import latest
from quernel.operators.search import bm25
from quernel.plans.ranks import global_rank
from quernel.sources.projections import SQL_COMMITS, commits, file_changes
from quernel.sources.tables import table


def logical_symbols(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """(logical_id, n_members, first_id): symbols grouped by (repo, language, path, symbol path, kind).

    The id is the first 8 bytes of the SHA-256 of the key, halved.
    """
    own = chunks.where("symbol_path is not null").select("id", "file_id", "symbol_path", "chunk_kind").distinct()
    rows = own.join(files.select(F.col("id").alias("file_id"), "repo_id", "language", "path"), "file_id")
    key = F.concat_ws("\u001f", "repo_id", "language", "path", "symbol_path", "chunk_kind")
    digest = F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, -10).cast("bigint")  # signed, so that all 64 bits fit
    return rows.groupBy(F.shiftrightunsigned(digest, 1).alias("logical_id")).agg(F.count(F.lit(1)).alias("n_members"), F.min("id").alias("first_id"))


def resolve_names(uses: DataFrame, definitions: DataFrame) -> DataFrame:
    """(use_id, symbol_id, reason) of uses (use_id, file_id, repo_id, name): the first stage with exactly one definition binds.

    Stages: same file, same repository, anywhere. A stage with several stops nothing but binds nothing; a name
    without a binding has symbol_id null and reason ``ambiguous`` or ``unknown``.
    """
    found = definitions.select("symbol_id", F.col("file_id").alias("f"), F.col("repo_id").alias("r"), "name").distinct()
    by = lambda *keys: found.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("symbol_id").alias("one"))
    file = by("name", "f").select("name", F.col("f").alias("file_id"), F.col("n").alias("n1"), F.col("one").alias("s1"))
    repo = by("name", "r").select("name", F.col("r").alias("repo_id"), F.col("n").alias("n2"), F.col("one").alias("s2"))
    any_ = by("name").select("name", F.col("n").alias("n3"), F.col("one").alias("s3"))
    rows = uses.join(file, ["name", "file_id"], "left").join(repo, ["name", "repo_id"], "left").join(any_, "name", "left")
    reason = F.when(F.col("n1") == 1, "file").when(F.col("n2") == 1, "repo").when(F.col("n3") == 1, "global").when(F.col("n3") > 1, "ambiguous").otherwise("unknown")
    target = F.when(F.col("n1") == 1, F.col("s1")).when(F.col("n2") == 1, F.col("s2")).when(F.col("n3") == 1, F.col("s3"))
    return rows.select("use_id", target.alias("symbol_id"), reason.alias("reason"))


def note_edges(notes: DataFrame) -> DataFrame:
    """(edge_key, from_id, relation, to_id) of notes linked to the earliest other note of their thread."""
    first = notes.groupBy("thread").agg(F.min("id").alias("to_id"))
    rows = notes.join(first, "thread").where("id <> to_id").select(F.col("id").alias("from_id"), F.lit("relates_to").alias("relation"), "to_id")
    return rows.withColumn("edge_key", F.sha2(F.concat_ws("\u001e", F.col("from_id").cast("string"), "relation", F.col("to_id").cast("string")), 256))


def validate_bindings(bindings: DataFrame, files: DataFrame) -> DataFrame:
    """(note_id, path, status) of bindings (note_id, repo_id, path, sha256): current, stale (other hash), relocated (hash elsewhere) or gone."""
    here = files.select("repo_id", "path", F.col("sha256").alias("now")).distinct()
    moved = files.select("repo_id", "sha256").distinct().withColumn("elsewhere", F.lit(True))
    rows = bindings.join(here.groupBy("repo_id", "path").agg(F.max("now").alias("now")), ["repo_id", "path"], "left").join(moved, ["repo_id", "sha256"], "left")
    status = F.when(F.col("now") == F.col("sha256"), "current").when(F.col("elsewhere"), "relocated").when(F.col("now").isNotNull(), "stale").otherwise("gone")
    return rows.select("note_id", "path", status.alias("status"))


def notes_below(bindings: DataFrame) -> DataFrame:
    """(dir, n_notes): distinct notes bound to a directory or any path below it."""
    parts = F.split("path", "/")
    dirs = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    return bindings.select("note_id", F.explode(dirs).alias("dir")).groupBy("dir").agg(F.countDistinct("note_id").alias("n_notes"))


def blame_rollup(lines: DataFrame) -> DataFrame:
    """(chunk_id, dominant, newest, oldest, n_lines) of (chunk_id, commit, at_s, n): dominant has the most lines (ties: greatest commit)."""
    counts = lines.groupBy("chunk_id", "commit").agg(F.sum("n").alias("n"), F.max("at_s").alias("at_s"))
    return counts.groupBy("chunk_id").agg(
        F.max_by("commit", F.struct("n", "commit")).alias("dominant"), F.max_by("commit", F.struct("at_s", "commit")).alias("newest"), F.min_by("commit", F.struct("at_s", "commit")).alias("oldest"), F.sum("n").alias("n_lines")
    )


def library_usage(calls: DataFrame, sites: int = 25) -> DataFrame:
    """(moniker, call_count, shown, rank) of (moniker, site): all calls count; ``shown`` is how many a report of ``sites`` lists."""
    out = calls.groupBy("moniker").agg(F.count(F.lit(1)).alias("call_count"))
    return global_rank(out, F.desc("call_count"), "moniker").select("moniker", "call_count", F.least("call_count", F.lit(sites)).alias("shown"), "rank")


def closing_edges(claims: DataFrame) -> DataFrame:
    """(issue, closer, trusted): the claim that holds, where one of the provider beats all others and the later wins among equals."""
    return claims.groupBy("issue").agg(F.max_by(F.struct("closer", "trusted"), F.struct("trusted", "seq")).alias("w")).select("issue", "w.closer", "w.trusted")


def commits_touching(messages: DataFrame, changes: DataFrame, query: str, paths: list[int], limit: int = 20) -> DataFrame:
    """(hash, score) of commits whose message or paths match; lower is better: the place in the message search, a quarter less a path."""
    ranked = bm25(messages, query, limit).select(F.col("doc_id").alias("hash"), (F.col("rank") - 1).alias("place"))
    hits = changes.where(F.col("path").isin(paths)).groupBy("hash").agg(F.countDistinct("path").alias("n"))
    both = ranked.join(hits, "hash", "full_outer")
    return both.select("hash", (F.coalesce("place", F.lit(limit)) - 0.25 * F.coalesce("n", F.lit(0))).alias("score"))


def _resolve(s, d):
    files = latest(table(s, d, "files"), ["id"], ["indexed_at_ms", "indexed_revision"]).select(F.col("id").alias("file_id"), "repo_id")
    chunks = table(s, d, "chunks").select("id", "file_id", "symbol_path").distinct().join(files, "file_id")
    defs = chunks.where("symbol_path is not null").select(F.col("id").alias("symbol_id"), "file_id", "repo_id", F.col("symbol_path").alias("name"))
    uses = chunks.select(F.col("id").alias("use_id"), "file_id", "repo_id", F.coalesce("symbol_path", F.lit("?")).alias("name"))
    return resolve_names(uses, defs)


def _notes(s, d):
    return table(s, d, "documents").where("repo_id is not null").select(F.col("doc_id").alias("id"), F.concat_ws("/", "repo_id", "source").alias("thread"))


def _bindings(s, d):
    files = table(s, d, "files").select("id", "repo_id", "path", "sha256").distinct()
    # what a note saw: every third file with another hash, every seventh under another path
    return files.select(F.col("id").alias("note_id"), "repo_id", F.when(F.col("id") % 7 == 0, F.concat(F.lit("old/"), "path")).otherwise(F.col("path")).alias("path"), F.when(F.col("id") % 3 == 0, F.lit("0")).otherwise(F.col("sha256")).alias("sha256"))


def _blame(s, d):
    line = table(s, d, "lineitem").select(F.col("l_partkey").alias("chunk_id"), F.col("l_orderkey").alias("commit"), F.col("l_linenumber").cast("bigint").alias("n"))
    return blame_rollup(line.join(commits(s, d).select(F.col("hash").alias("commit"), F.col("authored_at_s").alias("at_s")), "commit"))


def _claims(s, d):
    return table(s, d, "lineitem").select(F.col("l_partkey").alias("issue"), F.col("l_suppkey").alias("closer"), (F.col("l_returnflag") == "R").alias("trusted"), (F.col("l_orderkey") * 100 + F.col("l_linenumber") * 10 + F.col("l_suppkey") % 10).alias("seq"))


def _closing(s, d):
    rows = _claims(s, d)
    return closing_edges(rows.groupBy("issue", "trusted", "seq").agg(F.max("closer").alias("closer")))


def _touching(s, d):
    messages = table(s, d, "documents").where("doc_kind = 'commit'").select("doc_id", "text")
    return commits_touching(messages, file_changes(s, d), "stale shard manifest", [3, 5])


QUERIES = {
    "logical_symbols": lambda s, d: logical_symbols(table(s, d, "chunks"), latest(table(s, d, "files"), ["id"], ["indexed_at_ms", "indexed_revision"])),
    "resolve_names": _resolve,
    "note_edges": lambda s, d: note_edges(_notes(s, d)),
    "validate_bindings": lambda s, d: validate_bindings(_bindings(s, d), table(s, d, "files")),
    "notes_below": lambda s, d: notes_below(_bindings(s, d)),
    "blame_rollup": _blame,
    "library_usage": lambda s, d: library_usage(table(s, d, "lineitem").select(F.col("l_partkey").alias("moniker"), F.col("l_orderkey").alias("site"))),
    "closing_edges": _closing,
    "commits_touching": _touching,
    "commit_search": lambda s, d: bm25(table(s, d, "documents").where("doc_kind = 'commit'").select("doc_id", "text"), "stale shard manifest").select("doc_id", "rank", round4(1 / F.sqrt(F.col("rank").cast("double"))).alias("rank_score")),
}
_FILES = "WITH f AS (SELECT * FROM files QUALIFY row_number() OVER (PARTITION BY id ORDER BY indexed_at_ms DESC NULLS LAST, indexed_revision DESC NULLS LAST) = 1)"
_BIND = "SELECT DISTINCT id AS note_id, repo_id, CASE WHEN id % 7 = 0 THEN 'old/' || path ELSE path END AS path, CASE WHEN id % 3 = 0 THEN '0' ELSE sha256 END AS sha256 FROM (SELECT DISTINCT id, repo_id, path, sha256 FROM files)"
_BM = """WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\p{L}\\p{N}_-]+'), lambda x: x <> '') AS t FROM documents WHERE doc_kind = 'commit'),
z AS (SELECT doc_id, coalesce(len(t), 0) AS len, list_filter(t, lambda x: x IN ('stale', 'shard', 'manifest')) AS hits FROM t),
st AS (SELECT count(*) AS n, avg(len) AS avg_len FROM z), m AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len, unnest(hits) AS term FROM z) GROUP BY ALL), fq AS (SELECT term, count(*) AS df FROM m GROUP BY term),
bm AS (SELECT doc_id, floor(sum(greatest(ln((n - df + CAST(0.5 AS DOUBLE)) / (df + CAST(0.5 AS DOUBLE)) + 1), CAST(1e-6 AS DOUBLE)) * tf * CAST(2.2 AS DOUBLE) / (tf + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * len / avg_len))) * 10000 + 0.5) / 10000 AS score FROM m JOIN fq USING (term), st GROUP BY doc_id),
b AS (SELECT doc_id, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM bm)"""


SQL = {
    "logical_symbols": f"""{_FILES}, r AS (SELECT DISTINCT c.id, f.repo_id, f.language, f.path, c.symbol_path, c.chunk_kind FROM chunks c JOIN f ON f.id = c.file_id WHERE c.symbol_path IS NOT NULL),
k AS (SELECT id, CAST('0x' || substr(sha256(concat_ws(chr(31), repo_id, language, path, symbol_path, chunk_kind)), 1, 16) AS UBIGINT) AS h FROM r) SELECT CAST(h >> 1 AS BIGINT) AS logical_id, count(*) AS n_members, min(id) AS first_id FROM k GROUP BY 1""",
    "resolve_names": f"""{_FILES}, c AS (SELECT DISTINCT c.id, c.file_id, c.symbol_path, f.repo_id FROM chunks c JOIN f ON f.id = c.file_id), a AS (SELECT symbol_path, file_id, count(*) AS n, min(id) AS s FROM c WHERE symbol_path IS NOT NULL GROUP BY ALL), b AS (SELECT symbol_path, repo_id, count(*) AS n, min(id) AS s FROM c WHERE symbol_path IS NOT NULL GROUP BY ALL),
g AS (SELECT symbol_path, count(*) AS n, min(id) AS s FROM c WHERE symbol_path IS NOT NULL GROUP BY ALL)
SELECT c.id AS use_id, CASE WHEN a.n = 1 THEN a.s WHEN b.n = 1 THEN b.s WHEN g.n = 1 THEN g.s END AS symbol_id, CASE WHEN a.n = 1 THEN 'file' WHEN b.n = 1 THEN 'repo' WHEN g.n = 1 THEN 'global' WHEN g.n > 1 THEN 'ambiguous' ELSE 'unknown' END AS reason
FROM c LEFT JOIN a ON a.symbol_path = c.symbol_path AND a.file_id = c.file_id LEFT JOIN b ON b.symbol_path = c.symbol_path AND b.repo_id = c.repo_id LEFT JOIN g ON g.symbol_path = c.symbol_path""",
    "note_edges": "WITH n AS (SELECT doc_id AS id, concat_ws('/', repo_id, source) AS thread FROM documents WHERE repo_id IS NOT NULL), m AS (SELECT thread, min(id) AS to_id FROM n GROUP BY thread) SELECT id AS from_id, 'relates_to' AS relation, to_id, sha256(concat_ws(chr(30), id, 'relates_to', to_id)) AS edge_key FROM n JOIN m USING (thread) WHERE id <> to_id",
    "validate_bindings": f"""WITH b AS ({_BIND}), h AS (SELECT repo_id, path, max(sha256) AS now FROM files GROUP BY ALL), e AS (SELECT DISTINCT repo_id, sha256 FROM files)
SELECT note_id, b.path, CASE WHEN now = b.sha256 THEN 'current' WHEN e.sha256 IS NOT NULL THEN 'relocated' WHEN now IS NOT NULL THEN 'stale' ELSE 'gone' END AS status FROM b LEFT JOIN h ON h.repo_id = b.repo_id AND h.path = b.path LEFT JOIN e ON e.repo_id = b.repo_id AND e.sha256 = b.sha256""",
    "notes_below": f"WITH b AS ({_BIND}), p AS (SELECT note_id, string_split(path, '/') AS a FROM b), q AS (SELECT note_id, a, unnest(range(1, len(a) + 1)) AS k FROM p) SELECT array_to_string(a[1:k], '/') AS dir, count(DISTINCT note_id) AS n_notes FROM q GROUP BY ALL",
    "blame_rollup": f"""WITH commits AS ({SQL_COMMITS}), l AS (SELECT l_partkey AS chunk_id, l_orderkey AS commit, CAST(sum(l_linenumber) AS BIGINT) AS n, max(authored_at_s) AS at_s FROM lineitem JOIN commits ON hash = l_orderkey GROUP BY ALL)
SELECT chunk_id, arg_max(commit, (n, commit)) AS dominant, arg_max(commit, (at_s, commit)) AS newest, arg_min(commit, (at_s, commit)) AS oldest, CAST(sum(n) AS BIGINT) AS n_lines FROM l GROUP BY chunk_id""",
    "library_usage": "WITH c AS (SELECT l_partkey AS moniker, count(*) AS call_count FROM lineitem GROUP BY l_partkey) SELECT moniker, call_count, least(call_count, 25) AS shown, CAST(row_number() OVER (ORDER BY call_count DESC, moniker) AS INTEGER) AS rank FROM c",
    "closing_edges": "WITH r AS (SELECT l_partkey AS issue, l_returnflag = 'R' AS trusted, l_orderkey * 100 + l_linenumber * 10 + l_suppkey % 10 AS seq, max(l_suppkey) AS closer FROM lineitem GROUP BY ALL) SELECT issue, closer, trusted FROM r QUALIFY row_number() OVER (PARTITION BY issue ORDER BY trusted DESC, seq DESC) = 1",
    "commits_touching": f"{_BM}, x AS (SELECT doc_id AS hash, rank - 1 AS place FROM b WHERE rank <= 20), h AS (SELECT l_orderkey AS hash, count(DISTINCT l_suppkey) AS n FROM lineitem WHERE l_suppkey IN (3, 5) GROUP BY l_orderkey) SELECT hash, CAST(coalesce(place, 20) - CAST(0.25 AS DOUBLE) * coalesce(n, 0) AS DOUBLE) AS score FROM x FULL JOIN h USING (hash)",
    "commit_search": f"{_BM} SELECT doc_id, rank, floor(1 / sqrt(rank) * 10000 + 0.5) / 10000 AS rank_score FROM b",
}

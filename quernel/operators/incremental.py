"""Keeping an index up to date: cutting sources into chunks, what needs an embedding, history rows, healing, dead rows, schedules."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.operators.index import CONTEXT_LINES, EMBED_CHARS, SMALL_CHARS, STRUCTURE_BYTES, SYMBOL_LINES, TEXT_LINES, consolidate, discovery_plan, latest
from quernel.plans.ranks import top_ranked
from quernel.sources.tables import table

CHUNKS = "file_id bigint, kind string, symbol string, start_byte bigint, end_byte bigint, start_line int, end_line int"


def _windows(first: int, last: int, lines: int) -> list[tuple[int, int]]:
    return [(a, min(a + lines - 1, last)) for a in range(first, last + 1, lines)]


def chunk_spans(path: str, language: str | None, kind: str | None, text: str, symbols: list[tuple[str, int, int]]) -> list[tuple]:
    """(kind, symbol, start_byte, end_byte, start_line, end_line) of the chunks of one source.

    Generated files and sources over 512,000 bytes (but markdown) are windows of 160 lines. Markdown is cut before each line that starts with
    ``#`` once there is text, and a chunk names the headings so far. Code is cut by its symbols (name, first line, last line), 120 lines a part
    (``name#1``), and what no symbol covers by 80 lines a part; blank stretches give nothing, a source without chunks is one.
    """
    lines = [x + "\n" for x in text.split("\n")[:-1]] + ([text.split("\n")[-1]] if not text.endswith("\n") and text else [])
    at = [0]
    for x in lines:
        at.append(at[-1] + len(x.encode("utf-8", "surrogatepass")))
    file = path.rsplit("/", 1)[-1]
    span = lambda k, name, a, b: (k, name or None, at[a - 1], at[b], a, b)
    if not lines:
        return []
    if kind == "generated" or (at[-1] > STRUCTURE_BYTES and language != "markdown"):
        return [span("generated" if kind == "generated" else "code", file, a, b) for a, b in _windows(1, len(lines), TEXT_LINES)]
    if language == "markdown":
        out, headings, start, solid = [], [], 1, False
        for n, x in enumerate(lines, 1):
            if x.startswith("#") and solid:
                out.append(span("markdown", " > ".join(headings), start, n - 1))
                start, solid = n, False
            if m := re.match(r"\s*#+(.*)", x):
                headings.append(m.group(1).strip())
            solid = solid or bool(x.strip())
        return out + ([span("markdown", " > ".join(headings), start, len(lines))] if solid else [])
    out, covered = [], [False] * (len(lines) + 2)
    blank = lambda a, b: not "".join(lines[a - 1 : b]).strip()
    for name, a, b in symbols:
        a, b = max(a, 1), min(b, len(lines))
        if a > b or blank(a, b):
            continue
        covered[a : b + 1] = [True] * (b + 1 - a)
        out += [span("code", f"{name}#{k}" if k else name, x, y) for k, (x, y) in enumerate(_windows(a, b, SYMBOL_LINES))]
    context, start = 0, None
    for n in range(1, len(lines) + 2):
        if n <= len(lines) and not covered[n]:
            start = start or n
        elif start:
            if not blank(start, n - 1):
                parts = _windows(start, n - 1, CONTEXT_LINES)
                out += [span("code", f"{path}::#context-{context + 1}" + (f"-{k}" if k else ""), x, y) for k, (x, y) in enumerate(parts)]
                context += len(parts)
            start = None
    return sorted(out, key=lambda c: (c[2], c[3])) or [span("code", file, 1, len(lines))]


def file_chunks(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Chunks of ``files`` (file_id, path, language, kind, text) by ``symbols`` (file_id, name, start_line, end_line); see ``chunk_spans``.

    Each file is cut on its own. Null texts give nothing.
    """
    own = symbols.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("start_line", "end_line", "name"))).alias("symbols"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, path, language, kind, text, found in zip(b.file_id, b.path, b.language, b.kind, b.text, b.symbols, strict=True):
                spans = chunk_spans(path, language, kind, text, [(x["name"], x["start_line"], x["end_line"]) for x in (found if found is not None else [])])
                out += [(i, *x) for x in spans]
            yield pd.DataFrame(out, columns=["file_id", "kind", "symbol", "start_byte", "end_byte", "start_line", "end_line"])

    rows = files.where("text is not null").select("file_id", "path", "language", "kind", "text").join(own, "file_id", "left")
    return rows.mapInPandas(run, CHUNKS)


def embedding_input(path, language, kind, symbol, text) -> Column:
    """What is embedded of a chunk: its place, then as much of its text as 4,000 characters leave room for, 80 at least."""
    head = F.concat(F.lit("path: "), path, F.lit("\nlanguage: "), language, F.lit("\nkind: "), kind, F.lit("\n"), F.when(symbol.isNotNull(), F.concat(F.lit("symbol: "), symbol, F.lit("\n"))).otherwise(""), F.lit("body:\n"))
    return F.concat(head, F.substring(text, F.lit(1), F.greatest(F.lit(EMBED_CHARS) - F.length(head), F.lit(SMALL_CHARS))))


def needs_embedding(chunks: DataFrame, embeddings: DataFrame, model: str, version: str, dim: int, text_version: str) -> DataFrame:
    """(chunk_id, why) of chunks without a fresh embedding: the first of missing, status, text, model, dimension, text_version, input that doesn't agree.

    ``chunks``: chunk_id, text_hash, input (``embedding_input``); ``embeddings``: chunk_id, status, source_text_hash, model_version, embedding_dim,
    text_version, input_hash, one row a chunk. Null never agrees.
    """
    rows = chunks.join(embeddings.withColumn("there", F.lit(True)), "chunk_id", "left")
    differs = lambda a, b: ~F.col(a).eqNullSafe(b)
    wanted = F.sha2(F.concat_ws("\u0000", F.lit(model), F.lit(version), F.lit(text_version), F.col("input")), 256)
    why = (
        F.when(F.col("there").isNull(), "missing").when(differs("status", F.lit("Current")), "status").when(differs("source_text_hash", F.col("text_hash")), "text").when(differs("model_version", F.lit(version)), "model")
        .when(differs("embedding_dim", F.lit(dim)), "dimension").when(differs("text_version", F.lit(text_version)), "text_version").when(differs("input_hash", wanted), "input")
    )
    return rows.select("chunk_id", why.alias("why")).where("why is not null")


def applied_history(current: DataFrame, fresh: DataFrame, modes: DataFrame) -> DataFrame:
    """History rows (repo_id, hash, path) after ``fresh`` came in: a repository of mode ``append`` keeps its rows and takes the new ones, one of
    mode ``replace`` (its history was rewritten) has the fresh rows alone; others stay. ``modes``: repo_id, mode."""
    mode = F.broadcast(modes.select("repo_id", "mode"))
    kept = current.join(mode, "repo_id", "left").where(~F.col("mode").eqNullSafe("replace")).drop("mode")
    taken = fresh.join(mode, "repo_id").drop("mode")
    return kept.unionByName(taken.select(*current.columns)).distinct()


def heal_plan(indexed: DataFrame, found: DataFrame, limit: int) -> DataFrame:
    """(repo_id, path, action, rank): the first ``limit`` paths whose row in the index isn't what was found (a bounded step of healing)."""
    return top_ranked(discovery_plan(indexed, found).where("action <> 'keep'"), limit, "repo_id", "path")


def dead_rows(rows: DataFrame, live: DataFrame) -> DataFrame:
    """Rows of generations that aren't the live one of their repository (``live``: repo_id, generation); a repository without one has none live."""
    return rows.join(F.broadcast(live.select("repo_id", F.col("generation").alias("_live"))), "repo_id", "left").where(~F.col("generation").eqNullSafe(F.col("_live"))).drop("_live")


def relevant(kind, path, ignored: str, targets: str) -> Column:
    """Whether a watcher event starts a pass: a rescan always, else a create, modify or remove of an ignore file, or of a target that isn't ignored.

    ``ignored`` and ``targets`` are regular expressions of paths. Works on streams: it is a filter.
    """
    rules = path.rlike(r"(^|/)\.gitignore$")
    return (kind == "rescan") | (kind.isin("create", "modify", "remove") & (rules | (~path.rlike(ignored) & path.rlike(targets))))


def schedule(states: DataFrame, now_ms: int, least_s: int, full_s: int, probe_s: int) -> DataFrame:
    """(binding, decision): skip, full, incremental or probe for (binding, retry_not_before_ms, last_attempt_ms, continuation, last_full_ms, last_probe_ms, changed).

    A retry time or too recent an attempt skips; a walk that was begun goes on; then come a due full walk, a change, a due probe.
    """
    due = lambda c, s: F.col(c).isNull() | (F.lit(now_ms) - F.col(c) >= s * 1_000)
    decision = (
        F.when(F.col("retry_not_before_ms") > now_ms, "skip").when(~due("last_attempt_ms", least_s), "skip").when(F.col("continuation").isin("full", "incremental"), F.col("continuation"))
        .when(due("last_full_ms", full_s), "full").when(F.col("changed"), "incremental").when(due("last_probe_ms", probe_s), "probe").otherwise("skip")
    )
    return states.select("binding", decision.alias("decision"))


# -- the given tables
def _files(s: SparkSession, d: str) -> DataFrame:
    return latest(table(s, d, "files"), ["id"], ["indexed_at_ms", "indexed_revision"])


def _texts(s, d):
    return table(s, d, "chunk_text").groupBy(F.col("chunk_id").alias("id")).agg(F.max("blob").alias("b")).select("id", F.decode("b", "UTF-8").alias("text"))


def _sources(s, d):
    """Whole sources: the texts of a file's chunks in order."""
    parts = table(s, d, "chunks").select("id", "file_id", "start_byte").distinct().join(_texts(s, d), "id")
    whole = parts.groupBy("file_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start_byte", "id", "text"))), lambda x: x["text"]), "").alias("text"))
    return whole.join(_files(s, d).select(F.col("id").alias("file_id"), "path", F.lower(F.trim("language")).alias("language"), "kind"), "file_id")


def _file_chunks(s, d):
    symbols = table(s, d, "chunks").where("symbol_path is not null and id % 2 = 0").select("file_id", F.col("symbol_path").alias("name"), "start_line", "end_line").distinct()
    return file_chunks(_sources(s, d), symbols)


def _inputs(s, d):
    c = table(s, d, "chunks").select("id", "file_id", "symbol_path", "chunk_kind", "text_hash").distinct().join(_texts(s, d), "id").join(_files(s, d).select(F.col("id").alias("file_id"), "path", F.coalesce("language", F.lit("")).alias("language")), "file_id")
    return c.select(F.col("id").alias("chunk_id"), "text_hash", embedding_input(F.col("path"), F.col("language"), F.col("chunk_kind"), F.col("symbol_path"), F.col("text")).alias("input"))


def _needed(s, d):
    chunks = _inputs(s, d)
    e = table(s, d, "chunk_embeddings").groupBy("chunk_id").agg(F.max(F.struct("id", "status", "source_text_hash", "model_version", "embedding_dim")).alias("e")).select("chunk_id", "e.*")
    hashed = chunks.select("chunk_id", F.sha2(F.concat_ws("\u0000", F.lit("m"), F.lit("v"), F.lit("t1"), F.col("input")), 256).alias("h"))
    rows = e.join(hashed, "chunk_id").select("chunk_id", "status", "source_text_hash", F.when(F.col("id") % 13 == 0, "old").otherwise("v").alias("model_version"), (F.col("id") % 17 != 0).cast("int").alias("embedding_dim"), F.when(F.col("id") % 19 == 0, "t0").otherwise("t1").alias("text_version"), F.when(F.col("id") % 5 == 0, "x").otherwise(F.col("h")).alias("input_hash"))
    return needs_embedding(chunks, rows, "m", "v", 1, "t1")


def _history(s, d):
    rows = table(s, d, "files").select("repo_id", F.col("commit_sha").alias("hash"), "path", "id").where("hash <> ''")
    modes = table(s, d, "repos").select("repo_id", F.when(F.length("display_name") % 3 == 0, "replace").when(F.length("display_name") % 3 == 1, "append").otherwise("none").alias("mode")).where("mode <> 'none'")
    return applied_history(rows.where("id % 2 = 0").drop("id"), rows.where("id % 3 = 0").drop("id"), modes)


def _heal(s, d):
    base = latest(_files(s, d), ["repo_id", "path"], ["indexed_at_ms", "id"])
    return heal_plan(base.where("id % 11 <> 0"), base.where("id % 13 <> 0").withColumn("sha256", F.when(F.col("id") % 7 == 0, "new").otherwise(F.col("sha256"))), 40)


def _dead(s, d):
    rows = table(s, d, "files").select("id", "repo_id", (F.col("id") % 3).alias("generation")).distinct()
    return dead_rows(rows, table(s, d, "repos").where("length(display_name) > 8").select("repo_id", (F.length("display_name") % 3).alias("generation")))


def _events(s, d):
    i = F.col("event_id")
    kind = F.when(F.col("event_type") == "error", "rescan").when(i % 3 == 0, "create").when(i % 3 == 1, "modify").otherwise("access")
    path = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("src/a", "target/b", "docs/.gitignore", "node_modules/x/c", "lib/d")]), (i % 5 + 1).cast("int")), F.when(i % 5 == 2, "").when(i % 4 == 0, ".rs").otherwise(".txt"))
    return table(s, d, "events").select("event_id", kind.alias("kind"), path.alias("path"))


def _schedule(s, d):
    o = table(s, d, "orders")
    k = F.col("o_orderkey")
    at = lambda n: F.when(k % n != 0, F.lit(1_000_000) - k % (n * 1_000) * 40)
    return schedule(o.select(k.alias("binding"), F.when(k % 10 == 0, 1_000_001).otherwise(F.lit(None)).alias("retry_not_before_ms"), at(7).alias("last_attempt_ms"), F.when(k % 9 == 0, "full").when(k % 9 == 1, "incremental").otherwise("none").alias("continuation"), at(11).alias("last_full_ms"), at(5).alias("last_probe_ms"), (k % 4 == 0).alias("changed")), 1_000_000, 60, 300, 120)


def _consolidated(s, d):
    docs = table(s, d, "documents")
    return consolidate({"one": docs.where("doc_id % 2 = 0").select("doc_id", "lang"), "two": docs.where("doc_id % 2 = 1").select("doc_id", "source")})


QUERIES = {
    "file_chunks": _file_chunks,
    "needs_embedding": _needed,
    "history_applied": _history,
    "heal_plan": _heal,
    "dead_rows": _dead,
    "relevant_events": lambda s, d: _events(s, d).where(relevant(F.col("kind"), F.col("path"), r"(^|/)(target|node_modules)/", r"\.rs$")),
    "sync_schedule": _schedule,
    "consolidated": _consolidated,
}
_F = "f AS (SELECT * FROM files QUALIFY row_number() OVER (PARTITION BY id ORDER BY indexed_at_ms DESC NULLS LAST, indexed_revision DESC NULLS LAST) = 1)"
_HEAD = "'path: ' || path || chr(10) || 'language: ' || coalesce(language, '') || chr(10) || 'kind: ' || chunk_kind || chr(10) || CASE WHEN symbol_path IS NOT NULL THEN 'symbol: ' || symbol_path || chr(10) ELSE '' END || 'body:' || chr(10)"
_AT = lambda n: f"CASE WHEN o_orderkey % {n} <> 0 THEN 1000000 - o_orderkey % {n * 1000} * 40 END"
SQL = {
    "needs_embedding": f"""WITH {_F}, t AS (SELECT chunk_id, decode(max(blob)) AS text FROM chunk_text GROUP BY 1), c AS (SELECT DISTINCT c.id AS chunk_id, symbol_path, chunk_kind, text_hash, path, language FROM chunks c JOIN f ON f.id = c.file_id), h AS (SELECT c.*, text, {_HEAD} AS head FROM c JOIN t USING (chunk_id)),
i AS (SELECT chunk_id, text_hash, sha256('m' || chr(0) || 'v' || chr(0) || 't1' || chr(0) || head || substr(text, 1, greatest(4000 - length(head), 80))) AS want FROM h), e AS (SELECT * FROM chunk_embeddings QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY id DESC, status DESC, source_text_hash DESC) = 1),
r AS (SELECT i.chunk_id, CASE WHEN e.id IS NULL THEN 'missing' WHEN status IS DISTINCT FROM 'Current' THEN 'status' WHEN source_text_hash IS DISTINCT FROM text_hash THEN 'text' WHEN e.id % 13 = 0 THEN 'model' WHEN e.id % 17 = 0 THEN 'dimension' WHEN e.id % 19 = 0 THEN 'text_version' WHEN e.id % 5 = 0 THEN 'input' END AS why FROM i LEFT JOIN e USING (chunk_id))
SELECT * FROM r WHERE why IS NOT NULL""",
    "history_applied": """WITH r AS (SELECT repo_id, commit_sha AS hash, path, id FROM files WHERE commit_sha <> ''), m AS (SELECT repo_id, CASE length(display_name) % 3 WHEN 0 THEN 'replace' WHEN 1 THEN 'append' END AS mode FROM repos)
SELECT repo_id, hash, path FROM r LEFT JOIN m USING (repo_id) WHERE id % 2 = 0 AND mode IS DISTINCT FROM 'replace' UNION SELECT repo_id, hash, path FROM r JOIN m USING (repo_id) WHERE id % 3 = 0 AND mode IS NOT NULL""",
    "heal_plan": f"""WITH {_F}, b AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY repo_id, path ORDER BY indexed_at_ms DESC NULLS LAST, id DESC) = 1),
p AS (SELECT repo_id, path, CASE WHEN id % 11 = 0 AND id % 13 <> 0 THEN 'add' WHEN id % 13 = 0 AND id % 11 <> 0 THEN 'delete' WHEN id % 7 = 0 AND sha256 IS DISTINCT FROM 'new' THEN 'change' END AS action FROM b WHERE NOT (id % 11 = 0 AND id % 13 = 0)),
k AS (SELECT *, CAST(row_number() OVER (ORDER BY repo_id, path) AS INTEGER) AS rank FROM p WHERE action IS NOT NULL) SELECT * FROM k WHERE rank <= 40""",
    "dead_rows": "SELECT DISTINCT id, f.repo_id, id % 3 AS generation FROM files f LEFT JOIN (SELECT repo_id, length(display_name) % 3 AS g FROM repos WHERE length(display_name) > 8) USING (repo_id) WHERE id % 3 IS DISTINCT FROM g",
    "relevant_events": """WITH e AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 'rescan' WHEN event_id % 3 = 0 THEN 'create' WHEN event_id % 3 = 1 THEN 'modify' ELSE 'access' END AS kind, CASE event_id % 5 WHEN 0 THEN 'src/a' WHEN 1 THEN 'target/b' WHEN 2 THEN 'docs/.gitignore' WHEN 3 THEN 'node_modules/x/c' ELSE 'lib/d' END || CASE WHEN event_id % 5 = 2 THEN '' WHEN event_id % 4 = 0 THEN '.rs' ELSE '.txt' END AS path FROM events)
SELECT * FROM e WHERE kind = 'rescan' OR (kind IN ('create', 'modify', 'remove') AND (path LIKE '%/.gitignore' OR (path NOT LIKE 'target/%' AND path NOT LIKE 'node_modules/%' AND path LIKE '%.rs')))""",
    "sync_schedule": f"""WITH s AS (SELECT o_orderkey AS binding, o_orderkey % 10 = 0 AS r, {_AT(7)} AS a, CASE o_orderkey % 9 WHEN 0 THEN 'full' WHEN 1 THEN 'incremental' END AS c, {_AT(11)} AS f, {_AT(5)} AS p, o_orderkey % 4 = 0 AS ch FROM orders)
SELECT binding, CASE WHEN r THEN 'skip' WHEN 1000000 - a < 60000 THEN 'skip' WHEN c IS NOT NULL THEN c WHEN f IS NULL OR 1000000 - f >= 300000 THEN 'full' WHEN ch THEN 'incremental' WHEN p IS NULL OR 1000000 - p >= 120000 THEN 'probe' ELSE 'skip' END AS decision FROM s""",
    "consolidated": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang END AS lang, CASE WHEN doc_id % 2 = 1 THEN source END AS source, CASE WHEN doc_id % 2 = 0 THEN 'one' ELSE 'two' END AS repo_id FROM documents",
}

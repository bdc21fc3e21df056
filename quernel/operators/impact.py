"""What a change of a symbol touches: lanes with limits and truncation flags, text hits, histories of paths, and what is exported to other languages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernel.functions.exprs import ascii_lower, query_terms, terms
from quernel.operators.index import latest
from quernel.operators.resolution import named_edges, named_symbols, visible
from quernel.plans.ranks import top_ranked
from quernel.sources.tables import table

#: Categories in order, and reasons within them (fixed values).
CATEGORIES = ("Direct structural impact", "Probable textual impact", "Historical/papertrail evidence")
CALLS, IMPORTS = ("calls_name", "constructs", "dispatches", "uses_operator"), ("imports", "exports")


def _rows(rows: DataFrame, k: int, reason: str) -> DataFrame:
    return rows.select("path", F.coalesce("symbol", F.lit("")).alias("symbol"), F.lit(k).alias("k"), F.lit(reason).alias("reason"), "evidence")


def lanes(edges: DataFrame, symbols: DataFrame, symbol_id: int, qualified: str) -> DataFrame:
    """(path, symbol, k, reason, evidence): definition, callers, callees, import dependents and siblings of a symbol, not yet merged.

    ``symbols``: symbol_id, name, qualified_name, path. An edge is followed by id, and an unresolved one by its qualified target.
    """
    seed = symbols.where(F.col("symbol_id") == symbol_id)
    own = lambda c: symbols.select(F.col("symbol_id").alias(c), "path", F.col("qualified_name").alias("symbol"))
    to_seed = (F.col("to_symbol_id") == symbol_id) | F.coalesce(F.col("target_qualified_name") == qualified, F.lit(False))
    said = F.concat_ws(" ", "kind", F.lit("edge"), "confidence").alias("evidence")
    calls = edges.where(to_seed & F.col("kind").isin(*CALLS)).join(own("from_symbol_id"), "from_symbol_id").select("path", "symbol", said)
    called = edges.where((F.col("from_symbol_id") == symbol_id) & F.col("kind").isin(*CALLS) & F.col("to_symbol_id").isNotNull()).join(own("to_symbol_id"), "to_symbol_id").select("path", "symbol", said)
    imported = edges.where(to_seed & F.col("kind").isin(*IMPORTS)).join(own("from_symbol_id"), "from_symbol_id").select("path", "symbol", said)
    mates = symbols.join(F.broadcast(seed.select("path", F.col("symbol_id").alias("_s"))), "path").where("symbol_id <> _s").select("path", F.col("qualified_name").alias("symbol"), F.lit("same file").alias("evidence"))
    defined = seed.select("path", F.col("qualified_name").alias("symbol"), F.concat(F.lit("defined as "), "qualified_name").alias("evidence"))
    parts = ((defined, "exact_symbol_definition"), (calls, "direct_caller"), (called, "direct_callee"), (imported, "import_export_dependent"), (mates, "same_file_symbol"))
    out = None
    for k, (rows, reason) in enumerate(parts):
        out = _rows(rows, k, reason) if out is None else out.unionByName(_rows(rows, k, reason))
    return out


def surface(found: DataFrame, limit: int) -> DataFrame:
    """(path, symbol, reason, evidence, rank): ``found`` merged by (path, symbol, reason) with all evidence, in order of reason, path and symbol.

    One row beyond ``limit`` is asked for; where it exists a last row with reason ``completeness`` says so.
    """
    merged = found.groupBy("k", "path", "symbol", "reason").agg(F.array_join(F.sort_array(F.collect_set("evidence")), "; ").alias("evidence"))
    rows = top_ranked(merged, limit + 1, "k", "path", "symbol", "reason").select("path", "symbol", "reason", "evidence", "rank")
    notice = rows.where(F.col("rank") > limit).select(F.lit("").alias("path"), F.lit("").alias("symbol"), F.lit("completeness").alias("reason"), F.lit("more impact items exist beyond the limit").alias("evidence"), "rank")
    return rows.where(F.col("rank") <= limit).unionByName(notice)


def sections(found: DataFrame, limit: int) -> DataFrame:
    """(reason, n_shown, truncated): what each lane shows of its distinct items under ``limit`` (0: all), and whether it may have been cut."""
    n = found.groupBy("reason").agg(F.countDistinct("path", "symbol").alias("n"))
    shown = F.least("n", F.lit(limit).cast("bigint")) if limit else F.col("n")
    return n.select("reason", shown.alias("n_shown"), (F.lit(limit > 0) & (F.col("n") >= limit)).alias("truncated"))


def text_hits(files: DataFrame, symbols: DataFrame, texts: DataFrame, needle: str, limit: int) -> DataFrame:
    """(file_id, match, symbol, rank): files whose path, symbols or text hold ``needle``, path matches first to tell, by kind and path.

    ``files``: file_id, path, kind; ``symbols``: file_id, name; ``texts``: file_id, text. Paths and names contain it (case of A to Z aside); a text
    holds its terms in a row.
    """
    low = ascii_lower(F.lit(needle))
    words = query_terms(needle)
    by_name = symbols.where(ascii_lower(F.col("name")).contains(low)).groupBy("file_id").agg(F.max("name").alias("symbol"))
    phrase = " " + " ".join(words) + " "
    joined = F.concat(F.lit(" "), F.array_join(terms("text"), " "), F.lit(" "))
    by_text = texts.where(joined.contains(phrase) if words else F.lit(False)).select("file_id").distinct().withColumn("in_text", F.lit(True))
    rows = files.join(by_name, "file_id", "left").join(by_text, "file_id", "left").withColumn("in_path", ascii_lower(F.col("path")).contains(low))
    rows = rows.where(F.col("in_path") | F.col("symbol").isNotNull() | F.col("in_text"))
    match = F.when(F.col("in_path"), "path match").when(F.col("symbol").isNotNull(), "symbol match").otherwise("chunk text match")
    best = top_ranked(rows.withColumn("match", match), limit, "kind", "path", "file_id")
    return best.select("file_id", "match", F.when(F.col("match") == "symbol match", F.col("symbol")).alias("symbol"), "rank")


def reconciled(graph_rows: DataFrame, text_rows: DataFrame) -> DataFrame:
    """(path, line, found): places (path, line) that the graph and a text search both know (``matched``), or only one of them (``graph_only``, ``text_only``)."""
    a, b = graph_rows.select("path", "line").distinct().withColumn("g", F.lit(True)), text_rows.select("path", "line").distinct().withColumn("t", F.lit(True))
    found = F.when(F.col("t").isNull(), "graph_only").when(F.col("g").isNull(), "text_only").otherwise("matched")
    return a.join(b, ["path", "line"], "full_outer").select("path", "line", found.alias("found"))


def commits_for_paths(changes: DataFrame, commits: DataFrame, paths: DataFrame, budget: int) -> DataFrame:
    """(path, hash, rank): the newest ``budget`` commits of each asked path, so that a busy path takes no room from others."""
    rows = changes.join(F.broadcast(paths.select("path").distinct()), "path").join(commits, "hash")
    place = Window.partitionBy("path").orderBy(F.desc("authored_at_s"), "hash")
    return rows.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= budget).select("path", "hash", "rank")


def exported_surface(symbols: DataFrame, files: DataFrame, facts: DataFrame, limit: int) -> DataFrame:
    """(path, symbol, reason, rank): what a library shows to other languages: exported symbols, members within exported impls, generated bindings.

    ``symbols``: symbol_id, file_id, name, kind, start_byte, end_byte; ``files``: file_id, path, language, kind; ``facts``: symbol_id of exported symbols.
    A member lies strictly within an exported impl of its file, so the file is the key of the join and only impls are its other side.
    """
    rust = files.where("language = 'rust'").select("file_id", "path", F.col("kind").alias("file_kind"))
    own = symbols.join(facts.select("symbol_id").distinct(), "symbol_id", "left_semi").join(rust, "file_id")
    exported = own.where(F.col("kind").isin("function", "method", "impl", "struct", "enum", "trait")).select("path", "file_kind", "name", F.when(F.col("kind") == "impl", "rust_exported_impl").otherwise("rust_export").alias("reason"))
    impls = own.where("kind = 'impl'").select("file_id", "path", "file_kind", F.col("start_byte").alias("a"), F.col("end_byte").alias("b"))
    inside = symbols.where(F.col("kind").isin("function", "method")).join(impls, "file_id").where("start_byte > a and end_byte < b").select("path", "file_kind", "name", F.lit("rust_impl_member").alias("reason"))
    made = files.where(F.col("path").contains("/generated/") | F.col("path").endswith("generated-manifest.json")).select("file_id", "path", F.col("kind").alias("file_kind")).join(symbols, "file_id").select("path", "file_kind", "name", F.lit("generated_binding_artifact").alias("reason"))
    every = exported.union(inside).union(made).distinct()
    return top_ranked(every, limit, "reason", F.desc("file_kind"), "path", "name").select("path", F.col("name").alias("symbol"), "reason", "rank")


# -- the given tables
def _symbols(s: SparkSession, d: str) -> DataFrame:
    return named_symbols(s, d).join(table(s, d, "nation").select(F.col("n_nationkey").alias("file_id"), F.col("n_name").alias("path")), "file_id")


def _lanes(s, d):
    return lanes(visible(named_edges(s, d)), _symbols(s, d), 7, "m3::fn7")


def _files(s, d):
    return latest(table(s, d, "files"), ["id"], ["indexed_at_ms", "indexed_revision"]).where("kind <> 'deleted'").select(F.col("id").alias("file_id"), "path", "kind", F.lower(F.trim("language")).alias("language"))


def _hits(s, d):
    chunks = table(s, d, "chunks").select("id", "file_id", "symbol_path").distinct()
    texts = table(s, d, "chunk_text").groupBy(F.col("chunk_id").alias("id")).agg(F.max("blob").alias("b")).join(chunks, "id").select("file_id", F.decode("b", "UTF-8").alias("text"))
    return text_hits(_files(s, d), chunks.where("symbol_path is not null").select("file_id", F.col("symbol_path").alias("name")), texts, "shard", 80)


def _paths(s, d):
    from quernel.sources.projections import commits, file_changes

    return commits_for_paths(file_changes(s, d), commits(s, d), table(s, d, "supplier").where("s_nationkey = 3").select(F.col("s_suppkey").alias("path")), 4)


def _against(s, d):
    chunks = table(s, d, "chunks").select(F.col("file_id").alias("path"), F.col("start_line").alias("line"), "id").where("path is not null and line is not null")
    return reconciled(chunks.where("id % 3 <> 0"), chunks.where("id % 4 <> 0"))


def _exports(s, d):
    i = F.col("id")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("impl", "function", "method", "struct")]), (i % 4 + 1).cast("int"))
    wide = F.when(i % 4 == 0, 900).otherwise(0)
    symbols = table(s, d, "chunks").where("symbol_path is not null").select(i.alias("symbol_id"), "file_id", F.col("symbol_path").alias("name"), kind.alias("kind"), (F.col("start_byte") - wide).alias("start_byte"), (F.col("end_byte") + wide).alias("end_byte")).distinct()
    return exported_surface(symbols, _files(s, d), symbols.where("symbol_id % 3 = 0").select("symbol_id"), 150)


QUERIES = {
    "impact_items": lambda s, d: surface(_lanes(s, d), 60),
    "impact_sections": lambda s, d: sections(_lanes(s, d), 20),
    "text_hits": _hits,
    "commits_for_paths": _paths,
    "graph_against_text": _against,
    "exported_surface": _exports,
}


def _sql() -> dict[str, str]:
    from quernel.operators.resolution import SQL_NAMED
    from quernel.sources.projections import SQL_CHANGES, SQL_COMMITS

    lane = f"""{SQL_NAMED}, v AS (SELECT * FROM allE WHERE NOT hidden), sp AS (SELECT s.*, n_name AS path FROM s JOIN nation ON n_nationkey = file_id), ts AS (SELECT * FROM v WHERE to_symbol_id = 7 OR target_qualified_name = 'm3::fn7'),
ln AS (SELECT path, qualified_name AS symbol, 0 AS k, 'exact_symbol_definition' AS reason, 'defined as ' || qualified_name AS evidence FROM sp WHERE symbol_id = 7
UNION ALL SELECT path, qualified_name, 1, 'direct_caller', ts.kind || ' edge ' || confidence FROM ts JOIN sp ON sp.symbol_id = from_symbol_id WHERE ts.kind IN ('calls_name', 'constructs', 'dispatches', 'uses_operator')
UNION ALL SELECT path, qualified_name, 2, 'direct_callee', v.kind || ' edge ' || confidence FROM v JOIN sp ON sp.symbol_id = to_symbol_id WHERE from_symbol_id = 7 AND v.kind IN ('calls_name', 'constructs', 'dispatches', 'uses_operator')
UNION ALL SELECT path, qualified_name, 3, 'import_export_dependent', ts.kind || ' edge ' || confidence FROM ts JOIN sp ON sp.symbol_id = from_symbol_id WHERE ts.kind IN ('imports', 'exports')
UNION ALL SELECT b.path, b.qualified_name, 4, 'same_file_symbol', 'same file' FROM sp a JOIN sp b ON a.path = b.path AND a.symbol_id = 7 AND b.symbol_id <> 7)"""
    files = "f AS (SELECT id AS file_id, path, kind, lower(trim(language, ' ')) AS language FROM (SELECT * FROM files QUALIFY row_number() OVER (PARTITION BY id ORDER BY indexed_at_ms DESC NULLS LAST, indexed_revision DESC NULLS LAST) = 1) WHERE kind <> 'deleted')"
    return {
        "impact_items": f"""{lane}, m AS (SELECT k, path, symbol, reason, string_agg(DISTINCT evidence, '; ' ORDER BY evidence) AS evidence FROM ln GROUP BY ALL), r AS (SELECT path, symbol, reason, evidence, CAST(row_number() OVER (ORDER BY k, path, symbol, reason) AS INTEGER) AS rank FROM m)
SELECT * FROM r WHERE rank <= 60 UNION ALL SELECT '', '', 'completeness', 'more impact items exist beyond the limit', rank FROM r WHERE rank = 61""",
        "impact_sections": f"{lane}, n AS (SELECT reason, count(*) AS n FROM (SELECT DISTINCT reason, path, symbol FROM ln) GROUP BY 1) SELECT reason, least(n, 20) AS n_shown, n >= 20 AS truncated FROM n",
        "text_hits": f"""WITH {files}, c AS (SELECT DISTINCT id, file_id, symbol_path FROM chunks), t AS (SELECT DISTINCT c.file_id FROM (SELECT chunk_id, decode(max(blob)) AS text FROM chunk_text GROUP BY 1) x JOIN c ON c.id = chunk_id
  WHERE contains(' ' || array_to_string(list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\p{{L}}\\p{{N}}_-]+'), lambda w: w <> ''), ' ') || ' ', ' shard ')),
n AS (SELECT file_id, max(symbol_path) AS symbol FROM c WHERE contains(lower(symbol_path), 'shard') GROUP BY 1), r AS (SELECT f.*, n.symbol, contains(lower(path), 'shard') AS p FROM f LEFT JOIN n USING (file_id) WHERE contains(lower(path), 'shard') OR n.symbol IS NOT NULL OR f.file_id IN (SELECT file_id FROM t)),
k AS (SELECT file_id, CASE WHEN p THEN 'path match' WHEN symbol IS NOT NULL THEN 'symbol match' ELSE 'chunk text match' END AS match, CASE WHEN NOT p THEN symbol END AS symbol, CAST(row_number() OVER (ORDER BY kind, path, file_id) AS INTEGER) AS rank FROM r) SELECT * FROM k WHERE rank <= 80""",
        "commits_for_paths": f"WITH commits AS ({SQL_COMMITS}), changes AS ({SQL_CHANGES}) SELECT path, hash, CAST(row_number() OVER (PARTITION BY path ORDER BY authored_at_s DESC, hash) AS INTEGER) AS rank FROM changes JOIN commits USING (hash) WHERE path IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 3) QUALIFY row_number() OVER (PARTITION BY path ORDER BY authored_at_s DESC, hash) <= 4",
        "graph_against_text": """WITH a AS (SELECT DISTINCT file_id AS path, start_line AS line FROM chunks WHERE id % 3 <> 0 AND file_id IS NOT NULL AND start_line IS NOT NULL), b AS (SELECT DISTINCT file_id AS path, start_line AS line FROM chunks WHERE id % 4 <> 0 AND file_id IS NOT NULL AND start_line IS NOT NULL)
SELECT coalesce(a.path, b.path) AS path, coalesce(a.line, b.line) AS line, CASE WHEN b.path IS NULL THEN 'graph_only' WHEN a.path IS NULL THEN 'text_only' ELSE 'matched' END AS found FROM a FULL JOIN b ON a.path = b.path AND a.line = b.line""",
        "exported_surface": f"""WITH {files}, s AS (SELECT DISTINCT id AS symbol_id, file_id, symbol_path AS name, CASE id % 4 WHEN 0 THEN 'impl' WHEN 1 THEN 'function' WHEN 2 THEN 'method' ELSE 'struct' END AS kind, start_byte - CASE WHEN id % 4 = 0 THEN 900 ELSE 0 END AS a, end_byte + CASE WHEN id % 4 = 0 THEN 900 ELSE 0 END AS b FROM chunks WHERE symbol_path IS NOT NULL),
x AS (SELECT path, f.kind AS fk, name, CASE WHEN s.kind = 'impl' THEN 'rust_exported_impl' ELSE 'rust_export' END AS reason FROM s JOIN f USING (file_id) WHERE symbol_id % 3 = 0 AND language = 'rust'
UNION SELECT path, f.kind, m.name, 'rust_impl_member' FROM s i JOIN f USING (file_id) JOIN s m ON m.file_id = i.file_id AND m.a > i.a AND m.b < i.b WHERE i.symbol_id % 3 = 0 AND i.kind = 'impl' AND m.kind IN ('function', 'method') AND language = 'rust'
UNION SELECT path, f.kind, name, 'generated_binding_artifact' FROM s JOIN f USING (file_id) WHERE contains(path, '/generated/') OR path LIKE '%generated-manifest.json'),
k AS (SELECT path, name AS symbol, reason, CAST(row_number() OVER (ORDER BY reason, fk DESC, path, name) AS INTEGER) AS rank FROM x) SELECT * FROM k WHERE rank <= 150""",
    }


SQL = _sql()

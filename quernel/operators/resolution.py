"""Graph questions by name: which edges a symbol's name admits, how sure each match is, and what stays hidden.

Edges (edge_id, from_symbol_id, to_symbol_id, from_name, to_name, target_qualified_name, kind, confidence, hidden,
source_file_id) may be unresolved (to_symbol_id null). Symbols (symbol_id, name, qualified_name, file_id). A seed is a
name, qualified by ``::`` or not, with an optional symbol id and an optional table of the members (symbol_id) of its logical group.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.functions.exprs import lookup
from quernel.plans.ranks import top_ranked
from quernel.sources.projections import SQL_EDGES, edges
from quernel.sources.tables import table

#: Kinds of edges that a traversal takes by default (fixed values).
CALL_KINDS = ("calls_name", "constructs", "dispatches", "uses_operator")
#: Names so common that an unresolved call of them says nothing (fixed values).
COMMON_METHODS = (
    "clone", "map", "map_err", "and_then", "unwrap_or", "unwrap_or_else", "to_string", "to_owned", "as_ref", "as_mut", "get", "insert",
    "new", "default", "into", "from", "iter", "collect", "unwrap", "expect", "ok", "err",
)
#: Rank of confidence, and of symbol kinds in a lookup; other kinds come last (fixed values).
CONFIDENCE_RANK = {"Exact": 0.0, "Syntactic": 1.0, "NameOnly": 2.0}
SYMBOL_KIND_RANK = {
    "struct": 0, "class": 0, "object": 0, "actor": 0, "union": 0, "enum": 1, "trait": 1, "interface": 1, "protocol": 1, "type": 1,
    "function": 2, "method": 2, "constructor": 2, "macro": 2, "operator": 2,
    "const": 3, "var": 3, "property": 3, "static": 3, "enum_case": 3, "precedence_group": 3, "module": 4, "namespace": 4, "impl": 8,
}
EXACT, SYNTACTIC, FUZZY = "exact", "syntactic", "fuzzy"
NAMED = {"exact": "Exact", "syntactic": "Syntactic", "name_only": "NameOnly", "ambiguous": "Ambiguous"}


@dataclass(frozen=True)
class Seed:
    """What is asked about, and how: ``mode`` exact, syntactic or fuzzy."""

    symbol: str
    mode: str = SYNTACTIC
    symbol_id: int | None = None
    members: DataFrame | None = None
    kinds: tuple[str, ...] = CALL_KINDS
    include_macros: bool = False
    include_unresolved: bool = False
    include_common: bool = False
    #: Edges that a compiler verdict leads to the seed (edge_id).
    verified: DataFrame | None = None
    flags: dict = field(default_factory=dict)

    @property
    def short(self) -> str:
        return self.symbol.rsplit("::", 1)[-1]

    @property
    def by_name(self) -> bool:
        return self.mode == FUZZY or "::" not in self.symbol


def visible(edge_table: DataFrame) -> DataFrame:
    """Edges that aren't hidden (internal facts, suppressed candidates)."""
    return edge_table.where(F.coalesce(F.col("hidden"), F.lit(0)) == 0)


def decoded(rows: DataFrame, names: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with each ``<column>_id`` replaced by its name from ``names`` (id, value); unknown and null ids give null.

    Parquet's dictionary pages do what a table of interned strings does, so this only serves stores that have one.
    """
    for c in columns:
        rows = rows.join(names.select(F.col("id").alias(f"{c}_id"), F.col("value").alias(c)), f"{c}_id", "left").drop(f"{c}_id")
    return rows


def with_targets(edge_table: DataFrame, symbols: DataFrame, seed: Seed) -> DataFrame:
    """Edges with what their predicates ask: the names of both resolved ends, membership in the seed, compiler verdicts."""
    end = lambda x: symbols.select(F.col("symbol_id").alias(f"{x}_symbol_id"), F.col("name").alias(f"{x}_own"), F.col("qualified_name").alias(f"{x}_qn"))
    rows = edge_table.where(F.col("kind").isin(*seed.kinds)).join(end("to"), "to_symbol_id", "left").join(end("from"), "from_symbol_id", "left")
    for x in ("to", "from"):
        if seed.members is not None:
            mine = seed.members.select(F.col("symbol_id").alias(f"{x}_symbol_id")).distinct().withColumn(f"{x}_member", F.lit(True))
            rows = rows.join(mine, f"{x}_symbol_id", "left")
    if seed.verified is not None:
        rows = rows.join(seed.verified.select("edge_id").distinct().withColumn("compiled", F.lit(True)), "edge_id", "left")
    else:
        rows = rows.withColumn("compiled", F.lit(None).cast("boolean"))
    return rows


def unique_name(symbols: DataFrame, name: str) -> bool:
    """Whether exactly one symbol has the bare name."""
    return len(symbols.where(F.col("name") == name).limit(2).collect()) == 1


def _like(column: str, seed: Seed) -> Column:
    from quernel.functions.exprs import ascii_lower

    low = seed.symbol.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return ascii_lower(F.col(column)).endswith("::" + low)


def _any(*conditions: Column) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | F.coalesce(c, F.lit(False))
    return out


def reverse_predicate(seed: Seed, unique: bool) -> Column:
    """Edges that may lead to the seed.

    Exact: resolved to it. Syntactic: also by its qualified name, and a bare name that only one symbol has. Fuzzy: any equal
    name, qualified names that end on it, unresolved bare names. A compiler verdict admits an edge unless the mode is exact.
    """
    own = F.col("to_symbol_id") == F.lit(-1 if seed.symbol_id is None else seed.symbol_id)
    qualified, target = F.col("to_qn") == seed.symbol, F.col("target_qualified_name") == seed.symbol
    names = (F.col("to_own") == seed.short, qualified, _like("to_qn", seed), target, _like("target_qualified_name", seed), F.lit(seed.by_name) & (F.col("to_name") == seed.short))
    compiled = F.col("compiled")
    if seed.members is not None:
        member = F.col("to_member")
        if seed.mode == EXACT:
            return _any(member)
        if seed.mode == SYNTACTIC:
            return _any(member, F.col("to_symbol_id").isNull() & target, compiled)
        return _any(member, *names, compiled)
    if seed.mode == EXACT:
        return _any(own, qualified)
    if seed.mode == SYNTACTIC:
        return _any(own, qualified, F.lit(unique) & (F.col("to_own") == seed.short), target, compiled)
    return _any(*names, compiled)


def reverse_tier(seed: Seed) -> Column:
    """0 resolved, 1 by qualified name, 2 by bare name (fuzzy), a compiler verdict 0 where nothing else holds, else 4."""
    if seed.mode == EXACT:
        return F.lit(0)
    target = F.col("target_qualified_name") == seed.symbol
    tier = F.when(F.col("to_symbol_id").isNotNull(), 0)
    if seed.mode == FUZZY:
        tier = tier.when(_any(target, _like("target_qualified_name", seed)), 1).when(_any(F.lit(seed.by_name) & (F.col("to_name") == seed.short)), 2)
    else:
        tier = tier.when(_any(target), 1)
    return tier.when(_any(F.col("compiled")), 0).otherwise(4)


def forward_source(seed: Seed, unique: bool) -> Column:
    """Edges that start at the seed, by the same modes."""
    own = F.col("from_symbol_id") == F.lit(-1 if seed.symbol_id is None else seed.symbol_id)
    qualified, name = F.col("from_qn") == seed.symbol, F.col("from_name") == seed.symbol
    fuzzy = (F.col("from_own") == seed.short, qualified, _like("from_qn", seed), name, _like("from_name", seed))
    if seed.members is not None:
        member = F.col("from_member")
        return _any(member) if seed.mode == EXACT else _any(member, F.col("from_symbol_id").isNull() & name) if seed.mode == SYNTACTIC else _any(member, *fuzzy)
    if seed.mode == EXACT:
        return _any(own, qualified)
    if seed.mode == SYNTACTIC:
        return _any(own, qualified, F.lit(unique) & (F.col("from_own") == seed.short), name)
    return _any(*fuzzy)


def forward_filter(seed: Seed) -> Column:
    """Targets worth showing: resolved ones or with a qualified name, no macros, no common method names, unless asked for."""
    kind, resolved, qualified = F.col("kind"), F.col("to_symbol_id").isNotNull(), F.col("target_qualified_name").isNotNull()
    out = F.lit(True)
    if seed.mode == EXACT:
        out = resolved
    elif seed.mode == SYNTACTIC and not seed.include_unresolved:
        out = resolved | qualified | (F.lit(seed.include_macros) & (kind == "uses_macro"))
    if not seed.include_macros:
        out = out & (kind != "uses_macro")
    if not seed.include_unresolved:
        sure = (kind == "calls_name") & (resolved | ((F.col("confidence") == "Syntactic") & qualified))
        out = out & (sure | (kind.isin("constructs", "uses_operator") & resolved) | ~kind.isin("calls_name", "constructs", "uses_operator"))
    if not seed.include_common:
        out = out & ((kind != "calls_name") | ~F.col("to_name").isin(*COMMON_METHODS) | resolved)
    return F.coalesce(out, F.lit(False))


def hops(edge_table: DataFrame, symbols: DataFrame, seed: Seed, callers: bool, limit: int) -> DataFrame:
    """(edge_id, from_name, to_name, kind, confidence, match_tier, rank): the best ``limit`` callers or callees, each callsite once.

    Order: tier (callers), confidence, kind, name of the far end, edge id.
    """
    unique = unique_name(symbols, seed.short)
    rows = with_targets(edge_table, symbols, seed)
    rows = rows.where(reverse_predicate(seed, unique)) if callers else rows.where(forward_source(seed, unique) & forward_filter(seed))
    rows = rows.withColumn("match_tier", reverse_tier(seed) if callers else F.lit(0))
    best = top_ranked(rows, limit, "match_tier", lookup(F.col("confidence"), CONFIDENCE_RANK, 3.0), "kind", "from_name" if callers else "to_name", "edge_id")
    return best.select("edge_id", "from_name", "to_name", "kind", "confidence", "match_tier", "rank")


def effective_rank(confidence) -> Column:
    """0 for a compiler verdict, then the confidence ladder from 1, 5 for others."""
    return F.when(confidence == "compiler", 0).when(confidence == "exact", 1).when(confidence == "syntactic", 2).when(confidence == "name_only", 3).when(confidence == "ambiguous", 4).otherwise(5)


def overfetch(limit: int) -> int:
    """Hops to fetch before compiler verdicts re-rank them."""
    return max(limit, min(max(4 * limit, 200), 5_000))


def enriched_hops(found: DataFrame, verdicts: DataFrame, limit: int) -> DataFrame:
    """The best ``limit`` of ``found`` hops after current compiler ``verdicts`` (edge_id, verdict: confirm, upgrade or contradict).

    A confirmed or upgraded hop counts as compiler-verified and comes first; a contradicted one drops out.
    """
    said = verdicts.groupBy("edge_id").agg(F.max("verdict").alias("verdict"))
    rows = found.drop("rank").join(said, "edge_id", "left").where(~F.col("verdict").eqNullSafe("contradict"))
    shown = F.lit("ambiguous")
    for name, stored in NAMED.items():
        shown = F.when(F.col("confidence") == stored, name).otherwise(shown)
    rows = rows.withColumn("shown_confidence", F.when(F.col("verdict").isin("confirm", "upgrade"), "compiler").otherwise(shown))
    best = top_ranked(rows, limit, effective_rank(F.col("shown_confidence")), "match_tier", "kind", "edge_id")
    return best.select("edge_id", "kind", "shown_confidence", "rank")


def summary(edge_table: DataFrame, symbols: DataFrame, seed: Seed, callers: bool, limit: int) -> DataFrame:
    """One row: edges that match, by confidence, unresolved and hidden candidates, whether ``limit`` truncates, and two risks.

    Hidden: unresolved edges that the predicate or the filter leaves out although they name the seed (callers) or start at it.
    """
    unique = unique_name(symbols, seed.short)
    rows = with_targets(edge_table, symbols, seed)
    unresolved = F.col("to_symbol_id").isNull()
    if callers:
        shown = reverse_predicate(seed, unique)
        alone = symbols.where((F.col("name") == seed.short) & (F.col("qualified_name") != seed.symbol) & (F.col("symbol_id") != (-1 if seed.symbol_id is None else seed.symbol_id))).isEmpty()
        hidden = unresolved & ~shown & _any(F.col("target_qualified_name") == seed.symbol, _like("target_qualified_name", seed), F.lit(alone) & (F.col("to_name") == seed.short))
    else:
        source = forward_source(seed, unique)
        shown = source & forward_filter(seed)
        hidden = source & unresolved & ~forward_filter(seed)
    compiler = F.coalesce(F.col("compiled"), F.lit(False)) & unresolved if callers else F.lit(False)
    n = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("bigint")), F.lit(0))
    counts = rows.agg(
        n(shown).alias("matching"), n(hidden).alias("n_hidden"), n(shown & ~compiler & (F.col("confidence") == "Exact")).alias("exact_verified"), n(shown & ~compiler & (F.col("confidence") == "Syntactic")).alias("syntactic"),
        n(shown & ~compiler & (F.col("confidence") == "NameOnly")).alias("name_only"), n(shown & ~compiler & (F.col("confidence") == "Ambiguous")).alias("ambiguous"),
        n(shown & ~compiler & unresolved).alias("open"), n(shown & compiler).alias("compiler_verified"),
    )
    c = F.col
    counts = counts.select("*", (c("matching") + c("n_hidden")).alias("total"), (c("open") + c("n_hidden")).alias("unresolved")).withColumn("truncated", c("total") > limit)
    false_positive = F.when((c("ambiguous") > 0) | F.lit(seed.mode == FUZZY), "high").when((c("name_only") > 0) | (c("unresolved") > 0) | (F.lit(seed.mode == SYNTACTIC) & (c("exact_verified") + c("compiler_verified") < c("total"))), "medium").otherwise("low")
    completeness = F.when(c("truncated") | (c("unresolved") > c("exact_verified") + c("syntactic")), "high").when((c("unresolved") > 0) | (c("name_only") > 0) | (c("ambiguous") > 0), "medium").otherwise("low")
    if callers:  # no static caller found never means that there is none
        completeness = F.when((c("total") == 0) & (completeness == "low"), "medium").otherwise(completeness)
    return counts.select("total", "exact_verified", "syntactic", "name_only", "ambiguous", "unresolved", "compiler_verified", "truncated", false_positive.alias("false_positive_risk"), completeness.alias("completeness_risk"))


def coverage(files: DataFrame, failures: DataFrame, paths: DataFrame, now: DataFrame) -> DataFrame:
    """(path, language, parser_status, graph_status, last_indexed_revision) of every asked path.

    ``files``: path, language, sha256, indexed_revision; ``failures``: path; ``now``: path, sha256 on disk. A path without a row in
    the index is ``missing_from_index``; another hash on disk makes it ``stale_source``, before a parser failure.
    """
    own = files.groupBy("path").agg(F.max(F.struct("indexed_revision", "language", "sha256")).alias("f"))
    rows = paths.select("path").distinct().join(own, "path", "left").join(failures.select("path").distinct().withColumn("failed", F.lit(True)), "path", "left")
    rows = rows.join(now.groupBy("path").agg(F.max("sha256").alias("now")), "path", "left")
    known, stale = F.col("f").isNotNull(), ~F.col("now").eqNullSafe(F.col("f.sha256"))
    failed = F.coalesce("failed", F.lit(False))
    return rows.select(
        "path", F.when(known, F.col("f.language")).otherwise("unknown").alias("language"), F.when(~known, "missing_from_index").when(failed, "failed").otherwise("ok").alias("parser_status"),
        F.when(~known, "missing_from_index").when(stale, "stale_source").when(failed, "parser_failed").otherwise("ok").alias("graph_status"), F.when(F.col("f.indexed_revision") != "", F.col("f.indexed_revision")).alias("last_indexed_revision"),
    )


def lookup_symbol(symbols: DataFrame, files: DataFrame, name: str, limit: int, language: str | None = None, generated: bool = False) -> DataFrame:
    """(symbol_id, name, kind, path, rank): symbols of that name, or whose qualified name contains it (case of A to Z aside).

    Order: the exact name first, kind, path, first byte, id.
    """
    from quernel.functions.exprs import ascii_lower

    rows = symbols.join(files.select("file_id", "path", "language", "generated"), "file_id")
    low = name.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    rows = rows.where((F.col("name") == name) | ascii_lower(F.col("qualified_name")).contains(low))
    if not generated:
        rows = rows.where(F.col("generated") == 0)
    if language is not None:
        rows = rows.where(F.col("language") == language)
    ranked = top_ranked(rows, limit, (F.col("name") != name).cast("int"), lookup(F.col("kind"), {k: float(v) for k, v in SYMBOL_KIND_RANK.items()}, 9.0), "path", "start_byte", "symbol_id")
    return ranked.select("symbol_id", "name", "kind", "path", "rank")


def probe(rows: DataFrame, limit: int, *order) -> tuple[DataFrame, bool]:
    """The first ``limit`` rows and whether there are more, asked with one row beyond the limit."""
    more = len(rows.orderBy(*order).limit(limit + 1).select(F.lit(1)).collect()) > limit
    return rows.orderBy(*order).limit(limit), more


# -- the given tables as named symbols and edges
def named_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    name = F.concat(F.lit("fn"), (F.col("s_suppkey") % 40).cast("string"))
    kind = F.when(F.col("s_suppkey") % 3 == 0, "struct").when(F.col("s_suppkey") % 3 == 1, "function").otherwise("impl")
    return s.select(F.col("s_suppkey").alias("symbol_id"), name.alias("name"), F.concat(F.lit("m"), F.col("s_nationkey").cast("string"), F.lit("::"), name).alias("qualified_name"), F.col("s_nationkey").alias("file_id"), kind.alias("kind"), (F.col("s_suppkey") * 7 % 1000).alias("start_byte"))


def named_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct edge once; two thirds resolved, half of the rest with a qualified target, one in eleven hidden."""
    e = edges(spark, sf_dir).select("src", "dst", "kind", "confidence").distinct()
    own = named_symbols(spark, sf_dir)
    end = lambda x, y: own.select(F.col("symbol_id").alias(x), F.col("name").alias(f"{y}_name"), F.col("qualified_name").alias(f"{y}_q"), F.col("file_id").alias(f"{y}_file"))
    rows = e.join(end("src", "from"), "src").join(end("dst", "to"), "dst")
    total = F.col("src") + F.col("dst")
    kind = F.when(total % 7 == 0, "uses_macro").when(total % 7 == 1, "constructs").otherwise(F.col("kind"))
    confidence = F.when((F.col("src") + 2 * F.col("dst")) % 5 == 0, "Syntactic").when((F.col("src") + 2 * F.col("dst")) % 5 == 1, "Ambiguous").otherwise(F.col("confidence"))
    edge_id = (F.col("src") * 100_000 + F.col("dst")) * 8 + F.when(F.col("kind") == "calls_name", 0).when(F.col("kind") == "imports", 1).otherwise(2) * 2 + (F.col("confidence") == "Exact").cast("int")
    return rows.select(
        edge_id.alias("edge_id"), F.col("src").alias("from_symbol_id"), F.when(total % 3 != 0, F.col("dst")).alias("to_symbol_id"), "from_name", F.when(F.col("dst") % 13 == 0, "get").otherwise(F.col("to_name")).alias("to_name"),
        F.when(F.col("dst") % 2 == 0, F.col("to_q")).when(F.col("dst") % 5 == 0, F.concat(F.lit("crate::"), "to_q")).alias("target_qualified_name"), kind.alias("kind"), confidence.alias("confidence"),
        ((F.col("src") * 7 + F.col("dst")) % 11 == 0).cast("int").alias("hidden"), F.col("from_file").alias("source_file_id"),
    )


KINDS = ("calls_name", "constructs", "references_type", "uses_macro")
ASKED = {
    "exact": Seed("m3::fn7", EXACT, 7, kinds=KINDS), "syntactic": Seed("fn7", SYNTACTIC, 7, kinds=KINDS), "fuzzy": Seed("fn7", FUZZY, 7, kinds=KINDS, include_macros=True, include_unresolved=True, include_common=True),
}


def _two(s, d):
    return visible(named_edges(s, d)), named_symbols(s, d)


def _logical(s, d) -> Seed:
    own = named_symbols(s, d)
    return replace(ASKED["syntactic"], symbol="m3::fn7", members=own.where("name = 'fn7'"), verified=named_edges(s, d).where("from_symbol_id % 9 = 0 and to_name = 'fn7'"))


def _files(s, d):
    from quernel.operators.index import latest

    return latest(table(s, d, "files"), ["id"], ["indexed_at_ms", "indexed_revision"])


def _coverage(s, d):
    files = _files(s, d)
    base = files.select("path", "language", "sha256", F.coalesce("indexed_revision", F.lit("")).alias("indexed_revision"))
    asked = table(s, d, "files").select("path").distinct().unionByName(files.where("id % 10 = 0").select(F.concat("path", F.lit(".gone")).alias("path")))
    now = files.select("path", F.when(F.col("id") % 6 == 0, F.lit("other")).otherwise(F.col("sha256")).alias("sha256"))
    return coverage(base, files.where("id % 8 = 0").select("path"), asked, now)


def _enriched(s, d):
    found = hops(*_two(s, d), ASKED["fuzzy"], True, overfetch(20))
    verdicts = named_edges(s, d).select("edge_id", F.when(F.col("edge_id") % 3 == 0, "confirm").when(F.col("edge_id") % 3 == 1, "contradict").otherwise("none").alias("verdict"))
    return enriched_hops(found, verdicts, 20)


def _lookup(s, d):
    files = table(s, d, "nation").select(F.col("n_nationkey").alias("file_id"), F.col("n_name").alias("path"), F.lit("rust").alias("language"), (F.col("n_nationkey") % 6 == 0).cast("int").alias("generated"))
    return lookup_symbol(named_symbols(s, d), files, "fn7", 25)


QUERIES = {
    **{f"callers_{m}": (lambda s, d, q=q: hops(*_two(s, d), q, True, 50)) for m, q in ASKED.items()},
    **{f"callees_{m}": (lambda s, d, q=q: hops(*_two(s, d), q, False, 50)) for m, q in ASKED.items()},
    **{f"callers_{m}_summary": (lambda s, d, q=q: summary(*_two(s, d), q, True, 50)) for m, q in ASKED.items()},
    **{f"callees_{m}_summary": (lambda s, d, q=q: summary(*_two(s, d), q, False, 50)) for m, q in ASKED.items()},
    "callers_logical": lambda s, d: hops(*_two(s, d), _logical(s, d), True, 200),
    "callers_logical_summary": lambda s, d: summary(*_two(s, d), _logical(s, d), True, 200),
    "callers_enriched": _enriched,
    "graph_coverage": _coverage,
    "symbol_lookup": _lookup,
    "visible_edges": lambda s, d: visible(named_edges(s, d)).groupBy("kind", "confidence").agg(F.count(F.lit(1)).alias("n")),
}
SQL_NAMED = f"""WITH e0 AS (SELECT DISTINCT src, dst, kind, confidence FROM ({SQL_EDGES})),
s AS (SELECT s_suppkey AS symbol_id, 'fn' || (s_suppkey % 40) AS name, 'm' || s_nationkey || '::fn' || (s_suppkey % 40) AS qualified_name, s_nationkey AS file_id, CASE s_suppkey % 3 WHEN 0 THEN 'struct' WHEN 1 THEN 'function' ELSE 'impl' END AS kind, s_suppkey * 7 % 1000 AS start_byte FROM supplier),
allE AS (SELECT (src * 100000 + dst) * 8 + CASE e0.kind WHEN 'calls_name' THEN 0 WHEN 'imports' THEN 1 ELSE 2 END * 2 + CASE confidence WHEN 'Exact' THEN 1 ELSE 0 END AS edge_id, src AS from_symbol_id, CASE WHEN (src + dst) % 3 <> 0 THEN dst END AS to_symbol_id,
  f.name AS from_name, CASE WHEN dst % 13 = 0 THEN 'get' ELSE t.name END AS to_name, CASE WHEN dst % 2 = 0 THEN t.qualified_name WHEN dst % 5 = 0 THEN 'crate::' || t.qualified_name END AS target_qualified_name,
  CASE (src + dst) % 7 WHEN 0 THEN 'uses_macro' WHEN 1 THEN 'constructs' ELSE e0.kind END AS kind, CASE (src + 2 * dst) % 5 WHEN 0 THEN 'Syntactic' WHEN 1 THEN 'Ambiguous' ELSE confidence END AS confidence, (src * 7 + dst) % 11 = 0 AS hidden
  FROM e0 JOIN s f ON f.symbol_id = src JOIN s t ON t.symbol_id = dst),
x AS (SELECT a.*, t.name AS to_own, t.qualified_name AS to_qn, f.name AS from_own, f.qualified_name AS from_qn, EXISTS (SELECT 1 FROM s WHERE s.name = 'fn7' AND s.symbol_id = a.to_symbol_id) AS member, (a.from_symbol_id % 9 = 0 AND a.to_name = 'fn7') AS compiled
  FROM allE a LEFT JOIN s t ON t.symbol_id = to_symbol_id LEFT JOIN s f ON f.symbol_id = from_symbol_id WHERE NOT hidden AND a.kind IN ('calls_name', 'constructs', 'references_type', 'uses_macro'))"""
_ONE = "((SELECT count(*) FROM s WHERE name = 'fn7') = 1)"
_NAMES = "to_own = 'fn7' OR to_qn = 'fn7' OR to_qn LIKE '%::fn7' OR target_qualified_name = 'fn7' OR target_qualified_name LIKE '%::fn7' OR to_name = 'fn7'"
_REV = {
    "exact": ("to_symbol_id = 7 OR to_qn = 'm3::fn7'", "0", "m3::fn7"),
    "syntactic": (f"to_symbol_id = 7 OR to_qn = 'fn7' OR ({_ONE} AND to_own = 'fn7') OR target_qualified_name = 'fn7'", "CASE WHEN to_symbol_id IS NOT NULL THEN 0 WHEN target_qualified_name = 'fn7' THEN 1 ELSE 4 END", "fn7"),
    "fuzzy": (_NAMES, "CASE WHEN to_symbol_id IS NOT NULL THEN 0 WHEN target_qualified_name = 'fn7' OR target_qualified_name LIKE '%::fn7' THEN 1 WHEN to_name = 'fn7' THEN 2 ELSE 4 END", "fn7"),
    "logical": ("member OR (to_symbol_id IS NULL AND target_qualified_name = 'm3::fn7') OR compiled", "CASE WHEN to_symbol_id IS NOT NULL THEN 0 WHEN target_qualified_name = 'm3::fn7' THEN 1 WHEN compiled THEN 0 ELSE 4 END", "m3::fn7"),
}
_SURE = "((kind = 'calls_name' AND (to_symbol_id IS NOT NULL OR (confidence = 'Syntactic' AND target_qualified_name IS NOT NULL))) OR (kind IN ('constructs', 'uses_operator') AND to_symbol_id IS NOT NULL) OR kind NOT IN ('calls_name', 'constructs', 'uses_operator'))"
_PLAIN = "(kind <> 'calls_name' OR to_name NOT IN ('clone', 'map', 'map_err', 'and_then', 'unwrap_or', 'unwrap_or_else', 'to_string', 'to_owned', 'as_ref', 'as_mut', 'get', 'insert', 'new', 'default', 'into', 'from', 'iter', 'collect', 'unwrap', 'expect', 'ok', 'err') OR to_symbol_id IS NOT NULL)"
_FWD = {
    "exact": ("from_symbol_id = 7 OR from_qn = 'm3::fn7'", f"to_symbol_id IS NOT NULL AND kind <> 'uses_macro' AND {_SURE} AND {_PLAIN}"),
    "syntactic": (f"from_symbol_id = 7 OR from_qn = 'fn7' OR ({_ONE} AND from_own = 'fn7') OR from_name = 'fn7'", f"(to_symbol_id IS NOT NULL OR target_qualified_name IS NOT NULL) AND kind <> 'uses_macro' AND {_SURE} AND {_PLAIN}"),
    "fuzzy": ("from_own = 'fn7' OR from_qn = 'fn7' OR from_qn LIKE '%::fn7' OR from_name = 'fn7' OR from_name LIKE '%::fn7'", "true"),
}
_CONF = "CASE confidence WHEN 'Exact' THEN 0 WHEN 'Syntactic' THEN 1 WHEN 'NameOnly' THEN 2 ELSE 3 END"


def _hops_sql(where: str, tier: str, name: str, limit: int) -> str:
    return f"{SQL_NAMED}, y AS (SELECT edge_id, from_name, to_name, kind, confidence, {tier} AS match_tier FROM x WHERE {where}), z AS (SELECT *, CAST(row_number() OVER (ORDER BY match_tier, {_CONF}, kind, {name}, edge_id) AS INTEGER) AS rank FROM y) SELECT * FROM z WHERE rank <= {limit}"


def _summary_sql(shown: str, hidden: str, mode: str, callers: bool, limit: int, compiled: str = "false") -> str:
    lone = "WHEN total = 0 AND NOT (truncated OR unresolved > exact_verified + syntactic OR unresolved > 0 OR name_only > 0 OR ambiguous > 0) THEN 'medium'" if callers else ""
    return f"""{SQL_NAMED}, y AS (SELECT *, coalesce({shown}, false) AS shown, to_symbol_id IS NULL AS un, coalesce({compiled}, false) AND to_symbol_id IS NULL AS co FROM x),
k AS (SELECT count(*) FILTER (shown) AS m, count(*) FILTER (coalesce({hidden}, false)) AS h, count(*) FILTER (shown AND NOT co AND confidence = 'Exact') AS exact_verified, count(*) FILTER (shown AND NOT co AND confidence = 'Syntactic') AS syntactic,
  count(*) FILTER (shown AND NOT co AND confidence = 'NameOnly') AS name_only, count(*) FILTER (shown AND NOT co AND confidence = 'Ambiguous') AS ambiguous, count(*) FILTER (shown AND NOT co AND un) AS o, count(*) FILTER (shown AND co) AS compiler_verified FROM y),
g AS (SELECT m + h AS total, exact_verified, syntactic, name_only, ambiguous, o + h AS unresolved, compiler_verified, m + h > {limit} AS truncated FROM k)
SELECT *, CASE WHEN ambiguous > 0 OR {str(mode == "fuzzy").lower()} THEN 'high' WHEN name_only > 0 OR unresolved > 0 OR ({str(mode in ("syntactic", "logical")).lower()} AND exact_verified + compiler_verified < total) THEN 'medium' ELSE 'low' END AS false_positive_risk,
  CASE {lone} WHEN truncated OR unresolved > exact_verified + syntactic THEN 'high' WHEN unresolved > 0 OR name_only > 0 OR ambiguous > 0 THEN 'medium' ELSE 'low' END AS completeness_risk FROM g"""


def _hidden(mode: str) -> str:
    name = _REV[mode][2]
    others = f"(SELECT count(*) FROM s WHERE name = 'fn7' AND qualified_name <> '{name}' AND symbol_id <> 7) = 0"
    return f"un AND NOT shown AND (target_qualified_name = '{name}' OR target_qualified_name LIKE '%::{name}' OR ({others} AND to_name = 'fn7'))"


SQL = {
    **{f"callers_{m}": _hops_sql(_REV[m][0], _REV[m][1], "from_name", 50) for m in ASKED},
    **{f"callees_{m}": _hops_sql(f"({_FWD[m][0]}) AND ({_FWD[m][1]})", "0", "to_name", 50) for m in ASKED},
    **{f"callers_{m}_summary": _summary_sql(_REV[m][0], _hidden(m), m, True, 50) for m in ASKED},
    **{f"callees_{m}_summary": _summary_sql(f"({_FWD[m][0]}) AND ({_FWD[m][1]})", f"({_FWD[m][0]}) AND un AND NOT coalesce({_FWD[m][1]}, false)", m, False, 50) for m in ASKED},
    "callers_logical": _hops_sql(_REV["logical"][0], _REV["logical"][1], "from_name", 200),
    "callers_logical_summary": _summary_sql(_REV["logical"][0], _hidden("logical"), "logical", True, 200, "compiled"),
    "callers_enriched": f"""{SQL_NAMED}, y AS (SELECT *, {_REV["fuzzy"][1]} AS t FROM x WHERE {_REV["fuzzy"][0]}), z AS (SELECT *, row_number() OVER (ORDER BY t, {_CONF}, kind, from_name, edge_id) AS r FROM y),
w AS (SELECT edge_id, kind, t, CASE WHEN edge_id % 3 = 0 THEN 'compiler' WHEN confidence = 'Exact' THEN 'exact' WHEN confidence = 'Syntactic' THEN 'syntactic' WHEN confidence = 'NameOnly' THEN 'name_only' ELSE 'ambiguous' END AS shown_confidence FROM z WHERE r <= 200 AND edge_id % 3 <> 1),
v AS (SELECT edge_id, kind, shown_confidence, CAST(row_number() OVER (ORDER BY CASE shown_confidence WHEN 'compiler' THEN 0 WHEN 'exact' THEN 1 WHEN 'syntactic' THEN 2 WHEN 'name_only' THEN 3 ELSE 4 END, t, kind, edge_id) AS INTEGER) AS rank FROM w) SELECT * FROM v WHERE rank <= 20""",
    "graph_coverage": """WITH f AS (SELECT * FROM files QUALIFY row_number() OVER (PARTITION BY id ORDER BY indexed_at_ms DESC NULLS LAST, indexed_revision DESC NULLS LAST) = 1),
b AS (SELECT path, coalesce(indexed_revision, '') AS indexed_revision, language, sha256 FROM f QUALIFY row_number() OVER (PARTITION BY path ORDER BY coalesce(indexed_revision, '') DESC, language DESC NULLS LAST, sha256 DESC NULLS LAST) = 1),
a AS (SELECT path FROM files UNION SELECT path || '.gone' FROM f WHERE id % 10 = 0), n AS (SELECT path, max(CASE WHEN id % 6 = 0 THEN 'other' ELSE sha256 END) AS now FROM f GROUP BY path), p AS (SELECT DISTINCT path FROM f WHERE id % 8 = 0)
SELECT a.path, CASE WHEN b.path IS NULL THEN 'unknown' ELSE language END AS language, CASE WHEN b.path IS NULL THEN 'missing_from_index' WHEN p.path IS NOT NULL THEN 'failed' ELSE 'ok' END AS parser_status,
  CASE WHEN b.path IS NULL THEN 'missing_from_index' WHEN now IS DISTINCT FROM sha256 THEN 'stale_source' WHEN p.path IS NOT NULL THEN 'parser_failed' ELSE 'ok' END AS graph_status, nullif(indexed_revision, '') AS last_indexed_revision
FROM a LEFT JOIN b ON b.path = a.path LEFT JOIN n ON n.path = a.path LEFT JOIN p ON p.path = a.path""",
    "symbol_lookup": f"""{SQL_NAMED}, l AS (SELECT symbol_id, name, kind, n_name AS path, CAST(row_number() OVER (ORDER BY CASE WHEN name = 'fn7' THEN 0 ELSE 1 END, CASE kind WHEN 'struct' THEN 0 WHEN 'function' THEN 2 WHEN 'impl' THEN 8 ELSE 9 END, n_name, start_byte, symbol_id) AS INTEGER) AS rank
FROM s JOIN nation ON n_nationkey = file_id WHERE n_nationkey % 6 <> 0 AND (name = 'fn7' OR contains(lower(qualified_name), 'fn7'))) SELECT * FROM l WHERE rank <= 25""",
    "visible_edges": f"{SQL_NAMED} SELECT kind, confidence, count(*) AS n FROM allE WHERE NOT hidden GROUP BY ALL",
}

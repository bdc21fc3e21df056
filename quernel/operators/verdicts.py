"""Compiler verdicts on graph edges: which occurrence a call site stands in, what the compiler says of it, and what that adds up to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernel.operators.evidence import ratio
from quernel.operators.index import latest
from quernel.plans.cluster import spill_table
from quernel.plans.intervals import contained
from quernel.plans.ranks import top_ranked
from quernel.sources.tables import table

LOW = ("NameOnly", "Ambiguous")
SITES = 25


def containing(tokens: DataFrame, occurrences: DataFrame) -> DataFrame:
    """(edge_id, symbol, start_byte, end_byte): the occurrence of each token (edge_id, path, token_start, token_end).

    It holds the whole token; a module's only counts where it bounds the token exactly. References come before definitions, then the
    shortest (ties: first byte, symbol). See ``plans.intervals`` for how they meet.
    """
    asked = tokens.select("edge_id", "path", F.col("token_start").alias("a"), F.col("token_end").alias("b"))
    held = contained(asked, occurrences.withColumn("lo", F.col("start_byte")).withColumn("hi", F.col("end_byte")), "path")
    held = held.where(((F.col("lo") == F.col("a")) & (F.col("hi") == F.col("b"))) | ~F.col("is_module"))
    order = F.struct(F.col("is_definition").cast("int"), F.col("end_byte") - F.col("start_byte"), F.col("start_byte"), F.col("symbol"))
    best = held.groupBy("edge_id").agg(F.min_by(F.struct("symbol", "start_byte", "end_byte"), order).alias("o"))
    return best.select("edge_id", "o.symbol", "o.start_byte", "o.end_byte")


def agrees(own: Column, own_group: Column, other: Column, other_group: Column) -> Column:
    """Whether two symbols are the same one or of one logical group."""
    return F.coalesce((own == other) | (own_group == other_group), F.lit(False))


def classified(tokens: DataFrame, occurrences: DataFrame, definitions: DataFrame, groups: DataFrame) -> DataFrame:
    """(edge_id, kind, resolved_symbol_id, symbol) of the tokens with a verdict.

    ``definitions``: symbol, has_extent, symbol_id (null where the index has no such symbol); ``groups``: symbol_id, logical_id.
    An edge whose own confidence is Exact or Syntactic and that has a target is resolved. A definition in the index confirms it, or contradicts
    it where it is another symbol of no common group, and upgrades an edge that isn't resolved. A definition outside, or a
    symbol that names a package, contradicts a resolved edge and else is ``resolved_external``. Without an extent or a package there is no verdict.
    """
    found = containing(tokens, occurrences).select("edge_id", "symbol")
    rows = tokens.select("edge_id", "confidence", "heuristic_symbol_id").join(found, "edge_id").join(definitions.withColumn("defined", F.lit(True)), "symbol", "left")
    group = lambda c, n: groups.select(F.col("symbol_id").alias(c), F.col("logical_id").alias(n))
    rows = rows.join(group("heuristic_symbol_id", "own_group"), "heuristic_symbol_id", "left").join(group("symbol_id", "other_group"), "symbol_id", "left")
    resolved = F.col("confidence").isin("Exact", "Syntactic") & F.col("heuristic_symbol_id").isNotNull()
    same = agrees(F.col("heuristic_symbol_id"), F.col("own_group"), F.col("symbol_id"), F.col("other_group"))
    inside = F.when(~F.coalesce(resolved, F.lit(False)), "upgrade").when(same, "confirm").otherwise("contradict")
    outside = F.when(F.coalesce(resolved, F.lit(False)), "contradict").otherwise("resolved_external")
    defined = F.coalesce(F.col("defined"), F.lit(False))
    kind = F.when(defined & ~F.col("has_extent"), F.lit(None)).when(F.col("symbol_id").isNotNull(), inside).when(defined | F.col("symbol").startswith("ext "), outside)
    return rows.select("edge_id", kind.alias("kind"), F.col("symbol_id").alias("resolved_symbol_id"), "symbol").where("kind is not null")


def verdict_counts(verdicts: DataFrame) -> DataFrame:
    """One row: verdicts in all and by kind."""
    n = lambda k: F.coalesce(F.sum((F.col("kind") == k).cast("bigint")), F.lit(0))
    return verdicts.agg(F.count(F.lit(1)).alias("total"), n("upgrade").alias("upgraded"), n("resolved_external").alias("resolved_external"), n("confirm").alias("confirmed"), n("contradict").alias("contradicted"))


def eval_metrics(verdicts: DataFrame, tokens: DataFrame, calls: DataFrame) -> DataFrame:
    """One row: precision, recall, recovery of unsure edges and the share of them that the compiler resolves; a share of nothing is 1.

    ``calls``: covered (boolean), one row a callable occurrence.
    """
    low = tokens.where(F.col("confidence").isin(*LOW)).select("edge_id")
    unsure = verdicts.join(low, "edge_id", "left_semi").agg(F.count(F.lit(1)).alias("seen"), F.coalesce(F.sum((F.col("kind") == "upgrade").cast("bigint")), F.lit(0)).alias("recovered"), F.coalesce(F.sum(F.col("kind").isin("upgrade", "resolved_external").cast("bigint")), F.lit(0)).alias("upgradeable"))
    every = low.agg(F.count(F.lit(1)).alias("open"))
    covered = calls.agg(F.coalesce(F.sum(F.col("covered").cast("bigint")), F.lit(0)).alias("covered_calls"), F.coalesce(F.sum((~F.col("covered")).cast("bigint")), F.lit(0)).alias("oracle_only_calls"))
    one = verdict_counts(verdicts).join(F.broadcast(unsure)).join(F.broadcast(every)).join(F.broadcast(covered))
    c = F.col
    share = lambda a, b, n: F.round(ratio(a, b), 6).alias(n)
    return one.select(
        share(c("confirmed"), c("confirmed") + c("contradicted"), "precision"), share(c("covered_calls"), c("covered_calls") + c("oracle_only_calls"), "recall"), share(c("recovered"), c("seen"), "name_only_recovery_rate"),
        share(c("upgradeable"), c("open"), "oracle_upgradeable_fraction"), "confirmed", "contradicted", "upgraded", "resolved_external", "covered_calls", "oracle_only_calls",
    )


def contradictions(verdicts: DataFrame, canonical: DataFrame) -> DataFrame:
    """(edge_id, symbol, label): contradicted edges, each once; a canonical tool that spoke of an edge overrules a live one.

    Both tables are verdicts. label: ``resolved-external`` where the compiler left the corpus, else ``same-corpus``.
    """
    live = verdicts.join(canonical.select("edge_id"), "edge_id", "left_anti")
    both = canonical.select("edge_id", "kind", "resolved_symbol_id", "symbol").unionByName(live.select("edge_id", "kind", "resolved_symbol_id", "symbol")).where("kind = 'contradict'")
    one = both.groupBy("edge_id").agg(F.min(F.struct("symbol", "resolved_symbol_id")).alias("v"))
    return one.select("edge_id", "v.symbol", F.when(F.col("v.resolved_symbol_id").isNull(), "resolved-external").otherwise("same-corpus").alias("label"))


def usage_sites(calls: DataFrame, monikers: DataFrame, limit: int = 50, sites: int = SITES, deprecated_only: bool = False) -> DataFrame:
    """(moniker, deprecated, call_count, sites, rank): the ``limit`` monikers to look at, with their first ``sites`` call sites.

    ``calls``: moniker, path, start_line; ``monikers``: moniker, deprecated. Order: deprecated first, most calls, moniker; ``call_count`` counts all.
    """
    known = monikers.where("deprecated") if deprecated_only else monikers
    counted = calls.groupBy("moniker").agg(F.count(F.lit(1)).alias("call_count")).join(known, "moniker")
    best = top_ranked(counted, limit, F.desc("deprecated"), F.desc("call_count"), "moniker")
    place = Window.partitionBy("moniker").orderBy("path", "start_line")
    first = calls.join(F.broadcast(best.select("moniker")), "moniker").withColumn("_k", F.row_number().over(place)).where(F.col("_k") <= sites)
    listed = first.groupBy("moniker").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("path", "start_line"))), lambda x: F.concat_ws(":", x["path"].cast("string"), x["start_line"].cast("string"))), ",").alias("sites"))
    return best.join(listed, "moniker").select("moniker", "deprecated", "call_count", "sites", "rank")


#: What makes two reports comparable.
PROFILE = ("schema_version", "corpus_profile_hash", "tool_version")


def comparable(one: dict, other: dict) -> bool:
    return all(one[k] == other[k] for k in PROFILE)


def resolution_report(edges: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row: edges resolved before and after the verdicts. ``edges``: edge_id, to_symbol_id."""
    before = edges.agg(F.count(F.lit(1)).alias("total_edges"), F.count("to_symbol_id").alias("resolved_before"))
    both = before.join(F.broadcast(verdict_counts(verdicts)))
    c = F.col
    return both.select("total_edges", "resolved_before", (c("resolved_before") + c("upgraded") + c("resolved_external")).alias("resolved_after"), (c("total_edges") - c("resolved_before")).alias("unresolved_before"))


def report_delta(now: DataFrame, now_profile: dict, base: DataFrame, base_profile: dict) -> DataFrame:
    """One row: how far each figure of a report moved since its baseline; reports of other profiles are refused."""
    if not comparable(now_profile, base_profile):
        raise ValueError("reports of different profiles can't be compared")
    names = [c for c in now.columns if c in base.columns]
    both = now.select(*names).join(base.select(*[F.col(c).alias(f"_{c}") for c in names]))
    return both.select(*[(F.col(c) - F.col(f"_{c}")).alias(c) for c in names])


# -- the given tables as tokens and occurrences: chunks are occurrences of their file, with a narrower one in each and a module around all
def _chunks(s: SparkSession, d: str) -> DataFrame:
    return latest(table(s, d, "chunks").where("start_byte is not null and end_byte is not null and file_id is not null"), ["id"], ["file_id", "start_byte", "end_byte", "symbol_path"]).select("id", "file_id", "start_byte", "end_byte", "symbol_path")


def _symbol() -> Column:
    return F.coalesce(F.col("symbol_path"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("ext pkg"), (F.col("id") % 9).cast("string"))).otherwise(F.concat(F.lit("local "), F.col("id").cast("string"))))


def _occurrences(s, d):
    c = _chunks(s, d).withColumn("symbol", _symbol())
    wide = c.select(F.col("file_id").alias("path"), "start_byte", "end_byte", "symbol", (F.col("id") % 4 == 0).alias("is_definition"), F.lit(False).alias("is_module"))
    at = F.col("start_byte") + F.col("id") % 7
    near = c.where("id % 3 = 0").select(F.col("file_id").alias("path"), (at - 1).alias("start_byte"), (at + 9).alias("end_byte"), "symbol", (F.col("id") % 6 == 0).alias("is_definition"), F.lit(False).alias("is_module"))
    module = c.groupBy(F.col("file_id").alias("path")).agg(F.min("start_byte").alias("start_byte"), F.max("end_byte").alias("end_byte")).select("path", "start_byte", "end_byte", F.lit("mod").alias("symbol"), F.lit(False).alias("is_definition"), F.lit(True).alias("is_module"))
    return wide.unionByName(near).unionByName(module)


def _tokens(s, d):
    c = _chunks(s, d)
    at = F.col("start_byte") + F.col("id") % 7
    confidence = F.when(F.col("id") % 4 == 0, "Exact").when(F.col("id") % 4 == 1, "Syntactic").when(F.col("id") % 4 == 2, "NameOnly").otherwise("Ambiguous")
    target = F.when(F.col("id") % 5 != 0, F.col("id") - F.col("id") % 3)
    return c.select(F.col("id").alias("edge_id"), F.col("file_id").alias("path"), at.alias("token_start"), (at + 5).alias("token_end"), confidence.alias("confidence"), target.alias("heuristic_symbol_id"))


def _definitions(s, d):
    own = _chunks(s, d).where("symbol_path is not null").groupBy(F.col("symbol_path").alias("symbol")).agg(F.min("id").alias("i"))
    return own.select("symbol", (F.col("i") % 17 != 0).alias("has_extent"), F.when(F.col("i") % 5 != 4, F.col("i")).alias("symbol_id"))


def _groups(s, d):
    return _chunks(s, d).select(F.col("id").alias("symbol_id"), F.floor(F.col("id") / 4).alias("logical_id"))


def _verdicts(s, d):
    return spill_table(classified(_tokens(s, d), _occurrences(s, d), _definitions(s, d), _groups(s, d)), "verdicts")


def _calls(s, d):
    return _chunks(s, d).where("symbol_path is not null").select((F.col("id") % 3 != 0).alias("covered"))


def _contradictions(s, d):
    v = _verdicts(s, d)
    return contradictions(v.where("edge_id % 2 = 0"), v.where("edge_id % 3 = 0"))


def _usage(s, d):
    calls = table(s, d, "lineitem").select(F.col("l_partkey").alias("moniker"), F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("start_line"))
    return usage_sites(calls, table(s, d, "part").select(F.col("p_partkey").alias("moniker"), (F.col("p_size") % 10 == 0).alias("deprecated")))


def _report(s, d):
    return resolution_report(_tokens(s, d).select("edge_id", F.when(F.col("confidence").isin("Exact", "Syntactic"), F.col("heuristic_symbol_id")).alias("to_symbol_id")), _verdicts(s, d))


QUERIES = {
    "containing_occurrences": lambda s, d: containing(_tokens(s, d), _occurrences(s, d)),
    "edge_verdicts": lambda s, d: classified(_tokens(s, d), _occurrences(s, d), _definitions(s, d), _groups(s, d)),
    "verdict_counts": lambda s, d: verdict_counts(_verdicts(s, d)),
    "verdict_metrics": lambda s, d: eval_metrics(_verdicts(s, d), _tokens(s, d), _calls(s, d)),
    "graph_contradictions": _contradictions,
    "library_usage_sites": _usage,
    "resolution_report": _report,
}
_C = """WITH c AS (SELECT id, file_id, start_byte, end_byte, symbol_path FROM chunks WHERE start_byte IS NOT NULL AND end_byte IS NOT NULL AND file_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY file_id DESC, start_byte DESC, end_byte DESC, symbol_path DESC NULLS LAST) = 1),
y AS (SELECT *, coalesce(symbol_path, CASE WHEN id % 2 = 0 THEN 'ext pkg' || (id % 9) ELSE 'local ' || id END) AS symbol FROM c),
o AS (SELECT file_id AS path, start_byte, end_byte, symbol, id % 4 = 0 AS def, false AS mod FROM y UNION ALL SELECT file_id, start_byte + id % 7 - 1, start_byte + id % 7 + 9, symbol, id % 6 = 0, false FROM y WHERE id % 3 = 0 UNION ALL SELECT file_id, min(start_byte), max(end_byte), 'mod', false, true FROM y GROUP BY file_id),
t AS (SELECT id AS edge_id, file_id AS path, start_byte + id % 7 AS a, start_byte + id % 7 + 5 AS b, CASE id % 4 WHEN 0 THEN 'Exact' WHEN 1 THEN 'Syntactic' WHEN 2 THEN 'NameOnly' ELSE 'Ambiguous' END AS confidence, CASE WHEN id % 5 <> 0 THEN id - id % 3 END AS heuristic FROM c),
h AS (SELECT edge_id, symbol, start_byte, end_byte FROM t JOIN o ON o.path = t.path AND start_byte <= a AND b <= end_byte AND start_byte < end_byte AND ((start_byte = a AND end_byte = b) OR NOT mod) QUALIFY row_number() OVER (PARTITION BY edge_id ORDER BY def, end_byte - start_byte, start_byte, symbol) = 1),
df AS (SELECT symbol, i % 17 <> 0 AS extent, CASE WHEN i % 5 <> 4 THEN i END AS symbol_id FROM (SELECT symbol_path AS symbol, min(id) AS i FROM c WHERE symbol_path IS NOT NULL GROUP BY 1)),
ids AS (SELECT id FROM c),
v0 AS (SELECT t.edge_id, h.symbol, df.symbol_id AS resolved_symbol_id, df.symbol IS NOT NULL AS defined, extent, confidence IN ('Exact', 'Syntactic') AND heuristic IS NOT NULL AS own,
  heuristic = df.symbol_id OR (heuristic IN (SELECT id FROM ids) AND df.symbol_id IN (SELECT id FROM ids) AND heuristic // 4 = df.symbol_id // 4) AS same FROM t JOIN h USING (edge_id) LEFT JOIN df ON df.symbol = h.symbol),
v AS (SELECT edge_id, symbol, resolved_symbol_id, CASE WHEN defined AND NOT extent THEN NULL WHEN resolved_symbol_id IS NOT NULL THEN CASE WHEN NOT own THEN 'upgrade' WHEN coalesce(same, false) THEN 'confirm' ELSE 'contradict' END
  WHEN defined OR symbol LIKE 'ext %' THEN CASE WHEN own THEN 'contradict' ELSE 'resolved_external' END END AS kind FROM v0),
w AS (SELECT * FROM v WHERE kind IS NOT NULL),
n AS (SELECT count(*) AS total, count(*) FILTER (kind = 'upgrade') AS upgraded, count(*) FILTER (kind = 'resolved_external') AS resolved_external, count(*) FILTER (kind = 'confirm') AS confirmed, count(*) FILTER (kind = 'contradict') AS contradicted FROM w)"""
SQL = {
    "containing_occurrences": f"{_C} SELECT * FROM h",
    "edge_verdicts": f"{_C} SELECT edge_id, kind, resolved_symbol_id, symbol FROM w",
    "verdict_counts": f"{_C} SELECT * FROM n",
    "verdict_metrics": f"""{_C}, l AS (SELECT edge_id FROM t WHERE confidence IN ('NameOnly', 'Ambiguous')), u AS (SELECT count(*) AS seen, count(*) FILTER (kind = 'upgrade') AS rec, count(*) FILTER (kind IN ('upgrade', 'resolved_external')) AS up FROM w JOIN l USING (edge_id)),
k AS (SELECT count(*) FILTER (id % 3 <> 0) AS covered_calls, count(*) FILTER (id % 3 = 0) AS oracle_only_calls FROM c WHERE symbol_path IS NOT NULL), z AS (SELECT count(*) AS opened FROM l)
SELECT CASE WHEN confirmed + contradicted = 0 THEN 1 ELSE round(confirmed / CAST(confirmed + contradicted AS DOUBLE), 6) END AS precision, CASE WHEN covered_calls + oracle_only_calls = 0 THEN 1 ELSE round(covered_calls / CAST(covered_calls + oracle_only_calls AS DOUBLE), 6) END AS recall,
  CASE WHEN seen = 0 THEN 1 ELSE round(rec / CAST(seen AS DOUBLE), 6) END AS name_only_recovery_rate, CASE WHEN opened = 0 THEN 1 ELSE round(up / CAST(opened AS DOUBLE), 6) END AS oracle_upgradeable_fraction, confirmed, contradicted, upgraded, resolved_external, covered_calls, oracle_only_calls FROM n, u, k, z""",
    "graph_contradictions": f"""{_C}, b AS (SELECT * FROM w WHERE edge_id % 3 = 0 UNION ALL SELECT * FROM w WHERE edge_id % 2 = 0 AND edge_id % 3 <> 0)
SELECT edge_id, symbol, CASE WHEN resolved_symbol_id IS NULL THEN 'resolved-external' ELSE 'same-corpus' END AS label FROM b WHERE kind = 'contradict'""",
    "library_usage_sites": """WITH m AS (SELECT l_partkey AS moniker, p_size % 10 = 0 AS deprecated, count(*) AS call_count FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (ORDER BY deprecated DESC, call_count DESC, moniker) AS INTEGER) AS rank FROM m), q AS (SELECT l_partkey AS moniker, l_orderkey AS o, l_linenumber AS n FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) <= 25)
SELECT r.moniker, deprecated, call_count, string_agg(o || ':' || n, ',' ORDER BY o, n) AS sites, rank FROM r JOIN q USING (moniker) WHERE rank <= 50 GROUP BY ALL""",
    "resolution_report": f"{_C}, e AS (SELECT count(*) AS total_edges, count(CASE WHEN confidence IN ('Exact', 'Syntactic') THEN heuristic END) AS resolved_before FROM t) SELECT total_edges, resolved_before, resolved_before + upgraded + resolved_external AS resolved_after, total_edges - resolved_before AS unresolved_before FROM e, n",
}

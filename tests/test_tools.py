"""Questions by name on the smallest tables: each answers within its limit and tells what it left out."""

import os

import pytest
from pyspark.sql import functions as F

from quernel import tools
from quernel.operators import briefs, clones, fusion, memory, papertrail, resolution
from quernel.operators import incremental as inc
from quernel.sources.projections import commits, file_changes
from quernel.sources.tables import table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def space(spark):
    s, d = spark, SF
    store = fusion.chunk_store(s, d)
    symbols = resolution.named_symbols(s, d)
    files = table(s, d, "nation").select(F.col("n_nationkey").alias("file_id"), F.col("n_name").alias("path"), F.lit("rust").alias("language"), F.lit(0).alias("generated"), F.lit("source").alias("kind"))
    docs = table(s, d, "documents")
    prints = clones.fingerprints(docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("language"), "text"))
    found = inc._files(s, d)
    return tools.Workspace(
        {
            "chunks": store.chunks.withColumn("start_line", F.col("start_byte")), "vectors": store.vectors, "refs": store.refs, "symbols": symbols.withColumn("end_byte", F.col("start_byte") + 5), "files": files,
            "edges": resolution.named_edges(s, d), "changes": store.changes, "commits": commits(s, d), "facts": symbols.select("symbol_id"), "chunk_rows": table(s, d, "chunks"), "chunk_texts": table(s, d, "chunk_text"),
            "metrics": briefs._metrics(s, d), "file_pairs": briefs.graph_pairs(briefs._edges(s, d), briefs._symbols(s, d)), "prints": prints, "modules": docs.select(F.col("doc_id").alias("id"), F.coalesce("source", F.lit("")).alias("module")),
            "messages": docs.where("doc_kind = 'commit'").select("doc_id", "text"), "threads": papertrail._docs(s, d), "records": papertrail._records(s, d), "thread_refs": papertrail._refs(s, d), "notes": memory._notes(s, d), "bindings": memory._bindings(s, d),
            "tags": memory._tags(s, d), "note_edges": memory._note_links(s, d), "embeddings": table(s, d, "chunk_embeddings"), "indexed": found.where("id % 2 = 0"), "found": found,
            "findings": s.createDataFrame([("abc", "open", None)], "finding_id string, status string, reviewed_at_ms bigint"), "calls": table(s, d, "lineitem").select(F.col("l_partkey").alias("moniker"), F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("start_line")),
            "monikers": table(s, d, "part").select(F.col("p_partkey").alias("moniker"), (F.col("p_size") % 10 == 0).alias("deprecated")), "verdicts": resolution.named_edges(s, d).select("edge_id", F.lit("confirm").alias("kind"), F.lit(1).alias("resolved_symbol_id"), F.lit("x").alias("symbol")),
            "graph_places": table(s, d, "chunks").select(F.col("file_id").alias("path"), F.col("start_line").alias("line")), "text_places": table(s, d, "chunks").select(F.col("file_id").alias("path"), F.col("end_line").alias("line")),
        }
    )


ASKED = {
    "semantic_search": {"query": "stale shard manifest", "limit": 3}, "symbol_lookup": {"symbol": "fn", "limit": 2}, "docs_for_symbol": {"query": "shard", "path": "a/shard.rs", "name": "Shard", "qualified": "a::Shard", "limit": 2},
    "read_chunk": {"chunk_id": 5}, "grep": {"pattern": r"^\s*$"}, "find_callers": {"symbol": "fn7", "limit": 2, "mode": "fuzzy"}, "trace_callees": {"symbol": "fn7", "limit": 2, "mode": "fuzzy", "include": ["unresolved", "common_methods"]}, "traversal_summary": {"symbol": "fn7"},
    "impact_surface": {"symbol_id": 7, "qualified": "m3::fn7", "limit": 2}, "compare_graph_to_text": {}, "compare_graph_to_scip": {}, "check_library_usage": {"limit": 3}, "ffi_surface": {"limit": 3}, "important_symbols": {"limit": 3}, "repo_brief": {"mode": "churn", "limit": 3},
    "repo_clusters": {}, "find_clones": {"limit": 2}, "clones_for_symbol": {"subject": 9}, "clones_of_text": {"text": "a b c", "language": "en"}, "history_for_symbol": {"symbol": "fn", "limit": 2}, "commit_search": {"query": "shard", "limit": 2}, "issue_search": {"query": "shard", "limit": 2},
    "refs_for_commit": {"prefix": "a", "limit": 2}, "memory_search": {"query": "shard", "limit": 2}, "memory_get": {"note_id": 4}, "memory_for_path": {"path": "src/a/b.rs"}, "memory_doctor": {}, "memory_edges": {}, "dream": {}, "dream_review": {"finding": "ab", "verdict": "accept", "now_ms": 1},
    "index_status": {}, "heal_index": {"limit": 3},
}


@pytest.mark.parametrize("name", sorted(ASKED))
def test_question(space, name):
    answer = space.ask(name, **ASKED[name])
    rows = answer.rows.collect()
    limit = ASKED[name].get("limit")
    if limit and answer.truncated is not None and name != "impact_surface":
        assert len(rows) <= limit and (len(rows) == limit or not answer.truncated)


def test_history_questions(spark):
    w = tools.Workspace({"changes": file_changes(spark, SF), "commits": commits(spark, SF), "messages": table(spark, SF, "documents").where("doc_kind = 'commit'").select("doc_id", "text")})
    answer = w.ask("git_history_for_path", path=3, limit=5)
    assert answer.rows.count() == 5 and answer.truncated
    assert w.ask("commits_touching_query", query="shard", paths=[3], limit=4).rows.count() == 4
    w.ask("coupled_files", path=3).rows.collect()
    with pytest.raises(LookupError):
        w.ask("find_callers", symbol="x")
    with pytest.raises(LookupError):
        w.ask("nothing")

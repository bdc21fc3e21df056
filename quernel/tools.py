"""The operators as named questions with limits: one call a question, with whether its answer was cut.

A ``Workspace`` holds the tables of one index; a question only reads those it needs, and a missing one is named when it is asked for.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.operators import briefs, clones, fusion, graph, history, impact, incremental, index, memory, notes, papertrail, refine, resolution, search, verdicts

#: Former names of questions.
ALIASES = {"git_history_for_path": "history_for_path", "git_history_for_symbol": "history_for_symbol", "papertrail_issue_search": "issue_search", "memories_for_path": "memory_for_path", "callers": "find_callers", "callees": "trace_callees"}


@dataclass(frozen=True)
class Answer:
    """Rows of an answer, and whether there were more than were asked for (None where that isn't asked)."""

    rows: DataFrame
    truncated: bool | None = None


@dataclass
class Workspace:
    """Tables by name, with the columns that the operators name: chunks, vectors, edges, symbols, files, commits, changes, refs, notes, bindings, note_edges,
    threads, records, verdicts, occurrences, monikers, calls, metrics, findings, indexed, found."""

    tables: dict[str, DataFrame] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise LookupError(f"this question needs the table {name}")
        return self.tables[name]

    def ask(self, question: str, **arguments) -> Answer:
        """Answer a question by its name or a former one."""
        name = ALIASES.get(question, question)
        if name not in QUESTIONS:
            raise LookupError(f"no question {question}; there are {', '.join(sorted(QUESTIONS))}")
        return QUESTIONS[name](self, **arguments)


QUESTIONS: dict[str, Callable[..., Answer]] = {}


def question(make: Callable[..., Answer]) -> Callable[..., Answer]:
    QUESTIONS[make.__name__] = make
    return make


def _cut(rows: DataFrame, limit: int, rank: str = "rank") -> Answer:
    """The rows of a report of ``limit`` + 1, without the one that tells that there are more."""
    more = not rows.where(F.col(rank) > limit).isEmpty()
    return Answer(rows.where(F.col(rank) <= limit), more)


# -- search
@question
def semantic_search(w: Workspace, query: str, limit: int = 10, embedding: list[float] | None = None, include_generated: bool = False, graded: bool = False) -> Answer:
    store = fusion.Store(w["chunks"], w["vectors"] if embedding is not None else w["chunks"], w["edges"], w["changes"], w["refs"])
    return _cut(fusion.semantic_search(store, query, embedding, limit + 1, graded, include_generated), limit)


@question
def symbol_lookup(w: Workspace, symbol: str, limit: int = 10, language: str | None = None, include_generated: bool = False) -> Answer:
    return _cut(resolution.lookup_symbol(w["symbols"], w["files"], symbol, limit + 1, language, include_generated), limit)


@question
def docs_for_symbol(w: Workspace, query: str, path: str, name: str, qualified: str, limit: int = 10) -> Answer:
    found = search.bm25(w["chunks"].select("doc_id", "text"), query, 8 * max(limit, 10)).select("doc_id", "score")
    return _cut(fusion.rank_docs(w["chunks"].join(F.broadcast(found), "doc_id"), path, name, qualified, limit + 1), limit)


@question
def read_chunk(w: Workspace, chunk_id: int, around: int = 1) -> Answer:
    return Answer(index.read_chunk(w["chunk_rows"], w["chunk_texts"], chunk_id, around))


@question
def grep(w: Workspace, pattern: str) -> Answer:
    return Answer(search.regex_hits(w["chunks"].select(F.col("doc_id").alias("id"), "text"), pattern))


# -- graph
def _seed(symbol: str, resolution_mode: str, kinds, symbol_id, include) -> resolution.Seed:
    include = set(include)
    return resolution.Seed(symbol, resolution_mode, symbol_id, kinds=tuple(kinds), include_macros="macros" in include, include_unresolved="unresolved" in include, include_common="common_methods" in include)


def _hops(w: Workspace, seed: resolution.Seed, callers: bool, limit: int) -> Answer:
    edges = resolution.visible(w["edges"])
    if "verdicts" not in w.tables:
        return _cut(resolution.hops(edges, w["symbols"], seed, callers, limit + 1), limit)
    said = w["verdicts"].select("edge_id", F.col("kind").alias("verdict"))
    return _cut(resolution.enriched_hops(resolution.hops(edges, w["symbols"], seed, callers, resolution.overfetch(limit)), said, limit + 1), limit)


@question
def find_callers(w: Workspace, symbol: str, limit: int = 50, mode: str = resolution.SYNTACTIC, edge_kinds=resolution.CALL_KINDS, symbol_id: int | None = None, include=()) -> Answer:
    return _hops(w, _seed(symbol, mode, edge_kinds, symbol_id, include), True, limit)


@question
def trace_callees(w: Workspace, symbol: str, limit: int = 50, mode: str = resolution.SYNTACTIC, edge_kinds=resolution.CALL_KINDS, symbol_id: int | None = None, include=()) -> Answer:
    return _hops(w, _seed(symbol, mode, edge_kinds, symbol_id, include), False, limit)


@question
def traversal_summary(w: Workspace, symbol: str, callers: bool = True, limit: int = 50, mode: str = resolution.SYNTACTIC, edge_kinds=resolution.CALL_KINDS, symbol_id: int | None = None, include=()) -> Answer:
    return Answer(resolution.summary(resolution.visible(w["edges"]), w["symbols"], _seed(symbol, mode, edge_kinds, symbol_id, include), callers, limit))


@question
def impact_surface(w: Workspace, symbol_id: int, qualified: str, limit: int = 50) -> Answer:
    found = impact.lanes(resolution.visible(w["edges"]), w["symbols"].join(w["files"].select("file_id", "path"), "file_id"), symbol_id, qualified)
    rows = impact.surface(found, limit)
    return Answer(rows, not rows.where("reason = 'completeness'").isEmpty())


@question
def compare_graph_to_text(w: Workspace) -> Answer:
    return Answer(impact.reconciled(w["graph_places"], w["text_places"]))


@question
def compare_graph_to_scip(w: Workspace, limit: int = 50) -> Answer:
    rows = verdicts.contradictions(w["verdicts"], w["verdicts"].limit(0))
    shown, more = resolution.probe(rows, limit, "edge_id")
    return Answer(shown, more)


@question
def check_library_usage(w: Workspace, limit: int = 50, deprecated_only: bool = False, path: str | None = None) -> Answer:
    calls = w["calls"] if path is None else w["calls"].where(F.col("path") == path)
    return _cut(verdicts.usage_sites(calls, w["monikers"], limit + 1, deprecated_only=deprecated_only), limit)


@question
def ffi_surface(w: Workspace, limit: int = 50) -> Answer:
    return _cut(impact.exported_surface(w["symbols"], w["files"], w["facts"], limit + 1), limit)


@question
def important_symbols(w: Workspace, limit: int = 20, personal: DataFrame | None = None) -> Answer:
    edges = resolution.visible(w["edges"]).select(F.col("from_symbol_id").alias("src"), F.col("to_symbol_id").alias("dst"), "kind", "confidence")
    shown, more = resolution.probe(graph.pagerank(graph.ranked_edges(edges), personal=personal), limit, F.desc("rank"), "node")
    return Answer(shown, more)


# -- files, clones
@question
def repo_brief(w: Workspace, mode: str = "spine", limit: int = 20) -> Answer:
    shown, more = resolution.probe(briefs.file_brief(w["metrics"], mode), limit, F.desc("score"), "path", "file_id")
    return Answer(shown, more)


@question
def repo_clusters(w: Workspace, limit: int = 10, min_cluster_size: int = 2) -> Answer:
    pairs = briefs.likeness(w["metrics"], briefs.co_touch_pairs(w["changes"], w["metrics"]), w["file_pairs"])
    shown, more = resolution.probe(briefs.file_clusters(w["metrics"], pairs, min_cluster_size), limit, F.desc("score"), "cluster")
    return Answer(shown, more)


@question
def find_clones(w: Workspace, min_similarity: float = clones.THETA, limit: int = 20) -> Answer:
    prints = w["prints"]
    pairs = clones.clone_pairs(clones.bags(prints), min_similarity)
    metrics = refine.class_metrics(pairs, clones.lcs_ratio(pairs, prints), prints, w["modules"])
    return _cut(refine.find_clones(metrics, limit + 1), limit)


@question
def clones_for_symbol(w: Workspace, subject: int, min_similarity: float = clones.THETA) -> Answer:
    return Answer(refine.subject_component(clones.clone_pairs(clones.bags(w["prints"]), min_similarity), subject))


@question
def clones_of_text(w: Workspace, text: str, language: str, min_similarity: float = clones.THETA) -> Answer:
    return Answer(refine.clones_of_text(clones.bags(w["prints"]), text, language, min_similarity))


# -- history and threads
@question
def history_for_path(w: Workspace, path, limit: int = 20) -> Answer:
    shown, more = resolution.probe(history.history_for_path(w["changes"], w["commits"], path), limit, F.desc("authored_at_s"), "hash")
    return Answer(shown, more)


@question
def history_for_symbol(w: Workspace, symbol: str, limit: int = 20) -> Answer:
    hits = symbol_lookup(w, symbol, limit).rows.select("symbol_id", "path")
    return Answer(history.history_for_symbols(hits, w["changes"].select("hash", "path"), w["commits"], limit))


@question
def commit_search(w: Workspace, query: str, limit: int = 20) -> Answer:
    return _cut(search.bm25(w["messages"], query, limit + 1), limit)


@question
def commits_touching_query(w: Workspace, query: str, paths: list, limit: int = 20) -> Answer:
    shown, more = resolution.probe(notes.commits_touching(w["messages"], w["changes"], query, paths, limit), limit, "score", "hash")
    return Answer(shown, more)


@question
def coupled_files(w: Workspace, path, limit: int = 20) -> Answer:
    rows = history.coupled_files(history.change_couplings(w["changes"], w["commits"])).where(F.col("path") == path)
    return _cut(rows, limit)


@question
def issue_search(w: Workspace, query: str, limit: int = 20, kind: str | None = None) -> Answer:
    return _cut(papertrail.issue_search(w["threads"], w["records"], query, limit + 1, kind), limit)


@question
def refs_for_commit(w: Workspace, prefix: str, limit: int = 20) -> Answer:
    return _cut(papertrail.refs_for_commit(w["thread_refs"], prefix, limit + 1), limit)


# -- notes, findings, the index
@question
def memory_search(w: Workspace, query: str, limit: int = 10, embedding: list[float] | None = None) -> Answer:
    own = w["notes"].select(F.col("note_id").alias("doc_id"), F.col("body").alias("text"))
    return _cut(fusion.note_search(own, w["vectors"] if embedding is not None else own, query, embedding, limit + 1), limit)


@question
def memory_get(w: Workspace, note_id) -> Answer:
    mine = F.col("note_id") == note_id
    return Answer(memory.hydrated(w["notes"].where(mine), w["bindings"].where(mine), w["tags"].where(mine)))


@question
def memory_for_path(w: Workspace, path: str) -> Answer:
    """Notes bound to a path or to a directory above it."""
    above = [path.rsplit("/", k)[0] for k in range(path.count("/") + 1)]
    return Answer(w["bindings"].where(F.col("path").isin(path, *above)).select("note_id", "path", "anchor_status").distinct())


@question
def memory_doctor(w: Workspace, placeholder: str = "__unassigned__") -> Answer:
    return Answer(memory.doctor(w["notes"], w["bindings"], w["symbols"].join(w["files"].select("file_id", "path"), "file_id"), placeholder))


@question
def memory_edges(w: Workspace, note_id=None) -> Answer:
    rows = memory.reresolved(w["note_edges"], w["notes"])
    return Answer(rows if note_id is None else rows.where(F.col("target_note_id") == note_id))


@question
def dream(w: Workspace) -> Answer:
    """Findings about notes: (kind, subject) of paths that are gone and notes that nothing vouches for."""
    paths = w["files"].select("path")
    stale = memory.stale_references(w["notes"], paths).select(F.lit("stale_reference").alias("kind"), F.col("note_id").alias("subject"))
    lost = memory.unverifiable(w["notes"], w["bindings"], w["symbols"], paths).select(F.lit("memory_unverifiable").alias("kind"), F.col("note_id").alias("subject"))
    return Answer(stale.unionByName(lost))


@question
def dream_review(w: Workspace, finding: str, verdict: str, now_ms: int) -> Answer:
    return Answer(memory.review(w["findings"], finding, verdict, now_ms))


@question
def index_status(w: Workspace) -> Answer:
    return Answer(index.embedding_status(w["embeddings"]))


@question
def heal_index(w: Workspace, limit: int = 4) -> Answer:
    return _cut(incremental.heal_plan(w["indexed"], w["found"], limit + 1), limit)

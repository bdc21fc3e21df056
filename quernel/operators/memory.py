"""Notes bound to code: hydration, evidence lanes, health of their anchors, identifiers they name, what to verify, and findings about them.

Notes: note_id, repo_id, kind, title, body, status. Bindings: note_id, kind, binding_id, path, line, anchor_status. ``scip_moniker``
bindings follow the compiler index and never count as broken or live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.plans.cluster import cut
from quernel.plans.ranks import global_rank
from quernel.sources.tables import table

#: Statuses of a live note, shortest snake_case word that is an identifier, ranks of reasons and findings (fixed values).
LIVE = ("active", "stale")
SNAKE_LENGTH = 8
REASON_RANK = {"anchor_broken": 1.0, "never_checked": 0.75, "content_changed": 0.5, "inputs_changed": 0.25, "prompt_changed": 0.2}
BASE_RANK = {"coverage_gap": 1.0, "stale_reference": 0.5, "memory_unverifiable": 0.9, "memory_divergence": 0.8, "memory_duplicate": 0.6, "dependent_of_dead_source": 0.5}
CURRENT_FINDINGS = ("open", "accepted", "dismissed")
VERDICTS = {"accept": "accepted", "dismiss": "dismissed", "reset": "open"}


def hydrated(notes: DataFrame, bindings: DataFrame, tags: DataFrame) -> DataFrame:
    """(note_id, kind, title, status, bindings, tags): notes with their bindings and tags as sorted, joined lists; empty where there are none."""
    label = F.concat_ws(":", "kind", F.coalesce("path", F.lit("")), "anchor_status")
    bound = bindings.groupBy("note_id").agg(F.array_join(F.sort_array(F.collect_list(label)), ",").alias("bindings"))
    tagged = tags.groupBy("note_id").agg(F.array_join(F.sort_array(F.collect_set("tag")), ",").alias("tags"))
    rows = notes.select("note_id", "kind", "title", "status").join(bound, "note_id", "left").join(tagged, "note_id", "left")
    return rows.withColumn("bindings", F.coalesce("bindings", F.lit(""))).withColumn("tags", F.coalesce("tags", F.lit("")))


def evidence_lanes(notes: DataFrame, direct: DataFrame, crossed: DataFrame, call_paths: DataFrame, limit: int) -> DataFrame:
    """(note_id, lane): notes bound to a symbol, to an edge around it or to a call path through it; notes that aren't active are in lane ``stale``.

    The three tables hold note_id; ``limit`` is what a lane shows (0: all), the smallest ids. A note may be in several lanes.
    """
    out = None
    for name, rows in (("direct", direct), ("path_crossed", crossed), ("call_path_crossed", call_paths)):
        own = notes.select("note_id", "status").join(rows.select("note_id").distinct(), "note_id", "left_semi")
        own = own.orderBy("note_id").limit(limit) if limit else own
        own = own.select("note_id", F.when(F.col("status") == "active", name).otherwise("stale").alias("lane"))
        out = own if out is None else out.unionByName(own)
    return out.distinct()


def doctor(notes: DataFrame, bindings: DataFrame, symbols: DataFrame, placeholder: str) -> DataFrame:
    """(note_id, kind, binding_id, anchor_status, candidates): bindings of active notes that are gone, stale or pending, with the live symbols
    (path, name) of their path as candidates; notes of the ``placeholder`` repository need a home."""
    active = notes.where("status = 'active'").select("note_id")
    broken = bindings.where(F.col("anchor_status").isin("gone", "stale", "pending") & (F.col("kind") != "scip_moniker")).join(active, "note_id", "left_semi")
    live = symbols.groupBy("path").agg(F.array_join(F.sort_array(F.collect_set("name")), ",").alias("candidates"))
    rows = broken.join(live, "path", "left").select("note_id", "kind", "binding_id", "anchor_status", F.coalesce("candidates", F.lit("")).alias("candidates"))
    lost = notes.where(F.col("status").isin(*LIVE) & (F.col("repo_id") == placeholder)).select("note_id", F.lit("repo").alias("kind"), F.lit(placeholder).alias("binding_id"), F.lit("placeholder_repo").alias("anchor_status"), F.lit("").alias("candidates"))
    return rows.unionByName(lost)


def anchor_health(notes: DataFrame, bindings: DataFrame) -> DataFrame:
    """(anchor_status, n) over the bindings of active notes."""
    active = notes.where("status = 'active'").select("note_id")
    return bindings.where("kind <> 'scip_moniker'").join(active, "note_id", "left_semi").groupBy("anchor_status").agg(F.count(F.lit(1)).alias("n"))


def reresolved(edges: DataFrame, notes: DataFrame) -> DataFrame:
    """(edge_id, target_repo_id, target_note_id, anchor_status): targets of note edges as they stand now.

    A note that exists gives its own repository and ``current``; one that is missing is ``gone`` if it was there before, else
    ``unresolved`` with the repository that the edge names. Edges to other than notes stay as they are.
    """
    there = notes.select(F.col("note_id").alias("target_anchor"), F.coalesce("repo_id", F.lit("__unassigned__")).alias("now")).distinct()
    rows = edges.join(there, "target_anchor", "left")
    node, found = F.col("target_kind") == "node", F.col("now").isNotNull()
    status = F.when(~node, F.col("anchor_status")).when(found, "current").when(F.col("anchor_status").isin("current", "gone"), "gone").otherwise("unresolved")
    return rows.select("edge_id", F.when(node & found, F.col("now")).otherwise(F.col("target_repo_id")).alias("target_repo_id"), F.when(node & found, F.col("target_anchor")).alias("target_note_id"), status.alias("anchor_status"))


def identifiers(notes: DataFrame) -> DataFrame:
    """(note_id, identifier): what a note names: spans in back ticks on one line, trimmed, and snake_case words of 8 characters or more."""
    text = F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("body", F.lit("")))
    spans = F.filter(F.transform(F.regexp_extract_all(text, F.lit("`([^`]+)`"), 1), lambda x: F.trim(x)), lambda x: (x != "") & ~x.contains("\n"))
    words = F.filter(F.regexp_extract_all(text, F.lit(r"\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\b"), 0), lambda x: F.length(x) >= SNAKE_LENGTH)
    return notes.select("note_id", F.explode(F.array_distinct(F.concat(spans, words))).alias("identifier"))


def path_suffixes(paths: DataFrame) -> DataFrame:
    """(suffix): every path (path) from each of its parts on, so that a suffix search is an equality."""
    parts = F.split("path", "/")
    return paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))).alias("suffix")).distinct()


def stale_references(notes: DataFrame, paths: DataFrame) -> DataFrame:
    """(note_id, missing): paths of Rust sources below crates, apps, tools or src that live notes name and that no indexed path is or ends with.

    A name that follows / or : is part of something longer and doesn't count.
    """
    named = F.filter(F.regexp_extract_all("body", F.lit(r"(?:[/:]|\b)(?:crates|apps|tools|src)/[\w./-]+\.rs\b"), 0), lambda x: ~x.rlike("^[/:]"))
    rows = notes.where(F.col("status").isin(*LIVE)).select("note_id", F.explode(F.array_distinct(named)).alias("suffix"))
    gone = rows.join(path_suffixes(paths), "suffix", "left_anti")
    return gone.groupBy("note_id").agg(F.array_join(F.sort_array(F.collect_set("suffix")), ", ").alias("missing"))


def unverifiable(notes: DataFrame, bindings: DataFrame, symbols: DataFrame, paths: DataFrame, floating: tuple[str, ...] = ()) -> DataFrame:
    """(note_id, n_identifiers): active notes without a binding that isn't gone, none of whose identifiers is a symbol's name or an indexed path.

    Kinds in ``floating`` needn't be bound: without any binding they don't count.
    """
    live = bindings.where("kind <> 'scip_moniker' and anchor_status <> 'gone'").select("note_id").distinct()
    own = notes.where("status = 'active'").join(live, "note_id", "left_anti")
    if floating:
        bound = bindings.select("note_id").distinct().withColumn("bound", F.lit(True))
        own = own.join(bound, "note_id", "left").where(~F.col("kind").isin(*floating) | F.col("bound")).drop("bound")
    named = identifiers(own)
    last = F.element_at(F.split("identifier", "::"), -1)
    known = named.join(symbols.select(F.col("name")).distinct(), last == F.col("name"), "left_semi").select("note_id")
    known = known.union(named.join(path_suffixes(paths), F.col("identifier") == F.col("suffix"), "left_semi").select("note_id")).distinct()
    counts = named.groupBy("note_id").agg(F.count(F.lit(1)).alias("n"))
    return own.join(known, "note_id", "left_anti").join(counts, "note_id", "left").select("note_id", F.coalesce("n", F.lit(0)).alias("n_identifiers"))


def death(status: Column, n_bindings: Column, n_gone: Column) -> Column:
    """Why a note no longer stands, null where it does."""
    return F.when(status.isin("obsolete", "rejected"), status).when((n_bindings > 0) & (n_gone == n_bindings), "anchored only to code that is gone")


def dependents_of_dead(notes: DataFrame, bindings: DataFrame, derived: DataFrame, supersedes: DataFrame) -> DataFrame:
    """(note_id, via, root, reason): live notes derived, directly or through others, from one that no longer stands.

    ``derived``: note_id, parent; ``supersedes``: note_id, target. The first parent (by id) that is dead or rests on one that is leads to the
    root. A note that supersedes its root is left out. Rounds follow the longest chain; each is cut, and only new notes are joined.
    """
    counts = bindings.groupBy("note_id").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("anchor_status") == "gone").cast("bigint")).alias("g"))
    reason = death(F.col("status"), F.coalesce("n", F.lit(0)), F.coalesce("g", F.lit(0)))
    state = notes.select("note_id", "status").join(counts, "note_id", "left").select("note_id", "status", reason.alias("reason"))
    live = state.where(F.col("status").isin(*LIVE)).select("note_id")
    links = cut(derived.join(live, "note_id", "left_semi").where("note_id <> parent").select("note_id", "parent").distinct())
    dead = cut(state.where("reason is not null").select("note_id", "reason"))
    # notes that rest on a dead one, by growing the set a link at a time
    rests = cut(links.join(dead.select(F.col("note_id").alias("parent")), "parent", "left_semi").select("note_id").distinct())
    fresh = rests
    while not fresh.isEmpty():
        fresh = cut(links.join(fresh.select(F.col("note_id").alias("parent")), "parent", "left_semi").select("note_id").distinct().join(rests, "note_id", "left_anti"))
        rests = cut(rests.union(fresh))
    ends = dead.select(F.col("note_id").alias("parent"), F.lit(True).alias("is_dead"))
    onward = rests.select(F.col("note_id").alias("parent")).withColumn("goes_on", F.lit(True))
    usable = links.join(ends, "parent", "left").join(onward, "parent", "left").where("is_dead or goes_on")
    first = cut(usable.groupBy("note_id").agg(F.min_by(F.struct("parent", F.coalesce("is_dead", F.lit(False)).alias("is_dead")), F.col("parent")).alias("p")).select("note_id", F.col("p.parent").alias("via"), F.col("p.parent").alias("at"), F.col("p.is_dead").alias("done")))
    step = cut(first.select(F.col("note_id").alias("at"), F.col("via").alias("next"), F.col("done").alias("next_done")))
    seen = -1
    while True:  # follow the first parents; each round doubles the step
        left = first.where("not done").count()
        if left in (0, seen):
            break
        seen = left
        moved = first.join(step, "at", "left")
        first = cut(moved.select("note_id", "via", F.when(F.col("done"), F.col("at")).otherwise(F.col("next")).alias("at"), (F.col("done") | F.coalesce("next_done", F.lit(False))).alias("done")))
    alive = state.where("reason is null").select("note_id")
    rows = first.where("done").join(alive, "note_id", "left_semi").join(dead.withColumnRenamed("note_id", "at"), "at").select("note_id", "via", F.col("at").alias("root"), "reason")
    return rows.join(supersedes.select("note_id", F.col("target").alias("root")).distinct(), ["note_id", "root"], "left_anti").select("note_id", "via", "root", "reason")


def duplicate_findings(pairs: DataFrame, compared: DataFrame, notes: DataFrame, findings: DataFrame) -> DataFrame:
    """(subject, origin): live notes that are close in meaning, ``a|b`` by id; an open finding whose notes weren't both compared stays.

    ``pairs``: a, b; ``compared``: note_id; ``findings``: a, b, status.
    """
    live = notes.where(F.col("status").isin(*LIVE)).select("note_id")
    both = lambda df: df.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(live.withColumnRenamed("note_id", "a"), "a", "left_semi").join(live.withColumnRenamed("note_id", "b"), "b", "left_semi")
    now = both(pairs).withColumn("origin", F.lit("near"))
    seen = lambda n: compared.select(F.col("note_id").alias(n)).distinct().withColumn(f"{n}_seen", F.lit(True))
    kept = both(findings.where(F.col("status").isin(*CURRENT_FINDINGS))).join(seen("a"), "a", "left").join(seen("b"), "b", "left").where("a_seen is null or b_seen is null").select("a", "b")
    kept = kept.join(now, ["a", "b"], "left_anti").withColumn("origin", F.lit("kept"))
    return now.unionByName(kept).select(F.concat_ws("|", "a", "b").alias("subject"), "origin")


def divergences(reality: DataFrame, notes: DataFrame, inputs: DataFrame, prompt: str) -> DataFrame:
    """(note_id, direction): active notes whose stored verdict is ``diverged`` and still speaks of the same text, inputs and prompt.

    ``reality``: note_id, verdict, direction, content_hash, inputs_hash, prompt_version; ``inputs``: note_id, inputs_hash as it is now.
    """
    now = notes.where("status = 'active'").select("note_id", content_hash("title", "body").alias("now_content")).join(inputs.select("note_id", F.col("inputs_hash").alias("now_inputs")), "note_id")
    rows = reality.where((F.col("verdict") == "diverged") & (F.col("prompt_version") == prompt)).join(now, "note_id")
    return rows.where((F.col("content_hash") == F.col("now_content")) & (F.col("inputs_hash") == F.col("now_inputs"))).select("note_id", F.coalesce("direction", F.lit("unknown")).alias("direction"))


def content_hash(title, body) -> Column:
    return F.sha2(F.concat_ws("\u001f", F.coalesce(title, F.lit("")), F.coalesce(body, F.lit(""))), 256)


def verification_queue(notes: DataFrame, bindings: DataFrame, reality: DataFrame, inputs: DataFrame, prompt: str) -> DataFrame:
    """(note_id, reason, rank, place): active notes to check again, the most urgent first (ties: id).

    A note whose text, inputs and prompt are those of its last check is skipped even if its anchor is broken; else a broken anchor comes first.
    """
    now = notes.where("status = 'active'").select("note_id", content_hash("title", "body").alias("now_content")).join(inputs.select("note_id", F.col("inputs_hash").alias("now_inputs")), "note_id", "left")
    broken = bindings.where("anchor_status in ('gone', 'stale') and kind <> 'scip_moniker'").select("note_id").distinct().withColumn("broken", F.lit(True))
    rows = now.join(broken, "note_id", "left").join(reality.withColumn("known", F.lit(True)), "note_id", "left")
    text, pack, ask = (~F.col(a).eqNullSafe(b) for a, b in (("content_hash", F.col("now_content")), ("inputs_hash", F.col("now_inputs")), ("prompt_version", F.lit(prompt))))
    known = F.coalesce("known", F.lit(False))
    due = ~known | text | pack | ask
    reason = F.when(F.coalesce("broken", F.lit(False)), "anchor_broken").when(~known, "never_checked").when(text, "content_changed").when(pack, "inputs_changed").otherwise("prompt_changed")
    rank = F.create_map(*[F.lit(x) for kv in REASON_RANK.items() for x in kv])
    return global_rank(rows.where(due).select("note_id", reason.alias("reason")).withColumn("rank", rank[F.col("reason")]), F.desc("rank"), "note_id", name="place")


def review(findings: DataFrame, prefix: str, verdict: str, now_ms: int) -> DataFrame:
    """The findings (finding_id, status, reviewed_at_ms, ...) after a review of the one whose id starts with ``prefix``.

    The prefix must name exactly one finding, and one that is current; ``accept``, ``dismiss`` or ``reset``.
    """
    prefix = prefix.strip()
    if not prefix:
        raise ValueError("a finding id is required")
    status = VERDICTS[verdict]
    found = findings.where(F.col("finding_id").startswith(prefix)).select("finding_id", "status").limit(2).collect()
    if len(found) != 1:
        raise ValueError("no finding matches" if not found else "the id is ambiguous")
    if found[0].status not in CURRENT_FINDINGS:
        raise ValueError(f"the finding is {found[0].status} and can't be reviewed")
    mine = F.col("finding_id") == found[0].finding_id
    at = F.lit(None).cast("bigint") if verdict == "reset" else F.lit(now_ms).cast("bigint")
    return findings.withColumn("status", F.when(mine, status).otherwise(F.col("status"))).withColumn("reviewed_at_ms", F.when(mine, at).otherwise(F.col("reviewed_at_ms")))


# -- the given documents as notes
def _notes(s: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    status = F.when(i % 6 == 0, "obsolete").when(i % 6 == 1, "stale").when(i % 25 == 2, "rejected").otherwise("active")
    named = F.concat(F.coalesce("text", F.lit("")), F.lit("\nsee `fn"), (i % 400).cast("string"), F.lit("` and src/a"), (i % 9).cast("string"), F.lit("/b.rs, vendor:src/c.rs or step_no_"), i.cast("string"), F.lit(" in `crates/x.rs`"))
    return table(s, d, "documents").select(i.alias("note_id"), "repo_id", F.col("doc_kind").alias("kind"), F.substring("text", 1, 30).alias("title"), named.alias("body"), status.alias("status"))


def _bindings(s, d):
    i = F.col("doc_id")
    paths = table(s, d, "files").groupBy(F.col("id").alias("doc_id")).agg(F.min("path").alias("path"))
    docs = table(s, d, "documents").select("doc_id", F.explode(F.array(*[F.lit(k) for k in range(2)])).alias("n")).join(paths, "doc_id")
    kind = F.when(i % 3 == 0, "path").when(i % 3 == 1, "symbol").otherwise("scip_moniker")
    status = F.when(i % 7 < 2, "gone").when((i + F.col("n")) % 7 == 2, "stale").when((i + F.col("n")) % 7 == 3, "pending").otherwise("current")
    return docs.select(i.alias("note_id"), kind.alias("kind"), F.concat_ws("#", i.cast("string"), F.col("n").cast("string")).alias("binding_id"), "path", status.alias("anchor_status"))


def _symbols(s, d):
    files = table(s, d, "files").groupBy(F.col("id").alias("file_id")).agg(F.min("path").alias("path"))
    return table(s, d, "chunks").where("symbol_path is not null and id % 4 = 0").select("file_id", F.concat(F.lit("fn"), (F.col("id") % 150).cast("string")).alias("name")).distinct().join(files, "file_id")


def _paths(s, d):
    return table(s, d, "files").select("path").distinct().union(s.createDataFrame([("x/src/a3/b.rs",), ("src/a5/b.rs",)], "path string"))


def _reality(s, d):
    n = _notes(s, d).where("note_id % 4 <> 3")
    i = F.col("note_id")
    return n.select(i, F.when(i % 3 == 0, "diverged").otherwise("holds").alias("verdict"), F.when(i % 2 == 0, "code_moved").alias("direction"), F.when(i % 10 == 0, "old").otherwise(content_hash("title", "body")).alias("content_hash"), F.concat(F.lit("h"), (i % 8).cast("string")).alias("inputs_hash"), F.when(i % 11 == 0, "p1").otherwise("p2").alias("prompt_version"))


def _inputs(s, d):
    return _notes(s, d).select("note_id", F.when(F.col("note_id") % 14 == 0, "hx").otherwise(F.concat(F.lit("h"), (F.col("note_id") % 8).cast("string"))).alias("inputs_hash"))


def _derived(s, d):
    i = F.col("note_id")
    return _notes(s, d).where("note_id % 5 <> 0").select(i, F.explode(F.array(i - i % 5, F.floor(i / 2), i - 1)).alias("parent"))


def _dependents(s, d):
    return dependents_of_dead(_notes(s, d), _bindings(s, d), _derived(s, d), _notes(s, d).where("note_id % 9 = 0").select("note_id", (F.col("note_id") - 1).alias("target")))


def _pairs(s, d):
    p = table(s, d, "lineitem")
    return p.where("l_orderkey < 3000").select(F.col("l_orderkey").alias("a"), (F.col("l_partkey") % 900).alias("b"))


def _duplicates(s, d):
    findings = table(s, d, "events").select((F.col("event_id") % 1000).alias("a"), (F.col("user_id") % 1000).alias("b"), F.when(F.col("event_type") == "error", "resolved").otherwise("open").alias("status"))
    return duplicate_findings(_pairs(s, d).where("a % 3 = 0"), _notes(s, d).where("note_id % 2 = 0"), _notes(s, d), findings)


def _lanes(s, d):
    n = _notes(s, d)
    pick = lambda w: n.where(w).select("note_id")
    return evidence_lanes(n, pick("note_id % 10 = 3"), pick("note_id % 14 = 3"), pick("note_id % 22 = 3"), 12)


def _tags(s, d):
    return table(s, d, "documents").select(F.col("doc_id").alias("note_id"), F.explode(F.array("lang", "source")).alias("tag")).where("tag is not null")


def _note_links(s, d):
    i = F.col("doc_id")
    return table(s, d, "documents").select(i.alias("edge_id"), F.when(i % 8 == 0, "path").otherwise("node").alias("target_kind"), (i * 2).alias("target_anchor"), F.lit("hint").alias("target_repo_id"), F.when(i % 3 == 0, "current").when(i % 3 == 1, "gone").otherwise("unresolved").alias("anchor_status"))


QUERIES = {
    "notes_hydrated": lambda s, d: hydrated(_notes(s, d), _bindings(s, d), _tags(s, d)),
    "note_lanes": _lanes,
    "note_doctor": lambda s, d: doctor(_notes(s, d), _bindings(s, d), _symbols(s, d), "2aab7ed572604b0586ae7bb149b3f422"),
    "anchor_health": lambda s, d: anchor_health(_notes(s, d), _bindings(s, d)),
    "note_edges_now": lambda s, d: reresolved(_note_links(s, d), _notes(s, d)),
    "note_identifiers": lambda s, d: identifiers(_notes(s, d)),
    "stale_references": lambda s, d: stale_references(_notes(s, d), _paths(s, d)),
    "unverifiable_notes": lambda s, d: unverifiable(_notes(s, d), _bindings(s, d), _symbols(s, d), _paths(s, d), ("comment",)),
    "dependents_of_dead": _dependents,
    "duplicate_findings": _duplicates,
    "divergent_notes": lambda s, d: divergences(_reality(s, d), _notes(s, d), _inputs(s, d), "p2"),
    "verification_queue": lambda s, d: verification_queue(_notes(s, d), _bindings(s, d), _reality(s, d), _inputs(s, d), "p2"),
}
_N = r"""WITH RECURSIVE n AS (SELECT doc_id AS note_id, repo_id, doc_kind AS kind, left(text, 30) AS title, coalesce(text, '') || chr(10) || 'see `fn' || (doc_id % 400) || '` and src/a' || (doc_id % 9) || '/b.rs, vendor:src/c.rs or step_no_' || doc_id || ' in `crates/x.rs`' AS body,
  CASE WHEN doc_id % 6 = 0 THEN 'obsolete' WHEN doc_id % 6 = 1 THEN 'stale' WHEN doc_id % 25 = 2 THEN 'rejected' ELSE 'active' END AS status FROM documents),
fp AS (SELECT id, min(path) AS path FROM files GROUP BY id),
b AS (SELECT doc_id AS note_id, CASE doc_id % 3 WHEN 0 THEN 'path' WHEN 1 THEN 'symbol' ELSE 'scip_moniker' END AS kind, doc_id || '#' || k AS binding_id, path, CASE WHEN doc_id % 7 < 2 THEN 'gone' WHEN (doc_id + k) % 7 = 2 THEN 'stale' WHEN (doc_id + k) % 7 = 3 THEN 'pending' ELSE 'current' END AS anchor_status FROM documents JOIN fp ON fp.id = doc_id, (SELECT unnest([0, 1]) AS k)),
sy AS (SELECT DISTINCT path, 'fn' || (c.id % 150) AS name FROM chunks c JOIN fp ON fp.id = c.file_id WHERE symbol_path IS NOT NULL AND c.id % 4 = 0), pa AS (SELECT DISTINCT path FROM files UNION SELECT 'x/src/a3/b.rs' UNION SELECT 'src/a5/b.rs'),
sx AS (SELECT DISTINCT array_to_string(a[k:], '/') AS suffix FROM (SELECT a, unnest(range(1, len(a) + 1)) AS k FROM (SELECT string_split(path, '/') AS a FROM pa))),
it AS (SELECT note_id, unnest(list_distinct(list_concat(list_filter(list_transform(regexp_extract_all(coalesce(title, '') || chr(10) || body, '`([^`]+)`', 1), lambda x: trim(x, ' ')), lambda x: x <> '' AND NOT contains(x, chr(10))), list_filter(regexp_extract_all(coalesce(title, '') || chr(10) || body, '\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\b'), lambda x: length(x) >= 8)))) AS identifier FROM n),
rl AS (SELECT note_id, CASE WHEN note_id % 3 = 0 THEN 'diverged' ELSE 'holds' END AS verdict, CASE WHEN note_id % 2 = 0 THEN 'code_moved' END AS direction, CASE WHEN note_id % 10 = 0 THEN 'old' ELSE sha256(coalesce(title, '') || chr(31) || body) END AS ch, 'h' || (note_id % 8) AS ih, CASE WHEN note_id % 11 = 0 THEN 'p1' ELSE 'p2' END AS pv FROM n WHERE note_id % 4 <> 3),
nw AS (SELECT note_id, status, sha256(coalesce(title, '') || chr(31) || body) AS nc, CASE WHEN note_id % 14 = 0 THEN 'hx' ELSE 'h' || (note_id % 8) END AS ni FROM n)"""
SQL = {
    "notes_hydrated": f"""{_N}, x AS (SELECT note_id, string_agg(concat_ws(':', kind, coalesce(path, ''), anchor_status), ',' ORDER BY concat_ws(':', kind, coalesce(path, ''), anchor_status)) AS bindings FROM b GROUP BY 1), g AS (SELECT DISTINCT doc_id AS note_id, unnest([lang, source]) AS tag FROM documents), y AS (SELECT note_id, string_agg(tag, ',' ORDER BY tag) AS tags FROM g WHERE tag IS NOT NULL GROUP BY 1)
SELECT n.note_id, n.kind, title, status, coalesce(bindings, '') AS bindings, coalesce(tags, '') AS tags FROM n LEFT JOIN x USING (note_id) LEFT JOIN y USING (note_id)""",
    "note_lanes": f"""{_N}, p AS (SELECT note_id, status, 'direct' AS lane, row_number() OVER (ORDER BY note_id) AS k FROM n WHERE note_id % 10 = 3 UNION ALL SELECT note_id, status, 'path_crossed', row_number() OVER (ORDER BY note_id) FROM n WHERE note_id % 14 = 3 UNION ALL SELECT note_id, status, 'call_path_crossed', row_number() OVER (ORDER BY note_id) FROM n WHERE note_id % 22 = 3)
SELECT DISTINCT note_id, CASE WHEN status = 'active' THEN lane ELSE 'stale' END AS lane FROM p WHERE k <= 12""",
    "note_doctor": f"""{_N}, c AS (SELECT path, string_agg(name, ',' ORDER BY name) AS candidates FROM sy GROUP BY path)
SELECT b.note_id, b.kind, binding_id, anchor_status, coalesce(candidates, '') AS candidates FROM b JOIN n ON n.note_id = b.note_id AND status = 'active' LEFT JOIN c ON c.path = b.path WHERE anchor_status IN ('gone', 'stale', 'pending') AND b.kind <> 'scip_moniker'
UNION ALL SELECT note_id, 'repo', repo_id, 'placeholder_repo', '' FROM n WHERE status IN ('active', 'stale') AND repo_id = '2aab7ed572604b0586ae7bb149b3f422'""",
    "anchor_health": f"{_N} SELECT anchor_status, count(*) AS n FROM b JOIN n USING (note_id) WHERE status = 'active' AND b.kind <> 'scip_moniker' GROUP BY 1",
    "note_edges_now": """WITH e AS (SELECT doc_id AS edge_id, CASE WHEN doc_id % 8 = 0 THEN 'path' ELSE 'node' END AS k, doc_id * 2 AS t, CASE doc_id % 3 WHEN 0 THEN 'current' WHEN 1 THEN 'gone' ELSE 'unresolved' END AS st FROM documents)
SELECT edge_id, CASE WHEN k = 'node' AND d.doc_id IS NOT NULL THEN coalesce(d.repo_id, '__unassigned__') ELSE 'hint' END AS target_repo_id, CASE WHEN k = 'node' THEN d.doc_id END AS target_note_id, CASE WHEN k <> 'node' THEN st WHEN d.doc_id IS NOT NULL THEN 'current' WHEN st IN ('current', 'gone') THEN 'gone' ELSE 'unresolved' END AS anchor_status FROM e LEFT JOIN documents d ON d.doc_id = t""",
    "note_identifiers": f"{_N} SELECT note_id, identifier FROM it",
    "stale_references": rf"""{_N}, r AS (SELECT note_id, unnest(list_distinct(list_filter(regexp_extract_all(body, '(?:[/:]|\b)(?:crates|apps|tools|src)/[\w./-]+\.rs\b'), lambda x: NOT regexp_matches(x, '^[/:]')))) AS p FROM n WHERE status IN ('active', 'stale'))
SELECT note_id, string_agg(p, ', ' ORDER BY p) AS missing FROM r WHERE p NOT IN (SELECT suffix FROM sx) GROUP BY note_id""",
    "unverifiable_notes": f"""{_N}, o AS (SELECT * FROM n WHERE status = 'active' AND NOT EXISTS (SELECT 1 FROM b WHERE b.note_id = n.note_id AND b.kind <> 'scip_moniker' AND anchor_status <> 'gone') AND (n.kind <> 'comment' OR EXISTS (SELECT 1 FROM b WHERE b.note_id = n.note_id))),
k AS (SELECT note_id FROM it WHERE string_split(identifier, '::')[-1] IN (SELECT name FROM sy) OR identifier IN (SELECT suffix FROM sx)) SELECT o.note_id, (SELECT count(*) FROM it WHERE it.note_id = o.note_id) AS n_identifiers FROM o WHERE o.note_id NOT IN (SELECT note_id FROM k)""",
    "dependents_of_dead": f"""{_N}, st AS (SELECT n.note_id, status, CASE WHEN status IN ('obsolete', 'rejected') THEN status WHEN count(binding_id) > 0 AND count(binding_id) = count(*) FILTER (anchor_status = 'gone') THEN 'anchored only to code that is gone' END AS reason FROM n LEFT JOIN b USING (note_id) GROUP BY note_id, status),
l AS (SELECT DISTINCT note_id, parent FROM (SELECT note_id, unnest([note_id - note_id % 5, note_id // 2, note_id - 1]) AS parent FROM n WHERE note_id % 5 <> 0 AND status IN ('active', 'stale')) WHERE note_id <> parent), dd AS (SELECT note_id, reason FROM st WHERE reason IS NOT NULL),
rs(note_id) AS (SELECT l.note_id FROM l JOIN dd ON dd.note_id = parent UNION SELECT l.note_id FROM rs JOIN l ON l.parent = rs.note_id),
fi AS (SELECT l.note_id, min(parent) AS via FROM l WHERE parent IN (SELECT note_id FROM dd) OR parent IN (SELECT note_id FROM rs) GROUP BY 1),
w(note_id, via, node) AS (SELECT note_id, via, via FROM fi UNION ALL SELECT w.note_id, w.via, fi.via FROM w JOIN fi ON fi.note_id = w.node WHERE w.node NOT IN (SELECT note_id FROM dd))
SELECT w.note_id, w.via, w.node AS root, dd.reason FROM w JOIN dd ON dd.note_id = w.node JOIN st ON st.note_id = w.note_id AND st.reason IS NULL WHERE NOT (w.note_id % 9 = 0 AND w.node = w.note_id - 1)""",
    "duplicate_findings": f"""{_N}, lv AS (SELECT note_id FROM n WHERE status IN ('active', 'stale')), p AS (SELECT DISTINCT least(l_orderkey, l_partkey % 900) AS a, greatest(l_orderkey, l_partkey % 900) AS b2 FROM lineitem WHERE l_orderkey < 3000 AND l_orderkey % 3 = 0 AND l_orderkey <> l_partkey % 900),
f AS (SELECT DISTINCT least(event_id % 1000, user_id % 1000) AS a, greatest(event_id % 1000, user_id % 1000) AS b2 FROM events WHERE event_type <> 'error' AND event_id % 1000 <> user_id % 1000),
x AS (SELECT a, b2, 'near' AS origin FROM p UNION ALL SELECT a, b2, 'kept' FROM f WHERE NOT (a IN (SELECT note_id FROM n WHERE note_id % 2 = 0) AND b2 IN (SELECT note_id FROM n WHERE note_id % 2 = 0)) AND NOT EXISTS (SELECT 1 FROM p WHERE p.a = f.a AND p.b2 = f.b2))
SELECT a || '|' || b2 AS subject, origin FROM x WHERE a IN (SELECT note_id FROM lv) AND b2 IN (SELECT note_id FROM lv)""",
    "divergent_notes": f"{_N} SELECT note_id, coalesce(direction, 'unknown') AS direction FROM rl JOIN nw USING (note_id) WHERE verdict = 'diverged' AND pv = 'p2' AND status = 'active' AND ch = nc AND ih = ni",
    "verification_queue": f"""{_N}, q AS (SELECT nw.note_id, rl.note_id IS NOT NULL AS known, ch IS DISTINCT FROM nc AS t, ih IS DISTINCT FROM ni AS p, pv IS DISTINCT FROM 'p2' AS a, EXISTS (SELECT 1 FROM b WHERE b.note_id = nw.note_id AND anchor_status IN ('gone', 'stale') AND kind <> 'scip_moniker') AS broken FROM nw LEFT JOIN rl USING (note_id) WHERE status = 'active'),
r AS (SELECT note_id, CASE WHEN broken THEN 'anchor_broken' WHEN NOT known THEN 'never_checked' WHEN t THEN 'content_changed' WHEN p THEN 'inputs_changed' ELSE 'prompt_changed' END AS reason FROM q WHERE NOT known OR t OR p OR a),
k AS (SELECT *, CAST(CASE reason WHEN 'anchor_broken' THEN 1 WHEN 'never_checked' THEN 0.75 WHEN 'content_changed' THEN 0.5 WHEN 'inputs_changed' THEN 0.25 ELSE 0.2 END AS DOUBLE) AS rank FROM r) SELECT *, CAST(row_number() OVER (ORDER BY rank DESC, note_id) AS INTEGER) AS place FROM k""",
}

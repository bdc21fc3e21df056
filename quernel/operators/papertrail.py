"""Threads of a tracker: search with one answer a record, references in prose, what a thread is, and which records to distil."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernel.functions.exprs import ascii_lower, round4
from quernel.operators.search import QUERY, bm25
from quernel.plans.ranks import top_ranked
from quernel.sources.tables import table

#: Words before a reference that give it a kind; others are ``unknown`` (fixed values).
CLOSING = ("fix", "fixes", "fixed", "close", "closes", "closed", "resolve", "resolves", "resolved")
REVERTS, REFERENCE = ("reverts", "reverted"), ("refs", "ref", "see", "related")
#: Labels of a text by the first class that has one of its words; ``context`` without one (fixed values).
TEXT_CLASSES = (
    ("decision", ("decided", "decision", "we will")), ("rejected_alternative", ("rejected", "alternative", "instead")), ("constraint", ("must", "constraint", "required")),
    ("risk", ("risk", "concern", "blocked")), ("obsolete", ("obsolete", "deprecated", "no longer")),
)
#: A thread is thin below so many characters of body and comments (fixed values).
THIN_BODY, THIN_COMMENTS, LEAST_REVIEWS = 400, 1, 2
_BREAKS, _EDGE = r"[\s,;)\]}]+", r"""^[(\[{.:'"]+|[(\[{.:'"]+$"""


def search(docs: DataFrame, query: str, limit: int, doc_kind: str | None = None) -> DataFrame:
    """(doc_id, rank, score): the best documents (doc_id, text, doc_kind), of one kind if given; score 1 / sqrt(rank)."""
    own = docs if doc_kind is None else docs.where(F.col("doc_kind") == doc_kind)
    return bm25(own.select("doc_id", "text"), query, limit).select("doc_id", "rank", round4(1 / F.sqrt(F.col("rank").cast("double"))).alias("score"))


def coalesced(hits: DataFrame, records: DataFrame) -> DataFrame:
    """Hits (doc_id, rank, ...) without those whose record an earlier hit stands for; ``records``: doc_id, record. Hits without a record stay.

    A record's representative is its best hit's thread; ``records`` may give a thread key, so that all hits of that thread stay.
    """
    rows = hits.join(records.select("doc_id", "record", F.coalesce("thread", F.col("doc_id").cast("string")).alias("thread")), "doc_id", "left")
    first = rows.where("record is not null").groupBy("record").agg(F.min_by("thread", "rank").alias("first"))
    return rows.join(F.broadcast(first), "record", "left").where(F.col("record").isNull() | (F.col("thread") == F.col("first"))).drop("first", "thread")


def issue_search(docs: DataFrame, records: DataFrame, query: str, limit: int, doc_kind: str | None = None, over: int = 4) -> DataFrame:
    """(doc_id, record, score, rank): ``over`` x ``limit`` hits, one answer a record, the best ``limit`` of them."""
    kept = coalesced(search(docs, query, over * limit, doc_kind), records)
    return top_ranked(kept.withColumnRenamed("rank", "place"), limit, "place").select("doc_id", "record", "score", "rank")


def ref_kind(previous) -> Column:
    low = ascii_lower(previous)
    return F.when(low.isin(*CLOSING), "closing").when(low.isin(*REVERTS), "reverts").when(low.isin(*REFERENCE), "reference").otherwise("unknown")


def _number(text) -> Column:
    """A number of 1 to 10 digits without a leading zero, else null."""
    return F.when(text.rlike(r"^[1-9][0-9]{0,9}$"), text.cast("bigint"))


def parse_refs(texts: DataFrame, project: str, url_base: str) -> DataFrame:
    """(doc_id, pos, project, number, shape, ref_kind): references in texts (doc_id, text) whose own project is ``project``.

    Tokens end at blanks and , ; ) ] }; brackets, dots, colons and quotes at their ends fall away, then ! and ? behind. A token is an
    address of an issue or pull under ``url_base``, owner/repo#number, GH-number or #number; the word before gives the kind.
    """
    trimmed = F.transform(F.split("text", _BREAKS), lambda t: F.regexp_replace(F.regexp_replace(t, _EDGE, ""), "[!?]+$", ""))
    tokens = texts.where("text is not null").select("doc_id", F.filter(trimmed, lambda t: t != "").alias("tokens"))
    rows = tokens.select("doc_id", "tokens", F.posexplode("tokens").alias("pos", "token")).where(F.col("token").contains("#") | F.col("token").startswith("GH-") | F.col("token").startswith(url_base))
    previous = F.when(F.col("pos") > 0, F.col("tokens")[F.col("pos") - 1]).otherwise("")
    path = F.split(F.substr(F.col("token"), F.lit(len(url_base) + 2)), "/")
    is_url = F.col("token").startswith(url_base + "/") & (F.size(path) >= 4) & F.element_at(path, 3).isin("issues", "pull")
    cross = F.split(F.substring_index("token", "#", 1), "/")
    is_cross = F.col("token").contains("#") & (F.size(cross) == 2)
    after = F.expr("substr(token, instr(token, '#') + 1)")
    dash, local = F.col("token").startswith("GH-"), F.col("token").startswith("#")
    found = (
        F.when(is_url, F.struct(F.concat_ws("/", F.element_at(path, 1), F.element_at(path, 2)).alias("project"), _number(F.element_at(path, 4)).alias("number"), F.lit("url").alias("shape")))
        .when(is_cross, F.struct(F.substring_index("token", "#", 1).alias("project"), _number(after).alias("number"), F.lit("cross_repo").alias("shape")))
        .when(dash, F.struct(F.lit(project).alias("project"), _number(F.substr(F.col("token"), F.lit(4))).alias("number"), F.lit("gh_dash").alias("shape")))
        .when(local, F.struct(F.lit(project).alias("project"), _number(after).alias("number"), F.lit("local_number").alias("shape")))
    )
    rows = rows.withColumn("r", found).withColumn("ref_kind", ref_kind(previous)).where("r.number is not null")
    return rows.select("doc_id", "pos", "r.project", "r.number", "r.shape", "ref_kind")


def refs_for_path(refs: DataFrame, limit: int, paths: DataFrame | None = None) -> DataFrame:
    """(source_path, ref_id, number, rank): the newest ``limit`` references from each path, or from those of ``paths`` (source_path)."""
    own = refs if paths is None else refs.join(paths.select("source_path").distinct(), "source_path", "left_semi")
    place = Window.partitionBy("source_path").orderBy(F.desc("ref_id"))
    return own.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= limit).select("source_path", "ref_id", "number", "rank")


def refs_for_commit(refs: DataFrame, prefix: str, limit: int) -> DataFrame:
    """(ref_id, number, ref_kind, rank): references of commits whose hash starts with ``prefix``; closing ones first, then the newest."""
    own = refs.where(F.col("source_commit").startswith(prefix))
    return top_ranked(own, limit, (F.col("ref_kind") != "closing").cast("int"), F.desc("ref_id")).select("ref_id", "number", "ref_kind", "rank")


def classify_text(documents: DataFrame) -> DataFrame:
    """(doc_id, label): the first class with a word in the lower-cased text, ``context`` without one, null for a null text."""
    low = ascii_lower(F.col("text"))
    label = F.when(F.col("text").isNull(), F.lit(None))
    for name, words in TEXT_CLASSES:
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        label = label.when(hit, name)
    return documents.select("doc_id", label.otherwise("context").alias("label"))


def thread_shapes(comments: DataFrame) -> DataFrame:
    """(thread, n_comments, n_reviews, body_len, shape) of rows (thread, kind, body_len): comments and reviews count, other rows are the body.

    ``thin``: at most one comment and a body below 400; ``review_stream``: two reviews at least, and half of the comments; else ``investigation``.
    """
    is_comment, is_review = F.col("kind").isin("comment", "review"), F.col("kind") == "review"
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("bigint"))
    out = comments.groupBy("thread").agg(n(is_comment).alias("n_comments"), n(is_review).alias("n_reviews"), F.coalesce(F.max(F.when(~F.coalesce(is_comment, F.lit(False)), F.col("body_len"))), F.lit(0)).alias("body_len"))
    shape = F.when((F.col("n_comments") <= THIN_COMMENTS) & (F.col("body_len") < THIN_BODY), "thin").when((F.col("n_reviews") >= LEAST_REVIEWS) & (F.col("n_reviews") * 2 >= F.col("n_comments")), "review_stream").otherwise("investigation")
    return out.withColumn("shape", shape)


def outcome_verified(claims: DataFrame) -> DataFrame:
    """(thread, verified): a claim of having landed needs a fix edge or a closing word; other claims (thread, status, fix_edge, closing_word) stand."""
    return claims.select("thread", F.when(F.col("status") == "landed", F.coalesce(F.col("fix_edge") | F.col("closing_word"), F.lit(False))).otherwise(True).alias("verified"))


def plan_records(items: DataFrame, edges: DataFrame) -> DataFrame:
    """(project, kind, key, partners, fix_shas, source, text_closing): what to distil.

    Every closed issue, with the merged change requests of its project that closed it and the commits of those and of commits that did;
    then every merged change request that no issue took. ``items``: project, kind, key, state, merge_sha; ``edges``: project, issue_key,
    closer_kind, closer_key, closer_commit, source (``provider`` is stronger than ``text``).
    """
    issues = items.where("kind = 'issue' and state = 'closed'").select("project", F.col("key").alias("issue_key")).distinct()
    merged = items.where("kind = 'change_request' and state = 'merged'").groupBy("project", "key").agg(F.max("merge_sha").alias("merge_sha"))
    own = edges.join(issues, ["project", "issue_key"])
    by_commit = own.where("closer_kind = 'commit'").select("project", "issue_key", F.lit(None).cast("string").alias("partner"), F.col("closer_key").alias("sha"), "source")
    by_request = own.where("closer_kind = 'change_request'").join(merged.withColumnRenamed("key", "closer_key"), ["project", "closer_key"]).select("project", "issue_key", F.col("closer_key").alias("partner"), F.coalesce("closer_commit", "merge_sha").alias("sha"), "source")
    every = by_commit.unionByName(by_request)
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    facts = every.groupBy("project", "issue_key").agg(joined("partner").alias("partners"), joined("sha").alias("fix_shas"), F.max((F.col("source") == "provider").cast("int")).alias("p"), F.max((F.col("source") == "text").cast("int")).alias("t"))
    source = F.when(F.col("p") == 1, "provider").when(F.col("t") == 1, "text").otherwise("none")
    plans = issues.join(facts, ["project", "issue_key"], "left").select("project", F.lit("issue").alias("kind"), F.col("issue_key").alias("key"), F.coalesce("partners", F.lit("")).alias("partners"), F.coalesce("fix_shas", F.lit("")).alias("fix_shas"), source.alias("source"), F.coalesce(F.col("t") == 1, F.lit(False)).alias("text_closing"))
    taken = by_request.select("project", F.col("partner").alias("key")).distinct()
    rest = merged.join(taken, ["project", "key"], "left_anti").select("project", F.lit("change_request").alias("kind"), "key", F.lit("").alias("partners"), F.coalesce("merge_sha", F.lit("")).alias("fix_shas"), F.lit("provider").alias("source"), F.lit(False).alias("text_closing"))
    return plans.unionByName(rest)


_FENCE = re.compile(r" {0,3}(```+|~~~+)")


def segment_blocks(text: str) -> list[tuple[int, int]]:
    """Trimmed spans of the blocks of a text: fenced code, heading lines, and runs of other lines without a blank one between them."""
    spans, start, end, fence, at = [], None, 0, None, 0

    def close() -> None:
        nonlocal start
        if start is not None:
            raw = text[start:end]
            if raw.strip():
                spans.append((start + len(raw) - len(raw.lstrip()), start + len(raw.rstrip())))
            start = None

    for line in text.splitlines(keepends=True):
        m = _FENCE.match(line)
        if fence:
            end = at + len(line)
            if m and m.group(1).startswith(fence) and not line.strip().strip(fence[0]):
                close()
                fence = None
        elif m:
            close()
            start, end, fence = at, at + len(line), m.group(1)
        elif not line.strip():
            close()
        elif re.match(r" {0,3}#{1,6}(\s|$)", line):
            close()
            start, end = at, at + len(line)
            close()
        else:
            start, end = at if start is None else start, at + len(line)
        at += len(line)
    close()
    return spans


def tail_aware_budget(lengths: list[int], most: int) -> list[int]:
    """Which units to keep within ``most`` in all: the first, then units from the end while they fit, else the next from the front."""
    if sum(lengths) <= most:
        return list(range(len(lengths)))
    head, tail, kept = 1, 0, lengths[0]
    while head + tail < len(lengths):
        last = len(lengths) - 1 - tail
        if kept + lengths[last] <= most:
            kept, tail = kept + lengths[last], tail + 1
        elif head != last and kept + lengths[head] <= most:
            kept, head = kept + lengths[head], head + 1
        else:
            break
    return [*range(head), *range(len(lengths) - tail, len(lengths))]


def budgeted_units(documents: DataFrame, most: int) -> DataFrame:
    """(doc_id, unit, start, end, kept) of the blocks of each text (doc_id, text), and whether ``most`` characters leave room for them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, text in zip(b.doc_id, b.text, strict=True):
                spans = segment_blocks(text or "")
                kept = set(tail_aware_budget([e - s for s, e in spans], most)) if spans else set()
                out += [(doc, k, s, e, k in kept) for k, (s, e) in enumerate(spans)]
            yield pd.DataFrame(out, columns=["doc_id", "unit", "start", "end", "kept"]).astype({"kept": "bool"})

    return documents.select("doc_id", "text").mapInPandas(run, "doc_id bigint, unit int, start bigint, end bigint, kept boolean")


def best_bindings(bindings: DataFrame) -> DataFrame:
    """(note_id, kind, path, line): the binding that stands for a note: priority, one with a line, line, age, kind, path."""
    place = Window.partitionBy("note_id").orderBy("priority", F.col("line").isNull(), "line", "created_at_ms", "kind", F.coalesce("path", F.lit("")))
    return bindings.withColumn("_k", F.row_number().over(place)).where("_k = 1").select("note_id", "kind", "path", "line")


# -- the given tables as threads
def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", "text", "doc_kind", "repo_id", "source")


def _records(s, d):
    own = _docs(s, d).where("doc_id % 3 <> 0")
    return own.select("doc_id", F.concat_ws("/", F.coalesce("repo_id", F.lit("-")), "source").alias("record"), F.lit(None).cast("string").alias("thread"))


def _with_refs(s, d):
    i = F.col("doc_id")
    tail = F.concat(F.lit("\n(Fixes #"), (i % 50).cast("string"), F.lit("), see acme/tools#"), (i % 7).cast("string"), F.lit("; closes GH-"), (i % 9).cast("string"), F.lit(". Reverts https://git.example/a/b/pull/"), (i + 1).cast("string"), F.lit("/files! related: [#"), (i % 13).cast("string"), F.lit("] a#1 #x #007"))
    return table(s, d, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), tail).alias("text"))


def _refs(s, d):
    rows = parse_refs(_with_refs(s, d), "acme/core", "https://git.example")
    files = table(s, d, "files").groupBy(F.col("id").alias("doc_id")).agg(F.min("path").alias("source_path"), F.max("commit_sha").alias("source_commit"))
    return rows.join(files, "doc_id").select((F.col("doc_id") * 100_000 + F.col("pos")).alias("ref_id"), "number", "ref_kind", "source_path", "source_commit")


def _items(s, d):
    o = table(s, d, "orders")
    kind = F.when(F.col("o_orderkey") % 2 == 0, "issue").otherwise("change_request")
    state = F.when(F.col("o_orderstatus") != "F", "open").when(F.col("o_orderkey") % 2 == 0, "closed").otherwise("merged")
    return o.select((F.col("o_custkey") % 5).cast("string").alias("project"), kind.alias("kind"), F.col("o_orderkey").cast("string").alias("key"), state.alias("state"), F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("m"), F.col("o_orderkey").cast("string"))).alias("merge_sha"))


def _edges(s, d):
    l, o = table(s, d, "lineitem"), table(s, d, "orders").select("o_orderkey", (F.col("o_custkey") % 5).cast("string").alias("project"))
    rows = l.where("l_orderkey % 2 = 0").join(o, l["l_orderkey"] == o["o_orderkey"])
    commit = F.col("l_linenumber") % 3 == 0
    return rows.select("project", F.col("l_orderkey").cast("string").alias("issue_key"), F.when(commit, "commit").otherwise("change_request").alias("closer_kind"), F.when(commit, F.concat(F.lit("c"), F.col("l_partkey").cast("string"))).otherwise((F.col("l_orderkey") + 2 * F.col("l_linenumber") - 5).cast("string")).alias("closer_key"), F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit("k"), F.col("l_suppkey").cast("string"))).alias("closer_commit"), F.when(F.col("l_returnflag") == "R", "provider").otherwise("text").alias("source"))


def _note_bindings(s, d):
    i = F.col("event_id")
    return table(s, d, "events").select(F.col("user_id").alias("note_id"), F.col("event_type").alias("kind"), F.when(i % 5 != 0, F.concat(F.lit("p"), (i % 30).cast("string"))).alias("path"), F.when(i % 4 != 0, i % 90).alias("line"), (i % 3).alias("priority"), i.alias("created_at_ms"))


QUERIES = {
    "thread_search": lambda s, d: search(_docs(s, d), QUERY, 60, "issue"),
    "issue_search": lambda s, d: issue_search(_docs(s, d).where("doc_kind in ('issue', 'comment', 'review')"), _records(s, d), QUERY, 25),
    "tracker_refs": lambda s, d: parse_refs(_with_refs(s, d), "acme/core", "https://git.example"),
    "commit_refs": lambda s, d: refs_for_commit(_refs(s, d), "a", 30),
    "path_refs": lambda s, d: refs_for_path(_refs(s, d), 3),
    "classify_text": lambda s, d: classify_text(table(s, d, "documents")),
    "thread_shapes": lambda s, d: thread_shapes(table(s, d, "documents").where("repo_id is not null").select(F.concat_ws("/", "repo_id", "source").alias("thread"), F.col("doc_kind").alias("kind"), F.col("n_chars").alias("body_len"))),
    "outcome_verified": lambda s, d: outcome_verified(_items(s, d).select(F.col("key").alias("thread"), F.when(F.col("state") == "merged", "landed").otherwise("open").alias("status"), F.col("merge_sha").isNotNull().alias("fix_edge"), (F.col("project") == "1").alias("closing_word"))),
    "distill_plan": lambda s, d: plan_records(_items(s, d), _edges(s, d)),
    "budgeted_units": lambda s, d: budgeted_units(table(s, d, "documents"), 1_000),
    "best_bindings": lambda s, d: best_bindings(_note_bindings(s, d)),
}


def _bm(where: str, limit: int) -> str:
    return f"""t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\p{{L}}\\p{{N}}_-]+'), lambda x: x <> '') AS t FROM documents WHERE {where}), z AS (SELECT doc_id, coalesce(len(t), 0) AS len, list_filter(t, lambda x: x IN ('stale', 'shard', 'manifest')) AS hits FROM t),
st AS (SELECT count(*) AS n, avg(len) AS avg_len FROM z), m AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len, unnest(hits) AS term FROM z) GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM m GROUP BY term),
bm AS (SELECT doc_id, floor(sum(greatest(ln((n - df + CAST(0.5 AS DOUBLE)) / (df + CAST(0.5 AS DOUBLE)) + 1), CAST(1e-6 AS DOUBLE)) * tf * CAST(2.2 AS DOUBLE) / (tf + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * len / avg_len))) * 10000 + 0.5) / 10000 AS s FROM m JOIN f USING (term), st GROUP BY doc_id),
b AS (SELECT doc_id, rank, floor(1 / sqrt(rank) * 10000 + 0.5) / 10000 AS score FROM (SELECT doc_id, CAST(row_number() OVER (ORDER BY s DESC, doc_id) AS INTEGER) AS rank FROM bm) WHERE rank <= {limit})"""


_REFS = r"""WITH w AS (SELECT doc_id, coalesce(text, '') || chr(10) || '(Fixes #' || (doc_id % 50) || '), see acme/tools#' || (doc_id % 7) || '; closes GH-' || (doc_id % 9) || '. Reverts https://git.example/a/b/pull/' || (doc_id + 1) || '/files! related: [#' || (doc_id % 13) || '] a#1 #x #007' AS text FROM documents),
k AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[\s,;)\]}]+'), lambda t: regexp_replace(regexp_replace(t, '^[(\[{.:''"]+|[(\[{.:''"]+$', '', 'g'), '[!?]+$', '')), lambda t: t <> '') AS a FROM w),
p AS (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM k), q AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, a[i] AS t, CASE WHEN i > 1 THEN lower(a[i - 1]) ELSE '' END AS prev FROM p),
u AS (SELECT *, string_split(substr(t, 21), '/') AS parts, string_split(string_split(t, '#')[1], '/') AS cr FROM q),
v AS (SELECT doc_id, pos, prev, CASE WHEN t LIKE 'https://git.example/%' AND len(parts) >= 4 AND parts[3] IN ('issues', 'pull') THEN 'url' WHEN contains(t, '#') AND len(cr) = 2 THEN 'cross_repo' WHEN t LIKE 'GH-%' THEN 'gh_dash' WHEN t LIKE '#%' THEN 'local_number' END AS shape, t, parts FROM u),
x AS (SELECT *, CASE shape WHEN 'url' THEN parts[4] WHEN 'gh_dash' THEN substr(t, 4) ELSE substr(t, strpos(t, '#') + 1) END AS num FROM v WHERE shape IS NOT NULL),
refs AS (SELECT doc_id, pos, CASE shape WHEN 'url' THEN parts[1] || '/' || parts[2] WHEN 'cross_repo' THEN string_split(t, '#')[1] ELSE 'acme/core' END AS project, CAST(num AS BIGINT) AS number, shape,
  CASE WHEN prev IN ('fix', 'fixes', 'fixed', 'close', 'closes', 'closed', 'resolve', 'resolves', 'resolved') THEN 'closing' WHEN prev IN ('reverts', 'reverted') THEN 'reverts' WHEN prev IN ('refs', 'ref', 'see', 'related') THEN 'reference' ELSE 'unknown' END AS ref_kind FROM x WHERE regexp_matches(num, '^[1-9][0-9]{0,9}$')),
rf AS (SELECT doc_id * 100000 + pos AS ref_id, number, ref_kind, source_path, source_commit FROM refs JOIN (SELECT id AS doc_id, min(path) AS source_path, max(commit_sha) AS source_commit FROM files GROUP BY id) USING (doc_id))"""
_ITEMS = """WITH i AS (SELECT CAST(o_custkey % 5 AS VARCHAR) AS project, CASE WHEN o_orderkey % 2 = 0 THEN 'issue' ELSE 'change_request' END AS kind, CAST(o_orderkey AS VARCHAR) AS key, CASE WHEN o_orderstatus <> 'F' THEN 'open' WHEN o_orderkey % 2 = 0 THEN 'closed' ELSE 'merged' END AS state, CASE WHEN o_orderkey % 3 <> 0 THEN 'm' || o_orderkey END AS merge_sha FROM orders)"""
SQL = {
    "thread_search": f"WITH {_bm(chr(100) + 'oc_kind = ' + chr(39) + 'issue' + chr(39), 60)} SELECT * FROM b",
    "issue_search": f"""WITH {_bm("doc_kind IN ('issue', 'comment', 'review')", 100)}, r AS (SELECT b.*, CASE WHEN doc_id % 3 <> 0 THEN concat_ws('/', coalesce(repo_id, '-'), source) END AS record FROM b JOIN documents USING (doc_id)),
k AS (SELECT * FROM r WHERE record IS NULL OR rank = (SELECT min(rank) FROM r q WHERE q.record = r.record)), o AS (SELECT doc_id, record, score, CAST(row_number() OVER (ORDER BY rank) AS INTEGER) AS rank FROM k) SELECT * FROM o WHERE rank <= 25""",
    "tracker_refs": f"{_REFS} SELECT * FROM refs",
    "commit_refs": f"{_REFS}, o AS (SELECT ref_id, number, ref_kind, CAST(row_number() OVER (ORDER BY CASE WHEN ref_kind = 'closing' THEN 0 ELSE 1 END, ref_id DESC) AS INTEGER) AS rank FROM rf WHERE source_commit LIKE 'a%') SELECT * FROM o WHERE rank <= 30",
    "path_refs": f"{_REFS}, o AS (SELECT source_path, ref_id, number, CAST(row_number() OVER (PARTITION BY source_path ORDER BY ref_id DESC) AS INTEGER) AS rank FROM rf) SELECT * FROM o WHERE rank <= 3",
    "classify_text": """WITH t AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents) SELECT doc_id, CASE WHEN t IS NULL THEN NULL WHEN contains(t, 'decided') OR contains(t, 'decision') OR contains(t, 'we will') THEN 'decision' WHEN contains(t, 'rejected') OR contains(t, 'alternative') OR contains(t, 'instead') THEN 'rejected_alternative'
  WHEN contains(t, 'must') OR contains(t, 'constraint') OR contains(t, 'required') THEN 'constraint' WHEN contains(t, 'risk') OR contains(t, 'concern') OR contains(t, 'blocked') THEN 'risk' WHEN contains(t, 'obsolete') OR contains(t, 'deprecated') OR contains(t, 'no longer') THEN 'obsolete' ELSE 'context' END AS label FROM t""",
    "thread_shapes": """WITH t AS (SELECT concat_ws('/', repo_id, source) AS thread, count(*) FILTER (doc_kind IN ('comment', 'review')) AS n_comments, count(*) FILTER (doc_kind = 'review') AS n_reviews, coalesce(max(CASE WHEN coalesce(doc_kind, '') NOT IN ('comment', 'review') THEN n_chars END), 0) AS body_len FROM documents WHERE repo_id IS NOT NULL GROUP BY 1)
SELECT *, CASE WHEN n_comments <= 1 AND body_len < 400 THEN 'thin' WHEN n_reviews >= 2 AND n_reviews * 2 >= n_comments THEN 'review_stream' ELSE 'investigation' END AS shape FROM t""",
    "outcome_verified": f"{_ITEMS} SELECT key AS thread, CASE WHEN state = 'merged' THEN merge_sha IS NOT NULL OR project = '1' ELSE true END AS verified FROM i",
    "distill_plan": f"""{_ITEMS}, e AS (SELECT CAST(o_custkey % 5 AS VARCHAR) AS project, CAST(l_orderkey AS VARCHAR) AS issue_key, CASE WHEN l_linenumber % 3 = 0 THEN 'commit' ELSE 'change_request' END AS closer_kind, CASE WHEN l_linenumber % 3 = 0 THEN 'c' || l_partkey ELSE CAST(l_orderkey + 2 * l_linenumber - 5 AS VARCHAR) END AS closer_key,
  CASE WHEN l_suppkey % 2 = 0 THEN 'k' || l_suppkey END AS closer_commit, CASE WHEN l_returnflag = 'R' THEN 'provider' ELSE 'text' END AS source FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_orderkey % 2 = 0),
ci AS (SELECT DISTINCT project, key FROM i WHERE kind = 'issue' AND state = 'closed'), mp AS (SELECT project, key, max(merge_sha) AS merge_sha FROM i WHERE kind = 'change_request' AND state = 'merged' GROUP BY ALL),
x AS (SELECT e.project, issue_key, NULL AS partner, closer_key AS sha, source FROM e JOIN ci ON ci.project = e.project AND ci.key = issue_key WHERE closer_kind = 'commit' UNION ALL SELECT e.project, issue_key, closer_key, coalesce(closer_commit, merge_sha), source FROM e JOIN ci ON ci.project = e.project AND ci.key = issue_key JOIN mp ON mp.project = e.project AND mp.key = closer_key WHERE closer_kind = 'change_request'),
g AS (SELECT project, issue_key, coalesce(string_agg(DISTINCT partner, ',' ORDER BY partner), '') AS partners, coalesce(string_agg(DISTINCT sha, ',' ORDER BY sha), '') AS fix_shas, max(source = 'provider') AS p, max(source = 'text') AS t FROM x GROUP BY ALL)
SELECT ci.project, 'issue' AS kind, ci.key, coalesce(partners, '') AS partners, coalesce(fix_shas, '') AS fix_shas, CASE WHEN p THEN 'provider' WHEN t THEN 'text' ELSE 'none' END AS source, coalesce(t, false) AS text_closing FROM ci LEFT JOIN g ON g.project = ci.project AND g.issue_key = ci.key
UNION ALL SELECT project, 'change_request', key, '', coalesce(merge_sha, ''), 'provider', false FROM mp WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.project = mp.project AND x.partner = mp.key)""",
    "best_bindings": "WITH b AS (SELECT user_id AS note_id, event_type AS kind, CASE WHEN event_id % 5 <> 0 THEN 'p' || (event_id % 30) END AS path, CASE WHEN event_id % 4 <> 0 THEN event_id % 90 END AS line, event_id % 3 AS priority, event_id AS c FROM events) SELECT note_id, kind, path, line FROM b QUALIFY row_number() OVER (PARTITION BY note_id ORDER BY priority, line IS NULL, line, c, kind, coalesce(path, '')) = 1",
}

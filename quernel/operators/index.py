"""The index itself: scopes and overlays, discovery, chunking, embedding policy, status, digests, collection of garbage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernel.functions.exprs import is_generated_path, is_test_path
from quernel.plans.intervals import contained
from quernel.sources.tables import table

#: Lines of a chunk of plain text, of a symbol's part, of a part of what no symbol covers; bytes from which a source isn't cut by symbols;
#: characters of an embedding, and least characters of a chunk (fixed values).
TEXT_LINES, SYMBOL_LINES, CONTEXT_LINES, STRUCTURE_BYTES, EMBED_CHARS, SMALL_CHARS = 160, 120, 80, 512_000, 4_000, 80
LANGUAGES = ("rust", "typescript", "python", "go", "kotlin", "c", "cpp", "swift", "markdown")
_C_NOTES = r"/\*[\s\S]*?\*/|//[^\n]*"
#: What says nothing of a file's own: comments, imports, module lines.
PLUMBING = {
    "rust": _C_NOTES + r"|(?:pub(?:\([^)]*\))?\s+)?use\s[^;]*;|extern\s+crate\s[^;]*;|(?:pub\s+)?mod\s+\w+\s*;",
    "typescript": _C_NOTES + r"|import\s[^;]*?from\s*[\"'][^\"'\n]*[\"'];?|import\s*[\"'][^\"'\n]*[\"'];?|export\s+\*[^;\n]*;?",
    "python": r'\"\"\"[\s\S]*?\"\"\"|#[^\n]*|from\s+\S+\s+import\s+(?:\([^)]*\)|[^\n(]*)|(?m:^)import\s[^\n]*',
    "go": _C_NOTES + r"|package\s+\w+|import\s+(?:\([^)]*\)|\"[^\"\n]*\")", "kotlin": _C_NOTES + r"|(?:package|import)\s[^\n]*",
    "c": _C_NOTES + r"|#\s*include[^\n]*", "cpp": _C_NOTES + r"|#\s*include[^\n]*", "swift": _C_NOTES + r"|import\s[^\n]*",
}


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the greatest by ``order`` (nulls lowest, a full order over the given columns)."""
    place = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return rows.withColumn("_place", F.row_number().over(place)).where("_place = 1").drop("_place")


def scoped_files(files: DataFrame) -> DataFrame:
    """The files that a checkout sees: overlay rows without tombstones, and base rows whose path has no overlay row.

    A tombstone (kind ``deleted``) hides its base path and isn't seen itself. Overlay rows have a worktree_id.
    """
    overlay = files.where(F.coalesce("worktree_id", F.lit("")) != "")
    base = files.where(F.coalesce("worktree_id", F.lit("")) == "")
    seen = overlay.where(~F.col("kind").eqNullSafe("deleted"))
    return seen.unionByName(base.where(~F.col("kind").eqNullSafe("deleted")).join(overlay.select("repo_id", "path").distinct(), ["repo_id", "path"], "left_anti"))


def discovery_plan(indexed: DataFrame, found: DataFrame) -> DataFrame:
    """(repo_id, path, action): what to do to bring an index to what was found, by hash, language and kind.

    ``add``, ``change``, ``delete`` or ``keep``; null stamps compare as equal to null.
    """
    stamps = ["sha256", "language", "kind"]
    old = indexed.select("repo_id", "path", F.struct(*stamps).alias("old"))
    new = found.select("repo_id", "path", F.struct(*stamps).alias("new"))
    action = F.when(F.col("old").isNull(), "add").when(F.col("new").isNull(), "delete").when(F.col("old").eqNullSafe(F.col("new")), "keep").otherwise("change")
    return old.join(new, ["repo_id", "path"], "full_outer").select("repo_id", "path", action.alias("action"))


def line_chunks(documents: DataFrame, lines: int = TEXT_LINES) -> DataFrame:
    """(doc_id, chunk, start_line, end_line, text): windows of ``lines`` lines; a trailing line break starts no line."""
    split = F.split(F.regexp_replace("text", r"\n\z", ""), "\n")
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(split) - 1) / lines).cast("int")), lambda k: F.struct(k.alias("chunk"), F.slice(split, k * lines + 1, lines).alias("own")))
    rows = documents.where("text is not null").select("doc_id", F.explode(cut).alias("c"))
    return rows.select("doc_id", "c.chunk", (F.col("c.chunk") * lines + 1).alias("start_line"), (F.col("c.chunk") * lines + F.size("c.own")).alias("end_line"), F.array_join("c.own", "\n").alias("text"))


def heading_chunks(documents: DataFrame) -> DataFrame:
    """(doc_id, section, heading, n_lines): markdown sections; lines before the first heading are section 0."""
    lines = documents.where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    starts = F.col("line").rlike(r"^#{1,6}\s+\S")
    numbered = lines.withColumn("section", F.sum(starts.cast("int")).over(Window.partitionBy("doc_id").orderBy("pos")))
    heading = F.max(F.when(starts, F.col("line")))
    return numbered.groupBy("doc_id", "section").agg(F.coalesce(heading, F.lit("")).alias("heading"), F.count(F.lit(1)).alias("n_lines"))


def low_signal(text, language) -> F.Column:
    """Whether a chunk has nothing but imports, module lines, comments and closing braces, by the language's patterns; never for markdown."""
    rest = F.lit("x")
    for name, pattern in PLUMBING.items():
        rest = F.when(language == name, F.regexp_replace(text, pattern, "")).otherwise(rest)
    return F.regexp_replace(rest, r"[\s}]+", "") == ""


def embedding_policy(chunks: DataFrame) -> DataFrame:
    """(chunk_id, policy, priority) of chunks (chunk_id, symbol_path, chunk_kind, text, path, language, file_kind); the first rule that holds.

    Lengths are of the text without blanks at its ends, in characters. Priority: 0 a symbol's source, 1 documents and other source, 2 tests, 9 skipped.
    """
    path, size = F.col("path"), F.length(F.regexp_replace("text", r"^\s+|\s+$", ""))
    made = (F.col("file_kind") == "generated") | (F.col("chunk_kind") == "generated")
    made_path = path.rlike(r"/generated/|/target/|/\.build/|^\.build/|/Pods/|^Pods/|(Cargo\.lock|package-lock\.json|pnpm-lock\.yaml|Package\.resolved)$")
    fixture = path.rlike(r"/(fixtures|__fixtures__|testdata|snapshots)/|\.snap$")
    policy = (
        F.when((size > 4 * EMBED_CHARS) & (made | F.col("symbol_path").isNull()), "SkipTooLarge")
        .when(made | made_path, "SkipGenerated")
        .when(fixture, "SkipTestFixture")
        .when(~F.coalesce(F.col("language").isin(*LANGUAGES), F.lit(False)), "SkipLanguageUnsupported")
        .when(size < SMALL_CHARS, "SkipTooSmall")
        .when(low_signal(F.col("text"), F.col("language")), "SkipLowSignal")
        .otherwise("Embed")
    )
    test, prose = is_test_path(path), F.col("language") == "markdown"
    priority = F.when(F.col("symbol_path").isNotNull() & (F.col("chunk_kind") == "code") & ~test & ~prose, 0).when(prose, 1).when(test, 2).otherwise(1)
    return chunks.withColumn("policy", policy).select("chunk_id", "policy", F.when(F.col("policy") == "Embed", priority).otherwise(9).alias("priority"))


def embedding_status(embeddings: DataFrame) -> DataFrame:
    """Per model: rows, current, stale and failed ones, and current chunks."""
    of = lambda s: F.sum((F.col("status") == s).cast("bigint"))
    return embeddings.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("n_rows"), of("Current").alias("n_current"), of("Stale").alias("n_stale"), of("Failed").alias("n_failed"), F.countDistinct(F.when(F.col("status") == "Current", F.col("chunk_id"))).alias("n_chunks")
    )


def stale_embeddings(embeddings: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, chunk_id): current embeddings whose chunk is gone or whose text hash isn't the chunk's."""
    now = chunks.select(F.col("id").alias("chunk_id"), "text_hash").distinct()
    rows = embeddings.where("status = 'Current'").select("id", "chunk_id", "source_text_hash").join(now, "chunk_id", "left")
    return rows.where(~F.col("source_text_hash").eqNullSafe(F.col("text_hash"))).select("id", "chunk_id").distinct()


def content_digest(files: DataFrame) -> DataFrame:
    """(repo_id, lane_1 .. lane_4, n): order-independent digest of the multiset of (path, sha256), four sums modulo 2 ** 64.

    Tombstones are no members. Sums are exact decimals, so any number of files adds up; removing a row subtracts it (``moved_digest``).
    """
    h = F.sha2(F.concat_ws("\u001f", "path", "sha256"), 256)
    live = files.where(~F.col("kind").eqNullSafe("deleted"))
    lane = lambda k: F.sum(F.conv(F.substring(h, 16 * k - 15, 16), 16, 10).cast("decimal(20,0)"))
    sums = live.groupBy("repo_id").agg(*[lane(k).alias(f"lane_{k}") for k in range(1, 5)], F.count(F.lit(1)).alias("n"))
    return sums.select("repo_id", *[(F.col(f"lane_{k}") % F.lit(str(2**64)).cast("decimal(38,0)")).cast("decimal(20,0)").cast("string").alias(f"lane_{k}") for k in range(1, 5)], "n")


def moved_digest(state: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """``state`` (a ``content_digest``) after rows were added and removed, without reading the others; a repository without rows has none."""
    out = state
    for rows, sign in ((added, 1), (removed, -1)):
        d = content_digest(rows).select("repo_id", *[F.col(f"lane_{k}").alias(f"m_{k}") for k in range(1, 5)], F.col("n").alias("m"))
        lane = lambda k, sign=sign: F.pmod(F.coalesce(F.col(f"lane_{k}"), F.lit("0")).cast("decimal(38,0)") + sign * F.coalesce(F.col(f"m_{k}"), F.lit("0")).cast("decimal(38,0)"), F.lit(str(2**64)).cast("decimal(38,0)")).cast("decimal(20,0)").cast("string").alias(f"lane_{k}")
        out = out.join(d, "repo_id", "full_outer").select("repo_id", *[lane(k) for k in range(1, 5)], (F.coalesce("n", F.lit(0)) + sign * F.coalesce("m", F.lit(0))).alias("n"))
    return out.where("n <> 0")


def read_chunk(chunks: DataFrame, texts: DataFrame, chunk_id: int, around: int = 1) -> DataFrame:
    """The chunk and its neighbours in the file (offset -around to around), with their texts."""
    own = chunks.where(F.col("id") == chunk_id).select("file_id").distinct()
    mates = chunks.join(F.broadcast(own), "file_id").select("id", "file_id", "start_byte").distinct()
    placed = mates.withColumn("place", F.row_number().over(Window.partitionBy("file_id").orderBy("start_byte", "id")))
    at = placed.where(F.col("id") == chunk_id).select("file_id", F.col("place").alias("at"))
    near = placed.join(F.broadcast(at), "file_id").withColumn("offset", F.col("place") - F.col("at")).where(F.abs("offset") <= around)
    bodies = texts.join(F.broadcast(near.select(F.col("id").alias("chunk_id"))), "chunk_id").groupBy("chunk_id").agg(F.max("blob").alias("blob"))
    return near.join(bodies, near["id"] == bodies["chunk_id"], "left").select(near["id"], "offset", F.decode("blob", "UTF-8").alias("text"))


def orphans(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """(id): chunks whose file is unknown or a tombstone, for collection."""
    live = files.where(~F.col("kind").eqNullSafe("deleted")).select(F.col("id").alias("file_id")).distinct()
    return chunks.select("id", "file_id").distinct().join(live, "file_id", "left_anti").select("id")


def treemap(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """(repo_id, dir, n_files, n_lines): lines and files below each top directory."""
    size = chunks.groupBy("file_id").agg(F.max("end_line").alias("lines"))
    rows = files.select(F.col("id").alias("file_id"), "repo_id", F.substring_index("path", "/", 1).alias("dir")).join(size, "file_id", "left")
    return rows.groupBy("repo_id", "dir").agg(F.count(F.lit(1)).alias("n_files"), F.sum(F.coalesce("lines", F.lit(0)).cast("bigint")).alias("n_lines"))


def consolidate(stores: dict[str, DataFrame]) -> DataFrame:
    """The rows of several stores as one, each under its repository; columns that a store lacks are null."""
    out = None
    for repo, rows in stores.items():
        own = rows.withColumn("repo_id", F.lit(repo))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def enclosed(chunks: DataFrame) -> DataFrame:
    """(inner_id, outer_id): for each chunk the shortest other chunk of its file that has all its lines and more (ties: the smaller id)."""
    rows = chunks.select("file_id", "id", "start_line", "end_line").distinct()
    inner = rows.select("file_id", F.col("id").alias("inner_id"), F.col("start_line").alias("a"), (F.col("end_line") + 1).alias("b"))
    outer = rows.select("file_id", F.col("id").alias("outer_id"), F.col("start_line").alias("lo"), (F.col("end_line") + 1).alias("hi"))
    pairs = contained(inner, outer, "file_id").where("hi - lo > b - a")
    return pairs.groupBy("inner_id").agg(F.min_by("outer_id", F.struct(F.col("hi") - F.col("lo"), F.col("outer_id"))).alias("outer_id"))


def line_overlaps(chunks: DataFrame, ranges: DataFrame) -> DataFrame:
    """(id, n_ranges): chunks that overlap line ranges (file_id, lo, hi) of a diff."""
    own = chunks.select("id", "file_id", "start_line", "end_line").distinct()
    return own.join(ranges, "file_id").where("start_line <= hi and end_line >= lo").groupBy("id").agg(F.count(F.lit(1)).alias("n_ranges"))


def _files(s: SparkSession, d: str) -> DataFrame:
    return latest(table(s, d, "files"), ["id"], ["indexed_at_ms", "indexed_revision"])


def _documents(s, d):
    return table(s, d, "documents").select("doc_id", "text")


def _policy_rows(s, d):
    chunks = table(s, d, "chunks").select(F.col("id").alias("chunk_id"), "file_id", "symbol_path", "chunk_kind").distinct()
    texts = table(s, d, "chunk_text").groupBy("chunk_id").agg(F.max("blob").alias("b")).select("chunk_id", F.decode("b", "UTF-8").alias("text"))
    return chunks.join(_files(s, d).select(F.col("id").alias("file_id"), "path", F.lower(F.trim("language")).alias("language"), F.col("kind").alias("file_kind")), "file_id").join(texts, "chunk_id")


def _moved_chunks(s, d):
    """Chunks of which every ninth has another text now."""
    return table(s, d, "chunks").select("id", F.when(F.col("id") % 9 == 0, F.lit("changed")).otherwise(F.col("text_hash")).alias("text_hash"))


def _widened(s, d):
    i = F.col("id")
    return table(s, d, "chunks").select("id", "file_id", (F.col("start_line") - i % 5).alias("start_line"), (F.col("end_line") + i % 7).alias("end_line"))


def _digest_after(s, d):
    files = _files(s, d)
    old, new = files.where("id % 7 <> 0"), files.where("id % 7 = 0")
    gone = files.where("id % 10 = 3 and id % 7 <> 0")
    return moved_digest(content_digest(old), new, gone)


def _split_scopes(s, d):
    files = _files(s, d)
    worktree = F.coalesce("worktree_id", F.lit("")) != ""
    one = lambda df: latest(df, ["repo_id", "path"], ["indexed_at_ms", "id"])
    return one(files.where(~worktree)), one(scoped_files(files))


def _ranges(s, d):
    return table(s, d, "files").select(F.col("id").alias("file_id"), (F.col("id") % 40).alias("lo"), (F.col("id") % 40 + 30).alias("hi")).distinct()


QUERIES = {
    "scoped_files": lambda s, d: scoped_files(_files(s, d)).select("id", "repo_id", "path", "worktree_id"),
    "discovery_plan": lambda s, d: discovery_plan(*_split_scopes(s, d)),
    "line_chunks": lambda s, d: line_chunks(_documents(s, d)),
    "path_classes": lambda s, d: table(s, d, "files").select("path").distinct().select("path", is_test_path(F.col("path")).alias("is_test"), is_generated_path(F.col("path")).alias("is_generated")),
    "heading_chunks": lambda s, d: heading_chunks(_documents(s, d)),
    "embedding_policy": lambda s, d: embedding_policy(_policy_rows(s, d)),
    "embedding_status": lambda s, d: embedding_status(table(s, d, "chunk_embeddings")),
    "stale_embeddings": lambda s, d: stale_embeddings(table(s, d, "chunk_embeddings"), _moved_chunks(s, d)),
    "content_digest": lambda s, d: content_digest(_files(s, d)),
    "content_digest_moved": _digest_after,
    "read_chunk": lambda s, d: read_chunk(table(s, d, "chunks"), table(s, d, "chunk_text"), 5, 2),
    "orphan_chunks": lambda s, d: orphans(table(s, d, "chunks"), _files(s, d).where("id % 10 <> 0")),
    "treemap": lambda s, d: treemap(_files(s, d), table(s, d, "chunks")),
    "enclosed_chunks": lambda s, d: enclosed(_widened(s, d)),
    "line_overlaps": lambda s, d: line_overlaps(table(s, d, "chunks"), _ranges(s, d)),
    "language_histogram": lambda s, d: _files(s, d).groupBy("repo_id", "language", "kind").agg(F.count(F.lit(1)).alias("n_files")),
}
_FILES = "WITH f AS (SELECT * FROM files QUALIFY row_number() OVER (PARTITION BY id ORDER BY indexed_at_ms DESC NULLS LAST, indexed_revision DESC NULLS LAST) = 1)"
_SCOPE = _FILES + """, o AS (SELECT * FROM f WHERE coalesce(worktree_id, '') <> ''), b AS (SELECT * FROM f WHERE coalesce(worktree_id, '') = ''),
sc AS (SELECT * FROM o WHERE kind IS DISTINCT FROM 'deleted' UNION ALL SELECT * FROM b WHERE kind IS DISTINCT FROM 'deleted' AND NOT EXISTS (SELECT 1 FROM o WHERE o.repo_id = b.repo_id AND o.path = b.path))"""  # fmt: skip
_TEST = r"(regexp_matches(lower(path), '(^|/)(tests|test|__tests__|__test__|__mocks__|spec|specs)(/|$)') OR parse_filename(path) = 'conftest.py' OR contains(lower(parse_filename(path)), '.test.') OR contains(lower(parse_filename(path)), '.spec.') OR regexp_matches(string_split(parse_filename(path), '.')[1], '^tests?$|^test_|_tests?$|Tests?$|TestCase$'))"
_GENERATED = "(path LIKE '%.d.ts' OR list_has_any(string_split(path, '/'), ['generated', 'generated-web']))"
_REST = "CASE " + " ".join(f"WHEN language = '{n}' THEN regexp_replace(text, '{p.replace(chr(39), chr(39) * 2)}', '', 'g')" for n, p in PLUMBING.items()) + " ELSE 'x' END"
_DIGEST = ", ".join(f"CAST(sum(CAST('0x' || substr(h, {16 * k - 15}, 16) AS UBIGINT)) % 18446744073709551616 AS VARCHAR) AS lane_{k}" for k in range(1, 5))
SQL = {
    "scoped_files": f"{_SCOPE} SELECT id, repo_id, path, worktree_id FROM sc",
    "discovery_plan": f"""{_SCOPE}, x AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY repo_id, path ORDER BY indexed_at_ms DESC NULLS LAST, id DESC) = 1), y AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY repo_id, path ORDER BY indexed_at_ms DESC NULLS LAST, id DESC) = 1)
SELECT coalesce(x.repo_id, y.repo_id) AS repo_id, coalesce(x.path, y.path) AS path, CASE WHEN x.id IS NULL THEN 'add' WHEN y.id IS NULL THEN 'delete'
  WHEN x.sha256 IS NOT DISTINCT FROM y.sha256 AND x.language IS NOT DISTINCT FROM y.language AND x.kind IS NOT DISTINCT FROM y.kind THEN 'keep' ELSE 'change' END AS action
FROM x FULL JOIN y ON x.repo_id = y.repo_id AND x.path = y.path""",
    "line_chunks": r"""WITH l AS (SELECT doc_id, string_split(regexp_replace(text, '\n\z', ''), chr(10)) AS a FROM documents WHERE text IS NOT NULL), k AS (SELECT doc_id, a, unnest(range(0, CAST(floor((len(a) - 1) / 160) AS INTEGER) + 1)) AS chunk FROM l)
SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, CAST(chunk * 160 + 1 AS INTEGER) AS start_line, CAST(chunk * 160 + len(a[chunk * 160 + 1:chunk * 160 + 160]) AS INTEGER) AS end_line, array_to_string(a[chunk * 160 + 1:chunk * 160 + 160], chr(10)) AS text FROM k""",
    "heading_chunks": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
n AS (SELECT *, regexp_matches(line, '^#{1,6}\s+\S') AS h, CAST(sum(CASE WHEN regexp_matches(line, '^#{1,6}\s+\S') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS section FROM l)
SELECT doc_id, section, coalesce(max(CASE WHEN h THEN line END), '') AS heading, count(*) AS n_lines FROM n GROUP BY doc_id, section""",
    "path_classes": f"SELECT DISTINCT path, {_TEST} AS is_test, {_GENERATED} AS is_generated FROM files",
    "embedding_policy": f"""{_FILES}, t AS (SELECT chunk_id, decode(max(blob)) AS text FROM chunk_text GROUP BY 1), c AS (SELECT DISTINCT id AS chunk_id, file_id, symbol_path, chunk_kind FROM chunks), r AS (SELECT c.*, path, lower(trim(language, ' ')) AS language, kind AS file_kind, text FROM c JOIN f ON f.id = c.file_id JOIN t USING (chunk_id)),
z AS (SELECT *, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS size, regexp_replace({_REST}, '[\\s}}]+', '', 'g') = '' AS low, (file_kind = 'generated' OR chunk_kind = 'generated') AS made FROM r),
p AS (SELECT *, CASE WHEN size > 16000 AND (made OR symbol_path IS NULL) THEN 'SkipTooLarge' WHEN made OR contains(path, '/generated/') OR contains(path, '/target/') OR contains(path, '/.build/') OR path LIKE '.build/%' OR contains(path, '/Pods/') OR path LIKE 'Pods/%' OR regexp_matches(path, '(Cargo\\.lock|package-lock\\.json|pnpm-lock\\.yaml|Package\\.resolved)$') THEN 'SkipGenerated'
  WHEN contains(path, '/fixtures/') OR contains(path, '/__fixtures__/') OR contains(path, '/testdata/') OR contains(path, '/snapshots/') OR path LIKE '%.snap' THEN 'SkipTestFixture' WHEN language IS NULL OR language NOT IN ('rust', 'typescript', 'python', 'go', 'kotlin', 'c', 'cpp', 'swift', 'markdown') THEN 'SkipLanguageUnsupported' WHEN size < 80 THEN 'SkipTooSmall' WHEN low THEN 'SkipLowSignal' ELSE 'Embed' END AS policy FROM z)
SELECT chunk_id, policy, CASE WHEN policy <> 'Embed' THEN 9 WHEN symbol_path IS NOT NULL AND chunk_kind = 'code' AND NOT {_TEST} AND language <> 'markdown' THEN 0 WHEN language = 'markdown' THEN 1 WHEN {_TEST} THEN 2 ELSE 1 END AS priority FROM p""",
    "embedding_status": """SELECT model_id, count(*) AS n_rows, count(*) FILTER (status = 'Current') AS n_current, count(*) FILTER (status = 'Stale') AS n_stale, count(*) FILTER (status = 'Failed') AS n_failed, count(DISTINCT chunk_id) FILTER (status = 'Current') AS n_chunks FROM chunk_embeddings GROUP BY model_id""",
    "stale_embeddings": "WITH c AS (SELECT DISTINCT id, CASE WHEN id % 9 = 0 THEN 'changed' ELSE text_hash END AS text_hash FROM chunks) SELECT DISTINCT e.id, e.chunk_id FROM chunk_embeddings e LEFT JOIN c ON c.id = e.chunk_id WHERE status = 'Current' AND e.source_text_hash IS DISTINCT FROM c.text_hash",
    "content_digest": f"{_FILES}, h AS (SELECT repo_id, sha256(concat_ws(chr(31), path, sha256)) AS h FROM f WHERE kind IS DISTINCT FROM 'deleted') SELECT repo_id, {_DIGEST}, count(*) AS n FROM h GROUP BY repo_id",
    "content_digest_moved": f"{_FILES}, h AS (SELECT repo_id, sha256(concat_ws(chr(31), path, sha256)) AS h FROM f WHERE kind IS DISTINCT FROM 'deleted' AND NOT (id % 10 = 3 AND id % 7 <> 0)) SELECT repo_id, {_DIGEST}, count(*) AS n FROM h GROUP BY repo_id",
    "read_chunk": """WITH m AS (SELECT DISTINCT id, file_id, start_byte FROM chunks WHERE file_id IN (SELECT file_id FROM chunks WHERE id = 5)), p AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY start_byte, id) AS place FROM m)
SELECT p.id, CAST(p.place - q.place AS INTEGER) AS offset, (SELECT decode(max(blob)) FROM chunk_text t WHERE t.chunk_id = p.id) AS text FROM p JOIN p q ON q.id = 5 WHERE abs(p.place - q.place) <= 2""",
    "orphan_chunks": f"{_FILES} SELECT DISTINCT c.id FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.id = c.file_id AND f.id % 10 <> 0 AND f.kind IS DISTINCT FROM 'deleted')",
    "treemap": f"{_FILES}, z AS (SELECT file_id, max(end_line) AS lines FROM chunks GROUP BY file_id) SELECT repo_id, string_split(path, '/')[1] AS dir, count(*) AS n_files, CAST(sum(coalesce(lines, 0)) AS BIGINT) AS n_lines FROM f LEFT JOIN z ON z.file_id = f.id GROUP BY ALL",
    "enclosed_chunks": "WITH c AS (SELECT DISTINCT id, file_id, start_line - id % 5 AS start_line, end_line + id % 7 AS end_line FROM chunks) SELECT b.id AS inner_id, arg_min(a.id, (a.end_line - a.start_line, a.id)) AS outer_id FROM c a JOIN c b ON a.file_id = b.file_id AND a.start_line <= b.start_line AND b.end_line <= a.end_line AND b.end_line - b.start_line < a.end_line - a.start_line GROUP BY b.id",
    "line_overlaps": "WITH c AS (SELECT DISTINCT id, file_id, start_line, end_line FROM chunks), r AS (SELECT DISTINCT id AS file_id, id % 40 AS lo, id % 40 + 30 AS hi FROM files) SELECT id, count(*) AS n_ranges FROM c JOIN r USING (file_id) WHERE start_line <= hi AND end_line >= lo GROUP BY id",
    "language_histogram": f"{_FILES} SELECT repo_id, language, kind, count(*) AS n_files FROM f GROUP BY ALL",
}

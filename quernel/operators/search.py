"""Search: postings, BM25, exact vector scoring, hybrid fusion, snippets, embeddings and their codec."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.functions.exprs import ascii_lower, capped, query_terms, rank_score, round4, terms
from quernel.plans.ranks import global_rank, top_ranked
from quernel.sources.tables import table

#: Parameters of BM25, and the weights of the two lanes of the fused score (fixed values; the other lanes are open, see README).
K1, B = 1.2, 0.75
FUSION = {"bm25": 0.45, "vector": 0.35}
#: Candidates for each hit that is asked for, and the least that are.
OVERFETCH, LEAST_FETCH = 8, 10


def postings(documents: DataFrame) -> DataFrame:
    """(doc_id, term, tf) of ``documents`` (doc_id, text); texts without terms have none."""
    return documents.select("doc_id", F.explode(terms("text")).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def bm25(documents: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """(doc_id, score, rank) of every document that holds a term of ``query`` (Okapi, any term), or of the best ``limit``.

    Terms are matched unstemmed; idf is floored at 1e-6. Lengths count all terms; only the terms of the query
    are exploded, so a pass moves one small row per match. A query without terms matches nothing.
    """
    wanted = query_terms(query)
    sized = documents.select("doc_id", terms("text").alias("t")).select("doc_id", F.coalesce(F.size("t"), F.lit(0)).alias("len"), F.filter("t", lambda x: x.isin(wanted) if wanted else F.lit(False)).alias("hits"))
    stats = sized.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"))
    matches = sized.where(F.size("hits") > 0).select("doc_id", "len", F.explode("hits").alias("term")).groupBy("doc_id", "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    frequency = matches.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # one row per term of the query
    n, df, tf = F.col("n"), F.col("df"), F.col("tf")
    idf = F.greatest(F.log((n - df + 0.5) / (df + 0.5) + 1), F.lit(1e-6))
    part = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    scored = matches.join(F.broadcast(frequency), "term").join(F.broadcast(stats)).select("doc_id", part.alias("part")).groupBy("doc_id").agg(round4(F.sum("part")).alias("score"))
    order = F.desc("score"), "doc_id"
    return global_rank(scored, *order) if limit is None else top_ranked(scored, limit, *order)


def dot(left, right):
    return F.aggregate(F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda a, x: a + x)


def vector_scores(vectors: DataFrame, query: list[float]) -> DataFrame:
    """(vec_id, similarity) of the vectors (vec_id, embedding) with a positive product with ``query``; other lengths are left out."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.where(F.size("embedding") == len(query)).select("vec_id", dot("embedding", q).alias("similarity")).where("similarity > 0")


def top(scored: DataFrame, by: str, key: str, limit: int) -> DataFrame:
    """The best ``limit`` rows (a top-k report), ties by ``key``."""
    return scored.orderBy(F.desc(by), key).limit(limit)


def symbol_path_boost(symbol, path, wanted: list[str]):
    """0.5 for each term in the symbol, 0.2 for each in the path, 1 at most."""
    low_symbol, low_path = ascii_lower(F.coalesce(symbol, F.lit(""))), ascii_lower(F.coalesce(path, F.lit("")))
    score = F.lit(0.0)
    for t in wanted:
        score = score + F.when(low_symbol.contains(t), 0.5).otherwise(0.0) + F.when(low_path.contains(t), 0.2).otherwise(0.0)
    return F.least(score, F.lit(1.0))


def fuse(lexical: DataFrame, vector: DataFrame) -> DataFrame:
    """(doc_id, bm25, vector, score, mode) from (doc_id, rank) and (doc_id, similarity): weighted rank score and clamped similarity."""
    both = lexical.select("doc_id", rank_score(F.col("rank")).alias("bm25")).join(vector.select("doc_id", capped(F.col("similarity")).alias("vector")), "doc_id", "full_outer")
    both = both.select("doc_id", F.coalesce("bm25", F.lit(0.0)).alias("bm25"), F.coalesce("vector", F.lit(0.0)).alias("vector"))
    mode = F.when((F.col("bm25") > 0) & (F.col("vector") > 0), "hybrid").when(F.col("vector") > 0, "vector").otherwise("lexical")
    return both.withColumn("score", round4(F.col("bm25") * FUSION["bm25"] + F.col("vector") * FUSION["vector"])).withColumn("mode", mode)


def hybrid_search(documents: DataFrame, vectors: DataFrame, query: str, embedding: list[float] | None, limit: int = 10) -> DataFrame:
    """The best ``limit`` documents: BM25 and vector candidates, 8 for each asked hit, fused; without an embedding lexical only.

    ``vectors``: doc_id, embedding. Columns: doc_id, bm25, vector, score, mode, rank.
    """
    fetch = OVERFETCH * max(limit, LEAST_FETCH)
    lexical = bm25(documents, query, fetch)
    if embedding is None:
        near = documents.sparkSession.createDataFrame([], "doc_id bigint, similarity double")
    else:
        near = top(vector_scores(vectors.select(F.col("doc_id").alias("vec_id"), "embedding"), embedding), "similarity", "vec_id", fetch).withColumnRenamed("vec_id", "doc_id")
    return top_ranked(fuse(lexical, near), limit, F.desc("score"), "doc_id")


def snippets(documents: DataFrame, query: str) -> DataFrame:
    """(doc_id, snippet): three lines from the one before the first that holds a term of the query (else the first three)."""
    wanted = query_terms(query)
    lines = F.split("text", "\n")
    hits = F.transform("lines", lambda x: F.exists(F.array(*[F.lit(t) for t in wanted]), lambda t: F.contains(ascii_lower(x), t)) if wanted else F.lit(False))
    start = F.greatest(F.array_position("hits", True).cast("int") - 1, F.lit(1))
    return documents.where("text is not null").select("doc_id", lines.alias("lines")).withColumn("hits", hits).select("doc_id", F.array_join(F.slice("lines", start, 3), "\n").alias("snippet"))


def encode_vector(column):
    """(scale, codes): symmetric 8-bit codes, scale = greatest absolute value / 127; zeros have scale 0."""
    scale = F.aggregate(F.transform(column, lambda x: F.abs(x.cast("double"))), F.lit(0.0), lambda a, x: F.greatest(a, x)) / 127
    codes = F.transform(column, lambda x: F.when(scale > 0, F.round(x.cast("double") / scale)).otherwise(F.lit(0.0)).cast("int"))
    return F.struct(scale.alias("scale"), codes.alias("codes"))


def decode_vector(encoded):
    return F.transform(encoded["codes"], lambda c: c * encoded["scale"])


def hash_embeddings(documents: DataFrame, dim: int = 384) -> DataFrame:
    """(doc_id, embedding array<float>): hashed words and pairs of words, of length 1 (zeros for a text without words).

    Words break at other than letters, digits and underscores and inside identifiers; one letter is no word.
    A word counts 1, a pair 0.6; the place and sign come from SHA-256.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib
        import re

        known: dict[str, tuple[int, float]] = {}

        def place(word: str) -> tuple[int, float]:
            if word not in known:
                if len(known) > 500_000:
                    known.clear()
                h = hashlib.sha256(word.encode()).digest()
                known[word] = int.from_bytes(h[:2], "little") % dim, -1.0 if h[2] & 1 else 1.0
            return known[word]

        part = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[^\W\d_A-Z]+|[A-Z]+|\d+")
        for b in batches:
            out = []
            for text in b.text:
                words = [w.lower() for w in part.findall(text or "") if len(w) > 1]
                v = np.zeros(dim, np.float32)
                for w in words:
                    k, sign = place(w)
                    v[k] += sign
                for x, y in zip(words, words[1:], strict=False):
                    k, sign = place(f"{x}::{y}")
                    v[k] += np.float32(0.6) * sign
                size = float(np.sqrt((v * v).sum()))
                out.append(v / size if size else v)
            yield pd.DataFrame({"doc_id": b.doc_id, "embedding": out})

    return documents.select("doc_id", "text").mapInPandas(run, "doc_id bigint, embedding array<float>")


def docs_tree(paths: DataFrame) -> DataFrame:
    """(dir, n_files): files below every directory of (path); an ancestor counts all below it."""
    parts = F.split("path", "/")
    dirs = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    return paths.where(F.size(parts) > 1).select(F.explode(dirs).alias("dir")).groupBy("dir").agg(F.count(F.lit(1)).alias("n_files"))


def regex_hits(texts: DataFrame, pattern: str) -> DataFrame:
    """(id, line_no, line) of the lines of (id, text) that match ``pattern`` (Java syntax)."""
    lines = texts.where(F.col("text").rlike(f"(?m){pattern}")).select("id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.where(F.col("line").rlike(pattern)).select("id", (F.col("pos") + 1).alias("line_no"), "line")


QUERY = "stale shard manifest"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return [float(x) for x in table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]]


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


def _decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", encode_vector("embedding").alias("code"))


QUERIES = {
    "postings": lambda s, d: postings(_documents(s, d)),
    "document_frequency": lambda s, d: document_frequency(postings(_documents(s, d))),
    "bm25": lambda s, d: bm25(_documents(s, d), QUERY),
    "vector_scores": lambda s, d: vector_scores(table(s, d, "embeddings"), _query_vector(s, d)).select("vec_id", F.round("similarity", 4).alias("similarity")),
    "hybrid_search": lambda s, d: hybrid_search(_documents(s, d), _vectors(s, d), QUERY, _query_vector(s, d), 20).select("doc_id", "score", "mode", "rank"),
    "lexical_search": lambda s, d: hybrid_search(_documents(s, d), _vectors(s, d), QUERY, None, 20).select("doc_id", "score", "mode", "rank"),
    "snippets": lambda s, d: snippets(_documents(s, d), QUERY),
    "path_boost": lambda s, d: _documents(s, d).select("doc_id", F.round(symbol_path_boost(F.col("lang"), F.col("source"), query_terms("git pool fr")), 2).alias("boost")),
    "vector_codes": lambda s, d: _decoded(s, d).select("vec_id", F.round("code.scale", 6).alias("scale"), F.aggregate("code.codes", F.lit(0), lambda a, x: a + x).alias("code_sum")),
    "hash_embeddings": lambda s, d: hash_embeddings(_documents(s, d)).select("doc_id", F.transform("embedding", lambda x: F.round(x, 4)).alias("embedding")),
    "docs_tree": lambda s, d: docs_tree(table(s, d, "files").select("path")),
    "regex_hits": lambda s, d: regex_hits(_documents(s, d).select(F.col("doc_id").alias("id"), "text"), r"^\|[-| ]+\|$"),
}
_T = """WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\p{L}\\p{N}_-]+'), lambda x: x <> '') AS t FROM documents)"""
_P = _T + ", p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM t) GROUP BY ALL)"
_BM = f"""{_T}, z AS (SELECT doc_id, coalesce(len(t), 0) AS len, list_filter(t, lambda x: x IN ('stale', 'shard', 'manifest')) AS hits FROM t),
st AS (SELECT count(*) AS n, avg(len) AS avg_len FROM z), m AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len, unnest(hits) AS term FROM z) GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM m GROUP BY term),
bm AS (SELECT doc_id, floor(sum(greatest(ln((n - df + CAST(0.5 AS DOUBLE)) / (df + CAST(0.5 AS DOUBLE)) + 1), CAST(1e-6 AS DOUBLE)) * tf * CAST(2.2 AS DOUBLE) / (tf + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * len / avg_len))) * 10000 + 0.5) / 10000 AS score FROM m JOIN f USING (term), st GROUP BY doc_id),
b AS (SELECT doc_id, score, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM bm)"""
_V = """v AS (SELECT vec_id, list_dot_product(CAST(embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 0) AS DOUBLE[])) AS similarity FROM embeddings)"""
_FUSE = """, x AS (SELECT doc_id, 1 / sqrt(rank) AS bm25 FROM b WHERE rank <= 160), y AS (SELECT vec_id AS doc_id, least(similarity, 1) AS vector FROM v WHERE similarity > 0 ORDER BY similarity DESC, vec_id LIMIT {n}),
u AS (SELECT doc_id, coalesce(bm25, 0) AS bm25, coalesce(vector, 0) AS vector FROM x FULL JOIN y USING (doc_id)),
s AS (SELECT doc_id, floor((bm25 * CAST(0.45 AS DOUBLE) + vector * CAST(0.35 AS DOUBLE)) * 10000 + 0.5) / 10000 AS score, CASE WHEN bm25 > 0 AND vector > 0 THEN 'hybrid' WHEN vector > 0 THEN 'vector' ELSE 'lexical' END AS mode FROM u)
SELECT *, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s ORDER BY score DESC, doc_id LIMIT 20"""
SQL = {
    "postings": f"{_P} SELECT * FROM p",
    "document_frequency": f"{_P} SELECT term, count(*) AS df FROM p GROUP BY term",
    "bm25": f"{_BM} SELECT * FROM b",
    "vector_scores": f"WITH {_V} SELECT vec_id, round(similarity, 4) AS similarity FROM v WHERE similarity > 0",
    "hybrid_search": f"{_BM}, {_V}{_FUSE.format(n=160)}",
    "lexical_search": f"{_BM}, {_V}{_FUSE.format(n=0)}",
    "path_boost": "SELECT doc_id, round(least(" + " + ".join(f"CASE WHEN contains(coalesce(lower(lang), ''), '{t}') THEN 0.5 ELSE 0 END + CASE WHEN contains(lower(source), '{t}') THEN 0.2 ELSE 0 END" for t in ("git", "pool", "fr")) + ", CAST(1 AS DOUBLE)), 2) AS boost FROM documents",
    "vector_codes": "WITH s AS (SELECT vec_id, embedding, list_max(list_transform(CAST(embedding AS DOUBLE[]), lambda x: abs(x))) / 127 AS scale FROM embeddings) SELECT vec_id, round(scale, 6) AS scale, CAST(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(round(x / scale) AS INTEGER))) AS INTEGER) AS code_sum FROM s",
    "docs_tree": "WITH p AS (SELECT string_split(path, '/') AS a FROM files), q AS (SELECT a, unnest(range(1, len(a))) AS k FROM p) SELECT array_to_string(a[1:k], '/') AS dir, count(*) AS n_files FROM q GROUP BY ALL",
    "regex_hits": r"WITH l AS (SELECT doc_id AS id, string_split(text, chr(10)) AS a FROM documents), m AS (SELECT id, a, unnest(range(1, len(a) + 1)) AS k FROM l) SELECT id, CAST(k AS INTEGER) AS line_no, a[k] AS line FROM m WHERE regexp_matches(a[k], '^\|[-| ]+\|$')",
}

"""Chunks with their texts, and whole files put together from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.sources.tables import table

#: Aliases of languages as they occur in source collections (fixed values).
LANGUAGE_ALIASES = {
    "rs": "rust",
    "ts": "typescript",
    "tsx": "typescript",
    "mts": "typescript",
    "py": "python",
    "py3": "python",
    "python3": "python",
    "golang": "go",
    "kt": "kotlin",
    "kts": "kotlin",
    "c++": "cpp",
    "cxx": "cpp",
    "cc": "cpp",
    "md": "markdown",
    "h": "c",
}


def language_name(column) -> F.Column:
    """A language without regard to case, blanks and aliases."""
    bare = F.lower(F.trim(F.regexp_replace(column, r"\s+", "")))
    out = bare
    for alias, name in LANGUAGE_ALIASES.items():
        out = F.when(bare == alias, F.lit(name)).otherwise(out)
    return out


def latest_files(files: DataFrame) -> DataFrame:
    """One row per file id: the one indexed last (ties: the greatest row), tombstones left out.

    Rows with null id are dropped. Pre-aggregates on the map side, so repeated deliveries don't skew.
    """
    columns = ["repo_id", "path", "language", "kind"]
    order = F.struct(F.coalesce("indexed_at_ms", F.lit(-1)), *[F.coalesce(F.col(c), F.lit("")) for c in columns])
    best = files.where(F.col("id").isNotNull()).groupBy(F.col("id").alias("file_id")).agg(F.max_by(F.struct(*columns), order).alias("_f"))
    return best.select("file_id", *[F.col(f"_f.{c}").alias(c) for c in columns]).where(~F.col("kind").eqNullSafe("deleted"))


def distinct_chunks(chunks: DataFrame) -> DataFrame:
    """One row per chunk id (repeated deliveries are equal; the smallest row counts). Null ids are dropped."""
    columns = ["file_id", "chunk_kind", "symbol_path", "start_byte", "end_byte"]
    return (
        chunks.where(F.col("id").isNotNull())
        .groupBy(F.col("id").alias("chunk_id"))
        .agg(F.min(F.struct(*columns)).alias("_c"))
        .select("chunk_id", *[F.col(f"_c.{c}").alias(c) for c in columns])
    )


def load_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_chunks(table(spark, sf_dir, "chunks"))


def load_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_files(table(spark, sf_dir, "files"))


def file_sources(chunks: DataFrame, texts: DataFrame) -> DataFrame:
    """(file_id, parts): the chunk texts of every file as an array of (start_byte, chunk_id, blob), unordered, repeats included.

    Text is shuffled twice: to its chunk and to its file. A file is the unit of all that reads whole sources.
    ``whole_source`` puts the parts in order. Chunks without a text or with null ids take no part.
    """
    places = chunks.select(F.col("id").alias("chunk_id"), "file_id", "start_byte").where("chunk_id is not null and file_id is not null")
    joined = texts.select("chunk_id", "blob").where(F.col("blob").isNotNull()).join(places, "chunk_id")
    return joined.groupBy("file_id").agg(F.collect_list(F.struct("start_byte", "chunk_id", "blob")).alias("parts"))


def whole_source(parts) -> bytes:
    """The parts of one file in start_byte order (null first, ties by chunk id), each chunk once."""
    seen, out = set(), []
    for p in sorted(parts, key=lambda p: (-1 if p["start_byte"] is None else p["start_byte"], p["chunk_id"])):
        if p["chunk_id"] not in seen:
            seen.add(p["chunk_id"])
            out.append(bytes(p["blob"]))
    return b"".join(out)


def load_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, parts, repo_id, path, language, kind) of every file that is no tombstone."""
    sources = file_sources(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "chunk_text"))
    return sources.join(load_files(spark, sf_dir), "file_id")

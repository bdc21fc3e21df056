"""Sources and sinks: files of a tree, tables with a declared schema (Parquet or JSON), compressed text stores, rows as JSON lines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Extensions of the languages that are indexed (fixed values).
EXTENSIONS = {
    "rs": "rust", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "py": "python", "pyi": "python", "go": "go", "kt": "kotlin", "kts": "kotlin",
    "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "swift": "swift", "md": "markdown",
}


def collect_files(spark: SparkSession, root: str, ignored: list[str] | None = None) -> DataFrame:
    """(path, language, sha256, size, content) of the source files below ``root``, paths relative to it.

    Only names with a known extension are listed, so others are never read; ``ignored``: regular expressions of paths to leave out.
    """
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(EXTENSIONS) + "}").load(base)
    # both without a scheme: the listing writes file:/a for file:///a
    bare = "/" + re.sub(r"^[a-z0-9]+:", "", base).lstrip("/")
    rows = files.withColumn("path", F.substr(F.regexp_replace("path", r"^[a-z0-9]+:/+", "/"), F.lit(len(bare) + 2)))
    for pattern in ignored or []:
        rows = rows.where(~F.col("path").rlike(pattern))
    kinds = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    return rows.select("path", kinds[F.lower(F.substring_index("path", ".", -1))].alias("language"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"), "content")


def read_declared(spark: SparkSession, path: str, schema: StructType | str, form: str = "parquet") -> DataFrame:
    """A table (Parquet or JSON lines) that must have the columns of ``schema``; others are left out.

    Trackers and compiler indexes come in this way: their mirrors write such tables, and nothing here talks to them. A Parquet table without a column or
    with another type is refused before anything is read.
    """
    wanted = spark.createDataFrame([], schema).schema
    if form == "json":
        return spark.read.schema(wanted).option("mode", "FAILFAST").json(path)
    have = {f.name: f.dataType for f in spark.read.parquet(path).schema.fields}
    wrong = [f.name for f in wanted.fields if have.get(f.name) != f.dataType]
    if wrong:
        raise ValueError(f"{path} lacks {wrong}, or has other types")
    return spark.read.parquet(path).select(*[f.name for f in wanted.fields])


def write_text_store(texts: DataFrame, path: str) -> None:
    """Texts as a Parquet store of zstandard pages, ordered by their key within each file, so that a point read skips most of it."""
    texts.sortWithinPartitions(texts.columns[0]).write.option("compression", "zstd").parquet(path)


def as_json(rows: DataFrame) -> DataFrame:
    """(value): each row as one JSON object, nulls left out."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))

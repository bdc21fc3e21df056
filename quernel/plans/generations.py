"""Generations: write a new snapshot beside the old one, whole or only the buckets that changed, then flip one pointer file."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "CURRENT"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def publish(df: DataFrame, root: str) -> str:
    """Write ``df`` as a new generation under ``root`` and make it the current one atomically.

    A failed or lost task leaves the pointer on the former generation. Returns the generation's name.
    """
    spark = df.sparkSession
    name = f"gen-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{name}")
    _flip(spark, root, name)
    return name


def _flip(spark: SparkSession, root: str, content: str) -> None:
    """Make ``content`` the pointer of ``root`` in one rename."""
    jvm, fs, base = _fs(spark, root)
    tmp = jvm.org.apache.hadoop.fs.Path(base, f".{POINTER}-{uuid.uuid4().hex}")
    out = fs.create(tmp, True)
    out.write(bytearray(content.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(base.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(tmp), fs.makeQualified(jvm.org.apache.hadoop.fs.Path(base, POINTER)), options)


def current(spark: SparkSession, root: str) -> str | None:
    """Name of the published generation, None before the first."""
    jvm, fs, base = _fs(spark, root)
    at = jvm.org.apache.hadoop.fs.Path(base, POINTER)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def read_current(spark: SparkSession, root: str) -> DataFrame:
    """The published snapshot."""
    name = current(spark, root)
    if name is None:
        raise FileNotFoundError(f"nothing published under {root}")
    return spark.read.parquet(f"{root}/{name}")


BUCKET = "_bucket"


def bucket_of(keys: list[str], buckets: int):
    """The bucket of a row by its keys."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _manifest(spark: SparkSession, root: str) -> dict:
    content = current(spark, root)
    return json.loads(content) if content else {"buckets": None, "paths": {}}


def publish_buckets(df: DataFrame, root: str, keys: list[str], buckets: int) -> None:
    """Replace the buckets that ``df`` has rows of, and make them current together with the others as they were.

    ``df`` must hold all rows of the buckets it touches. The pointer names each bucket's folder, so a step costs what it
    changes, not what there is. The number of buckets is that of the first generation.
    """
    spark, now = df.sparkSession, _manifest(df.sparkSession, root)
    buckets = now["buckets"] or buckets
    name = f"gen-{uuid.uuid4().hex}"
    df.withColumn(BUCKET, bucket_of(keys, buckets)).write.partitionBy(BUCKET).parquet(f"{root}/{name}")
    jvm, fs, made = _fs(spark, f"{root}/{name}")
    fresh = {x.getPath().getName().split("=")[1]: f"{name}/{x.getPath().getName()}" for x in fs.listStatus(made) if x.isDirectory()}
    _flip(spark, root, json.dumps({"buckets": buckets, "paths": now["paths"] | fresh}))


def read_buckets(spark: SparkSession, root: str, touched: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame | None:
    """The current rows, or those of the buckets that ``touched`` has rows of; None where nothing is published there."""
    now = _manifest(spark, root)
    paths = now["paths"]
    if touched is not None and paths:
        wanted = {str(r[BUCKET]) for r in touched.select(bucket_of(keys, now["buckets"]).alias(BUCKET)).distinct().collect()}  # at most the buckets
        paths = {k: v for k, v in paths.items() if k in wanted}
    return spark.read.parquet(*[f"{root}/{p}" for _, p in sorted(paths.items())]) if paths else None

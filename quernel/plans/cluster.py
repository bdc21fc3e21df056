"""What every operator needs from the cluster: a shared folder, lineage cuts, checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE_ROOT = str(Path(__file__).resolve().parents[2])


def ensure_importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    On a cluster without a shared code path, ship the package with ``--py-files`` instead.
    """
    env = spark.sparkContext.environment
    if PACKAGE_ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (PACKAGE_ROOT, env.get("PYTHONPATH")) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only with a local master (tests, a laptop) is a temporary folder made and set where the setting is absent.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="quernel-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", at)
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably in the shared folder and drop its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the application's part of the shared folder."""
    return f"{_own(spark)}/{name}-{uuid.uuid4().hex}"


def _own(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/quernel/{spark.sparkContext.applicationId}"


def clean_scratch(spark: SparkSession) -> None:
    """Delete all that this application has spilled and published there; only once nothing reads it any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own(spark))
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def spill_table(df: DataFrame, name: str, instead: DataFrame | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back (columnar, pruned on reading).

    ``instead``: the spilled table of the round before, which nothing needs once this one is written; it is deleted.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._spilled = path
    if instead is not None and getattr(instead, "_spilled", None):
        drop_spilled(instead)
    return out


def drop_spilled(df: DataFrame) -> None:
    """Delete the table behind a spilled DataFrame."""
    spark = df.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._spilled)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast when ``df`` was counted to have at most ``max_rows``; else leave a shuffle join.

    ``df`` should be cheap to count (a small table or an aggregate of one).
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def tasks_for(spark: SparkSession, rows: int, rows_per_task: int) -> int:
    """Shuffle partitions so that each holds about ``rows_per_task``, never fewer than the session's setting."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_per_task), 1)

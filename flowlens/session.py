"""Session and shared-folder helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "flowlens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, adaptive execution and quiet progress output."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


@cache
def _own_folder() -> tempfile.TemporaryDirectory:
    """One folder per process, gone when it ends."""
    return tempfile.TemporaryDirectory(prefix="flowlens-", ignore_cleanup_errors=True)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the one the cluster names in ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    return _own_folder().name


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage through a reliable checkpoint, so later stages and retries see the same rows."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return os.path.join(shared_dir(spark), f"flowlens-{uuid.uuid4().hex}", name)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table below the shared folder, read again: one computation, whatever reads it, and no lineage."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

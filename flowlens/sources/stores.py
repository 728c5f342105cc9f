"""Sinks and small stored artefacts: flow store, drift snapshots, specs, manifests."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence

import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


READ_BYTES = 8 << 20


def first_delivery(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row per key: the first in ``order``."""
    return df.groupBy(F.col(key).alias("_key")).agg(
        F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_row")).select("_row.*")


def ignore_known(batch: DataFrame, stored: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Rows of the batch whose key is not stored yet, once each."""
    return first_delivery(batch.join(stored.select(key), key, "left_anti").select(*batch.columns), key, order)


def sink_flows_idempotent(
    batch: DataFrame, path: str, key: str = "flow_id", order: Sequence[str] = ("observed_at",), batch_id: int | None = None,
) -> None:
    """Add the rows whose key is new to a pruned store (see flow_store); without ``batch_id`` as the next batch.

    Delivering a batch again changes nothing.
    """
    from flowlens.sources.flow_store import FlowStore

    store = FlowStore(path, key, order)
    store.sink(batch, store.last_batch(batch.sparkSession) + 1 if batch_id is None else batch_id)


def append_drift_snapshot(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def latest_snapshot(df: DataFrame, model: str = "model_version", order: str = "id") -> DataFrame:
    """The newest snapshot of every model version."""
    return df.groupBy(F.col(model).alias("_m")).agg(
        F.max_by(F.struct(*df.columns), F.col(order)).alias("_row")).select("_row.*")


def write_spec(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def read_spec(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def spec_fingerprint(spec: DataFrame, order: str = "pos") -> DataFrame:
    """SHA-256 over the ordered rows of a spec table (a few rows per feature)."""
    cols = [order, *[c for c in spec.columns if c != order]]
    rows = F.array_sort(F.collect_list(F.struct(*cols)))
    return spec.agg(F.sha2(F.to_json(rows), 256).alias("sha256"), F.count(F.lit(1)).alias("features"))


@F.pandas_udf(StringType())
def _file_sha256(paths: pd.Series) -> pd.Series:
    def digest(path: str) -> str:
        uri = re.sub(r"^file:/(?!/)", "file:///", path)
        files, name = FileSystem.from_uri(uri)
        h = hashlib.sha256()
        with files.open_input_stream(name) as f:
            while chunk := f.read(READ_BYTES):
                h.update(chunk)
        return h.hexdigest()
    return paths.map(digest)


def file_manifest(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Name below ``path``, size and SHA-256 of every file. Files are read in pieces, so their size does not matter."""
    root = re.sub(r"^[a-z0-9]+:/*", "/", path).rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return files.select(
        F.substring_index("path", root, -1).alias("name"), F.col("length").alias("size"),
        _file_sha256("path").alias("sha256"))


def verify_manifest(manifest: DataFrame, present: DataFrame) -> DataFrame:
    """Files that are missing, unlisted or different."""
    want = manifest.select("name", F.col("size").alias("_s"), F.col("sha256").alias("_h"))
    both = want.join(present, "name", "full_outer")
    problem = (
        F.when(F.col("sha256").isNull(), "missing").when(F.col("_h").isNull(), "unlisted")
        .when((F.col("sha256") != F.col("_h")) | (F.col("size") != F.col("_s")), "mismatched")
    )
    return both.select("name", problem.alias("problem")).where(F.col("problem").isNotNull())

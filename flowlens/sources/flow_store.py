"""Flow store that ignores known ids and reads only the files that may hold them.

Layout below ``path``: ``store_batch=<n>/store_day=<day>/`` with rows sorted by an id bucket. Beside it, ``<path>.index``
has one row per batch, day and bucket: a Bloom filter of the ids (about 10 bits each, one false hit in a hundred).
A batch asks the filters first. New ids touch no stored file at all; re-delivered ones lead to the days they lie in, and
of those only the ids of the named buckets are read.

A batch writes its own folders and looks only at earlier batches; the index is written last and commits it. So a batch that
runs again, after a failure or because it is delivered twice under its id, replaces itself and adds nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.sources.stores import first_delivery

BITS_PER_ID, PROBES = 10, 7
INDEX = "store_day string, bucket int, n long, bits binary"
FILE_DAY = "store_day"
BUCKET = "store_bucket"


def _places(hashes: np.ndarray, size: int) -> np.ndarray:
    """The bits of each id: a row of ``PROBES`` places."""
    u = hashes.astype(np.int64).view(np.uint64)
    step = (u >> np.uint64(32)) | np.uint64(1)
    return ((u & np.uint64(0xFFFFFFFF))[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) % np.uint64(size)


def bloom_of(hashes: np.ndarray) -> bytes:
    bits = np.zeros(max(64, -(-len(hashes) * BITS_PER_ID // 8) * 8), dtype=bool)
    bits[_places(hashes, len(bits)).ravel().astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def may_contain(bloom: bytes, hashes: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(bloom, dtype=np.uint8)).astype(bool)
    return bits[_places(hashes, len(bits)).astype(np.int64)].all(axis=1)


@dataclass
class FlowStore:
    """One store; ``order`` decides which delivery of an id is kept, its first column gives the day.

    ``buckets`` bounds what a task holds: the filters of one bucket, 1.25 bytes x stored ids / buckets.
    """

    path: str
    key: str = "flow_id"
    order: Sequence[str] = ("observed_at",)
    buckets: int = 64

    @property
    def index_path(self) -> str:
        return self.path.rstrip("/") + ".index"

    def last_batch(self, spark: SparkSession) -> int:
        """The newest committed batch; -1 before the first."""
        jvm = spark.sparkContext._jvm
        found = jvm.org.apache.hadoop.fs.Path(f"{self.index_path}/store_batch=*/_SUCCESS")
        made = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(found) or []
        return max((int(str(s.getPath().getParent().getName()).split("=")[1]) for s in made), default=-1)

    def _hash(self):
        return F.xxhash64(F.col(self.key).cast("string"))

    def _bucket(self):
        return F.pmod(self._hash(), F.lit(self.buckets)).cast("int")

    def files_that_may_hold(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """``store_batch, store_day, bucket`` of earlier batches whose filter knows one of the batch's ids."""
        spark = batch.sparkSession
        index = spark.read.schema(INDEX + ", store_batch int").parquet(self.index_path).where(F.col("store_batch") < batch_id)
        ids = batch.select(self._bucket().alias("bucket"), self._hash().alias("h"))

        def probe(key: tuple, asked: pa.Table, files: pa.Table) -> pa.Table:
            hashes = asked["h"].to_numpy()
            hit = [len(hashes) > 0 and bool(may_contain(b.as_py(), hashes).any()) for b in files["bits"]]
            return files.filter(pa.array(hit, pa.bool_())).select(["store_batch", "store_day", "bucket"])

        return ids.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInArrow(probe, "store_batch int, store_day string, bucket int")

    def known_rows(self, batch: DataFrame, batch_id: int) -> DataFrame | None:
        """The ids stored in the files that may hold one of the batch's; None where there is no such file."""
        spark = batch.sparkSession
        if self.last_batch(spark) < 0 or batch_id == 0:
            return None
        # a row per file and bucket touched: names, no data
        found = self.files_that_may_hold(batch, batch_id).distinct().collect()
        if not found:
            return None
        paths = sorted({f"{self.path}/store_batch={r['store_batch']}/store_day={r['store_day']}" for r in found})
        stored = spark.read.option("basePath", self.path).parquet(*paths)
        return stored.where(F.col(BUCKET).isin(sorted({r["bucket"] for r in found}))).select(self.key)

    def sink(self, batch: DataFrame, batch_id: int) -> None:
        """Add the rows whose id is new, once each; fits ``foreachBatch``."""
        spark = batch.sparkSession
        fresh = first_delivery(batch, self.key, self.order)
        known = self.known_rows(batch, batch_id)
        if known is not None:
            fresh = fresh.join(known, self.key, "left_anti").select(*batch.columns)
        kind = dict(batch.dtypes)[self.order[0]]
        day = F.date_format(self.order[0], "yyyy-MM-dd") if kind.startswith(("timestamp", "date")) else F.lit("all")
        out = f"{self.path}/store_batch={batch_id}"
        # rebalanced: a day with most rows is split over tasks, small days share one
        dealt = fresh.withColumns({BUCKET: self._bucket(), FILE_DAY: F.coalesce(day, F.lit("none"))}).hint("rebalance", FILE_DAY)
        dealt.sortWithinPartitions(FILE_DAY, BUCKET).write.mode("overwrite").partitionBy(FILE_DAY).parquet(out)
        schema = dealt.schema
        rows = spark.read.schema(schema).parquet(out).select(FILE_DAY, F.col(BUCKET).alias("bucket"), self._hash().alias("h"))

        def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame([{"store_day": key[0], "bucket": key[1], "n": len(pdf), "bits": bloom_of(pdf["h"].to_numpy())}])

        rows.groupBy(FILE_DAY, "bucket").applyInPandas(build, INDEX).write.mode("overwrite").parquet(f"{self.index_path}/store_batch={batch_id}")

    def read(self, spark: SparkSession) -> DataFrame:
        """Rows of all committed batches, in the columns they were given in."""
        last = self.last_batch(spark)
        rows = spark.read.parquet(self.path).where(F.col("store_batch") <= last)
        return rows.drop("store_batch", FILE_DAY, BUCKET)

"""Incidents kept as tables and updated once per micro-batch, aware of analyst closes.

Per-key state inside a streaming operator would bring every flow of a busy key to one
task. Here a micro-batch is folded to ticks first (partial aggregation), merged with the
open ticks of earlier batches, and cut into sessions with the batch operators.

Every batch writes its own folders and reads only the state of the batch before it, so
a batch that is run again after a failure replaces its own output and nothing else. The
progress of the query lies in the store, so batch numbers go on when it is started again.

Flows newer than the watermark are kept as rows, because a close that is still to come
may part them; only flows behind it are folded for good.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlens import constants as K
from flowlens.operators import incidents as I

FLOW_COLUMNS = (
    "kind string, flow_id string, observed_at timestamp, src_ip string, dst_ip string, dst_port int, verdict string, "
    "attack_family string, confidence double, severity double, model_version string")


def as_flow_events(scored: DataFrame) -> DataFrame:
    """Scored flows in the column order of the event stream."""
    return scored.select(F.lit("flow").alias("kind"), "flow_id", "observed_at", "src_ip", "dst_ip", "dst_port", "verdict",
                         "attack_family", "confidence", "severity", "model_version")


def as_close_events(closes: DataFrame) -> DataFrame:
    """Closing actions (src_ip, dst_ip, corr_family, at) as events of the same stream."""
    none = F.lit(None)
    return closes.select(
        F.lit("close").alias("kind"), none.cast("string").alias("flow_id"), F.col("at").alias("observed_at"), "src_ip", "dst_ip",
        none.cast("int").alias("dst_port"), F.lit(K.KNOWN_VERDICT).alias("verdict"), F.col("corr_family").alias("attack_family"),
        none.cast("double").alias("confidence"), none.cast("double").alias("severity"), none.cast("string").alias("model_version"))


@dataclass
class IncidentStore:
    """Folder of open ticks, final incidents and late rows.

    ``delay_s`` is how far behind the newest event a row may be; older rows go to the
    late table. Closes take effect on flows that come after them.
    """

    path: str
    gap_s: int = K.SESSION_GAP_S
    delay_s: int = 600

    def _state(self, spark: SparkSession, batch_id: int) -> tuple[DataFrame, DataFrame, DataFrame, int | None] | None:
        if batch_id < 0:
            return None
        root = f"{self.path}/state/batch={batch_id}"
        mark = spark.read.json(f"{root}/mark", schema="watermark bigint").head()
        return spark.read.parquet(f"{root}/ticks"), spark.read.parquet(f"{root}/recent"), spark.read.parquet(f"{root}/closes"), mark["watermark"]

    def _fold(self, rows: DataFrame, closes: DataFrame, earlier: DataFrame | None) -> DataFrame:
        folded = I.fold_ticks(rows, I.KEYS, "observed_at", self.gap_s, I.first_fold("observed_at"), closes)
        if earlier is None:
            return folded
        return folded.unionByName(earlier).groupBy(*I.KEYS, "_tick", "_sub").agg(*I.merge_fold())

    def update(self, batch: DataFrame, batch_id: int) -> None:
        """Fold one micro-batch in; fits ``foreachBatch``."""
        spark = batch.sparkSession
        before = self._state(spark, batch_id - 1)
        us = F.unix_micros("observed_at")
        batch = batch.persist()
        newest = batch.agg(F.max(us)).head()[0]
        old_mark = before[3] if before else None
        marks = [m for m in (old_mark, None if newest is None else newest - self.delay_s * 1_000_000) if m is not None]
        mark = max(marks) if marks else None

        in_time = batch if old_mark is None else batch.where(us >= F.lit(old_mark))
        if old_mark is not None:
            batch.where(us < F.lit(old_mark)).write.mode("overwrite").parquet(f"{self.path}/late/batch={batch_id}")
        hits = I.correlation_key(in_time.where(F.col("verdict") != K.BENIGN_VERDICT))
        closes = I.close_marks(hits.where(F.col("kind") == "close"), I.KEYS, self.gap_s, "observed_at")
        rows = hits.where(F.col("kind") == "flow")
        if before:
            closes = closes.unionByName(before[2]).distinct()
            rows = rows.unionByName(before[1])
        ticks = before[0] if before else None
        numbered = I.number_sessions(self._fold(rows, closes, ticks), I.KEYS, self.gap_s, closes)
        whole = Window.partitionBy(*I.KEYS, "session")
        limit = F.lit(mark if mark is not None else 0) - self.gap_s * 1_000_000
        numbered = numbered.withColumn("_done", F.max("_hi").over(whole) < limit).persist()

        done = numbered.where(F.col("_done")).groupBy(*I.KEYS, "session").agg(*I.merge_fold())
        I.add_risk(I.incident_rows(done)).write.mode("overwrite").parquet(f"{self.path}/final/batch={batch_id}")
        root = f"{self.path}/state/batch={batch_id}"
        still = numbered.where(~F.col("_done"))
        behind = us < F.lit(mark if mark is not None else 0)
        place = [*I.KEYS, "_tick", "_sub"]
        self._fold(rows.where(behind), closes, ticks).join(still.select(*place), place, "left_semi").write.mode(
            "overwrite").parquet(f"{root}/ticks")
        rows.where(~behind).write.mode("overwrite").parquet(f"{root}/recent")
        oldest = still.agg(F.min("_lo")).head()[0]
        floor = min(x for x in (oldest, mark, 0 if mark is None else mark) if x is not None)
        closes.where(F.col("_at") >= F.lit(floor)).write.mode("overwrite").parquet(f"{root}/closes")
        spark.createDataFrame([(mark,)], "watermark bigint").coalesce(1).write.mode("overwrite").json(f"{root}/mark")
        numbered.unpersist()
        batch.unpersist()
        self._forget(spark, batch_id - 2)

    def _forget(self, spark: SparkSession, batch_id: int) -> None:
        """Remove the state of a batch that can no longer be run again."""
        jvm = spark.sparkContext._jvm
        old = jvm.org.apache.hadoop.fs.Path(f"{self.path}/state/batch={batch_id}")
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    def last_batch(self, spark: SparkSession) -> int:
        """The newest batch with a state; -1 before the first."""
        jvm = spark.sparkContext._jvm
        found = jvm.org.apache.hadoop.fs.Path(f"{self.path}/state/batch=*/mark/_SUCCESS")
        made = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(found) or []
        return max((int(str(s.getPath().getParent().getParent().getName()).split("=")[1]) for s in made), default=-1)

    def final_incidents(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/final").drop("batch")

    def open_incidents(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """Incidents as they stand after a batch, not yet final."""
        ticks, recent, closes, _ = self._state(spark, batch_id)
        numbered = I.number_sessions(self._fold(recent, closes, ticks), I.KEYS, self.gap_s, closes)
        return I.add_risk(I.incident_rows(numbered.groupBy(*I.KEYS, "session").agg(*I.merge_fold())))

    def late_rows(self, spark: SparkSession) -> DataFrame:
        """Rows that came after the watermark had passed them; none is an empty table."""
        jvm = spark.sparkContext._jvm
        late = jvm.org.apache.hadoop.fs.Path(f"{self.path}/late")
        if not late.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(late):
            return spark.createDataFrame([], FLOW_COLUMNS)
        return spark.read.schema(FLOW_COLUMNS).parquet(f"{self.path}/late/*")

    def run_available(self, stream: DataFrame) -> int:
        """Process everything that is new; returns the last batch id. A further run goes on from there."""
        q = stream.writeStream.trigger(availableNow=True).option(
            "checkpointLocation", f"{self.path}/progress").foreachBatch(self.update).start()
        q.awaitTermination()
        return self.last_batch(stream.sparkSession)

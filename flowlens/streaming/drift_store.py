"""Drift of the last flows as a stream: a check after every so many flows, each stored as a snapshot."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens import constants as K
from flowlens.operators.drift import row_positions, window_checks
from flowlens.session import durable

SNAPSHOT = "checkpoint bigint, window_size bigint, attack_rate double, feature string, psi double"


@dataclass
class RollingDriftStore:
    """Folder of drift snapshots and of the flows that later checks still look back on.

    Flows count in the order they arrive: by micro-batch, inside one by ``order``. The state is the last ``window`` flows
    and the last ``window`` benign flows, whatever has passed before, in two places that batches use in turn. So a batch
    that runs again after a failure finds the state before it and replaces what it had written itself.
    """

    path: str
    order: Sequence[str]
    verdict: str = "verdict"
    window: int = K.DRIFT_WINDOW
    every: int = K.DRIFT_EVERY
    minimum: int = K.DRIFT_MIN_WINDOW

    def _place(self, batch_id: int) -> str:
        return f"{self.path}/recent/{batch_id % 2}"

    def _recent(self, spark: SparkSession, batch_id: int) -> tuple[DataFrame, tuple[int, int]] | None:
        """The flows kept by a batch, and how many flows and benign flows there had been."""
        if batch_id < 0:
            return None
        kept = spark.read.parquet(self._place(batch_id))
        at = kept.agg(F.max("_batch").alias("batch"), F.max("_flows").alias("flows"), F.max("_benign").alias("benign")).head()
        if at["batch"] is None:
            return kept.drop("_batch", "_flows", "_benign"), (0, 0)
        if at["batch"] != batch_id:
            raise RuntimeError(f"{self.path} holds the state of batch {at['batch']}, wanted {batch_id}")
        return kept.drop("_batch", "_flows", "_benign"), (at["flows"], at["benign"])

    def sink(self, batch: DataFrame, ref: DataFrame, batch_id: int) -> None:
        """Check and store one micro-batch."""
        spark = batch.sparkSession
        features = [r["feature"] for r in ref.select("feature").collect()]
        wanted = list(dict.fromkeys([*self.order, self.verdict, *features]))
        earlier = self._recent(spark, batch_id - 1)
        before = earlier[1] if earlier else (0, 0)
        rows = row_positions(batch.select(*wanted), self.order, self.verdict, self.every, before)
        if earlier:
            rows = rows.unionByName(earlier[0])
        rows = durable(rows)
        checks = window_checks(rows, ref, self.verdict, self.window, self.every, self.minimum, before[0])
        checks.write.mode("overwrite").parquet(f"{self.path}/snapshots/batch={batch_id}")
        quiet = F.coalesce(F.col(self.verdict) == K.BENIGN_VERDICT, F.lit(False))
        now = rows.agg(F.max("_seq").alias("seq"), F.max(F.col("_pos") + quiet.cast("bigint")).alias("pos")).head()
        flows, benign = (now["seq"] + 1, now["pos"]) if now["seq"] is not None else (0, 0)
        kept = rows.where((F.col("_seq") >= flows - self.window) | (quiet & (F.col("_pos") >= benign - self.window)))
        kept.withColumns({"_batch": F.lit(batch_id).cast("bigint"), "_flows": F.lit(flows).cast("bigint"), "_benign": F.lit(benign).cast("bigint")}).write.mode(
            "overwrite").parquet(self._place(batch_id))

    def run_available(self, stream: DataFrame, ref: DataFrame) -> DataFrame:
        """Work off everything that is new and return all snapshots; a further run goes on where this one ended."""
        q = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{self.path}/progress").foreachBatch(
            lambda df, batch_id: self.sink(df, ref, batch_id)).start()
        q.awaitTermination()
        return self.snapshots(stream.sparkSession)

    def snapshots(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(SNAPSHOT).parquet(f"{self.path}/snapshots").select(*[c.split()[0] for c in SNAPSHOT.split(", ")])

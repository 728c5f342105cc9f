"""Structured Streaming jobs. The expressions are the batch ones, so a drained stream equals the batch result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens import constants as K
from flowlens.functions import detection as D
from flowlens.models.cell_forest import CellForest
from flowlens.models.forest import FamilyForest, score
from flowlens.operators.drift import windowed_index
from flowlens.operators.evaluate import _outcomes
from flowlens.operators.incidents import KEYS, _incident_id, add_risk, correlation_key
from flowlens.sources.stores import sink_flows_idempotent


def stream_score(
    stream: DataFrame, features: Sequence[str], binary: CellForest | RandomForestClassificationModel, family: FamilyForest | None,
    tau_binary: float, tau_family: float = 0.0, tau_anomaly: float = K.ANOMALY_DISABLED,
) -> DataFrame:
    """Score, decide and weigh every flow; stateless, so it needs no watermark."""
    out = score(stream, features, binary, family)
    fconf = F.col("fconf") if family is not None else None
    closest = F.col("closest_family") if family is not None else F.lit(None).cast("string")
    pct = F.col("anomaly_pct") if "anomaly_pct" in stream.columns else F.lit(0.0)
    out = out.withColumn("verdict", D.verdict(F.col("p_attack"), pct, tau_binary, tau_anomaly, fconf, tau_family))
    out = out.withColumns({
        "confidence": D.confidence(F.col("verdict"), F.col("p_attack"), pct, tau_binary, tau_anomaly),
        "attack_family": D.reported_family(F.col("verdict"), closest),
    })
    probs = F.col("family_probs") if family is not None else F.lit(None).cast("map<string,double>")
    return out.withColumn("severity", D.expected_severity(F.col("attack_family"), probs))


def stream_dedupe(stream: DataFrame, key: str = "flow_id", ts: str = "observed_at", watermark: str = "10 minutes") -> DataFrame:
    """Drop re-delivered flows; the state of a key expires with the watermark."""
    return stream.withWatermark(ts, watermark).dropDuplicatesWithinWatermark([key])


def stream_incidents(
    stream: DataFrame, gap_s: int = K.SESSION_GAP_S, ts: str = "observed_at", watermark: str | None = "10 minutes",
) -> DataFrame:
    """Incidents of a scored stream, each emitted once its session can no longer grow.

    Session windows close ``gap_s`` after the last flow and out-of-order flows within the
    watermark still join or merge sessions. Rows of one key are merged inside each
    partition before the shuffle, so a key that owns most of a batch arrives as a few rows.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    hits = correlation_key(stream.where(F.col("verdict") != K.BENIGN_VERDICT))
    if watermark:
        hits = hits.withWatermark(ts, watermark)
    first = F.struct(F.unix_micros(ts).alias("us"), "flow_id", "dst_port", "verdict", "model_version")
    grouped = hits.groupBy(*KEYS, F.session_window(ts, f"{gap_s} seconds")).agg(
        F.count(F.lit(1)).alias("flow_count"), F.max("confidence").alias("max_confidence"),
        F.avg("severity").alias("severity"), F.max(F.unix_micros(ts)).alias("_hi"), F.min(first).alias("first"))
    return add_risk(grouped.select(
        _incident_id(KEYS, F.col("first.us")).alias("incident_id"), "src_ip", "dst_ip",
        F.col("corr_family").alias("attack_family"), F.col("first.verdict").alias("verdict"),
        F.col("first.dst_port").alias("dst_port"), F.col("first.model_version").alias("model_version"),
        F.lit("new").alias("status"), "flow_count", "max_confidence", "severity",
        F.timestamp_micros("first.us").alias("first_seen"), F.timestamp_micros("_hi").alias("last_seen")))


def stream_drift(
    stream: DataFrame, ref: DataFrame, ts: str = "observed_at", window: str = "5 minutes", slide: str = "1 minute",
    watermark: str | None = "10 minutes", verdict: str = "verdict",
) -> DataFrame:
    """Index of the benign-verdict flows per sliding window and feature."""
    calm = stream.where(F.col(verdict) == K.BENIGN_VERDICT)
    if watermark:
        calm = calm.withWatermark(ts, watermark)
    return windowed_index(calm, ref, ts, window, slide)


def stream_attack_rate(
    stream: DataFrame, ts: str = "observed_at", window: str = "5 minutes", slide: str = "1 minute",
    watermark: str | None = "10 minutes", verdict: str = "verdict",
) -> DataFrame:
    """Flows and share of non-benign verdicts per sliding window, the rate that is shown beside the drift index."""
    if watermark:
        stream = stream.withWatermark(ts, watermark)
    hit = (F.col(verdict) != K.BENIGN_VERDICT).cast("double")
    return stream.groupBy(F.window(ts, window, slide).alias("w")).agg(
        F.count(F.lit(1)).alias("flows"), F.avg(hit).alias("attack_rate")).select(F.col("w.start").alias("start"), "flows", "attack_rate")


def stream_replay_metrics(
    stream: DataFrame, truth: str = "ground_truth", verdict: str = "verdict", ts: str | None = None,
) -> DataFrame:
    """Running outcome counters of a replay (complete mode: one row).

    With ``ts`` also the first and last time, and flows per second between them (null if they are equal).
    """
    times = [F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")] if ts else []
    out = stream.groupBy().agg(
        F.count(F.lit(1)).alias("flows"), *[F.count_if(c).alias(n) for n, c in _outcomes(truth, verdict).items()], *times)
    if not ts:
        return out
    span = (F.unix_micros("last_ts") - F.unix_micros("first_ts")) / F.lit(1e6)
    return out.withColumn("flows_per_s", F.try_divide(F.col("flows").cast("double"), span))


def throughput(df: DataFrame, ts: str, seconds: int = 60) -> DataFrame:
    """Flows per second in consecutive windows; works on tables and streams."""
    return df.groupBy(F.window(ts, f"{seconds} seconds").alias("w")).agg(F.count(F.lit(1)).alias("flows")).select(
        F.col("w.start").alias("start"), "flows", (F.col("flows") / F.lit(float(seconds))).alias("flows_per_s"))


def progress_of(path: str) -> str:
    """Where a table's query keeps its progress: beside the table, so that the next run goes on where the last ended."""
    return path.rstrip("/") + ".progress"


def run_available(stream: DataFrame, path: str, mode: str = "append", progress: str | None = None) -> DataFrame:
    """Process everything that is new, write it below ``path`` and return the stored table.

    Append results go to the file sink; complete results replace the table each time. Progress is kept in ``progress``
    (by default beside the table): a further run on the same path continues with new rows and the state of the last.
    """
    spark = stream.sparkSession
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option(
        "checkpointLocation", progress or progress_of(path))
    if mode == "append":
        q = writer.format("parquet").start(path)
    else:
        q = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def run_flow_store(
    stream: DataFrame, path: str, key: str = "flow_id", order: Sequence[str] = ("observed_at",), progress: str | None = None,
) -> None:
    """Feed the flow store from a stream; a batch that is replayed after a failure adds nothing, a further run goes on."""
    q = stream.writeStream.trigger(availableNow=True).option(
        "checkpointLocation", progress or progress_of(path)).foreachBatch(
        lambda df, batch_id: sink_flows_idempotent(df, path, key, order, batch_id)).start()
    q.awaitTermination()

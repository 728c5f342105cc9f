"""Flows to incidents: correlation keys, sessions, aggregates, risk and links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens import constants as K
from flowlens.functions import detection as D

KEYS = ["src_ip", "dst_ip", "corr_family"]


def correlation_key(df: DataFrame, verdict: str = "verdict", family: str = "attack_family") -> DataFrame:
    """Add ``corr_family``: the family, or Unknown for novel anomalies."""
    return df.withColumn("corr_family", D.correlation_family(F.col(verdict), F.col(family)))


def _tick(ts: str, gap_s: int) -> Column:
    return F.floor(F.unix_micros(ts) / F.lit(gap_s * 1_000_000)).cast("bigint")


def _sub_ticks(df: DataFrame, closes: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Number of close events of the key inside the row's tick that happened before the row.

    The array holds the distinct close times of one key within one gap window.
    """
    per_tick = closes.groupBy(*keys, "_tick").agg(F.collect_set("_at").alias("_ats"))
    us = F.unix_micros(ts)
    joined = df.join(per_tick, [*keys, "_tick"], "left")
    before = F.size(F.filter(F.coalesce("_ats", F.array().cast("array<bigint>")), lambda a: a < us))
    return joined.withColumn("_sub", before.cast("bigint")).drop("_ats")


def close_marks(closes: DataFrame, keys: Sequence[str], gap_s: int, at: str = "at") -> DataFrame:
    """Distinct close times per key with the tick they fall into."""
    return closes.select(*keys, F.unix_micros(at).alias("_at"), _tick(at, gap_s).alias("_tick")).distinct()


def fold_ticks(
    df: DataFrame, keys: Sequence[str], ts: str, gap_s: int, aggs: Sequence[Column] = (), marks: DataFrame | None = None,
) -> DataFrame:
    """One row per key, gap-wide tick and stretch between closes: first and last time and ``aggs``."""
    keys = list(keys)
    ticked = df.withColumn("_tick", _tick(ts, gap_s))
    if marks is None:
        ticked = ticked.withColumn("_sub", F.lit(0).cast("bigint"))
    else:
        ticked = _sub_ticks(ticked, marks, keys, ts)
    us = F.unix_micros(ts)
    return ticked.groupBy(*keys, "_tick", "_sub").agg(F.min(us).alias("_lo"), F.max(us).alias("_hi"), *aggs)


def number_sessions(folded: DataFrame, keys: Sequence[str], gap_s: int, marks: DataFrame | None = None) -> DataFrame:
    """Add ``session``: a new one starts after a gap or behind a close event."""
    keys = list(keys)
    if marks is None:
        folded = folded.withColumn("_epoch", F.col("_sub"))
    else:
        extra = marks.groupBy(*keys, "_tick").agg(F.count(F.lit(1)).alias("_closed"))
        earlier = Window.partitionBy(*keys).orderBy("_tick").rangeBetween(Window.unboundedPreceding, -1)
        folded = (
            folded.withColumn("_closed", F.lit(0).cast("bigint"))
            .unionByName(extra, allowMissingColumns=True)
            .withColumn("_epoch", F.coalesce(F.sum("_closed").over(earlier), F.lit(0)) + F.col("_sub"))
            .where(F.col("_lo").isNotNull()).drop("_closed")
        )
    w = Window.partitionBy(*keys).orderBy("_tick", "_sub")
    starts = (
        F.lag("_hi").over(w).isNull()
        | (F.col("_lo") - F.lag("_hi").over(w) > gap_s * 1_000_000)
        | (F.col("_epoch") != F.lag("_epoch").over(w))
    )
    return folded.withColumn("_new", starts.cast("bigint")).withColumn("session", F.sum("_new").over(w)).drop("_new", "_epoch")


def session_marks(
    df: DataFrame, keys: Sequence[str], ts: str, gap_s: int = K.SESSION_GAP_S,
    aggs: Sequence[Column] = (), closes: DataFrame | None = None, at: str = "at",
) -> DataFrame:
    """Partial sessions: one row per key and gap-wide tick, numbered by session within the key.

    Rows closer than the gap always share a session, and all rows inside one tick are
    closer than that, so a tick folds to one row (count, times, ``aggs``) before the
    per-key window runs. The window then sees at most span / gap rows per key, however
    many flows the key has. With ``closes`` (keys + ``at``) a session also ends at a
    close event that lies between two of its rows.
    """
    marks = None if closes is None else close_marks(closes, keys, gap_s, at)
    return number_sessions(fold_ticks(df, keys, ts, gap_s, aggs, marks), keys, gap_s, marks)


def sessionize(df: DataFrame, keys: Sequence[str], ts: str, gap_s: int = K.SESSION_GAP_S,
               closes: DataFrame | None = None) -> DataFrame:
    """One row per session: keys, session number, count, first and last time."""
    marks = session_marks(df, keys, ts, gap_s, [F.count(F.lit(1)).alias("flow_count")], closes)
    return marks.groupBy(*keys, "session").agg(
        F.sum("flow_count").alias("flow_count"),
        F.timestamp_micros(F.min("_lo")).alias("first_seen"),
        F.timestamp_micros(F.max("_hi")).alias("last_seen"),
    )


def _incident_id(keys: Sequence[str], first_us: Column) -> Column:
    text = F.concat_ws("|", *[F.col(k) for k in keys], first_us.cast("string"))
    return F.concat(F.lit("INC-"), F.upper(F.substring(F.sha2(text, 256), 1, 12)))


def first_fold(ts: str) -> list[Column]:
    """Per-tick partial aggregates of an incident."""
    first = F.struct(
        F.unix_micros(ts).alias("us"), F.col("flow_id"), F.col("dst_port"), F.col("verdict"), F.col("model_version"))
    return [F.count(F.lit(1)).alias("n"), F.max("confidence").alias("conf"), F.sum("severity").alias("sev"),
            F.min(first).alias("first")]


def merge_fold() -> list[Column]:
    """The same aggregates merged over partial rows."""
    return [F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.sum("n").alias("n"), F.max("conf").alias("conf"),
            F.sum("sev").alias("sev"), F.min("first").alias("first")]


def incident_rows(merged: DataFrame) -> DataFrame:
    """Merged sessions -> incident columns."""
    return merged.select(
        _incident_id(KEYS, F.col("_lo")).alias("incident_id"),
        "src_ip", "dst_ip", F.col("corr_family").alias("attack_family"),
        F.col("first.verdict").alias("verdict"), F.col("first.dst_port").alias("dst_port"),
        F.col("first.model_version").alias("model_version"), F.lit("new").alias("status"),
        F.col("n").alias("flow_count"), F.col("conf").alias("max_confidence"), (F.col("sev") / F.col("n")).alias("severity"),
        F.timestamp_micros("_lo").alias("first_seen"), F.timestamp_micros("_hi").alias("last_seen"),
    )


def incident_aggregates(
    flows: DataFrame, gap_s: int = K.SESSION_GAP_S, ts: str = "observed_at", closes: DataFrame | None = None,
) -> DataFrame:
    """Non-benign scored flows -> one row per incident.

    Needs flow_id, ``ts``, src_ip, dst_ip, dst_port, verdict, attack_family, confidence,
    severity and model_version.
    """
    hits = correlation_key(flows.where(F.col("verdict") != K.BENIGN_VERDICT))
    marks = session_marks(hits, KEYS, ts, gap_s, first_fold(ts), closes)
    return incident_rows(marks.groupBy(*KEYS, "session").agg(*merge_fold()))


def add_risk(incidents: DataFrame) -> DataFrame:
    """Add risk_score, risk_level, confidence_band and the ATT&CK technique."""
    out = incidents.withColumn("risk_score", D.risk_score(
        F.col("verdict"), F.col("max_confidence"), F.col("severity"), F.col("flow_count")))
    return mitre_join(out.withColumns({
        "risk_level": D.risk_level(F.col("risk_score")),
        "confidence_band": D.confidence_band(F.col("max_confidence")),
    }))


def mitre_join(df: DataFrame, family: str = "attack_family") -> DataFrame:
    """Add mitre_id and mitre_name (null for families without a technique)."""
    return df.withColumns({"mitre_id": D.mitre_id(F.col(family)), "mitre_name": D.mitre_name(F.col(family))})


def link_flows(flows: DataFrame, gap_s: int = K.SESSION_GAP_S, ts: str = "observed_at",
               closes: DataFrame | None = None) -> DataFrame:
    """Add ``incident_id`` to every flow (null for benign ones).

    A (key, tick) belongs to exactly one incident, so the link is an equality join
    instead of a time-range join.
    """
    keyed = correlation_key(flows)
    hits = keyed.where(F.col("verdict") != K.BENIGN_VERDICT)
    marks = session_marks(hits, KEYS, ts, gap_s, closes=closes)
    w = Window.partitionBy(*KEYS, "session")
    ids = marks.select(*KEYS, "_tick", "_sub", _incident_id(KEYS, F.min("_lo").over(w)).alias("incident_id"))
    quiet = F.col("verdict") == K.BENIGN_VERDICT
    ticked = hits.withColumn("_tick", _tick(ts, gap_s))
    if closes is None:
        ticked = ticked.withColumn("_sub", F.lit(0).cast("bigint"))
    else:
        ticked = _sub_ticks(ticked, close_marks(closes, KEYS, gap_s), KEYS, ts)
    linked = ticked.join(ids, [*KEYS, "_tick", "_sub"], "left")
    rest = keyed.where(quiet).withColumn("incident_id", F.lit(None).cast("string"))
    cols = [*flows.columns, "incident_id"]
    return linked.select(*cols).unionByName(rest.select(*cols))


def batch_response(linked: DataFrame, batch: str, ts: str = "observed_at") -> DataFrame:
    """Per batch: flows received, incidents created, incidents updated.

    An incident is created in the batch of its first flow; every other non-benign flow updates.
    """
    hits = linked.where(F.col("incident_id").isNotNull())
    first = hits.groupBy("incident_id").agg(
        F.min(F.struct(F.unix_micros(ts).alias("us"), F.col("flow_id"), F.col(batch).alias("b"))).alias("f"))
    made = first.groupBy(F.col("f.b").alias(batch)).agg(F.count(F.lit(1)).alias("created"))
    got = linked.groupBy(batch).agg(F.count(F.lit(1)).alias("received"), F.count("incident_id").alias("_hits"))
    joined = got.join(made, batch, "left").withColumn("created", F.coalesce("created", F.lit(0)))
    return joined.select(batch, "received", "created", (F.col("_hits") - F.col("created")).alias("updated"))


def reduction_ratio(incidents: DataFrame) -> DataFrame:
    """Flows per incident over the whole table."""
    return incidents.agg(
        F.sum("flow_count").alias("flows"), F.count(F.lit(1)).alias("incidents"),
        F.try_divide(F.sum("flow_count").cast("double"), F.count(F.lit(1)).cast("double")).alias("flows_per_incident"))


def incident_top_features(attributions: DataFrame, flow_incident: DataFrame, k: int = 5) -> DataFrame:
    """Top features of each incident by mean contribution over its explained flows.

    attributions: flow_id, ts, feature, value, contribution, baseline_median;
    flow_incident: flow_id, incident_id. Features a flow lacks count as 0.
    """
    rows = attributions.join(flow_incident.select("flow_id", "incident_id"), "flow_id").where(
        F.col("incident_id").isNotNull())
    explained = rows.groupBy("incident_id").agg(F.count_distinct("flow_id").alias("explained"))
    latest = F.max(F.struct("ts", "flow_id", "value", "baseline_median"))
    per = rows.groupBy("incident_id", "feature").agg(F.sum("contribution").alias("_sum"), latest.alias("_l"))
    mean = per.join(explained, "incident_id").select(
        "incident_id", "feature", "explained", (F.col("_sum") / F.col("explained")).alias("_mean"),
        F.col("_l.value").alias("value"), F.col("_l.baseline_median").alias("baseline_median"))
    w = Window.partitionBy("incident_id").orderBy(F.desc(F.abs("_mean")), "feature")
    return mean.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(
        "incident_id", "rank", "feature", "value", F.round("_mean", 4).alias("contribution"), "baseline_median")

"""Analyst queue: lists, details, action log, live metrics."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens import constants as K
from flowlens.functions.exprs import fixed, lookup
from flowlens.plans.recipes import quantiles


def list_incidents(
    df: DataFrame, status: str | None = None, verdict: str | None = None, family: str | None = None,
    level: str | None = None, since: str | None = None, sort: str = "risk", limit: int = 50, offset: int = 0,
) -> DataFrame:
    """One page of the queue with the total before paging; unknown sorts mean risk."""
    for col, want in (("status", status), ("verdict", verdict), ("attack_family", family), ("risk_level", level)):
        if want is not None:
            df = df.where(F.col(col) == want)
    if since is not None:
        df = df.where(F.col("first_seen") >= F.lit(since).cast("timestamp"))
    total = df.count()
    lead = F.desc("last_seen") if sort == "last_seen" else F.desc("risk_score")
    page = df.orderBy(lead, "incident_id").offset(offset).limit(limit)
    return page.withColumn("total", F.lit(total).cast("bigint"))


def incident_detail(incidents: DataFrame, linked: DataFrame, actions: DataFrame, incident_id: str, flows: int = 20) -> DataFrame:
    """The incident with its first flows and its actions in time order, one row per flow or action.

    Flows come with their parsed feature map where ``linked`` has the raw features (JSON, ``props``).
    """
    raw = F.col("props") if "props" in linked.columns else F.lit(None).cast("string")
    one = incidents.where(F.col("incident_id") == incident_id)
    sample = (
        linked.where(F.col("incident_id") == incident_id)
        .select("incident_id", F.lit("flow").alias("kind"), F.col("flow_id").alias("ref"), F.col("observed_at").alias("at"),
                F.from_json(raw, "map<string,double>").alias("features"))
        .orderBy("at", "ref").limit(flows)
    )
    log = actions.where(F.col("incident_id") == incident_id).select(
        "incident_id", F.lit("action").alias("kind"), F.col("action").alias("ref"), "at", F.lit(None).cast("map<string,double>").alias("features"))
    return one.join(sample.unionByName(log), "incident_id", "left").orderBy("kind", "at", "ref")


_CLOSING = ("dismiss_fp", "resolve")
_CODES = 16  # room for the action's number in a place
_IDS = Decimal(1 << 64)
_HALF = Decimal(1 << 63)


def _place() -> Column:
    """Time, action id and action as one number that sorts like them: a fixed-width value, so aggregates of it hash."""
    code = F.coalesce(F.array_position(F.array(*[F.lit(a) for a in K.ACTIONS]), F.col("action")), F.lit(0))
    us = F.unix_micros("at").cast("decimal(17,0)")
    ids = F.col("action_id").cast("decimal(20,0)") + F.lit(_HALF).cast("decimal(20,0)")
    return ((us * F.lit(_IDS).cast("decimal(20,0)") + ids) * F.lit(_CODES).cast("decimal(2,0)") + code.cast("decimal(2,0)")).cast("decimal(38,0)")


def _action(place: str) -> Column:
    return F.get(F.array(*[F.lit(a) for a in K.ACTIONS]), (F.col(place) % F.lit(_CODES)).cast("int") - 1)


def _at(place: str) -> Column:
    return F.timestamp_micros(F.expr(f"{place} div {_IDS * _CODES}BD"))


def accepted_actions(actions: DataFrame) -> DataFrame:
    """The actions up to and including the first closing one of their incident (action ids are integers)."""
    placed = actions.withColumn("_place", _place())
    ends = placed.where(F.col("action").isin(*_CLOSING)).groupBy("incident_id").agg(F.min("_place").alias("_end"))
    return placed.join(ends, "incident_id", "left").where(
        F.col("_end").isNull() | (F.col("_place") <= F.col("_end"))).select(*actions.columns)


def fold_actions(actions: DataFrame) -> DataFrame:
    """Action log -> final status per incident and number of accepted actions.

    The first closing action ends the log: it is the last accepted one, later ones were rejected. Without one the
    latest acknowledge or escalate decides. ``acknowledged_at`` is the time of the first status-changing action if
    that is an acknowledge. Everything is a min or max of one number, so a long log is folded before the shuffle.
    """
    place, moving = F.col("_place"), F.col("action").isin(list(K.ACTION_STATUS))
    got = accepted_actions(actions).withColumn("_place", _place()).groupBy("incident_id").agg(
        F.max(F.when(moving, place)).alias("_last"), F.min(F.when(moving, place)).alias("_first"),
        F.count(F.lit(1)).alias("actions"))
    return got.select(
        "incident_id", "actions",
        F.coalesce(lookup(_action("_last"), K.ACTION_STATUS), F.lit("new")).alias("status"),
        F.when(_action("_first") == "acknowledge", _at("_first")).alias("acknowledged_at"),
        F.when(_action("_last").isin(*_CLOSING), _at("_last")).alias("closed_at"),
    )


def live_metrics(flows: DataFrame, incidents: DataFrame, actions: DataFrame, now: Column, by: str = "action") -> DataFrame:
    """One row of service figures; a figure without data is null (latencies are 0).

    flows: received_at, latency_ms; incidents: status, risk_level, first_seen,
    acknowledged_at; actions: the whole log, of which accepted ones count. ``by`` counts
    reviews per action or once per incident.
    """
    f = flows.agg(
        F.count(F.lit(1)).alias("flows_scored_total"),
        (F.count_if(F.col("received_at") >= now - F.expr("INTERVAL 60 SECONDS")) / F.lit(60.0)).alias("flows_per_sec_1m"))
    q = quantiles(flows, ["latency_ms"], {"p50": 0.5, "p95": 0.95}).head()
    is_open = ~F.col("status").isin(K.CLOSED_STATUSES)
    delta = (F.unix_micros("acknowledged_at") - F.unix_micros("first_seen")) / F.lit(1e6)
    i = incidents.agg(
        F.count_if(is_open).alias("incidents_open"),
        *[F.count_if(is_open & (F.col("risk_level") == lv)).alias(f"open_{lv.lower()}") for lv in K.LEVELS],
        F.avg(F.when(delta >= 0, delta)).alias("mtta_seconds"))
    reviews = accepted_actions(actions).where(F.col("action").isin("confirm", "dismiss_fp")).select("incident_id", "action")
    if by == "incident":
        reviews = reviews.distinct()
    yes, no = F.count_if(F.col("action") == "confirm"), F.count_if(F.col("action") == "dismiss_fp")
    a = reviews.agg(
        F.try_divide(yes.cast("double"), (yes + no).cast("double")).alias("analyst_confirmed_precision"),
        F.try_divide(no.cast("double"), (yes + no).cast("double")).alias("fp_dismiss_rate"))
    reviewed, served = a.head(), f.head()
    figures = {
        "flows_scored_total": F.lit(served[0]).cast("bigint"), "flows_per_sec_1m": F.lit(served[1]).cast("double"),
        "analyst_confirmed_precision": F.lit(reviewed[0]).cast("double"), "fp_dismiss_rate": F.lit(reviewed[1]).cast("double"),
        "latency_ms_p50": F.lit(float(q["p50"]) if q else 0.0), "latency_ms_p95": F.lit(float(q["p95"]) if q else 0.0),
    }
    return i.withColumns(figures)


def analyst_matrix(actions: DataFrame, analyst: str = "analyst") -> DataFrame:
    """Analyst x accepted action counts with a total, busiest analyst first."""
    wide = accepted_actions(actions).groupBy(analyst).pivot("action", K.ACTIONS).count().na.fill(0)
    total = sum((F.col(a) for a in K.ACTIONS), F.lit(0))
    return wide.withColumn("total", total.cast("bigint")).orderBy(F.desc("total"), analyst)


def action_counts(actions: DataFrame) -> DataFrame:
    """Accepted actions by kind."""
    return accepted_actions(actions).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def open_novel_count(incidents: DataFrame) -> DataFrame:
    """Open incidents whose verdict is novel."""
    return incidents.agg(F.count_if(
        (F.col("verdict") == K.NOVEL_VERDICT) & ~F.col("status").isin(K.CLOSED_STATUSES)).alias("open_novel"))


def new_since(previous: DataFrame | None, current: DataFrame, key: str = "incident_id") -> DataFrame:
    """Keys present now and absent before; none on the first snapshot."""
    ids = current.select(key).distinct()
    return ids.limit(0) if previous is None else ids.join(previous.select(key), key, "left_anti")


# interpretation lines (fixed values)
PRECISION_NONE = "Precision data unavailable — no analyst reviews recorded yet."
PRECISION_GOOD = "Model precision is healthy — analyst-confirmed classifications are accurate."
PRECISION_LOW = "Precision is below 85% — review SHAP feature attribution and refine thresholds."
MTTA_NONE = "MTTA data unavailable."
MTTA_FAST = "Excellent response time (< 2 min)."
MTTA_FAIR = "Acceptable response time (2–5 min)."
MTTA_SLOW = "MTTA exceeds 5 minutes — consider staffing review."


def metric_bands(df: DataFrame, precision: str = "precision", mtta: str = "mtta_seconds") -> DataFrame:
    """Add bands and wording for confirmed precision and time to acknowledge."""
    p, m = F.col(precision), F.col(mtta)
    return df.withColumns({
        "precision_band": F.when(p.isNull(), "none").when(p >= 0.85, "ok").when(p >= 0.70, "medium").otherwise("high"),
        "precision_text": F.when(p.isNull(), PRECISION_NONE).when(p >= 0.85, PRECISION_GOOD).otherwise(PRECISION_LOW),
        "mtta_text": F.when(m.isNull(), MTTA_NONE).when(m < 120, MTTA_FAST).when(m < 300, MTTA_FAIR).otherwise(MTTA_SLOW),
        "mtta_label": F.when(m.isNull(), "—").when(m < 60, F.concat(fixed(m, 0), F.lit(" s")))
        .when(m < 3600, F.concat(fixed(m / 60, 1), F.lit(" min"))).otherwise(F.concat(fixed(m / 3600, 2), F.lit(" hr"))),
    })


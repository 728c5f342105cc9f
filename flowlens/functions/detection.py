"""Verdict, confidence, family, severity and risk as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowlens import constants as K
from flowlens.functions.exprs import literal_map, lookup


def verdict(
    p: Column, percentile: Column, tau_binary: float | Column,
    tau_anomaly: float = K.ANOMALY_DISABLED, family_conf: Column | None = None,
    tau_family: float | Column = 0.0,
) -> Column:
    """Attack above the binary threshold (novel if its family is unsure), else novel if it looks strange."""
    unsure = F.lit(False) if family_conf is None else F.coalesce(family_conf < tau_family, F.lit(False))
    return (
        F.when((p >= tau_binary) & unsure, K.NOVEL_VERDICT)
        .when(p >= tau_binary, K.KNOWN_VERDICT)
        .when(percentile >= tau_anomaly, K.NOVEL_VERDICT)
        .otherwise(K.BENIGN_VERDICT)
    )


def novel_confidence(percentile: Column, tau_anomaly: float) -> Column:
    """Percentile in [tau, 100] mapped onto [0.5, 1]."""
    if tau_anomaly >= 100:
        return F.lit(0.0)
    scaled = F.lit(0.5) + F.lit(0.5) * (percentile - tau_anomaly) / F.lit(100.0 - tau_anomaly)
    return F.when(percentile >= tau_anomaly, scaled).otherwise(F.lit(0.0))


def confidence(v: Column, p: Column, percentile: Column, tau_binary: float, tau_anomaly: float) -> Column:
    strange = F.when(p >= tau_binary, p).otherwise(novel_confidence(percentile, tau_anomaly))
    return F.when(v == K.KNOWN_VERDICT, p).when(v == K.NOVEL_VERDICT, strange).otherwise(F.lit(0.0))


def reported_family(v: Column, closest: Column) -> Column:
    """Known attacks carry the closest family (or Malicious without a family head)."""
    return (
        F.when(v == K.KNOWN_VERDICT, F.coalesce(closest, F.lit("Malicious")))
        .when(v == K.NOVEL_VERDICT, F.lit("Unknown"))
        .otherwise(F.lit("BENIGN"))
    )


def correlation_family(v: Column, family: Column) -> Column:
    return F.when((v == K.NOVEL_VERDICT) | (family == "Unknown"), F.lit("Unknown")).otherwise(family)


def severity_of(family: Column) -> Column:
    return lookup(family, K.SEVERITY, F.lit(K.DEFAULT_SEVERITY))


def expected_severity(family: Column, probs: Column) -> Column:
    """Severity averaged over the family probabilities; the family's own weight without any."""
    weights = literal_map(K.SEVERITY)
    entries = F.map_entries(probs)
    zero = F.struct(F.lit(0.0).alias("num"), F.lit(0.0).alias("den"))
    total = F.aggregate(
        entries, zero,
        lambda acc, e: F.struct(
            (acc["num"] + e["value"] * F.coalesce(
                F.try_element_at(weights, e["key"]), F.lit(K.DEFAULT_SEVERITY))).alias("num"),
            (acc["den"] + e["value"]).alias("den"),
        ),
        lambda acc: F.when(acc["den"] > 0, acc["num"] / acc["den"]),
    )
    return F.coalesce(total, severity_of(family))


def burst(flow_count: Column) -> Column:
    size = F.log10(F.greatest(flow_count, F.lit(1)).cast("double")) / 3
    return F.lit(1.0) + F.lit(K.BURST_MAX_BOOST) * F.least(F.lit(1.0), size)


def risk_score(v: Column, conf: Column, sev: Column, flow_count: Column) -> Column:
    """0..100, rounded half to even; the product keeps the order confidence, severity, burst."""
    bonus = F.when(v == K.NOVEL_VERDICT, F.lit(K.NOVELTY_BONUS)).otherwise(F.lit(0.0))
    raw = conf * sev * burst(flow_count) + bonus
    clamped = F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0))
    return F.when(v == K.BENIGN_VERDICT, F.lit(0)).otherwise(F.rint(F.lit(100.0) * clamped).cast("int"))


def risk_level(score: Column) -> Column:
    return F.when(score >= K.HIGH_RISK, "HIGH").when(score >= K.MEDIUM_RISK, "MEDIUM").otherwise("LOW")


def confidence_band(conf: Column) -> Column:
    return F.when(conf >= K.HIGH_BAND, "high").when(conf >= K.MEDIUM_BAND, "medium").otherwise("low")


def mitre_id(family: Column) -> Column:
    return lookup(family, {f: t[0] for f, t in K.MITRE.items()})


def mitre_name(family: Column) -> Column:
    return lookup(family, {f: t[1] for f, t in K.MITRE.items()})


def drift_status(psi: Column) -> Column:
    return F.when(psi >= K.PSI_ALERT, "alert").when(psi >= K.PSI_WATCH, "watch").otherwise("ok")

"""Queries over sessions, incidents, risk and links."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens import constants as K
from flowlens.catalog.registry import ntz, query, r6
from flowlens.functions import detection as D
from flowlens.operators import incidents as I
from flowlens.plans import bindings as B

GAP = 21600


def islands_sql(gap_s: int = GAP, closes: str | None = None) -> str:
    """CTEs over ``scored``: ``marked`` (flow rows with session number) and ``inc`` (incidents)."""
    epoch = f"(SELECT count(*) FROM {closes} c WHERE c.src_ip = h.src_ip AND c.dst_ip = h.dst_ip AND c.corr_family = h.fam AND c.at < h.observed_at)" if closes else "0"
    return f"""hits0 AS (SELECT *, CASE WHEN verdict = 'novel_anomaly' THEN 'Unknown' ELSE attack_family END AS fam FROM scored WHERE verdict <> 'benign'),
 hits AS (SELECT h.*, {epoch} AS epoch FROM hits0 h),
 brk AS (SELECT *, CASE WHEN lag(observed_at) OVER w IS NULL OR epoch_us(observed_at) - epoch_us(lag(observed_at) OVER w) > cast({gap_s} AS bigint) * 1000000 OR epoch <> lag(epoch) OVER w THEN 1 ELSE 0 END AS b
 FROM hits WINDOW w AS (PARTITION BY src_ip, dst_ip, fam ORDER BY observed_at, flow_id)),
 marked AS (SELECT *, cast(sum(b) OVER (PARTITION BY src_ip, dst_ip, fam ORDER BY observed_at, flow_id) AS bigint) AS session FROM brk),
 inc AS (SELECT src_ip, dst_ip, fam, session, 'INC-' || upper(substr(sha256(src_ip || '|' || dst_ip || '|' || fam || '|' || cast(min(epoch_us(observed_at)) AS varchar)), 1, 12)) AS incident_id,
 count(*) AS flow_count, max(confidence) AS max_confidence, avg(severity) AS severity, min(observed_at) AS first_seen, max(observed_at) AS last_seen,
 first(verdict ORDER BY observed_at, flow_id) AS verdict, first(dst_port ORDER BY observed_at, flow_id) AS dst_port FROM marked GROUP BY 1, 2, 3, 4)"""


RISK = """CASE WHEN verdict = 'benign' THEN 0 ELSE cast(round_even(100e0 * least(1e0, greatest(0e0, {conf} * {sev} * (1e0 + 0.15e0 * least(1e0, log10(cast({n} AS double)) / 3)) + CASE WHEN verdict = 'novel_anomaly' THEN 0.1e0 ELSE 0e0 END)), 0) AS integer) END"""
MITRE_SQL = "CASE {f} " + " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in K.MITRE.items()) + " END"
MITRE_NAME_SQL = "CASE {f} " + " ".join(f"WHEN '{k}' THEN '{v[1]}'" for k, v in K.MITRE.items()) + " END"

RANKED_SQL = f"""WITH {B.SCORED_SQL}, {islands_sql()}, risk AS (SELECT *, {RISK.format(conf='max_confidence', sev='severity', n='flow_count')} AS risk_score FROM inc),
 incidents AS (SELECT incident_id, src_ip, dst_ip, fam AS attack_family, verdict, dst_port, 'new' AS status, flow_count, max_confidence, severity, first_seen, last_seen, risk_score,
 CASE WHEN risk_score >= 70 THEN 'HIGH' WHEN risk_score >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
 CASE WHEN max_confidence >= 0.85e0 THEN 'high' WHEN max_confidence >= 0.6e0 THEN 'medium' ELSE 'low' END AS confidence_band, {MITRE_SQL.format(f='fam')} AS mitre_id, {MITRE_NAME_SQL.format(f='fam')} AS mitre_name FROM risk)"""


def ranked_incidents(spark, sf_dir, gap_s=GAP):
    return I.add_risk(I.incident_aggregates(B.scored(spark, sf_dir), gap_s))


SESSION_COLS = "src_ip, dst_ip, fam AS corr_family, session, flow_count, first_seen, last_seen"


def sessions(spark, sf_dir, gap_s):
    hits = I.correlation_key(B.scored(spark, sf_dir).where(F.col("verdict") != "benign"))
    return ntz(I.sessionize(hits, I.KEYS, "observed_at", gap_s))


@query("i2_sessionize", f"WITH {B.SCORED_SQL}, {islands_sql(300)} SELECT {SESSION_COLS} FROM inc")
def i2_sessionize(spark, sf_dir):
    return sessions(spark, sf_dir, 300)


@query("i2_sessionize_wide", f"WITH {B.SCORED_SQL}, {islands_sql()} SELECT {SESSION_COLS} FROM inc")
def i2_sessionize_wide(spark, sf_dir):
    return sessions(spark, sf_dir, GAP)


@query("i3_incidents", RANKED_SQL + " SELECT incident_id, attack_family, verdict, dst_port, status, flow_count, round(max_confidence, 6) AS max_confidence, round(severity, 6) AS severity, first_seen, last_seen FROM incidents")
def i3_incidents(spark, sf_dir):
    out = I.incident_aggregates(B.scored(spark, sf_dir), GAP)
    return ntz(r6(out.select("incident_id", "attack_family", "verdict", "dst_port", "status", "flow_count", "max_confidence",
                             "severity", "first_seen", "last_seen")))


def attributions(spark, sf_dir):
    """Three signed contributions per flow; flows of low confidence are not explained."""
    f = B.scored(spark, sf_dir).where(F.col("confidence") >= 0.6)
    parts = F.array(
        F.struct(F.lit("value").alias("feature"), F.col("f_value").alias("value"), ((F.col("p_attack") - 0.4) * 0.7310585).alias("c")),
        F.struct(F.lit("k").alias("feature"), F.col("f_k").alias("value"), ((0.5 - F.col("fconf")) * 0.6224593).alias("c")),
        F.struct(F.lit("pct").alias("feature"), F.col("anomaly_pct").alias("value"), (F.col("anomaly_pct") * 0.0017615).alias("c")))
    return f.select("flow_id", F.col("observed_at").alias("ts"), F.explode(parts).alias("x")).select(
        "flow_id", "ts", "x.feature", "x.value", F.col("x.c").alias("contribution"), F.lit(1.0).alias("baseline_median"))


ATTR_SQL = """attr AS (SELECT flow_id, observed_at AS ts, 'value' AS feature, f_value AS value, (p_attack - 0.4e0) * 0.7310585e0 AS c FROM scored WHERE confidence >= 0.6e0
 UNION ALL SELECT flow_id, observed_at, 'k', f_k, (0.5e0 - fconf) * 0.6224593e0 FROM scored WHERE confidence >= 0.6e0 UNION ALL SELECT flow_id, observed_at, 'pct', anomaly_pct, anomaly_pct * 0.0017615e0 FROM scored WHERE confidence >= 0.6e0)"""


@query("i4_top_features", f"""WITH {B.SCORED_SQL}, {islands_sql()}, {ATTR_SQL}, l AS (SELECT flow_id, incident_id FROM marked JOIN inc USING (src_ip, dst_ip, fam, session)),
 j AS (SELECT * FROM attr JOIN l USING (flow_id)), n AS (SELECT incident_id, count(DISTINCT flow_id) AS explained FROM j GROUP BY 1),
 m AS (SELECT incident_id, feature, sum(c) / max(explained) AS mean, last(value ORDER BY ts, flow_id) AS value FROM j JOIN n USING (incident_id) GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY round(abs(mean), 9) DESC, feature) AS rank FROM m)
 SELECT incident_id, cast(rank AS integer) AS rank, feature, round(value, 6) AS value, round(mean, 4) AS contribution FROM r WHERE rank <= 2""")
def i4_top_features(spark, sf_dir):
    linked = I.link_flows(B.scored(spark, sf_dir), GAP).select("flow_id", "incident_id")
    out = I.incident_top_features(attributions(spark, sf_dir), linked, k=2)
    return r6(out.select("incident_id", "rank", "feature", "value", "contribution"))


@query("i5_severity", f"""WITH {B.FLOWS_SQL}, x AS (SELECT event_id, family, CASE WHEN tool <> 'view' THEN fconf END AS a, 1 - fconf AS b, tool FROM flows)
 SELECT event_id, round(CASE WHEN a IS NULL OR tool = 'click' THEN CASE family WHEN 'DoS' THEN 0.8e0 WHEN 'BruteForce' THEN 0.7e0 WHEN 'Botnet' THEN 0.9e0 ELSE 0e0 END ELSE (a * 0.6e0 + b * 1e0 + 0.5e0 * 0.25e0) / (a + b + 0.25e0) END, 6) AS severity FROM x""")
def i5_severity(spark, sf_dir):
    f = B.flows(spark, sf_dir)
    probs = F.create_map(F.lit("WebAttack"), F.col("fconf"), F.lit("Infiltration"), 1 - F.col("fconf"), F.lit("Novelty"), F.lit(0.25))
    zero = F.create_map(F.lit("DoS"), F.lit(0.0))
    m = F.when(F.col("tool") == "click", zero).when(F.col("tool") != "view", probs)
    return r6(f.select("event_id", D.expected_severity(F.col("family"), m).alias("severity")))


@query("i6_burst", "WITH g AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT user_id, n, round(1e0 + 0.15e0 * least(1e0, log10(cast(n AS double)) / 3), 6) AS burst FROM g")
def i6_burst(spark, sf_dir):
    g = B.table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return r6(g.withColumn("burst", D.burst(F.col("n"))))


@query("i7_risk", f"WITH {B.SCORED_SQL} SELECT event_id, {RISK.format(conf='confidence', sev='severity', n='(user_id + 1)')} AS risk_score FROM scored")
def i7_risk(spark, sf_dir):
    f = B.scored(spark, sf_dir)
    return f.select("event_id", D.risk_score(F.col("verdict"), F.col("confidence"), F.col("severity"), F.col("user_id") + 1).alias("risk_score"))


@query("i8_levels", f"WITH {B.FLOWS_SQL} SELECT event_id, CASE WHEN anomaly_pct >= 70 THEN 'HIGH' WHEN anomaly_pct >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level, CASE WHEN p_attack >= 0.85e0 THEN 'high' WHEN p_attack >= 0.6e0 THEN 'medium' ELSE 'low' END AS band FROM flows")
def i8_levels(spark, sf_dir):
    return B.flows(spark, sf_dir).select(
        "event_id", D.risk_level(F.col("anomaly_pct")).alias("risk_level"), D.confidence_band(F.col("p_attack")).alias("band"))


@query("i9_mitre", f"WITH {B.SCORED_SQL} SELECT event_id, attack_family, {MITRE_SQL.format(f='attack_family')} AS mitre_id, {MITRE_NAME_SQL.format(f='attack_family')} AS mitre_name FROM scored")
def i9_mitre(spark, sf_dir):
    return I.mitre_join(B.scored(spark, sf_dir)).select("event_id", "attack_family", "mitre_id", "mitre_name")


LINK_SQL = f"WITH {B.SCORED_SQL}, {islands_sql()}, linked AS (SELECT s.flow_id, s.batch, s.observed_at, incident_id FROM scored s LEFT JOIN marked m ON m.flow_id = s.flow_id LEFT JOIN inc i ON i.src_ip = m.src_ip AND i.dst_ip = m.dst_ip AND i.fam = m.fam AND i.session = m.session)"


@query("i10_link", LINK_SQL + " SELECT flow_id, incident_id FROM linked")
def i10_link(spark, sf_dir):
    return I.link_flows(B.scored(spark, sf_dir), GAP).select("flow_id", "incident_id")


@query("i11_batch_counts", LINK_SQL + """, f AS (SELECT incident_id, first(batch ORDER BY observed_at, flow_id) AS batch FROM linked WHERE incident_id IS NOT NULL GROUP BY 1), c AS (SELECT batch, count(*) AS created FROM f GROUP BY 1)
 SELECT l.batch, count(*) AS received, coalesce(max(created), 0) AS created, count(incident_id) - coalesce(max(created), 0) AS updated FROM linked l LEFT JOIN c ON c.batch = l.batch GROUP BY 1""")
def i11_batch_counts(spark, sf_dir):
    return I.batch_response(I.link_flows(B.scored(spark, sf_dir), GAP), "batch")


@query("i12_ratio", RANKED_SQL + " SELECT cast(sum(flow_count) AS bigint) AS flows, count(*) AS incidents, round(sum(flow_count) / cast(count(*) AS double), 6) AS flows_per_incident FROM incidents")
def i12_ratio(spark, sf_dir):
    return r6(I.reduction_ratio(I.incident_aggregates(B.scored(spark, sf_dir), GAP)))


CLOSES_SQL = "closes AS (SELECT src_ip, dst_ip, fam AS corr_family, observed_at AS at FROM hits0 WHERE tool IN ('purchase', 'view'))"


GUARD_SQL = f"WITH {B.SCORED_SQL}, " + islands_sql(GAP, "closes").replace(" hits AS (", f" {CLOSES_SQL}, hits AS (", 1)


@query("t3_guard", GUARD_SQL + f" SELECT {SESSION_COLS} FROM inc")
def t3_guard(spark, sf_dir):
    hits = I.correlation_key(B.scored(spark, sf_dir).where(F.col("verdict") != "benign"))
    closes = hits.where(F.col("tool").isin("purchase", "view")).select(*I.KEYS, F.col("observed_at").alias("at"))
    return ntz(I.sessionize(hits, I.KEYS, "observed_at", GAP, closes))

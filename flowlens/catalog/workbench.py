"""Queries over the analyst queue, action log, live metrics and briefs."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens import constants as K
from flowlens.catalog.incidents import GAP, RANKED_SQL, ranked_incidents
from flowlens.catalog.registry import ntz, query, r6
from flowlens.operators import brief as BR
from flowlens.operators import incidents as I
from flowlens.operators import workbench as W
from flowlens.plans import bindings as B


@query("i13_queue", RANKED_SQL + """ SELECT incident_id, risk_score, risk_level, attack_family, src_ip, dst_ip, flow_count, first_seen, last_seen, (SELECT count(*) FROM incidents WHERE attack_family <> 'x') AS total
 FROM incidents ORDER BY risk_score DESC, incident_id LIMIT 200""")
def i13_queue(spark, sf_dir):
    page = W.list_incidents(ranked_incidents(spark, sf_dir), limit=200)
    return ntz(page.select("incident_id", "risk_score", "risk_level", "attack_family", "src_ip", "dst_ip", "flow_count",
                           "first_seen", "last_seen", "total"))


@query("i13_queue_filtered", RANKED_SQL + """, f AS (SELECT * FROM incidents WHERE status = 'new' AND attack_family = 'DoS' AND risk_level = 'MEDIUM' AND first_seen >= TIMESTAMP '2024-01-08 00:00:00')
 SELECT incident_id, risk_score, last_seen, (SELECT count(*) FROM f) AS total FROM f ORDER BY last_seen DESC, incident_id LIMIT 50 OFFSET 10""")
def i13_queue_filtered(spark, sf_dir):
    page = W.list_incidents(ranked_incidents(spark, sf_dir), status="new", family="DoS", level="MEDIUM",
                            since="2024-01-08 00:00:00", sort="last_seen", limit=50, offset=10)
    return ntz(page.select("incident_id", "risk_score", "last_seen", "total"))


@query("i14_detail", RANKED_SQL + f""", top AS (SELECT incident_id FROM incidents ORDER BY risk_score DESC, incident_id LIMIT 1),
 l AS (SELECT flow_id, observed_at, incident_id, user_id, tool, f_k FROM marked JOIN inc USING (src_ip, dst_ip, fam, session) JOIN top USING (incident_id)),
 fl AS (SELECT incident_id, 'flow' AS kind, flow_id AS ref, observed_at AS "at", f_k AS k FROM l ORDER BY observed_at, flow_id LIMIT 20),
 ac AS (SELECT incident_id, 'action' AS kind, CASE tool WHEN 'error' THEN 'escalate' WHEN 'signup' THEN 'confirm' ELSE 'note' END AS ref, observed_at AS "at", NULL AS k FROM l)
 SELECT i.incident_id, risk_score, attack_family, kind, ref, "at", cast(k AS double) AS k FROM incidents i JOIN (SELECT * FROM fl UNION ALL SELECT * FROM ac) x ON x.incident_id = i.incident_id""")
def i14_detail(spark, sf_dir):
    inc = ranked_incidents(spark, sf_dir)
    top = inc.orderBy(F.desc("risk_score"), "incident_id").limit(1).head()["incident_id"]
    linked = I.link_flows(B.scored(spark, sf_dir), GAP)
    acts = linked.where(F.col("incident_id").isNotNull()).select(
        "incident_id", F.when(F.col("tool") == "error", "escalate").when(F.col("tool") == "signup", "confirm").otherwise("note").alias("action"),
        F.col("observed_at").alias("at"))
    out = W.incident_detail(inc, linked, acts, top)
    return ntz(out.select("incident_id", "risk_score", "attack_family", "kind", "ref", "at", F.try_element_at("features", F.lit("k")).alias("k")))


OK_SQL = f"""WITH {B.ACTIONS_SQL}, c AS (SELECT incident_id, min(("at", action_id)) AS c FROM actions WHERE action IN ('dismiss_fp', 'resolve') GROUP BY 1),
 ok AS (SELECT a.* FROM actions a LEFT JOIN c USING (incident_id) WHERE c.c IS NULL OR (a."at", a.action_id) <= c.c)"""
FOLD_SQL = OK_SQL + """,
 mv AS (SELECT * FROM ok WHERE action IN ('acknowledge', 'escalate', 'dismiss_fp', 'resolve')),
 st AS (SELECT incident_id, last(action ORDER BY "at", action_id) AS la, first(action ORDER BY "at", action_id) AS fa, first("at" ORDER BY "at", action_id) AS ft FROM mv GROUP BY 1),
 folded AS (SELECT k.incident_id, k.actions, CASE la WHEN 'acknowledge' THEN 'acknowledged' WHEN 'escalate' THEN 'escalated' WHEN 'dismiss_fp' THEN 'dismissed_fp' WHEN 'resolve' THEN 'resolved' ELSE 'new' END AS status,
 CASE WHEN fa = 'acknowledge' THEN ft END AS acknowledged_at FROM (SELECT incident_id, count(*) AS actions FROM ok GROUP BY 1) k LEFT JOIN st USING (incident_id))"""


@query("i15_fold", FOLD_SQL + " SELECT incident_id, actions, status, acknowledged_at FROM folded")
def i15_fold(spark, sf_dir):
    return ntz(W.fold_actions(B.actions(spark, sf_dir)).select("incident_id", "actions", "status", "acknowledged_at"))


LIVE_SQL = FOLD_SQL + f""", i AS (SELECT f.*, CASE WHEN actions >= 75 THEN 'HIGH' WHEN actions >= 60 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level, fs.first_seen FROM folded f JOIN (SELECT incident_id, min("at") AS first_seen FROM actions GROUP BY 1) fs USING (incident_id)),
 d AS (SELECT (epoch_us(acknowledged_at) - epoch_us(first_seen)) / 1e6 AS s FROM i WHERE acknowledged_at IS NOT NULL)
 SELECT (SELECT count(*) FROM events) AS flows_scored_total, round((SELECT count(*) FROM events, (SELECT max(ts) AS now FROM events) WHERE ts >= now - INTERVAL 60 SECONDS) / 60e0, 6) AS flows_per_sec_1m,
 round((SELECT quantile_cont(value, 0.5) FROM events), 6) AS latency_ms_p50, round((SELECT quantile_cont(value, 0.95) FROM events), 6) AS latency_ms_p95,
 count(*) FILTER (status NOT IN ('resolved', 'dismissed_fp')) AS incidents_open, {", ".join(f"count(*) FILTER (status NOT IN ('resolved', 'dismissed_fp') AND risk_level = '{lv}') AS open_{lv.lower()}" for lv in K.LEVELS)},
 (SELECT round(avg(s), 6) FROM d WHERE s >= 0) AS mtta_seconds, (SELECT round(count(*) FILTER (action = 'confirm') / cast(count(*) AS double), 6) FROM ok WHERE action IN ('confirm', 'dismiss_fp')) AS analyst_confirmed_precision,
 (SELECT round(count(*) FILTER (action = 'dismiss_fp') / cast(count(*) AS double), 6) FROM ok WHERE action IN ('confirm', 'dismiss_fp')) AS fp_dismiss_rate FROM i"""


def queue_state(spark, sf_dir):
    acts = B.actions(spark, sf_dir)
    seen = acts.groupBy("incident_id").agg(F.min("at").alias("first_seen"))
    level = F.when(F.col("actions") >= 75, "HIGH").when(F.col("actions") >= 60, "MEDIUM").otherwise("LOW")
    return W.fold_actions(acts).join(seen, "incident_id").withColumn("risk_level", level)


@query("i16_live", LIVE_SQL)
def i16_live(spark, sf_dir):
    e = B.table(spark, sf_dir, "events").select(F.col("ts").alias("received_at"), F.col("value").alias("latency_ms"))
    now = e.agg(F.max("received_at").alias("m")).head()["m"]
    out = W.live_metrics(e, queue_state(spark, sf_dir), B.actions(spark, sf_dir), F.lit(now))
    return r6(out)


@query("i17_analyst", OK_SQL + f" SELECT analyst, {', '.join(f'''count(*) FILTER (action = '{a}') AS {a}''' for a in K.ACTIONS)}, count(*) AS total FROM ok GROUP BY 1")
def i17_analyst(spark, sf_dir):
    return W.analyst_matrix(B.actions(spark, sf_dir))


@query("i17_action_counts", OK_SQL + " SELECT action, count(*) AS n FROM ok GROUP BY 1")
def i17_action_counts(spark, sf_dir):
    return W.action_counts(B.actions(spark, sf_dir))


@query("i18_open_novel", RANKED_SQL + " SELECT count(*) FILTER (verdict = 'novel_anomaly') AS open_novel FROM incidents")
def i18_open_novel(spark, sf_dir):
    return W.open_novel_count(ranked_incidents(spark, sf_dir))


@query("i19_new_rows", "SELECT DISTINCT user_id FROM events WHERE event_type IN ('view', 'click') AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 90)")
def i19_new_rows(spark, sf_dir):
    e = B.table(spark, sf_dir, "events")
    before = e.where((F.col("event_type") == "purchase") & (F.col("value") > 90))
    return W.new_since(before, e.where(F.col("event_type").isin("view", "click")), "user_id")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _num(x: str, d: int) -> str:
    return f"format('{{:,.{d}f}}', {x})"


def _feature_sql(name: str, v: str, m: str) -> str:
    r = f"({v} / {m})"
    return f"""CASE WHEN {m} > 0 THEN CASE WHEN {r} >= 3 THEN '{name} is ~' || {_num(f'round_even({r}, 0)', 0)} || 'x higher than typical' WHEN {r} <= 0.33e0 AND {v} > 0 THEN '{name} is ~' || {_num(f'round_even(1 / {r}, 0)', 0)} || 'x lower than typical'
 WHEN {v} = 0 THEN '{name} is zero (typical baseline ' || {_num(m, 1)} || ')' ELSE '{name} is ' || {_num(v, 1)} || ' vs baseline ' || {_num(m, 1)} END
 WHEN {m} = 0 AND {v} > 0 THEN '{name} is elevated (' || {_num(v, 1)} || ' vs normal 0)' ELSE '{name} is ' || {_num(v, 1)} END"""


BAND3 = "CASE band WHEN 'high' THEN {0} WHEN 'medium' THEN {1} ELSE {2} END"
PLAY_SQL = "CASE fam " + " ".join(f"WHEN '{k}' THEN {_quoted(v)}" for k, v in K.PLAYBOOK.items()) + f" ELSE {_quoted(K.DEFAULT_PLAYBOOK)} END"
BRIEF_SQL = f"""WITH {B.SCORED_SQL}, base AS (SELECT event_id, CASE WHEN tool = 'purchase' AND verdict = 'known_attack' THEN 'Malicious' ELSE attack_family END AS fam, verdict, confidence, user_id + 1 + 990 * (event_id % 2) AS n, src_ip, dst_ip, dst_port,
 CASE WHEN confidence >= 0.85e0 THEN 'high' WHEN confidence >= 0.6e0 THEN 'medium' ELSE 'low' END AS band, f_value, f_k, tool FROM scored WHERE verdict <> 'benign'),
 mit AS (SELECT *, CASE fam {" ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in K.MITRE.items())} END AS mitre_id, {PLAY_SQL} AS play, CASE WHEN tool = 'error' THEN 'telemetry exhibited statistical deviation from normal traffic baselines'
 ELSE ': ' || {_feature_sql('flow value', 'f_value', '20e0')} || ' and ' || {_feature_sql('k', 'f_k', "(CASE WHEN tool = 'signup' THEN 0e0 ELSE 40e0 END)")} END AS feats FROM base),
 briefs AS (SELECT *, CASE WHEN verdict = 'novel_anomaly' OR fam = 'Unknown' THEN {BAND3.format("'High-confidence anomalous activity observed'", "'Probable novel activity'", "'Possible novel activity'")}
 WHEN fam = 'Malicious' THEN {BAND3.format("'Confirmed malicious network activity'", "'Likely malicious network activity'", "'Possible malicious network activity'")}
 ELSE {BAND3.format("'Active '", "'Likely '", "'Possible '")} || fam || coalesce(' (MITRE ' || mitre_id || ')', '') || {BAND3.format("' activity detected'", "' activity observed'", "' activity detected'")} END
 || ' from ' || src_ip || ' to ' || dst_ip || ':' || dst_port || ' across ' || format('{{:,}}', n) || CASE WHEN n = 1 THEN ' flow. ' ELSE ' flows. ' END
 || CASE WHEN verdict = 'novel_anomaly' OR fam = 'Unknown' THEN 'No known attack family matched, but the traffic sits far outside normal behaviour' WHEN fam = 'Malicious' THEN 'The traffic was flagged as malicious per threat intelligence with unclassified exploit structure'
 ELSE 'The traffic matches ' || fam || ' behavioral patterns' END || feats || '. '
 || CASE WHEN verdict = 'novel_anomaly' OR fam = 'Unknown' THEN CASE WHEN band = 'low' THEN 'Worth reviewing: check what ' || src_ip || ' is doing on port ' || dst_port || ' before escalating.' ELSE 'Recommended action: ' || play END
 ELSE {BAND3.format("'Immediate action required: '", "'Recommended action: '", "'Worth reviewing before escalating: '")} || play END AS brief FROM mit)"""


def brief_rows(spark, sf_dir):
    f = B.scored(spark, sf_dir).where(F.col("verdict") != "benign")
    tool = F.col("tool")
    fam = F.when((tool == "purchase") & (F.col("verdict") == "known_attack"), "Malicious").otherwise(F.col("attack_family"))
    feats = F.array(
        F.struct(F.lit("flow_value").alias("feature"), F.col("f_value").alias("value"), F.lit(20.0).alias("baseline_median")),
        F.struct(F.lit("k").alias("feature"), F.col("f_k").alias("value"), F.when(tool == "signup", 0.0).otherwise(40.0).alias("baseline_median")),
        F.struct(F.lit("third").alias("feature"), F.lit(1.0).alias("value"), F.lit(1.0).alias("baseline_median")))
    df = f.select(
        "event_id", "verdict", fam.alias("attack_family"), F.col("confidence").alias("max_confidence"),
        (F.col("user_id") + 1 + 990 * (F.col("event_id") % 2)).alias("flow_count"), "src_ip", "dst_ip", "dst_port",
        F.when(tool != "error", feats).alias("top_features"))
    return BR.render_brief(I.mitre_join(df))


@query("i20_brief", BRIEF_SQL + " SELECT event_id, brief FROM briefs")
def i20_brief(spark, sf_dir):
    return brief_rows(spark, sf_dir).select("event_id", "brief")


@query("i21_bands", """WITH g AS (SELECT user_id, CASE WHEN user_id % 10 = 0 THEN NULL ELSE avg(CASE WHEN event_type <> 'error' THEN 1e0 ELSE 0e0 END) END AS precision, CASE WHEN user_id % 9 = 0 THEN NULL ELSE round(min(value) * 80 * (1 + user_id % 7), 1) END AS m FROM events GROUP BY 1)
 SELECT user_id, CASE WHEN precision IS NULL THEN 'none' WHEN precision >= 0.85e0 THEN 'ok' WHEN precision >= 0.7e0 THEN 'medium' ELSE 'high' END AS precision_band,
 CASE WHEN precision IS NULL THEN 'Precision data unavailable — no analyst reviews recorded yet.' WHEN precision >= 0.85e0 THEN 'Model precision is healthy — analyst-confirmed classifications are accurate.' ELSE 'Precision is below 85% — review SHAP feature attribution and refine thresholds.' END AS precision_text,
 CASE WHEN m IS NULL THEN 'MTTA data unavailable.' WHEN m < 120 THEN 'Excellent response time (< 2 min).' WHEN m < 300 THEN 'Acceptable response time (2–5 min).' ELSE 'MTTA exceeds 5 minutes — consider staffing review.' END AS mtta_text,
 CASE WHEN m IS NULL THEN '—' WHEN m < 60 THEN printf('%.0f s', m) WHEN m < 3600 THEN printf('%.1f min', m / 60) ELSE printf('%.2f hr', m / 3600) END AS mtta_label FROM g""")
def i21_bands(spark, sf_dir):
    u = F.col("user_id")
    g = B.table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.avg((F.col("event_type") != "error").cast("double")).alias("p"), F.min("value").alias("v"))
    g = g.select("user_id", F.when(u % 10 != 0, F.col("p")).alias("precision"),
                 F.when(u % 9 != 0, F.round(F.col("v") * 80 * (1 + u % 7), 1)).alias("mtta_seconds"))
    return W.metric_bands(g).select("user_id", "precision_band", "precision_text", "mtta_text", "mtta_label")


BROKEN_SQL = """x AS (SELECT event_id, verdict, fam, band, src_ip, dst_port, n, play, CASE WHEN tool = 'signup' THEN replace(brief, src_ip, 'somewhere') || ' Kerberos ticket seen.'
 WHEN tool = 'error' THEN replace(brief, 'Worth reviewing', 'Immediate action required') ELSE brief END AS t, brief FROM briefs)"""


@query("a19_brief_check", BRIEF_SQL + f""", {BROKEN_SQL}, y AS (SELECT *, lower(t) AS lo, verdict = 'novel_anomaly' OR fam = 'Unknown' AS nv FROM x)
 SELECT event_id, concat_ws(',', CASE WHEN {" OR ".join(f"contains(lo, '{w}')" for w in K.FORBIDDEN_TERMS)} THEN 'forbidden_term' END, CASE WHEN NOT contains(lo, src_ip) THEN 'src_ip' END,
 CASE WHEN NOT contains(lo, cast(dst_port AS varchar)) THEN 'dst_port' END, CASE WHEN NOT contains(t, format('{{:,}}', n)) AND NOT contains(t, cast(n AS varchar)) THEN 'flow_count' END,
 CASE WHEN band = 'high' AND (contains(lo, 'possible') OR contains(lo, 'worth reviewing before escalating')) THEN 'band_high' END,
 CASE WHEN band = 'low' AND (contains(lo, 'active ') OR contains(lo, 'immediate action required') OR NOT (contains(lo, 'possible') OR contains(lo, 'worth reviewing'))) THEN 'band_low' END,
 CASE WHEN band = 'medium' AND (contains(lo, 'active ') OR contains(lo, 'immediate action required')) THEN 'band_medium' END,
 CASE WHEN nv AND (NOT contains(lo, 'no known attack family matched') OR {" OR ".join(f"contains(lo, 'active {w}') OR contains(lo, 'likely {w}')" for w in K.NAMED_FAMILIES_LOWER)}) THEN 'novel_rule' END,
 CASE WHEN NOT nv AND fam = 'Malicious' AND (NOT (contains(lo, 'threat intelligence') OR contains(lo, 'malicious')) OR {" OR ".join(f"contains(lo, '{w}')" for w in K.NAMED_FAMILIES_LOWER)}) THEN 'malicious_rule' END,
 CASE WHEN NOT (contains(lo, lower(play)) OR contains(lo, 'check what')) THEN 'playbook' END, CASE WHEN t <> brief THEN 'not_reproducible' END) AS failures FROM y""")
def a19_brief_check(spark, sf_dir):
    rows = brief_rows(spark, sf_dir).join(B.flows(spark, sf_dir).select("event_id", "tool"), "event_id")
    text = (
        F.when(F.col("tool") == "signup", F.concat(F.replace("brief", F.col("src_ip"), F.lit("somewhere")), F.lit(" Kerberos ticket seen.")))
        .when(F.col("tool") == "error", F.replace("brief", F.lit("Worth reviewing"), F.lit("Immediate action required")))
        .otherwise(F.col("brief")))
    checked = BR.validate_briefs(rows.withColumn("brief", text))
    return checked.select("event_id", F.array_join("failures", ",").alias("failures"))


@query("a19_forbidden_in_documents", f"""SELECT doc_id, concat_ws(',', {", ".join(f"CASE WHEN contains(lower(text), '{w}') THEN '{w}' END" for w in K.FORBIDDEN_TERMS)}) AS found FROM documents""")
def a19_forbidden_in_documents(spark, sf_dir):
    d = B.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.array_join(BR.forbidden_terms(F.col("text")), ",").alias("found"))


@query("e11_shift_text", """WITH x AS (SELECT event_id, value, CASE WHEN user_id % 4 = 0 THEN NULL WHEN user_id % 4 = 1 THEN 0e0 ELSE 20e0 END AS m FROM events)
 SELECT event_id, CASE WHEN m IS NULL THEN 'No baseline' WHEN m = 0 AND value = 0 THEN 'Matches normal (0.0)' WHEN m = 0 THEN '+' || printf('%g', value) || ' above baseline (0.0)' WHEN value = m THEN 'Matches normal'
 WHEN value / m >= 2 THEN format('{:,.1f}', value / m) || '× higher than normal' WHEN value > 0 AND value / m <= 0.5 THEN format('{:,.1f}', m / value) || '× lower than normal'
 ELSE CASE WHEN (value - m) / m * 100 > 0 THEN '+' ELSE '' END || printf('%.1f', (value - m) / m * 100) || '% vs normal' END AS shift FROM x""")
def e11_shift_text(spark, sf_dir):
    from flowlens.operators.features import format_shift

    u = F.col("user_id") % 4
    m = F.when(u == 1, 0.0).when(u > 1, 20.0)
    return B.table(spark, sf_dir, "events").select("event_id", format_shift(F.col("value"), m).alias("shift"))

"""Queries over cleaning operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens import constants as K
from flowlens.catalog.registry import ntz, query, r6
from flowlens.functions.exprs import snake_expr
from flowlens.operators import clean as C
from flowlens.plans import bindings as B


def _cases(column: str, mapping: dict) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    return f"CASE {column} " + " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in mapping.items()) + " END"


@query("c1_snake", """SELECT event_id, regexp_replace(regexp_replace(lower(replace(trim(' ' || event_type || ' Pkts/s (' || props || ')'), '/', ' per ')),
 '[^0-9a-z]+', '_', 'g'), '^_+|_+$', '', 'g') AS name FROM events""")
def c1_snake(spark, sf_dir):
    raw = F.concat(F.lit(" "), F.col("event_type"), F.lit(" Pkts/s ("), F.col("props"), F.lit(")"))
    df = B.table(spark, sf_dir, "events").select(F.col("event_id").alias("Event ID"), raw.alias("Raw/Name"))
    return C.snake_columns(df).select("event_id", snake_expr(F.col("raw_per_name")).alias("name"))


LABEL_SQL = """CASE WHEN event_type = 'view' THEN 'BENIGN' WHEN event_type = 'click' THEN 'DoS Hulk'
 WHEN event_type = 'signup' THEN 'SSH-BruteForce - Attempted' WHEN event_type = 'error' THEN 'Web Attack - XSS' ELSE 'Mystery - Attempted' END"""


@query("c2_map_family", f"""WITH x AS (SELECT event_id, {LABEL_SQL} AS label, user_id % 5 = 0 OR event_type = 'signup' AS attempted FROM events)
 SELECT event_id, label, CASE WHEN attempted THEN 'BENIGN' ELSE {_cases("regexp_replace(label, ' - Attempted$', '')", K.LABEL_FAMILY)} END AS family,
 {_cases("regexp_replace(label, ' - Attempted$', '')", K.LABEL_FAMILY)} IS NULL AS unmapped FROM x""")
def c2_map_family(spark, sf_dir):
    kind = F.col("event_type")
    df = B.table(spark, sf_dir, "events").select(
        "event_id",
        F.when(kind == "view", "BENIGN").when(kind == "click", "DoS Hulk").when(kind == "signup", "SSH-BruteForce - Attempted")
        .when(kind == "error", "Web Attack - XSS").otherwise("Mystery - Attempted").alias("label"),
        ((F.col("user_id") % 5 == 0) | (kind == "signup")).alias("attempted"))
    gone = C.unmapped_labels(df).select(F.concat(F.col("label"), F.lit(K.ATTEMPTED_SUFFIX)).alias("label"), F.lit(True).alias("unmapped"))
    return C.map_family(df, attempted="attempted").join(gone, "label", "left").select(
        "event_id", "label", "family", F.coalesce("unmapped", F.lit(False)).alias("unmapped"))


@query("c3_nonfinite", """SELECT event_id, CASE WHEN event_type IN ('view', 'click', 'signup') THEN NULL ELSE value END AS x FROM events""")
def c3_nonfinite(spark, sf_dir):
    kind = F.col("event_type")
    x = (F.when(kind == "view", F.lit(float("inf"))).when(kind == "click", F.lit(float("-inf")))
         .when(kind == "signup", F.lit(float("nan"))).otherwise(F.col("value")))
    return C.nonfinite_to_null(B.table(spark, sf_dir, "events").select("event_id", x.alias("x")), ["x"])


GLUED_SQL = "cast(cast(epoch_us(ts) // 1000000 AS varchar) || cast(epoch_us(ts) % 1000000 AS varchar) AS bigint)"


def _glued():
    us = F.unix_micros("ts")
    return F.concat(F.floor(us / 1_000_000).cast("string"), (us % 1_000_000).cast("string")).cast("bigint")


@query("c4_repair_ts", f"SELECT event_id, epoch_us(ts) AS ts_us, {GLUED_SQL} <> epoch_us(ts) AS repaired FROM events")
def c4_repair_ts(spark, sf_dir):
    df = B.table(spark, sf_dir, "events").select("event_id", _glued().alias("raw"))
    return C.repair_timestamps(df, "raw").select("event_id", "ts_us", "repaired")


@query("c5_far_ts", """WITH x AS (SELECT event_id, ts, cast(ts AS date) + cast(user_id % 7 - 3 AS integer) AS file_date FROM events)
 SELECT event_id, epoch_us(ts) AS ts_us, cast(file_date AS date) AS file_date FROM x WHERE abs(epoch_us(ts) - epoch_us(cast(file_date AS timestamp))) <= 172800000000""")
def c5_far_ts(spark, sf_dir):
    df = B.table(spark, sf_dir, "events").select(
        "event_id", F.unix_micros("ts").alias("ts_us"),
        F.date_add(F.to_date("ts"), (F.col("user_id") % 7 - 3).cast("int")).alias("file_date"))
    return C.drop_far_timestamps(df, "ts_us", "file_date")


@query("c5_report", f"""WITH x AS (SELECT ts, {GLUED_SQL} AS raw, cast(ts AS date) + cast(user_id % 7 - 3 AS integer) AS file_date FROM events)
 SELECT count(*) AS rows, count(*) FILTER (raw <> epoch_us(ts)) AS repaired, count(*) FILTER (abs(epoch_us(ts) - epoch_us(cast(file_date AS timestamp))) > 172800000000) AS dropped FROM x""")
def c5_report(spark, sf_dir):
    df = B.table(spark, sf_dir, "events").select(
        _glued().alias("raw"), F.date_add(F.to_date("ts"), (F.col("user_id") % 7 - 3).cast("int")).alias("file_date"))
    return C.timestamp_report(df, "raw", "file_date")


@query("c6_ports", """SELECT event_id, cast(coalesce(CASE WHEN user_id % 3 = 0 THEN NULL ELSE user_id END, -1) AS integer) AS ingest,
 cast(greatest(coalesce(CASE WHEN user_id % 3 = 0 THEN NULL ELSE user_id END, -1), 0) AS integer) AS export FROM events""")
def c6_ports(spark, sf_dir):
    port = F.when(F.col("user_id") % 3 != 0, F.col("user_id"))
    df = C.fill_ports(B.table(spark, sf_dir, "events").select("event_id", port.alias("ingest")), ["ingest"])
    return C.clamp_ports(df.withColumn("export", F.col("ingest")), ["export"])


@query("c7_period", "SELECT event_id, strftime(ts, '%Y-%m') AS period FROM events")
def c7_period(spark, sf_dir):
    return C.derive_period(B.table(spark, sf_dir, "events"), "ts").select("event_id", "period")


@query("c8_identity", f"""WITH {B.FLOWS_SQL} SELECT cast(day AS varchar) || '-' || cast(event_id AS varchar) AS flow_id,
 strftime(observed_at, '%Y-%m-%dT%H:%M:%S.%fZ') AS observed_at,
 round((epoch_us(observed_at) - min(epoch_us(observed_at)) OVER (PARTITION BY tool)) / 1e6, 6) AS t_rel_s FROM flows""")
def c8_identity(spark, sf_dir):
    f = B.flows(spark, sf_dir).select("day", "event_id", F.col("observed_at").alias("ts"), "tool")
    return C.flow_identity(f, "day", "event_id", "ts", ["tool"]).select("flow_id", "observed_at", "t_rel_s")


TEXT_SQL = """CASE event_id % 9 WHEN 0 THEN ' SSH-BruteForce ' WHEN 1 THEN 'nmap' WHEN 2 THEN 'DDoS-HOIC' WHEN 3 THEN 'Web_Attack' WHEN 4 THEN 'strange thing'
 WHEN 5 THEN NULL WHEN 6 THEN 'Botnet' WHEN 7 THEN 'Malware' ELSE 'Infiltration' END"""
RAW_VERDICT_SQL = "CASE event_type WHEN 'view' THEN 'Anomaly' WHEN 'click' THEN 'benign' WHEN 'signup' THEN NULL WHEN 'error' THEN 'attack' ELSE 'odd' END"
FAMILY_SQL = f"""CASE WHEN fam IS NULL THEN CASE WHEN lower(coalesce(rv, '')) IN ('anomaly', 'novel_anomaly') THEN 'Unknown' WHEN lower(coalesce(rv, '')) = 'benign' THEN 'BENIGN' ELSE 'Malicious' END
 ELSE coalesce({_cases('lower(trim(fam))', K.FAMILY_ALIASES)}, CASE WHEN lower(coalesce(rv, '')) IN ('anomaly', 'novel_anomaly') THEN 'Unknown' ELSE 'Malicious' END) END"""
VERDICT_SQL = f"""CASE WHEN rv IS NULL THEN CASE family WHEN 'Unknown' THEN 'novel_anomaly' WHEN 'BENIGN' THEN 'benign' ELSE 'known_attack' END
 ELSE coalesce({_cases('lower(trim(rv))', K.VERDICT_ALIASES)}, CASE family WHEN 'Unknown' THEN 'novel_anomaly' ELSE 'known_attack' END) END"""


def _loose_text():
    m = F.col("event_id") % 9
    fam = (F.when(m == 0, " SSH-BruteForce ").when(m == 1, "nmap").when(m == 2, "DDoS-HOIC").when(m == 3, "Web_Attack")
           .when(m == 4, "strange thing").when(m == 6, "Botnet").when(m == 7, "Malware").when(m == 8, "Infiltration"))
    k = F.col("event_type")
    rv = F.when(k == "view", "Anomaly").when(k == "click", "benign").when(k == "error", "attack").when(k == "purchase", "odd")
    return fam, rv


@query("c9_alias", f"""WITH x AS (SELECT event_id, {TEXT_SQL} AS fam, {RAW_VERDICT_SQL} AS rv FROM events),
 y AS (SELECT *, {FAMILY_SQL} AS family FROM x) SELECT event_id, family, {VERDICT_SQL} AS verdict FROM y""")
def c9_alias(spark, sf_dir):
    fam, rv = _loose_text()
    df = B.table(spark, sf_dir, "events").select("event_id", fam.alias("f"), rv.alias("v"))
    df = df.withColumn("family", C.normalise_family(F.col("f"), F.col("v")))
    return df.select("event_id", "family", C.normalise_verdict(F.col("v"), F.col("family")).alias("verdict"))


@query("c10_normalise", f"""WITH x AS (SELECT event_id, {TEXT_SQL} AS fam, {RAW_VERDICT_SQL} AS rv, value, ts, user_id, event_type FROM events),
 y AS (SELECT *, {FAMILY_SQL} AS family FROM x), z AS (SELECT *, {VERDICT_SQL} AS verdict,
 CASE WHEN event_type = 'error' THEN 0.85e0 ELSE greatest(0e0, least(1e0, value / 60e0 - 0.05e0)) END AS max_confidence,
 CASE WHEN event_type = 'click' THEN {"CASE family " + " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in K.SEVERITY.items()) + " END"} ELSE least(1e0, value / 80e0) END AS severity,
 CASE WHEN event_type = 'view' THEN 1 ELSE greatest(1, cast(user_id % 50 - 3 AS integer)) END AS flow_count FROM y),
 s AS (SELECT *, CASE WHEN event_type = 'purchase' THEN least(100, greatest(0, cast(floor(value) AS integer) - 5)) WHEN verdict = 'benign' THEN 0
 ELSE cast(round_even(100e0 * least(1e0, greatest(0e0, max_confidence * severity * (1e0 + 0.15e0 * least(1e0, log10(cast(flow_count AS double)) / 3)) + CASE verdict WHEN 'novel_anomaly' THEN 0.1e0 ELSE 0e0 END)), 0) AS integer) END AS risk_score FROM z)
 SELECT cast(event_id AS varchar) AS incident_id, family AS attack_family, verdict, CASE WHEN event_type = 'click' THEN 'new' ELSE 'resolved' END AS status,
 CASE family {" ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in K.MITRE.items())} END AS mitre_id,
 round(max_confidence, 6) AS max_confidence, round(severity, 6) AS severity, flow_count, risk_score,
 CASE WHEN event_type = 'view' THEN 'HIGH' WHEN risk_score >= 70 THEN 'HIGH' WHEN risk_score >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
 '0.0.0.0' AS src_ip, ts AS first_seen, 1 AS n_features, 'syn' AS top_feature, 'hello' AS brief_text FROM s""")
def c10_normalise(spark, sf_dir):
    fam, rv = _loose_text()
    k, v, none = F.col("event_type"), F.col("value"), F.lit(None).cast("string")
    df = B.table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("incident_id"), fam.alias("attack_family"), rv.alias("verdict"),
        F.when(k == "click", "strange").otherwise("resolved").alias("status"),
        none.alias("mitre_id"), none.alias("mitre_name"),
        F.when(k == "error", "n/a").otherwise((v / 60.0 - 0.05).cast("string")).alias("max_confidence"),
        F.when(k != "click", (v / 80.0).cast("string")).alias("severity"),
        F.when(k == "view", "many").otherwise((F.col("user_id") % 50 - 3).cast("string")).alias("flow_count"),
        F.when(k == "purchase", (F.floor(v) - 5).cast("string")).alias("risk_score"),
        F.when(k == "view", "HIGH").otherwise("?").alias("risk_level"),
        none.alias("src_ip"), none.alias("dst_ip"), none.alias("dst_port"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("first_seen"), none.alias("last_seen"),
        F.concat(F.lit('[{"feature":"syn","value":'), v.cast("string"), F.lit(',"shap_value":0.5}]')).alias("top_features_json"),
        F.lit('{"text":"hello","source":"template"}').alias("brief_json"))
    out = C.normalise_incident_rows(df)
    return ntz(r6(out.select(
        "incident_id", "attack_family", "verdict", "status", "mitre_id", "max_confidence", "severity", "flow_count",
        "risk_score", "risk_level", "src_ip", "first_seen", F.size("top_features").alias("n_features"),
        F.col("top_features")[0]["feature"].alias("top_feature"), F.col("brief.text").alias("brief_text"))))


@query("c11_json_features", """SELECT event_id, cast(json_extract_string(props, '$.k') AS double) AS k, cast(NULL AS double) AS absent FROM events""")
def c11_json_features(spark, sf_dir):
    df = B.table(spark, sf_dir, "events").select("event_id", "props")
    return C.parse_features(df, "props", ["k", "absent"]).select("event_id", "k", "absent")

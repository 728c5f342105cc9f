"""Queries over thresholds, verdicts and explanation picks."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens import constants as K
from flowlens.catalog.registry import query, r6
from flowlens.operators import decide as D
from flowlens.plans import bindings as B

TAUS = (B.TAU_BINARY, B.TAU_ANOMALY)


@query("m5_percentile", f"""WITH {B.FLOWS_SQL}, r AS (SELECT f_value AS s FROM flows WHERE family = 'BENIGN'), v AS (SELECT s, count(*) AS c FROM r GROUP BY 1),
 u AS (SELECT x, sum(coalesce(c, 0)) OVER (ORDER BY x) AS upto FROM (SELECT DISTINCT f_value AS x FROM flows) LEFT JOIN v ON v.s = x)
 SELECT event_id, round(100e0 * upto / (SELECT count(*) FROM r), 6) AS percentile FROM flows JOIN u ON f_value = x""")
def m5_percentile(spark, sf_dir):
    f = B.flows(spark, sf_dir)
    out = D.anomaly_percentile(f.select("event_id", "f_value"), f.where(F.col("family") == "BENIGN"), "f_value", "f_value")
    return r6(out.select("event_id", "percentile"))


@query("m6_fuse", f"WITH {B.SCORED_SQL} SELECT event_id, verdict FROM scored")
def m6_fuse(spark, sf_dir):
    return D.fuse(B.flows(spark, sf_dir), *TAUS, B.TAU_FAMILY).select("event_id", "verdict")


@query("m7_confidence", f"WITH {B.SCORED_SQL} SELECT event_id, round(confidence, 6) AS confidence FROM scored")
def m7_confidence(spark, sf_dir):
    f = D.fuse(B.flows(spark, sf_dir), *TAUS, B.TAU_FAMILY)
    return r6(D.detection_confidence(f, *TAUS).select("event_id", "confidence"))


@query("m8_family", f"WITH {B.SCORED_SQL} SELECT event_id, attack_family FROM scored")
def m8_family(spark, sf_dir):
    f = D.fuse(B.flows(spark, sf_dir), *TAUS, B.TAU_FAMILY)
    f = f.withColumn("closest_family", F.when(F.col("family") != "BENIGN", F.col("family")))
    return D.assign_family(f).select("event_id", "attack_family")


BUDGETS = [0.0, *K.CURVE_BUDGETS]


@query("m9_threshold", f"""WITH {B.FLOWS_SQL}, r AS (SELECT p_attack, row_number() OVER (ORDER BY p_attack) - 1 AS k, count(*) OVER () AS n FROM flows WHERE family = 'BENIGN'),
 b AS (SELECT unnest([{", ".join(f"{b!r}::double" for b in BUDGETS)}]) AS budget)
 SELECT budget, n, p_attack AS score, (SELECT count(*) FROM r r2 WHERE r2.p_attack > r.p_attack) AS flagged FROM r JOIN b ON k = n - 1 - cast(floor(budget * n) AS bigint)""")
def m9_threshold(spark, sf_dir):
    benign = B.flows(spark, sf_dir).where(F.col("family") == "BENIGN")
    s = D.budget_scores(benign, "p_attack", BUDGETS)
    hits = D.with_budgets(benign.select("p_attack"), [{"b": r["budget"], "s": r["score"]} for r in s.collect()])
    count = hits.groupBy(F.col("b").alias("budget")).agg(F.count_if(F.col("p_attack") > F.col("s")).alias("flagged"))
    return s.join(count, "budget")


def curve_rows(spark, sf_dir):
    return B.flows(spark, sf_dir).select(
        "event_id", F.col("p_attack").alias("p"), "fconf", "family", "tool", "w",
        F.round(F.col("p_attack") * F.col("fconf"), 6).alias("p_full"))


def points_sql(budgets, familiar="family <> 'BENIGN'") -> str:
    """CTE ``taus``: budget, tau_binary, tau_family over ``flows``."""
    return f"""benign AS (SELECT p_attack, row_number() OVER (ORDER BY p_attack) - 1 AS k, count(*) OVER () AS n FROM flows WHERE family = 'BENIGN'),
 b AS (SELECT unnest([{", ".join(f"{b!r}::double" for b in budgets)}]) AS budget),
 tb AS (SELECT budget, p_attack AS tau_binary FROM benign JOIN b ON k = n - 1 - cast(floor(budget * n) AS bigint)),
 taus AS (SELECT budget, tau_binary, coalesce((SELECT quantile_cont(fconf, 0.02) FROM flows WHERE {familiar} AND p_attack > tau_binary), 0e0) AS tau_family FROM tb)"""


@query("m10_op_point", f"WITH {B.FLOWS_SQL}, {points_sql(K.CURVE_BUDGETS)} SELECT budget, tau_binary, round(tau_family, 6) AS tau_family FROM taus")
def m10_op_point(spark, sf_dir):
    taus = D.operating_points(curve_rows(spark, sf_dir), K.CURVE_BUDGETS)
    rows = [(t["budget"], t["tau_binary"], t["tau_family"]) for t in taus]
    return r6(spark.createDataFrame(rows, "budget double, tau_binary double, tau_family double"), "tau_family")


@query("m11_curve", f"""WITH {B.FLOWS_SQL}, {points_sql(K.CURVE_BUDGETS)}, x AS (SELECT *, p_attack > tau_binary AS f, p_attack > tau_binary AND fconf < tau_family AS nv, family <> 'BENIGN' AS y FROM flows, taus)
 SELECT budget, tau_binary, round(tau_family, 6) AS tau_family, round(coalesce(sum(w) FILTER (f AND NOT y), 0) / sum(w) FILTER (NOT y), 6) AS benign_fpr, round(coalesce(sum(w) FILTER (f AND y), 0) / sum(w) FILTER (y), 6) AS recall,
 coalesce(round(sum(w) FILTER (f AND y) / sum(w) FILTER (f), 6), 0e0) AS precision_natural, coalesce(round(count(*) FILTER (nv) / cast(nullif(count(*) FILTER (f), 0) AS double), 6), 0e0) AS novel_flagged_share,
 {", ".join(f"round(count(*) FILTER (f AND family = '{f}') / cast(count(*) FILTER (family = '{f}') AS double), 6) AS recall_{f.lower()}" for f in ["DoS", "BruteForce", "Botnet"])}
 FROM x GROUP BY budget, tau_binary, tau_family""")
def m11_curve(spark, sf_dir):
    rows = curve_rows(spark, sf_dir)
    out = D.operating_curve(rows, rows, families=["DoS", "BruteForce", "Botnet"])
    return r6(out, *[c for c in out.columns if c not in ("budget", "tau_binary")])


@query("m13_weights", """WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), t AS (SELECT sum(n) AS total, count(*) AS k FROM c)
 SELECT vec_id, label, round(total / cast(k * n AS double), 6) AS class_weight FROM embeddings JOIN c USING (label), t""")
def m13_weights(spark, sf_dir):
    return r6(D.class_weights(B.table(spark, sf_dir, "embeddings").select("vec_id", "label"), "label"))


def select_sql(cap: int, ceiling: int, gap_s: int, batch: str) -> str:
    by = f"{batch}, src_ip, dst_ip, fam"
    return f"""WITH {B.SCORED_SQL}, a AS (SELECT *, CASE WHEN verdict = 'novel_anomaly' THEN 'Unknown' ELSE attack_family END AS fam FROM scored WHERE verdict <> 'benign'),
 g AS (SELECT *, CASE WHEN epoch_us(observed_at) - lag(epoch_us(observed_at)) OVER w > cast({gap_s} AS bigint) * 1000000 THEN 1 ELSE 0 END AS brk FROM a WINDOW w AS (PARTITION BY {by} ORDER BY observed_at, flow_id)),
 s AS (SELECT *, sum(brk) OVER (PARTITION BY {by} ORDER BY observed_at, flow_id) AS run FROM g),
 best AS (SELECT *, row_number() OVER (PARTITION BY {by}, run ORDER BY p_attack DESC, flow_id) AS r FROM s),
 reps AS (SELECT {batch}, flow_id FROM best WHERE r = 1 QUALIFY row_number() OVER (PARTITION BY {batch} ORDER BY p_attack DESC, flow_id) <= {max(cap, ceiling)}),
 n AS (SELECT {batch}, count(*) AS held FROM best WHERE r = 1 GROUP BY 1),
 ranked AS (SELECT b.{batch}, flow_id, row_number() OVER (PARTITION BY b.{batch} ORDER BY p_attack DESC, flow_id) AS k FROM best b WHERE r > 1),
 rest AS (SELECT flow_id FROM ranked JOIN n USING ({batch}) WHERE k <= {cap} - held)
 SELECT flow_id FROM reps UNION ALL SELECT flow_id FROM rest"""


@query("m16_select", select_sql(25, 100, 300, "batch"))
def m16_select(spark, sf_dir):
    return D.select_for_explanation(B.scored(spark, sf_dir), "batch").select("flow_id")


@query("m16_select_day_runs", select_sql(400, 100, 86400, "day"))
def m16_select_day_runs(spark, sf_dir):
    return D.select_for_explanation(B.scored(spark, sf_dir), "day", cap=400, gap_s=86400).select("flow_id")

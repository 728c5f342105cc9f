"""Queries over evaluation reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens import constants as K
from flowlens.catalog.decide import curve_rows, points_sql
from flowlens.catalog.registry import query, r6
from flowlens.functions.exprs import wilson
from flowlens.operators import evaluate as E
from flowlens.plans import bindings as B


def _wilson_sql(k: str, n: str) -> tuple[str, str]:
    z = "1.96e0"
    p = f"(cast({k} AS double) / {n})"
    d = f"(1 + {z} * {z} / {n})"
    centre = f"(({p} + {z} * {z} / (2e0 * {n})) / {d})"
    half = f"({z} * sqrt({p} * (1 - {p}) / {n} + {z} * {z} / (4e0 * {n} * {n})) / {d})"
    return (f"round(CASE WHEN {n} > 0 THEN greatest(0e0, {centre} - {half}) ELSE 0e0 END, 6)",
            f"round(CASE WHEN {n} > 0 THEN least(1e0, {centre} + {half}) ELSE 1e0 END, 6)")


def _div(a: str, b: str) -> str:
    return f"coalesce(cast({a} AS double) / nullif({b}, 0), 0e0)"


Y = "family <> 'BENIGN'"
R_LO, R_HI = _wilson_sql("ktp", "na")
F_LO, F_HI = _wilson_sql("kfp", "nb")
BINARY_SQL = f"""WITH {B.FLOWS_SQL}, c AS (SELECT tool = 'x' AS dummy, count(*) AS n, count(*) FILTER ({Y}) AS na, count(*) FILTER (NOT ({Y})) AS nb,
 coalesce(sum(w) FILTER (p_attack >= 0.5e0 AND {Y}), 0) AS tp, coalesce(sum(w) FILTER (p_attack >= 0.5e0 AND NOT ({Y})), 0) AS fp,
 coalesce(sum(w) FILTER (p_attack < 0.5e0 AND {Y}), 0) AS fn, coalesce(sum(w) FILTER (p_attack < 0.5e0 AND NOT ({Y})), 0) AS tn,
 count(*) FILTER (p_attack >= 0.5e0 AND {Y}) AS ktp, count(*) FILTER (p_attack >= 0.5e0 AND NOT ({Y})) AS kfp FROM flows GROUP BY 1),
 p AS (SELECT *, {_div('tp', '(tp + fp)')} AS precision, {_div('tp', '(tp + fn)')} AS recall, {_div('fp', '(fp + tn)')} AS fpr FROM c)
 SELECT n, na AS n_attack, nb AS n_benign, cast(round_even(tp, 0) AS bigint) AS tp, cast(round_even(fp, 0) AS bigint) AS fp, cast(round_even(fn, 0) AS bigint) AS fn, cast(round_even(tn, 0) AS bigint) AS tn,
 round(precision, 6) AS precision, round(recall, 6) AS recall, round(fpr, 6) AS fpr, round({_div('2 * precision * recall', '(precision + recall)')}, 6) AS f1,
 {R_LO} AS recall_lo, {R_HI} AS recall_hi, {F_LO} AS fpr_lo, {F_HI} AS fpr_hi FROM p"""


@query("a1_binary", BINARY_SQL)
def a1_binary(spark, sf_dir):
    f = B.flows(spark, sf_dir)
    return r6(E.binary_report(f, F.col("family") != "BENIGN", F.col("p_attack") >= 0.5, F.col("w")))


def ranking_sql(source: str, score: str, y: str, w: str) -> str:
    """CTE ``quality``: roc_auc and pr_auc of one table."""
    return f"""g AS (SELECT {score} AS s, sum(CASE WHEN {y} THEN {w} ELSE 0e0 END) AS p, sum(CASE WHEN {y} THEN 0e0 ELSE {w} END) AS q FROM {source} GROUP BY 1),
 c AS (SELECT *, sum(p) OVER (ORDER BY s DESC) AS cp, sum(q) OVER (ORDER BY s DESC) AS cq, sum(p) OVER () AS tp, sum(q) OVER () AS tq FROM g),
 quality AS (SELECT round(sum(q * (cp - p / 2)) / (max(tp) * max(tq)), 6) AS roc_auc, round(sum(p * cp / (cp + cq)) / max(tp), 6) AS pr_auc FROM c)"""


@query("a2_roc_auc", f"WITH {B.FLOWS_SQL}, {ranking_sql('flows', 'p_attack', Y, 'w')} SELECT roc_auc FROM quality")
def a2_roc_auc(spark, sf_dir):
    f = B.flows(spark, sf_dir)
    return r6(E.ranking_quality(f, F.col("family") != "BENIGN", "p_attack", F.col("w")).select("roc_auc"))


@query("a3_pr_auc", f"WITH {B.FLOWS_SQL}, {ranking_sql('flows', 'p_attack', Y, 'w')} SELECT pr_auc FROM quality")
def a3_pr_auc(spark, sf_dir):
    f = B.flows(spark, sf_dir)
    return r6(E.ranking_quality(f, F.col("family") != "BENIGN", "p_attack", F.col("w")).select("pr_auc"))


LABELLED_SQL = "labelled AS (SELECT n_chars, quality = 1 AS y, toxic FROM labels JOIN documents USING (doc_id))"


@query("a2_labels_auc", f"WITH {LABELLED_SQL}, {ranking_sql('labelled', 'n_chars', 'y', '1e0')} SELECT roc_auc, pr_auc FROM quality")
def a2_labels_auc(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    df = docs.join(B.table(spark, sf_dir, "labels"), "doc_id")
    return r6(E.ranking_quality(df, F.col("quality") == 1, "n_chars"))


W_LO, W_HI = _wilson_sql("k", "n")


@query("a4_wilson", f"WITH g AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS k FROM events GROUP BY 1) SELECT user_id, k, n, {W_LO} AS lo, {W_HI} AS hi FROM g")
def a4_wilson(spark, sf_dir):
    g = B.table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("k"))
    lo, hi = wilson(F.col("k"), F.col("n"))
    return r6(g.select("user_id", "k", "n", lo.alias("lo"), hi.alias("hi")))


CONFUSION_SQL = f"""WITH {B.SCORED_SQL}, cells AS (SELECT family AS "true", attack_family AS pred, sum(w) AS weighted, count(*) AS raw FROM scored GROUP BY 1, 2)"""


def confusion_cells(spark, sf_dir, dense=False):
    return E.confusion(B.scored(spark, sf_dir), "family", "attack_family", F.col("w"), dense)


@query("a5_confusion", CONFUSION_SQL + """, labels_seen AS (SELECT "true" AS l FROM cells UNION SELECT pred FROM cells)
 SELECT a.l AS "true", b.l AS pred, cast(round_even(coalesce(weighted, 0e0), 0) AS bigint) AS weighted, coalesce(raw, 0) AS raw FROM labels_seen a CROSS JOIN labels_seen b LEFT JOIN cells c ON c."true" = a.l AND c.pred = b.l""")
def a5_confusion(spark, sf_dir):
    return confusion_cells(spark, sf_dir, dense=True).withColumn("weighted", F.rint("weighted").cast("bigint"))


C_LO, C_HI = _wilson_sql("rd", "rt")
FAMILY_REPORT_SQL = CONFUSION_SQL + f""", l AS (SELECT "true" AS family FROM cells UNION SELECT pred FROM cells),
 s AS (SELECT family, (SELECT coalesce(sum(weighted), 0) FROM cells WHERE "true" = family) AS t, (SELECT coalesce(sum(weighted), 0) FROM cells WHERE pred = family) AS p,
 (SELECT coalesce(sum(weighted), 0) FROM cells WHERE pred = family AND "true" = family) AS d, (SELECT coalesce(sum(raw), 0)::bigint FROM cells WHERE "true" = family) AS rt,
 (SELECT coalesce(sum(raw), 0)::bigint FROM cells WHERE "true" = family AND pred = family) AS rd, (SELECT sum(weighted) FROM cells) AS total FROM l),
 r AS (SELECT family, {_div('d', 'p')} AS precision, {_div('d', 't')} AS recall, {_div('(p - d)', '(total - t)')} AS fpr, cast(round_even(t, 0) AS bigint) AS support, rt AS sample_support, {C_LO} AS recall_lo, {C_HI} AS recall_hi FROM s),
 report AS (SELECT *, {_div('2 * precision * recall', '(precision + recall)')} AS f1 FROM r)"""


@query("a6_family", FAMILY_REPORT_SQL + " SELECT family, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(fpr, 6) AS fpr, support, sample_support, recall_lo, recall_hi, (SELECT round(avg(f1), 6) FROM report WHERE support > 0) AS macro_f1 FROM report")
def a6_family(spark, sf_dir):
    report = E.family_report(confusion_cells(spark, sf_dir))
    macro = E.macro_f1(report).head()[0]
    return r6(report.withColumn("macro_f1", F.lit(macro)))


@query("a6_family_auc", f"WITH {B.FLOWS_SQL}, g AS (SELECT fam, fconf AS s, sum(CASE WHEN family = fam THEN w ELSE 0e0 END) AS p, sum(CASE WHEN family = fam THEN 0e0 ELSE w END) AS q FROM flows, (SELECT DISTINCT family AS fam FROM flows) GROUP BY 1, 2),"
       " c AS (SELECT *, sum(p) OVER (PARTITION BY fam ORDER BY s DESC) AS cp, sum(p) OVER (PARTITION BY fam) AS tp, sum(q) OVER (PARTITION BY fam) AS tq FROM g) SELECT fam AS family, round(sum(q * (cp - p / 2)) / (max(tp) * max(tq)), 6) AS roc_auc FROM c GROUP BY 1")
def a6_family_auc(spark, sf_dir):
    return r6(E.family_auc(B.flows(spark, sf_dir), "family", "fconf", F.col("w")))


@query("a7_low_support", FAMILY_REPORT_SQL + " SELECT family, family || ': only ' || sample_support || ' test flows, so its metrics are unreliable (recall 95% CI ' || printf('%.2f', recall_lo) || '-' || printf('%.2f', recall_hi) || ')' AS caveat FROM report WHERE sample_support > 0 AND sample_support < 2500")
def a7_low_support(spark, sf_dir):
    return E.low_support(r6(E.family_report(confusion_cells(spark, sf_dir)), "recall_lo", "recall_hi"), 2500)


T_LO, T_HI = _wilson_sql("hits", "n")


@query("a8_tool_recall", f"WITH {B.FLOWS_SQL}, g AS (SELECT tool, count(*) AS n, count(*) FILTER (p_attack >= 0.5e0) AS hits FROM flows WHERE {Y} GROUP BY 1), r AS (SELECT *, hits / cast(n AS double) AS rec FROM g)"
       f" SELECT tool, n, hits, round(rec, 6) AS recall, {T_LO} AS recall_lo, {T_HI} AS recall_hi, tool = (SELECT tool FROM r WHERE n >= 100 ORDER BY rec, tool LIMIT 1) AS is_worst FROM r")
def a8_tool_recall(spark, sf_dir):
    rep = E.recall_by_tool(B.flows(spark, sf_dir), "tool", F.col("p_attack") >= 0.5, F.col("family") != "BENIGN")
    worst = E.worst_tool(rep, "tool").head()
    return r6(rep.withColumn("is_worst", F.col("tool") == F.lit(worst["tool"] if worst else None)))


H = "family = 'Botnet'"
HO_LO, HO_HI = _wilson_sql("k", "n_held_out")


@query("a9_holdout", f"""WITH {B.FLOWS_SQL}, {points_sql(K.HOLDOUT_BUDGETS, f"family <> 'BENIGN' AND NOT ({H})")},
 bf AS (SELECT round(p_attack * fconf, 6) AS pf, row_number() OVER (ORDER BY round(p_attack * fconf, 6)) - 1 AS k, count(*) OVER () AS n FROM flows WHERE family = 'BENIGN'),
 tf AS (SELECT budget, pf AS tau_full FROM bf JOIN b ON k = n - 1 - cast(floor(budget * n) AS bigint)),
 x AS (SELECT budget, tau_binary, tau_family, w, {H} AS h, family = 'BENIGN' AS bn, p_attack > tau_binary AS f, p_attack > tau_binary AND fconf < tau_family AS nv, round(p_attack * fconf, 6) > tau_full AS ff FROM flows, taus JOIN tf USING (budget)),
 s AS (SELECT budget, tau_binary, tau_family, count(*) FILTER (h) AS n_held_out, count(*) FILTER (h AND f) AS k, {_div('count(*) FILTER (h AND f)', 'count(*) FILTER (h)')} AS recall, {_div('count(*) FILTER (h AND ff)', 'count(*) FILTER (h)')} AS recall_seen_ceiling,
 {_div('count(*) FILTER (h AND nv)', 'count(*) FILTER (h AND f)')} AS novel_share_of_detected, {_div('count(*) FILTER (bn AND f)', 'count(*) FILTER (bn)')} AS benign_fpr, {_div('count(*) FILTER (bn AND nv)', 'count(*) FILTER (bn)')} AS benign_flagged_novel,
 {_div('count(*) FILTER (NOT bn AND NOT h AND f)', 'count(*) FILTER (NOT bn AND NOT h)')} AS familiar_attack_recall, {_div('count(*) FILTER (NOT bn AND NOT h AND nv)', 'count(*) FILTER (NOT bn AND NOT h AND f)')} AS familiar_false_novel,
 coalesce(sum(w) FILTER (nv AND h), 0) / sum(w) FILTER (nv) AS novel_bucket_precision FROM x GROUP BY 1, 2, 3)
 SELECT budget, tau_binary, round(tau_family, 6) AS tau_family, n_held_out, {", ".join(f"round({c}, 6) AS {c}" for c in ["recall", "recall_seen_ceiling", "novel_share_of_detected", "benign_fpr", "benign_flagged_novel", "familiar_attack_recall", "familiar_false_novel", "novel_bucket_precision"])}, {HO_LO} AS recall_lo, {HO_HI} AS recall_hi FROM s""")
def a9_holdout(spark, sf_dir):
    rows = curve_rows(spark, sf_dir)
    out = E.holdout_report(rows, rows, F.col("family") == "Botnet")
    return r6(out, *[c for c in out.columns if c not in ("budget", "tau_binary", "n_held_out")])


@query("a10_seeds", f"""WITH {B.FLOWS_SQL}, r AS (SELECT tool AS unit, 0.1e0 AS budget, user_id % 3 AS seed, avg(CASE WHEN p_attack >= 0.5e0 THEN 1e0 ELSE 0e0 END) AS recall,
 avg(fconf) FILTER (tool <> 'view' OR user_id % 3 = 1) AS novel_bucket_precision FROM flows GROUP BY 1, 2, 3)
 SELECT unit, budget, count(*) AS seeds, round(avg(recall), 6) AS recall, round(avg(novel_bucket_precision), 6) AS novel_bucket_precision, round(min(recall), 6) AS recall_min, round(max(recall), 6) AS recall_max,
 string_agg(cast(round(recall, 4) AS varchar), ',' ORDER BY seed) AS recall_by_seed FROM r GROUP BY 1, 2""")
def a10_seeds(spark, sf_dir):
    f = B.flows(spark, sf_dir)
    runs = f.groupBy(F.col("tool").alias("unit"), F.lit(0.1).alias("budget"), (F.col("user_id") % 3).alias("seed")).agg(
        F.avg((F.col("p_attack") >= 0.5).cast("double")).alias("recall"),
        F.avg(F.when((F.col("tool") != "view") | (F.col("user_id") % 3 == 1), F.col("fconf"))).alias("novel_bucket_precision"))
    out = E.aggregate_seeds(runs, "unit", "budget", ["recall", "novel_bucket_precision"])
    texts = F.transform("recall_by_seed", lambda x: x.cast("string"))
    return r6(out.withColumn("recall_by_seed", F.array_join(texts, ",")))


@query("a12_rank", f"""WITH {B.FLOWS_SQL}, r AS (SELECT tool, dst_port, user_id, avg(p_attack) AS main, avg(fconf) AS tie FROM flows GROUP BY 1, 2, 3) SELECT cast(user_id AS varchar) AS config, round(avg(main), 6) AS objective, round(avg(tie), 6) AS tie_break,
 row_number() OVER (ORDER BY round(avg(main), 6) DESC, round(avg(tie), 6) DESC, cast(user_id AS varchar)) AS rank FROM r GROUP BY user_id""")
def a12_rank(spark, sf_dir):
    from flowlens.models.tuning import rank_configs

    f = B.flows(spark, sf_dir)
    per = f.groupBy(F.col("user_id").cast("string").alias("config"), F.col("tool").alias("unit")).agg(
        F.avg("p_attack").alias("main"), F.avg("fconf").alias("tie"))
    return rank_configs(per, "config", "main", "tie").withColumn("rank", F.col("rank").cast("bigint"))


TRUTH = "CASE WHEN family = 'BENIGN' THEN 'BENIGN' WHEN family = 'Botnet' THEN 'Outlier' ELSE 'Malicious' END"
MONTH_SQL = f"""WITH {B.FLOWS_SQL}, m AS (SELECT *, {TRUTH} AS lab, p_attack >= 0.6e0 AS f, anomaly_pct >= 90 AS a FROM flows)
 SELECT day, count(*) AS n, round({_div("sum(w) FILTER (lab = 'Malicious' AND f)", "sum(w) FILTER (lab = 'Malicious')")}, 6) AS recall,
 round({_div("sum(w) FILTER (lab = 'BENIGN' AND f)", "sum(w) FILTER (lab = 'BENIGN')")}, 6) AS benign_fpr, round({_div("sum(w) FILTER (lab = 'Malicious' AND f)", "sum(w) FILTER (lab <> 'Outlier' AND f)")}, 6) AS precision_natural,
 round(avg(CASE WHEN lab = 'Malicious' THEN 1e0 ELSE 0e0 END), 6) AS positive_share, round(count(*) FILTER (lab = 'Outlier' AND f) / cast(nullif(count(*) FILTER (lab = 'Outlier'), 0) AS double), 6) AS unexplained_flagged_binary,
 round(count(*) FILTER (lab = 'Outlier' AND a) / cast(nullif(count(*) FILTER (lab = 'Outlier'), 0) AS double), 6) AS unexplained_flagged_anomaly,
 round(count(*) FILTER (lab = 'BENIGN' AND a) / cast(nullif(count(*) FILTER (lab = 'BENIGN'), 0) AS double), 6) AS benign_flagged_anomaly FROM m GROUP BY 1"""


@query("a14_monthly", MONTH_SQL)
def a14_monthly(spark, sf_dir):
    f = B.flows(spark, sf_dir)
    return r6(E.score_by_period(
        f, "day", F.col("family").isin("DoS", "BruteForce"), F.col("family") == "Botnet",
        F.col("p_attack") >= 0.6, F.col("anomaly_pct") >= 90, F.col("w")))


@query("a14_monthly_auc", f"""WITH {B.FLOWS_SQL}, m AS (SELECT day, p_attack AS s, family <> 'BENIGN' AS y, w FROM flows WHERE family <> 'Botnet'),
 g AS (SELECT day, s, sum(CASE WHEN y THEN w ELSE 0e0 END) AS p, sum(CASE WHEN y THEN 0e0 ELSE w END) AS q FROM m GROUP BY 1, 2),
 c AS (SELECT *, sum(p) OVER (PARTITION BY day ORDER BY s DESC) AS cp, sum(q) OVER (PARTITION BY day ORDER BY s DESC) AS cq, sum(p) OVER (PARTITION BY day) AS tp, sum(q) OVER (PARTITION BY day) AS tq FROM g)
 SELECT day, round(sum(q * (cp - p / 2)) / nullif(max(tp) * max(tq), 0), 6) AS roc_auc, CASE WHEN max(tp) > 0 AND max(tq) > 0 THEN round(sum(p * cp / (cp + cq)) / max(tp), 6) END AS pr_auc FROM c GROUP BY 1""")
def a14_monthly_auc(spark, sf_dir):
    known = B.flows(spark, sf_dir).where(F.col("family") != "Botnet")
    return r6(E.ranking_quality(known, F.col("family") != "BENIGN", "p_attack", F.col("w"), keys=["day"]))


@query("a15_recal", f"""WITH {B.FLOWS_SQL}, weekly AS (SELECT *, strftime(observed_at, '%G-%V') AS period FROM flows),
 cut AS (SELECT period, min(epoch_us(observed_at)) + cast(floor(0.2e0 * (max(epoch_us(observed_at)) - min(epoch_us(observed_at)))) AS bigint) AS c FROM weekly GROUP BY 1),
 win AS (SELECT weekly.* FROM weekly JOIN cut USING (period) WHERE epoch_us(observed_at) < c AND family = 'BENIGN'),
 r AS (SELECT period, p_attack, row_number() OVER (PARTITION BY period ORDER BY p_attack) - 1 AS k, count(*) OVER (PARTITION BY period) AS n FROM win),
 q AS (SELECT period, round(quantile_cont(anomaly_pct, 0.995), 6) AS tau_anomaly FROM win GROUP BY 1)
 SELECT period, n, p_attack AS tau_binary, tau_anomaly FROM r JOIN q USING (period) WHERE k = n - 1 - cast(floor(0.05e0 * n) AS bigint)""")
def a15_recal(spark, sf_dir):
    from flowlens.catalog.split import weekly_flows

    win = E.first_share_window(weekly_flows(spark, sf_dir), "period", "observed_at").where(F.col("family") == "BENIGN")
    return r6(E.recalibrate_thresholds(win, "period", "p_attack", "anomaly_pct", 0.05), "tau_anomaly")


@query("a15_recal_rescore")
def a15_recal_rescore(spark, sf_dir):
    from flowlens.catalog.split import weekly_flows
    from flowlens.models.recalibration import recalibrate

    f, family = weekly_flows(spark, sf_dir), F.col("family")
    return r6(recalibrate(f, "period", "observed_at", ["f_value", "f_k", "src_port"], ["event_id"], family.isin("DoS", "BruteForce"),
                          family == "BENIGN", family == "Botnet", "p_attack", 0.05, F.col("w")))


@query("a16_parity", f"WITH {B.FLOWS_SQL} SELECT count(*) AS rows, round(avg(CASE WHEN (p_attack >= 0.5e0) = (fconf >= 0.5e0) THEN 1e0 ELSE 0e0 END), 6) AS agreement FROM flows")
def a16_parity(spark, sf_dir):
    f = B.flows(spark, sf_dir)
    b = f.select("flow_id", F.col("fconf").alias("p_attack"))
    return r6(E.parity_check(f, b, "flow_id", "p_attack", 0.5))


REPLAY_SQL = f"""WITH {B.SCORED_SQL}, x AS (SELECT *, CASE tool WHEN 'purchase' THEN 'Outlier' WHEN 'click' THEN '' ELSE family END AS gt, verdict <> 'benign' AS hit FROM scored),
 o AS (SELECT *, lower(gt) = 'outlier' AS ou, lower(gt) NOT IN ('benign', 'unknown', '', 'outlier') AS bad FROM x)"""
OUTCOMES = {"tp": "bad AND hit", "fp": "NOT bad AND NOT ou AND hit", "tn": "NOT bad AND NOT ou AND NOT hit", "fn": "bad AND NOT hit"}


def replay_rows(spark, sf_dir):
    tool = F.col("tool")
    return B.scored(spark, sf_dir).withColumn(
        "ground_truth", F.when(tool == "purchase", "Outlier").when(tool == "click", "").otherwise(F.col("family")))


@query("a17_replay", REPLAY_SQL + f""", c AS (SELECT count(*) AS flows, {", ".join(f"count(*) FILTER (verdict = '{v}') AS n_{v}" for v in K.VERDICTS)}, {", ".join(f"count(*) FILTER ({c}) AS {n}" for n, c in OUTCOMES.items())},
 count(*) FILTER (ou) AS outliers, count(*) FILTER (ou AND hit) AS outliers_flagged, (SELECT string_agg(g || '=' || n, ',' ORDER BY g) FROM (SELECT CASE WHEN gt = '' THEN 'UNKNOWN' ELSE gt END AS g, count(*) AS n FROM o GROUP BY 1)) AS truth FROM o),
 p AS (SELECT *, coalesce(tp / cast(nullif(tp + fp, 0) AS double), 1e0) AS pr, coalesce(tp / cast(nullif(tp + fn, 0) AS double), 1e0) AS rc FROM c)
 SELECT * EXCLUDE (pr, rc), round(pr, 6) AS precision, round(rc, 6) AS recall, round({_div('2 * pr * rc', '(pr + rc)')}, 6) AS f1 FROM p""")
def a17_replay(spark, sf_dir):
    f = replay_rows(spark, sf_dir)
    truth = ",".join(f"{r[0]}={r[1]}" for r in sorted(E.truth_counts(f).collect()))
    return r6(E.replay_report(f).withColumn("truth", F.lit(truth)))


@query("a18_progress", REPLAY_SQL + f""", g AS (SELECT batch, {", ".join(f"count(*) FILTER ({c}) AS {n}" for n, c in OUTCOMES.items())} FROM o GROUP BY 1),
 r AS (SELECT batch, {", ".join(f"cast(sum({n}) OVER (ORDER BY batch) AS bigint) AS {n}" for n in OUTCOMES)} FROM g)
 SELECT *, round(coalesce(tp / cast(nullif(tp + fp, 0) AS double), 1e0), 6) AS precision, round(coalesce(tp / cast(nullif(tp + fn, 0) AS double), 1e0), 6) AS recall FROM r""")
def a18_progress(spark, sf_dir):
    return r6(E.progressive_metrics(replay_rows(spark, sf_dir), "batch"))

"""Queries over the population stability operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.catalog.registry import query, r6
from flowlens.operators import drift as D
from flowlens.plans import bindings as B

FLOW_FEATURES = ["f_value", "f_k", "p_attack"]


def reference_sql(source: str, cols: list[str], name: str = "ref") -> str:
    """CTEs: ``<name>`` (feature, edges, n) and ``<name>_exp`` (feature, bin, expected) from a table."""
    long = " UNION ALL ".join(f"SELECT '{c}' AS feature, cast({c} AS double) AS v FROM {source}" for c in cols)
    probs = ", ".join(f"{i / 10}" for i in range(1, 10))
    return f"""{name}_long AS ({long}),
 {name} AS (SELECT feature, list_sort(list_distinct(quantile_cont(v, [{probs}]))) AS edges, count(*) AS n FROM {name}_long GROUP BY 1),
 {name}_cnt AS (SELECT feature, len(list_filter(edges, lambda e: e <= v)) AS bin, count(*) AS c FROM {name}_long JOIN {name} USING (feature) GROUP BY 1, 2),
 {name}_exp AS (SELECT r.feature, b AS bin, coalesce(c, 0) / cast(n AS double) AS expected FROM (SELECT feature, n, unnest(range(len(edges) + 1)) AS b FROM {name}) r LEFT JOIN {name}_cnt k ON k.feature = r.feature AND k.bin = b)"""


def psi_sql(source: str, cols: list[str], keys: list[str], name: str = "got", ref: str = "ref") -> str:
    """CTE ``<name>``: keys, feature, n, psi of a table against ``ref``."""
    k = "".join(f"{x}, " for x in keys)
    kk = "".join(f" AND o.{x} = g.{x}" for x in keys)
    long = " UNION ALL ".join(f"SELECT {k}'{c}' AS feature, cast({c} AS double) AS v FROM {source}" for c in cols)
    return f"""{name}_long AS ({long}), {name}_o AS (SELECT {k}feature, len(list_filter(edges, lambda e: e <= v)) AS bin, count(*) AS c FROM {name}_long JOIN {ref} USING (feature) GROUP BY ALL),
 {name}_g AS (SELECT {k}feature, cast(sum(c) AS bigint) AS n FROM {name}_o GROUP BY ALL),
 {name}_t AS (SELECT g.*, greatest(coalesce(o.c, 0) / cast(g.n AS double), 1e-4) AS a, greatest(e.expected, 1e-4) AS e FROM {name}_g g JOIN {ref}_exp e ON e.feature = g.feature LEFT JOIN {name}_o o ON o.feature = g.feature AND o.bin = e.bin{kk}),
 {name} AS (SELECT {k}feature, max(n) AS n, sum((a - e) * ln(a / e)) AS psi FROM {name}_t GROUP BY ALL)"""


REF_N_SQL = f"WITH {B.MEASURES_SQL}, benign AS (SELECT * FROM measures WHERE class = 'N'), {reference_sql('benign', B.MEASURES)}"


@query("r1_reference", REF_N_SQL + " SELECT feature, n, cast(len(edges) AS integer) AS n_edges, round(list_sum(edges), 6) AS edge_sum, (SELECT round(sum(expected * (bin + 1)), 6) FROM ref_exp e WHERE e.feature = ref.feature) AS weighted_share FROM ref")
def r1_reference(spark, sf_dir):
    ref = D.build_reference(B.measures(spark, sf_dir).where(F.col("class") == "N"), B.MEASURES)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    weighted = total(F.transform("expected", lambda x, i: x * (i + 1)))
    return r6(ref.select("feature", "n", F.size("edges").alias("n_edges"), total(F.col("edges")).alias("edge_sum"),
                         weighted.alias("weighted_share")))


def measures_reference(spark, sf_dir):
    return D.build_reference(B.measures(spark, sf_dir).where(F.col("class") == "N"), B.MEASURES)


def shifted(spark, sf_dir):
    """Line items with heavier quantities and a collapsed discount."""
    return B.measures(spark, sf_dir).withColumns({
        "l_quantity": F.col("l_quantity") + 15, "l_discount": F.lit(0.0)})


SHIFT_SQL = "shifted AS (SELECT period, l_quantity + 15 AS l_quantity, l_extendedprice, 0e0 AS l_discount, l_tax FROM measures)"


@query("r2_psi", REF_N_SQL + f", {SHIFT_SQL}, {psi_sql('shifted', B.MEASURES, [])} SELECT feature, n, round(psi, 6) AS psi FROM got")
def r2_psi(spark, sf_dir):
    return r6(D.psi(shifted(spark, sf_dir), measures_reference(spark, sf_dir)))


STATUS_SQL = "CASE WHEN {x} >= 0.25 THEN 'alert' WHEN {x} >= 0.1 THEN 'watch' ELSE 'ok' END"


@query("r3_status", REF_N_SQL + f", {SHIFT_SQL}, {psi_sql('shifted', B.MEASURES, ['period'])} SELECT period, feature, {STATUS_SQL.format(x='psi')} AS status FROM got")
def r3_status(spark, sf_dir):
    return D.with_status(D.psi(shifted(spark, sf_dir), measures_reference(spark, sf_dir), ["period"])).select("period", "feature", "status")


FLOW_REF_SQL = f"WITH {B.SCORED_SQL}, calm AS (SELECT * FROM scored WHERE family = 'BENIGN'), {reference_sql('calm', FLOW_FEATURES)}, quiet AS (SELECT * FROM scored WHERE verdict = 'benign')"


def flow_reference(spark, sf_dir):
    return D.build_reference(B.scored(spark, sf_dir).where(F.col("family") == "BENIGN"), FLOW_FEATURES)


REPORT_SQL = FLOW_REF_SQL + f""", {psi_sql('quiet', FLOW_FEATURES, [])}, report AS (SELECT feature, psi, {STATUS_SQL.format(x='psi')} AS status, (SELECT max(psi) FROM got) AS max_psi,
 {STATUS_SQL.format(x='(SELECT max(psi) FROM got)')} AS overall_status, n AS window_size, (SELECT avg(CASE WHEN verdict <> 'benign' THEN 1e0 ELSE 0e0 END) FROM scored) AS attack_rate, 0.001e0 AS reference_rate FROM got)"""


@query("r4_report", REPORT_SQL + " SELECT feature, round(psi, 6) AS psi, status, round(max_psi, 6) AS max_psi, overall_status, window_size, round(attack_rate, 6) AS attack_rate, reference_rate FROM report")
def r4_report(spark, sf_dir):
    return r6(D.drift_report(B.scored(spark, sf_dir), flow_reference(spark, sf_dir)))


ROLL_SQL = FLOW_REF_SQL + f""", q AS (SELECT *, row_number() OVER (ORDER BY observed_at, flow_id) AS seq FROM scored), bq AS (SELECT *, row_number() OVER (ORDER BY seq) AS pos FROM q WHERE verdict = 'benign'),
 cp AS (SELECT seq AS checkpoint FROM q WHERE seq % 500 = 0),
 cps AS (SELECT checkpoint, (SELECT count(*) FROM bq WHERE bq.seq <= checkpoint) AS e, (SELECT avg(CASE WHEN verdict <> 'benign' THEN 1e0 ELSE 0e0 END) FROM q WHERE q.seq > checkpoint - 2000 AND q.seq <= checkpoint) AS attack_rate FROM cp),
 win AS (SELECT checkpoint, f_value, f_k, p_attack FROM cps JOIN bq ON bq.pos > e - 2000 AND bq.pos <= e WHERE e >= 200), {psi_sql('win', FLOW_FEATURES, ['checkpoint'])}"""


ROLLING_SQL = ROLL_SQL + " SELECT checkpoint, least(e, 2000) AS window_size, round(attack_rate, 6) AS attack_rate, feature, round(psi, 6) AS psi FROM got JOIN cps USING (checkpoint)"


@query("r5_rolling", ROLLING_SQL)
def r5_rolling(spark, sf_dir):
    s = B.scored(spark, sf_dir)
    return r6(D.rolling_drift(s, flow_reference(spark, sf_dir), ["observed_at", "flow_id"]))


@query("r6_monthly", REF_N_SQL + f", {SHIFT_SQL}, {psi_sql('shifted', B.MEASURES, ['period'])}, w AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY psi DESC, feature) AS k FROM got) SELECT period, round(psi, 6) AS max_psi, feature AS worst_feature, {STATUS_SQL.format(x='psi')} AS status FROM w WHERE k = 1")
def r6_monthly(spark, sf_dir):
    return r6(D.monthly_drift(shifted(spark, sf_dir), measures_reference(spark, sf_dir), "period"))


@query("r7_shift", REPORT_SQL + " SELECT feature, round(attack_rate - reference_rate, 6) AS rate_shift FROM report")
def r7_shift(spark, sf_dir):
    return r6(D.rate_shift(D.drift_report(B.scored(spark, sf_dir), flow_reference(spark, sf_dir))).select("feature", "rate_shift"))


@query("r8_guidance", REF_N_SQL + f", {SHIFT_SQL}, {psi_sql('shifted', B.MEASURES, ['period'])} SELECT period, feature, CASE WHEN psi >= 0.25 THEN '{D.GUIDANCE_ALERT}' WHEN psi >= 0.1 THEN '{D.GUIDANCE_WATCH}' ELSE '{D.GUIDANCE_OK}' END AS guidance FROM got")
def r8_guidance(spark, sf_dir):
    per = D.psi(shifted(spark, sf_dir), measures_reference(spark, sf_dir), ["period"])
    return D.drift_guidance(per).select("period", "feature", "guidance")


@query("r9_refresh")
def r9_refresh(spark, sf_dir):
    from flowlens.catalog.features import spec
    from flowlens.operators import features as FE

    train = B.measures(spark, sf_dir).where(F.col("period") < "2000")
    params = FE.fit_transformer(train, spec(spark))
    return D.refresh_reference(train.where(F.col("class") == "N"), params)

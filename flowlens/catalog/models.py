"""Queries over models; most are random or iterative, so invariants are returned instead of SQL twins."""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from flowlens.catalog.registry import query, r6
from flowlens.catalog.split import _split_sql
from flowlens.models import attribution as A
from flowlens.models import bundle as BU
from flowlens.models import forest as M
from flowlens.models import isolation as ISO
from flowlens.models import smote as SM
from flowlens.models import tuning as T
from flowlens.operators import decide as D
from flowlens.operators import evaluate as E
from flowlens.operators import features as FE
from flowlens.operators import split as S
from flowlens.plans import bindings as B
from flowlens.session import fresh_path, written

FEATURES = ["f_value", "f_k", "protocol", "f_port"]
TOOL_SPLIT_SQL = f"WITH {B.FLOWS_SQL}, {_split_sql('tool', 'flows', 'parts')}"


def parts(spark, sf_dir):
    f = S.time_block_split(B.flows(spark, sf_dir), ["tool"], "observed_at")
    return f.where(F.col("split") == "train"), f.where(F.col("split") == "val"), f.where(F.col("split") == "test")


def written_parts(spark, sf_dir):
    """The three parts from one stored table, for queries that read them again and again."""
    f = written(S.time_block_split(B.flows(spark, sf_dir).drop("p_attack", "fconf"), ["tool"], "observed_at"), "parts")
    return tuple(f.where(F.col("split") == part).drop("split") for part in ("train", "val", "test"))


def attack():
    return F.col("family") != "BENIGN"


@query("m1_forest", "SELECT true AS above_floor, true AS below_ceiling")
def m1_forest(spark, sf_dir):
    train, _, test = parts(spark, sf_dir)
    model = M.fit_binary_forest(train, FEATURES, attack())
    auc = E.ranking_quality(M.score(test.drop("p_attack"), FEATURES, model), attack(), "p_attack")
    return auc.select((F.col("roc_auc") > 0.8).alias("above_floor"), (F.col("roc_auc") < 0.97).alias("below_ceiling"))


@query("m2_family", f"WITH {B.FLOWS_SQL} SELECT DISTINCT family, true AS better_than_chance, true AS not_perfect FROM flows WHERE family <> 'BENIGN'")
def m2_family(spark, sf_dir):
    train, _, test = parts(spark, sf_dir)
    binary = M.fit_binary_forest(train, FEATURES, attack())
    family = M.fit_family_forest(train.where(attack()), FEATURES)
    scored = M.score(test.drop("p_attack", "fconf").where(attack()), FEATURES, binary, family)
    right = F.avg((F.col("closest_family") == F.col("family")).cast("double"))
    return scored.groupBy("family").agg((right > 0.5).alias("better_than_chance"), (right < 0.99).alias("not_perfect"))


@query("m3_score", f"WITH {B.FLOWS_SQL} SELECT count(*) AS n, count(*) AS p_in_range, count(*) AS probs_sum_to_one, count(*) AS best_is_largest FROM flows")
def m3_score(spark, sf_dir):
    f = B.flows(spark, sf_dir).drop("p_attack", "fconf")
    binary = M.fit_binary_forest(f, FEATURES, attack())
    family = M.fit_family_forest(f.where(attack()), FEATURES)
    s = M.score(f, FEATURES, binary, family)
    values = F.map_values("family_probs")
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return s.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("p_attack").between(0, 1)).alias("p_in_range"),
        F.count_if(F.abs(total - 1) < 1e-9).alias("probs_sum_to_one"),
        F.count_if(F.try_element_at("family_probs", F.col("closest_family")) == F.array_max(values)).alias("best_is_largest"))


@query("m4_iforest", "SELECT true AS planted_rank_top")
def m4_iforest(spark, sf_dir):
    f = B.flows(spark, sf_dir).select("event_id", "f_value", "f_k", "src_port", "family")
    forest = ISO.fit_isolation_forest(f.where(F.col("family") == "BENIGN"), ["f_value", "f_k", "src_port"], ["event_id"])
    planted = f.where(F.col("f_k") == 0).withColumns({
        "f_value": F.lit(5000.0), "f_k": F.lit(900.0), "src_port": F.lit(200000), "event_id": -F.col("event_id") - 1})
    scored = ISO.score_isolation(f.unionByName(planted), forest)
    got = scored.withColumn("planted", F.col("event_id") < 0)
    return E.ranking_quality(got, F.col("planted"), "anomaly_score").select((F.col("roc_auc") > 0.99).alias("planted_rank_top"))


def points(spark, sf_dir):
    return B.table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("string").alias("label"), F.col("vec_id").cast("string").alias("id"),
        F.transform("embedding", lambda x: x.cast("double")).alias("vec"))


@query("m12_neighbours", """WITH p AS (SELECT cast(label AS varchar) AS label, cast(vec_id AS varchar) AS id, cast(embedding AS double[]) AS v FROM embeddings),
 d AS (SELECT a.label, a.id, b.id AS near, list_distance(a.v, b.v) AS dist FROM p a JOIN p b ON a.label = b.label AND a.id <> b.id), r AS (SELECT *, row_number() OVER (PARTITION BY label, id ORDER BY dist, near) AS k FROM d)
 SELECT label, id, near, round(dist, 6) AS dist, cast(k AS integer) AS rank FROM r WHERE k <= 5""")
def m12_neighbours(spark, sf_dir):
    return r6(SM.nearest_in_class(points(spark, sf_dir), 5, block_rows=256))


@query("m12_smote", """WITH c AS (SELECT cast(label AS varchar) AS label, count(*) AS n FROM embeddings GROUP BY 1) SELECT label, cast(ceil((SELECT max(n) FROM c) * 1.5) AS bigint) - n AS synthetic, true AS inside_box FROM c""")
def m12_smote(spark, sf_dir):
    p = points(spark, sf_dir)
    biggest = p.groupBy("label").count().agg(F.max("count")).head()[0]
    made = SM.smote(p, -(-biggest * 3 // 2))
    cell = lambda df: df.select("label", F.posexplode("vec").alias("dim", "x"))
    box = cell(p).groupBy("label", "dim").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    reach = cell(made).groupBy("label", "dim").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    fits = reach.join(box, ["label", "dim"]).groupBy("label").agg(
        F.min((F.col("a") >= F.col("lo") - 1e-12) & (F.col("b") <= F.col("hi") + 1e-12)).alias("inside_box"))
    return made.groupBy("label").agg(F.count(F.lit(1)).alias("synthetic")).join(fits, "label")


def explained(spark, sf_dir):
    f = B.flows(spark, sf_dir).drop("p_attack")
    model = M.fit_binary_forest(f, FEATURES, attack())
    return M.score(f, FEATURES, model), model


@query("m14_attrib", "SELECT count(*) AS n, count(*) AS additive FROM events")
def m14_attrib(spark, sf_dir):
    scored, model = explained(spark, sf_dir)
    a = A.attribute(scored, FEATURES, model)
    total = F.col("base") + F.aggregate("contributions", F.lit(0.0), lambda x, y: x + y)
    return a.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs(total - F.col("p_attack")) < 1e-6).alias("additive"))


@query("m14_top_contributions")
def m14_top_contributions(spark, sf_dir):
    scored, model = explained(spark, sf_dir)
    ready = scored.withColumns({
        "verdict": F.when(F.col("p_attack") > 0.5, "known_attack").otherwise("benign"), "attack_family": F.col("family")})
    picked = D.select_for_explanation(ready, "batch", gap_s=86400)
    base = FE.baseline_stats(B.flows(spark, sf_dir).where(~attack()), FEATURES)
    rows = A.top_contributions(A.attribute(picked, FEATURES, model), FEATURES, base, "flow_id", "observed_at", 3)
    return r6(rows.drop("ts"))


@query("m15_importance", """SELECT feature, round(avg(abs(c)), 6) AS importance FROM (SELECT 'value' AS feature, value / 100e0 - 0.3e0 AS c FROM events UNION ALL SELECT 'user', 0.5e0 - user_id / 150e0 FROM events) GROUP BY 1""")
def m15_importance(spark, sf_dir):
    e = B.table(spark, sf_dir, "events")
    pairs = F.explode(F.array(
        F.struct(F.lit("value").alias("feature"), (F.col("value") / 100.0 - 0.3).alias("contribution")),
        F.struct(F.lit("user").alias("feature"), (0.5 - F.col("user_id") / 150.0).alias("contribution"))))
    return r6(A.global_importance(e.select(pairs.alias("p")).select("p.*")))


@query("a16_bundle_parity", "SELECT count(*) AS rows, 1e0 AS agreement FROM events")
def a16_bundle_parity(spark, sf_dir):
    train, val, _ = parts(spark, sf_dir)
    rows = [(i, c, 0.0, 70000.0, c == "f_value", None) for i, c in enumerate(FEATURES)]
    spec = spark.createDataFrame(rows, FE.SPEC_COLUMNS)
    made = BU.fit_bundle(train, val, spec, ["event_id"], 0.01)
    path = fresh_path(spark, "bundle")
    BU.save_bundle(made, path)
    flows = B.flows(spark, sf_dir).drop("p_attack", "fconf")
    a, b = (BU.detect(flows, x).select("flow_id", "p_attack") for x in (made, BU.load_bundle(spark, path)))
    return E.parity_check(a, b, "flow_id", "p_attack", made.rules.head()["tau_binary"])


def attack_units(df, *columns):
    """(column, value) of every attack family or tool in the table."""
    found = df.where(attack()).select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns])).alias("u")).select("u.*").distinct()
    return sorted((r["column"], r["value"]) for r in found.collect())


RATES = ["recall", "recall_seen_ceiling", "benign_fpr", "familiar_attack_recall"]


def in_range(*rates):
    """All of them null or between 0 and 1."""
    fine = F.lit(True)
    for r in rates:
        fine = fine & F.coalesce(F.col(r).between(0, 1), F.lit(True))
    return fine


@query("a11_run_holdouts", TOOL_SPLIT_SQL + """, t AS (SELECT flows.* FROM flows JOIN parts USING (event_id) WHERE split = 'test'),
 u AS (SELECT DISTINCT family AS unit FROM flows WHERE family <> 'BENIGN' UNION SELECT DISTINCT tool FROM flows WHERE family <> 'BENIGN')
 SELECT unit, s::int AS seed, b AS budget, (SELECT count(*) FROM t WHERE family = unit OR tool = unit) AS n_held_out, true AS rates_in_range, true AS grows_with_budget
 FROM u, unnest([7, 8, 9]) AS x(s), unnest([0.0001e0, 0.0005e0, 0.001e0, 0.005e0]) AS y(b)""")
def a11_run_holdouts(spark, sf_dir):
    train, val, test = written_parts(spark, sf_dir)
    setting = T.Setting(FEATURES, M.ForestParams(), M.FAMILY_PARAMS)
    units = attack_units(B.flows(spark, sf_dir), "family", "tool")
    out = T.run_holdouts(train, val, test, units, setting)
    # a larger budget lowers the threshold, so every rate can only grow
    before = Window.partitionBy("unit", "seed").orderBy("budget")  # four rows
    grows = F.coalesce(F.col("recall") >= F.lag("recall").over(before), F.lit(True)) & F.coalesce(
        F.col("benign_fpr") >= F.lag("benign_fpr").over(before), F.lit(True))
    return out.select("unit", "seed", "budget", "n_held_out", in_range(*RATES).alias("rates_in_range"), grows.alias("grows_with_budget"))


@query("a11_seed_summary", """WITH u AS (SELECT DISTINCT CASE event_type WHEN 'signup' THEN 'DoS' WHEN 'error' THEN 'BruteForce' ELSE 'Botnet' END AS unit
 FROM events WHERE event_type NOT IN ('view', 'click')) SELECT unit, b AS budget, 3::bigint AS seeds, 3 AS recalls, true AS mean_between FROM u, unnest([0.0001e0, 0.0005e0, 0.001e0, 0.005e0]) AS y(b)""")
def a11_seed_summary(spark, sf_dir):
    train, val, test = written_parts(spark, sf_dir)
    setting = T.Setting(FEATURES, M.ForestParams(), M.FAMILY_PARAMS)
    out = T.run_holdouts(train, val, test, attack_units(B.flows(spark, sf_dir), "family"), setting)
    got = E.aggregate_seeds(out, "unit", "budget", RATES)
    between = (F.col("recall") >= F.col("recall_min") - 1e-12) & (F.col("recall") <= F.col("recall_max") + 1e-12)
    return got.select("unit", "budget", "seeds", F.size("recall_by_seed").alias("recalls"), between.alias("mean_between"))


@query("a12_tune", """SELECT run, n AS configs, n AS distinct_configs, true AS default_tried, true AS ranks_follow_objective, true AS tie_within_objective
 FROM (VALUES ('search', 11::bigint)) AS v(run, n) UNION ALL SELECT 'confirm', NULL, NULL, true, true, true""")
def a12_tune(spark, sf_dir):
    train, val, _ = written_parts(spark, sf_dir)
    tools = [value for _, value in attack_units(B.flows(spark, sf_dir), "tool")]
    ranked, confirmed = T.tune(train, val, FEATURES, tools)
    both = ranked.withColumn("run", F.lit("search")).unionByName(confirmed.withColumn("run", F.lit("confirm")))
    default = F.lit(json.dumps(T.DEFAULT_CONFIG, sort_keys=True))
    before = F.lag("objective").over(Window.partitionBy("run").orderBy("rank"))  # a row per tried setting
    both = both.withColumn("_follows", F.coalesce(F.col("objective") <= before, F.lit(True)))
    # the confirming run has three settings, and the default where it is none of them
    search = F.col("run") == "search"
    return both.groupBy("run").agg(
        F.count(F.lit(1)).alias("configs"), F.countDistinct("config").alias("distinct_configs"), F.max(F.col("config") == default).alias("default_tried"),
        F.min("_follows").alias("ranks_follow_objective"), F.min(F.col("tie_break") <= F.col("objective")).alias("tie_within_objective")).select(
        "run", *[F.when(search, F.col(c)).alias(c) for c in ("configs", "distinct_configs")], "default_tried", "ranks_follow_objective", "tie_within_objective")


@query("a13_ablation", f"""WITH {B.FLOWS_SQL}, v AS (SELECT 'all' AS variant, 4 AS features UNION ALL SELECT 'no_' || x, 3 FROM unnest(['f_value', 'f_k', 'protocol', 'f_port']) AS y(x)),
 h AS (SELECT NULL::varchar AS held_tool UNION ALL SELECT DISTINCT tool FROM flows WHERE family <> 'BENIGN')
 SELECT variant, features, held_tool, true AS rates_in_range, held_tool IS NOT NULL AS held_known FROM v, h""")
def a13_ablation(spark, sf_dir):
    train, _, test = written_parts(spark, sf_dir)
    variants = {"all": FEATURES} | {f"no_{x}": [c for c in FEATURES if c != x] for x in FEATURES}
    out = T.ablation(train, test, variants, M.ForestParams(), minimum=20).withColumn("held_tool", F.lit(None).cast("string"))
    for _, tool in attack_units(B.flows(spark, sf_dir), "tool"):
        held = T.ablation(train, test, variants, M.ForestParams(), budget=0.005, held_tool=tool, minimum=20)
        out = out.unionByName(held.withColumn("held_tool", F.lit(tool)))
    return out.select("variant", "features", "held_tool", in_range("recall", "worst_recall", "held_recall").alias("rates_in_range"),
                      F.col("held_recall").isNotNull().alias("held_known"))


@query("m4_study", f"""WITH {B.FLOWS_SQL}, s AS (SELECT unnest(['n100_s256', 'n300_s256', 'n200_s2048', 'n200_s8192', 'n200_s2048_f05', 'n200_s256_f03']) AS setting),
 t AS (SELECT tool, count(*) AS n FROM flows WHERE family <> 'BENIGN' GROUP BY 1) SELECT setting, tool, n, true AS rates_in_range, true AS cut_holds FROM s, t""")
def m4_study(spark, sf_dir):
    f = B.flows(spark, sf_dir).select("event_id", "tool", "family", "f_value", "f_k", "src_port", "f_port")
    per, tools = ISO.isolation_study(f.where(~attack()), f, ["f_value", "f_k", "src_port", "f_port"], ["event_id"], attack(), "tool")
    # at most half a percent of the benign rows, and one, lie above their own 99.5th percentile
    per = per.select("setting", (in_range("roc_auc", "recall") & (F.col("benign_flag_rate") * F.col("n_benign") <= 0.005 * F.col("n_benign") + 1)).alias("cut_holds"))
    return tools.join(per, "setting").select("setting", "tool", "n", in_range("recall", "recall_lo", "recall_hi").alias("rates_in_range"), "cut_holds")

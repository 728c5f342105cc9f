"""Queries over deduplication, profiling and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.catalog.registry import ntz, query, r6
from flowlens.operators import quality as Q
from flowlens.plans import bindings as B

KEYS = ["l_quantity", "l_discount", "l_tax", "l_partkey", "l_returnflag"]
LINES_SQL = """lines AS (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax, l_partkey, l_returnflag, 0 AS part FROM lineitem
 UNION ALL SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax, l_partkey, l_returnflag, 1 FROM lineitem WHERE l_returnflag <> 'N')"""


def lines_with_copies(spark, sf_dir):
    """Line items plus a second delivery of every returned or accepted one."""
    cols = ["l_orderkey", "l_linenumber", *KEYS]
    one = B.table(spark, sf_dir, "lineitem").select(*cols)
    return one.withColumn("part", F.lit(0)).unionByName(
        one.where(F.col("l_returnflag") != "N").withColumn("part", F.lit(1)))


@query("p1_dedupe", f"""WITH {LINES_SQL}, f AS (SELECT *, row_number() OVER (PARTITION BY cast(l_quantity AS float), cast(l_discount AS float), cast(l_tax AS float), l_partkey, l_returnflag
 ORDER BY part, l_orderkey, l_linenumber, l_quantity, l_discount, l_tax) AS rn FROM lines) SELECT l_orderkey, l_linenumber, l_quantity, l_partkey, l_returnflag, part FROM f WHERE rn = 1""")
def p1_dedupe(spark, sf_dir):
    df = Q.dedupe_exact(lines_with_copies(spark, sf_dir), KEYS, ["part", "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"])
    return df.select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_returnflag", "part")


@query("p2_dup_report", f"""WITH {LINES_SQL}, g AS (SELECT l_returnflag, count(*) AS c FROM lines GROUP BY cast(l_quantity AS float), cast(l_discount AS float), cast(l_tax AS float), l_partkey, l_returnflag)
 SELECT l_returnflag, cast(sum(c) AS bigint) AS rows_in, count(*) AS rows_kept, cast(sum(c) - count(*) AS bigint) AS removed,
 round((sum(c) - count(*)) / cast(sum(c) AS double), 6) AS dup_rate FROM g GROUP BY 1""")
def p2_dup_report(spark, sf_dir):
    return r6(Q.dedupe_report(lines_with_copies(spark, sf_dir), KEYS, "l_returnflag"))


def flawed(spark, sf_dir):
    """Line items whose tax, discount and price carry infinities, NaN and negatives by return flag."""
    flag = F.col("l_returnflag")
    return B.table(spark, sf_dir, "lineitem").select(
        "l_quantity",
        F.when(flag == "A", F.lit(float("inf"))).when(flag == "N", F.lit(float("nan"))).otherwise(F.col("l_tax")).alias("tax"),
        F.when(flag == "R", -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice")).alias("price"))


@query("p3_quality", """SELECT 'tax' AS column, count(*) FILTER (l_returnflag = 'A') AS n_inf, count(*) FILTER (l_returnflag = 'N') AS n_nan, cast(0 AS bigint) AS n_neg,
 count(*) FILTER (l_returnflag IN ('A', 'N')) AS rows_with_nonfinite FROM lineitem
 UNION ALL SELECT 'price', 0, 0, count(*) FILTER (l_returnflag = 'R'), count(*) FILTER (l_returnflag IN ('A', 'N')) FROM lineitem""")
def p3_quality(spark, sf_dir):
    df, cols = flawed(spark, sf_dir), ["l_quantity", "tax", "price"]
    return Q.column_quality(df, cols).withColumn("rows_with_nonfinite", F.lit(Q.rows_with_nonfinite(df, cols).head()[0]).cast("bigint"))


@query("p4_day_profile", f"""WITH {B.FLOWS_SQL}, c AS (SELECT day, user_id, tool, min(observed_at) AS t FROM flows GROUP BY 1, 2, 3),
 r AS (SELECT day, count(*) AS raw FROM flows GROUP BY ROLLUP (day)),
 k AS (SELECT day, count(*) AS clean, min(t) AS ts_min, max(t) AS ts_max FROM c GROUP BY ROLLUP (day))
 SELECT r.day, raw, clean, ts_min, ts_max, round((raw - clean) / cast(raw AS double), 6) AS dup_rate FROM r JOIN k ON r.day IS NOT DISTINCT FROM k.day""")
def p4_day_profile(spark, sf_dir):
    f = B.flows(spark, sf_dir).select("day", "user_id", "tool", "observed_at")
    clean = Q.dedupe_exact(f, ["day", "user_id", "tool"], ["observed_at"])
    out = Q.day_profile(f, clean, "day", "observed_at")
    return ntz(r6(out.withColumns({"raw": F.col("raw").cast("bigint"), "clean": F.col("clean").cast("bigint")})))


@query("p5_label_profile", f"""WITH {B.FLOWS_SQL} SELECT day, CASE WHEN protocol = 17 THEN tool || ' [attempted]' ELSE tool END AS label, count(*) AS n,
 min(observed_at) AS ts_min, max(observed_at) AS ts_max FROM flows GROUP BY 1, 2""")
def p5_label_profile(spark, sf_dir):
    f = B.flows(spark, sf_dir).withColumn("attempted", F.col("protocol") == 17)
    return ntz(Q.label_profile(f, "day", "tool", "observed_at", "attempted"))


TOOLS = ["view", "click", "signup", "error", "purchase"]


@query("p6_label_matrix", f"""WITH {B.FLOWS_SQL} SELECT day, {", ".join(f"count(*) FILTER (tool = '{t}') AS {t}" for t in TOOLS)}, count(*) AS total FROM flows GROUP BY 1""")
def p6_label_matrix(spark, sf_dir):
    return Q.label_matrix(B.flows(spark, sf_dir), "day", "tool", TOOLS)


@query("p7_share", f"""WITH {B.FLOWS_SQL} SELECT day, count(*) FILTER (family = 'BENIGN') AS n_benign, count(*) FILTER (family = 'DoS') AS n_dos,
 count(*) FILTER (family = 'Botnet') AS n_botnet, count(*) AS total, round(avg(CASE WHEN family = 'DoS' THEN 1e0 ELSE 0e0 END), 6) AS positive_share FROM flows GROUP BY 1""")
def p7_share(spark, sf_dir):
    return r6(Q.class_share(B.flows(spark, sf_dir), "day", "family", "DoS", ["BENIGN", "DoS", "Botnet"]))


@query("v1_validate", f"""WITH {B.SCORED_SQL}, x AS (SELECT event_id, CASE WHEN user_id % 11 = 0 THEN 70000 ELSE src_port END AS src_port,
 CASE WHEN tool = 'error' THEN p_attack * 1.5e0 ELSE p_attack END AS p_attack, CASE WHEN user_id % 13 = 0 THEN 'Odd' ELSE family END AS family,
 CASE WHEN user_id % 17 = 0 THEN NULL ELSE src_ip END AS src_ip FROM scored),
 y AS (SELECT event_id, concat_ws(',', CASE WHEN src_ip IS NULL THEN 'src_ip' END, CASE WHEN src_port > 65535 THEN 'src_port' END,
 CASE WHEN p_attack > 1 THEN 'p_attack' END, CASE WHEN family = 'Odd' THEN 'family' END) AS reasons FROM x)
 SELECT event_id, reasons FROM y""")
def v1_validate(spark, sf_dir):
    u = F.col("user_id")
    df = B.scored(spark, sf_dir).withColumns({
        "src_port": F.when(u % 11 == 0, 70000).otherwise(F.col("src_port")),
        "p_attack": F.when(F.col("tool") == "error", F.col("p_attack") * 1.5).otherwise(F.col("p_attack")),
        "family": F.when(u % 13 == 0, "Odd").otherwise(F.col("family")),
        "src_ip": F.when(u % 17 != 0, F.col("src_ip"))})
    good, bad = Q.validate_flows(df)
    return good.select("event_id", F.lit("").alias("reasons")).unionByName(
        bad.select("event_id", F.array_join("reasons", ",").alias("reasons")))


@query("v2_missing", """SELECT event_id, CASE event_type WHEN 'view' THEN 'a,z' WHEN 'click' THEN 'a,k,z' ELSE 'z' END AS missing FROM events""")
def v2_missing(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("double")
    kind = F.col("event_type")
    full = F.create_map(F.lit("a"), F.col("value"), F.lit("k"), k, F.lit("extra"), F.lit(1.0))
    m = (F.when(kind == "view", F.create_map(F.lit("k"), k))
         .when(kind == "click", F.lit(None).cast("map<string,double>")).otherwise(full))
    df = B.table(spark, sf_dir, "events").select("event_id", m.alias("features"))
    return Q.missing_features(df, "features", ["a", "k", "z"]).select("event_id", F.array_join("missing", ",").alias("missing"))


@query("v3_spec_check", """WITH s AS (SELECT event_type AS name, min(value) AS lo, max(value) AS hi, quantile_cont(value, 0.5) AS m, count(*) AS n FROM events GROUP BY 1)
 SELECT name, concat_ws(',', CASE WHEN name = 'view' THEN 'clip' END, CASE WHEN name = 'click' THEN 'quantiles' END, CASE WHEN name = 'signup' THEN 'log1p' END,
 CASE WHEN n <= 100000 THEN 'few_benign' END, CASE WHEN name = 'error' THEN 'kept_and_dropped' END) AS broken FROM s""")
def v3_spec_check(spark, sf_dir):
    from flowlens.plans.recipes import quantiles

    e = B.table(spark, sf_dir, "events")
    q = quantiles(e, ["value"], {"lo": 0.0, "p05": 0.05, "m": 0.5, "p95": 0.95, "hi": 1.0}, keys=["event_type"])
    name = F.col("event_type")
    spec = q.select(
        F.lit(0).alias("pos"), name.alias("name"),
        F.when(name == "view", F.col("hi")).when(name == "signup", -F.col("lo") - 1).otherwise(F.col("lo")).alias("clip_lo"),
        F.when(name == "view", F.col("lo")).otherwise(F.col("hi")).alias("clip_hi"), (name == "signup").alias("log1p"))
    base = q.select(
        F.lit(0).alias("pos"), name.alias("feature"), "n", "p05",
        F.when(name == "click", F.col("hi") + 1).otherwise(F.col("m")).alias("median"), "p95")
    gone = spec.where(F.col("name") == "error").select("name")
    return Q.check_spec_consistency(spec, base, gone).select("name", F.array_join("broken", ",").alias("broken"))

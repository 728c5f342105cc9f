"""Queries over feature statistics, specs and the transformer."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.catalog.registry import query, r6
from flowlens.operators import features as FE
from flowlens.plans import bindings as B

LONG_SQL = " UNION ALL ".join(f"SELECT class, l_orderkey, l_linenumber, '{c}' AS feature, {c} AS v FROM measures" for c in B.MEASURES)


@query("e1_column_stats", f"""WITH {B.MEASURES_SQL}, long AS ({LONG_SQL}), top AS (SELECT feature, max(c) AS c, count(*) AS u FROM (SELECT feature, v, count(*) AS c FROM long GROUP BY 1, 2) GROUP BY 1)
 SELECT feature, count(*) AS n, 0e0 AS nan_rate, max(u) AS n_unique, min(v) AS min, max(v) AS max, round(quantile_cont(v, 0.5), 6) AS median,
 round(quantile_cont(v, 0.0001), 6) AS q_lo, round(quantile_cont(v, 0.9999), 6) AS q_hi, round(skewness(v), 6) AS skew, round(cast(max(c) AS double) / count(*), 6) AS top_share
 FROM long JOIN top USING (feature) GROUP BY 1""")
def e1_column_stats(spark, sf_dir):
    return r6(FE.column_stats(B.measures(spark, sf_dir), B.MEASURES))


@query("e2_group_clip", f"""WITH {B.MEASURES_SQL}, long AS ({LONG_SQL}), g AS (SELECT class, feature, quantile_cont(v, 0.0001) AS lo, quantile_cont(v, 0.9999) AS hi FROM long GROUP BY 1, 2)
 SELECT feature, round(min(lo), 6) AS clip_lo, round(max(hi), 6) AS clip_hi FROM g GROUP BY 1""")
def e2_group_clip(spark, sf_dir):
    return r6(FE.group_clip_bounds(B.measures(spark, sf_dir), B.MEASURES, "class"))


def related(spark, sf_dir):
    """Line-item measures plus a copy of the quantity and the tax-laden price."""
    return B.measures(spark, sf_dir).withColumns({
        "copy": 2 * F.col("l_quantity") + 1, "gross": F.col("l_extendedprice") * (1 + F.col("l_tax"))})


RELATED = [*B.MEASURES, "copy", "gross"]
RANKED_SQL = f"""WITH {B.MEASURES_SQL}, wide AS (SELECT *, 2 * l_quantity + 1 AS copy, l_extendedprice * (1 + l_tax) AS gross FROM measures),
 ranks AS (SELECT {", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2e0 AS r{i}" for i, c in enumerate(RELATED))} FROM wide),
 pairs AS ({" UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, '{a}' AS feature_a, '{b}' AS feature_b, abs(corr(r{i}, r{j})) AS rho FROM ranks" for i, a in enumerate(RELATED) for j, b in enumerate(RELATED))})"""


@query("e3_spearman", RANKED_SQL + " SELECT feature_a, feature_b, round(rho, 6) AS rho FROM pairs")
def e3_spearman(spark, sf_dir):
    return r6(FE.spearman_matrix(related(spark, sf_dir), RELATED).select("feature_a", "feature_b", "rho"))


@query("e4_prune", RANKED_SQL + """ SELECT feature_b AS name, rho IS NULL AS kept, feature_a AS partner, round(rho, 6) AS rho FROM (
 SELECT f.feature_b, p.feature_a, p.rho FROM (SELECT DISTINCT feature_b FROM pairs) f LEFT JOIN (
 SELECT * FROM pairs WHERE i < j AND rho > 0.95 AND feature_a IN ('l_quantity', 'l_extendedprice')) p ON p.feature_b = f.feature_b)""")
def e4_prune(spark, sf_dir):
    rho = FE.spearman_matrix(related(spark, sf_dir), RELATED)
    return r6(FE.prune_correlated(rho, RELATED), "rho")


@query("e5_pairs", RANKED_SQL + " SELECT feature_a, feature_b, round(rho, 6) AS rho FROM pairs WHERE i < j AND rho > 0.8")
def e5_pairs(spark, sf_dir):
    return r6(FE.corr_pairs(FE.spearman_matrix(related(spark, sf_dir), RELATED)))


@query("e6_spec", f"""WITH {B.MEASURES_SQL}, wide AS (SELECT *, power(l_quantity / 10e0, 9) AS heavy FROM measures),
 long AS ({" UNION ALL ".join(f"SELECT class, '{c}' AS name, {c} AS v, {i} AS o FROM wide" for i, c in enumerate(["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))}),
 g AS (SELECT class, name, quantile_cont(v, 0.0001) AS lo, quantile_cont(v, 0.9999) AS hi FROM long GROUP BY 1, 2),
 b AS (SELECT name, min(lo) AS clip_lo, max(hi) AS clip_hi FROM g GROUP BY 1), m AS (SELECT name, max(o) AS pos, quantile_cont(v, 0.5) AS med, skewness(v) AS sk FROM long GROUP BY 1)
 SELECT cast(pos AS integer) AS pos, name, round(clip_lo, 6) AS clip_lo, round(clip_hi, 6) AS clip_hi, clip_lo >= 0 AND sk > 5 AS log1p, round(med, 6) AS train_median FROM b JOIN m USING (name)""")
def e6_spec(spark, sf_dir):
    df = related(spark, sf_dir).withColumns({"fixed": F.lit(3.0)})
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "fixed", "copy", "gross"]
    return r6(FE.build_feature_spec(df, cols, "class").features)


def spec(spark):
    return spark.createDataFrame([
        (0, "l_quantity", 2.0, 45.0, False, 25.0), (1, "l_extendedprice", 1000.0, 50000.0, True, 20000.0),
        (2, "l_discount", 0.0, 0.09, False, 0.05), (3, "l_tax", 0.01, 0.07, True, 0.04),
    ], FE.SPEC_COLUMNS)


def with_gaps(spark, sf_dir):
    """Line items whose discount is infinite for returned rows and whose tax is missing for open ones."""
    flag = F.col("class")
    return B.measures(spark, sf_dir).withColumns({
        "l_discount": F.when(flag == "R", F.lit(float("inf"))).otherwise(F.col("l_discount")),
        "l_tax": F.when(flag != "N", F.col("l_tax"))})


CLIP_SQL = f"""WITH {B.MEASURES_SQL}, c AS (SELECT l_orderkey, l_linenumber, greatest(2e0, least(45e0, l_quantity)) AS q, greatest(1000e0, least(50000e0, l_extendedprice)) AS p,
 CASE WHEN class <> 'R' THEN greatest(0e0, least(0.09e0, l_discount)) END AS d, CASE WHEN class <> 'N' THEN greatest(0.01e0, least(0.07e0, l_tax)) END AS t FROM measures),
 m AS (SELECT quantile_cont(q, 0.5) AS mq, quantile_cont(p, 0.5) AS mp, quantile_cont(d, 0.5) AS md, quantile_cont(t, 0.5) AS mt FROM c),
 z AS (SELECT l_orderkey, l_linenumber, coalesce(q, mq) AS q, ln(1 + coalesce(p, mp)) AS p, coalesce(d, md) AS d, ln(1 + coalesce(t, mt)) AS t FROM c, m)"""


@query("e7_fit", CLIP_SQL + " " + " UNION ALL ".join(
    f"SELECT {i} AS pos, '{n}' AS name, round((SELECT {m} FROM m), 8) AS median, round(avg({c}), 8) AS mean, round(stddev_pop({c}), 8) AS std FROM z"
    for i, (n, c, m) in enumerate([("l_quantity", "q", "mq"), ("l_extendedprice", "p", "mp"), ("l_discount", "d", "md"), ("l_tax", "t", "mt")])))
def e7_fit(spark, sf_dir):
    fitted = FE.fit_transformer(with_gaps(spark, sf_dir), spec(spark)).select("pos", "name", "median", "mean", "std")
    return fitted.withColumns({c: F.round(c, 8) for c in ("median", "mean", "std")})


@query("e8_transform", CLIP_SQL + """, s AS (SELECT avg(q) AS aq, stddev_pop(q) AS sq, avg(p) AS ap, stddev_pop(p) AS sp, avg(d) AS ad, stddev_pop(d) AS sd, avg(t) AS avt, stddev_pop(t) AS st FROM z)
 SELECT l_orderkey, l_linenumber, round(cast(cast((q - aq) / sq AS float) AS double), 4) AS l_quantity, round(cast(cast((p - ap) / sp AS float) AS double), 4) AS l_extendedprice,
 round(cast(cast((d - ad) / sd AS float) AS double), 4) AS l_discount, round(cast(cast((t - avt) / st AS float) AS double), 4) AS l_tax FROM z, s""")
def e8_transform(spark, sf_dir):
    df = with_gaps(spark, sf_dir)
    out = FE.transform(df, FE.fit_transformer(df, spec(spark)), ["l_orderkey", "l_linenumber"], scaled=True)
    return out.withColumns({c: F.round(F.col(c).cast("double"), 4) for c in B.MEASURES})


@query("e9_variant", f"""WITH {B.MEASURES_SQL} SELECT l_orderkey, l_linenumber, round(cast(cast(greatest(2e0, least(45e0, l_quantity)) AS float) AS double), 4) AS l_quantity,
 round(cast(cast(ln(1 + greatest(0.01e0, least(0.07e0, l_tax))) AS float) AS double), 4) AS l_tax, cast(l_orderkey % 60000 AS double) AS dst_port FROM measures""")
def e9_variant(spark, sf_dir):
    df = B.measures(spark, sf_dir).withColumn("dst_port", F.col("l_orderkey") % 60000)
    v = FE.variant_spec(spec(spark), ["l_extendedprice", "l_discount"], ["dst_port"])
    out = FE.transform(df, FE.fit_transformer(df, v), ["l_orderkey", "l_linenumber"])
    return out.withColumns({c: F.round(F.col(c).cast("double"), 4) for c in ("l_quantity", "l_tax", "dst_port")})


BASE_SQL = f"""WITH {B.MEASURES_SQL}, long AS ({LONG_SQL}), base AS (SELECT feature, count(*) AS n, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.05) AS p05,
 quantile_cont(v, 0.95) AS p95, avg(v) AS mean, stddev_pop(v) AS std, avg(CASE WHEN v = 0 THEN 1e0 ELSE 0e0 END) AS zero_share FROM long WHERE class = 'N' GROUP BY 1)"""


@query("e10_baseline", BASE_SQL + " SELECT feature, n, round(median, 6) AS median, round(p05, 6) AS p05, round(p95, 6) AS p95, round(mean, 6) AS mean, round(std, 6) AS std, round(zero_share, 6) AS zero_share FROM base")
def e10_baseline(spark, sf_dir):
    benign = B.measures(spark, sf_dir).where(F.col("class") == "N")
    return r6(FE.baseline_stats(benign, B.MEASURES).drop("pos"))


G4_SQL = """CASE WHEN {x} = 0 THEN '0' WHEN abs({x}) >= 999.5e0 AND abs({x}) < 9999.5e0 THEN substr(printf('%.0f', {x}), 1, 1) || ',' || substr(printf('%.0f', {x}), 2) ELSE printf('%.4g', {x}) END"""


@query("e11_vs_normal", f"""WITH n AS (SELECT event_type AS kind, event_id, value FROM events), b AS (SELECT kind, CASE WHEN kind IN ('view', 'click') THEN 0e0 ELSE quantile_cont(value, 0.5) END AS median,
 quantile_cont(value, 0.95) AS p95 FROM n GROUP BY 1), r AS (SELECT *, CASE WHEN abs(median) >= 1e-9 THEN value / median END AS ratio FROM n JOIN b USING (kind))
 SELECT event_id, round(ratio, 6) AS ratio, CASE WHEN ratio IS NULL AND value > p95 THEN kind || ' is ' || {G4_SQL.format(x='value')} || ', above the benign 95th percentile (' || {G4_SQL.format(x='p95')} || ')'
 WHEN ratio IS NULL THEN kind || ' is ' || {G4_SQL.format(x='value')} || ' (benign traffic is usually 0)'
 WHEN ratio >= 2 THEN kind || ' is ' || CASE WHEN ratio >= 10 THEN format('{{:,}}', cast(round_even(ratio, 0) AS bigint)) ELSE printf('%.1f', ratio) END || 'x the benign median'
 WHEN ratio > 0 AND ratio <= 0.5 THEN kind || ' is ' || CASE WHEN 1 / ratio >= 10 THEN format('{{:,}}', cast(round_even(1 / ratio, 0) AS bigint)) ELSE printf('%.1f', 1 / ratio) END || 'x below the benign median'
 ELSE kind || ' is close to the benign median' END AS text FROM r""")
def e11_vs_normal(spark, sf_dir):
    from flowlens.plans.recipes import quantiles

    e = B.table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("kind"), "value")
    base = quantiles(e, ["value"], {"median": 0.5, "p95": 0.95}, keys=["kind"]).select(
        F.col("kind").alias("feature"),
        F.when(F.col("kind").isin("view", "click"), 0.0).otherwise(F.col("median")).alias("median"), "p95")
    out = FE.describe_vs_normal(e.withColumnRenamed("kind", "feature"), base)
    return r6(out.select("event_id", "ratio", "text"))

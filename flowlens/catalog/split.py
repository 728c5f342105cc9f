"""Queries over splits, samples and slices."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.catalog.registry import ntz, query, r6
from flowlens.operators import split as S
from flowlens.plans import bindings as B
from flowlens.session import fresh_path

GROUP = ["tool", "dst_ip"]


def _split_sql(group: str, source: str, name: str) -> str:
    """CTEs giving ``split`` per row of ``source`` by order statistics of time within ``group``."""
    on = " AND ".join(f"a.{g.strip()} = b.{g.strip()}" for g in group.split(","))
    return f"""{name}_r AS (SELECT {group}, epoch_us(observed_at) AS us, row_number() OVER (PARTITION BY {group} ORDER BY observed_at) - 1 AS rk,
 count(*) OVER (PARTITION BY {group}) AS n FROM {source}),
 {name}_b AS (SELECT {group}, max(us) FILTER (rk = least(cast(floor(n * 0.70e0) AS bigint), n - 1)) AS t1, max(us) FILTER (rk = least(cast(floor(n * 0.85e0) AS bigint), n - 1)) AS t2,
 cast(floor(least(60e6, 0.02e0 * (max(us) - min(us)))) AS bigint) AS p FROM {name}_r GROUP BY {group}),
 {name} AS (SELECT a.*, CASE WHEN epoch_us(observed_at) < t1 - p THEN 'train' WHEN epoch_us(observed_at) >= t1 + p AND epoch_us(observed_at) < t2 - p THEN 'val'
 WHEN epoch_us(observed_at) >= t2 + p THEN 'test' ELSE 'purged' END AS split FROM {source} a JOIN {name}_b b ON {on})"""


D1_SQL = f"WITH {B.FLOWS_SQL}, {_split_sql('tool, dst_ip', 'flows', 'parts')}"


def split_flows(spark, sf_dir):
    return S.time_block_split(B.flows(spark, sf_dir), GROUP, "observed_at")


@query("d1_time_split", D1_SQL + " SELECT event_id, split FROM parts")
def d1_time_split(spark, sf_dir):
    return split_flows(spark, sf_dir).select("event_id", "split")


DRIFT_SQL = f"""WITH {B.FLOWS_SQL}, weekly AS (SELECT *, strftime(observed_at, '%G-%V') AS period FROM flows),
 early AS (SELECT * FROM weekly WHERE period IN (SELECT min(period) FROM weekly)), {_split_sql('period, tool', 'early', 'first_part')},
 later AS (SELECT * FROM weekly WHERE period NOT IN (SELECT min(period) FROM weekly)),
 cuts AS (SELECT period, min(epoch_us(observed_at)) + cast(floor(0.2e0 * (max(epoch_us(observed_at)) - min(epoch_us(observed_at)))) AS bigint) AS b FROM later GROUP BY 1),
 second_part AS (SELECT a.*, CASE WHEN epoch_us(observed_at) >= b + 60000000 THEN 'test' WHEN family = 'BENIGN' AND epoch_us(observed_at) < b - 60000000 THEN 'recal' ELSE 'purged' END AS split
 FROM later a JOIN cuts USING (period)) SELECT event_id, period, split FROM first_part UNION ALL SELECT event_id, period, split FROM second_part"""


def iso_week(ts):
    """ISO year-week text of a timestamp."""
    return F.format_string("%04d-%02d", F.extract(F.lit("YEAROFWEEK"), ts).cast("int"), F.weekofyear(ts))


def weekly_flows(spark, sf_dir):
    return B.flows(spark, sf_dir).withColumn("period", iso_week(F.col("observed_at")))


@query("d2_drift_split", DRIFT_SQL)
def d2_drift_split(spark, sf_dir):
    f = weekly_flows(spark, sf_dir)
    early = [f.agg(F.min("period")).head()[0]]
    return S.drift_split(f, early, "period", ["tool"], "observed_at", "family").select("event_id", "period", "split")


CAPS = {"train_attack_cap": 120, "train_benign": 500, "eval_benign": 90}


def sampled(spark, sf_dir):
    f = split_flows(spark, sf_dir).withColumn("unit", F.when(F.col("family") == "BENIGN", "BENIGN").otherwise(F.col("tool")))
    return f, S.working_sample(f, ["event_id"], "unit", **CAPS)


@query("d3_sample", D1_SQL + """, u AS (SELECT *, CASE WHEN family = 'BENIGN' THEN 'BENIGN' ELSE tool END AS unit FROM parts WHERE split <> 'purged')
 SELECT split, unit, CASE WHEN split = 'train' AND unit = 'BENIGN' THEN least(count(*), 500) WHEN split = 'train' THEN least(count(*), 120)
 WHEN unit = 'BENIGN' THEN least(count(*), 90) ELSE count(*) END AS n, cast(0 AS bigint) AS repeated FROM u GROUP BY 1, 2""")
def d3_sample(spark, sf_dir):
    _, s = sampled(spark, sf_dir)
    return s.groupBy("split", "unit").agg(
        F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - F.count_distinct("event_id")).alias("repeated"))


@query("d4_bernoulli", "SELECT event_type AS tool, count(*) AS n, true AS within_five_sigma FROM events GROUP BY 1")
def d4_bernoulli(spark, sf_dir):
    f = B.flows(spark, sf_dir)
    cap = 600
    kept = S.bernoulli_stratified(f, "tool", cap, ["event_id"]).groupBy("tool").agg(F.count(F.lit(1)).alias("k"))
    n = f.groupBy("tool").agg(F.count(F.lit(1)).alias("n"))
    p = F.least(F.lit(1.0), F.lit(float(cap)) / F.col("n"))
    off = F.abs(F.col("k") - F.col("n") * p)
    return n.join(kept, "tool").select("tool", "n", (off <= 5 * F.sqrt(F.col("n") * p * (1 - p))).alias("within_five_sigma"))


@query("d5_holdout_mask", D1_SQL + " SELECT event_id, split, tool FROM parts WHERE split = 'test' OR tool <> 'signup'")
def d5_holdout_mask(spark, sf_dir):
    return S.exclude_unit(split_flows(spark, sf_dir), "tool", "signup").select("event_id", "split", "tool")


@query("d6_manifest", D1_SQL + f""" SELECT coalesce(tool, '(all)') AS tool, {", ".join(f"count(*) FILTER (split = '{s}') AS {s}" for s in S.SPLITS)}, count(*) AS total
 FROM parts GROUP BY ROLLUP (tool)""")
def d6_manifest(spark, sf_dir):
    return S.split_manifest(split_flows(spark, sf_dir), "tool")


@query("d7_weights", """WITH full_count AS (SELECT c_nationkey, count(*) AS f FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1),
 s AS (SELECT o_orderkey, c_nationkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus = 'F'),
 n AS (SELECT c_nationkey, count(*) AS k FROM s GROUP BY 1)
 SELECT o_orderkey, n_name, round(cast(f AS double) / k, 6) AS weight FROM s JOIN n USING (c_nationkey) JOIN full_count USING (c_nationkey) JOIN nation ON n_nationkey = c_nationkey""")
def d7_weights(spark, sf_dir):

    c = B.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    full = B.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").join(c, "o_custkey")
    names = B.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    w = S.sampling_weights(full.where(F.col("o_orderstatus") == "F"), full, ["c_nationkey"])
    return r6(w.join(names, "c_nationkey").select("o_orderkey", "n_name", "weight"))


@query("d8_working_set", D1_SQL + """ SELECT split, event_id, round(f_value, 6) AS f_value FROM parts WHERE split <> 'purged' AND (split <> 'train' OR family <> 'BENIGN' OR f_value < 40)""")
def d8_working_set(spark, sf_dir):
    f = split_flows(spark, sf_dir)
    index = f.select("event_id", "split", 
                     ((F.col("split") != "purged") & ((F.col("split") != "train") | (F.col("family") != "BENIGN")
                                                      | (F.col("f_value") < 40))).alias("in_sample"))
    got = S.materialise_working_set(B.flows(spark, sf_dir), index, ["event_id"], fresh_path(spark, "working_set"))
    return r6(got.select("split", "event_id", "f_value"))


@query("d9_middle_slice", """WITH r AS (SELECT event_id, ts, row_number() OVER (ORDER BY ts, event_id) - 1 AS k, count(*) OVER () AS n FROM events)
 SELECT event_id, ts FROM r WHERE k >= greatest((n - 1000) // 2, 0) AND k < greatest((n - 1000) // 2, 0) + 1000""")
def d9_middle_slice(spark, sf_dir):
    return ntz(S.middle_slice(B.table(spark, sf_dir, "events").select("event_id", "ts"), ["ts", "event_id"], 1000))


@query("d10_random_slice")
def d10_random_slice(spark, sf_dir):
    return ntz(S.random_slice(B.table(spark, sf_dir, "events").select("event_id", "ts"), ["event_id"], 500, ["ts", "event_id"]))


@query("d11_even_spaced", """WITH r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events),
 w AS (SELECT DISTINCT event_type, cast(round_even(i * (cast(n - 1 AS double) / 99e0), 0) AS bigint) AS k FROM (SELECT DISTINCT event_type, n FROM r), range(100) t(i))
 SELECT event_type, event_id FROM r JOIN w USING (event_type, k)""")
def d11_even_spaced(spark, sf_dir):
    e = B.table(spark, sf_dir, "events").select("event_type", "event_id", "ts")
    return S.evenly_spaced(e, ["event_type"], ["ts", "event_id"], 100).select("event_type", "event_id")


@query("d12_slice_manifest", f"""WITH {B.FLOWS_SQL}, c AS (SELECT tool, count(*) AS n FROM flows GROUP BY 1)
 SELECT count(*) AS rows, count(*) AS available, count(*) FILTER (tool = 'error') AS nonfinite_replaced,
 round((max(epoch_us(observed_at)) - min(epoch_us(observed_at))) / 1e6, 1) AS span_s, min(observed_at) AS first_ts,
 (SELECT string_agg(tool || '=' || n, ',' ORDER BY tool) FROM c) AS labels FROM flows""")
def d12_slice_manifest(spark, sf_dir):
    f = B.flows(spark, sf_dir).withColumn("f_value", F.when(F.col("tool") == "error", F.lit(float("nan"))).otherwise(F.col("f_value")))
    m = S.slice_manifest(f, ["f_value"], "observed_at", "tool")
    pairs = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return ntz(m.withColumn("labels", F.array_join(pairs, ",")))


@query("d13_batches", """SELECT event_id, cast(floor((row_number() OVER (ORDER BY ts, event_id) - 1) / 250e0) AS bigint) AS batch FROM events""")
def d13_batches(spark, sf_dir):
    return S.micro_batches(B.table(spark, sf_dir, "events").select("event_id", "ts"), ["ts", "event_id"], 250).select("event_id", "batch")

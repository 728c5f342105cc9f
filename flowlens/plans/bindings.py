"""The given test tables seen as flows, actions and features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions import detection as D

TAU_BINARY, TAU_ANOMALY, TAU_FAMILY = 0.5, 99.0, 0.3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; timestamps without zone become UTC instants."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    zoneless = [c for c, t in df.dtypes if t == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as network flows."""
    e, user, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    port = (
        F.when(kind == "view", 443).when(kind == "click", 80).when(kind == "signup", 22)
        .when(kind == "purchase", 8080).otherwise(21))
    family = (
        F.when(kind.isin("view", "click"), "BENIGN").when(kind == "signup", "DoS")
        .when(kind == "error", "BruteForce").otherwise("Botnet"))
    # a port that tells the family four times out of five
    noisy = F.when((e * 7919) % 10 < 8, port).otherwise(F.element_at(F.array(*[F.lit(p) for p in (443, 80, 22, 8080, 21)]), (e % 5 + 1).cast("int")))
    k = F.get_json_object("props", "$.k").cast("double")
    return table(spark, sf_dir, "events").select(
        e.cast("string").alias("flow_id"), "event_id", F.col("ts").alias("observed_at"), "user_id",
        F.concat(F.lit("10.0.0."), (user % 8).cast("string")).alias("src_ip"),
        F.concat(F.lit("172.31.0."), (e % 2).cast("string")).alias("dst_ip"),
        (F.lit(1024) + (e * 7919) % 60000).cast("int").alias("src_port"), port.cast("int").alias("dst_port"), noisy.cast("int").alias("f_port"),
        F.when(e % 3 == 0, 17).otherwise(6).cast("int").alias("protocol"),
        kind.alias("tool"), family.alias("family"), family.alias("ground_truth"),
        F.col("value").alias("f_value"), k.alias("f_k"), "props",
        F.round(F.col("value") / (F.col("value") + 50.0), 6).alias("p_attack"),
        F.round(k / 100.0, 4).alias("fconf"), ((e % 1000) / F.lit(10.0)).alias("anomaly_pct"),
        F.floor(e / F.lit(250.0)).alias("batch"), F.to_date("ts").alias("day"),
        F.lit("1.0.0").alias("model_version"),
        F.when(kind == "view", 10.0).when(kind == "click", 4.0).otherwise(1.0).alias("w"),
    )


FLOWS_SQL = """flows AS (SELECT cast(event_id AS varchar) AS flow_id, event_id, ts AS observed_at, user_id,
 '10.0.0.' || cast(user_id % 8 AS varchar) AS src_ip, '172.31.0.' || cast(event_id % 2 AS varchar) AS dst_ip,
 cast(1024 + (event_id * 7919) % 60000 AS integer) AS src_port,
 cast(CASE event_type WHEN 'view' THEN 443 WHEN 'click' THEN 80 WHEN 'signup' THEN 22 WHEN 'purchase' THEN 8080 ELSE 21 END AS integer) AS dst_port,
 cast(CASE WHEN event_id % 3 = 0 THEN 17 ELSE 6 END AS integer) AS protocol, event_type AS tool,
 CASE WHEN event_type IN ('view','click') THEN 'BENIGN' WHEN event_type = 'signup' THEN 'DoS' WHEN event_type = 'error' THEN 'BruteForce' ELSE 'Botnet' END AS family,
 CASE WHEN event_type IN ('view','click') THEN 'BENIGN' WHEN event_type = 'signup' THEN 'DoS' WHEN event_type = 'error' THEN 'BruteForce' ELSE 'Botnet' END AS ground_truth,
 value AS f_value, cast(json_extract_string(props, '$.k') AS double) AS f_k, props,
 round(value / (value + 50e0), 6) AS p_attack,
 round(cast(json_extract_string(props, '$.k') AS double) / 100e0, 4) AS fconf, (event_id % 1000) / 10e0 AS anomaly_pct,
 cast(floor(event_id / 250e0) AS bigint) AS batch, cast(ts AS date) AS day, '1.0.0' AS model_version,
 CASE event_type WHEN 'view' THEN 10e0 WHEN 'click' THEN 4e0 ELSE 1e0 END AS w
 FROM events)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows with verdict, confidence, family and severity, as the scoring path would store them."""
    f = flows(spark, sf_dir)
    f = f.withColumn("verdict", D.verdict(
        F.col("p_attack"), F.col("anomaly_pct"), TAU_BINARY, TAU_ANOMALY, F.col("fconf"), TAU_FAMILY))
    closest = F.when(F.col("family") != "BENIGN", F.col("family"))
    f = f.withColumn("confidence", D.confidence(
        F.col("verdict"), F.col("p_attack"), F.col("anomaly_pct"), TAU_BINARY, TAU_ANOMALY))
    f = f.withColumn("attack_family", D.reported_family(F.col("verdict"), closest))
    return f.withColumn("severity", D.severity_of(F.col("attack_family")))


SCORED_SQL = FLOWS_SQL + """, voted AS (SELECT *, CASE WHEN p_attack >= 0.5e0 AND fconf < 0.3e0 THEN 'novel_anomaly'
 WHEN p_attack >= 0.5e0 THEN 'known_attack' WHEN anomaly_pct >= 99e0 THEN 'novel_anomaly' ELSE 'benign' END AS verdict FROM flows),
 named AS (SELECT *, CASE WHEN verdict = 'known_attack' THEN p_attack
 WHEN verdict = 'novel_anomaly' THEN CASE WHEN p_attack >= 0.5e0 THEN p_attack ELSE 0.5e0 + 0.5e0 * (anomaly_pct - 99e0) / 1e0 END ELSE 0e0 END AS confidence,
 CASE WHEN verdict = 'known_attack' THEN CASE WHEN family = 'BENIGN' THEN 'Malicious' ELSE family END
 WHEN verdict = 'novel_anomaly' THEN 'Unknown' ELSE 'BENIGN' END AS attack_family FROM voted),
 scored AS (SELECT *, CASE attack_family WHEN 'Unknown' THEN 0.75e0 WHEN 'DoS' THEN 0.8e0 WHEN 'BruteForce' THEN 0.7e0
 WHEN 'Malicious' THEN 0.7e0 WHEN 'Botnet' THEN 0.9e0 ELSE 0e0 END AS severity FROM named)"""


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as an analyst action log."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("action_id"), F.col("user_id").cast("string").alias("incident_id"),
        F.concat(F.lit("analyst"), (F.col("event_id") % 7).cast("string")).alias("analyst"),
        F.when(kind == "view", "note").when(kind == "click", "acknowledge").when(kind == "signup", "confirm")
        .when(kind == "error", "escalate").otherwise("resolve").alias("action"),
        F.col("ts").alias("at"),
    )


ACTIONS_SQL = """actions AS (SELECT event_id AS action_id, cast(user_id AS varchar) AS incident_id,
 'analyst' || cast(event_id % 7 AS varchar) AS analyst,
 CASE event_type WHEN 'view' THEN 'note' WHEN 'click' THEN 'acknowledge' WHEN 'signup' THEN 'confirm' WHEN 'error' THEN 'escalate' ELSE 'resolve' END AS action,
 ts AS "at" FROM events)"""

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as a wide numeric feature table with a class and a period."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", *MEASURES, F.col("l_returnflag").alias("class"),
        F.date_format("l_shipdate", "yyyy").alias("period"))


MEASURES_SQL = """measures AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
 l_returnflag AS class, strftime(l_shipdate, '%Y') AS period FROM lineitem)"""

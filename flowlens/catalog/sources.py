"""Queries over readers and stores. Files are written from the given tables first."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens import constants as K
from flowlens.catalog.registry import ntz, query, r6
from flowlens.functions.exprs import finite
from flowlens.plans import bindings as B
from flowlens.session import fresh_path
from flowlens.sources import readers as R
from flowlens.sources import stores as S


def raw_flow_files(spark, sf_dir):
    """Write the flows as raw 91-column CSV and return the path."""
    f = B.flows(spark, sf_dir)
    given = {
        "id": F.col("flow_id"), "Flow ID": F.concat(F.lit("f"), F.col("flow_id")),
        "Src IP": F.col("src_ip"), "Src Port": F.col("src_port"), "Dst IP": F.col("dst_ip"), "Dst Port": F.col("dst_port"),
        "Protocol": F.col("protocol"), "Timestamp": F.date_format("observed_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"),
        "Label": F.when(F.col("family") == "BENIGN", "BENIGN").when(F.col("family") == "DoS", "DoS Hulk")
        .when(F.col("family") == "BruteForce", "SSH-BruteForce - Attempted").otherwise("Botnet Ares"),
        "Attempted Category": F.when(F.col("family") == "BruteForce", 2).otherwise(-1),
        "Flow Bytes/s": F.when(F.col("tool") == "purchase", "Infinity").otherwise(F.col("f_value").cast("string")),
    }
    cols = [given.get(c, F.col("f_value") + i).alias(c) for i, c in enumerate(K.FLOW_CSV_COLUMNS)]
    path = fresh_path(spark, "raw_flows")
    f.select(*cols).write.option("header", True).csv(path)
    return path


@query("s1_read_csv", f"""WITH {B.FLOWS_SQL} SELECT src_ip, src_port, dst_port, observed_at AS ts,
 round(f_value + 8, 6) AS flow_duration, round(f_value + 88, 6) AS total_tcp_flow_time, tool = 'purchase' AS rate_is_inf,
 CASE family WHEN 'BENIGN' THEN 'BENIGN' WHEN 'DoS' THEN 'DoS Hulk' WHEN 'BruteForce' THEN 'SSH-BruteForce - Attempted' ELSE 'Botnet Ares' END AS label,
 cast(CASE family WHEN 'BruteForce' THEN 2 ELSE -1 END AS integer) AS attempted_category FROM flows""")
def s1_read_csv(spark, sf_dir):
    df = R.read_flow_csv(spark, raw_flow_files(spark, sf_dir))
    out = df.select(
        "src_ip", "src_port", "dst_port", "ts", "flow_duration", "total_tcp_flow_time",
        finite(F.col("flow_bytes_per_s")).isNull().alias("rate_is_inf"), "label", "attempted_category")
    return ntz(r6(out))


def honeypot_files(spark, sf_dir):
    f = B.flows(spark, sf_dir)
    us = F.unix_micros("observed_at")
    glued = F.concat(F.floor(us / 1_000_000).cast("string"), (us % 1_000_000).cast("string")).cast("bigint")
    cols = {
        "avg_ipt": F.col("f_value"), "bytes_in": F.col("user_id"), "bytes_out": F.col("event_id"),
        "dest_ip": F.col("event_id") % 2, "dest_port": F.when(F.col("protocol") == 6, F.col("dst_port").cast("double")),
        "entropy": F.col("fconf"), "num_pkts_out": F.col("event_id") % 11, "num_pkts_in": F.col("event_id") % 13,
        "proto": F.col("protocol").cast("bigint"), "src_ip": F.col("user_id"), "src_port": F.col("src_port").cast("double"),
        "time_end": glued, "time_start": glued, "total_entropy": F.col("f_value") * 2,
        "label": F.when(F.col("family") == "BENIGN", "benign").when(F.col("family") == "Botnet", "outlier").otherwise("malicious"),
        "duration": F.col("p_attack"),
    }
    path = fresh_path(spark, "honeypot")
    f.select(*[c.alias(n) for n, c in cols.items()], F.date_format("observed_at", "yyyy.MM.dd").alias("file_day")) \
        .write.partitionBy("file_day").option("header", True).csv(path)
    return path


@query("s2_read_daily", f"""WITH {B.FLOWS_SQL} SELECT event_id AS bytes_out, day, strftime(observed_at, '%Y-%m') AS period,
 cast(CASE WHEN protocol = 6 THEN dst_port ELSE -1 END AS integer) AS dst_port, f_value AS avg_ipt,
 CASE WHEN family = 'BENIGN' THEN 'BENIGN' WHEN family = 'Botnet' THEN 'Outlier' ELSE 'Malicious' END AS family,
 epoch_us(observed_at) AS ts_us FROM flows""")
def s2_read_daily(spark, sf_dir):
    from flowlens.operators import clean as C

    df = R.read_honeypot_csv(spark, honeypot_files(spark, sf_dir))
    df = C.repair_timestamps(df, "time_start").withColumn("ts", F.timestamp_micros("ts_us"))
    df = C.derive_period(C.fill_ports(df.withColumnRenamed("dest_port", "dst_port"), ["dst_port"]), "ts")
    df = C.map_family(df, "label", mapping=K.HONEYPOT_FAMILY, strict=True)
    return df.select("bytes_out", "day", "period", "dst_port", "avg_ipt", "family", "ts_us")


@query("s4_scan_pruned", f"""WITH {B.FLOWS_SQL}, last AS (SELECT max(day) AS d FROM flows)
 SELECT event_id, tool, f_value, day FROM flows, last WHERE day >= d - 6 AND tool IN ('signup', 'error')""")
def s4_scan_pruned(spark, sf_dir):
    path = fresh_path(spark, "canonical")
    R.write_canonical(B.flows(spark, sf_dir), path)
    last = spark.read.parquet(path).agg(F.max("day")).head()[0]
    days = [r[0] for r in spark.range(7).select(F.date_sub(F.lit(last), F.col("id").cast("int"))).collect()]
    return R.scan_flows(spark, path, days, ["signup", "error"], ["event_id", "tool", "f_value", "day"])


REPLAY_ROWS_SQL = f"""WITH {B.FLOWS_SQL} SELECT flow_id, observed_at, src_ip,
 cast(CASE WHEN protocol = 17 THEN 0 ELSE src_port END AS integer) AS src_port, protocol, ground_truth,
 round(cast(cast(f_value AS float) AS double), 4) AS f_value FROM flows"""


def replay_files(spark, sf_dir):
    f = B.flows(spark, sf_dir)
    path = fresh_path(spark, "replay")
    f.select(
        "flow_id", F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("observed_at"),
        F.lit(0.0).alias("t_rel_s"), "src_ip", F.when(F.col("protocol") == 17, -1).otherwise(F.col("src_port")).alias("src_port"),
        "dst_ip", "dst_port", "protocol", "ground_truth", "tool", F.col("f_value").cast("float"),
    ).repartition(4).write.option("header", True).option("compression", "gzip").csv(path)
    return path


def replay_columns(df):
    return ntz(df.select("flow_id", "observed_at", "src_ip", "src_port", "protocol", "ground_truth",
                         F.round(F.col("f_value").cast("double"), 4).alias("f_value")))


@query("s5_replay_read", REPLAY_ROWS_SQL)
def s5_replay_read(spark, sf_dir):
    return replay_columns(R.read_replay(spark, replay_files(spark, sf_dir), ["protocol", "f_value"]))


@query("s5_replay_stream", REPLAY_ROWS_SQL)
def s5_replay_stream(spark, sf_dir):
    from flowlens.streaming.jobs import run_available

    live = R.stream_replay(spark, replay_files(spark, sf_dir), ["protocol", "f_value"], files_per_trigger=2)
    return replay_columns(run_available(live, fresh_path(spark, "replayed")))


@query("s6_upsert_ignore", f"""WITH {B.FLOWS_SQL} SELECT flow_id, tool, round(f_value, 6) AS f_value FROM flows""")
def s6_upsert_ignore(spark, sf_dir):
    f = B.flows(spark, sf_dir).select("flow_id", "tool", "observed_at", "f_value")
    path = fresh_path(spark, "flow_store")
    late = f.withColumns({"observed_at": F.col("observed_at") + F.expr("INTERVAL 1 HOUR"), "f_value": F.col("f_value") + 1})
    S.sink_flows_idempotent(f.where(F.col("tool") != "view").unionByName(late.where(F.col("tool") == "click")), path)
    S.sink_flows_idempotent(f, path)
    S.sink_flows_idempotent(late, path)
    return r6(spark.read.parquet(path).select("flow_id", "tool", "f_value"))


@query("s7_latest_snapshot", """SELECT event_type AS model_version, event_id AS id, status, max_psi FROM (
 SELECT event_type, event_id, CASE WHEN value >= 50 THEN 'alert' ELSE 'ok' END AS status, round(value / 100e0, 6) AS max_psi,
 row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1""")
def s7_latest_snapshot(spark, sf_dir):
    e = B.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("model_version"),
        F.when(F.col("value") >= 50, "alert").otherwise("ok").alias("status"), (F.col("value") / 100.0).alias("max_psi"))
    path = fresh_path(spark, "snapshots")
    early = F.col("status") == "ok"
    S.append_drift_snapshot(e.where(early), path)
    S.append_drift_snapshot(e.where(~early), path)
    return r6(S.latest_snapshot(spark.read.parquet(path)))


@query("s8_spec_fingerprint")
def s8_spec_fingerprint(spark, sf_dir):
    from flowlens.operators import features as FE

    spec = FE.build_feature_spec(B.measures(spark, sf_dir), B.MEASURES, "class").features
    path = fresh_path(spark, "spec")
    S.write_spec(spec, path)
    again = S.read_spec(spark, path, FE.SPEC_COLUMNS)
    return S.spec_fingerprint(again).join(S.spec_fingerprint(spec).select("sha256"), "sha256")


@query("s9_manifest_verify")
def s9_manifest_verify(spark, sf_dir):
    have = S.file_manifest(spark, sf_dir, "*.parquet")
    table = F.substring_index("name", "/", 1)
    listed = have.where(table != "nation.parquet").withColumn(
        "sha256", F.when(table == "orders.parquet", F.lit("0")).otherwise(F.col("sha256")))
    return S.verify_manifest(listed, have.where(table != "customer.parquet"))

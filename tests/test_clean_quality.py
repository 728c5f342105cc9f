from datetime import datetime

import pytest
from pyspark.sql import functions as F

from flowlens import constants as K
from flowlens.functions.exprs import repair_epoch_us, snake
from flowlens.operators import clean as C
from flowlens.operators import quality as Q
from flowlens.sources import readers as R
from flowlens.sources import stores as S


def raw_line(i, **over):
    row = {c: "1" for c in K.FLOW_CSV_COLUMNS}
    row.update({"id": str(i), "Flow ID": f"f{i}", "Src IP": "10.0.0.1", "Dst IP": "10.0.0.2", "Label": "BENIGN",
                "Timestamp": "2018-02-14 12:30:07.258263", "Attempted Category": "-1"})
    row.update(over)
    return ",".join(row[c] for c in K.FLOW_CSV_COLUMNS)


@pytest.fixture()
def raw_csv(tmp_path):
    lines = [
        raw_line(0), raw_line(1, **{"Flow Bytes/s": "Infinity", "Flow Duration": "2"}),
        raw_line(2, Label="DoS Hulk"), raw_line(3, Label="DoS GoldenEye - Attempted", **{"Attempted Category": "3", "Fwd IAT Max": "9"}),
        raw_line(4),
    ]
    path = tmp_path / "day.csv"
    path.write_text(",".join(K.FLOW_CSV_COLUMNS) + "\n" + "\n".join(lines) + "\n")
    return str(path)


def test_pinned_names():
    assert len(K.FLOW_CSV_COLUMNS) == 91 and len(R.FLOW_FEATURES) == 81
    assert len({snake(c) for c in R.FLOW_FEATURES}) == 81
    assert snake("Flow Bytes/s") == "flow_bytes_per_s" and snake(" Total Bwd packets") == "total_bwd_packets"


def test_raw_file_to_clean_rows(spark, raw_csv):
    df = R.read_flow_csv(spark, raw_csv).withColumn("attempted", F.col("attempted_category") != -1)
    df = C.map_family(df, attempted="attempted", strict=True)
    feats = [snake(c) for c in R.FLOW_FEATURES]
    quality = {r["column"]: r for r in Q.column_quality(df, feats).collect()}
    assert quality["flow_bytes_per_s"]["n_inf"] == 1 and set(quality) == {"flow_bytes_per_s"}
    clean = C.nonfinite_to_null(df, feats).withColumn("row", F.monotonically_increasing_id())
    kept = Q.dedupe_exact(clean, [*feats, "dst_port", "protocol", "family"], ["row"])
    assert kept.count() == 4 and df.where("attempted").count() == 1
    tools = {r["label"]: r["family"] for r in kept.collect()}
    assert tools["DoS GoldenEye - Attempted"] == "BENIGN" and tools["DoS Hulk"] == "DoS"


def test_same_row_on_two_days_is_kept_once(spark):
    df = spark.createDataFrame([("d2", 0, 1.0), ("d1", 5, 1.0), ("d1", 6, 2.0)], "day string, row int, x double")
    got = sorted(map(tuple, Q.dedupe_exact(df, ["x"], ["day", "row"]).collect()))
    assert got == [("d1", 5, 1.0), ("d1", 6, 2.0)]


def test_unknown_header_and_label_fail(spark, raw_csv, tmp_path):
    bad = tmp_path / "bad.csv"
    bad.write_text(open(raw_csv).read().replace("Flow Duration", "Duration"))
    with pytest.raises(Exception):
        R.read_flow_csv(spark, str(bad)).collect()
    df = spark.createDataFrame([("Mystery",)], "label string")
    with pytest.raises(ValueError, match="Mystery"):
        C.map_family(df, strict=True)
    assert [r[0] for r in C.unmapped_labels(df).collect()] == ["Mystery"]


def test_colliding_names_fail(spark):
    with pytest.raises(ValueError, match="collide"):
        C.snake_columns(spark.createDataFrame([(1, 2)], ["a b", "A/b"]).toDF("a b", "a-b"))


def test_epoch_repair(spark):
    cases = {1592533725648144: 1592533725648144, 159253372548144: 1592533725048144, 15925337258144: 1592533725008144,
             1592533725144: 1592533725000144, 15925337250: 1592533725000000}
    df = spark.createDataFrame([(k,) for k in cases], "raw long").select("raw", repair_epoch_us(F.col("raw")).alias("us"))
    for r in df.collect():
        assert r["us"] == cases[r["raw"]]
    again = df.select("us", repair_epoch_us(F.col("us")).alias("twice"))
    assert all(r["us"] == r["twice"] for r in again.collect())


def test_feature_json_and_missing(spark):
    df = spark.createDataFrame([('{"a":1.5,"x":2}',), ('{"b":3}',)], "j string")
    got = C.parse_features(df, "j", ["a", "b"]).collect()
    assert [(r["a"], r["b"]) for r in got] == [(1.5, None), (None, 3.0)]
    m = df.withColumn("m", F.from_json("j", "map<string,double>"))
    assert [r["missing"] for r in Q.missing_features(m, "m", ["b", "a"]).collect()] == [["b"], ["a"]]


def test_flow_store_ignores_known_ids(spark, tmp_path):
    path = str(tmp_path / "store")
    t = datetime(2026, 1, 1)
    a = spark.createDataFrame([("f1", t, 1), ("f1", t.replace(hour=2), 2), ("f2", t, 3)], "flow_id string, observed_at timestamp, x int")
    S.sink_flows_idempotent(a, path)
    S.sink_flows_idempotent(a.withColumn("x", F.lit(9)), path)
    assert sorted((r["flow_id"], r["x"]) for r in spark.read.parquet(path).collect()) == [("f1", 1), ("f2", 3)]


def test_manifest_problems(spark, tmp_path):
    for n in ("a", "b", "c"):
        (tmp_path / n).write_text(n)
    listed = S.file_manifest(spark, str(tmp_path)).where("name <> 'c'").collect()
    manifest = spark.createDataFrame(listed).withColumn("sha256", F.when(F.col("name") == "b", "0").otherwise(F.col("sha256")))
    present = S.file_manifest(spark, str(tmp_path)).where("name <> 'a'")
    got = dict(map(tuple, S.verify_manifest(manifest, present).collect()))
    assert got == {"a": "missing", "b": "mismatched", "c": "unlisted"}


def test_scan_prunes_days_and_pushes_tools(spark, tmp_path):
    path = str(tmp_path / "canon")
    df = spark.createDataFrame([("d1", 0, "x", 1.0), ("d2", 1, "y", 2.0)], "day string, row int, tool string, v double")
    R.write_canonical(df, path)
    plan = R.scan_flows(spark, path, ["d1"], ["x"], ["row", "v"])
    text = plan._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(day" in text or "PartitionFilters: [day" in text or "day#" in text.split("PartitionFilters")[1][:80]
    assert "PushedFilters: [IsNotNull(tool), EqualTo(tool,x)]" in text or "In(tool" in text
    assert plan.count() == 1

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.operators import drift as DR
from flowlens.operators import features as FE
from flowlens.operators import split as S


def meta(spark):
    t0 = datetime(2018, 2, 14, 8)
    rows, i = [], 0
    for tool, n, start, span in (("BENIGN", 2000, 0, 36000), ("DDoS-HOIC", 600, 32400, 3600), ("DDoS-LOIC-UDP", 100, 7200, 1800)):
        for j in range(n):
            at = start + span * j / n if tool != "DDoS-LOIC-UDP" else start + span * (j // 4) / (n // 4)
            rows.append(("d1", "BENIGN" if tool == "BENIGN" else "DDoS", tool, t0 + timedelta(seconds=at), i))
            i += 1
    return spark.createDataFrame(rows, "day string, family string, tool string, ts timestamp, row int")


GROUP = ["day", "family", "tool"]


def test_time_split_is_ordered_with_a_gap_and_never_parts_ties(spark):
    out = S.time_block_split(meta(spark), GROUP, "ts").toPandas()
    for tool, g in out.groupby("tool"):
        spans = {s: (x["ts"].min(), x["ts"].max()) for s, x in g.groupby("split")}
        assert {"train", "val", "test"} <= set(spans)
        span_s = (g["ts"].max() - g["ts"].min()).total_seconds()
        purge = min(60.0, 0.02 * span_s)
        for a, b in (("train", "val"), ("val", "test")):
            assert (spans[b][0] - spans[a][1]).total_seconds() >= 2 * purge - 1
        assert g.groupby("ts")["split"].nunique().max() == 1


def test_working_sample_sizes_and_manifest(spark):
    split = S.time_block_split(meta(spark), GROUP, "ts")
    sample = S.working_sample(split, ["day", "row"], "tool", train_attack_cap=100, train_benign=300, eval_benign=50)
    n = {(r["split"], r["tool"]): r["count"] for r in sample.groupBy("split", "tool").count().collect()}
    full = {(r["split"], r["tool"]): r["count"] for r in split.groupBy("split", "tool").count().collect()}
    assert n[("train", "BENIGN")] == 300 and n[("train", "DDoS-HOIC")] == 100
    assert n[("val", "BENIGN")] == 50 and n[("test", "DDoS-HOIC")] == full[("test", "DDoS-HOIC")]
    m = {r["tool"]: r for r in S.split_manifest(split, "tool").collect()}
    assert m["(all)"]["total"] == 2700 == sum(r["total"] for k, r in m.items() if k != "(all)")


def test_drift_split(spark):
    rows, i = [], 0
    for period, month in (("2020-06", 6), ("2020-07", 7), ("2020-09", 9)):
        for fam, n in (("BENIGN", 600), ("Malicious", 400), ("Outlier", 100)):
            for j in range(n):
                rows.append((period, fam, datetime(2020, month, 1) + timedelta(minutes=30 * j * 600 / n), i))
                i += 1
    df = spark.createDataFrame(rows, "period string, family string, ts timestamp, row int")
    out = S.drift_split(df, ["2020-06"], "period", ["family"], "ts", "family").toPandas()
    assert len(out) == len(rows)
    recal = out[out.split == "recal"]
    assert set(recal.family) == {"BENIGN"} and set(recal.period) == {"2020-07", "2020-09"}
    later = out[out.period != "2020-06"]
    assert not set(later.split) & {"train", "val"}
    for _, g in later.groupby("period"):
        assert g[g.split == "recal"].ts.max() < g[g.split == "test"].ts.min()


def test_weights(spark):
    full = spark.createDataFrame([("a",)] * 1000 + [("b",)] * 50, "g string")
    sample = spark.createDataFrame([("a",)] * 100 + [("b",)] * 50, "g string")
    got = {r["g"]: r["weight"] for r in S.sampling_weights(sample, full, ["g"]).distinct().collect()}
    assert got == {"a": 10.0, "b": 1.0}
    with pytest.raises(ValueError, match="missing"):
        S.sampling_weights(sample.union(spark.createDataFrame([("z",)], "g string")), full, ["g"])


def test_slices(spark):
    df = spark.range(101).withColumn("t", F.col("id") * 2)
    mid = sorted(r["id"] for r in S.middle_slice(df, ["t", "id"], 11).collect())
    assert mid == list(range(45, 56))
    assert S.middle_slice(df, ["t"], 500).count() == 101
    even = df.withColumn("g", F.lit("x"))
    assert sorted(r["id"] for r in S.evenly_spaced(even, ["g"], ["t"], 5).collect()) == [0, 25, 50, 75, 100]
    assert S.evenly_spaced(even, ["g"], ["t"], 200).count() == 101
    b = S.micro_batches(spark.range(60), ["id"], 25).groupBy("batch").count().collect()
    assert sorted((r["batch"], r["count"]) for r in b) == [(0, 25), (1, 25), (2, 10)]
    assert S.random_slice(df, ["id"], 10, ["t"]).count() == 10


SPEC = [(0, "dur", 0.0, 1000.0, True, None), (1, "x", -5.0, 5.0, False, None), (2, "flag", 0.0, 1.0, False, None)]


def test_transform_policy(spark):
    rng = np.random.default_rng(0)
    train = spark.createDataFrame(
        [(float(a), float(b), float(c)) for a, b, c in zip(rng.exponential(50, 200), rng.normal(0, 3, 200), rng.integers(0, 2, 200))],
        "dur double, x double, flag double")
    params = FE.fit_transformer(train, spark.createDataFrame(SPEC, FE.SPEC_COLUMNS))
    med = {r["name"]: r["median"] for r in params.collect()}
    pdf = train.toPandas()
    assert med["dur"] == pytest.approx(np.median(pdf["dur"].clip(0, 1000)))
    odd = spark.createDataFrame(
        [(0, float("inf"), None, 0.0), (1, -3.0, 99.0, 1.0), (2, None, -99.0, 2.0), (3, 1e9, 0.0, None)],
        "i int, dur double, x double, flag double")
    out = {r["i"]: r for r in FE.transform(odd, params, ["i"]).collect()}
    assert out[0]["dur"] == pytest.approx(np.log1p(med["dur"]), rel=1e-5) == pytest.approx(out[2]["dur"], rel=1e-5)
    assert out[1]["dur"] == 0.0 and out[3]["dur"] == pytest.approx(np.log1p(1000), rel=1e-5)
    assert out[1]["x"] == 5.0 and out[2]["x"] == -5.0 and out[3]["flag"] == pytest.approx(med["flag"])


def test_spec_builder(spark):
    rng = np.random.default_rng(1)
    n = 4000
    a = rng.lognormal(0, 1, n)
    cols = {"a": a, "a_copy": 2 * a + 1, "b": rng.normal(size=n), "const": np.ones(n), "neg": rng.normal(-5, 1, n),
            "heavy": rng.pareto(1.2, n)}
    rows = [tuple(float(cols[c][i]) for c in cols) + ("g" if i % 2 else "h",) for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols) + ", class string")
    got = FE.build_feature_spec(df, list(cols), "class")
    spec = {r["name"]: r for r in got.features.collect()}
    gone = {r["name"]: r for r in got.dropped.collect()}
    assert set(spec) == {"a", "b", "neg", "heavy"}
    assert gone["a_copy"]["kept_partner"] == "a" and gone["a_copy"]["rho"] > 0.99 and gone["const"]["reason"] == "constant"
    assert spec["heavy"]["log1p"] and not spec["neg"]["log1p"] and not spec["b"]["log1p"]
    with pytest.raises(ValueError, match="optional"):
        FE.variant_spec(got.features, optional=["src_port"])


def test_description_texts(spark):
    base = spark.createDataFrame([("iat_max", 10.0, 100.0), ("zero", 0.0, 5.0)], "feature string, median double, p95 double")
    rows = [("iat_max", 250.0), ("iat_max", 23.0), ("iat_max", 2.0), ("iat_max", 11.0), ("zero", 1234.5678), ("zero", 0.0), ("zero", 2.5)]
    got = FE.describe_vs_normal(spark.createDataFrame(rows, "feature string, value double"), base).collect()
    texts = {(r["feature"], r["value"]): r["text"] for r in got}
    assert texts[("iat_max", 250.0)] == "iat max is 25x the benign median"
    assert texts[("iat_max", 23.0)] == "iat max is 2.3x the benign median"
    assert texts[("iat_max", 2.0)] == "iat max is 5.0x below the benign median"
    assert texts[("iat_max", 11.0)] == "iat max is close to the benign median"
    assert texts[("zero", 1234.5678)] == "zero is 1,235, above the benign 95th percentile (5)"
    assert texts[("zero", 0.0)] == "zero is 0 (benign traffic is usually 0)"
    assert texts[("zero", 2.5)] == "zero is 2.5 (benign traffic is usually 0)"


def psi_frame(spark, seed, shift=0.0, n=5000):
    rng = np.random.default_rng(seed)
    rows = zip((rng.normal(size=n) + shift).tolist(), rng.lognormal(size=n).tolist(), rng.integers(0, 3, n).astype(float).tolist())
    return spark.createDataFrame(list(rows), "gauss double, lognorm double, discrete double")


def test_psi_reacts_to_shift_only(spark):
    cols = ["gauss", "lognorm", "discrete"]
    ref = DR.build_reference(psi_frame(spark, 0), cols)
    same = {r["feature"]: r["psi"] for r in DR.psi(psi_frame(spark, 1), ref).collect()}
    assert all(0 <= v < 0.10 for v in same.values())
    moved = {r["feature"]: r["psi"] for r in DR.psi(psi_frame(spark, 1, shift=1.5), ref).collect()}
    assert moved["gauss"] > 0.25 and moved["lognorm"] < 0.10
    collapsed = DR.psi(psi_frame(spark, 1).withColumn("gauss", F.lit(0.0)), ref).where("feature = 'gauss'").head()["psi"]
    assert collapsed > 0.25
    self_psi = DR.psi(psi_frame(spark, 0), ref).collect()
    assert all(r["psi"] < 0.01 for r in self_psi)
    const = DR.build_reference(spark.createDataFrame([(1.0,)] * 100, "x double"), ["x"])
    assert DR.psi(spark.createDataFrame([(7.0,)] * 50, "x double"), const).head()["psi"] == pytest.approx(0.0)
    with pytest.raises(ValueError, match="no finite"):
        DR.build_reference(spark.createDataFrame([(None,)], "x double"), ["x"])


@pytest.mark.parametrize("n,checks", [(499, 0), (500, 1), (1000, 2)])
def test_rolling_drift_checkpoints(spark, n, checks):
    df = spark.range(n).select("id", (F.col("id") % 17).cast("double").alias("x"), F.lit("benign").alias("verdict"))
    ref = DR.build_reference(df, ["x"])
    assert DR.rolling_drift(df, ref, ["id"]).count() == checks


def test_rolling_drift_against_plain_windows(spark):
    n, window, every = 3000, 200, 50
    df = spark.range(n).select(
        "id", ((F.col("id") * 37) % 101 + F.col("id") / 300).alias("x"),
        F.when((F.col("id") % 3 == 0) | F.col("id").between(600, 1200), "known_attack").otherwise("benign").alias("verdict"))
    ref = DR.build_reference(df, ["x"])
    got = {r["checkpoint"]: r for r in DR.rolling_drift(df, ref, ["id"], window=window, every=every, minimum=20).collect()}
    rows = df.orderBy("id").collect()
    r = ref.head()
    edges, expected = np.array(r["edges"]), np.maximum(r["expected"], 1e-4)
    for cp in range(every, n + 1, every):
        seen = rows[:cp]
        calm = [x["x"] for x in seen if x["verdict"] == "benign"][-window:]
        if len(calm) < 20:
            assert cp not in got
            continue
        share = np.maximum(np.bincount(np.searchsorted(edges, calm, side="right"), minlength=len(edges) + 1) / len(calm), 1e-4)
        assert got[cp]["psi"] == pytest.approx(float(((share - expected) * np.log(share / expected)).sum()), abs=1e-9)
        assert got[cp]["window_size"] == len(calm)
        last = seen[-window:]
        assert got[cp]["attack_rate"] == pytest.approx(sum(x["verdict"] != "benign" for x in last) / len(last))

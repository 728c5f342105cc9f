from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.models import attribution as A
from flowlens.models import bundle as BU
from flowlens.models import forest as M
from flowlens.models import isolation as ISO
from flowlens.models import tuning as T
from flowlens.operators import features as FE
from flowlens.streaming import jobs as J
from flowlens.streaming.incident_store import IncidentStore, as_close_events, as_flow_events

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    out = []
    for i in range(1500):
        fam = ["BENIGN", "BENIGN", "DoS", "Botnet"][i % 4]
        out.append((i, fam, fam, float(rng.normal({"BENIGN": 0, "DoS": 4, "Botnet": -4}[fam])), float(rng.normal()), float(rng.normal())))
    return spark.createDataFrame(out, "id long, family string, tool string, a double, b double, c double").cache()


SMALL = M.ForestParams(trees=5, depth=5, min_rows=2, features="all")


def test_forests_score_and_explain(spark, rows):
    attack = F.col("family") != "BENIGN"
    binary = M.fit_binary_forest(rows, FEATURES, attack, SMALL)
    family = M.fit_family_forest(rows.where(attack), FEATURES, params=SMALL)
    assert family.classes == ["Botnet", "DoS"]
    scored = M.score(rows, FEATURES, binary, family)
    got = scored.where(attack).agg(F.avg((F.col("closest_family") == F.col("family")).cast("double")), F.min("fconf")).head()
    assert got[0] > .95 and got[1] >= .5
    a = A.attribute(scored, FEATURES, binary)
    total = F.col("base") + F.aggregate("contributions", F.lit(0.0), lambda x, y: x + y)
    assert a.agg(F.max(F.abs(total - F.col("p_attack")))).head()[0] < 1e-6
    many = M.fit_binary_forest(rows, FEATURES, attack, M.ForestParams(trees=40, depth=4, min_rows=2, features="all"))
    b = A.attribute(M.score(rows.limit(50), FEATURES, many), FEATURES, many)
    assert b.agg(F.max(F.abs(total - F.col("p_attack")))).head()[0] < 1e-6
    base = spark.createDataFrame([(f, 0.0) for f in FEATURES], "feature string, median double")
    top = A.top_contributions(a.withColumn("ts", F.col("id")), FEATURES, base, "id", "ts", 2)
    assert top.groupBy("id").count().where("count <> 2").count() == 0
    assert A.global_importance(top).head()["feature"] == "a"


def test_isolation_forest_ranks_planted_rows_top(spark, rows):
    benign = rows.where("family = 'BENIGN'")
    forest = ISO.fit_isolation_forest(benign, FEATURES, ["id"], trees=40, sample=128)
    assert len(forest.trees) == 40 and all(t["size"][0] <= 200 for t in forest.trees)
    odd = spark.createDataFrame([(-1, 30.0, 30.0, 30.0)], "id long, a double, b double, c double")
    s = ISO.score_isolation(benign.select("id", *FEATURES).unionByName(odd), forest)
    assert s.orderBy(F.desc("anomaly_score")).head()["id"] == -1
    again = ISO.fit_isolation_forest(benign.repartition(5), FEATURES, ["id"], trees=40, sample=128)
    assert [t["threshold"] for t in again.trees] == [t["threshold"] for t in forest.trees]


def test_random_configs_are_distinct_and_repeatable():
    a = T.random_configs(6, 3)
    assert a == T.random_configs(6, 3) and len({str(c) for c in a}) == 7 and a[0] == T.DEFAULT_CONFIG


def test_bundle_detects_alike_after_reload_and_notices_tampering(spark, rows, tmp_path):
    spec = spark.createDataFrame([(i, f, -50.0, 50.0, False, None) for i, f in enumerate(FEATURES)], FE.SPEC_COLUMNS)
    made = BU.fit_bundle(rows, rows, spec, ["id"], 0.01, binary_params=SMALL, family_params=SMALL)
    got = BU.detect(rows, made)
    benign = got.where("family = 'BENIGN'")
    assert benign.where("verdict <> 'benign'").count() <= 0.01 * benign.count()
    assert got.where("family <> 'BENIGN' and verdict <> 'benign'").count() > 700
    assert set(r[0] for r in got.where("verdict = 'novel_anomaly'").select("attack_family").distinct().collect()) <= {"Unknown"}
    path = str(tmp_path / "bundle")
    BU.save_bundle(made, path)
    again = BU.detect(rows, BU.load_bundle(spark, path))
    cols = ["id", "p_attack", "verdict", "confidence", "attack_family", "severity"]
    assert got.select(*cols).exceptAll(again.select(*cols)).count() == 0
    next((tmp_path / "bundle" / "rules").glob("part-*")).write_text('{"tau_binary":0.1}')
    with pytest.raises(ValueError, match="mismatched"):
        BU.load_bundle(spark, path)


def test_bundle_without_families_uses_the_anomaly_path(spark, rows, tmp_path):
    spec = spark.createDataFrame([(i, f, -1e6, 1e6, False, None) for i, f in enumerate(FEATURES)], FE.SPEC_COLUMNS)
    made = BU.fit_bundle(rows, rows, spec, ["id"], 0.01, binary_params=SMALL, with_family=False, tau_anomaly=99.5, trees=30, sample=128)
    odd = rows.where("family = 'BENIGN'").limit(20).withColumns({f: F.lit(-9000.0 * (-1) ** i) for i, f in enumerate(FEATURES)})
    path = str(tmp_path / "strange")
    BU.save_bundle(made, path)
    for bundle in (made, BU.load_bundle(spark, path)):
        got = BU.detect(rows, bundle)
        assert got.where("anomaly_pct < 0 or anomaly_pct > 100").count() == 0
        assert {r[0] for r in got.where("verdict = 'known_attack'").select("attack_family").distinct().collect()} == {"Malicious"}
        tau = bundle.rules.head()["tau_binary"]
        novel = got.where("verdict = 'novel_anomaly'")
        assert novel.where((F.col("p_attack") >= tau) | (F.col("anomaly_pct") < 99.5)).count() == 0
        strange = BU.detect(odd, bundle)
        assert strange.where("verdict = 'benign'").count() == 0 and strange.where("anomaly_pct < 99.5").count() == 0


FLOW = "flow_id string, observed_at timestamp, src_ip string, dst_ip string, dst_port int, verdict string, attack_family string, confidence double, severity double, model_version string"


def test_incident_store_over_batches(spark, tmp_path):
    t0 = datetime(2026, 1, 1)
    at = lambda s: t0 + timedelta(seconds=s)
    flow = lambda i, s, src="a": (f"f{i}", at(s), src, "d", 80, "known_attack", "DoS", .9, .8, "1")
    frame = lambda *r: as_flow_events(spark.createDataFrame(list(r), FLOW))
    close = lambda s: as_close_events(spark.createDataFrame([("a", "d", "DoS", at(s))], "src_ip string, dst_ip string, corr_family string, at timestamp"))
    store = IncidentStore(str(tmp_path / "store"), delay_s=600)
    batches = [
        frame(flow(0, 0), flow(1, 180)),
        frame(flow(2, 100), flow(3, 400)),
        close(420),
        frame(flow(4, 500), flow(5, 500, "b")),
        frame(flow(6, 5000)),
        frame(flow(7, 10), flow(8, 5100)),
    ]
    for i, b in enumerate(batches):
        store.update(b, i)
        store.update(b, i)
    final = sorted((r["src_ip"], r["flow_count"], r["first_seen"]) for r in store.final_incidents(spark).collect())
    assert final == [("a", 1, at(500)), ("a", 4, at(0)), ("b", 1, at(500))]
    assert [(r["flow_count"], r["first_seen"]) for r in store.open_incidents(spark, 5).collect()] == [(2, at(5000))]
    assert [r["flow_id"] for r in store.late_rows(spark).collect()] == ["f7"]


def frames(spark):
    t0 = datetime(2026, 1, 1)
    at = lambda s: t0 + timedelta(seconds=s)
    flows = lambda *seconds: as_flow_events(spark.createDataFrame(
        [(f"f{s}", at(s), "a", "d", 80, "known_attack", "DoS", .9, .8, "1") for s in seconds], FLOW))
    close = lambda s: as_close_events(spark.createDataFrame([("a", "d", "DoS", at(s))], "src_ip string, dst_ip string, corr_family string, at timestamp"))
    return at, flows, close


def test_a_late_close_parts_flows_that_came_before_it(spark, tmp_path):
    at, flows, close = frames(spark)
    store = IncidentStore(str(tmp_path / "store"), delay_s=600)
    assert store.last_batch(spark) == -1
    store.update(flows(10, 100, 200), 0)
    store.update(close(50), 1)
    assert store.late_rows(spark).count() == 0
    got = sorted((r["flow_count"], r["first_seen"]) for r in store.open_incidents(spark, 1).collect())
    assert got == [(1, at(10)), (2, at(100))]
    store.update(flows(9000), 2)
    assert sorted((r["flow_count"], r["first_seen"]) for r in store.final_incidents(spark).collect()) == got
    assert store.last_batch(spark) == 2 and not (tmp_path / "store" / "state" / "batch=0").exists()


def test_streams_go_on_where_the_last_run_ended(spark, tmp_path):
    at, flows, _ = frames(spark)
    source = str(tmp_path / "in")
    flows(0, 60).coalesce(1).write.mode("append").parquet(source)
    schema = flows(0).schema
    stream = lambda: spark.readStream.schema(schema).parquet(source)
    store, table, kept = IncidentStore(str(tmp_path / "store")), str(tmp_path / "table"), str(tmp_path / "flows")
    for want, more in ((2, None), (3, flows(120)), (3, None)):
        if more is not None:
            more.coalesce(1).write.mode("append").parquet(source)
        last = store.run_available(stream())
        assert [r["flow_count"] for r in store.open_incidents(spark, last).collect()] == [want]
        assert J.run_available(stream(), table).count() == want
        J.run_flow_store(stream(), kept)
        assert spark.read.parquet(kept).count() == want


def test_late_rows_and_expiry_with_a_real_watermark(spark, tmp_path):
    """Sessions close behind the watermark, a row behind it is dropped, a repeated key is kept once its state is gone."""
    at, flows, _ = frames(spark)
    source = str(tmp_path / "in")
    schema = flows(0).schema
    table, once = str(tmp_path / "incidents"), str(tmp_path / "once")
    sizes = []
    for batch in (flows(0, 60), flows(3000), flows(30), flows(9000)):
        batch.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        got = J.run_available(J.stream_incidents(stream.drop("kind"), 300, watermark="10 minutes"), table)
        sizes.append(sorted(r["flow_count"] for r in got.collect()))
        J.run_available(J.stream_dedupe(stream, watermark="10 minutes"), once)
    assert sizes[-1] == [1, 2]
    assert sorted(r["flow_id"] for r in spark.read.parquet(once).collect()) == ["f0", "f3000", "f60", "f9000"]

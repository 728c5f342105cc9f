from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from flowlens import constants as K
from flowlens.functions import detection as D
from flowlens.functions.exprs import wilson
from flowlens.operators import brief as BR
from flowlens.operators import decide as DE
from flowlens.operators import evaluate as E
from flowlens.operators import incidents as I
from flowlens.operators import workbench as W
from flowlens.operators.split import micro_batches

T0 = datetime(2026, 10, 6, 8, 0)
FLOW = ("flow_id string, observed_at timestamp, src_ip string, dst_ip string, dst_port int, verdict string, "
        "attack_family string, confidence double, severity double, model_version string")


def flow(i, s=0, src="a", dst="d", fam="DDoS", verdict="known_attack", conf=0.9, sev=0.8):
    return (f"f{i}", T0 + timedelta(seconds=s), src, dst, 80 + i, verdict, fam, conf, sev, "1")


def one(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_fuse(spark):
    rows = [(0, .9, 10.0, .6), (1, .2, 99.9, .6), (2, .2, 50.0, .6), (3, .9, 10.0, .99), (4, .9, 10.0, .55), (5, .9, 0.0, None)]
    df = spark.createDataFrame(rows, "i int, p_attack double, anomaly_pct double, fconf double")
    v = {r["i"]: r["verdict"] for r in DE.fuse(df.where("i < 3"), .5, 99.0).collect()}
    assert v == {0: "known_attack", 1: "novel_anomaly", 2: "benign"}
    v = {r["i"]: r["verdict"] for r in DE.fuse(df.where("i >= 3"), .5, 99.0, .9).collect()}
    assert v == {3: "known_attack", 4: "novel_anomaly", 5: "known_attack"}
    got = [r[0] for r in spark.createDataFrame([(99.0,), (99.5,), (100.0,), (98.0,)], "x double").select(D.novel_confidence(F.col("x"), 99.0)).collect()]
    assert got == [0.5, 0.75, 1.0, 0.0]


def test_risk_examples(spark):
    rows = [("known_attack", .88, .70, 1, 62, "MEDIUM"), ("known_attack", .81, 1.0, 1, 81, "HIGH"), ("known_attack", .95, .30, 1, 28, "LOW"),
            ("known_attack", .99, .80, 4210, 91, "HIGH"), ("known_attack", .94, .90, 37, 91, "HIGH"), ("novel_anomaly", .71, .75, 112, 69, "MEDIUM"),
            ("known_attack", .58, .64, 1, 37, "LOW"), ("benign", .99, .8, 10, 0, "LOW")]
    df = spark.createDataFrame(rows, "v string, c double, s double, n int, want int, level string")
    out = df.withColumn("got", D.risk_score(F.col("v"), F.col("c"), F.col("s"), F.col("n")))
    for r in out.withColumn("lv", D.risk_level(F.col("got"))).collect():
        assert (r["got"], r["lv"]) == (r["want"], r["level"])
    probs = spark.sql("select map('WebAttack', 0.9D, 'Infiltration', 0.1D) m, 'WebAttack' f union all select map(), 'Botnet' union all select null, 'Odd'")
    assert sorted(round(r[0], 6) for r in probs.select(D.expected_severity(F.col("f"), F.col("m"))).collect()) == [0.5, 0.64, 0.9]


@pytest.mark.parametrize("cap,moved,want", [(2, False, [0, 4, 6]), (5, False, [0, 1, 2, 4, 6]), (0, False, []), (2, True, [0, 3, 4, 6])])
def test_explanation_picks(spark, cap, moved, want):
    p = [0.99, 0.98, 0.97, 0.96, 0.30, 0.01, 0.40]
    fam = ["DDoS"] * 4 + ["Unknown", "BENIGN", "DoS"]
    ver = ["known_attack"] * 4 + ["novel_anomaly", "benign", "known_attack"]
    rows = [(i, T0 + timedelta(minutes=10 if moved and i == 3 else 0), "aaaabcc"[i], "d", ver[i], fam[i], p[i]) for i in range(7)]
    df = spark.createDataFrame(rows, "flow_id int, observed_at timestamp, src_ip string, dst_ip string, verdict string, attack_family string, p_attack double")
    assert sorted(r["flow_id"] for r in DE.select_for_explanation(df.withColumn("batch", F.lit(1)), "batch", cap=cap).collect()) == want


@pytest.mark.parametrize("gap,counts", [(180, [2]), (300, [2]), (301, [1, 1])])
def test_session_gap(spark, gap, counts):
    df = spark.createDataFrame([flow(0), flow(1, gap)], FLOW)
    assert sorted(r["flow_count"] for r in I.incident_aggregates(df).collect()) == counts


def test_keys_do_not_mix(spark):
    rows = [flow(0), flow(1, src="b"), flow(2, dst="e"), flow(3, fam="DoS"), flow(4, verdict="novel_anomaly", fam="DDoS"),
            flow(5, verdict="novel_anomaly", fam="Unknown"), flow(6, verdict="benign", fam="BENIGN")]
    got = I.incident_aggregates(spark.createDataFrame(rows, FLOW)).collect()
    assert len(got) == 5 and sum(r["flow_count"] for r in got) == 6


def test_aggregates_take_the_first_flow(spark):
    rows = [flow(2, 40, conf=.5, sev=.4), flow(0, 0, conf=.7, sev=.8), flow(1, 20, conf=.95, sev=.6)]
    r = I.incident_aggregates(spark.createDataFrame(rows, FLOW)).head()
    assert (r["flow_count"], r["max_confidence"], r["dst_port"], r["status"]) == (3, .95, 80, "new")
    assert r["severity"] == pytest.approx(.6) and (r["last_seen"] - r["first_seen"]).total_seconds() == 40


def test_close_events_split_sessions(spark):
    df = I.correlation_key(spark.createDataFrame([flow(0), flow(1, 60), flow(2, 120), flow(3, 400)], FLOW))
    at = lambda *s: spark.createDataFrame([("a", "d", "DDoS", T0 + timedelta(seconds=x)) for x in s], "src_ip string, dst_ip string, corr_family string, at timestamp")
    n = lambda closes: sorted(r["flow_count"] for r in I.sessionize(df, I.KEYS, "observed_at", closes=closes).collect())
    assert n(None) == [4] and n(at(90)) == [2, 2] and n(at(500)) == [4] and n(at(30, 90, 350)) == [1, 1, 1, 1]
    assert n(at(60)) == [2, 2]


def test_hot_key_session_equals_plain_islands(spark):
    n = 6000
    rows = [flow(i, s=(i * i) % 40000 + (900 if i % 7 == 0 else 0), src="hot" if i % 3 == 0 else f"s{i % 40}") for i in range(n)]
    got = {(r["src_ip"], r["first_seen"]): r["flow_count"] for r in I.incident_aggregates(spark.createDataFrame(rows, FLOW), 5).collect()}
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r[1])
    want = {}
    for src, ts in by.items():
        start = last = None
        for t in sorted(ts):
            if last is None or (t - last).total_seconds() > 5:
                start = t
                want[(src, start)] = 0
            want[(src, start)] += 1
            last = t
    assert got == want
    linked = I.link_flows(spark.createDataFrame(rows, FLOW), 5)
    sizes = sorted(r["count"] for r in linked.groupBy("incident_id").count().collect())
    assert sizes == sorted(want.values())


def test_top_features(spark):
    rows = [("f1", T0, "fwd_pkt", 1.0, .4), ("f1", T0, "flow_dur", 2.0, .2), ("f2", T0 + timedelta(seconds=1), "fwd_pkt", 3.0, .6),
            ("f2", T0 + timedelta(seconds=1), "syn_flag", 4.0, .8)]
    a = spark.createDataFrame([(*r, 0.0) for r in rows], "flow_id string, ts timestamp, feature string, value double, contribution double, baseline_median double")
    link = spark.createDataFrame([("f1", "I"), ("f2", "I"), ("f3", "I")], "flow_id string, incident_id string")
    got = [(r["feature"], r["contribution"], r["value"]) for r in I.incident_top_features(a, link).orderBy("rank").collect()]
    assert got == [("fwd_pkt", .5, 3.0), ("syn_flag", .4, 4.0), ("flow_dur", .1, 2.0)]


ACT = "action_id long, incident_id string, analyst string, action string, at timestamp"


def test_action_log(spark):
    seq = {"A": ["acknowledge", "note", "acknowledge"], "B": ["escalate", "acknowledge"], "C": ["acknowledge", "resolve", "escalate", "note"],
           "D": ["note", "confirm"], "E": ["dismiss_fp", "acknowledge"]}
    rows, i = [], 0
    for inc, acts in seq.items():
        for k, a in enumerate(acts):
            rows.append((i, inc, "x", a, T0 + timedelta(seconds=60 * (k + 1))))
            i += 1
    df = spark.createDataFrame(rows, ACT)
    got = {r["incident_id"]: (r["status"], r["acknowledged_at"]) for r in W.fold_actions(df).collect()}
    t1 = T0 + timedelta(seconds=60)
    assert got == {"A": ("acknowledged", t1), "B": ("acknowledged", None), "C": ("resolved", t1), "D": ("new", None), "E": ("dismissed_fp", None)}
    assert {r["incident_id"]: r["count"] for r in W.accepted_actions(df).groupBy("incident_id").count().collect()} == {"A": 3, "B": 2, "C": 2, "D": 2, "E": 1}


def test_live_metrics(spark):
    flows = spark.createDataFrame([(T0, 10.0), (T0, 20.0), (T0 - timedelta(hours=1), 30.0)], "received_at timestamp, latency_ms double")
    inc = spark.createDataFrame([("1", "new", "HIGH", T0, None), ("2", "acknowledged", "MEDIUM", T0, T0 + timedelta(seconds=60)), ("3", "resolved", "LOW", T0, None)],
                                "incident_id string, status string, risk_level string, first_seen timestamp, acknowledged_at timestamp")
    acts = spark.createDataFrame([(1, "1", "x", "confirm", T0), (2, "3", "x", "dismiss_fp", T0)], ACT)
    r = W.live_metrics(flows, inc, acts, F.lit(T0)).head()
    assert (r["flows_scored_total"], r["latency_ms_p50"], r["incidents_open"], r["open_high"], r["open_medium"]) == (3, 20.0, 2, 1, 1)
    assert (r["analyst_confirmed_precision"], r["mtta_seconds"]) == (.5, 60.0) and r["flows_per_sec_1m"] == pytest.approx(2 / 60)
    empty = W.live_metrics(flows.limit(0), inc.limit(0), acts.limit(0), F.lit(T0)).head()
    assert (empty["latency_ms_p50"], empty["analyst_confirmed_precision"], empty["mtta_seconds"]) == (0.0, None, None)


def test_queue_sorting_and_paging(spark):
    inc = spark.createDataFrame([(f"i{k}", "new", "known_attack", "DoS", "HIGH", k, T0 + timedelta(seconds=-k), T0 + timedelta(seconds=-k)) for k in range(10)],
                                "incident_id string, status string, verdict string, attack_family string, risk_level string, risk_score int, first_seen timestamp, last_seen timestamp")
    page = W.list_incidents(inc, sort="nonsense", limit=3, offset=1).collect()
    assert [r["risk_score"] for r in page] == [8, 7, 6] and page[0]["total"] == 10
    assert [r["incident_id"] for r in W.list_incidents(inc, sort="last_seen", limit=2).collect()] == ["i0", "i1"]
    assert W.list_incidents(inc, status="resolved").count() == 0
    assert W.new_since(None, inc).count() == 0 and W.new_since(inc.where("risk_score < 9"), inc).count() == 1


def test_binary_report_and_wilson(spark):
    y, p = [1, 1, 1, 0, 0, 0, 0, 0], [.9, .8, .2, .7, .1, .1, .2, .3]
    df = spark.createDataFrame(list(zip(y, p)), "y int, p double")
    r = E.binary_report(df, F.col("y") == 1, F.col("p") >= .5).head()
    assert (r["tp"], r["fn"], r["fp"], r["tn"], r["fpr"]) == (2, 1, 1, 4, .2)
    rows = [(1, 1.0 if i < 8 else 0.0, 1.0) for i in range(10)] + [(0, 1.0 if i < 2 else 0.0, 10.0) for i in range(100)]
    df = spark.createDataFrame(rows, "y int, p double, w double")
    w = E.binary_report(df, F.col("y") == 1, F.col("p") >= .5, F.col("w")).head()
    raw = E.binary_report(df, F.col("y") == 1, F.col("p") >= .5).head()
    assert raw["precision"] == pytest.approx(.8) and w["precision"] == pytest.approx(8 / 28) and w["recall"] == raw["recall"]
    assert (w["fp"], w["tn"]) == (20, 980)
    got = spark.createDataFrame([(0, 0), (500, 1000)], "k int, n int").select(*wilson(F.col("k"), F.col("n"))).collect()
    assert tuple(got[0]) == (0.0, 1.0) and got[1][0] == pytest.approx(.469, abs=1e-3) and got[1][1] == pytest.approx(.531, abs=1e-3)
    assert E.ranking_quality(df.where("y = 1"), F.col("y") == 1, "p").head()["roc_auc"] is None


def test_threshold_respects_the_budget(spark):
    scores = [i / 1000 for i in range(1000)] + [.999] * 5
    df = spark.createDataFrame([(s,) for s in scores], "p double")
    for budget in (0.0, .001, .01, .1):
        cut = DE.threshold_for_fpr(df, "p", budget)
        assert sum(s > cut for s in scores) <= budget * len(scores)
    with pytest.raises(ValueError, match="no benign"):
        DE.threshold_for_fpr(df.limit(0), "p", .1)


def test_family_report(spark):
    cells = E.confusion(spark.createDataFrame([("BENIGN", "BENIGN")] * 5 + [("DoS", "DoS")] * 3 + [("DoS", "Unknown")], "t string, p string"), "t", "p", dense=True)
    assert cells.count() == 9
    rep = {r["family"]: r for r in E.family_report(cells).collect()}
    assert rep["DoS"]["recall"] == .75 and rep["DoS"]["precision"] == 1.0 and rep["Unknown"]["support"] == 0
    assert E.macro_f1(E.family_report(cells)).head()[0] == pytest.approx((1 + 2 * .75 / 1.75) / 2)


def test_replay(spark):
    df = spark.createDataFrame([(i, "DoS", "known_attack") for i in range(60)], "id long, ground_truth string, verdict string")
    r = E.replay_report(df).head()
    assert (r["tp"], r["precision"], r["recall"], r["f1"]) == (60, 1.0, 1.0, 1.0)
    prog = E.progressive_metrics(micro_batches(df, ["id"], 25), "batch").orderBy("batch").collect()
    assert [x["tp"] for x in prog] == [25, 50, 60]
    odd = spark.createDataFrame([("outlier", "known_attack"), ("", "benign"), (None, "benign"), ("unknown", "known_attack")], "ground_truth string, verdict string")
    r = E.replay_report(odd).head()
    assert (r["outliers"], r["outliers_flagged"], r["tp"], r["fp"], r["tn"], r["recall"]) == (1, 1, 0, 1, 2, 1.0)


BRIEF = ("incident_id string, verdict string, attack_family string, max_confidence double, flow_count long, src_ip string, dst_ip string, dst_port int, "
         "top_features array<struct<feature:string,value:double,baseline_median:double>>")


def test_briefs_pass_their_own_checks(spark):
    feats = [("flow_iat_max", 600.0, 2.0), ("syn_flag", 3.0, 0.0)]
    rows = [(f"{f}-{c}", "novel_anomaly" if f == "Unknown" else "known_attack", f, c, 4210, "1.2.3.4", "5.6.7.8", 443, feats)
            for f in K.FAMILIES if f != "BENIGN" for c in (.95, .7, .4)]
    out = BR.render_brief(I.mitre_join(spark.createDataFrame(rows, BRIEF)))
    checked = {r["incident_id"]: r for r in BR.validate_briefs(out).collect()}
    assert all(r["failures"] == [] for r in checked.values()), [r["failures"] for r in checked.values()]
    assert checked["DDoS-0.95"]["brief"].startswith(
        "Active DDoS (MITRE T1498) activity detected from 1.2.3.4 to 5.6.7.8:443 across 4,210 flows. The traffic matches DDoS behavioral "
        "patterns: flow iat max is ~300x higher than typical and syn flag is elevated (3.0 vs normal 0). Immediate action required: ")
    assert checked["Unknown-0.4"]["brief"].endswith("Worth reviewing: check what 1.2.3.4 is doing on port 443 before escalating.")
    bad = out.withColumn("brief", F.concat("brief", F.lit(" Root access via CVE-2021-1.")))
    assert all({"forbidden_term", "not_reproducible"} <= set(r["failures"]) for r in BR.validate_briefs(bad).collect())


def test_metric_wording(spark):
    df = spark.createDataFrame([(None, None), (.9, 30.0), (.75, 150.0), (.2, 4000.0)], "precision double, mtta_seconds double")
    assert [(r["precision_band"], r["mtta_label"]) for r in W.metric_bands(df).collect()] == [
        ("none", "—"), ("ok", "30 s"), ("medium", "2.5 min"), ("high", "1.11 hr")]

"""Many forests in one job: trees, scores, hold-outs and searches against plain computation."""

import dataclasses
import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.models import growing
from flowlens.models import isolation as ISO
from flowlens.models import tree_tables as TT
from flowlens.models import tuning as T
from flowlens.models.forest import ForestParams
from flowlens.models.growing import Job, _drawn, grow_forests, grow_tree, training_cells, training_sample
from flowlens.operators import evaluate as E

START = dt.datetime(2026, 1, 1)


def attack():
    return F.col("family") != "BENIGN"


@pytest.fixture(scope="module")
def flows(spark):
    """Benign rows, two tools alike in x, and one that only y tells."""
    rng, rows = random.Random(3), []
    for i in range(1_500):
        kind = rng.random()
        family, tool = ("BENIGN", "none") if kind < 0.6 else ("DoS", rng.choice(["hulk", "loic"])) if kind < 0.85 else ("Botnet", "ares")
        x = rng.gauss(6 if family == "DoS" else 0, 1)
        y = rng.gauss(9 if family == "Botnet" else 0, 1)
        rows.append((str(i), START + dt.timedelta(seconds=i), family, tool, x, y, rng.random(), 1.0))
    return spark.createDataFrame(rows, "flow_id string, observed_at timestamp, family string, tool string, x double, y double, z double, w double")


def job(fit, **more):
    return Job(**({"fit": fit, "label": "attack", "trees": 8, "depth": 6, "min_rows": 3, "subset": "sqrt", "seed": 1, "features": ("x", "y", "z")} | more))


def test_best_split_of_one_tree_against_every_possible_one():
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 8, (200, 3)), rng.integers(0, 2, 200)
    y[x[:, 1] > 4] = 1

    class Same:  # draws every row once and allows every feature
        def integers(self, lo, hi, n):
            return np.arange(n)

        def random(self, shape):
            return np.zeros(shape)

    feature, threshold, left, right, value = grow_tree(x, y, 2, [np.arange(7)] * 3, Same(), 1, 1, 3, False, 8)

    def impurity(part):
        return len(part) * (1 - (part.mean() ** 2 + (1 - part.mean()) ** 2)) if len(part) else 0.0

    best = min((impurity(y[x[:, j] <= b]) + impurity(y[x[:, j] > b]), j, b) for j in range(3) for b in range(7))
    assert (feature[0], threshold[0]) == best[1:]
    assert value.reshape(-1, 2)[left[0], 1] == pytest.approx(y[x[:, best[1]] <= best[2]].mean())


def test_leaves_hold_at_least_the_asked_rows_and_depth_is_kept():
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 30, (500, 4)), rng.integers(0, 3, 500)
    feature, threshold, left, right, value = grow_tree(x, y, 3, [np.arange(29)] * 4, rng, 5, 10, 2, True, 30)
    tree = TT.Tree(feature, threshold, left, right, value)
    depth = np.zeros(len(left), dtype=int)
    for i in range(len(left)):
        for c in (left[i], right[i]):
            if c >= 0:
                depth[c] = depth[i] + 1
    assert depth.max() <= 5 and np.allclose(value.reshape(-1, 3).sum(axis=1), 1)
    assert set(tree.leaves(x)) <= set(np.flatnonzero(left < 0))


def test_rows_meet_only_the_trees_of_their_fit_in_any_blocks(spark, flows, monkeypatch):
    sample = training_sample(flows, ["x", "y", "z"], attack(), ["tool", "family"], ["flow_id"])
    trees = grow_forests(spark, sample, [job("a"), job("b", trees=3, without=("tool", "ares")), job("c", label="family")])
    assert {r.fit: r["n"] for r in trees.groupBy("fit").agg(F.count(F.lit(1)).alias("n")).collect()} == {"a": 8, "b": 3, "c": 8}
    rows = flows.withColumn("fit", F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("none"))))

    def scores():
        met = TT.meet_trees(rows, trees, ["x", "y", "z"], 2, TT.leaf_values(2), ["flow_id"])
        return {(r.fit, r.flow_id): (r.n_trees, [round(v, 9) for v in r.sums]) for r in met.collect()}

    whole = scores()
    monkeypatch.setattr(TT, "BLOCK_ROWS", 100)
    monkeypatch.setattr(TT, "BLOCK_NODES", 40)
    assert scores() == whole and len(whole) == 4_500
    assert whole["none", "3"] == (0, [0.0, 0.0])
    held = {r.fit: [TT.Tree(*[np.array(r[c]) for c in ("feature", "threshold", "left", "right", "value")])] for r in trees.where("tree = 0").collect()}
    one = TT.meet_trees(rows.where("fit = 'a'"), trees.where("tree = 0"), ["x", "y", "z"], 2, TT.leaf_values(2), ["flow_id"]).collect()
    for r in one[:50]:
        t = held["a"][0]
        assert r.sums == pytest.approx(t.value.reshape(-1, 2)[t.leaves(np.array([[r.x, r.y, r.z]]))[0]].tolist())


def test_a_left_out_tool_has_no_part_in_its_forest(spark, flows):
    """Thresholds and shares are the same whether its rows are in the sample or not."""
    with_it, without = (training_sample(d, ["x", "y", "z"], attack(), ["tool", "family"], ["flow_id"]) for d in (flows, flows.where("tool <> 'ares'")))
    a, b = ({r.tree: (r.feature, r.threshold, r.value) for r in grow_forests(spark, s, [job("f", without=("tool", "ares"))]).collect()} for s in (with_it, without))
    assert a == b


def test_sample_is_bounded_and_the_same_every_time(flows):
    a, b = (training_sample(flows.repartition(n), ["x"], attack(), ["tool"], ["flow_id"], rows=300) for n in (2, 5))
    assert 200 < len(a.x) < 400 and (a.x == b.x).all()


def test_holdouts_of_many_runs_equal_one_report_each(flows):
    rows = flows.select("family", "tool", "w", F.col("x").alias("p"), F.col("z").alias("fconf"), (F.col("x") + F.col("y")).alias("p_full"))
    held = {u: F.col("tool") == u for u in ("hulk", "ares")}
    both = None
    for u, h in held.items():
        some = rows.withColumns({"unit": F.lit(u), "held": h})
        both = some if both is None else both.unionByName(some)
    got = {(r.unit, r.budget): r.asDict() for r in E.holdout_reports(both, both, ["unit"], "held", [0.01, 0.1]).collect()}
    assert len(got) == 4
    for u, h in held.items():
        for r in E.holdout_report(rows, rows, h, [0.01, 0.1]).collect():
            want = r.asDict()
            assert {k: pytest.approx(v) if isinstance(v, float) else v for k, v in want.items()} == {k: got[u, r.budget][k] for k in want}


def test_run_holdouts_search_and_ablation(spark, flows):
    parts = [flows.where(F.pmod(F.col("flow_id").cast("int"), F.lit(3)) == k) for k in range(3)]
    small = ForestParams(trees=10, depth=6, min_rows=3, features="sqrt")
    out = T.run_holdouts(*parts, [("tool", "hulk"), ("family", "Botnet")], T.Setting(["x", "y", "z"], small, small), seeds=(1, 2), budgets=(0.05,))
    got = {(r.unit, r.seed): r for r in out.collect()}
    assert set(got) == {(u, s) for u in ("hulk", "Botnet") for s in (1, 2)}
    for s in (1, 2):  # loic still teaches x; nothing else teaches y
        assert got["hulk", s].recall > 0.9 and got["Botnet", s].recall < 0.5 and got["Botnet", s].recall_seen_ceiling > 0.9
    summed = {r.unit: r for r in E.aggregate_seeds(out, "unit", "budget", ["recall"]).collect()}
    assert summed["hulk"].seeds == 2 and len(summed["hulk"].recall_by_seed) == 2
    ranked, confirmed = T.tune(parts[0], parts[1], ["x", "y", "z"], ["hulk", "ares"], n=2, trees=6, confirm_seeds=(5,), budgets=(0.05, 0.01))
    assert sorted(r["rank"] for r in ranked.collect()) == [1, 2, 3] and confirmed.count() == 3
    rows = {r.variant: r for r in T.ablation(parts[0], parts[2], {"all": ["x", "y", "z"], "no_y": ["x", "z"]}, small, budget=0.02, held_tool="ares", minimum=5).collect()}
    assert rows["all"].features == 3 and rows["no_y"].held_recall < 0.3 and rows["all"].recall > 0.5


def test_rows_of_a_cell_reach_the_same_leaves(spark, flows):
    """Missing and infinite numbers and such on a threshold too; holdouts score every cell once."""
    sample = training_sample(flows, ["x", "y", "z"], attack(), ["tool", "family"], ["flow_id"])
    trees = grow_forests(spark, sample, [job("a"), job("b", trees=3, without=("tool", "ares"))])
    cut = [t for r in trees.collect() for f, t in zip(r.feature, r.threshold, strict=True) if f == 0]
    odd = [(float("nan"), 0.0, 1.0), (None, 0.0, 1.0), (float("inf"), 0.0, 1.0), (float("-inf"), -0.0, 1.0), *[(t, 0.0, 1.0) for t in sorted(set(cut))[:20]]]
    rows = flows.select("x", "y", "z").unionByName(spark.createDataFrame(odd, "x double, y double, z double"))
    rows = rows.withColumn("id", F.monotonically_increasing_id().cast("string")).withColumn("fit", F.explode(F.array(F.lit("a"), F.lit("b"))))
    met = TT.meet_trees(T._with_cell(rows, trees, ["x", "y", "z"]), trees, ["x", "y", "z"], 2, TT.leaf_values(2), ["id"]).collect()
    found = {}
    for r in met:
        found.setdefault((r.fit, bytes(r._cell)), set()).add(tuple(r.sums))
    assert all(len(v) == 1 for v in found.values()) and len(found) < len(met)


def test_isolation_forests_of_all_fits_equal_single_ones(spark, flows):
    benign = flows.where(~attack())
    plan = spark.createDataFrame([("a", 20, 64, 1.0), ("b", 20, 256, 1.0)], "fit string, trees int, sample int, share double")
    both = benign.withColumn("fit", F.explode(F.array(F.lit("a"), F.lit("b"))))
    trees = ISO.grow_isolation_forests(both, plan, ["x", "y"], ["flow_id"])
    got = {(r.fit, r.flow_id): r.anomaly_score for r in ISO.score_isolation_forests(both, trees, ["x", "y"], ["flow_id"]).collect()}
    for fit, sample in (("a", 64), ("b", 256)):
        alone = ISO.score_isolation(benign, ISO.fit_isolation_forest(benign, ["x", "y"], ["flow_id"], 20, sample))
        for r in alone.collect():
            assert got[fit, r.flow_id] == pytest.approx(r.anomaly_score, abs=1e-9)


def test_study_of_settings_with_a_share_of_the_features(spark, flows):
    per, tools = ISO.isolation_study(flows.where(~attack()), flows, ["x", "y", "z"], ["flow_id"], attack(), "tool",
                                     {"whole": (30, 128, 1.0), "third": (30, 128, 0.34)})
    rows = {r.setting: r for r in per.collect()}
    assert set(rows) == {"whole", "third"} and all(r.roc_auc > 0.9 and r.benign_flag_rate <= 0.005 + 1 / r.n_benign for r in rows.values())
    assert {(r.setting, r.tool) for r in tools.collect()} == {(s, t) for s in rows for t in ("hulk", "loic", "ares")}
    plan = spark.createDataFrame([("third", 30, 128, 0.34)], "fit string, trees int, sample int, share double")
    used = ISO.grow_isolation_forests(flows.withColumn("fit", F.lit("third")), plan, ["x", "y", "z"], ["flow_id"])
    assert all(len({f for f in r.feature if f >= 0}) <= 1 for r in used.collect())


def holdout_jobs():
    return [job("full|1"), job("b", without=("tool", "hulk")), job("f", label="family", without=("tool", "hulk"), attacks_only=True)]


def test_holdouts_train_on_all_rows(spark, flows, monkeypatch):
    """No sample is drawn, and the cells of a set of rows stand for every one of them, with the cut points of all."""
    odd = flows.limit(3).withColumns({"family": F.lit(None).cast("string"), "tool": F.lit(None).cast("string")})
    rows = flows.unionByName(odd).unionByName(flows.limit(50))  # labels without a value, and copies
    jobs = holdout_jobs()
    sample = training_sample(rows, ["x", "y", "z"], attack(), ["tool", "family"], ["flow_id"])
    cells = training_cells(rows, ["x", "y", "z"], attack(), ["tool", "family"], jobs)
    for j in jobs:
        cuts, codes, y, _ = sample.prepared(j)
        got_cuts, got_codes, got_y, n = cells.prepared(j)
        assert all(a.tolist() == b.tolist() for a, b in zip(cuts, got_cuts, strict=True)) and n.sum() == len(y)
        want, counts = np.unique(np.hstack([codes, y[:, None]]), axis=0, return_counts=True)
        found = {}
        for c, label, m in zip(got_codes.tolist(), got_y, n, strict=True):
            found[(*c, label)] = found.get((*c, label), 0) + m
        assert found == dict(zip(map(tuple, want.tolist()), counts, strict=True))
    monkeypatch.setattr(T, "training_sample", lambda *a, **k: pytest.fail("rows were sampled"))
    parts = [flows.where(F.pmod(F.col("flow_id").cast("int"), F.lit(3)) == k) for k in range(3)]
    small = ForestParams(trees=4, depth=4, min_rows=3, features="sqrt")
    assert T.run_holdouts(*parts, [("tool", "hulk")], T.Setting(["x", "y", "z"], small, small), seeds=(1,), budgets=(0.05,)).count() == 1


def test_cells_beyond_a_task_grow_in_rounds(spark, flows, monkeypatch):
    """The same jobs with cells held by tasks and not: forests that tell the classes apart alike."""
    jobs, scores = [dataclasses.replace(j, trees=40) for j in holdout_jobs()], []
    for most in (growing.GROUP_CODES, 0):
        monkeypatch.setattr(growing, "GROUP_CODES", most)
        cells = training_cells(flows, ["x", "y", "z"], attack(), ["tool", "family"], jobs)
        assert bool(cells.beyond) == (most == 0) and bool(cells.held) == (most > 0)
        trees = grow_forests(spark, cells, jobs)
        assert {r.fit: r["n"] for r in trees.groupBy("fit").agg(F.count(F.lit(1)).alias("n")).collect()} == {j.fit: 40 for j in jobs}
        met = TT.meet_trees(flows.withColumn("fit", F.lit("full|1")), trees, ["x", "y", "z"], 2, TT.leaf_values(2), ["flow_id"])
        scores.append({r.flow_id: r.sums[1] / r.n_trees for r in met.collect()})
    a, b = (np.array([s[k] for k in sorted(scores[0])]) for s in scores)
    assert np.corrcoef(a, b)[0, 1] > 0.98 and abs(a - b).mean() < 0.05


def test_a_missing_number_keeps_a_feature_from_being_split_on(spark, flows):
    holed = flows.withColumn("z", F.when(F.col("flow_id") != "5", F.col("z")))
    cells = training_cells(holed, ["x", "y", "z"], attack(), ["tool", "family"], holdout_jobs())
    assert [len(c) for c in cells.prepared(holdout_jobs()[0])[0]] == [63, 63, 0]


def test_draws_of_cells_are_those_of_their_rows():
    rng = np.random.default_rng(3)
    times = np.array([1, 4, 50, 2_000])
    drawn = [_drawn(times, rng) for _ in range(4_000)]
    weight, met = (np.mean([d[i] for d in drawn], axis=0) / times for i in (0, 1))
    assert weight == pytest.approx(np.ones(4), abs=0.05) and met == pytest.approx(np.full(4, 1 - np.exp(-1)), abs=0.03)
    assert all(_drawn(np.array([1]), rng)[0][0] > 0 for _ in range(50))


def test_study_scores_rows_in_place(spark, flows, monkeypatch):
    """Held forests give the scores of forests as tables, for missing and infinite numbers too; a fit without trees gives none."""
    odd = spark.createDataFrame([(None, 1.0), (float("nan"), 2.0), (float("inf"), 3.0), (float("-inf"), None)], "x double, y double")
    rows = flows.select("x", "y").unionByName(odd).withColumn("id", F.monotonically_increasing_id())
    plan = spark.createDataFrame([("a", 20, 64, 1.0), ("b", 10, 256, 0.5)], "fit string, trees int, sample int, share double")
    both = flows.where(~attack()).withColumn("fit", F.explode(F.array(F.lit("a"), F.lit("b"))))
    trees, fits = ISO.grow_isolation_forests(both, plan, ["x", "y"], ["flow_id"]), ["a", "b", "none"]
    named = rows.withColumn("fit", F.explode(F.array(*[F.lit(f) for f in fits])))
    want = {(r.fit, r.id): r.anomaly_score for r in ISO.score_isolation_forests(named, trees, ["x", "y"], ["id"]).collect()}
    met = []
    monkeypatch.setattr(ISO, "meet_trees", lambda *a: met.append(a) or TT.meet_trees(*a))
    for most in (ISO.HELD_NODES, 0):
        monkeypatch.setattr(ISO, "HELD_NODES", most)
        got = {(r.fit, r.id): r.anomaly_score for r in ISO.score_all_settings(rows, trees, fits, ["x", "y"], ["id"]).collect()}
        assert got == {k: v if v is None else pytest.approx(v, abs=1e-9) for k, v in want.items()} and len(met) == (most == 0)
    assert {k[0] for k, v in want.items() if v is None} == {"none"}
    monkeypatch.undo()
    monkeypatch.setattr(ISO, "meet_trees", lambda *a: pytest.fail("rows were shuffled to the trees"))
    per, _ = ISO.isolation_study(flows.where(~attack()), flows, ["x", "y"], ["flow_id"], attack(), "tool", {"a": (10, 64, 1.0)})
    assert per.count() == 1

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.models import bundle as BU
from flowlens.models import cell_forest as C
from flowlens.models import forest as M
from flowlens.operators import features as FE

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def attacks(spark):
    rng = np.random.default_rng(3)
    fam = rng.integers(0, 3, 4000)
    x = np.round(rng.normal(size=(4000, 3)) + 1.5 * np.stack([fam == 0, fam == 1, fam == 2], axis=1), 2)
    rows = [(i, "xyz"[f], *map(float, v)) for i, (f, v) in enumerate(zip(fam, x, strict=True))]
    return spark.createDataFrame(rows, "id long, family string, a double, b double, c double").cache()


def plain_cut(codes, y, w, tries, min_rows, bins, classes):
    """The best Gini gain over all cuts, one by one."""
    gini = lambda m: (m ** 2).sum() / m.sum() if m.sum() else 0.0
    mass = lambda keep: np.bincount(y[keep], weights=w[keep], minlength=classes)
    best = (1e-9, -1, 0)
    for j in np.flatnonzero(tries):
        for c in range(bins - 1):
            a, b = mass(codes[:, j] <= c), mass(codes[:, j] > c)
            if min(a.sum(), b.sum()) >= max(min_rows, 1):
                gain = gini(a) + gini(b) - gini(a + b)
                if gain > best[0] + 1e-9:
                    best = (gain, j, c)
    return best


def test_best_cuts_agree_with_trying_every_cut():
    rng = np.random.default_rng(2)
    codes, y, w = rng.integers(0, 9, (300, 3)).astype(np.uint8), rng.integers(0, 4, 300), rng.integers(1, 4, 300).astype(float)
    node = rng.integers(0, 6, 300)
    tries = rng.random((6, 3)) < .7
    total = np.bincount(node * 4 + y, weights=w, minlength=24).reshape(6, 4)
    feature, cut, gain = C.best_cuts(node, codes, y, w, total, tries, 20, 9)
    for k in range(6):
        want = plain_cut(codes[node == k], y[node == k], w[node == k], tries[k], 20, 9, 4)
        assert (feature[k], gain[k]) == (want[1], pytest.approx(want[0]))
        assert want[1] < 0 or cut[k] == want[2]


def test_siblings_of_one_class_merge_and_leaves_hold_min_rows():
    rng = np.random.default_rng(4)
    codes, y, w = rng.integers(0, 16, (500, 4)).astype(np.uint8), rng.integers(0, 3, 500), rng.integers(1, 3, 500)
    tree = C.grow_cells(codes, y, w, 3, np.random.default_rng(1), 12, 5, 2, 16)
    small = C.merge_siblings(tree)
    for t in (tree, small):
        at = C.walk(t.feature, t.code, t.left, codes)
        mass = np.zeros_like(t.mass)
        np.add.at(mass, (at, y), w)
        leaf = t.left < 0
        assert np.array_equal(mass[leaf], t.mass[leaf]) and t.mass[leaf].sum(axis=1).min() >= 5
    says = small.mass.argmax(axis=1)
    ends = [a for a in small.left if a >= 0 and small.left[a] < 0 and small.left[a + 1] < 0]
    assert len(small.left) < len(tree.left) and ends and all(says[a] != says[a + 1] for a in ends)


def test_cells_count_every_row(spark, attacks):
    borders = C.feature_borders(attacks.withColumn("c", F.col("id") % 5), FEATURES, 16)
    assert borders[2].tolist() == [.5, 1.5, 2.5, 3.5] and all(len(b) <= 15 for b in borders)
    cells = C.binned_cells(attacks.withColumn("c", F.col("id") % 5).withColumn("y", F.ascii("family") - 120), FEATURES, "y", borders)
    assert cells.agg(F.sum("n")).first()[0] == 4000
    assert cells.groupBy("codes", "y").count().where("count > 1").count() == 0
    with pytest.raises(Exception, match="null or not a number"):
        C.binned_cells(attacks.withColumns({"a": F.lit(None).cast("double"), "y": F.lit(0)}), FEATURES, "y", borders).collect()


def test_forest_is_the_same_whatever_the_layout_and_grows_in_rounds(spark, attacks, monkeypatch):
    p = M.ForestParams(trees=12, depth=30, min_rows=2, features="sqrt")
    one = M.fit_family_forest(attacks, FEATURES, params=p)
    two = M.fit_family_forest(attacks.coalesce(1).repartition(3), FEATURES, params=p)
    assert [b.tolist() for b in one.model.borders] != [] and len(one.model.trees) == 12
    if all(np.array_equal(a, b) for a, b in zip(one.model.borders, two.model.borders, strict=True)):
        assert one.model.trees == two.model.trees
    monkeypatch.setattr(C, "TASK_CELLS", 300)
    monkeypatch.setattr(C, "BLOCK_CELLS", 700)
    rounds = M.fit_family_forest(attacks, FEATURES, params=p)
    assert len(rounds.model.trees) == 12

    def right(forest):
        names = F.array(*[F.lit(c) for c in forest.classes])
        probs = attacks.withColumn("p", forest.model.probabilities(attacks, FEATURES))
        total = F.aggregate("p", F.lit(0.0), lambda a, x: a + x)
        says = F.element_at(names, F.array_position("p", F.array_max("p")).cast("int"))
        return probs.agg(F.avg((says == F.col("family")).cast("double")), F.max(F.abs(total - 1))).first()

    a, b = right(one), right(rounds)
    assert a[0] > .8 and b[0] > .8 and abs(a[0] - b[0]) < .05 and max(a[1], b[1]) < 1e-9
    # every node of a tree put together from pieces is reached from its root, once
    for _, _, _, left, value in rounds.model.trees:
        left = np.frombuffer(left, np.int32)
        inner = left[left >= 0]
        assert sorted([0, *inner, *(inner + 1)]) == list(range(len(left)))
        shares = np.frombuffer(value, np.float64).reshape(-1, 3)
        assert len(shares) == len(left) and np.allclose(shares.sum(axis=1), 1)


def test_default_family_forest_ends_and_comes_back_from_its_bundle(spark, attacks, tmp_path):
    rows = attacks.unionByName(attacks.withColumns({"id": -F.col("id") - 1, "family": F.lit("BENIGN"), **{f: -2 - F.col(f) for f in FEATURES}}))
    spec = spark.createDataFrame([(i, f, -50.0, 50.0, False, None) for i, f in enumerate(FEATURES)], FE.SPEC_COLUMNS)
    made = BU.fit_bundle(rows, rows, spec, ["id"], 0.01, binary_params=M.ForestParams(trees=5, depth=5, min_rows=2, features="all"))
    assert len(made.family.model.trees) == M.FAMILY_PARAMS.trees
    path = str(tmp_path / "bundle")
    BU.save_bundle(made, path)
    again = BU.load_bundle(spark, path)
    assert again.family.model.trees == made.family.model.trees
    cols = ["id", "p_attack", "verdict", "fconf", "family_probs", "closest_family"]
    a, b = ({r["id"]: r for r in BU.detect(rows, x).select(*cols).collect()} for x in (made, again))
    assert a == b and len(a) == 8000


def test_scores_known_and_new_cells_alike(monkeypatch):
    rng = np.random.default_rng(6)
    trees = []
    for t in range(3):
        codes, y = rng.integers(0, 8, (400, 2)).astype(np.uint8), rng.integers(0, 2, 400)
        trees.append((t, *C.packed(C.grow_cells(codes, y, np.ones(400), 2, rng, 6, 2, 2, 8))))
    monkeypatch.setattr(C, "SEEN_CELLS", 20)
    scores, rows = C.Scores(trees, [np.arange(7.0)] * 2, 2), rng.integers(0, 8, (500, 2)).astype(np.uint8)
    want = scores.walked(rows)
    for lo in range(0, 500, 50):
        assert np.array_equal(scores.of(rows[lo:lo + 50]), want[lo:lo + 50])
    assert scores.of(rows[:0]).shape == (0, 2)

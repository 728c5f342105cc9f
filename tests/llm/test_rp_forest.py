import numpy as np
from brute import Groups

from flowlens.llm.rp_forest import near_vectors


def table(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)


def plain(x, least=0.95):
    x = np.asarray(x, dtype=np.float32).astype(np.float64)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= least
    groups = Groups(range(len(x)))
    for a, b in zip(*np.nonzero(linked), strict=True):
        groups.join(int(a), int(b))
    return {i: (int(linked[i].sum()) - 1, groups.find(i), groups.find(i) == i) for i in range(len(x))}


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(300, 32))
    x = np.concatenate([centers, centers[rng.integers(0, 300, 500)] + rng.normal(size=(500, 32)) * 0.22, np.repeat(centers[:2], 150, axis=0),
                        centers[5] + rng.normal(size=(300, 32)) * 0.1])
    want = plain(x)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(table(spark, x), leaf=64, block=100).collect()}
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(g[0] for g in got.values()) >= 0.97 * sum(w[0] for w in want.values())
    assert np.mean([got[i][1] == want[i][1] for i in want]) > 0.97


def test_blocks_are_exact(spark):
    """With a single leaf of many blocks every pair is met."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(150, 3))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(table(spark, x), leaf=1000, block=20, trees=1).collect()}
    assert got == plain(x)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], "x"), (2, [2.0, 0.0], "x"), (3, [1.0, 0.0], None), (3, [1.0, 0.0], None), (4, None, "x"), (5, [], "x"),
            (6, [0.0, 0.0], "x"), (7, [nan, 1.0], "x"), (8, [1.0, inf], "x"), (9, [1.0, None], "x"), (10, [1.0, 0.0, 0.0], "x"),
            (None, [1.0, 0.0], "x"), (12, [1e300, 1e290], "x"), (13, [1e-300, 0.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rep string")
    got = near_vectors(df).collect()
    assert len(got) == len(rows)
    assert {r.vec_id: r.n_links for r in got if r.vec_id} == {1: 4, 2: 4, 3: 4, 4: 0, 5: 0, 6: 0, 7: 0, 8: 0, 9: 0, 10: 0, 12: 4, 13: 4}
    assert {r.component_id for r in got if r.vec_id in (1, 2, 3, 12, 13)} == {1}
    assert near_vectors(df.limit(0)).count() == 0

"""The flow store reads only files that may hold an id; neighbours are exact without all pairs."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from flowlens.models import smote
from flowlens.models.smote import nearest_in_class
from flowlens.sources.flow_store import FlowStore, bloom_of, may_contain

START = dt.datetime(2026, 1, 1)
SCHEMA = "flow_id string, observed_at timestamp, v int"


def flows(spark, first, n, day, v=0):
    return spark.createDataFrame([(f"f{i}", START + dt.timedelta(days=day, seconds=i), v) for i in range(first, first + n)], SCHEMA)


def days_of(df):
    return {f.split("store_day=")[1].split("/")[0] for f in df.inputFiles()}


def test_bloom_filter_has_no_false_negative_and_few_false_positives():
    rng = np.random.default_rng(0)
    have, other = rng.integers(-2 ** 63, 2 ** 63 - 1, 5_000), rng.integers(-2 ** 63, 2 ** 63 - 1, 20_000)
    bits = bloom_of(have)
    assert may_contain(bits, have).all() and may_contain(bits, other).mean() < 0.03
    assert not may_contain(bloom_of(have[:0]), other).any()


def test_batches_read_only_the_days_of_ids_they_bring_again(spark, tmp_path):
    store = FlowStore(str(tmp_path / "s"), buckets=4)
    for day in range(3):
        store.sink(flows(spark, 1000 * day, 50, day), day)
    assert store.known_rows(flows(spark, 1000, 5, 9), 3) is not None
    assert days_of(store.known_rows(flows(spark, 1000, 5, 9), 3)) == {"2026-01-02"}
    # ids nobody has seen: at most a chance hit, here none
    assert store.known_rows(flows(spark, 77_000, 3, 9), 3) is None
    store.sink(flows(spark, 1000, 60, 9, v=1), 3)
    rows = {r.flow_id: r.v for r in store.read(spark).collect()}
    assert len(rows) == 160 and sum(rows.values()) == 10 and store.read(spark).columns == ["flow_id", "observed_at", "v"]


def test_a_batch_that_runs_again_adds_nothing(spark, tmp_path):
    store = FlowStore(str(tmp_path / "s"), buckets=4)
    store.sink(flows(spark, 0, 20, 0), 0)
    for _ in range(2):
        store.sink(flows(spark, 10, 20, 1), 1)
        assert store.read(spark).count() == 30 and store.last_batch(spark) == 1
    # a batch that was written but never committed is not read, and is replaced
    spark.createDataFrame([("lost", START, 1, 0, "x")], SCHEMA + ", store_bucket int, store_day string").write.partitionBy("store_day").parquet(
        str(tmp_path / "s" / "store_batch=2"))
    assert store.read(spark).where("flow_id = 'lost'").isEmpty()
    store.sink(flows(spark, 25, 10, 2), 2)
    assert store.read(spark).count() == 35


def test_first_delivery_wins_and_null_times_are_kept(spark, tmp_path):
    store = FlowStore(str(tmp_path / "s"))
    later = START + dt.timedelta(hours=1)
    store.sink(spark.createDataFrame([("a", later, 2), ("a", START, 1), ("b", None, 3)], SCHEMA), 0)
    store.sink(spark.createDataFrame([("a", START - dt.timedelta(days=3), 9), ("b", START, 9), ("c", START, 4)], SCHEMA), 1)
    assert {(r.flow_id, r.v) for r in store.read(spark).collect()} == {("a", 1), ("b", 3), ("c", 4)}


def brute(rows, k):
    out = {}
    for label, i, v in rows:
        d = sorted((float(np.sqrt(((np.array(w) - np.array(v)) ** 2).sum())), j) for m, j, w in rows if m == label and j != i)[:k]
        out[label, i] = [(j, round(x, 9)) for x, j in d]
    return out


def found(df):
    out = {}
    for r in df.orderBy("label", "id", "rank").collect():
        out.setdefault((r.label, r.id), []).append((r.near, round(r.dist, 9)))
    return out


def test_neighbours_are_exact_on_ties_copies_and_tiny_classes(spark):
    rng = random.Random(2)
    rows = [("grid", f"g{i}", [float(i % 7), float(i // 7 % 5)]) for i in range(100)]  # ties and copies everywhere
    rows += [("far", f"r{i}", [rng.gauss(0, 1) * 10 ** rng.randint(0, 4), rng.gauss(0, 1)]) for i in range(80)]
    rows += [("one", "x", [1.0, 2.0]), ("two", "y", [0.0, 0.0]), ("two", "z", [0.0, 0.0])]
    df = spark.createDataFrame(rows, "label string, id string, vec array<double>").repartition(3)
    want = {key: near for key, near in brute(rows, 3).items() if near}
    assert found(nearest_in_class(df, 3, block_rows=16)) == want
    assert nearest_in_class(df.limit(0), 3).count() == 0


def test_points_travel_once_per_group_of_cells(spark, monkeypatch):
    """Groups of several cells, cells cut into parts and one group of all give the same neighbours."""
    rng = random.Random(5)
    rows = [("a", f"a{i}", [rng.gauss(0, 1) for _ in range(6)]) for i in range(120)]
    rows += [("b", f"b{i}", [float(i % 3) * 100 + rng.random(), 0.0, 0.0, 0.0, 0.0, rng.random()]) for i in range(90)]
    df = spark.createDataFrame(rows, "label string, id string, vec array<double>")
    want = brute(rows, 4)
    for size in (8, 40, 1_000_000):
        monkeypatch.setattr(smote, "GROUP_ROWS", size)
        assert found(nearest_in_class(df, 4, block_rows=8)) == want


def test_clustered_points_are_compared_with_few(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 100, (40, 8))
    x = centres[rng.integers(0, 40, 2_000)] + rng.normal(0, 1, (2_000, 8))
    rows = [("c", f"p{i:05d}", v.tolist()) for i, v in enumerate(x)]
    looked = spark.sparkContext.accumulator(0)
    got = found(nearest_in_class(spark.createDataFrame(rows, "label string, id string, vec array<double>"), 5, looked=looked))
    assert 0 < looked.value < 0.1 * 2_000 * 1_999
    d = np.sqrt(((x[:30, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    for i in range(30):
        order = [j for j in np.argsort(d[i], kind="stable") if j != i][:5]
        assert [n for n, _ in got["c", f"p{i:05d}"]] == [f"p{j:05d}" for j in order]


def test_points_that_rule_nothing_out_meet_as_matrices(spark, monkeypatch):
    """No point is looked at by itself then; distances are those of plain numpy, ties go by id, also far from the origin."""
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(0, 1, (500, 40)), 1e7 + np.round(rng.normal(0, 1, (300, 40))), np.sign(rng.normal(0, 1, (200, 40)))])
    labels = ["plain"] * 500 + ["far"] * 300 + ["signs"] * 200
    rows = [(c, f"p{i}", v.tolist()) for i, (c, v) in enumerate(zip(labels, x, strict=True))]
    df = spark.createDataFrame(rows, "label string, id string, vec array<double>")
    alone = spark.sparkContext.accumulator(0)
    plain = smote._nearest

    def counted(label, ids, *more):
        alone.add(len(ids))
        return plain(label, ids, *more)

    want = brute(rows, 4)
    monkeypatch.setattr(smote, "_nearest", counted)
    for size in (64, 16_384):
        monkeypatch.setattr(smote, "GROUP_ROWS", size)
        monkeypatch.setattr(smote, "DENSE_NUMBERS", size * 7)
        monkeypatch.setattr(smote, "EXACT_PAIRS", 97)
        alone.value = 0
        assert found(nearest_in_class(df, 4, block_rows=64)) == want
        assert alone.value < 0.1 * len(rows)


def test_matrices_and_rows_one_by_one_find_the_same():
    rng = np.random.default_rng(8)
    x = np.concatenate([np.round(rng.normal(0, 2, (300, 3))), rng.normal(0, 1e5, (100, 3)), 1e9 + rng.normal(0, 1e-3, (100, 3))])
    names = np.array([f"n{i % 490}" for i in rng.permutation(500)], dtype=object)  # ten ids come twice
    bound = rng.choice([0.5, 3.0, np.inf], 500)
    but = np.array([[0, 0], [40, 90]])[rng.integers(0, 2, 500)]
    spans = [[(0, a), (b, 500)] for a, b in but]
    rows, _ = smote._nearest("c", list(names), x, names, x, spans, 6)
    i, j, d = smote._nearest_of_all(list(names), x, bound, but, names, x, 6)
    got = sorted(zip(names[i], names[j], d.tolist(), strict=True))
    allowed = {}
    for name, b in zip(names, bound, strict=True):
        allowed.setdefault(name, []).append(b)
    once = {n for n, b in allowed.items() if len(b) == 1}
    assert [g for g in got if g[0] in once] == sorted((a, b, c) for _, a, b, c in rows if a in once and c <= allowed[a][0])


def test_oversampling_looks_up_neighbours_by_matrices(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [("a", f"a{i}", v.tolist()) for i, v in enumerate(rng.normal(0, 1, (400, 30)))]
    alone = spark.sparkContext.accumulator(0)
    plain = smote._nearest

    def counted(label, ids, *more):
        alone.add(len(ids))
        return plain(label, ids, *more)

    monkeypatch.setattr(smote, "_nearest", counted)
    made = smote.smote(spark.createDataFrame(rows, "label string, id string, vec array<double>"), 600, 3).collect()
    near = brute(rows, 3)
    assert len(made) == 200 and all(r.near in {n for n, _ in near["a", r.base]} for r in made)
    assert alone.value == 0

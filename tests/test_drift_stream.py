"""Rolling drift as a stream: same checks as over the whole table, bounded state, replayed batches."""

import random

import pytest
from pyspark.sql import functions as F

from flowlens.operators import drift as DR
from flowlens.session import fresh_path
from flowlens.streaming.drift_store import RollingDriftStore

WINDOW, EVERY, MINIMUM = 40, 10, 20


@pytest.fixture(scope="module")
def flows(spark):
    """A third of the flows come in one long attack, in which no check sees a new benign flow; null verdicts too."""
    rng = random.Random(7)
    rows = []
    for i in range(300):
        verdict = "known_attack" if 100 <= i < 200 else rng.choice(["benign", "benign", "benign", "suspicious", None])
        rows.append((i, verdict, rng.choice([rng.gauss(i / 90, 1), None, float("nan"), float("inf")]) if i % 9 == 0 else rng.gauss(i / 90, 1)))
    df = spark.createDataFrame(rows, "id long, verdict string, x double")
    ref = DR.build_reference(spark.createDataFrame([(rng.gauss(0, 1),) for _ in range(200)], "x double"), ["x"])
    return df, ref


def listed(df):
    return sorted((r.checkpoint, r.window_size, round(r.attack_rate, 9), r.feature, round(r.psi, 9)) for r in df.collect())


def batch(flows):
    df, ref = flows
    return listed(DR.rolling_drift(df, ref, ["id"], window=WINDOW, every=EVERY, minimum=MINIMUM))


def store(spark):
    return RollingDriftStore(fresh_path(spark, "drift"), ["id"], window=WINDOW, every=EVERY, minimum=MINIMUM)


@pytest.mark.parametrize("cuts", [(7, 163, 300)])
def test_stream_that_is_started_again_equals_the_table(spark, flows, cuts):
    df, ref = flows
    path, own, last = fresh_path(spark, "in"), store(spark), 0
    for cut in cuts:
        df.where(F.col("id").between(last, cut - 1)).write.mode("append").parquet(path)
        got = own.run_available(spark.readStream.schema(df.schema).parquet(path), ref)
        last = cut
    assert listed(got) == batch(flows) and len(listed(got)) > 20


def test_a_batch_that_runs_again_changes_nothing_and_the_state_is_bounded(spark, flows):
    df, ref = flows
    own = store(spark)
    for i in range(3):
        part = df.where(F.floor(F.col("id") / 100) == i)
        own.sink(part, ref, i)
        own.sink(part, ref, i)
        assert spark.read.parquet(own._place(i)).count() <= 2 * WINDOW
    assert listed(own.snapshots(spark)) == batch(flows)
    with pytest.raises(RuntimeError):
        own.sink(df, ref, 9)

"""Recalibrated periods are rescored, and replay counters carry the rate."""

import datetime as dt

from pyspark.sql import functions as F

from flowlens.models.recalibration import recalibrate
from flowlens.streaming import jobs as J

START = dt.datetime(2026, 1, 1)


def test_every_period_is_rescored_by_its_own_forest(spark):
    rows = []
    for period, level in (("a", 0.0), ("b", 1000.0)):  # the second period lies far from the first
        for i in range(1000):
            attack = i % 10 == 9
            x = level + (i * 37 % 101) / 10 + (500.0 if attack else 0.0)
            rows.append((period, i + (10_000 if period == "b" else 0), START + dt.timedelta(seconds=i), x, (i * 7 % 100) / 200 + 0.5 * attack, attack))
    rows.append(("c", 50_000, START, 1.0, 0.9, True))  # no benign row
    df = spark.createDataFrame(rows, "period string, id long, ts timestamp, x double, p double, attack boolean")
    attack = F.col("attack")
    got = {r.period: r for r in recalibrate(df, "period", "ts", ["x"], ["id"], attack, ~attack, F.lit(False), "p", 0.05, trees=50, sample=128).collect()}
    for period in "ab":
        window = sorted(r[4] for r in rows if r[0] == period and r[2] < START + dt.timedelta(microseconds=int(0.2 * 999e6)) and not r[5])
        r = got[period]
        assert (r.n, r.n_window, r.tau_binary) == (1000, len(window), window[len(window) - 1 - int(0.05 * len(window))])
        assert r.recall == 1.0 and r.benign_fpr < 0.1 and r.benign_flagged_anomaly < 0.1 and 0 < r.tau_anomaly < 1
    assert got["c"].n == 1 and got["c"].tau_binary is None and got["c"].recall is None


def test_replay_counters_carry_times_and_rate(spark):
    rows = [(START + dt.timedelta(seconds=5 * i), "DoS", "known_attack") for i in range(5)]
    df = spark.createDataFrame(rows, "ts timestamp, ground_truth string, verdict string")
    r = J.stream_replay_metrics(df, ts="ts").head()
    assert (r.flows, r.tp, r.first_ts, r.last_ts, r.flows_per_s) == (5, 5, rows[0][0], rows[-1][0], 0.25)
    assert J.stream_replay_metrics(df.limit(1), ts="ts").head().flows_per_s is None

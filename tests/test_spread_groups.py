"""Order statistics and rank correlations whose rows never meet by group."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowlens.operators import features as FE
from flowlens.plans import recipes as R
from flowlens.session import fresh_path

PROBS = {"a": 0.1, "b": 0.5}


def table(spark, n=900):
    rng = np.random.default_rng(3)
    rows = [("hot" if i % 3 == 0 else f"k{i % 5}", float(x), float(i % 4), float(x) ** 3 + i % 2) for i, x in enumerate(rng.normal(size=n))]
    rows += [(None, 1.0, None, 2.0), ("k1", math.nan, 1.0, math.inf), ("k1", None, -0.0, 0.0)]
    return spark.createDataFrame(rows, "k string, v double, few double, cube double")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_rows_of_a_group_are_not_dealt_by_group(spark, keys):
    q = R.quantiles(table(spark), ["v", "few"], PROBS, keys=keys, buckets=16, groups=7 if keys else None)
    assert plan(q).count("rightHint=(strategy=broadcast)") == 2


def test_many_or_unknown_groups_are_joined_by_salt(spark):
    df = table(spark)
    want = {(r["k"], r["feature"]): r[2:] for r in R.quantiles(df, ["v", "few"], PROBS, keys=["k"], groups=7).collect()}
    q = R.quantiles(df, ["v", "few"], PROBS, keys=["k"])
    assert "strategy=broadcast" not in plan(q) and "_salt" in plan(q)
    assert {(r["k"], r["feature"]): r[2:] for r in q.collect()} == want


def test_running_totals_compute_their_rows_once(spark):
    path = fresh_path(spark, "source")
    table(spark).write.parquet(path)
    out = R.running_totals(spark.read.parquet(path).where("not isnan(v)"), "v", {"n": F.count(F.lit(1))})
    assert out.inputFiles() and not any(path in f for f in out.inputFiles())


@pytest.mark.parametrize("broadcast", [0, 10, 100_000])
def test_rank_correlation_by_any_route(spark, monkeypatch, broadcast):
    monkeypatch.setattr(FE, "RANKS_BROADCAST", broadcast)
    df, cols = table(spark).withColumn("fixed", F.lit(2.0)), ["v", "few", "cube", "fixed"]
    x = pd.DataFrame([r.asDict() for r in df.select(*cols).collect()], columns=cols).replace([math.inf, -math.inf], math.nan).fillna(0.0)
    want = x.rank().corr().abs()
    got = {(r["feature_a"], r["feature_b"]): r["rho"] for r in FE.spearman_matrix(df, cols).collect()}
    assert len(got) == 16
    for a in cols:
        for b in cols:
            if a != b and "fixed" in (a, b):
                assert math.isnan(got[a, b])
            elif a == b:
                assert got[a, b] == 1.0
            else:
                assert got[a, b] == pytest.approx(want.loc[a, b], abs=1e-9)


def test_cells_with_few_values_are_not_shuffled(spark):
    rows = table(spark).select(*[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("few", "few")]).toDF("a", "b")
    ranks = R.written(FE._mean_ranks(rows, ["a", "b"]), "ranks")
    vectors, order = FE._rank_vectors(rows, ["a", "b"], ranks)
    assert order == [0, 1] and plan(vectors).count("strategy=broadcast") == 2
    assert "Aggregate" not in plan(vectors)


def test_the_largest_feature_is_folded_by_value(spark, monkeypatch):
    monkeypatch.setattr(FE, "RANKS_BROADCAST", 100)
    rows = table(spark).select(*[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("v", "few")]).where("not isnan(v)")
    ranks = R.written(FE._mean_ranks(rows, ["v", "few"]), "ranks")
    vectors, order = FE._rank_vectors(rows, ["v", "few"], ranks)
    assert order == [1, 0] and vectors.columns == ["_v", "_f"] and "Aggregate" not in plan(vectors)


def test_a_spec_takes_its_quantiles_from_one_count(spark, monkeypatch):
    rows = [(i % 3 if i % 50 else None, float(i * i % 97), float(i % 7) if i % 5 else None, -float(i) if i % 11 else math.nan) for i in range(400)]
    df, cols = spark.createDataFrame(rows, "g int, a double, b double, c double"), ["a", "b", "c"]
    calls = []
    monkeypatch.setattr(FE, "quantiles", lambda *a, **k: calls.append(a))
    got = {r["name"]: r for r in FE.build_feature_spec(df, cols, "g").features.collect()}
    assert sorted(got) == cols and not calls
    x = pd.DataFrame(rows, columns=["g", *cols])
    for c in cols:
        assert got[c]["train_median"] == x[c].median()
        per = x.groupby("g")[c]
        assert got[c]["clip_lo"] == pytest.approx(per.quantile(0.0001).min()) and got[c]["clip_hi"] == pytest.approx(per.quantile(0.9999).max())

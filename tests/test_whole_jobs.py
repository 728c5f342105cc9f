"""Registered model queries run the whole job of their operators."""

import os

from pyspark.sql import functions as F

from flowlens.catalog import models as CM
from flowlens.catalog import sources as CS
from flowlens.models import forest as M
from flowlens.models import tuning as T
from flowlens.plans import bindings as B
from flowlens.sources import stores as S

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TOOLS = ["error", "purchase", "signup"]
UNITS = [("family", f) for f in ("Botnet", "BruteForce", "DoS")] + [("tool", t) for t in TOOLS]


def test_every_attack_family_and_tool_is_a_unit(spark):
    assert CM.attack_units(B.flows(spark, SF), "family", "tool") == UNITS


def test_operators_are_called_with_their_defaults(spark, monkeypatch):
    asked = {}

    def tune(train, val, features, tools, **more):
        asked["tune"] = (tools, more)
        one = spark.range(1).select(F.lit("c").alias("config"), F.lit(1).alias("rank"), F.lit(0.0).alias("objective"), F.lit(0.0).alias("tie_break"))
        return one, one

    def run_holdouts(train, val, test, units, setting, **more):
        asked["holdouts"] = (units, setting, more)
        return spark.range(1).select(*[F.lit(0).alias(c) for c in (
            "unit", "seed", "budget", "n_held_out", "recall", "recall_seen_ceiling", "benign_fpr", "familiar_attack_recall")])

    held = []

    def ablation(train, test, variants, params, **more):
        held.append((len(variants), params, more.get("held_tool")))
        return spark.range(1).select(*[F.lit(0).alias(c) for c in ("variant", "features", "recall", "worst_recall", "held_recall")])

    for name, f in (("tune", tune), ("run_holdouts", run_holdouts), ("ablation", ablation)):
        monkeypatch.setattr(T, name, f)
    assert {r["run"] for r in CM.a12_tune(spark, SF).collect()} == {"search", "confirm"}
    assert asked["tune"] == (TOOLS, {})
    CM.a11_run_holdouts(spark, SF)
    assert asked["holdouts"] == (UNITS, T.Setting(CM.FEATURES, M.ForestParams(), M.FAMILY_PARAMS), {})
    CM.a13_ablation(spark, SF)
    assert held == [(len(CM.FEATURES) + 1, M.ForestParams(), t) for t in [None, *TOOLS]]


def test_every_file_is_hashed_and_verified(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(S, "verify_manifest", lambda listed, have: asked.extend([listed, have]) or have)
    CS.s9_manifest_verify(spark, SF)
    every = {f for f in os.listdir(SF) if f.endswith(".parquet")}
    listed, have = ({r["name"] for r in df.collect()} for df in asked)
    assert listed == every - {"nation.parquet"} and have == every - {"customer.parquet"}

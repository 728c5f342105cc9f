"""Random search, hold-out runs and ablations: lists of forests grown side by side and judged in one plan each."""

from __future__ import annotations

import json
import random
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens import constants as K
from flowlens.models.forest import ForestParams
from flowlens.models.growing import Job, grow_forests, training_cells, training_sample
from flowlens.models.tree_tables import leaf_values, meet_trees
from flowlens.operators.decide import budget_scores
from flowlens.operators.evaluate import holdout_reports
from flowlens.plans.recipes import number_rows
from flowlens.session import written

def _attack():
    return F.col("family") != "BENIGN"


def rank_configs(results: DataFrame, config: str, main: str, tie: str) -> DataFrame:
    """Configurations by mean objective over their units, then by the tie-break, then by name.

    Ranks are row numbers of a range sort, so any number of configurations may be ranked.
    """
    per = results.groupBy(config).agg(
        F.round(F.avg(main), 6).alias("objective"), F.round(F.avg(tie), 6).alias("tie_break"))
    ordered = per.withColumns({"_o": -F.coalesce("objective", F.lit(-1.0)), "_t": -F.coalesce("tie_break", F.lit(-1.0))})
    return number_rows(ordered, ["_o", "_t", config], "rank").select(
        config, "objective", "tie_break", (F.col("rank") + 1).cast("int").alias("rank"))


@dataclass
class Setting:
    """Columns and sizes shared by repeated fits."""

    features: Sequence[str]
    binary: ForestParams
    family: ForestParams


def _job(fit: str, label: str, p: ForestParams, seed: int, features: Sequence[str], **more) -> Job:
    return Job(fit, label, p.trees, p.depth, p.min_rows, p.features, seed, tuple(features), bins=p.bins, **more)


def _with_fit(rows: DataFrame, fits: DataFrame) -> DataFrame:
    """Every row once per run; ``fits`` is a handful of rows (one per forest asked for)."""
    names = [c for c in fits.columns]
    listed = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r, strict=True)]) for r in fits.collect()])
    return rows.withColumn("_run", F.explode(listed)).select(*rows.columns, *[F.col(f"_run.{n}").alias(n) for n in names])


def _attack_scores(rows: DataFrame, trees: DataFrame, features: Sequence[str], ids: Sequence[str], out: str) -> DataFrame:
    met = meet_trees(rows, trees, features, 2, leaf_values(2), ids, "_sums")
    share = F.try_divide(F.element_at("_sums", 2), F.col("n_trees").cast("double"))
    return met.withColumn(out, F.coalesce(share, F.lit(0.0))).drop("_sums", "n_trees")


# scores of cells (cells x runs) that may be broadcast
SCORES_BROADCAST = 1_000_000


def _with_cell(rows: DataFrame, trees: DataFrame, features: Sequence[str]) -> DataFrame:
    """Add ``_cell``: rows with the same one lie between the same thresholds of all trees, so every tree leads them to the same leaf.

    The thresholds are bounded by the bins of the forests and pass through the driver.
    """
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            feature, at = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("feature", "threshold"))
            for j in np.unique(feature[feature >= 0]):
                found = np.unique(at[feature == j])
                yield pa.RecordBatch.from_pydict({"feature": pa.array(np.full(len(found), j), pa.int32()), "threshold": pa.array(found, pa.float64())})

    cuts = trees.select("feature", "threshold").mapInArrow(pairs, "feature int, threshold double").distinct()
    borders = [np.zeros(0)] * len(features)
    for r in cuts.groupBy("feature").agg(F.array_sort(F.collect_list("threshold")).alias("at")).collect():
        borders[r["feature"]] = np.array(r["at"])

    @F.pandas_udf("binary")
    def cell(*columns: pd.Series) -> pd.Series:
        # x <= threshold goes left; a missing number goes right everywhere, as the largest do
        codes = [np.searchsorted(b, c.to_numpy(dtype=np.float64), side="left") for b, c in zip(borders, columns, strict=True)]
        return pd.Series([r.tobytes() for r in np.stack(codes, axis=1).astype("<u4")])

    return rows.withColumn("_cell", cell(*[F.col(f) for f in features]))


def run_holdouts(
    train: DataFrame, val: DataFrame, evaluation: DataFrame, units: Sequence[tuple[str, str]], setting: Setting,
    seeds: Sequence[int] = (7, 8, 9), budgets: Sequence[float] = tuple(K.HOLDOUT_BUDGETS), ids: Sequence[str] = ("flow_id",),
) -> DataFrame:
    """Refit both heads without each unit (column, value) and report how the unit is then treated.

    One model with everything per seed gives the ceiling. Rows need family, tool and the weight ``w``. All forests of all
    seeds and units grow in one job from all rows of ``train``, counted by their bins (see growing); every row of ``val`` and
    ``evaluation`` is scored, rows that no tree can tell apart once (see :func:`_with_cell`).
    Output: unit, seed and the hold-out report columns, a row per budget; :func:`aggregate_seeds` sums it up.
    """
    spark, features = train.sparkSession, list(setting.features)
    jobs = []
    for seed in seeds:
        jobs.append(_job(f"full|{seed}", "attack", setting.binary, seed, features))
        for i, unit in enumerate(units):
            jobs.append(_job(f"binary|{i}|{seed}", "attack", setting.binary, seed, features, without=unit))
            jobs.append(_job(f"family|{i}|{seed}", "family", setting.family, seed, features, without=unit, attacks_only=True))
    cells = training_cells(train, features, _attack(), ["family", "tool"], jobs)
    trees = grow_forests(spark, cells, jobs)
    classes = len(cells.classes(_job("", "family", setting.family, 0, features, attacks_only=True)))

    rows = val.withColumn("_part", F.lit("val")).unionByName(evaluation.withColumn("_part", F.lit("eval")))
    rows = rows.select("_part", "family", "tool", "w", *[F.col(f).cast("double").alias(f) for f in features])
    rows = written(_with_cell(rows, trees, features), "holdout_rows")
    cells = rows.groupBy("_cell").agg(*[F.min(f).alias(f) for f in features])
    cells = _with_fit(cells, spark.createDataFrame([(s, f"full|{s}") for s in seeds], "seed int, fit string"))
    cells = _attack_scores(cells, trees, features, ["_cell"], "p_full").drop("fit")
    cells = cells.withColumn("_unit", F.explode(F.sequence(F.lit(0), F.lit(len(units) - 1))))
    name = F.concat(F.col("_unit").cast("string"), F.lit("|"), F.col("seed").cast("string"))
    cells = _attack_scores(cells.withColumn("fit", F.concat(F.lit("binary|"), name)), trees, features, ["_cell"], "p")
    cells = meet_trees(cells.withColumn("fit", F.concat(F.lit("family|"), name)), trees, features, classes, leaf_values(classes), ["_cell"], "_sums")
    cells = cells.withColumn("fconf", F.try_divide(F.array_max("_sums"), F.col("n_trees").cast("double")))
    cells = written(cells.groupBy("_cell").agg(F.collect_list(F.struct("_unit", "seed", "p", "fconf", "p_full")).alias("_runs")), "cell_scores")
    few = cells.count() * len(units) * len(seeds) <= SCORES_BROADCAST
    rows = rows.join(F.broadcast(cells) if few else cells, "_cell")
    rows = rows.select("_part", "family", "tool", "w", F.explode("_runs").alias("_run")).select("_part", "family", "tool", "w", "_run.*")
    held = F.element_at(F.array(*[F.coalesce(F.col(c) == v, F.lit(False)) for c, v in units]), F.col("_unit") + 1)
    named = F.element_at(F.array(*[F.lit(v) for _, v in units]), F.col("_unit") + 1)
    scored = written(rows.select("_part", "_unit", named.alias("unit"), "seed", held.alias("_held"), "family", "w", "p", "fconf", "p_full"), "holdouts")
    return holdout_reports(scored.where("_part = 'val'"), scored.where("_part = 'eval'"), ["_unit", "unit", "seed"], "_held", budgets).drop("_unit")


# values a tuned setting may take (fixed values)
SEARCH_SPACE = {
    "depth": [10, 16, 24, 30],
    "min_rows": [1, 2, 5, 20, 100],
    "features": ["sqrt", "0.2", "0.5"],
    "balanced": [False, True],
}
DEFAULT_CONFIG = {"depth": 30, "min_rows": 2, "features": "sqrt", "balanced": True}


def random_configs(n: int, seed: int = 7) -> list[dict]:
    """The default setting and ``n`` distinct random ones."""
    rng = random.Random(seed)
    found = [dict(DEFAULT_CONFIG)]
    every = 1
    for v in SEARCH_SPACE.values():
        every *= len(v)
    while len(found) < min(n + 1, every):
        c = {k: rng.choice(v) for k, v in SEARCH_SPACE.items()}
        if c not in found:
            found.append(c)
    return found


def _unit_recalls(
    train: DataFrame, val: DataFrame, features: Sequence[str], tools: Sequence[str], configs: Sequence[dict], trees: int,
    seeds: Sequence[int], budgets: tuple[float, float], ids: Sequence[str],
) -> DataFrame:
    """``config, unit, seed, main, tie``: recall on each tool by the forest that never saw it, at both budgets.

    All configurations, tools and seeds are one list of forests over one sample. Benign validation rows meet every forest,
    attack rows only those that left their tool out.
    """
    spark = train.sparkSession
    sample = training_sample(train, list(features), _attack(), ["tool"], ids)
    runs = [(f"{i}|{j}|{s}", json.dumps(c, sort_keys=True), tool, s)
            for i, c in enumerate(configs) for j, tool in enumerate(tools) for s in seeds]
    jobs = [Job(fit, "attack", trees, c["depth"], c["min_rows"], c["features"], seed, tuple(features), ("tool", tool), c["balanced"])
            for (fit, _, tool, seed), c in zip(runs, [c for c in configs for _ in tools for _ in seeds], strict=True)]
    grown = grow_forests(spark, sample, jobs)
    listed = spark.createDataFrame(runs, "fit string, config string, unit string, seed int")
    rows = val.select(*ids, "tool", (~_attack()).alias("_benign"), *[F.col(f).cast("double").alias(f) for f in features])
    rows = _with_fit(rows, listed.select("fit", "unit")).where(F.col("_benign") | (F.col("tool") == F.col("unit")))
    scored = written(_attack_scores(rows, grown, features, ids, "p").select("fit", "_benign", "p"), "search")
    cuts = budget_scores(scored.where("_benign"), "p", budgets, ["fit"]).groupBy("fit").agg(*[
        F.max(F.when(F.col("budget") == float(b), F.col("score"))).alias(f"_cut{i}") for i, b in enumerate(budgets)])
    hits = scored.where("not _benign").join(cuts, "fit").groupBy("fit").agg(*[
        F.avg((F.col("p") > F.col(f"_cut{i}")).cast("double")).alias(n) for i, n in enumerate(("main", "tie"))])
    return written(listed.join(hits, "fit", "left").select("config", "unit", "seed", "main", "tie"), "recalls")


def tune(
    train: DataFrame, val: DataFrame, features: Sequence[str], tools: Sequence[str], n: int = 10, trees: int = 60,
    seed: int = 7, confirm_seeds: Sequence[int] = (8, 9),
    budgets: tuple[float, float] = (0.0005, 0.0001), ids: Sequence[str] = ("flow_id",),
) -> tuple[DataFrame, DataFrame]:
    """Random search for unseen-tool recall: (ranking of all tried, ranking of the best three and the default on new seeds).

    A tool without validation rows counts for no configuration.
    """
    ranked = rank_configs(_unit_recalls(train, val, features, tools, random_configs(n, seed), trees, [seed], budgets, ids), "config", "main", "tie")
    best = [json.loads(r["config"]) for r in ranked.where("rank <= 3").orderBy("rank").collect()]
    best += [c for c in [DEFAULT_CONFIG] if c not in best]
    again = _unit_recalls(train, val, features, tools, best, trees, list(confirm_seeds), budgets, ids)
    return ranked, rank_configs(again, "config", "main", "tie")


def ablation(
    train: DataFrame, evaluation: DataFrame, variants: dict[str, Sequence[str]], params: ForestParams,
    budget: float = 0.001, seed: int = 7, held_tool: str | None = None, minimum: int = K.LOW_SUPPORT, ids: Sequence[str] = ("flow_id",),
) -> DataFrame:
    """Refit per feature variant: recall at the budget and the worst tool with at least ``minimum`` rows.

    With ``held_tool`` the tool is left out of training and its recall reported. All variants grow in one job.
    """
    spark = train.sparkSession
    features = list(dict.fromkeys(f for fs in variants.values() for f in fs))
    sample = training_sample(train, features, _attack(), ["tool"], ids)
    without = ("tool", held_tool) if held_tool is not None else None
    grown = grow_forests(spark, sample, [_job(v, "attack", params, seed, fs, without=without) for v, fs in variants.items()])
    listed = spark.createDataFrame([(v, len(fs)) for v, fs in variants.items()], "fit string, features int")
    rows = evaluation.select(*ids, "tool", _attack().alias("_attack"), *[F.col(f).cast("double").alias(f) for f in features])
    rows = _attack_scores(_with_fit(rows, listed.select("fit")), grown, features, ids, "p")
    scored = written(rows.select("fit", "tool", "_attack", "p"), "ablation")
    cuts = budget_scores(scored.where("not _attack"), "p", [budget], ["fit"]).select("fit", F.col("score").alias("_cut"))
    per = scored.where("_attack").join(cuts, "fit").groupBy("fit", "tool").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("p") > F.col("_cut")).alias("hits"))
    recall = F.col("hits") / F.col("n")
    worst = F.min(F.when(F.col("n") >= minimum, F.struct(recall.alias("recall"), F.col("tool").alias("tool"))))
    found = per.groupBy("fit").agg((F.sum("hits") / F.sum("n")).alias("recall"), worst.alias("_worst"),
                                   F.max(F.when(F.col("tool") == F.lit(held_tool), recall)).alias("held_recall"))
    return listed.join(found, "fit", "left").select(
        F.col("fit").alias("variant"), "features", F.coalesce("recall", F.lit(0.0)).alias("recall"),
        F.col("_worst.tool").alias("worst_tool"), F.col("_worst.recall").alias("worst_recall"), "held_recall")

"""Isolation forest: trees grown one per task from hashed subsamples, scored in Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions.exprs import wilson
from flowlens.models.tree_tables import TREE_COLUMNS, leaf_values, meet_trees
from flowlens.operators.evaluate import ranking_quality
from flowlens.plans.recipes import hash01, quantiles
from flowlens.session import written

TREE_SCHEMA = (
    "tree int, feature array<int>, threshold array<double>, left array<int>, right array<int>, size array<int>")
NODES_PER_PASS = 2_000_000
HELD_NODES = 8_000_000


@dataclass
class IsolationForest:
    """Grown trees (one row of node arrays each), feature order and mean subsample size."""

    trees: list
    features: list[str]
    sample: float


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search in a tree of n rows."""
    n = np.asarray(n, dtype=float)
    big = 2.0 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2.0 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, big, np.where(n == 2, 1.0, 0.0))


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int, among: np.ndarray | None = None) -> dict[str, list]:
    """One tree; ``among`` names the features it may split on (all when not given)."""
    nodes: dict[str, list] = {"feature": [], "threshold": [], "left": [], "right": [], "size": []}

    def leaf(size: int) -> int:
        for key, v in (("feature", -1), ("threshold", 0.0), ("left", -1), ("right", -1), ("size", size)):
            nodes[key].append(v)
        return len(nodes["size"]) - 1

    work = [(leaf(len(x)), np.arange(len(x)), 0)]
    while work:
        at, rows, depth = work.pop()
        part = x[rows]
        if depth >= limit or len(rows) < 2:
            continue
        lo, hi = part.min(axis=0), part.max(axis=0)
        usable = np.flatnonzero(hi > lo) if among is None else among[hi[among] > lo[among]]
        if len(usable) == 0:
            continue
        f = int(rng.choice(usable))
        cut = float(rng.uniform(lo[f], hi[f]))
        below = part[:, f] <= cut
        if below.all():
            continue
        left, right = leaf(int(below.sum())), leaf(int((~below).sum()))
        nodes["feature"][at], nodes["threshold"][at] = f, cut
        nodes["left"][at], nodes["right"][at] = left, right
        work += [(left, rows[below], depth + 1), (right, rows[~below], depth + 1)]
    return nodes


def fit_isolation_forest(
    benign: DataFrame, features: Sequence[str], ids: Sequence[str], trees: int = 200, sample: int = 8192, seed: int = 7,
) -> IsolationForest:
    """Grow ``trees`` trees, each from about ``sample`` benign rows chosen by hash.

    Rows are spread over trees by hash, so a task only ever holds one subsample; the
    result has at most two nodes per sampled row.
    """
    features = list(features)
    n = benign.count()
    if n == 0:
        raise ValueError("no benign rows to fit on")
    copies = trees * min(sample, n) / n
    whole, part = int(math.floor(copies)), copies - math.floor(copies)
    key = [F.col(c) for c in ids]
    more = (hash01(*key, seed=seed) < F.lit(part)).cast("int")
    picks = F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.lit(whole) + more, F.lit(1)) if whole else F.when(more == 1, F.array(F.lit(1))),
        lambda i: F.pmod(F.xxhash64(F.lit(seed + 1), i, *key), F.lit(trees)).cast("int")))
    spread = benign.select(*[F.col(f).cast("double").alias(f) for f in features], F.explode(picks).alias("tree"))
    limit = max(1, math.ceil(math.log2(max(min(sample, n), 2))))

    def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(features)[features].to_numpy()
        grown = _grow(rows, np.random.default_rng([seed, int(key[0])]), limit)
        return pd.DataFrame([{"tree": int(key[0]), **grown}])

    got = spread.groupBy("tree").applyInPandas(grow, TREE_SCHEMA).collect()
    sizes = [r["size"][0] for r in got]
    return IsolationForest(sorted(got, key=lambda r: r["tree"]), features, float(np.mean(sizes)))


def grow_isolation_forests(
    rows: DataFrame, settings: DataFrame, features: Sequence[str], ids: Sequence[str], seed: int = 7,
) -> DataFrame:
    """Any number of isolation forests in one job, as a stored table of trees (see tree_tables, and ``rows`` per tree).

    ``rows`` has ``fit`` and the benign rows to fit it on, ``settings`` one row per fit: trees, sample and share (of the
    features that a tree may split on). Rows are dealt to trees by hash, so a task holds one subsample of one tree, and the
    trees of all fits grow side by side. Fits without rows have no trees.
    """
    features, key = list(features), [F.col(c) for c in ids]
    counts = rows.groupBy("fit").agg(F.count(F.lit(1)).alias("_n"))
    plan = counts.join(F.broadcast(settings), "fit")
    size = F.least(F.col("sample").cast("long"), F.col("_n"))
    copies = F.col("trees") * size / F.col("_n")
    plan = plan.select("fit", "trees", "share", F.floor(copies).cast("int").alias("_whole"), (copies - F.floor(copies)).alias("_part"),
                       F.greatest(F.lit(1), F.ceil(F.log2(F.greatest(size, F.lit(2)).cast("double"))).cast("int")).alias("_limit"))
    drawn = rows.select("fit", *ids, *[F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(features)]).join(F.broadcast(plan), "fit")
    times = F.col("_whole") + (hash01(*key, seed=seed) < F.col("_part")).cast("int")
    picks = F.array_distinct(F.transform(
        F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>")),
        lambda i: F.pmod(F.xxhash64(F.lit(seed + 1), i, *key), F.col("trees")).cast("int")))
    names = [f"_x{i}" for i in range(len(features))]
    spread = drawn.select("fit", "share", "_limit", *names, F.explode(picks).alias("tree"))

    def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x, rng = pdf.sort_values(names)[names].to_numpy(), np.random.default_rng([seed, int(key[1])])
        tried = max(1, int(round(float(pdf["share"].iloc[0]) * len(names))))
        among = None if tried >= len(names) else np.sort(rng.choice(len(names), tried, replace=False))
        t = _grow(x, rng, int(pdf["_limit"].iloc[0]), among)
        depth = np.zeros(len(t["size"]))
        for at in range(len(depth)):  # children come after their parent
            for child in (t["left"][at], t["right"][at]):
                if child >= 0:
                    depth[child] = depth[at] + 1
        return pd.DataFrame([{"fit": key[0], "tree": int(key[1]), "feature": t["feature"], "threshold": t["threshold"], "left": t["left"],
                              "right": t["right"], "value": (depth + average_path(np.array(t["size"]))).tolist(), "rows": int(t["size"][0])}])

    return written(spread.groupBy("fit", "tree").applyInPandas(grow, TREE_COLUMNS + ", rows int"), "isolation")


def score_isolation_forests(df: DataFrame, trees: DataFrame, features: Sequence[str], ids: Sequence[str], out: str = "anomaly_score") -> DataFrame:
    """Add the anomaly score by the forest of each row's ``fit``; null where that has no trees."""
    met = meet_trees(df, trees, features, 1, leaf_values(1), ids, "_path")
    n = F.col("_rows")
    scale = trees.groupBy("fit").agg(F.avg("rows").alias("_rows")).select(
        "fit", F.when(n > 2, 2 * (F.log(n - 1) + F.lit(float(np.euler_gamma))) - 2 * (n - 1) / n).otherwise(F.lit(1.0)).alias("_scale"))
    mean = F.try_divide(F.element_at("_path", 1), F.col("n_trees").cast("double"))
    return met.join(scale, "fit", "left").withColumn(out, F.pow(F.lit(2.0), -mean / F.col("_scale"))).drop("_path", "n_trees", "_scale")


class HeldForests:
    """Isolation forests as node arrays that a task holds whole: a leaf points at itself with a threshold that no number passes.

    ``trees`` are those of :func:`grow_isolation_forests`, whose right child is next to the left one.
    """

    def __init__(self, trees: DataFrame, fits: Sequence[str]):
        self.fits, got = list(fits), trees.select("fit", "tree", "feature", "threshold", "left", "value", "rows").toArrow().sort_by(
            [("fit", "ascending"), ("tree", "ascending")])
        self.trees: dict[str, list[tuple]] = {f: [] for f in self.fits}
        rows: dict[str, list[int]] = {f: [] for f in self.fits}
        for t in got.to_batches():
            for i in range(len(t)):
                fit = t.column("fit")[i].as_py()
                feature, threshold, left, value = (t.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("feature", "threshold", "left", "value"))
                split, depth = left >= 0, np.zeros(len(left), dtype=np.int32)
                for at in np.flatnonzero(split):  # children come after their parent
                    depth[left[at]:left[at] + 2] = depth[at] + 1
                self.trees[fit].append((np.where(split, feature, 0).astype(np.int16), np.where(split, threshold, np.inf),
                                        np.where(split, left, np.arange(len(left))).astype(np.int32), value.copy(), int(depth.max())))
                rows[fit].append(t.column("rows")[i].as_py())
        # as in score_isolation, with the mean number of rows that the trees of a fit were grown from
        self.scale = {f: (float(average_path(np.mean(n))) if np.mean(n) > 2 else 1.0) if n else math.nan for f, n in rows.items()}

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Rows x fits; not a number where a fit has no trees. A missing number goes right everywhere."""
        flat = np.ascontiguousarray(np.where(np.isnan(x), np.inf, x)).ravel()
        first = np.arange(len(x)) * x.shape[1]
        out = np.full((len(x), len(self.fits)), np.nan)
        for i, fit in enumerate(self.fits):
            total = np.zeros(len(x))
            for feature, threshold, left, value, depth in self.trees[fit]:
                feature, left, at = feature.astype(np.intp), left.astype(np.intp), np.zeros(len(x), dtype=np.intp)
                for _ in range(depth):
                    at = left.take(at) + (flat.take(feature.take(at) + first) > threshold.take(at))
                total += value.take(at)
            if self.trees[fit]:
                out[:, i] = 2.0 ** (-(total / len(self.trees[fit])) / self.scale[fit])
        return out


def score_all_settings(df: DataFrame, trees: DataFrame, fits: Sequence[str], features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """``fit, *keep, anomaly_score``: every row of ``df`` by every one of ``fits``, as :func:`score_isolation_forests` gives them.

    Trees of up to ``HELD_NODES`` nodes (settings bound them, not rows) are broadcast once, so rows and trees are never
    shuffled and a row is read once for all fits; larger forests meet the rows in blocks.
    """
    nodes = trees.agg(F.sum(F.size("feature"))).first()[0] or 0
    if nodes > HELD_NODES:
        named = df.withColumns({"fit": F.explode(F.array(*[F.lit(f) for f in fits])), "_id": F.monotonically_increasing_id()})
        return score_isolation_forests(named, trees, features, ["_id"]).select("fit", *keep, "anomaly_score")
    held = df.sparkSession.sparkContext.broadcast(HeldForests(trees, fits))

    @F.pandas_udf("array<double>")
    def scores(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in batches:
            x = np.stack([s.to_numpy(dtype=np.float64, na_value=np.nan) for s in batch], axis=1)
            yield pd.Series(list(held.value.scores(x)), dtype=object)

    got = df.withColumn("_s", scores(*[F.col(f).cast("double") for f in features]))
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("fit"), F.get("_s", i).alias("anomaly_score")) for i, f in enumerate(fits)])).alias("_e")
    score = F.col("_e.anomaly_score")
    return got.select(*keep, each).select("_e.fit", *keep, F.when(~F.isnan(score), score).alias("anomaly_score"))


# settings compared by the study: trees, subsample, share of the features per tree (fixed values)
STUDY = {
    "n100_s256": (100, 256, 1.0),
    "n300_s256": (300, 256, 1.0),
    "n200_s2048": (200, 2048, 1.0),
    "n200_s8192": (200, 8192, 1.0),
    "n200_s2048_f05": (200, 2048, 0.5),
    "n200_s256_f03": (200, 256, 0.3),
}


def isolation_study(
    benign: DataFrame, val: DataFrame, features: Sequence[str], ids: Sequence[str], attack: Column, tool: str,
    settings: dict[str, tuple[int, int, float]] | None = None, share: float = 0.995, seed: int = 7,
) -> tuple[DataFrame, DataFrame]:
    """Which setting separates attacks best on ``val``: (a row per setting, a row per setting and tool).

    Per setting the ROC-AUC, the cut at the ``share`` quantile of benign scores, and the rates of benign and attack rows
    above it; per tool its recall with an interval.
    """
    settings = settings or STUDY
    spark, fits = benign.sparkSession, F.explode(F.array(*[F.lit(k) for k in settings])).alias("fit")
    plan = spark.createDataFrame([(k, *v) for k, v in settings.items()], "fit string, trees int, sample int, share double")
    trees = grow_isolation_forests(benign.select(fits, *ids, *features), plan, features, ids, seed)
    rows = val.select(attack.alias("_attack"), F.col(tool).alias("tool"), *[F.col(f).cast("double").alias(f) for f in features])
    scored = written(score_all_settings(rows, trees, list(settings), features, ["tool", "_attack"]), "study")
    cut = quantiles(scored.where("not _attack"), ["anomaly_score"], {"tau": share}, keys=["fit"], groups=len(settings)).select("fit", "tau")
    judged = scored.join(F.broadcast(cut), "fit").withColumn("_hit", F.col("anomaly_score") > F.col("tau"))
    auc = ranking_quality(scored, F.col("_attack"), "anomaly_score", keys=["fit"]).select("fit", "roc_auc")
    rate = lambda c: F.avg(F.when(c, F.col("_hit").cast("double")))
    overall = judged.groupBy("fit", "tau").agg(
        F.count_if(~F.col("_attack")).alias("n_benign"), rate(~F.col("_attack")).alias("benign_flag_rate"), rate(F.col("_attack")).alias("recall"))
    per_tool = judged.where("_attack").groupBy("fit", "tool").agg(F.count(F.lit(1)).alias("n"), F.count_if("_hit").alias("hits"))
    lo, hi = wilson(F.col("hits"), F.col("n"))
    per_tool = per_tool.withColumns({"recall": F.col("hits") / F.col("n"), "recall_lo": lo, "recall_hi": hi})
    name = {"fit": "setting"}
    return overall.join(auc, "fit").withColumnsRenamed(name), per_tool.withColumnsRenamed(name)


def _passes(trees: list) -> list[list]:
    out: list[list] = [[]]
    held = 0
    for t in trees:
        if held and held + len(t["size"]) > NODES_PER_PASS:
            out.append([])
            held = 0
        out[-1].append(t)
        held += len(t["size"])
    return out


def score_isolation(df: DataFrame, forest: IsolationForest, out: str = "anomaly_score") -> DataFrame:
    """Add the anomaly score in (0, 1), higher = stranger.

    Trees are shipped in passes of bounded size; each pass adds its path lengths.
    """
    sc = df.sparkSession.sparkContext
    inputs = F.struct(*[F.col(f).cast("double").alias(f) for f in forest.features])
    total = F.lit(0.0)
    for group in _passes(forest.trees):
        packed = sc.broadcast([
            tuple(np.asarray(t[k]) for k in ("feature", "threshold", "left", "right", "size")) for t in group])

        @F.pandas_udf("double")
        def paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            for pdf in batches:
                x = pdf.to_numpy(dtype=float)
                depth = np.zeros(len(x))
                for feature, threshold, left, right, size in packed.value:
                    at = np.zeros(len(x), dtype=int)
                    live = np.flatnonzero(feature[at] >= 0)
                    while len(live):
                        node = at[live]
                        below = x[live, feature[node]] <= threshold[node]
                        at[live] = np.where(below, left[node], right[node])
                        depth[live] += 1
                        live = live[feature[at[live]] >= 0]
                    depth += average_path(size[at])
                yield pd.Series(depth)

        total = total + paths(inputs)
    scale = float(average_path(forest.sample)) or 1.0
    mean = total / F.lit(float(len(forest.trees)))
    return df.withColumn(out, F.pow(F.lit(2.0), -mean / F.lit(scale)))


def score_borders(benign: DataFrame, score: str = "anomaly_score", points: int = 10_000) -> list[float]:
    """``points`` evenly ranked scores of the benign rows, from one mergeable sketch."""
    found = benign.agg(F.percentile_approx(score, [(i + 1) / points for i in range(points)], 10 * points)).head()[0]
    return [float(x) for x in found or []]


def score_percentile(df: DataFrame, borders: Sequence[float], score: str = "anomaly_score", out: str = "anomaly_pct") -> DataFrame:
    """Add the share of benign scores at or below the score, times 100; works on tables and streams."""
    held = np.asarray(borders)

    @F.pandas_udf("double")
    def percentile(s: pd.Series) -> pd.Series:
        return pd.Series(100.0 * np.searchsorted(held, s.to_numpy(), side="right") / max(len(held), 1))

    return df.withColumn(out, percentile(F.col(score)))

"""Signed feature contributions to p(attack), summed along tree paths."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.models.cell_forest import CellForest
from flowlens.models.tree_tables import TREE_COLUMNS, Tree, meet_trees
from flowlens.session import fresh_path, written


def node_table(model: RandomForestClassificationModel, spark) -> DataFrame:
    """Nodes of all trees as a table: tree, node, p, feature, threshold, left, right."""
    path = fresh_path(spark, "forest")
    model.write().save(path)
    raw = spark.read.parquet(f"{path}/data")
    n = F.col("nodeData")
    stats = n["impurityStats"]
    mass = F.aggregate(stats, F.lit(0.0), lambda a, x: a + x)
    return raw.select(
        F.col("treeID").alias("tree"), n["id"].alias("node"),
        F.coalesce(F.try_divide(F.get(stats, 1), mass), F.lit(0.0)).alias("p"),
        n["split"]["featureIndex"].alias("feature"),
        F.coalesce(F.get(n["split"]["leftCategoriesOrThreshold"], 0), F.lit(0.0)).alias("threshold"),
        n["leftChild"].alias("left"), n["rightChild"].alias("right"))


def _trees(model: CellForest | RandomForestClassificationModel, spark) -> DataFrame:
    """One row of node arrays per tree (node numbers are places in the arrays)."""
    if isinstance(model, CellForest):
        rows = [("model", tree, np.where(left >= 0, feature, -1).tolist(), threshold.tolist(), left.tolist(), np.where(left >= 0, left + 1, -1).tolist(),
                 shares[:, 1].tolist()) for tree, feature, threshold, left, shares in model.arrays()]
        return spark.createDataFrame(rows, TREE_COLUMNS)
    listed = F.array_sort(F.collect_list(F.struct("node", "p", "feature", "threshold", "left", "right")))
    per = node_table(model, spark).groupBy("tree").agg(listed.alias("n"))
    return per.select(
        F.lit("model").alias("fit"), F.col("tree").cast("int").alias("tree"),
        F.transform("n.feature", lambda x: x.cast("int")).alias("feature"), F.col("n.threshold").alias("threshold"),
        F.transform("n.left", lambda x: x.cast("int")).alias("left"), F.transform("n.right", lambda x: x.cast("int")).alias("right"),
        F.col("n.p").alias("value"))


def path_contributions(width: int) -> Callable[[np.ndarray, Tree], np.ndarray]:
    """Per row the change of p at every step down a tree, added to the feature of the split; the root's p comes last."""
    def visit(x: np.ndarray, tree: Tree) -> np.ndarray:
        total, p = np.zeros((len(x), width + 1)), tree.value
        total[:, width] = p[0]
        at = np.zeros(len(x), dtype=np.int64)
        live = np.flatnonzero(tree.left[at] >= 0)
        while len(live):
            node = at[live]
            child = np.where(x[live, tree.feature[node]] <= tree.threshold[node], tree.left[node], tree.right[node])
            np.add.at(total, (live, tree.feature[node]), p[child] - p[node])
            at[live] = child
            live = live[tree.left[child] >= 0]
        return total

    return visit


def attribute(
    df: DataFrame, features: Sequence[str], model: CellForest | RandomForestClassificationModel, ids: Sequence[str] = ("flow_id",),
) -> DataFrame:
    """Add ``base`` and ``contributions`` (one per feature); base + their sum is the forest's p(attack).

    Walking a tree, the change of p from a node to its child belongs to the feature the node splits on; every tree is
    walked. Trees are a table that blocks of rows meet in tasks.
    ``ids`` spread the rows over blocks (other columns, where a table has none of them, do as well).
    """
    width = len(features)
    spread = [c for c in ids if c in df.columns] or list(features)
    trees = written(_trees(model, df.sparkSession), "trees")
    inputs = [f"_x{i}" for i in range(width)]
    rows = df.withColumns({"fit": F.lit("model"), **{x: F.col(f).cast("double") for x, f in zip(inputs, features, strict=True)}})
    met = meet_trees(rows, trees, inputs, width + 1, path_contributions(width), spread, "_c")
    mean = F.transform("_c", lambda x: F.try_divide(x, F.col("n_trees").cast("double")))
    got = met.withColumn("_c", mean).withColumns({"base": F.element_at("_c", -1), "contributions": F.slice("_c", 1, width)})
    return got.select(*df.columns, "base", "contributions")


def top_contributions(df: DataFrame, features: Sequence[str], baseline: DataFrame, row_id: str, ts: str, k: int = 5) -> DataFrame:
    """The k largest contributions per row with the raw value and the benign median."""
    items = F.array(*[
        F.struct((-F.abs(F.col("contributions")[i])).alias("o"), F.lit(f).alias("feature"),
                 F.col(f).cast("double").alias("value"), F.col("contributions")[i].alias("contribution"))
        for i, f in enumerate(features)])
    best = F.explode(F.slice(F.array_sort(items), 1, k)).alias("_b")
    rows = df.select(row_id, F.col(ts).alias("ts"), best).select(
        row_id, "ts", "_b.feature", "_b.value", "_b.contribution")
    medians = baseline.select("feature", F.col("median").alias("baseline_median"))
    return rows.join(medians, "feature", "left")


def global_importance(attributions: DataFrame) -> DataFrame:
    """Mean absolute contribution per feature, largest first."""
    return attributions.groupBy("feature").agg(
        F.avg(F.abs("contribution")).alias("importance")).orderBy(F.desc("importance"), "feature")

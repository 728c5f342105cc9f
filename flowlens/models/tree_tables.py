"""Forests as tables: one row per tree, any number of forests ("fits") side by side.

Rows meet the trees of their own fit in blocks, through a cogroup on (fit, row block). A task holds one block of rows and
one block of trees, so neither a forest nor a table has to fit anywhere as a whole, and nothing passes the driver but the
number of blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

TREE_COLUMNS = (
    "fit string, tree int, feature array<int>, threshold array<double>, left array<int>, right array<int>, value array<double>")
BLOCK_ROWS = 20_000
BLOCK_NODES = 1_000_000


@dataclass
class Tree:
    """Node arrays: a leaf has ``left`` -1, rows with x <= threshold go left; ``value`` holds ``width`` numbers per node."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The node at which each row ends."""
        at = np.zeros(len(x), dtype=np.int64)
        live = np.flatnonzero(self.left[at] >= 0)
        while len(live):
            node = at[live]
            at[live] = np.where(x[live, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            live = live[self.left[at[live]] >= 0]
        return at


def leaf_values(width: int) -> Callable[[np.ndarray, Tree], np.ndarray]:
    """What :func:`meet_trees` adds up per tree: the values of the leaf."""
    return lambda x, tree: tree.value.reshape(-1, width)[tree.leaves(x)]


def meet_trees(
    rows: DataFrame, trees: DataFrame, features: Sequence[str], width: int, visit: Callable[[np.ndarray, Tree], np.ndarray],
    ids: Sequence[str], out: str = "sums",
) -> DataFrame:
    """Add ``out`` (``width`` numbers summed over all trees of the row's fit) and ``n_trees`` to ``rows``.

    ``rows`` has ``fit``; ``ids`` name a row and spread the rows of a fit over blocks. ``visit(x, tree)`` gives rows x
    ``width`` numbers. Rows whose fit has no tree get zeros. Forests beyond ``BLOCK_NODES`` nodes take several passes.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = trees.groupBy("fit").agg(F.sum(F.size("feature")).alias("_nodes"), F.count(F.lit(1)).cast("int").alias("n_trees"))
    sizes = sizes.withColumn("_passes", F.ceil(F.col("_nodes") / BLOCK_NODES).cast("int"))
    counted = rows.groupBy("fit").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("_blocks"))
    plan = counted.join(sizes, "fit", "left").fillna({"n_trees": 0, "_passes": 0})
    passes = plan.agg(F.max("_passes")).first()[0] or 0  # one number
    zeros = F.array_repeat(F.lit(0.0), width)
    now = rows.join(plan.select("fit", "_blocks", "n_trees"), "fit").withColumn(
        "_block", F.pmod(F.xxhash64(*ids), F.col("_blocks")).cast("int")).drop("_blocks").withColumn(out, zeros)
    now = now.withColumn(out, F.col(out).cast(ArrayType(DoubleType())))
    shared = trees.join(plan.select("fit", "_blocks", "_passes"), "fit").withColumn("_pass", F.pmod("tree", F.col("_passes")).cast("int"))
    schema, names = now.schema, list(features)

    def walk(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return left
        x = np.stack([left[n].to_numpy(zero_copy_only=False).astype(np.float64) for n in names], axis=1)
        total = np.array(left[out].combine_chunks().flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, width)
        # trees in their own order, so that sums of doubles never depend on how a shuffle ran
        for t in right.sort_by("tree").to_batches():
            for i in range(len(t)):
                get = {c: t.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("feature", "threshold", "left", "right", "value")}
                total = total + visit(x, Tree(**get))
        sums = pa.ListArray.from_arrays(pa.array(np.arange(0, total.size + 1, width, dtype=np.int32)), pa.array(total.ravel()))
        return left.set_column(left.schema.get_field_index(out), out, sums)

    for k in range(passes):
        block = shared.where(F.col("_pass") == k).withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        block = block.select("fit", "_block", "tree", "feature", "threshold", "left", "right", "value")
        a, b = (t.repartition(parts, "fit", "_block").groupBy("fit", "_block") for t in (now, block))
        now = a.cogroup(b).applyInArrow(walk, schema)
    return now.drop("_block")

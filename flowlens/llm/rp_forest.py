"""Near-duplicate embeddings: a forest of random projection trees, comparison inside leaves, union of links.

A tree splits the space by random directions at about the middle of what it has seen; vectors within a margin of
a border go to both sides (spill). The borders are fitted on a bounded sample (``SAMPLE`` vectors by hash); every
vector is sent down every tree. Inside a leaf all vectors meet in blocks of ``BLOCK`` rows: exact cosines in
double precision, and only the groups found leave the task, one row per vector. The groups of all leaves and trees
are joined to components.

Links are then counted exactly inside each component, again in blocks, so a vector's count does not depend on
which trees separated it from a neighbour. Vectors that are equal number by number stand for one another throughout
and are counted with their multiplicity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.components import connected_components
from flowlens.llm.storage import stored

SAMPLE = 16_384
TREES = 16
LEAF = 512
BLOCK = 2_048
SPILL = 0.05
LEAST = 24  # sampled vectors that a fitted node has on average


@dataclass
class Tree:
    """One direction per level, and two borders per node: vectors above ``low`` go right, up to ``high`` go left.

    Borders are kept down to the depth that the sample can tell; below it the nodes of a level share those of their last
    fitted ancestor, so a tree's size is bounded by the sample, whatever its depth.
    """

    directions: np.ndarray
    low: list[np.ndarray]
    high: list[np.ndarray]

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and leaf numbers; a row may stand in several leaves."""
        values = x @ self.directions.T
        rows, node = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
        for level, (low, high) in enumerate(zip(self.low, self.high, strict=True)):
            fitted = node >> (level - int(np.log2(len(low))))
            value = values[rows, level]
            left, right = value <= high[fitted], value > low[fitted]
            rows, node = np.concatenate([rows[left], rows[right]]), np.concatenate([2 * node[left], 2 * node[right] + 1])
        return rows, node


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, safely for very large and very small numbers."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def grow(sample: np.ndarray, depth: int, seed: int, spill: float = SPILL) -> Tree:
    """A tree over unit vectors: each node splits its sampled vectors a little off their middle, by a random share."""
    rng = np.random.default_rng(seed)
    directions = rng.normal(size=(depth, sample.shape[1]))
    directions /= np.maximum(np.linalg.norm(directions, axis=1, keepdims=True), 1e-300)
    values = sample @ directions.T
    fitted = max(0, int(np.log2(max(1, len(sample) / LEAST))))
    nodes, lows, highs = [np.arange(len(sample))], [], []
    for level in range(depth):
        middle = 0.5 + (rng.random(len(nodes)) - 0.5) * 0.2
        low = np.array([np.quantile(values[n, level], max(0.0, m - spill)) for n, m in zip(nodes, middle, strict=True)])
        high = np.array([np.quantile(values[n, level], min(1.0, m + spill)) for n, m in zip(nodes, middle, strict=True)])
        lows.append(low)
        highs.append(high)
        if level < fitted:
            halves = []
            for n, lo, hi in zip(nodes, low, high, strict=True):
                left, right = n[values[n, level] <= hi], n[values[n, level] > lo]
                halves += [left if len(left) else n, right if len(right) else n]
            nodes = halves
    return Tree(directions, lows, highs)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack(column.to_numpy(zero_copy_only=False)).astype(np.float64) if len(column) else np.zeros((0, 1))


def _linked(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    return a @ b.T >= least


def _groups(ids: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """Smallest id reachable inside the block."""
    label = ids.copy()
    left, right = np.nonzero(linked)
    while True:
        new = label.copy()
        np.minimum.at(new, left, label[right])
        if (new == label).all():
            return label
        label = new


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding`` of the rows that can link: no nulls inside, finite, not all zero. Repeated rows are one."""
    rows = vectors.select("vec_id", "embedding")
    good = (F.col("vec_id").isNotNull() & (F.size("embedding") > 0)
            & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            & F.exists("embedding", lambda x: x != 0))
    return rows.where(F.coalesce(good, F.lit(False))).distinct()


def _in_blocks(rows: DataFrame, key: str, block: int) -> DataFrame:
    """Every row once per pair of blocks of its key: ``key, x, y, own`` with x <= y; own tells which of the two it is.

    The number of blocks comes from the count of the key, so a key with any number of rows is met in pairs of
    blocks of about ``block`` rows, each a group of its own.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    rows = rows.join(counts, key)
    blocks = F.ceil(F.col("_n") / F.lit(block)).cast("int")
    rows = rows.withColumn("_blocks", blocks).withColumn("own", F.pmod(F.xxhash64("vec_id", F.lit(5)), F.col("_blocks")).cast("int"))
    meets = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    rows = rows.select("*", meets.alias("_other"))
    return rows.withColumns({"x": F.least("own", "_other"), "y": F.greatest("own", "_other")}).drop("_n", "_blocks", "_other")


def near_vectors(vectors: DataFrame, least: float = 0.95, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE,
                 block: int = BLOCK, spill: float = SPILL) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per row of ``vectors`` (``vec_id long, embedding array<float or double>``).

    Two vectors link when their cosine is at least ``least``. Null, empty, zero vectors and those with null or
    non-finite numbers have no links and stand alone, as do vectors of different lengths towards each other. Rows that
    share a vec_id are one node: most links of any of its vectors, smallest component; a null vec_id stands alone. An
    empty table gives an empty result; other columns are ignored.
    """
    single = valid_vectors(vectors)
    classes = stored(single.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "vectors")
    member = single.join(classes.select("embedding", "rep", "copies"), "embedding").select("vec_id", "rep", "copies")
    reps = classes.select(F.col("rep").alias("vec_id"), "embedding", "copies")

    # at most ``sample`` vectors of each length, by hash
    forests: dict[int, list[Tree]] = {}
    for length, rows in sorted(reps.groupBy(F.size("embedding").alias("d")).count().collect()):
        drawn = reps.where(F.size("embedding") == length).orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(sample)
        own = unit(_matrix(drawn.select("embedding").toArrow()["embedding"].combine_chunks()))
        depth = max(0, int(np.ceil(np.log2(max(rows, 1) / leaf))))
        forests[length] = [grow(own, depth, seed=1000 * t + length, spill=spill) for t in range(trees)]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.column("vec_id").to_numpy(zero_copy_only=False), batch.column("embedding")
            sizes = np.array([len(v) for v in column])
            for length, forest in forests.items():
                here = np.flatnonzero(sizes == length)
                if not len(here):
                    continue
                x = unit(_matrix(column.take(pa.array(here))))
                for t, tree in enumerate(forest):
                    row, node = tree.leaves(x)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(ids[here[row]]), pa.array((np.int64(length) << 40) + (np.int64(t) << 32) + node)], names=["vec_id", "leaf"])

    leaves = reps.select("vec_id", "embedding").mapInArrow(place, "vec_id long, leaf long")
    leaves = _in_blocks(stored(leaves, "leaves"), "leaf", block).join(reps.select("vec_id", "embedding"), "vec_id")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        ids = group["vec_id"].to_numpy()
        x = unit(np.stack(group["embedding"].to_numpy()).astype(np.float64))
        label = _groups(ids, _linked(x, x, least))
        tied = label != ids
        return pd.DataFrame({"a": label[tied], "b": ids[tied]})

    edges = leaves.groupBy("leaf", "x", "y").applyInPandas(compare, "a long, b long")
    found = stored(connected_components(stored(edges.distinct(), "edges")), "components")

    def count(group: pd.DataFrame) -> pd.DataFrame:
        x = unit(np.stack(group["embedding"].to_numpy()).astype(np.float64))
        own, copies = group["own"].to_numpy(), group["copies"].to_numpy()
        same = group["x"].iloc[0] == group["y"].iloc[0]
        # within one block every pair counts, between two blocks only pairs across
        seen = _linked(x, x, least) & (True if same else own[:, None] != own[None, :])
        return pd.DataFrame({"vec_id": group["vec_id"], "n": seen @ copies})

    grouped = found.select(F.col("node").alias("vec_id"), "component").join(reps, "vec_id")
    counts = _in_blocks(grouped, "component", block).groupBy("component", "x", "y").applyInPandas(count, "vec_id long, n long")
    counts = counts.groupBy("vec_id").agg(F.sum("n").alias("n"))
    per_rep = found.select(F.col("node").alias("rep"), "component").join(counts.withColumnRenamed("vec_id", "rep"), "rep", "left")
    linked = member.join(per_rep, "rep", "left").select(
        "vec_id", (F.coalesce("n", "copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = linked.groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = vectors.select("vec_id").join(linked, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))

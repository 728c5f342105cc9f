"""A classification forest over all rows of a table, grown on cells instead of rows.

A histogram tree sees of a row only the bin of every feature and the class, so rows that agree in these are one cell with
a count: however many rows there are, trees meet the distinct cells. A cell's bootstrap count is a Poisson number around
its count, which is what its rows would have drawn together. Nodes of more than ``TASK_CELLS`` cells are split in Spark
rounds over summed histograms, one level per round; smaller ones are grown to the end inside a task, side by side. Growing
keeps to MLlib's rules: Gini gain, counts of drawn rows per leaf, siblings that name the same class merged.

A grown tree is a row of packed node arrays (7 bytes a node and its class shares). Rows are scored in tasks, the same way
in tables and streams.
"""

from __future__ import annotations

import math
import uuid
from collections import OrderedDict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.session import written

BLOCK_CELLS = 250_000
TASK_CELLS = 1_000_000
TREES_PER_TASK = 10
#: cells whose scores a worker keeps
SEEN_CELLS = 200_000
CELL_COLUMNS = "codes binary, y int, n bigint"
DRAWN_COLUMNS = "tree int, node int, block long, codes binary, y binary, w binary"
SUM_COLUMNS = "tree int, node int, feature int, code int, y int, w double, cells bigint"
CUT_COLUMNS = "tree int, node int, feature int, code int, cells array<bigint>, mass array<double>"
PIECE_COLUMNS = "tree int, node int, feature binary, code binary, left binary, value binary"
TREE_COLUMNS = "tree int, feature binary, code binary, left binary, value binary"
BORDER_COLUMNS = "pos int, borders array<double>"


def tried_features(subset: str, width: int) -> int:
    """Features tried per node, rounded up as in MLlib."""
    if subset == "all":
        return width
    return max(1, min(width, math.ceil(math.sqrt(width) if subset == "sqrt" else float(subset) * width)))


def feature_borders(df: DataFrame, features: Sequence[str], bins: int) -> list[np.ndarray]:
    """At most ``bins`` - 1 cut points per feature: between all values where they are few, else quantiles of all rows."""
    cells = [F.col(f).cast("double") for f in features]
    guess = df.agg(*[F.approx_count_distinct(c).alias(f"_{i}") for i, c in enumerate(cells)]).first()
    few = [i for i in range(len(features)) if guess[i] <= 2 * bins]
    values: dict[int, list[float]] = {i: [] for i in few}
    if few:
        each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), cells[i].alias("v")) for i in few])).alias("_e")
        for r in df.select(each).select("_e.*").where(F.col("v").isNotNull()).distinct().collect():
            values[r["i"]].append(r["v"])
    wide = [i for i in range(len(features)) if i not in values or len(values[i]) > bins]
    out: list[np.ndarray] = [np.zeros(0)] * len(features)
    if wide:
        numbers = df.select(*[cells[i].alias(f"_{i}") for i in wide])
        found = numbers.approxQuantile(numbers.columns, [k / bins for k in range(1, bins)], 1 / (8 * bins))
        for i, cuts in zip(wide, found, strict=True):
            out[i] = np.unique(np.array(cuts, dtype=np.float64))
    for i in few:
        if i not in wide:
            v = np.sort(np.array(values[i]))
            middle = v[:-1] + (v[1:] - v[:-1]) / 2
            out[i] = np.where(np.isfinite(middle), middle, v[:-1])
    return out


def bin_codes(x: np.ndarray, borders: Sequence[np.ndarray]) -> np.ndarray:
    """The bin of every value: a row goes left of cut c when its code is at most c."""
    if np.isnan(x).any():
        raise ValueError("a feature is null or not a number")
    return np.stack([np.searchsorted(b, x[:, j], side="left") for j, b in enumerate(borders)], axis=1).astype(np.uint8)


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(width)], axis=1)


def _as_bytes(codes: np.ndarray) -> pa.Array:
    rows, width = codes.shape
    return pa.Array.from_buffers(pa.binary(), rows, [
        None, pa.py_buffer(np.arange(0, rows * width + 1, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(codes))])


def binned_cells(df: DataFrame, features: Sequence[str], label: str, borders: Sequence[np.ndarray]) -> DataFrame:
    """Rows counted by their bins and class; batches fold before the shuffle."""
    width, cuts = len(features), list(borders)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            if batch.column(width).null_count:
                raise ValueError("a label is null")
            y = batch.column(width).to_numpy(zero_copy_only=False).astype(np.int32)
            whole = np.ascontiguousarray(np.hstack([bin_codes(_matrix(batch, width), cuts), y.view(np.uint8).reshape(-1, 4)]))
            cell, n = np.unique(whole.view(f"V{width + 4}").ravel(), return_counts=True)
            cell = cell.view(np.uint8).reshape(-1, width + 4)
            yield pa.RecordBatch.from_arrays([
                _as_bytes(cell[:, :width]), pa.array(np.ascontiguousarray(cell[:, width:]).view(np.int32).ravel()), pa.array(n.astype(np.int64))],
                names=["codes", "y", "n"])

    ready = df.select(*[F.col(f).cast("double").alias(f"_{i}") for i, f in enumerate(features)], F.col(label).cast("int").alias("_y"))
    return ready.mapInArrow(fold, CELL_COLUMNS).groupBy("codes", "y").agg(F.sum("n").alias("n"))


@dataclass
class Nodes:
    """Node arrays of one tree: a split has ``left`` >= 0 and its right child next to it, a leaf has -1."""

    feature: np.ndarray
    code: np.ndarray
    left: np.ndarray
    mass: np.ndarray  # nodes x classes


def walk(feature: np.ndarray, code: np.ndarray, left: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The node at which each row ends."""
    at = np.zeros(len(codes), dtype=np.int64)
    live = np.flatnonzero(left[at] >= 0)
    while len(live):
        node = at[live]
        at[live] = left[node] + (codes[live, feature[node]] > code[node])
        live = live[left[at[live]] >= 0]
    return at


def best_cuts(
    node: np.ndarray, codes: np.ndarray, y: np.ndarray, w: np.ndarray, total: np.ndarray, tries: np.ndarray, min_rows: int, bins: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per node the feature and code of the best cut by Gini gain (-1 where none helps), and that gain.

    Rows are sorted by node and code per feature, so the work follows the rows and not nodes x bins.
    """
    many, classes = total.shape
    gain_of, feature, cut = np.full(many, 1e-9), np.full(many, -1, dtype=np.int32), np.zeros(many, dtype=np.int32)
    whole = (total ** 2).sum(axis=1) / np.maximum(total.sum(axis=1), 1e-300)
    for j in range(codes.shape[1]):
        here = np.flatnonzero(tries[node, j])
        if not len(here):
            continue
        key = node[here] * bins + codes[here, j]
        order = np.argsort(key, kind="stable")
        here, key = here[order], key[order]
        new = np.append(True, key[1:] != key[:-1])
        run = np.cumsum(new) - 1
        of, at = np.divmod(key[new], bins)
        mass = np.bincount(run * classes + y[here], weights=w[here], minlength=len(of) * classes).reshape(-1, classes)
        upto = np.cumsum(mass, axis=0)
        first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        start = np.repeat(first, np.diff(np.append(first, len(of))))
        below = upto - (upto[start] - mass[start])
        above = total[of] - below
        wb, wa = below.sum(axis=1), above.sum(axis=1)
        gain = (below ** 2).sum(axis=1) / np.maximum(wb, 1e-300) + (above ** 2).sum(axis=1) / np.maximum(wa, 1e-300) - whole[of]
        gain[(wb < max(min_rows, 1)) | (wa < max(min_rows, 1))] = -1
        best = np.maximum.reduceat(gain, first)
        hit = np.flatnonzero(gain == np.repeat(best, np.diff(np.append(first, len(of)))))[::-1]
        place = np.zeros(many, dtype=np.int64)
        place[of[hit]] = at[hit]  # written backwards, so the lowest code stays
        of, better = of[first], best > gain_of[of[first]]
        gain_of[of[better]], feature[of[better]], cut[of[better]] = best[better], j, place[of[better]]
    return feature, cut, gain_of


def grow_cells(
    codes: np.ndarray, y: np.ndarray, w: np.ndarray, classes: int, rng: np.random.Generator,
    depth: int, min_rows: int, tried: int, bins: int,
) -> Nodes:
    """One tree over weighted cells, level by level."""
    width = codes.shape[1]
    y, w = y.astype(np.int64), w.astype(np.float64)
    total = np.bincount(y, weights=w, minlength=classes).reshape(1, classes)
    parts, made = [], 1
    ids = np.zeros(1, dtype=np.int64)  # numbers of the level's nodes
    node = np.zeros(len(y), dtype=np.int64)  # place of the row's node in the level
    masses = [total]
    for _ in range(depth):
        # a pure or small node is a leaf
        live = ((total > 0).sum(axis=1) > 1) & (total.sum(axis=1) >= 2 * min_rows)
        keep = live[node]
        node = (np.cumsum(live) - 1)[node[keep]]
        codes, y, w, ids, total = codes[keep], y[keep], w[keep], ids[live], total[live]
        if not len(ids):
            break
        tries = np.zeros((len(ids), width), dtype=bool)
        np.put_along_axis(tries, np.argsort(rng.random((len(ids), width)), axis=1)[:, :tried], True, axis=1)
        feature, cut, _ = best_cuts(node, codes, y, w, total, tries, min_rows, bins)
        split = np.flatnonzero(feature >= 0)
        if not len(split):
            break
        parts.append((ids[split], feature[split], cut[split], made + 2 * np.arange(len(split))))
        keep = feature[node] >= 0
        codes, y, w, node = codes[keep], y[keep], w[keep], node[keep]
        child = np.cumsum(feature >= 0) - 1
        node = 2 * child[node] + (codes[np.arange(len(node)), feature[node]] > cut[node])
        ids = made + np.arange(2 * len(split))
        made += 2 * len(split)
        total = np.bincount(node * classes + y, weights=w, minlength=len(ids) * classes).reshape(-1, classes)
        masses.append(total)
    out = Nodes(np.full(made, -1, dtype=np.int16), np.zeros(made, dtype=np.uint8), np.full(made, -1, dtype=np.int32), np.concatenate(masses))
    for at, feature, cut, left in parts:
        out.feature[at], out.code[at], out.left[at] = feature, cut, left
    return out


def merge_siblings(tree: Nodes) -> Nodes:
    """Leaves below one split that name the same class become one leaf, from the bottom up."""
    left, says = tree.left.copy(), tree.mass.argmax(axis=1)
    todo = np.flatnonzero(left >= 0)
    while len(todo):
        a = left[todo]
        merged = todo[(left[a] < 0) & (left[a + 1] < 0) & (says[a] == says[a + 1])]
        if not len(merged):
            break
        left[merged] = -1
        todo = np.flatnonzero(left >= 0)
    used = np.zeros(len(left), dtype=bool)
    used[0] = True
    level = np.zeros(1, dtype=np.int64)
    while len(level):
        level = left[level[left[level] >= 0]]
        level = np.concatenate([level, level + 1])
        used[level] = True
    place = np.cumsum(used) - 1
    left = np.where(left >= 0, place[left], -1).astype(np.int32)
    return Nodes(np.where(left >= 0, tree.feature, -1)[used].astype(np.int16), tree.code[used], left[used], tree.mass[used])


def packed(tree: Nodes) -> tuple[bytes, bytes, bytes, bytes]:
    """Node arrays as bytes, with the class shares of every node."""
    shares = tree.mass / np.maximum(tree.mass.sum(axis=1, keepdims=True), 1e-300)
    return tree.feature.astype(np.int16).tobytes(), tree.code.tobytes(), tree.left.astype(np.int32).tobytes(), shares.tobytes()


@dataclass
class Grower:
    """What the tasks that grow a forest need to know."""

    trees: int
    classes: int
    width: int
    depth: int
    min_rows: int
    tried: int
    bins: int
    seed: int
    merge: bool = True  # siblings that name the same class

    def rng(self, *of: int) -> np.random.Generator:
        return np.random.default_rng([self.seed & 0xFFFFFFFF, *of])

    def draws(self, key: tuple, cells: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """The bootstrap samples of a block of cells for one batch of trees; the order of the cells is their own."""
        block, part = (k.as_py() for k in key)
        cells = cells.sort_by([("codes", "ascending"), ("y", "ascending")])
        codes = np.frombuffer(b"".join(cells["codes"].to_pylist()), dtype=np.uint8).reshape(-1, self.width)
        y, n = cells["y"].to_numpy(), cells["n"].to_numpy()
        for tree in range(part * TREES_PER_TASK, min((part + 1) * TREES_PER_TASK, self.trees)):
            w = self.rng(0, tree, block).poisson(n)
            drawn = np.flatnonzero(w)
            yield tree, codes[drawn], y[drawn], w[drawn]

    def tries(self, tree: int, node: int) -> np.ndarray:
        """The features a node of the top may be cut by."""
        return np.sort(self.rng(1, tree, node).permutation(self.width)[:self.tried])

    def cut(self, key: tuple, sums: pa.Table) -> pa.Table:
        """The best cut of one node from its summed histograms: cells and class masses of both children, or its own mass."""
        tree, node = (k.as_py() for k in key)
        of, code, y, w, cells = (sums[c].to_numpy() for c in ("feature", "code", "y", "w", "cells"))
        best, found = 1e-9, None
        for j in np.unique(of):
            at = np.flatnonzero(of == j)
            total = np.bincount(y[at], weights=w[at], minlength=self.classes)
            _, c, gain = best_cuts(np.zeros(len(at), dtype=np.int64), code[at, None], y[at], w[at], total[None], np.ones((1, 1), dtype=bool), self.min_rows, self.bins)
            if gain[0] > best:
                best, goes = gain[0], code[at] > c[0]
                side = np.bincount(goes * self.classes + y[at], weights=w[at], minlength=2 * self.classes)
                found = (int(j), int(c[0]), np.bincount(goes, weights=cells[at], minlength=2).astype(np.int64).tolist(), side.tolist())
        found = found or (-1, 0, [], total.tolist())
        return pa.table({"tree": pa.array([tree], pa.int32()), "node": pa.array([node], pa.int32()), "feature": pa.array([found[0]], pa.int32()),
                         "code": pa.array([found[1]], pa.int32()), "cells": pa.array([found[2]], pa.list_(pa.int64())), "mass": pa.array([found[3]], pa.list_(pa.float64()))})

    def piece(self, key: tuple, drawn: pa.Table, depth: dict[tuple[int, int], int]) -> pa.Table:
        """The whole subtree below one node."""
        tree, node = (k.as_py() for k in key)
        drawn = drawn.sort_by("block")
        join = lambda c, kind: np.frombuffer(b"".join(drawn[c].to_pylist()), dtype=kind)
        grown = grow_cells(
            join("codes", np.uint8).reshape(-1, self.width), join("y", np.int32), join("w", np.int32), self.classes, self.rng(2, tree, node),
            self.depth - depth.get((tree, node), 0), self.min_rows, self.tried, self.bins)
        grown = merge_siblings(grown) if self.merge else grown
        return pa.table({"tree": pa.array([tree], pa.int32()), "node": pa.array([node], pa.int32()),
                         **{c: pa.array([b], pa.binary()) for c, b in zip(("feature", "code", "left", "value"), packed(grown), strict=True)}})


@dataclass
class Top:
    """The upper nodes of one tree, split in Spark rounds."""

    feature: list[int]
    code: list[int]
    left: list[int]
    mass: list[list[float] | None]
    depth: list[int]

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array(self.feature, dtype=np.int16), np.array(self.code, dtype=np.uint8), np.array(self.left, dtype=np.int64)


def _rows_of(leaf: np.ndarray, nodes: set[int]) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(leaf, kind="stable")
    found, first = np.unique(leaf[order], return_index=True)
    for node, at in zip(found, np.split(order, first[1:]), strict=True):
        if int(node) in nodes:
            yield int(node), at


def grow_forest(cells: DataFrame, grower: Grower) -> list[tuple[int, bytes, bytes, bytes, bytes]]:
    """All trees of a forest over stored cells, packed."""
    spark, g = cells.sparkSession, grower
    n = cells.count()
    if not n:
        raise ValueError("no rows to fit on")
    slots = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    work = cells.withColumn("block", F.pmod(F.xxhash64("codes"), F.lit(-(-n // BLOCK_CELLS)))).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.lit(-(-g.trees // TREES_PER_TASK) - 1)))).repartition(slots, "block", "part")

    def choose(key: tuple, table: pa.Table) -> pa.Table:
        return g.cut(key, table)

    tops = [Top([-1], [0], [-1], [None], [0]) for _ in range(g.trees)]
    pieces: dict[tuple[int, int], tuple[bytes, bytes, bytes, bytes]] = {}
    small = {(t, 0) for t in range(g.trees)} if n <= TASK_CELLS or not g.depth else set()
    big = {(t, 0) for t in range(g.trees)} - small
    while big:
        wanted, arrays = {t: {k for u, k in big if u == t} for t, _ in big}, [t.arrays() for t in tops]

        def sums(key: tuple, table: pa.Table) -> pa.Table:
            out = []
            for tree, codes, y, w in g.draws(key, table):  # noqa: B023
                for node, at in _rows_of(walk(*arrays[tree], codes), wanted.get(tree, set())):  # noqa: B023
                    for j in g.tries(tree, node):  # noqa: B023
                        cell = codes[at, j].astype(np.int64) * g.classes + y[at]
                        count = np.bincount(cell)
                        used = np.flatnonzero(count)
                        code, label = np.divmod(used, g.classes)
                        out.append(pd.DataFrame({"tree": tree, "node": node, "feature": j, "code": code, "y": label,
                                                 "w": np.bincount(cell, weights=w[at])[used], "cells": count[used]}))
            empty = pd.DataFrame({c: [] for c in ("tree", "node", "feature", "code", "y", "w", "cells")})
            kinds = {"tree": "int32", "node": "int32", "feature": "int32", "code": "int32", "y": "int32", "w": "float64", "cells": "int64"}
            return pa.Table.from_pandas(pd.concat(out or [empty]).astype(kinds), preserve_index=False)

        added = work.groupBy("block", "part").applyInArrow(sums, SUM_COLUMNS).groupBy("tree", "node", "feature", "code", "y").agg(
            F.sum("w").alias("w"), F.sum("cells").alias("cells"))
        cuts = added.repartition(slots, "tree", "node").groupBy("tree", "node").applyInArrow(choose, CUT_COLUMNS).collect()
        big = set()
        for r in sorted(cuts, key=lambda r: (r["tree"], r["node"])):
            top, node = tops[r["tree"]], r["node"]
            if r["feature"] < 0:
                pieces[r["tree"], node] = packed(_leaf(r["mass"]))
                continue
            top.feature[node], top.code[node], top.left[node] = r["feature"], r["code"], len(top.left)
            for side in (0, 1):
                child, mass = len(top.left), r["mass"][side * g.classes:(side + 1) * g.classes]
                top.feature.append(-1), top.code.append(0), top.left.append(-1), top.mass.append(mass), top.depth.append(top.depth[node] + 1)
                if top.depth[child] >= g.depth or sum(m > 0 for m in mass) < 2:
                    pieces[r["tree"], child] = packed(_leaf(mass))
                else:
                    (big if r["cells"][side] > TASK_CELLS else small).add((r["tree"], child))
    below, arrays = {t: {k for u, k in small if u == t} for t, _ in small}, [t.arrays() for t in tops]
    depth = {(t, k): tops[t].depth[k] for t, k in small}

    def deal(key: tuple, table: pa.Table) -> pa.Table:
        rows = [(tree, node, key[0].as_py(), codes[at].tobytes(), y[at].astype(np.int32).tobytes(), w[at].astype(np.int32).tobytes())
                for tree, codes, y, w in g.draws(key, table) for node, at in _rows_of(walk(*arrays[tree], codes), below.get(tree, set()))]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        names = ("tree", "node", "block", "codes", "y", "w")
        return pa.table({c: pa.array([r[i] for r in rows], k) for i, (c, k) in enumerate(zip(names, kinds, strict=True))})

    def finish(key: tuple, table: pa.Table) -> pa.Table:
        return g.piece(key, table, depth)

    dealt = work.groupBy("block", "part").applyInArrow(deal, DRAWN_COLUMNS)
    grown = written(dealt.repartition(slots, "tree", "node").groupBy("tree", "node").applyInArrow(finish, PIECE_COLUMNS), "trees")
    for r in grown.toLocalIterator():
        pieces[r["tree"], r["node"]] = tuple(bytes(r[c]) for c in ("feature", "code", "left", "value"))
    return [(t, *_put_together(top, t, pieces, g.classes, g.merge)) for t, top in enumerate(tops) if any((t, k) in pieces for k in range(len(top.left)))]


def _leaf(mass: Sequence[float]) -> Nodes:
    return Nodes(np.array([-1], dtype=np.int16), np.zeros(1, dtype=np.uint8), np.array([-1], dtype=np.int32), np.array([mass], dtype=np.float64))


def _put_together(top: Top, tree: int, pieces: dict, classes: int, merge: bool = True) -> tuple[bytes, bytes, bytes, bytes]:
    """One tree from its top and the subtrees that hang below it."""
    if len(top.left) == 1:
        return pieces[tree, 0]
    for node in range(len(top.left) - 1, -1, -1):  # children have higher numbers
        a = top.left[node]
        ends = merge and a >= 0 and all(top.left[k] < 0 and len(pieces[tree, k][1]) == 1 for k in (a, a + 1))
        if ends and np.argmax(top.mass[a]) == np.argmax(top.mass[a + 1]):
            top.left[node] = -1
            pieces[tree, node] = packed(_leaf(np.add(top.mass[a], top.mass[a + 1])))
    for node in range(len(top.left) - 1, -1, -1):
        if top.mass[node] is None and top.left[node] >= 0:
            top.mass[node] = np.add(top.mass[top.left[node]], top.mass[top.left[node] + 1])
    feature, code, left = (list(a) for a in top.arrays())
    value = packed(Nodes(np.array(feature), np.array(code, dtype=np.uint8), np.array(left), np.array(top.mass, dtype=np.float64)))[3]
    value = list(np.frombuffer(value, np.float64).reshape(-1, classes))
    rest, made = [[], [], [], []], len(left)
    for node in range(len(top.left)):
        if top.left[node] >= 0 or (tree, node) not in pieces:
            continue
        f, c, a, v = (np.frombuffer(b, kind) for b, kind in zip(pieces[tree, node], (np.int16, np.uint8, np.int32, np.float64), strict=True))
        # the subtree's root takes the place of the top's leaf, its other nodes follow at the end
        a, v = np.where(a >= 0, a + made - 1, -1), v.reshape(-1, classes)
        feature[node], code[node], left[node], value[node] = f[0], c[0], a[0], v[0]
        for held, more in zip(rest, (f, c, a, v), strict=True):
            held.append(more[1:])
        made += len(a) - 1
    whole = [np.concatenate([np.array(own), *more]) for own, more in zip((feature, code, left, value), rest, strict=True)]
    kinds = (np.int16, np.uint8, np.int32, np.float64)
    return tuple(a.astype(k).tobytes() for a, k in zip(whole, kinds, strict=True))


def fit_cells(
    df: DataFrame, features: Sequence[str], label: Column, classes: int, trees: int, depth: int, min_rows: int, subset: str, bins: int, seed: int,
) -> CellForest:
    """A forest of all rows; ``label`` counts classes from 0. At most 256 bins, since a code is one byte."""
    if not 1 < bins <= 256:
        raise ValueError("2 to 256 bins")
    names = [f"_{i}" for i in range(len(features))]
    rows = written(df.select(*[F.col(f).cast("double").alias(n) for f, n in zip(features, names, strict=True)], label.cast("int").alias("_y")), "rows")
    borders = feature_borders(rows, names, bins)
    cells = written(binned_cells(rows, names, "_y", borders), "cells")
    grower = Grower(trees, classes, len(names), depth, min_rows, tried_features(subset, len(names)), bins, seed)
    return CellForest(grow_forest(cells, grower), borders, classes)


@dataclass
class CellForest:
    """Packed trees, one row each (``tree, feature, code, left, value``): node arrays as in :class:`Nodes`, and class shares."""

    trees: list[tuple[int, bytes, bytes, bytes, bytes]]
    borders: list[np.ndarray]
    classes: int
    name: str = field(default_factory=lambda: uuid.uuid4().hex)
    held: object = None

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """The trees (``TREE_COLUMNS``) and the borders (``BORDER_COLUMNS``)."""
        return (spark.createDataFrame([tuple(bytearray(x) if isinstance(x, bytes) else x for x in t) for t in self.trees], TREE_COLUMNS),
                spark.createDataFrame([(i, b.tolist()) for i, b in enumerate(self.borders)], BORDER_COLUMNS))

    def arrays(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Per tree: its number, feature, threshold (rows with x <= threshold go left), left and class shares of its nodes."""
        for tree, f, c, a, v in self.trees:
            feature, code, left = np.frombuffer(f, np.int16), np.frombuffer(c, np.uint8), np.frombuffer(a, np.int32)
            threshold = np.zeros(len(left))
            for j, cuts in enumerate(self.borders):
                at = (left >= 0) & (feature == j)
                threshold[at] = cuts[code[at]]
            yield tree, feature, threshold, left, np.frombuffer(v, np.float64).reshape(-1, self.classes)

    @classmethod
    def of_tables(cls, trees: DataFrame, borders: DataFrame, classes: int) -> CellForest:
        rows = sorted((r["tree"], *(bytes(r[c]) for c in ("feature", "code", "left", "value"))) for r in trees.toLocalIterator())
        return cls(rows, [np.array(r["borders"], dtype=np.float64) for r in sorted(borders.collect(), key=lambda r: r["pos"])], classes)

    def probabilities(self, df: DataFrame, features: Sequence[str]) -> Column:
        """Mean class shares over all trees for the rows of ``df``, a table or a stream."""
        if self.held is None:
            self.held = df.sparkSession.sparkContext.broadcast((self.trees, self.borders, self.classes))
        held, name = self.held, self.name

        @F.pandas_udf("array<double>")
        def shares(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            scores = _scores(name, held)
            for batch in batches:
                x = np.stack([s.to_numpy(dtype=np.float64, na_value=np.nan) for s in batch], axis=1)
                yield pd.Series(list(scores.of(bin_codes(x, scores.borders))), dtype=object)

        return shares(*[F.col(f).cast("double") for f in features])


class Scores:
    """Class shares of cells; those met before come from a bounded table."""

    def __init__(self, trees: list[tuple], borders: list[np.ndarray], classes: int):
        self.borders, self.classes = borders, classes
        self.trees = [(np.frombuffer(f, np.int16), np.frombuffer(c, np.uint8), np.frombuffer(a, np.int32),
                       np.frombuffer(v, np.float64).reshape(-1, classes)) for _, f, c, a, v in trees]
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, dtype=f"S{max(1, len(self.borders)) * 2}")
        self.known = np.zeros((0, self.classes))

    def of(self, codes: np.ndarray) -> np.ndarray:
        if not len(codes):
            return np.zeros((0, self.classes))
        # hex digits: fixed-width strings that sort and have no zero bytes
        text = np.frombuffer(codes.tobytes().hex().encode(), dtype=f"S{codes.shape[1] * 2}")
        keys, first, where = np.unique(text, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        new = self.keys[at] != keys if len(self.keys) else np.ones(len(keys), dtype=bool)
        got = np.empty((len(keys), self.classes))
        got[~new] = self.known[at[~new]]
        if new.any():
            got[new] = self.walked(codes[first[new]])
            if len(self.keys) + new.sum() > SEEN_CELLS:
                self.clear()
            both = np.concatenate([self.keys, keys[new]])
            order = np.argsort(both)
            self.keys, self.known = both[order], np.concatenate([self.known, got[new]])[order]
        return got[where]

    def walked(self, codes: np.ndarray) -> np.ndarray:
        total = np.zeros((len(codes), self.classes))
        for feature, code, left, value in self.trees:
            total += value[walk(feature, code, left, codes)]
        return total / np.maximum(total.sum(axis=1, keepdims=True), 1e-300)


_loaded: OrderedDict[str, Scores] = OrderedDict()


def _scores(name: str, held) -> Scores:
    """The forest of this worker, unpacked once; the last few are kept."""
    if name not in _loaded:
        while len(_loaded) >= 2:
            _loaded.popitem(last=False)
        _loaded[name] = Scores(*held.value)
    return _loaded[name]

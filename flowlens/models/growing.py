"""Many classification forests grown in one job, from training data that every task holds.

Searches, hold-outs and ablations refit the same table again and again. Here the refits of all settings, left-out units,
seeds and feature sets are one list of jobs; every (job, few trees) is a task, so as many trees grow side by side as there
are cores, and no fit waits for another. Validation and evaluation rows are scored whole.

Hold-outs train on all rows, counted by the bins of their features (``training_cells``). Searches and ablations train on a
sample of at most ``TRAIN_ROWS`` rows chosen by hash (the documented bound of what is broadcast: rows x (features + labels)
x 8 bytes).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.models.cell_forest import CellForest, Grower, grow_forest
from flowlens.models.tree_tables import TREE_COLUMNS
from flowlens.plans.recipes import hash01, running_totals
from flowlens.session import fresh_path, written

TRAIN_ROWS = 600_000
TREES_PER_TASK = 5
HIST_CELLS = 8_000_000
# rows that are folded to cells at once
FOLD_ROWS = 200_000
# codes (cells x features) of one group that a task holds, and of all groups; groups beyond grow in Spark rounds
GROUP_CODES = 4_000_000
HELD_CODES = 16_000_000
# shares of rows that a bootstrap draws 0, 1, 2, ... times
DRAWN_SHARES = np.array([math.exp(-1) / math.factorial(k) for k in range(17)])


@dataclass(frozen=True)
class Job:
    """One forest: its name, label column, the (column, value) left out of training, features, parameters and seed."""

    fit: str
    label: str
    trees: int
    depth: int
    min_rows: int
    subset: str  # features tried per node: "sqrt" or a share
    seed: int
    features: tuple[str, ...]
    without: tuple[str, str] | None = None
    balanced: bool = False
    attacks_only: bool = False
    synthetic: bool = False
    bins: int = 64


@dataclass
class Sample:
    """Training rows as arrays; codes of ``labels`` and ``units`` point into sorted lists of values."""

    features: list[str]
    x: np.ndarray
    codes: dict[str, np.ndarray]
    values: dict[str, list[str]]
    attack: np.ndarray
    synthetic: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=bool))

    def rows_of(self, job: Job) -> np.ndarray:
        keep = self.attack.copy() if job.attacks_only else np.ones(len(self.x), dtype=bool)
        if job.without:
            column, value = job.without
            if value in self.values[column]:
                keep &= self.codes[column] != self.values[column].index(value)
        if not job.synthetic:
            keep &= ~self.synthetic
        return np.flatnonzero(keep)

    def classes(self, job: Job) -> list[str]:
        """Class names in the order of a job's probabilities."""
        if job.label == "attack":
            return ["benign", "attack"]
        return [v for v in self.values[job.label] if not (job.attacks_only and v == "BENIGN")]

    def labels_of(self, job: Job, rows: np.ndarray) -> np.ndarray:
        if job.label == "attack":
            return self.attack[rows].astype(np.int64)
        names = self.classes(job)
        place = np.array([names.index(v) if v in names else 0 for v in self.values[job.label]], dtype=np.int64)
        return place[self.codes[job.label][rows]]

    def kind(self, job: Job) -> tuple:
        """Jobs with the same one share what :meth:`prepared` gives."""
        return job.without, job.features, job.label, job.attacks_only, job.synthetic, job.bins

    def prepared(self, job: Job) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, None]:
        """Cut points per feature of the job, codes and classes of its rows, and how many rows each stands for (one)."""
        rows = self.rows_of(job)
        x = self.x[rows][:, [self.features.index(f) for f in job.features]]
        cuts = _borders(x, job.bins) if len(rows) else []
        codes = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1) if len(rows) else x
        return cuts, codes, self.labels_of(job, rows), None


@dataclass
class Cells:
    """All training rows, counted by the bins of their features and their kind (labels and units), once per set of rows.

    ``kinds`` has a row per kind, so it tells which kinds a job trains on and their classes. A set of rows is what one unit
    left out (or none), and attacks only or not, leave; its cut points come from its own rows.
    """

    features: list[str]
    kinds: Sample
    cuts: dict[tuple, list[np.ndarray]]
    held: dict[tuple, tuple[np.ndarray, np.ndarray, np.ndarray]]  # codes, kinds and rows of the cells
    beyond: dict[tuple, DataFrame]  # sets with more cells than tasks hold: codes, kind, n

    def classes(self, job: Job) -> list[str]:
        return self.kinds.classes(job)

    def kind(self, job: Job) -> tuple:
        return *_rows_asked(job), job.label

    def classes_of(self, job: Job) -> np.ndarray:
        """The class of every kind."""
        return self.kinds.labels_of(job, np.arange(len(self.kinds.attack)))

    def prepared(self, job: Job) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        codes, kind, n = self.held[_rows_asked(job)]
        return self.cuts[_rows_asked(job)], codes, self.classes_of(job)[kind], n


def _rows_asked(job: Job) -> tuple:
    return job.without, job.attacks_only, job.bins


def _exact_borders(rows: DataFrame, features: Sequence[str], sets: Sequence[tuple], members: np.ndarray) -> list[list[np.ndarray]]:
    """Per set of rows and feature what :func:`_borders` gives for all its rows, without a row at the driver.

    Values are counted per feature and set, ranks come from their running totals; at most ``bins`` values per set and
    feature are collected.
    """
    each = F.explode(F.array(*[F.struct(F.lit(j).alias("_j"), F.col(f).alias("_v")) for j, f in enumerate(features)])).alias("_e")
    long = rows.select("_kind", each).select("_kind", "_e.*").where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    among = [F.col("_kind").isin([int(k) for k in np.flatnonzero(m)]) if m.any() else F.lit(False) for m in members]
    totals = running_totals(long, "_v", {f"_s{i}": F.count_if(c) for i, c in enumerate(among)}, ["_j"])
    bins = [s[-1] for s in sets]

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, v = batch.column("_j").to_numpy(zero_copy_only=False), batch.column("_v").to_numpy(zero_copy_only=False)
            for i, b in enumerate(bins):
                n, below, total = (batch.column(f"_s{i}{c}").to_numpy(zero_copy_only=False) for c in ("", "_below", "_total"))
                for j in np.unique(of):
                    here = np.flatnonzero((of == j) & (n > 0) & (below + n < total))
                    if not len(here):
                        continue
                    ranks = np.floor((total[here[0]] - 1) * (np.arange(1, b) / b))
                    upto = below[here] + n[here]
                    hit = here[np.searchsorted(ranks, upto, "left") > np.searchsorted(ranks, below[here], "left")]
                    yield pa.RecordBatch.from_pydict({
                        "i": pa.array(np.full(len(hit), i), pa.int32()), "j": pa.array(np.full(len(hit), j), pa.int32()), "v": pa.array(v[hit], pa.float64())})

    out = [[np.zeros(0)] * len(features) for _ in sets]
    found = totals.mapInArrow(pick, "i int, j int, v double").toPandas()
    for (i, j), v in found.groupby(["i", "j"])["v"]:
        out[i][j] = np.unique(v.to_numpy())
    return out


def training_cells(df: DataFrame, features: Sequence[str], attack: Column, columns: Sequence[str], jobs: Sequence[Job]) -> Cells:
    """Every row of ``df`` for the ``jobs``, which share ``features``; ``columns`` are the labels and units they name.

    What is held grows with the cells (bins, kinds), not with the rows. A feature with a missing number among the rows of a
    set is not split on there, as in a sample. At most 256 bins, since a code is one byte.
    """
    features, width, sets = list(features), len(features), list(dict.fromkeys(_rows_asked(j) for j in jobs))
    if any(list(j.features) != features or j.synthetic or not 1 < j.bins <= 256 for j in jobs):
        raise ValueError("cells hold the rows of jobs with the same features, no synthetic rows and 2 to 256 bins")
    rows = df.select(*[F.col(f).cast("double").alias(f) for f in features], *columns, F.coalesce(attack, F.lit(False)).alias("_attack"))
    missing = [F.count_if(F.col(f).isNull() | F.isnan(f)).alias(f"_m{j}") for j, f in enumerate(features)]
    met = rows.groupBy(*columns, "_attack").agg(F.count(F.lit(1)).alias("_n"), *missing).toPandas()
    if not len(met):
        raise ValueError("no rows to fit on")
    codes, values = {}, {}
    for c in columns:
        code, names = pd.factorize(met[c], sort=True)
        codes[c], values[c] = code.astype(np.int64), [str(v) for v in names]
    met = met.assign(**{f"_c_{c}": codes[c] for c in columns}).sort_values([*[f"_c_{c}" for c in columns], "_attack"])
    codes = {c: met[f"_c_{c}"].to_numpy() for c in columns}
    attacks = met["_attack"].to_numpy(dtype=bool)
    kinds = Sample(features, np.zeros((len(met), 0)), codes, values, attacks, np.zeros(len(met), dtype=bool))
    members = np.zeros((len(sets), len(met)), dtype=bool)
    for job in jobs:
        members[sets.index(_rows_asked(job)), kinds.rows_of(job)] = True
    number = F.lit(None).cast("int")
    for k in range(len(met)):
        same = F.col("_attack") == F.lit(bool(attacks[k]))
        for c in columns:
            same &= F.col(c).isNull() if codes[c][k] < 0 else F.coalesce(F.col(c).cast("string") == F.lit(values[c][codes[c][k]]), F.lit(False))
        number = F.when(same, F.lit(k)).otherwise(number)
    rows = written(rows.select(*features, number.alias("_kind")), "training")
    cuts = _exact_borders(rows, features, sets, members)
    lost = met[[f"_m{j}" for j in range(width)]].to_numpy()
    cuts = [[np.zeros(0) if lost[m, j].any() else c for j, c in enumerate(cs)] for cs, m in zip(cuts, members, strict=True)]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def folded(some: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(some)
            x, kind = [t[f].to_numpy() for f in features], t["_kind"].to_numpy().astype(np.int32)
            for i, cs in enumerate(cuts):
                at = np.flatnonzero(members[i][kind])
                if not len(at):
                    continue
                code = np.stack([np.searchsorted(c, v[at], side="left") for c, v in zip(cs, x, strict=True)], axis=1).astype(np.uint8)
                whole = np.ascontiguousarray(np.hstack([code, kind[at].view(np.uint8).reshape(-1, 4)]))
                cell, n = np.unique(whole.view(f"V{width + 4}").ravel(), return_counts=True)
                cell = cell.view(np.uint8).reshape(-1, width + 4)
                yield pa.RecordBatch.from_pydict({
                    "i": pa.array(np.full(len(n), i), pa.int32()), "codes": pa.array([r.tobytes() for r in cell[:, :width]], pa.binary()),
                    "kind": pa.array(np.ascontiguousarray(cell[:, width:]).view(np.int32).ravel()), "n": pa.array(n.astype(np.int64))})

        some, many = [], 0
        for batch in batches:
            some, many = [*some, batch], many + len(batch)
            if many >= FOLD_ROWS:
                yield from folded(some)
                some, many = [], 0
        if many:
            yield from folded(some)

    folds = rows.mapInArrow(fold, "i int, codes binary, kind int, n bigint").groupBy("i", "codes", "kind").agg(F.sum("n").alias("n"))
    cells = written(folds, "cells")
    sizes = {r["i"]: r["c"] for r in cells.groupBy("i").agg(F.count(F.lit(1)).alias("c")).collect()}
    small, taken = [], 0
    for i in sorted(range(len(sets)), key=lambda i: (sizes.get(i, 0), i)):
        if sizes.get(i, 0) * width <= GROUP_CODES and taken + sizes.get(i, 0) * width <= HELD_CODES:
            small, taken = [*small, i], taken + sizes.get(i, 0) * width
    # in their own order, so that draws never depend on how a shuffle ran
    got = cells.where(F.col("i").isin(small)).toArrow().sort_by([(c, "ascending") for c in ("i", "codes", "kind")])
    of, edges = got["i"].to_numpy(), {}
    for i in small:
        part = got.slice(np.searchsorted(of, i, "left"), sizes.get(i, 0))
        edges[sets[i]] = (np.frombuffer(b"".join(part["codes"].to_pylist()), dtype=np.uint8).reshape(-1, width),
                          part["kind"].to_numpy().astype(np.int16), part["n"].to_numpy())
    beyond = {sets[i]: cells.where(F.col("i") == i).drop("i") for i in range(len(sets)) if i not in small}
    return Cells(features, kinds, dict(zip(sets, cuts, strict=True)), edges, beyond)


def training_sample(
    df: DataFrame, features: Sequence[str], attack: Column, columns: Sequence[str], ids: Sequence[str],
    rows: int = TRAIN_ROWS, seed: int = 7, synthetic: Column | None = None,
) -> Sample:
    """At most about ``rows`` rows of ``df``, the same ones in every run; ``columns`` (labels, units) become codes."""
    n = df.count()
    if not n:
        raise ValueError("no rows to fit on")
    chosen = df if n <= rows else df.where(hash01(*[F.col(c) for c in ids], seed=seed) < rows / n)
    shown = synthetic if synthetic is not None else F.lit(False)
    got = chosen.select(*[F.col(f).cast("double").alias(f) for f in features], *columns, attack.alias("_attack"),
                        shown.alias("_synthetic"), F.xxhash64(F.lit(seed), *ids).alias("_o"), *[F.col(c).alias(f"_id{i}") for i, c in enumerate(ids)])
    table = got.toPandas().sort_values(["_o", *[f"_id{i}" for i in range(len(ids))]])
    codes, values = {}, {}
    for c in columns:
        code, names = pd.factorize(table[c], sort=True)
        codes[c], values[c] = code.astype(np.int64), [str(v) for v in names]
    return Sample(list(features), table[list(features)].to_numpy(dtype=np.float64), codes, values,
                  table["_attack"].to_numpy(dtype=bool), table["_synthetic"].to_numpy(dtype=bool))


def _borders(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Cut points per feature: quantiles of the rows at hand, so rows left out have no part in them."""
    out = []
    for j in range(x.shape[1]):
        found = np.unique(np.quantile(x[:, j], np.arange(1, bins) / bins, method="lower"))
        out.append(found[found < x[:, j].max()] if len(x) else found)
    return out


def _drawn(times: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """How often the rows of each cell are drawn together, and how many of them at all; every row by itself, Poisson(1)."""
    while True:
        rows = rng.multinomial(times, DRAWN_SHARES)  # rows drawn 0, 1, 2, ... times
        if rows[:, 1:].any():
            return rows @ np.arange(rows.shape[1]), times - rows[:, 0]


def grow_tree(
    codes: np.ndarray, y: np.ndarray, classes: int, borders: Sequence[np.ndarray], rng: np.random.Generator,
    depth: int, min_rows: int, tried: int, balanced: bool, bins: int, times: np.ndarray | None = None,
) -> tuple[np.ndarray, ...]:
    """One tree on a bootstrap sample by Gini gain, level by level: feature, threshold, left, right, class shares.

    With ``times`` a row stands for that many rows. ``min_rows`` counts the different rows that were drawn.
    """
    n, width = codes.shape
    if times is None:
        drawn = np.bincount(rng.integers(0, n, n), minlength=n)
        met = drawn > 0
    else:
        drawn, met = _drawn(times, rng)
    rows = np.flatnonzero(drawn)
    codes, y, weight, met = codes[rows].astype(np.int64), y[rows], drawn[rows].astype(np.float64), met[rows].astype(np.float64)
    if balanced:
        mass = np.bincount(y, weights=weight, minlength=classes)
        weight = weight * (weight.sum() / (max((mass > 0).sum(), 1) * np.maximum(mass, 1)))[y]
    feature, threshold, left, right = [-1], [0.0], [-1], [-1]
    share = [np.bincount(y, weights=weight, minlength=classes)]
    where = np.zeros(len(y), dtype=np.int64)  # place of the row's node among the level's nodes
    level = [0]
    for _ in range(depth):
        if not level:
            break
        step = max(1, HIST_CELLS // (bins * classes * width))
        best_gain, best_at = np.zeros(len(level)), np.full(len(level), -1, dtype=np.int64)
        allowed = np.argsort(rng.random((len(level), width)), axis=1)[:, :tried]
        ok = np.zeros((len(level), width), dtype=bool)
        np.put_along_axis(ok, allowed, True, axis=1)
        for lo in range(0, len(level), step):
            hi = min(lo + step, len(level))
            here = np.flatnonzero((where >= lo) & (where < hi))
            loc, yy, ww, mm = where[here] - lo, y[here], weight[here], met[here]
            for j in range(width):
                cell = loc * bins + codes[here, j]
                mass = np.bincount(cell * classes + yy, weights=ww, minlength=(hi - lo) * bins * classes).reshape(hi - lo, bins, classes)
                count = np.bincount(cell, weights=mm, minlength=(hi - lo) * bins).reshape(hi - lo, bins)
                below, n_below = np.cumsum(mass, axis=1)[:, :-1], np.cumsum(count, axis=1)[:, :-1]
                whole, n_whole = mass.sum(axis=1, keepdims=True), count.sum(axis=1, keepdims=True)
                above = whole - below
                wb, wa, wt = below.sum(axis=2), above.sum(axis=2), whole.sum(axis=2)
                gain = ((below ** 2).sum(axis=2) / np.maximum(wb, 1e-300) + (above ** 2).sum(axis=2) / np.maximum(wa, 1e-300)
                        - (whole ** 2).sum(axis=2) / np.maximum(wt, 1e-300))
                gain[(n_below < min_rows) | (n_whole - n_below < min_rows) | (n_below == 0) | (n_below == n_whole)] = -1
                gain[~ok[lo:hi, j]] = -1
                at = gain.argmax(axis=1)
                value = gain[np.arange(hi - lo), at]
                better = value > np.maximum(best_gain[lo:hi], 1e-9)
                best_gain[lo:hi][better] = value[better]
                best_at[lo:hi][better] = j * bins + at[better]
        split = np.flatnonzero(best_at >= 0)
        if not len(split):
            break
        child = np.full((len(level), 2), -1, dtype=np.int64)
        child[split] = np.arange(2 * len(split)).reshape(-1, 2)
        for s in split:
            j, b = divmod(int(best_at[s]), bins)
            node = level[s]
            feature[node], threshold[node] = j, float(borders[j][b])
            left[node], right[node] = len(feature), len(feature) + 1
            feature += [-1, -1]
            threshold += [0.0, 0.0]
            left += [-1, -1]
            right += [-1, -1]
        stay = best_at[where] >= 0
        codes, y, weight, met, where = codes[stay], y[stay], weight[stay], met[stay], where[stay]
        j, b = np.divmod(best_at[where], bins)
        where = child[where, (codes[np.arange(len(y)), j] > b).astype(np.int64)]
        mass = np.bincount(where * classes + y, weights=weight, minlength=2 * len(split) * classes).reshape(-1, classes)
        share += list(mass)
        level = [x for s in split for x in (left[level[s]], right[level[s]])]
        # a pure node is a leaf
        mixed = (mass > 0).sum(axis=1) > 1
        place = np.where(mixed, np.cumsum(mixed) - 1, -1)
        level = [x for x, m in zip(level, mixed, strict=True) if m]
        keep = mixed[where]
        codes, y, weight, met, where = codes[keep], y[keep], weight[keep], met[keep], place[where[keep]]
    value = np.stack(share)
    value = value / np.maximum(value.sum(axis=1, keepdims=True), 1e-300)
    return (np.array(feature, dtype=np.int32), np.array(threshold), np.array(left, dtype=np.int32),
            np.array(right, dtype=np.int32), value.ravel())


def _tried(subset: str, width: int) -> int:
    return max(1, int(np.sqrt(width)) if subset == "sqrt" else int(float(subset) * width))


def _grow_in_rounds(spark, cells: Cells, job: Job) -> DataFrame:
    """The trees of one job whose cells are more than a task holds: nodes are split in Spark rounds (see cell_forest).

    ``min_rows`` counts draws here, not different rows.
    """
    if job.balanced:
        raise ValueError("balanced forests grow on held cells only")
    asked, classes = _rows_asked(job), len(cells.classes(job))
    label = F.get(F.array(*[F.lit(int(y)) for y in cells.classes_of(job)]), F.col("kind"))
    table = written(cells.beyond[asked].groupBy("codes", label.alias("y")).agg(F.sum("n").alias("n")), "job_cells")
    width = len(cells.features)
    grower = Grower(job.trees, classes, width, job.depth, job.min_rows, _tried(job.subset, width), job.bins, job.seed, merge=False)
    forest = CellForest(grow_forest(table, grower), cells.cuts[asked], classes)
    return spark.createDataFrame([
        (job.fit, int(tree), feature.astype(np.int32).tolist(), threshold.tolist(), left.tolist(), np.where(left >= 0, left + 1, -1).tolist(), value.ravel().tolist())
        for tree, feature, threshold, left, value in forest.arrays()], TREE_COLUMNS)


def grow_forests(spark, sample: Sample | Cells, jobs: Sequence[Job], columns: Sequence[str] | None = None) -> DataFrame:
    """The trees of all jobs as a stored table (see tree_tables); feature numbers point into ``sample.features``."""
    beyond = [job for job in jobs if isinstance(sample, Cells) and _rows_asked(job) in sample.beyond]
    rest = [job for job in jobs if job not in beyond]
    shown = Cells(sample.features, sample.kinds, sample.cuts, sample.held, {}) if isinstance(sample, Cells) else sample
    held = spark.sparkContext.broadcast((shown, rest))
    pieces = [(i, k) for i, job in enumerate(rest) for k in range(0, job.trees, TREES_PER_TASK)]
    slots = max(1, min(len(pieces), 4 * spark.sparkContext.defaultParallelism))

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        data, todo = held.value
        ready: dict = {}
        for batch in batches:
            for i, k in zip(batch["job"], batch["first"], strict=True):
                job = todo[i]
                key = data.kind(job)
                if key not in ready:
                    ready.clear()
                    ready[key] = data.prepared(job)
                cuts, codes, y, times = ready[key]
                if not len(y):
                    continue
                at, out = [data.features.index(f) for f in job.features], []
                for tree in range(k, min(k + TREES_PER_TASK, job.trees)):
                    f, t, a, b, v = grow_tree(codes, y, len(data.classes(job)), cuts, np.random.default_rng([job.seed, tree]),
                                              job.depth, job.min_rows, _tried(job.subset, len(at)), job.balanced, job.bins, times)
                    out.append((job.fit, tree, np.where(f >= 0, np.array(at, dtype=np.int32)[f], -1).astype(np.int32), t, a, b, v))
                yield pd.DataFrame(out, columns=["fit", "tree", "feature", "threshold", "left", "right", "value"])

    # pieces of one job stay together, so that a task bins its rows once
    work = spark.createDataFrame(pieces, "job int, first int").repartitionByRange(slots, "job", "first")
    path = fresh_path(spark, "forests")
    work.mapInPandas(grow, TREE_COLUMNS).write.parquet(path)
    for job in beyond:
        _grow_in_rounds(spark, sample, job).write.mode("append").parquet(path)
    return spark.read.schema(TREE_COLUMNS).parquet(path)

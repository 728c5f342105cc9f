"""Quality rules: base counts of a text, and robust multivariate outliers per language and source.

Every text becomes a vector of transformed statistics. Per group (language and source) location and scatter are the
minimum covariance determinant estimate: of all subsets holding ``SUBSET`` of the group, the one whose covariance has
the smallest determinant. It is approached by concentration steps from three robust starts (coordinatewise medians,
tanh scores, spatial signs): keep the rows nearest to the present estimate, estimate again, until no group's determinant falls by 1 %.
A last reweighted step uses all rows within the 97.5 % ellipsoid. Texts beyond the cut-off by Mahalanobis distance go.

A step is two passes over a packed table of vectors (a row per Arrow batch and group), without the texts: tasks count
distances into fine buckets, Spark adds the counts up and finds the bucket where the subset ends; then tasks add up
moments of the rows inside, Spark adds those up. A group with a third of all rows is only counts and sums, nothing of it
is gathered, sampled or capped; estimates are a table that packed rows meet by a join.

Groups with fewer than ``LEAST_ROWS`` judged texts are pooled by language, and where that is too few, all together;
below ``2 * (P + 1)`` texts no estimate is made and the base rules decide alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.storage import stored
from flowlens.llm.words import Words, grams, words_of

# The base rules.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30  # of 100 words

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: The vector, and per statistic the smallest spread that is taken to be one: log of the mean word length, roots of
#: symbols per word, repeated lines per line and repeated words per word, log distinct words per log words, root of capitals per character.
FLOORS = (0.03, 0.1, 0.1, 0.1, 0.01, 0.03)
P = len(FLOORS)
SUBSET = 0.75
LEAST_ROWS = 100
CUT = 1e-5  # share of a normal population beyond the cut-off
#: Vectors of fewer words scatter more; a deviation is scaled by sqrt(n / (n + STEADY)).
STEADY = 100.0
STEPS = 30
SETTLED = 1e-2  # a log determinant that falls by less has settled
GRID, FINE = 512, 64
_PAIRS = np.triu_indices(P)
_NEWLINE = np.zeros(256, dtype=bool)
_NEWLINE[10] = True
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS.encode())] = True


# ---- statistics of a text

def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    run = np.concatenate([[0], np.cumsum(flags)])
    return run[offsets[1:]] - run[offsets[:-1]]


def _again(value: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value: whether it is found twice or more in its text, and whether an equal one comes before it."""
    order = np.lexsort((np.arange(len(value)), value, text))
    v, t = value[order], text[order]
    same = (v[1:] == v[:-1]) & (t[1:] == t[:-1])
    later, any_ = np.zeros(len(v), dtype=bool), np.zeros(len(v), dtype=bool)
    later[1:] = same
    any_[1:] |= same
    any_[:-1] |= same
    found, after = np.empty_like(any_), np.empty_like(later)
    found[order], after[order] = any_, later
    return found, after


def _repeated_words(w: Words) -> np.ndarray:
    """Words that lie in a window of ``WINDOW`` words found twice or more in the text."""
    owner, g = w.text_of_word(), grams(w.hashes, WINDOW)
    if not len(g):
        return np.zeros(len(w.offsets) - 1, dtype=np.int64)
    inside = np.flatnonzero(owner[:len(g)] == owner[WINDOW - 1:])
    twice, _ = _again(g[inside], owner[inside])
    cover = np.zeros(len(owner) + 1, dtype=np.int64)
    at = inside[twice]
    cover[:len(g)] += np.bincount(at, minlength=len(g))
    np.subtract.at(cover, at + WINDOW, 1)
    return _per_text(np.cumsum(cover[:-1]) > 0, w.offsets)


def statistics(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Piece by piece: first text, counts (texts x 5) and vectors (texts x P). Null texts have no words."""
    for w, lines in zip(words_of(texts), words_of(texts, gaps=_NEWLINE), strict=True):
        n = w.counts.astype(np.int64)
        owner = w.text_of_word()
        size = np.zeros(len(w.data) + 1, dtype=np.int64)
        np.cumsum((w.data & 0xC0) != 0x80, out=size[1:])
        chars = np.bincount(owner, weights=size[w.ends] - size[w.starts], minlength=len(n)).astype(np.int64)
        symbols = _per_text(_SYMBOL[w.data], w.text_offsets)
        capitals = _per_text((w.data >= 65) & (w.data <= 90), w.text_offsets)
        first_word = np.searchsorted(w.starts, lines.starts)
        worded = first_word < np.searchsorted(w.starts, lines.ends)
        line_of = lines.text_of_word()[worded]
        _, later = _again(lines.hashes[worded], line_of)
        n_lines = np.bincount(line_of, minlength=len(n))
        dup = np.bincount(line_of[later], minlength=len(n))
        repeated = _repeated_words(w)
        _, seen = _again(w.hashes, owner)
        distinct = n - np.bincount(owner[seen], minlength=len(n))
        words = np.maximum(n, 1)
        vector = np.stack([
            np.log(np.maximum(chars, 1) / words), np.sqrt(symbols / words), np.sqrt(dup / np.maximum(n_lines, 1)),
            np.sqrt(repeated / words), np.log(np.maximum(distinct, 1)) / np.log(np.maximum(n, 2)),
            np.sqrt(capitals / np.maximum(chars, 1))], axis=1)
        yield w.first, np.stack([n, chars, symbols, dup, repeated], axis=1).astype(np.int64), vector


def fails_base(counts: np.ndarray) -> np.ndarray:
    n, repeated = counts[:, 0], counts[:, 4]
    return (n < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * n)


# ---- packed vectors

_PACKED = "lang_key string, source_key string, doc_id array<long>, counts array<long>, vectors array<double>, judged long"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, counts, vectors in statistics(batch.column("text")):
            n = len(counts)
            part = batch.slice(first, n)
            keys = part.column("lang_key").to_pylist(), part.column("source_key").to_pylist()
            group, names = pd.factorize(pd.MultiIndex.from_arrays(keys))
            order = np.argsort(group, kind="stable")
            cuts = np.searchsorted(group[order], np.arange(len(names) + 1))
            counts, vectors = counts[order], vectors[order]
            judged = np.add.reduceat((~fails_base(counts)).astype(np.int64), cuts[:-1])
            ids = part.column("doc_id").take(pa.array(order))

            def lists(values: pa.Array, each: int, cuts: np.ndarray = cuts) -> pa.Array:
                return pa.ListArray.from_arrays(pa.array((cuts * each).astype(np.int32)), values)

            yield pa.RecordBatch.from_arrays([
                pa.array([x[0] for x in names], pa.string()), pa.array([x[1] for x in names], pa.string()), lists(ids, 1),
                lists(pa.array(counts.ravel()), len(COUNTS)), lists(pa.array(vectors.ravel()), P), pa.array(judged)],
                names=["lang_key", "source_key", "doc_id", "counts", "vectors", "judged"])


def _packed(docs: DataFrame) -> DataFrame:
    """Vectors of all rows by batch and group, each with its fit group (null where there is none)."""
    def key(c: str):
        return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), key("lang").alias("lang_key"), key("source").alias("source_key"))
    packed = stored(rows.mapInArrow(_pack, _PACKED), "vectors")
    sizes = packed.groupBy("lang_key", "source_key").agg(F.sum("judged").alias("n"))
    small = sizes.where(F.col("n") < LEAST_ROWS)
    pooled = small.groupBy("lang_key").agg(F.sum("n").alias("in_lang"))
    rest = pooled.where(F.col("in_lang") < LEAST_ROWS).agg(F.coalesce(F.sum("in_lang"), F.lit(0)).alias("in_rest"))
    # the number of texts in no group of their own: one number, so the driver may hold it
    enough = rest.first()["in_rest"] >= 2 * (P + 1)
    fit = sizes.join(pooled, "lang_key", "left").select(
        "lang_key", "source_key",
        F.when(F.col("n") >= LEAST_ROWS, F.concat_ws("|", F.lit("own"), F.length("lang_key"), "lang_key", "source_key"))
        .when(F.col("in_lang") >= LEAST_ROWS, F.concat(F.lit("lang|"), "lang_key"))
        .when(F.lit(enough), F.lit("rest")).alias("fit"))
    return stored(packed.join(fit, ["lang_key", "source_key"]).drop("lang_key", "source_key", "judged"), "grouped")


def _lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    c = batch.column(name)
    return c.offsets.to_numpy(), c.values.to_numpy(zero_copy_only=False)


def _rows(batch: pa.RecordBatch, *names: str) -> Iterator[tuple[str, tuple[np.ndarray, ...]]]:
    """Per packed row: fit group and the named lists; ``counts`` and ``vectors`` of all its texts, as matrices."""
    fits = batch.column("fit").to_pylist()
    flat = {n: _lists(batch, n) for n in ("counts", "vectors", *names)}
    for i, fit in enumerate(fits):
        got = {n: v[at[i]:at[i + 1]] for n, (at, v) in flat.items()}
        yield fit, (got["counts"].reshape(-1, len(COUNTS)), got["vectors"].reshape(-1, P), *[got[n] for n in names])


def _scaled(counts: np.ndarray, vectors: np.ndarray, centre: np.ndarray, spread: np.ndarray) -> np.ndarray:
    n = counts[:, :1].astype(np.float64)
    return np.sqrt(n / (n + STEADY)) * (vectors - centre) / spread


def _distances(y: np.ndarray, mean: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    z = y - mean
    return np.maximum(np.einsum("ij,jk,ik->i", z, inverse.reshape(P, P), z), 0)


def _bucket(d2: np.ndarray) -> np.ndarray:
    return np.floor(FINE * np.log2(d2 + 2.0 ** -20)).astype(np.int64)


def _in_tasks(table: DataFrame, count: Callable, names: tuple[str, ...], schema: str) -> DataFrame:
    """Run ``count(fit, counts, vectors, *lists) -> rows`` over judged texts; one Arrow batch out per batch in."""
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for fit, (counts, vectors, *more) in _rows(batch, *names):
                keep = ~fails_base(counts)
                if keep.any():
                    out += count(fit, counts[keep], vectors[keep], *more)
            if out:
                yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=columns), preserve_index=False)

    return table.mapInArrow(run, schema)


# ---- robust starts

def _cells(fit: str, counts: np.ndarray, vectors: np.ndarray) -> list[tuple]:
    out = []
    for j in range(P):
        cell, n = np.unique(np.rint(vectors[:, j] * GRID).astype(np.int64), return_counts=True)
        out += [(fit, j, int(c), int(k)) for c, k in zip(cell, n, strict=True)]
    return out


def _centres(rows: pd.DataFrame) -> pd.DataFrame:
    """Median and median deviation per statistic, from counts on a fixed grid (at most a few thousand cells per group)."""
    centre, spread = np.zeros(P), np.array(FLOORS)
    for j, part in rows.groupby("stat"):
        part = part.sort_values("cell")
        x, n = part["cell"].to_numpy() / GRID, part["n"].to_numpy()
        centre[j] = x[np.searchsorted(np.cumsum(n), n.sum() / 2)]
        away = np.abs(x - centre[j])
        order = np.argsort(away, kind="stable")
        spread[j] = max(FLOORS[j], 1.4826 * away[order][np.searchsorted(np.cumsum(n[order]), n.sum() / 2)])
    total = int(rows.loc[rows["stat"] == 0, "n"].sum())
    return pd.DataFrame({"fit": rows["fit"].iloc[:1], "n": [total], "centre": [centre], "spread": [spread]})


def _moments(y: np.ndarray, weight: np.ndarray | None = None) -> list[float]:
    w = np.ones(len(y)) if weight is None else weight
    second = (y * w[:, None]).T @ y
    return [float(w.sum()), *(w @ y).tolist(), *second[_PAIRS].tolist()]


def _start_moments(fit: str, counts: np.ndarray, vectors: np.ndarray, centre: np.ndarray, spread: np.ndarray) -> list[tuple]:
    y = _scaled(counts, vectors, centre, spread)
    sign = y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-9)
    return [(fit, 1, _moments(np.tanh(y))), (fit, 2, _moments(sign))]


def _summed(rows: DataFrame) -> DataFrame:
    """Moments added up per group and start, element by element."""
    size = 1 + P + len(_PAIRS[0])
    return rows.groupBy("fit", "start").agg(*[F.sum(F.col("moments")[i]).alias(f"m{i}") for i in range(size)]).select(
        "fit", "start", F.array(*[f"m{i}" for i in range(size)]).alias("moments"))


# ---- estimates

def _chi2(p: float, share: float) -> float:
    """Quantile of chi square by the cube-root normal approximation."""
    return p * (1 - 2 / (9 * p) + NormalDist().inv_cdf(share) * (2 / (9 * p)) ** 0.5) ** 3


def _chi2_share(p: float, x: float) -> float:
    return NormalDist().cdf(((x / p) ** (1 / 3) - 1 + 2 / (9 * p)) / (2 / (9 * p)) ** 0.5)


def estimate(moments: np.ndarray, share: float, correlation_only: bool = False) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean, inverse covariance (flat) and log determinant from weight, sums and products of scaled rows.

    The covariance of a truncated sample is made consistent for a normal population. A statistic that varies by less than
    its floor (say, no symbols at all) gets the missing variance as if by independent noise, so no determinant is ever zero.
    """
    n = max(moments[0], 1.0)
    mean = moments[1:1 + P] / n
    cov = np.zeros((P, P))
    cov[_PAIRS] = moments[1 + P:] / n
    cov = cov + np.triu(cov, 1).T - np.outer(mean, mean)
    if correlation_only:
        mean = np.zeros(P)
        cov = cov / np.sqrt(np.outer(np.maximum(np.diag(cov), 1e-3), np.maximum(np.diag(cov), 1e-3)))
    else:
        varied = max(int((np.diag(cov) > 0.05).sum()), 1)
        cov = cov * share / max(_chi2_share(varied + 2, _chi2(varied, share)), 1e-3)
    cov = cov + np.diag(np.maximum(1 - np.diag(cov), 0)) + 0.05 * np.eye(P)
    return mean, np.linalg.inv(cov).ravel(), float(np.linalg.slogdet(cov)[1])


_ESTIMATES = "fit string, start long, mean array<double>, inverse array<double>, logdet double"


def _estimates(summed: DataFrame, share: float, correlation_only: bool = False) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, flat = _lists(batch, "moments")
            found = [estimate(flat[at[i]:at[i + 1]], share, correlation_only) for i in range(len(batch))]
            yield pa.RecordBatch.from_arrays([
                batch.column("fit"), batch.column("start"), pa.array([m.tolist() for m, _, _ in found], pa.list_(pa.float64())),
                pa.array([i.tolist() for _, i, _ in found], pa.list_(pa.float64())), pa.array([d for _, _, d in found], pa.float64())],
                names=["fit", "start", "mean", "inverse", "logdet"])

    return summed.mapInArrow(run, _ESTIMATES)


def _distance_cells(fit: str, counts: np.ndarray, vectors: np.ndarray, centre, spread, start, mean, inverse) -> list[tuple]:
    y, out = _scaled(counts, vectors, centre, spread), []
    for k, s in enumerate(start):
        cell, n = np.unique(_bucket(_distances(y, mean[k * P:(k + 1) * P], inverse[k * P * P:(k + 1) * P * P])), return_counts=True)
        out += [(fit, int(s), int(c), int(m)) for c, m in zip(cell, n, strict=True)]
    return out


def _inner_moments(fit: str, counts: np.ndarray, vectors: np.ndarray, centre, spread, start, mean, inverse, edge, part) -> list[tuple]:
    """Moments of the rows before the bucket where the subset ends, and of that bucket's rows by the share that still fits."""
    y, out = _scaled(counts, vectors, centre, spread), []
    for k, s in enumerate(start):
        cell = _bucket(_distances(y, mean[k * P:(k + 1) * P], inverse[k * P * P:(k + 1) * P * P]))
        weight = np.where(cell < edge[k], 1.0, np.where(cell == edge[k], part[k], 0.0))
        out.append((fit, int(s), _moments(y, weight)))
    return out


def _edges(cells: DataFrame, share: float) -> DataFrame:
    """Per group and start the bucket in which the nearest ``share`` of the rows ends, and the share of that bucket taken."""
    def find(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("cell")
        n = rows["n"].to_numpy()
        want, upto = max(np.ceil(share * n.sum()), 1.0), np.cumsum(n)
        i = int(np.searchsorted(upto, want))
        return pd.DataFrame({"fit": rows["fit"].iloc[:1], "start": rows["start"].iloc[:1], "edge": [int(rows["cell"].iloc[i])],
                             "part": [float((want - (upto[i] - n[i])) / n[i])]})

    summed = cells.groupBy("fit", "start", "cell").agg(F.sum("n").alias("n"))
    return summed.groupBy("fit", "start").applyInPandas(find, "fit string, start long, edge long, part double")


def _per_fit(estimates: DataFrame, *more: str) -> DataFrame:
    """All starts of a group side by side (three at most), in one row."""
    listed = F.array_sort(F.collect_list(F.struct("start", "mean", "inverse", *more)))
    per = estimates.groupBy("fit").agg(listed.alias("all"))
    return per.select("fit", F.col("all.start").alias("start"), F.flatten("all.mean").alias("mean"), F.flatten("all.inverse").alias("inverse"),
                      *[F.col(f"all.{m}").alias(m) for m in more])


def fit_groups(packed: DataFrame) -> DataFrame:
    """``fit, centre, spread, mean, inverse``: the reweighted estimate of each fit group."""
    judged = packed.where(F.col("fit").isNotNull()).select("fit", "counts", "vectors")
    cells = _in_tasks(judged, _cells, (), "fit string, stat long, cell long, n long")
    centres = stored(cells.groupBy("fit", "stat", "cell").agg(F.sum("n").alias("n")).groupBy("fit").applyInPandas(
        _centres, "fit string, n long, centre array<double>, spread array<double>"), "centres")
    known = judged.join(centres.drop("n"), "fit")
    moment_row = "fit string, start long, moments array<double>"
    around = ("centre", "spread", "start", "mean", "inverse")

    starts = _estimates(_summed(_in_tasks(known, _start_moments, ("centre", "spread"), moment_row)), SUBSET, correlation_only=True)
    unit = starts.where("start = 1").withColumns({"start": F.lit(0).cast("long"), "inverse": F.lit(np.eye(P).ravel().tolist()), "logdet": F.lit(1e300)})
    now = stored(unit.unionByName(starts.withColumn("logdet", F.lit(1e300))), "starts")

    def refined(now: DataFrame, share: float) -> DataFrame:
        cells = _in_tasks(known.join(_per_fit(now), "fit"), _distance_cells, around, "fit string, start long, cell long, n long")
        edges = stored(now.join(_edges(cells, share), ["fit", "start"]), "edges")
        inner = _in_tasks(known.join(_per_fit(edges, "edge", "part"), "fit"), _inner_moments, (*around, "edge", "part"), moment_row)
        return stored(_estimates(_summed(inner), share), "estimates")

    for _ in range(STEPS):
        after = refined(now, SUBSET)
        falls = after.alias("a").join(now.alias("b"), ["fit", "start"]).where(F.col("a.logdet") < F.col("b.logdet") - SETTLED).limit(1).count()
        now = after
        if not falls:
            break
    best = now.groupBy("fit").agg(F.min("logdet").alias("logdet"))
    best = now.join(best, ["fit", "logdet"]).groupBy("fit", "logdet").agg(F.min("start").alias("start"))
    chosen = stored(now.join(best.select("fit", "start"), ["fit", "start"]), "chosen")
    # reweighting: every row inside the 97.5 % ellipsoid of the raw estimate counts
    edge = int(_bucket(np.array([_chi2(P, 0.975)]))[0])
    inside = chosen.withColumns({"edge": F.lit(edge).cast("long"), "part": F.lit(1.0)})
    inner = _in_tasks(known.join(_per_fit(inside, "edge", "part"), "fit"), _inner_moments, (*around, "edge", "part"), moment_row)
    final = _estimates(_summed(inner), 0.975)
    return stored(centres.drop("n").join(final.select("fit", "mean", "inverse"), "fit"), "estimates")


def quality_rules(docs: DataFrame) -> DataFrame:
    """``doc_id``, the five counts, ``base_failed``, ``kept`` and ``distance`` per row of ``docs``.

    Columns read: ``doc_id, text, lang, source``; others may have any names. Null and empty texts have no words and fail the
    base rules; a null language or source is a group of its own. Rows with equal ids or texts are judged each, and count
    each in the estimates. Texts that fail the base rules take no part in them; their distance is null, as it is where no
    estimate exists. An empty table gives an empty result.
    """
    packed = _packed(docs)
    ready = packed.join(fit_groups(packed), "fit", "left")
    limit = _chi2(P, 1 - CUT)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (_, (counts, vectors, centre, spread, mean, inverse)) in enumerate(_rows(batch, "centre", "spread", "mean", "inverse")):
                failed = fails_base(counts)
                distance = np.full(len(counts), np.nan)
                if len(centre):
                    distance = _distances(_scaled(counts, vectors, centre, spread), mean, inverse)
                unknown = failed | np.isnan(distance)
                kept = ~failed & ~(distance > limit)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id")[i].values, *[pa.array(np.ascontiguousarray(counts[:, j])) for j in range(len(COUNTS))],
                    pa.array(failed), pa.array(kept), pa.array(np.sqrt(np.where(unknown, 0, distance)), mask=unknown)],
                    names=["doc_id", *COUNTS, "base_failed", "kept", "distance"])

    return ready.mapInArrow(judge, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, distance double")

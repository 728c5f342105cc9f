"""Learning from trusted positives and unlabelled texts: non-negative unbiased risk with a class prior.

With positives P, unlabelled U and prior p, the risk of a score g under the logistic loss l is

    p * mean_P l(g) + max(0, mean_U l(-g) - p * mean_P l(-g))

The second part estimates the risk on negatives without any; where a step makes it negative, the model has
begun to memorise and the step goes the other way. The logistic loss makes sigmoid(g) a probability.

The fit runs in numpy on a bounded, documented sample of rows (``POSITIVES``, ``UNLABELLED``), chosen by a hash of
their ids; scores cover all rows. Labels are learnt from only where crc32(doc_id) mod 5 is not 0;
unlabelled texts of the sample are held to the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.storage import stored
from flowlens.llm.words import SIGNS, Words, words_of

POSITIVES = 8_192
UNLABELLED = 16_384
HASH_BITS = 18
FOLDS = 5
LEAST_FOR_PRIOR = 50


def fold_of(doc_id: Column) -> Column:
    """Fold 0 is kept for testing; a null id counts as an empty one."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(FOLDS))


def held_out(doc_id: Column) -> Column:
    return fold_of(doc_id) == 0


# ---- what a text looks like

def style_of(w: Words) -> np.ndarray:
    """Per text: shares of each ASCII character, capitals, words that repeat the one before, distinct words, sizes."""
    n = len(w.offsets) - 1
    sizes = np.diff(w.text_offsets)
    owner = np.repeat(np.arange(n), sizes)
    chars = np.bincount(owner * 129 + np.minimum(w.data, 128), minlength=n * 129).reshape(n, 129).astype(np.float64)
    words = np.maximum(w.counts, 1)[:, None]
    text = w.text_of_word()
    again = np.zeros(len(text), dtype=bool)
    again[1:] = (w.hashes[1:] == w.hashes[:-1]) & (text[1:] == text[:-1])
    repeats = np.bincount(text[again], minlength=n)[:, None] / words
    order = np.lexsort((w.hashes, text))
    h, t = w.hashes[order], text[order]
    first = np.ones(len(h), dtype=bool)
    first[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    distinct = np.bincount(t[first], minlength=n)[:, None] / np.sqrt(words)
    upper = chars[:, 65:91].sum(axis=1, keepdims=True)
    share = np.hstack([np.delete(chars, np.r_[65:91, 97:123], axis=1), upper]) / np.maximum(sizes, 1)[:, None]
    length = np.log1p(sizes)[:, None]
    return np.hstack([np.sqrt(share), np.minimum(share * 20, 1), repeats, np.sqrt(repeats), np.log1p(distinct),
                      length, np.log(np.maximum(sizes[:, None], 1) / words)])


def word_buckets(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash bucket of every word."""
    return w.text_of_word(), (w.hashes >> np.uint64(64 - HASH_BITS)).astype(np.int64)


def _distinct(text: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique(text.astype(np.int64) << HASH_BITS | bucket)
    return key >> HASH_BITS, key & ((1 << HASH_BITS) - 1)


# ---- the model

@dataclass
class Model:
    """A linear score over style features, words, or both; ``probability`` of each text of a piece."""

    mean: np.ndarray
    scale: np.ndarray
    style: np.ndarray
    words: np.ndarray  # weight per hash bucket; empty when words are not used
    bias: float

    def probability(self, plain: Words, spoken: Words | None) -> np.ndarray:
        g = np.full(len(plain.offsets) - 1, self.bias)
        if len(self.style):
            g += np.clip((style_of(plain) - self.mean) / self.scale, -5, 5) @ self.style
        if len(self.words) and spoken is not None:
            text, bucket = word_buckets(spoken)
            known = np.flatnonzero(self.words[bucket])
            t, b = _distinct(text[known], bucket[known])
            g += np.bincount(t, weights=self.words[b], minlength=len(g))
        # rounded: the last digits depend on how rows are batched
        return np.round(1 / (1 + np.exp(-np.clip(g, -30, 30))), 9)


def fit_nnpu(positive: np.ndarray, features: np.ndarray, prior: float, l2: float, steps: int = 400, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk; rows are positives where ``positive``, else unlabelled."""
    p, u = (features[rows].astype(np.float32, copy=False) for rows in (positive, ~positive))
    w, bias = np.zeros(features.shape[1]), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)

    def sigmoid(g: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(g, -30, 30)))

    for step in range(1, steps + 1):
        gp, gu = (x @ w.astype(np.float32) + bias for x in (p, u))
        sp, su = sigmoid(gp), sigmoid(gu)
        risk = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        for_p, for_u = prior * (sp - 1) / len(p), np.zeros(len(u))
        if risk >= 0:
            for_p, for_u = for_p - prior * sp / len(p), su / len(u)
        else:
            for_p, for_u = prior * sp / len(p), -su / len(u)
        grad = np.concatenate([
            p.T @ for_p.astype(np.float32) + u.T @ for_u.astype(np.float32) + l2 * w, [for_p.sum() + for_u.sum()]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        move = rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return w, float(bias)


def _telling(c_p: np.ndarray, c_u: np.ndarray, n_p: int, n_u: int, least_z: float, most: int) -> np.ndarray:
    """Buckets whose share of texts differs between positives and unlabelled by ``least_z`` standard errors."""
    pooled = (c_p + c_u + 1) / (n_p + n_u + 2)
    z = (c_p / max(n_p, 1) - c_u / max(n_u, 1)) / np.sqrt(pooled * (1 - pooled) * (1 / max(n_p, 1) + 1 / max(n_u, 1)))
    best = np.argsort(-np.abs(z), kind="stable")[:most]
    return best[np.abs(z[best]) >= least_z]


def estimate_prior(of_positives: np.ndarray, of_unlabelled: np.ndarray, delta: float = 0.1, gamma: float = 0.01) -> float:
    """Share of positives among unlabelled texts, from scores that no model was fitted on.

    Above any score c the unlabelled texts hold at least the positives: q_U(c) >= prior * q_P(c). Where only positives are
    left above c, the ratio is the prior itself. The c is taken at which the ratio plus its sampling error is smallest.
    """
    cuts = np.unique(of_positives)
    q_p = 1 - np.searchsorted(np.sort(of_positives), cuts, side="left") / len(of_positives)
    q_u = 1 - np.searchsorted(np.sort(of_unlabelled), cuts, side="left") / len(of_unlabelled)
    error = np.sqrt(np.log(4 / delta) / 2) * (len(of_positives) ** -0.5 + len(of_unlabelled) ** -0.5)
    best = int(np.argmin((q_u + (1 + gamma) * error) / q_p))
    return float(np.clip(q_u[best] / q_p[best], 0.001, 0.999))


def _sample(docs: DataFrame, labels: DataFrame, label: str, positives: int, unlabelled: int, without: Sequence[int]) -> tuple[DataFrame, float]:
    """``doc_id, text, positive`` of the rows to fit on, and the share of positives among labelled rows outside the test fold.

    At most ``positives + unlabelled`` rows, whatever rows share an id: of those the smallest text stands for all.
    """
    def may_learn() -> Column:
        return ~fold_of(F.col("doc_id")).isin([0, *without])

    known = labels.select("doc_id", F.col(label).alias("_label")).where(F.col("_label").isNotNull() & may_learn())
    ones, all_rows = known.agg(F.coalesce(F.sum((F.col("_label") == 1).cast("long")), F.lit(0)), F.count(F.lit(1))).first()
    by_hash = F.xxhash64(F.lit(31), "doc_id")
    trusted = known.where("_label = 1").select("doc_id").distinct().orderBy(by_hash, "doc_id").limit(positives)
    # unlabelled texts: their labels, where there are any, are not looked at
    pool = docs.select("doc_id").where(F.col("doc_id").isNotNull() & may_learn()).distinct()
    pool = pool.orderBy(F.xxhash64(F.lit(37), "doc_id"), "doc_id").limit(unlabelled)
    ids = trusted.select("doc_id", F.lit(True).alias("positive")).unionByName(pool.select("doc_id", F.lit(False).alias("positive")))
    # at most positives + unlabelled ids of 8 bytes: the limits above bound what is broadcast
    picked = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    return picked.groupBy("doc_id", "positive").agg(F.min("text").alias("text")), (ones + 1) / (all_rows + 2)


def _chosen_words(rows: DataFrame, least_z: float, most: int) -> np.ndarray:
    """The telling buckets; Spark counts them, at most 2^HASH_BITS counts reach the driver."""
    n_p, n_u = rows.agg(F.count_if("positive"), F.count_if(~F.col("positive"))).first()
    per = rows.select("positive", F.explode("words").alias("bucket")).groupBy("bucket").agg(
        F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("u")).toArrow()
    counts = np.zeros((2, 1 << HASH_BITS))
    counts[:, per["bucket"].to_numpy()] = per["p"].to_numpy(), per["u"].to_numpy()
    return _telling(counts[0], counts[1], n_p, n_u, least_z, most)


def train(docs: DataFrame, labels: DataFrame, label: str, style: bool, words: bool, l2: float = 1e-3,
          least_z: float = 4.0, most_words: int = 1_000, steps: int = 400, distinct: bool = False, positives: int = POSITIVES,
          unlabelled: int = UNLABELLED, without: Sequence[int] = ()) -> Model | None:
    """The fitted model, or None without any trusted positive or unlabelled text to learn from.

    With ``distinct`` texts that are alike in all features count once per side, so that the words of a group of copies
    are no evidence. ``without`` names folds that are left out beside the test fold. The class prior is estimated over the
    unlabelled half of the sample that a first fit does not see; a sample too small for that keeps the share of labels.
    What reaches the driver is at most ``positives + unlabelled`` rows of the style features and ``most_words`` word places.
    """
    picked, share = _sample(docs, labels, label, positives, unlabelled, without)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain = words_of(batch.column("text"))
            spoken = words_of(batch.column("text"), lower=True, gaps=SIGNS)
            for a, b in zip(plain, spoken, strict=True):
                n = len(a.offsets) - 1
                dense = style_of(a) if style else np.zeros((n, 0))
                t, k = _distinct(*word_buckets(b)) if words else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                cuts = np.searchsorted(t, np.arange(n + 1))
                at = np.arange(0, n * dense.shape[1] + 1, max(dense.shape[1], 1)) if dense.shape[1] else np.zeros(n + 1)
                yield pa.RecordBatch.from_arrays([
                    batch.column("positive").slice(a.first, n),
                    pa.ListArray.from_arrays(at.astype(np.int32), dense.astype(np.float32).ravel()),
                    pa.ListArray.from_arrays(cuts.astype(np.int32), k.astype(np.int32)),
                ], names=["positive", "style", "words"])

    rows = picked.mapInArrow(features, "positive boolean, style array<float>, words array<int>").withColumn("look", F.xxhash64("style", "words"))
    rows = stored(rows.dropDuplicates(["positive", "look"]) if distinct else rows, "features")
    chosen = _chosen_words(rows, least_z, most_words) if words else np.zeros(0, dtype=np.int64)
    place = np.full(1 << HASH_BITS, -1, dtype=np.int32)
    place[chosen] = np.arange(len(chosen))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("words")
            at, found = held.offsets.to_numpy(), place[held.values.to_numpy(zero_copy_only=False)]
            upto = np.concatenate([[0], np.cumsum(found >= 0)])[at]
            yield pa.RecordBatch.from_arrays([
                batch.column("positive"), batch.column("look"), batch.column("style"),
                pa.ListArray.from_arrays((upto - upto[0]).astype(np.int32), found[at[0]:at[-1]][found[at[0]:at[-1]] >= 0])], names=["positive", "look", "style", "words"])

    seen = rows.select("positive", "look", "style", "words").mapInArrow(told, "positive boolean, look long, style array<float>, words array<int>").toArrow()
    # rows that tie are alike, so the order of the sums is always the same
    seen = seen.sort_by([("look", "ascending"), ("positive", "ascending")]).combine_chunks()
    positive = np.array(seen["positive"].to_pylist(), dtype=bool)
    if not positive.any() or positive.all():
        return None

    def flat(name: str) -> np.ndarray:
        return seen[name].combine_chunks().flatten().to_numpy(zero_copy_only=False)

    mean = scale = np.zeros(0)
    dense = flat("style").astype(np.float64).reshape(len(positive), -1)
    if style:
        mean, scale = dense.mean(axis=0), dense.std(axis=0) + 1e-3
        dense = np.clip((dense - mean) / scale, -5, 5)
    lengths = np.diff(seen["words"].combine_chunks().offsets.to_numpy())
    grid = np.zeros((len(positive), len(mean) + len(chosen)), dtype=np.float32)
    grid[:, :len(mean)] = dense
    grid[np.repeat(np.arange(len(positive)), lengths), len(mean) + flat("words").astype(np.int64)] = 1

    prior = share
    first = (seen["look"].combine_chunks().to_numpy() >> 7) % 2 == 0
    if min(positive[first].sum(), positive[~first].sum(), (~positive[first]).sum(), (~positive[~first]).sum()) >= LEAST_FOR_PRIOR:
        w, bias = fit_nnpu(positive[first], grid[first], share, l2, min(steps, 400))
        score = grid[~first] @ w.astype(np.float32) + bias
        prior = estimate_prior(score[positive[~first]], score[~positive[~first]])
    w, bias = fit_nnpu(positive, grid, prior, l2, steps)
    table = np.zeros(1 << HASH_BITS if words else 0, dtype=np.float64)
    table[chosen] = w[len(mean):]
    return Model(mean, scale, w[:len(mean)], table, bias)


def cross_validate(
    docs: DataFrame, labels: DataFrame, label: str, settings: Sequence[dict], threshold: float, **how,
) -> list[tuple[dict, float, float]]:
    """Per setting the mean recall of 1s and of 0s over the learning folds, each scored by a model that never saw it.

    The test fold has no part in it, so settings chosen by these figures may be judged on that fold.
    """
    known = labels.select("doc_id", F.col(label).alias("_y")).where(F.col("_y").isNotNull()).distinct()
    out = []
    for setting in settings:
        found = []
        for fold in range(1, FOLDS):
            model = train(docs, labels, label, without=(fold,), **how, **setting)
            mine = docs.where(fold_of(F.col("doc_id")) == fold)
            got = scored(mine, model, threshold).join(known, "doc_id")
            found.append(got.agg(*[F.avg(F.when(F.col("_y") == y, (F.col("predicted") == y).cast("double"))) for y in (1, 0)]).first())
        ones, zeros = (float(np.mean([f[i] for f in found if f[i] is not None])) for i in (0, 1))
        out.append((setting, ones, zeros))
    return out


def scored(docs: DataFrame, model: Model | None, threshold: float) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row; without a model every score is 0.5."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if model is None:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.full(len(batch), 0.5))], names=["doc_id", "score"])
                continue
            use_words = bool(len(model.words))
            spoken = words_of(batch.column("text"), lower=True, gaps=SIGNS) if use_words else None
            for a in words_of(batch.column("text")) if len(model.style) or not use_words else spoken:
                own = (a if not len(model.style) else next(spoken)) if use_words else None
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(a.first, len(a.offsets) - 1), pa.array(model.probability(a, own))], names=["doc_id", "score"])

    rows = docs.select("doc_id", "text").mapInArrow(score, "doc_id long, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))




def accepted(docs: DataFrame, model: Model | None, threshold: float) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with all their columns, decided where they are read."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if model is None:
                yield batch
                continue
            spoken = words_of(batch.column("text"), lower=True, gaps=SIGNS) if len(model.words) else None
            for w in words_of(batch.column("text")):
                good = model.probability(w, next(spoken) if spoken else None) >= threshold
                yield batch.slice(w.first, len(good)).filter(pa.array(good))

    return docs.mapInArrow(keep, docs.schema)

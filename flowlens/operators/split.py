"""Time-blocked splits, samples, weights and slices."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.constants import MAX_BATCH
from flowlens.functions.exprs import finite
from flowlens.plans.recipes import hash01, number_rows, order_statistics, smallest_by_hash

SPLITS = ["train", "val", "test", "recal", "purged"]


def split_boundaries(
    df: DataFrame, group: Sequence[str], ts: str,
    fracs: tuple[float, float] = (0.70, 0.85), purge_s: float = 60.0, purge_frac: float = 0.02,
) -> DataFrame:
    """Per group: the two cut times and the purge margin, in epoch microseconds."""
    timed = df.select(*group, F.unix_micros(ts).alias("_us"))
    at = lambda f: (lambda n: F.least(F.floor(n * F.lit(f)), n - 1))
    stats = order_statistics(timed, group, "_us", {
        "t1": at(fracs[0]), "t2": at(fracs[1]), "t_min": lambda n: F.lit(0), "t_max": lambda n: n - 1,
    })
    span = F.col("t_max") - F.col("t_min")
    purge = F.floor(F.least(F.lit(purge_s * 1e6), F.lit(purge_frac) * span)).cast("bigint")
    return stats.select(*group, "t1", "t2", purge.alias("purge"))


def _three_way(us: Column) -> Column:
    t1, t2, p = F.col("t1"), F.col("t2"), F.col("purge")
    return (
        F.when(us < t1 - p, "train")
        .when((us >= t1 + p) & (us < t2 - p), "val")
        .when(us >= t2 + p, "test")
        .otherwise("purged")
    )


def time_block_split(
    df: DataFrame, group: Sequence[str], ts: str,
    fracs: tuple[float, float] = (0.70, 0.85), purge_s: float = 60.0, purge_frac: float = 0.02,
) -> DataFrame:
    """Add ``split``: earlier rows train, later rows test, a purged margin around each cut.

    Cuts are order statistics of time per group, so equal timestamps never part.
    """
    cuts = split_boundaries(df, group, ts, fracs, purge_s, purge_frac)
    joined = df.join(cuts, list(group))
    return joined.withColumn("split", _three_way(F.unix_micros(ts))).drop("t1", "t2", "purge")


def drift_split(
    df: DataFrame, early: Sequence[str], period: str, group: Sequence[str], ts: str, family: str,
    recal_frac: float = 0.2, purge_s: float = 60.0,
) -> DataFrame:
    """Early periods are split by :func:`time_block_split`; later ones into recalibration and test.

    In a later period the first ``recal_frac`` of the time span is kept for benign
    recalibration only, and everything after it (plus the margin) is test.
    """
    is_early = F.col(period).isin(list(early))
    first = time_block_split(df.where(is_early), [period, *group], ts, purge_s=purge_s)
    later = df.where(~is_early)
    us = F.unix_micros(ts)
    spans = later.groupBy(period).agg(F.min(us).alias("_lo"), F.max(us).alias("_hi"))
    cut = spans.select(period, (F.col("_lo") + F.floor(F.lit(recal_frac) * (F.col("_hi") - F.col("_lo")))).alias("_cut"))
    margin = F.lit(int(purge_s * 1_000_000))
    named = (
        F.when(us >= F.col("_cut") + margin, "test")
        .when((F.col(family) == "BENIGN") & (us < F.col("_cut") - margin), "recal")
        .otherwise("purged")
    )
    second = later.join(cut, period).withColumn("split", named).drop("_cut")
    return first.select(*df.columns, "split").unionByName(second.select(*df.columns, "split"))


def working_sample(
    df: DataFrame, ids: Sequence[str], tool: str = "tool", benign: str = "BENIGN",
    train_attack_cap: int = 20_000, train_benign: int = 400_000, eval_benign: int | None = None, seed: int = 7,
) -> DataFrame:
    """Exact-size sample per (split, tool): capped training strata, every evaluation row (benign ones capped on request)."""
    split, is_benign = F.col("split"), F.col(tool) == benign
    used = df.where(split.isin("train", "val", "test"))
    cap = (
        F.when((split == "train") & is_benign, F.lit(train_benign))
        .when(split == "train", F.lit(train_attack_cap))
        .otherwise(F.lit(eval_benign))
    )
    capped = (split == "train") | is_benign if eval_benign is not None else split == "train"
    whole = used.where(~capped)
    cut = smallest_by_hash(used.where(capped), ["split", tool], ids, cap, seed)
    return whole.unionByName(cut.select(*df.columns))


def bernoulli_stratified(
    df: DataFrame, stratum: str, caps: Mapping[str, int] | int, ids: Sequence[str], seed: int = 7,
) -> DataFrame:
    """Keep each row with probability ``min(1, cap / n)`` of its stratum; no sort, no exact size."""
    n = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n"))
    if isinstance(caps, int):
        cap: Column = F.lit(caps)
    else:
        pairs = [F.lit(x) for kv in caps.items() for x in kv]
        cap = F.try_element_at(F.create_map(*pairs), F.col(stratum))
    frac = n.select(stratum, F.least(F.lit(1.0), F.coalesce(cap / F.col("_n"), F.lit(1.0))).alias("_frac"))
    keep = hash01(*[F.col(c) for c in ids], seed=seed) < F.col("_frac")
    return df.join(frac, stratum).where(keep).drop("_frac")


def exclude_unit(df: DataFrame, col: str, value: str) -> DataFrame:
    """Training and validation rows without one family or tool; test rows all stay."""
    return df.where((F.col("split") == "test") | (F.col(col) != value))


def split_manifest(df: DataFrame, by: str, splits: Sequence[str] = SPLITS) -> DataFrame:
    """Counts per group and split with a totals row (``by`` = '(all)')."""
    counts = df.groupBy(by, "split").agg(F.count(F.lit(1)).alias("n"))
    return counts.rollup(by).agg(
        *[F.coalesce(F.sum(F.when(F.col("split") == s, F.col("n"))), F.lit(0)).alias(s) for s in splits],
        F.sum("n").alias("total"),
    ).withColumn(by, F.coalesce(F.col(by), F.lit("(all)")))


def sampling_weights(sample: DataFrame, full: DataFrame, by: Sequence[str]) -> DataFrame:
    """Add ``weight`` = rows in the full table / rows in the sample, per group.

    A sampled group the full table lacks is an error.
    """
    s = sample.groupBy(*by).agg(F.count(F.lit(1)).alias("_s"))
    f = full.groupBy(*by).agg(F.count(F.lit(1)).alias("_f"))
    both = s.join(f, list(by), "left")
    gone = both.where(F.col("_f").isNull())
    if some := gone.limit(5).collect():
        raise ValueError(f"{gone.count()} groups missing from the full table, such as {[tuple(r)[:len(by)] for r in some]}")
    w = both.select(*by, (F.col("_f") / F.col("_s")).alias("weight"))
    return sample.join(w, list(by))


def materialise_working_set(flows: DataFrame, index: DataFrame, keys: Sequence[str], path: str) -> DataFrame:
    """Write the sampled rows, one directory per split, and return the stored table.

    ``index`` holds keys, split and in_sample; keys are unique, so the join cannot
    multiply rows.
    """
    chosen = index.where(F.col("in_sample")).select(*keys, "split")
    flows.join(chosen, list(keys)).write.mode("overwrite").partitionBy("split").parquet(path)
    return flows.sparkSession.read.parquet(path)


def middle_slice(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """``n`` consecutive rows around the middle of the order (all rows when fewer); the leading column has no nulls."""
    first = F.unix_micros(order[0]) if dict(df.dtypes)[order[0]] == "timestamp" else F.col(order[0])
    begin = lambda k: F.greatest(F.floor((k - n) / 2), F.lit(0))
    found = order_statistics(df.select(first.alias("_v")), [], "_v", {"lo": begin, "hi": lambda k: F.least(begin(k) + n, k) - 1}).head()
    if found is None:
        return df.limit(0)
    # only rows between the two values of the leading column are put in order
    before = df.where(first < F.lit(found["lo"])).count()
    near = number_rows(df.where(first.between(F.lit(found["lo"]), F.lit(found["hi"]))), order, "_seq")
    start = max((found["n"] - n) // 2, 0) - before
    return near.where((F.col("_seq") >= start) & (F.col("_seq") < start + n)).drop("_seq")


def random_slice(df: DataFrame, ids: Sequence[str], n: int, order: Sequence[str], seed: int = 7) -> DataFrame:
    """Exactly ``min(n, rows)`` rows chosen by a seeded hash, in time order."""
    return smallest_by_hash(df, [], ids, n, seed).orderBy(*order)


def evenly_spaced(df: DataFrame, group: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    """Rows at positions ``rint(i (n-1)/(k-1))`` for i in 0..k-1 per group; every row when n <= k."""
    numbered = number_rows(df, order, "_pos", keys=group)
    sizes = numbered.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    with_n = numbered.join(sizes, list(group))
    step = (F.col("_n") - 1).cast("double") / F.lit(float(max(k - 1, 1)))
    nearest = F.rint(F.col("_pos") / F.when(step > 0, step))
    hit = F.when(F.col("_n") <= k, F.lit(True)).otherwise(
        F.exists(
            F.array(nearest - 1, nearest, nearest + 1),
            lambda i: (i >= 0) & (i <= k - 1) & (F.rint(i * step) == F.col("_pos")),
        ))
    return with_n.where(hit).drop("_pos", "_n")


def slice_manifest(df: DataFrame, features: Sequence[str], ts: str, label: str, available: int | None = None) -> DataFrame:
    """One row: size, replaced values, span, first time and counts per label."""
    per_label = df.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(ts).alias("lo"), F.max(ts).alias("hi"),
        sum((F.count_if(finite(F.col(c)).isNull()) for c in features), F.lit(0)).alias("bad"),
    )
    entries = F.array_sort(F.collect_list(F.struct(F.col(label), F.col("n"))))
    total = F.sum("n")
    return per_label.agg(
        total.alias("rows"),
        (F.lit(available).cast("bigint") if available is not None else total).alias("available"),
        F.sum("bad").alias("nonfinite_replaced"),
        F.round((F.unix_micros(F.max("hi")) - F.unix_micros(F.min("lo"))) / F.lit(1e6), 1).alias("span_s"),
        F.min("lo").alias("first_ts"),
        F.map_from_entries(entries).alias("labels"),
    )


def micro_batches(df: DataFrame, order: Sequence[str], size: int) -> DataFrame:
    """Add ``batch`` = position // size, with the size held in 1..500."""
    size = max(1, min(int(size), MAX_BATCH))
    numbered = number_rows(df, order, "_seq")
    return numbered.withColumn("batch", F.floor(F.col("_seq") / F.lit(size))).drop("_seq")

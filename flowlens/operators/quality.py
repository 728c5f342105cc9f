"""Deduplication, profiling and validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens import constants as K
from flowlens.functions.exprs import failed, ratio


def _comparable(df: DataFrame, keys: Sequence[str]) -> list:
    kinds = dict(df.dtypes)
    return [
        (F.col(k).cast("float") if kinds[k] in ("double", "float") else F.col(k)).alias(f"_k{i}")
        for i, k in enumerate(keys)
    ]


def dedupe_exact(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key combination over the whole table: the first in ``order``.

    Doubles are compared as 32-bit floats, the width they are stored in. A copy only
    needs its order columns to lose, so partial aggregation folds a hot group of
    copies before the shuffle.
    """
    row = F.struct(*[F.col(c) for c in df.columns])
    rank = F.struct(*[F.col(c) for c in order])
    grouped = df.groupBy(*_comparable(df, keys)).agg(F.min_by(row, rank).alias("_row"))
    return grouped.select("_row.*")


def copy_counts(df: DataFrame, keys: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """Copies per key combination, with columns that are equal inside a key."""
    return df.groupBy(*_comparable(df, [*keys, *carry])).agg(F.count(F.lit(1)).alias("copies")).select(
        *[F.col(f"_k{len(keys) + i}").alias(c) for i, c in enumerate(carry)], "copies")


def dedupe_report(df: DataFrame, keys: Sequence[str], family: str) -> DataFrame:
    """Per family: rows in, kept, removed and the removed share."""
    per_key = copy_counts(df, [k for k in keys if k != family], [family])
    return per_key.groupBy(family).agg(
        F.sum("copies").alias("rows_in"),
        F.count(F.lit(1)).alias("rows_kept"),
        (F.sum("copies") - F.count(F.lit(1))).alias("removed"),
    ).withColumn("dup_rate", ratio(F.col("removed"), F.col("rows_in")))


def column_quality(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per column with any finding: infinite, missing and negative counts."""
    counts = []
    for i, c in enumerate(cols):
        d = F.col(c).cast("double")
        inf = F.abs(d) == float("inf")
        counts += [
            F.count_if(inf).alias(f"inf{i}"),
            F.count_if(d.isNull() | F.isnan(d)).alias(f"nan{i}"),
            F.count_if((d < 0) & ~F.isnan(d)).alias(f"neg{i}"),
        ]
    one = df.agg(*counts)
    rows = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"inf{i}").alias("n_inf"),
                 F.col(f"nan{i}").alias("n_nan"), F.col(f"neg{i}").alias("n_neg"))
        for i, c in enumerate(cols)
    ]))
    return one.select(rows.alias("r")).select("r.*").where(F.expr("n_inf + n_nan + n_neg > 0"))


def rows_with_nonfinite(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    bad = F.lit(False)
    for c in cols:
        d = F.col(c).cast("double")
        bad = bad | d.isNull() | F.isnan(d) | (F.abs(d) == float("inf"))
    return df.agg(F.count_if(bad).alias("rows_with_nonfinite"))


def day_profile(raw: DataFrame, clean: DataFrame, day: str, ts: str) -> DataFrame:
    """Per day and in total (day null): raw and clean rows, duplicate rate, time span."""
    both = raw.select(day, F.lit(1).alias("r"), F.lit(0).alias("c"), F.lit(None).cast("timestamp").alias("t")).unionByName(
        clean.select(day, F.lit(0).alias("r"), F.lit(1).alias("c"), F.col(ts).alias("t")))
    return both.rollup(day).agg(
        F.sum("r").alias("raw"), F.sum("c").alias("clean"),
        F.min("t").alias("ts_min"), F.max("t").alias("ts_max"),
    ).withColumn("dup_rate", ratio(F.col("raw") - F.col("clean"), F.col("raw")))


def label_profile(df: DataFrame, group: str, label: str, ts: str, attempted: str | None = None) -> DataFrame:
    """Rows and time span per (group, label); attempted labels are marked."""
    shown = F.col(label)
    if attempted:
        shown = F.when(F.col(attempted), F.concat(F.col(label), F.lit(" [attempted]"))).otherwise(shown)
    return df.groupBy(group, shown.alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.min(ts).alias("ts_min"), F.max(ts).alias("ts_max"))


def label_matrix(df: DataFrame, group: str, label: str, labels: Sequence[str]) -> DataFrame:
    """Group x label counts with zeros and a row total."""
    wide = df.groupBy(group).pivot(label, list(labels)).count().na.fill(0)
    total = sum((F.col(f"`{x}`") for x in labels), F.lit(0))
    return wide.withColumn("total", total.cast("bigint"))


def class_share(df: DataFrame, period: str, label: str, positive: str, classes: Sequence[str]) -> DataFrame:
    """Counts per class, total and positive share per period."""
    return df.groupBy(period).agg(
        *[F.count_if(F.col(label) == c).alias(f"n_{c.lower()}") for c in classes],
        F.count(F.lit(1)).alias("total"),
        F.avg((F.col(label) == positive).cast("double")).alias("positive_share"),
    )


def validation_rules(batch_size: str | None = None) -> list:
    """(rule name, broken-condition) pairs for scored flow rows."""
    outside = lambda c, lo, hi: F.col(c).isNull() | (F.col(c) < lo) | (F.col(c) > hi)
    rules = [
        ("flow_id", F.col("flow_id").isNull() | (F.col("flow_id") == "")),
        ("src_ip", F.col("src_ip").isNull()),
        ("dst_ip", F.col("dst_ip").isNull()),
        ("src_port", outside("src_port", 0, 65535)),
        ("dst_port", outside("dst_port", 0, 65535)),
        ("protocol", outside("protocol", 0, 255)),
        ("p_attack", outside("p_attack", 0.0, 1.0)),
        ("anomaly_pct", outside("anomaly_pct", 0.0, 100.0)),
        ("verdict", ~F.col("verdict").isin(K.VERDICTS)),
        ("family", ~F.col("family").isin(K.FAMILIES)),
    ]
    if batch_size:
        rules.append(("batch_size", outside(batch_size, 1, K.MAX_BATCH)))
    return rules


def validate_flows(df: DataFrame, rules: list | None = None) -> tuple[DataFrame, DataFrame]:
    """Split rows into (valid, rejected); rejected rows list the rules they break."""
    checked = df.withColumn("reasons", failed(rules or validation_rules()))
    good = checked.where(F.size("reasons") == 0).drop("reasons")
    return good, checked.where(F.size("reasons") > 0)


def missing_features(df: DataFrame, features: str, names: Sequence[str]) -> DataFrame:
    """Names of the spec a record's feature map lacks, in spec order."""
    wanted = F.array(*[F.lit(n) for n in names])
    have = F.coalesce(F.map_keys(features), F.array().cast("array<string>"))
    return df.withColumn("missing", F.filter(wanted, lambda x: ~F.array_contains(have, x)))


def check_spec_consistency(
    spec: DataFrame, baseline: DataFrame, dropped: DataFrame | None = None, least_benign: int = K.LEAST_BENIGN,
) -> DataFrame:
    """One row per spec feature with the names of broken rules.

    spec: pos, name, clip_lo, clip_hi, log1p; baseline: pos, feature, n (benign rows behind it), p05, median, p95.
    """
    b = baseline.select(F.col("pos").alias("_bpos"), F.col("feature").alias("name"), F.col("n").alias("_n"), "p05", "median", "p95")
    joined = spec.join(b, "name", "left")
    rules = [
        ("not_in_baseline", F.col("_bpos").isNull()),
        ("order", F.col("_bpos") != F.col("pos")),
        ("clip", F.col("clip_lo") > F.col("clip_hi")),
        ("quantiles", (F.col("p05") > F.col("median")) | (F.col("median") > F.col("p95"))),
        ("log1p", F.col("log1p") & (F.col("clip_lo") < 0)),
        ("few_benign", F.col("_n") <= least_benign),
    ]
    if dropped is not None:
        d = dropped.select("name").distinct().withColumn("_gone", F.lit(True))
        joined = joined.join(d, "name", "left")
        rules.append(("kept_and_dropped", F.col("_gone")))
    return joined.select("name", failed(rules).alias("broken"))

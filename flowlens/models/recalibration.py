"""Recalibration per period: forest and thresholds from the period's own benign window, and the period rescored."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.models.isolation import grow_isolation_forests, score_isolation_forests
from flowlens.operators.evaluate import first_share_window, recalibrate_thresholds, score_by_period
from flowlens.session import written


def recalibrate(
    df: DataFrame, period: str, ts: str, features: Sequence[str], ids: Sequence[str], y: Column, benign: Column,
    unexplained: Column, p: str, budget: float, w: Column | None = None, frac: float = 0.2, anomaly_pct: float = 99.5,
    trees: int = 200, sample: int = 8192,
) -> DataFrame:
    """Per period: both thresholds, and the rates of :func:`score_by_period` over all its rows under them.

    The isolation forest is refitted on the benign rows of the period's first ``frac``. Periods without such rows keep
    null thresholds and rates, with their number of rows. The forests of all periods grow in one job and every row meets
    the trees of its own period, so the number of jobs does not depend on the number of periods.
    """
    weight = F.lit(1.0) if w is None else w
    rows = df.select(
        period, F.col(ts).alias("_ts"), F.col(p).alias("_p"), y.alias("_y"), benign.alias("_benign"), unexplained.alias("_u"),
        weight.cast("double").alias("_w"), *[F.col(c).alias(f"_id{i}") for i, c in enumerate(ids)],
        *[F.col(f).cast("double").alias(f"_f{i}") for i, f in enumerate(features)],
        F.coalesce(F.concat(F.lit("="), F.col(period).cast("string")), F.lit("null")).alias("fit"))
    names, keys = [f"_f{i}" for i in range(len(features))], [f"_id{i}" for i in range(len(ids))]
    window = first_share_window(rows, period, "_ts", frac).where("_benign")
    settings = window.select("fit").distinct().withColumns({
        "trees": F.lit(trees), "sample": F.lit(sample), "share": F.lit(1.0)})
    grown = grow_isolation_forests(window, settings, names, keys)
    scored = written(score_isolation_forests(rows, grown, names, keys, "_anomaly"), "rescored")
    cuts = recalibrate_thresholds(
        first_share_window(scored, period, "_ts", frac).where("_benign"), period, "_p", "_anomaly", budget, anomaly_pct)
    cuts = written(cuts.withColumnRenamed("n", "n_window"), "cuts")
    if cuts.isEmpty():
        raise ValueError("no benign rows to recalibrate on")
    rates = score_by_period(
        scored.join(cuts, period), period, F.col("_y"), F.col("_u"), F.col("_p") > F.col("tau_binary"),
        F.col("_anomaly") >= F.col("tau_anomaly"), F.col("_w"))
    done = rates.drop("n").join(cuts, period)
    return scored.groupBy(period).agg(F.count(F.lit(1)).alias("n")).join(done, period, "left")

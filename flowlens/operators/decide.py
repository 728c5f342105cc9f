"""Thresholds, verdicts and the choice of flows to explain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens import constants as K
from flowlens.functions import detection as D
from flowlens.functions.exprs import ratio
from flowlens.operators.incidents import correlation_key
from flowlens.plans.recipes import order_statistics, quantiles, running_totals


def fuse(
    df: DataFrame, tau_binary: float, tau_anomaly: float = K.ANOMALY_DISABLED, tau_family: float = 0.0,
    p: str = "p_attack", percentile: str = "anomaly_pct", family_conf: str | None = "fconf",
) -> DataFrame:
    """Add ``verdict``."""
    fc = F.col(family_conf) if family_conf else None
    return df.withColumn("verdict", D.verdict(F.col(p), F.col(percentile), tau_binary, tau_anomaly, fc, tau_family))


def detection_confidence(
    df: DataFrame, tau_binary: float, tau_anomaly: float = K.ANOMALY_DISABLED,
    p: str = "p_attack", percentile: str = "anomaly_pct",
) -> DataFrame:
    """Add ``confidence`` for the risk score."""
    return df.withColumn("confidence", D.confidence(F.col("verdict"), F.col(p), F.col(percentile), tau_binary, tau_anomaly))


def assign_family(df: DataFrame, closest: str = "closest_family") -> DataFrame:
    """Add ``attack_family`` from the verdict and the closest known family."""
    return df.withColumn("attack_family", D.reported_family(F.col("verdict"), F.col(closest)))


def anomaly_percentile(df: DataFrame, reference: DataFrame, score: str, ref_score: str, out: str = "percentile") -> DataFrame:
    """Add ``100 x (reference scores <= score) / reference size``.

    Both sides meet per distinct value: reference counts are accumulated over value
    buckets and joined back by equality, so neither side is collected or broadcast whole.
    """
    both = df.select(F.col(score).alias("_s"), F.lit(0).alias("_r")).unionByName(
        reference.select(F.col(ref_score).alias("_s"), F.lit(1).alias("_r")))
    totals = running_totals(both.where(F.col("_s").isNotNull()), "_s", {"r": F.sum("_r")})
    pct = totals.select(
        F.col("_s").alias(score),
        (F.lit(100.0) * (F.col("r_below") + F.col("r")) / F.col("r_total")).alias(out))
    return df.join(pct, score, "left")


def budget_scores(
    benign: DataFrame, p: str, budgets: Sequence[float], keys: Sequence[str] = (),
) -> DataFrame:
    """Per budget the benign score ``s`` such that flagging ``p > s`` stays within the budget.

    With n benign rows at most ``floor(budget n)`` may be flagged, so s is the next
    smaller order statistic. Output: keys, n, budget, score.
    """
    ranks = {f"_s{i}": (lambda n, b=b: n - 1 - F.floor(F.lit(float(b)) * n)) for i, b in enumerate(budgets)}
    found = order_statistics(benign, keys, p, ranks)
    rows = F.explode(F.array(*[
        F.struct(F.lit(float(b)).alias("budget"), F.col(f"_s{i}").alias("score")) for i, b in enumerate(budgets)]))
    return found.select(*keys, "n", rows.alias("_x")).select(*keys, "n", "_x.budget", "_x.score")


def threshold_for_fpr(benign: DataFrame, p: str, budget: float) -> float:
    """Score of one budget; flag rows with ``p > score``. No benign rows is an error."""
    got = budget_scores(benign, p, [budget]).head()
    if got is None:
        raise ValueError("no benign rows to calibrate on")
    return float(got["score"])


def with_budgets(df: DataFrame, taus: Sequence[dict]) -> DataFrame:
    """One copy of each row per budget with that budget's thresholds (a handful of literals)."""
    rows = F.array(*[
        F.struct(*[F.lit(v).cast("double").alias(k) for k, v in t.items()]) for t in taus])
    return df.select("*", F.explode(rows).alias("_t")).select(*df.columns, "_t.*")


def operating_points(
    val: DataFrame, budgets: Sequence[float], false_novel: float = K.FALSE_NOVEL,
    p: str = "p", fconf: str = "fconf", benign: Column | None = None, familiar: Column | None = None,
) -> list[dict]:
    """Per budget: binary threshold score (flag ``p > tau_binary``) and family threshold.

    The family threshold is the ``false_novel`` quantile of the family confidence over
    familiar attacks that are flagged; 0 without any.
    """
    benign = F.col("family") == "BENIGN" if benign is None else benign
    familiar = F.col("family") != "BENIGN" if familiar is None else familiar
    base = budget_scores(val.where(benign), p, budgets).collect()
    if not base:
        raise ValueError("no benign rows to calibrate on")
    taus = [{"budget": r["budget"], "tau_binary": r["score"]} for r in base]
    flagged = with_budgets(val.where(familiar).select(p, fconf), taus).where(F.col(p) > F.col("tau_binary"))
    cut = quantiles(flagged, [fconf], {"q": false_novel}, keys=["budget"]).collect()
    by_budget = {r["budget"]: float(r["q"]) for r in cut}
    for t in taus:
        t["tau_family"] = by_budget.get(t["budget"], 0.0)
    return taus


def decide_flags(p: Column, fconf: Column) -> tuple[Column, Column]:
    """(flagged, novel) against the threshold columns of :func:`operating_points`."""
    flagged = p > F.col("tau_binary")
    return flagged, flagged & F.coalesce(fconf < F.col("tau_family"), F.lit(False))


def operating_curve(
    val: DataFrame, evaluation: DataFrame, budgets: Sequence[float] = tuple(K.CURVE_BUDGETS),
    p: str = "p", fconf: str = "fconf", family: str = "family", weight: str = "w", families: Sequence[str] = (),
) -> DataFrame:
    """Per budget: thresholds, benign FPR, recall, weighted precision, novel share, recall per family."""
    taus = operating_points(val, budgets, p=p, fconf=fconf)
    rows = with_budgets(evaluation.select(p, fconf, family, weight), taus)
    flagged, novel = decide_flags(F.col(p), F.col(fconf))
    attack, w = F.col(family) != "BENIGN", F.col(weight)
    mass = lambda cond: F.sum(F.when(cond, w).otherwise(0.0))
    return rows.groupBy("budget", "tau_binary", "tau_family").agg(
        ratio(mass(flagged & ~attack), mass(~attack)).alias("benign_fpr"),
        ratio(mass(flagged & attack), mass(attack)).alias("recall"),
        ratio(mass(flagged & attack), mass(flagged)).alias("precision_natural"),
        ratio(F.count_if(novel), F.count_if(flagged)).alias("novel_flagged_share"),
        *[ratio(F.count_if(flagged & (F.col(family) == f)), F.count_if(F.col(family) == f)).alias(f"recall_{f.lower()}")
          for f in families],
    )


def class_weights(df: DataFrame, label: str, mode: str = "balanced", out: str = "class_weight") -> DataFrame:
    """``none`` -> 1, ``balanced`` -> rows / (classes x rows of the class)."""
    if mode == "none":
        return df.withColumn(out, F.lit(1.0))
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    size = counts.agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("k")).head()
    w = counts.select(label, (F.lit(float(size["n"] or 0)) / (F.lit(float(size["k"])) * F.col("_n"))).alias(out))
    return df.join(w, label)


def select_for_explanation(
    df: DataFrame, batch: str, cap: int = K.EXPLAIN_CAP, ceiling: int = K.EXPLAIN_CEILING, gap_s: int = K.SESSION_GAP_S,
    ts: str = "observed_at", p: str = "p_attack", row_id: str = "flow_id",
) -> DataFrame:
    """The attack rows worth explaining in every batch: the best row of each incident run, then the best of the rest.

    Batches are those the flows arrive in (at most ``MAX_BATCH`` rows), so ranking inside one is small and every run of
    every batch up to ``max(cap, ceiling)`` has its representative. Needs src_ip, dst_ip, verdict and attack_family.
    """
    if cap <= 0:
        return df.limit(0)
    attacks = correlation_key(df.where(F.col("verdict") != K.BENIGN_VERDICT))
    keys = [batch, "src_ip", "dst_ip", "corr_family"]
    in_run = Window.partitionBy(*keys).orderBy(ts, row_id)
    new = F.coalesce(F.unix_micros(ts) - F.lag(F.unix_micros(ts)).over(in_run) > gap_s * 1_000_000, F.lit(True)).cast("int")
    best = [F.desc(p), F.col(row_id)]
    runs = attacks.withColumn("_new", new).withColumn("_run", F.sum("_new").over(in_run))
    ranked = runs.withColumn("_rest", F.row_number().over(Window.partitionBy(*keys, "_run").orderBy(*best)) > 1)
    ranked = ranked.withColumn("_place", F.row_number().over(Window.partitionBy(batch).orderBy("_rest", *best)))
    most = F.when(F.col("_rest"), F.lit(cap)).otherwise(F.lit(max(cap, ceiling)))
    return ranked.where(F.col("_place") <= most).select(*df.columns)

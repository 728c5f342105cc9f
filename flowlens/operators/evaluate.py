"""Evaluation reports: binary, curves, families, hold-outs, periods, replay."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens import constants as K
from flowlens.functions.exprs import fixed, is_attack_truth, is_outlier_truth, ratio, wilson
from flowlens.operators.decide import with_budgets, budget_scores, decide_flags, operating_points
from flowlens.plans.recipes import quantiles, running_totals


def _mass(cond: Column, w: Column) -> Column:
    return F.sum(F.when(cond, w).otherwise(F.lit(0.0)))


def _share(cond: Column, among: Column) -> Column:
    """Share of ``cond`` among rows where ``among`` holds (null when there are none)."""
    return F.try_divide(F.count_if(cond & among).cast("double"), F.count_if(among).cast("double"))


def binary_report(
    df: DataFrame, y: Column, flagged: Column, w: Column | None = None, keys: Sequence[str] = (),
) -> DataFrame:
    """Weighted counts, precision, recall, FPR, F1 and Wilson intervals on raw counts."""
    w = F.lit(1.0) if w is None else w
    base = df.select(*keys, y.alias("_y"), flagged.alias("_f"), w.cast("double").alias("_w"))
    y, f, w = F.col("_y"), F.col("_f"), F.col("_w")
    got = base.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(y).alias("n_attack"), F.count_if(~y).alias("n_benign"),
        _mass(f & y, w).alias("_tp"), _mass(f & ~y, w).alias("_fp"),
        _mass(~f & y, w).alias("_fn"), _mass(~f & ~y, w).alias("_tn"),
        F.count_if(f & y).alias("_ktp"), F.count_if(f & ~y).alias("_kfp"),
    )
    out = got.withColumns({
        "precision": ratio(F.col("_tp"), F.col("_tp") + F.col("_fp")),
        "recall": ratio(F.col("_tp"), F.col("_tp") + F.col("_fn")),
        "fpr": ratio(F.col("_fp"), F.col("_fp") + F.col("_tn")),
    })
    r_lo, r_hi = wilson(F.col("_ktp"), F.col("n_attack"))
    f_lo, f_hi = wilson(F.col("_kfp"), F.col("n_benign"))
    return out.select(
        *keys, "n", "n_attack", "n_benign",
        *[F.rint(f"_{c}").cast("bigint").alias(c) for c in ("tp", "fp", "fn", "tn")],
        "precision", "recall", "fpr",
        ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"),
        r_lo.alias("recall_lo"), r_hi.alias("recall_hi"), f_lo.alias("fpr_lo"), f_hi.alias("fpr_hi"),
    )


def ranking_quality(df: DataFrame, y: Column, score: str, w: Column | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Exact weighted ROC-AUC (ties share) and average precision (step form), null without both classes."""
    w = F.lit(1.0) if w is None else w
    base = df.select(*keys, F.col(score).alias("_s"), y.alias("_y"), w.cast("double").alias("_w"))
    t = running_totals(base, "_s", {
        "pos": F.sum(F.when(F.col("_y"), F.col("_w")).otherwise(0.0)),
        "neg": F.sum(F.when(F.col("_y"), 0.0).otherwise(F.col("_w"))),
    }, keys)
    pos_over = F.col("pos_total") - F.col("pos_below")
    neg_over = F.col("neg_total") - F.col("neg_below")
    area = F.sum(F.col("neg") * (pos_over - F.col("pos") / 2))
    steps = F.sum(F.col("pos") * F.coalesce(F.try_divide(pos_over, pos_over + neg_over), F.lit(0.0)))
    got = t.groupBy(*keys).agg(
        area.alias("_a"), steps.alias("_s"), F.max("pos_total").alias("_p"), F.max("neg_total").alias("_n"))
    both = (F.col("_p") > 0) & (F.col("_n") > 0)
    return got.select(
        *keys,
        F.when(both, F.try_divide(F.col("_a"), F.col("_p") * F.col("_n"))).alias("roc_auc"),
        F.when(both, F.try_divide(F.col("_s"), F.col("_p"))).alias("pr_auc"),
    )


def confusion(df: DataFrame, true: str, pred: str, w: Column | None = None, dense: bool = False) -> DataFrame:
    """Weighted (rounded) and raw counts per (true, predicted); ``dense`` adds the zero cells."""
    w = F.lit(1.0) if w is None else w
    cells = df.groupBy(F.col(true).alias("true"), F.col(pred).alias("pred")).agg(
        F.sum(w.cast("double")).alias("weighted"), F.count(F.lit(1)).alias("raw"))
    if dense:
        labels = cells.select(F.explode(F.array("true", "pred")).alias("l")).agg(F.collect_set("l").alias("_l"))
        grid = labels.select(F.explode("_l").alias("true"), "_l").select("true", F.explode("_l").alias("pred"))
        cells = grid.join(cells, ["true", "pred"], "left").na.fill(0)
    return cells


def family_report(cells: DataFrame) -> DataFrame:
    """One-vs-rest precision, recall, F1, FPR, support and interval per family, plus macro F1.

    Works on confusion cells (labels squared), each cell counted once for its true
    and once for its predicted label.
    """
    as_true = cells.select(F.col("true").alias("family"), F.col("weighted").alias("t"), F.lit(0.0).alias("p"),
                           F.when(F.col("true") == F.col("pred"), F.col("weighted")).otherwise(0.0).alias("d"),
                           F.col("raw").alias("rt"),
                           F.when(F.col("true") == F.col("pred"), F.col("raw")).otherwise(0).alias("rd"))
    as_pred = cells.select(F.col("pred").alias("family"), F.lit(0.0).alias("t"), F.col("weighted").alias("p"),
                           F.lit(0.0).alias("d"), F.lit(0).cast("bigint").alias("rt"), F.lit(0).cast("bigint").alias("rd"))
    total = cells.agg(F.sum("weighted").alias("_total"))
    sums = as_true.unionByName(as_pred).groupBy("family").agg(
        F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum("d").alias("tp"), F.sum("rt").alias("rt"), F.sum("rd").alias("rd"))
    one = float(total.head()[0] or 0.0)
    fp, fn = F.col("p") - F.col("tp"), F.col("t") - F.col("tp")
    lo, hi = wilson(F.col("rd"), F.col("rt"))
    out = sums.withColumns({
        "precision": ratio(F.col("tp"), F.col("p")), "recall": ratio(F.col("tp"), F.col("t")),
        "fpr": ratio(fp, F.lit(one) - F.col("t")),
    })
    return out.select(
        "family", "precision", "recall",
        ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"),
        "fpr", F.rint(F.col("tp") + fn).cast("bigint").alias("support"), F.col("rt").alias("sample_support"),
        lo.alias("recall_lo"), hi.alias("recall_hi"))


def family_auc(df: DataFrame, family: str, score: str, w: Column | None = None) -> DataFrame:
    """Exact one-vs-rest ROC-AUC of a score per family (ties share).

    Scores are added up per value once over all rows and once per family; a family needs the values its own rows have
    and no others, so rows are never repeated per family.
    """
    w = F.lit(1.0) if w is None else w
    base = df.select(F.col(family).alias("family"), F.col(score).alias("_s"), w.cast("double").alias("_w"))
    everyone = running_totals(base, "_s", {"a": F.sum("_w")})
    own = running_totals(base, "_s", {"p": F.sum("_w")}, ["family"])
    area = F.sum(F.col("p") * (F.col("a_below") - F.col("p_below") + (F.col("a") - F.col("p")) / 2))
    got = own.join(everyone, "_s").groupBy("family").agg(
        area.alias("_a"), F.max("p_total").alias("_p"), F.max(F.col("a_total") - F.col("p_total")).alias("_n"))
    return got.select("family", F.when(F.col("_n") > 0, F.try_divide(F.col("_a"), F.col("_p") * F.col("_n"))).alias("roc_auc"))


def macro_f1(report: DataFrame) -> DataFrame:
    return report.where(F.col("support") > 0).agg(F.avg("f1").alias("macro_f1"))


def low_support(report: DataFrame, minimum: int = K.LOW_SUPPORT) -> DataFrame:
    """Caveat line for families with some but too few test flows."""
    return report.where((F.col("sample_support") > 0) & (F.col("sample_support") < minimum)).select(
        "family",
        F.concat(
            F.col("family"), F.lit(": only "), F.col("sample_support").cast("string"),
            F.lit(" test flows, so its metrics are unreliable (recall 95% CI "),
            fixed(F.col("recall_lo"), 2), F.lit("-"), fixed(F.col("recall_hi"), 2), F.lit(")")).alias("caveat"))


def recall_by_tool(df: DataFrame, tool: str, flagged: Column, attack: Column) -> DataFrame:
    """Per attack tool: rows, recall and its interval."""
    got = df.where(attack).groupBy(tool).agg(F.count(F.lit(1)).alias("n"), F.count_if(flagged).alias("hits"))
    lo, hi = wilson(F.col("hits"), F.col("n"))
    return got.select(tool, "n", "hits", ratio(F.col("hits"), F.col("n")).alias("recall"),
                      lo.alias("recall_lo"), hi.alias("recall_hi"))


def worst_tool(report: DataFrame, tool: str, minimum: int = K.LOW_SUPPORT) -> DataFrame:
    """The tool with the lowest recall among those with enough rows (ties by name)."""
    return report.where(F.col("n") >= minimum).agg(
        F.min(F.struct(F.col("recall"), F.col(tool).alias("tool"))).alias("w")).select("w.tool", "w.recall")


def holdout_report(
    val: DataFrame, evaluation: DataFrame, held: Column, budgets: Sequence[float] = tuple(K.HOLDOUT_BUDGETS),
    false_novel: float = K.FALSE_NOVEL, p: str = "p", fconf: str = "fconf", p_full: str = "p_full",
    family: str = "family", weight: str = "w",
) -> DataFrame:
    """How a model that never saw one unit treats that unit, per false-alarm budget.

    ``p`` and ``fconf`` come from the model without the unit, ``p_full`` from the one
    trained on everything.
    """
    taus = operating_points(val, budgets, false_novel, p, fconf, familiar=(F.col(family) != "BENIGN") & ~held)
    full = {r["budget"]: r["score"] for r in
            budget_scores(val.where(F.col(family) == "BENIGN"), p_full, budgets).collect()}
    for t in taus:
        t["tau_full"] = full[t["budget"]]
    rows = with_budgets(evaluation.select(p, fconf, p_full, family, F.col(weight).alias("_w"), held.alias("_held")), taus)
    return _holdout_rates(rows, [], p, fconf, p_full, family)


def _holdout_rates(rows: DataFrame, keys: Sequence[str], p: str, fconf: str, p_full: str, family: str) -> DataFrame:
    """Rates per key and budget from rows that carry ``_w``, ``_held`` and the thresholds of their budget."""
    flagged, novel = decide_flags(F.col(p), F.col(fconf))
    rows = rows.select(*keys, "budget", "tau_binary", "tau_family", "_w", "_held", flagged.alias("_f"), novel.alias("_n"),
                       (F.col(p_full) > F.col("tau_full")).alias("_ff"), (F.col(family) == "BENIGN").alias("_b"))
    h, f, n, b = F.col("_held"), F.col("_f"), F.col("_n"), F.col("_b")
    familiar = ~b & ~h
    lo, hi = wilson(F.col("_k"), F.col("n_held_out"))
    return rows.groupBy(*keys, "budget", "tau_binary", "tau_family").agg(
        F.count_if(h).alias("n_held_out"), F.count_if(h & f).alias("_k"),
        F.coalesce(_share(f, h), F.lit(0.0)).alias("recall"),
        F.coalesce(_share(F.col("_ff"), h), F.lit(0.0)).alias("recall_seen_ceiling"),
        F.coalesce(_share(n, h & f), F.lit(0.0)).alias("novel_share_of_detected"),
        _share(f, b).alias("benign_fpr"), _share(n, b).alias("benign_flagged_novel"),
        _share(f, familiar).alias("familiar_attack_recall"),
        F.coalesce(_share(n, familiar & f), F.lit(0.0)).alias("familiar_false_novel"),
        F.try_divide(_mass(n & h, F.col("_w")), _mass(n, F.col("_w"))).alias("novel_bucket_precision"),
    ).withColumns({"recall_lo": lo, "recall_hi": hi}).drop("_k")


def holdout_reports(
    val: DataFrame, evaluation: DataFrame, keys: Sequence[str], held: str, budgets: Sequence[float] = tuple(K.HOLDOUT_BUDGETS),
    false_novel: float = K.FALSE_NOVEL, p: str = "p", fconf: str = "fconf", p_full: str = "p_full",
    family: str = "family", weight: str = "w",
) -> DataFrame:
    """:func:`holdout_report` of many runs (``keys``) in one plan; ``held`` is the flag of the left-out rows of a run."""
    keys, benign = list(keys), F.col(family) == "BENIGN"
    calm, at = val.where(benign), [*keys, "budget"]
    base = budget_scores(calm, p, budgets, keys).select(*at, F.col("score").alias("tau_binary"))
    full = budget_scores(calm, p_full, budgets, keys).select(*at, F.col("score").alias("tau_full"))
    familiar = val.where(~benign & ~F.col(held)).select(*keys, p, fconf).join(base, keys).where(F.col(p) > F.col("tau_binary"))
    cut = quantiles(familiar, [fconf], {"tau_family": false_novel}, keys=at).select(*at, "tau_family")
    taus = base.join(full, at).join(cut, at, "left").fillna(0.0, ["tau_family"])
    rows = evaluation.select(*keys, p, fconf, p_full, family, F.col(weight).alias("_w"), F.col(held).alias("_held")).join(taus, keys)
    return _holdout_rates(rows, keys, p, fconf, p_full, family)


def aggregate_seeds(runs: DataFrame, unit: str, budget: str, metrics: Sequence[str], recall: str = "recall") -> DataFrame:
    """Mean of every metric over seeds, and the smallest, largest and every recall.

    A unit has one row per seed, so the recall list is as long as the number of seeds.
    """
    by_seed = F.array_sort(F.collect_list(F.struct(F.col("seed"), F.round(recall, 4).alias("r"))))
    return runs.groupBy(unit, budget).agg(
        F.count(F.lit(1)).alias("seeds"), *[F.avg(m).alias(m) for m in metrics],
        F.min(recall).alias("recall_min"), F.max(recall).alias("recall_max"),
        F.transform(by_seed, lambda x: x["r"]).alias("recall_by_seed"))


def score_by_period(
    df: DataFrame, period: str, y: Column, unexplained: Column, flag_binary: Column, flag_anomaly: Column,
    w: Column | None = None,
) -> DataFrame:
    """Per period: rates over explained rows, and how many unexplained rows each detector flags."""
    w = F.lit(1.0) if w is None else w
    base = df.select(period, y.alias("_y"), unexplained.alias("_u"), flag_binary.alias("_f"),
                     flag_anomaly.alias("_a"), w.cast("double").alias("_w"))
    y, u, f, a, w = (F.col(c) for c in ("_y", "_u", "_f", "_a", "_w"))
    known = ~u
    return base.groupBy(period).agg(
        F.count(F.lit(1)).alias("n"),
        ratio(_mass(known & y & f, w), _mass(known & y, w)).alias("recall"),
        ratio(_mass(known & ~y & f, w), _mass(known & ~y, w)).alias("benign_fpr"),
        ratio(_mass(known & y & f, w), _mass(known & f, w)).alias("precision_natural"),
        F.avg(y.cast("double")).alias("positive_share"),
        _share(f, u).alias("unexplained_flagged_binary"), _share(a, u).alias("unexplained_flagged_anomaly"),
        _share(a, known & ~y).alias("benign_flagged_anomaly"),
    )


def recalibrate_thresholds(
    window: DataFrame, period: str, p: str, score: str, budget: float, anomaly_pct: float = 99.5,
) -> DataFrame:
    """Per period: binary threshold score (flag ``p > tau``) and anomaly threshold from benign rows."""
    binary = budget_scores(window, p, [budget], [period]).select(period, "n", F.col("score").alias("tau_binary"))
    strange = quantiles(window, [score], {"tau_anomaly": anomaly_pct / 100.0}, keys=[period]).select(period, "tau_anomaly")
    return binary.join(strange, period)


def first_share_window(df: DataFrame, period: str, ts: str, frac: float = 0.2) -> DataFrame:
    """Rows in the first ``frac`` of each period's time span."""
    us = F.unix_micros(ts)
    spans = df.groupBy(period).agg(F.min(us).alias("_lo"), F.max(us).alias("_hi"))
    cut = spans.select(period, (F.col("_lo") + F.floor(F.lit(frac) * (F.col("_hi") - F.col("_lo")))).alias("_cut"))
    return df.join(cut, period).where(us < F.col("_cut")).drop("_cut")


def parity_check(a: DataFrame, b: DataFrame, key: str, p: str, threshold: float) -> DataFrame:
    """Share of rows two scoring paths agree on."""
    left = a.select(key, (F.col(p) >= threshold).alias("_a"))
    right = b.select(key, (F.col(p) >= threshold).alias("_b"))
    return left.join(right, key).agg(
        F.count(F.lit(1)).alias("rows"), F.avg((F.col("_a") == F.col("_b")).cast("double")).alias("agreement"))


def _outcomes(truth: str, verdict: str) -> dict[str, Column]:
    hit = F.col(verdict) != K.BENIGN_VERDICT
    out, bad = is_outlier_truth(F.col(truth)), is_attack_truth(F.col(truth))
    return {
        "tp": bad & hit, "fp": ~bad & ~out & hit, "tn": ~bad & ~out & ~hit, "fn": bad & ~hit,
        "outliers": out, "outliers_flagged": out & hit,
    }


def _precision_recall_f1(df: DataFrame) -> DataFrame:
    p = F.coalesce(F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fp")).cast("double")), F.lit(1.0))
    r = F.coalesce(F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fn")).cast("double")), F.lit(1.0))
    out = df.withColumns({"precision": p, "recall": r})
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def replay_report(df: DataFrame, truth: str = "ground_truth", verdict: str = "verdict") -> DataFrame:
    """Outcome of a replay: verdict counts and a confusion that leaves unexplained rows out."""
    agg = df.agg(
        F.count(F.lit(1)).alias("flows"),
        *[F.count_if(F.col(verdict) == v).alias(f"n_{v}") for v in K.VERDICTS],
        *[F.count_if(c).alias(n) for n, c in _outcomes(truth, verdict).items()],
    )
    return _precision_recall_f1(agg)


def truth_counts(df: DataFrame, truth: str = "ground_truth") -> DataFrame:
    """Rows per ground-truth label, with UNKNOWN for none."""
    shown = F.coalesce(F.nullif(F.col(truth), F.lit("")), F.lit("UNKNOWN"))
    return df.groupBy(shown.alias("ground_truth")).agg(F.count(F.lit(1)).alias("n"))


def progressive_metrics(df: DataFrame, batch: str, truth: str = "ground_truth", verdict: str = "verdict") -> DataFrame:
    """Running outcome counts, precision and recall after every batch."""
    parts = {n: F.count_if(c) for n, c in _outcomes(truth, verdict).items() if n in ("tp", "fp", "tn", "fn")}
    t = running_totals(df, batch, parts)
    upto = t.select(batch, *[(F.col(f"{n}_below") + F.col(n)).alias(n) for n in parts])
    return _precision_recall_f1(upto).drop("f1")



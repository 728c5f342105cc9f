"""Population stability: reference, index, reports and rolling checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens import constants as K
from flowlens.functions.detection import drift_status
from flowlens.functions.exprs import finite
from flowlens.operators.features import transform
from flowlens.plans.recipes import number_rows, quantiles, running_totals

REFERENCE_SCHEMA = "feature string, edges array<double>, expected array<double>, n bigint"


def _binned(df: DataFrame, edges: dict[str, list[float]], keys: Sequence[str]) -> DataFrame:
    """keys, feature, bin = number of edges at or below the value; non-finite values are left out."""
    names = list(edges)
    vals = df.select(*keys, *[finite(F.col(c)).alias(f"_v{i}") for i, c in enumerate(names)])
    binned = Bucketizer(
        splitsArray=[[float("-inf"), *edges[c], float("inf")] for c in names],
        inputCols=[f"_v{i}" for i in range(len(names))], outputCols=[f"_b{i}" for i in range(len(names))],
        handleInvalid="keep").transform(vals)
    cells = F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"_b{i}").cast("int").alias("bin")) for i, c in enumerate(names)]))
    return binned.select(*keys, cells.alias("_x")).select(*keys, "_x.feature", "_x.bin").where(F.col("bin").isNotNull())


def build_reference(df: DataFrame, cols: Sequence[str], bins: int = 10) -> DataFrame:
    """Per feature: distinct inner quantile edges, expected share per bin, finite rows.

    A feature without finite values is an error. The result has one row per feature.
    """
    probs = {f"q{i}": i / bins for i in range(1, bins)}
    cut = {r["feature"]: sorted({float(r[q]) for q in probs}) for r in quantiles(df, cols, probs).collect()}
    empty = [c for c in cols if c not in cut]
    if empty:
        raise ValueError(f"no finite values in the reference data: {empty}")
    counts = _binned(df, {c: cut[c] for c in cols}, []).groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("n")).collect()
    rows = []
    for c in cols:
        per = [0] * (len(cut[c]) + 1)
        for r in counts:
            if r["feature"] == c:
                per[r["bin"]] = r["n"]
        rows.append((c, cut[c], [x / sum(per) for x in per], sum(per)))
    return df.sparkSession.createDataFrame(rows, REFERENCE_SCHEMA)


def _edges(ref: DataFrame) -> tuple[dict[str, list[float]], int]:
    rows = ref.collect()
    return {r["feature"]: list(r["edges"]) for r in rows}, max(len(r["expected"]) for r in rows)


def _psi_of(counts: Column, expected: Column, n: Column) -> Column:
    """Sum over the reference's bins, empty ones included, with both shares floored."""
    floor = F.lit(K.PSI_FLOOR)
    used = F.slice(counts, F.lit(1), F.size(expected))
    terms = F.zip_with(used, expected, lambda c, e: (
        (F.greatest(c / n, floor) - F.greatest(e, floor)) * F.ln(F.greatest(c / n, floor) / F.greatest(e, floor))))
    return F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)


def psi(df: DataFrame, ref: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Index per key and feature: ``keys, feature, n, psi``. One aggregation, no sort."""
    edges, width = _edges(ref)
    cells = _binned(df, edges, keys).groupBy(*keys, "feature", "bin").agg(F.count(F.lit(1)).alias("_c"))
    return _index(cells, ref, keys, width)


def _index(cells: DataFrame, ref: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """``cells``: keys, feature, bin, count ``_c``."""
    counted = cells.groupBy(*keys, "feature").agg(
        F.sum("_c").alias("n"),
        F.array(*[F.coalesce(F.sum(F.when(F.col("bin") == b, F.col("_c"))), F.lit(0)) for b in range(width)]).alias("_counts"))
    return counted.join(ref.select("feature", "expected"), "feature").select(
        *keys, "feature", "n", _psi_of(F.col("_counts"), F.col("expected"), F.col("n")).alias("psi"))


def with_status(df: DataFrame) -> DataFrame:
    return df.withColumn("status", drift_status(F.col("psi")))


def drift_report(
    df: DataFrame, ref: DataFrame, verdict: str = "verdict", expected_rate: float = 0.001,
    minimum: int = K.DRIFT_MIN_WINDOW,
) -> DataFrame:
    """Per feature: index over benign-verdict rows, its status, the worst one and the attack rate.

    Empty when fewer than ``minimum`` rows have a benign verdict.
    """
    quiet = F.col(verdict) == K.BENIGN_VERDICT
    rates = df.agg(F.count_if(quiet).alias("benign"), F.avg((~quiet).cast("double")).alias("rate")).head()
    features = with_status(psi(df.where(quiet), ref))
    top = features.agg(F.max("psi").alias("m")).head()["m"] or 0.0
    return features.where(F.lit(rates["benign"] >= minimum)).select(
        "feature", "psi", "status", F.lit(float(top)).alias("max_psi"),
        drift_status(F.lit(float(top))).alias("overall_status"),
        F.lit(int(rates["benign"])).cast("bigint").alias("window_size"),
        F.lit(rates["rate"]).cast("double").alias("attack_rate"), F.lit(expected_rate).alias("reference_rate"),
    ).orderBy(F.desc("psi"), "feature")


def _is_benign(verdict: str) -> Column:
    return F.coalesce(F.col(verdict) == K.BENIGN_VERDICT, F.lit(False))


def row_positions(df: DataFrame, order: Sequence[str], verdict: str, every: int = K.DRIFT_EVERY, after: tuple[int, int] = (0, 0)) -> DataFrame:
    """Adds ``_seq`` (rows before) and ``_pos`` (benign rows before), both from what ``after`` says of earlier rows."""
    quiet = _is_benign(verdict)
    rows = number_rows(df, order, "_seq").withColumn("_part", F.floor(F.col("_seq") / every))
    below = running_totals(rows, "_part", {"ben": F.count_if(quiet)}).select("_part", "ben_below")
    inside = Window.partitionBy("_part").orderBy("_seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(below, "_part").withColumn(
        "_pos", F.col("ben_below") + F.coalesce(F.sum(quiet.cast("bigint")).over(inside), F.lit(0)) + F.lit(after[1]))
    return rows.withColumn("_seq", F.col("_seq") + F.lit(after[0])).drop("_part", "ben_below")


def window_checks(
    rows: DataFrame, ref: DataFrame, verdict: str = "verdict", window: int = K.DRIFT_WINDOW, every: int = K.DRIFT_EVERY,
    minimum: int = K.DRIFT_MIN_WINDOW, after: int = 0,
) -> DataFrame:
    """The checks past row ``after`` of rows with ``_seq`` and ``_pos``: see :func:`rolling_drift`.

    Of rows before ``after`` only those in the last ``window`` rows or benign rows are needed. A benign row is counted
    once: where a window of some check begins or ends, the run of benign rows is cut, bins are counted per piece, and
    the checks add up pieces. So rows are never copied per check, however the windows overlap.
    """
    if window % every:
        raise ValueError("window must be a multiple of every")
    edges, width = _edges(ref)
    quiet = _is_benign(verdict)
    rows = rows.withColumn("_block", F.floor(F.col("_seq") / every))
    blocks = rows.groupBy("_block").agg(
        F.count(F.lit(1)).alias("all"), F.count_if(quiet).alias("ben"),
        F.max(F.col("_pos") + quiet.cast("bigint")).alias("_end"), F.min(F.when(quiet, F.col("_pos"))).alias("_first"))
    checks = (
        blocks.select(F.explode(F.sequence("_block", F.col("_block") + (window // every - 1))).alias("_check"), "all", "ben")
        .groupBy("_check").agg(F.sum("all").alias("_n"), F.sum("ben").alias("_b"))
        .join(blocks.where((F.col("all") == every) & ((F.col("_block") + 1) * every > after)).select(
            F.col("_block").alias("_check"), "_end"), "_check")
        .where(F.col("_end") >= minimum)
        .select(((F.col("_check") + 1) * every).alias("checkpoint"), "_end",
                (F.lit(1.0) - F.col("_b") / F.col("_n")).alias("attack_rate"))
    )
    ends = checks.select("_end").distinct().withColumn("_from", F.greatest(F.col("_end") - window, F.lit(0)))

    def parts(first: Column, last: Column) -> Column:
        return F.explode(F.sequence(F.floor(first / window), F.floor(last / window))).alias("_part")

    held = blocks.where("ben > 0").select("_block", "_first", "_end", parts(F.col("_first"), F.col("_end") - 1))
    starts = ends.select("_from", F.floor(F.col("_from") / window).alias("_part")).distinct()
    cuts = held.join(starts, "_part").where((F.col("_from") >= F.col("_first")) & (F.col("_from") < F.col("_end")))
    cuts = cuts.groupBy("_block").agg(F.collect_set("_from").alias("_cuts"))
    marks = blocks.select("_block", "_first").join(cuts, "_block", "left")
    piece = F.greatest(F.col("_first"), F.array_max(F.filter("_cuts", lambda c: c <= F.col("_pos"))))
    pieces = rows.where(quiet).join(marks, "_block").withColumn("_piece", piece)
    cells = _binned(pieces, edges, ["_piece"]).groupBy("_piece", "feature", "bin").agg(F.count(F.lit(1)).alias("_c"))
    cells = cells.withColumn("_part", F.floor(F.col("_piece") / window))
    covered = cells.join(ends.select("_end", "_from", parts(F.col("_from"), F.col("_end") - 1)), "_part").where(
        (F.col("_piece") >= F.col("_from")) & (F.col("_piece") < F.col("_end")))
    covered = covered.groupBy("_end", "feature", "bin").agg(F.sum("_c").alias("_c"))
    return checks.join(_index(covered, ref, ["_end"], width), "_end").select(
        "checkpoint", F.least(F.col("_end"), F.lit(window)).alias("window_size"), "attack_rate", "feature", "psi")


def rolling_drift(
    df: DataFrame, ref: DataFrame, order: Sequence[str], verdict: str = "verdict",
    window: int = K.DRIFT_WINDOW, every: int = K.DRIFT_EVERY, minimum: int = K.DRIFT_MIN_WINDOW,
) -> DataFrame:
    """After every ``every`` rows: attack rate of the last ``window`` rows and index of the last
    ``window`` benign rows. ``window`` must be a multiple of ``every``.

    Output: ``checkpoint, window_size, attack_rate, feature, psi``; checks with fewer than
    ``minimum`` benign rows are left out.
    """
    edges, _ = _edges(ref)
    wanted = list(dict.fromkeys([*order, verdict, *edges]))
    return window_checks(row_positions(df.select(*wanted), order, verdict, every), ref, verdict, window, every, minimum)


def monthly_drift(df: DataFrame, ref: DataFrame, period: str) -> DataFrame:
    """Per period: largest index, the feature it belongs to (ties by name) and the status."""
    per = psi(df, ref, [period])
    worst = F.min(F.struct((-F.col("psi")).alias("neg"), F.col("feature")))
    return per.groupBy(period).agg(worst.alias("_w")).select(
        period, (-F.col("_w.neg")).alias("max_psi"), F.col("_w.feature").alias("worst_feature"),
        drift_status(-F.col("_w.neg")).alias("status"))


def rate_shift(report: DataFrame) -> DataFrame:
    """Observed minus expected attack rate."""
    return report.withColumn("rate_shift", F.col("attack_rate") - F.col("reference_rate"))


# wording per band (fixed values)
GUIDANCE_ALERT = "Alert — Significant distribution shift. Retrain / recalibrate."
GUIDANCE_WATCH = "Watch — Moderate distribution shift. Monitor closely."
GUIDANCE_OK = "Stable — Feature distribution matches baseline."


def drift_guidance(report: DataFrame) -> DataFrame:
    return report.withColumn(
        "guidance",
        F.when(F.col("psi") >= K.PSI_ALERT, GUIDANCE_ALERT).when(F.col("psi") >= K.PSI_WATCH, GUIDANCE_WATCH)
        .otherwise(GUIDANCE_OK))


def refresh_reference(benign_train: DataFrame, params: DataFrame) -> DataFrame:
    """Reference from all transformed benign training rows."""
    ready = transform(benign_train, params)
    return build_reference(ready, ready.columns)


def windowed_index(df: DataFrame, ref: DataFrame, ts: str, window: str, slide: str) -> DataFrame:
    """Index per event-time window and feature: ``start, feature, n, psi``; for tables and streams.

    The reference's shares are literals here, so a stream needs no join.
    """
    edges, width = _edges(ref)
    shares = {r["feature"]: list(r["expected"]) for r in ref.collect()}
    expected = F.map_from_arrays(
        F.array(*[F.lit(f) for f in shares]),
        F.array(*[F.array(*[F.lit(float(x)) for x in e]) for e in shares.values()]))
    counted = _binned(df, edges, [ts]).groupBy(F.window(ts, window, slide).alias("w"), "feature").agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.count_if(F.col("bin") == b) for b in range(width)]).alias("_counts"))
    return counted.select(
        F.col("w.start").alias("start"), "feature", "n",
        _psi_of(F.col("_counts"), F.element_at(expected, F.col("feature")), F.col("n")).alias("psi"))

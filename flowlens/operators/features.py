"""Feature statistics, feature specs, the transformer and baselines."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens import constants as K
from flowlens.functions.exprs import finite, fixed
from flowlens.plans.recipes import quantiles, quantiles_of_totals, running_totals
from flowlens.session import written

CLIP = {"lo": 0.0001, "hi": 0.9999}
SPEC_COLUMNS = "pos int, name string, clip_lo double, clip_hi double, log1p boolean, train_median double"


def _melt(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    cells = F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), finite(F.col(c)).alias("value")) for c in cols]))
    return df.select(*keys, cells.alias("_x")).select(*keys, "_x.*")


def column_stats(df: DataFrame, cols: Sequence[str], exact: bool = True, totals: DataFrame | None = None) -> DataFrame:
    """One row per column: missing rate, distinct values, range, quantiles, skew, top-value share.

    ``totals``: running totals ``c`` of the rows per ``feature`` and ``value``, where they are known already.
    """
    wide = []
    for i, c in enumerate(cols):
        v = finite(F.col(c))
        wide += [
            F.avg(v.isNull().cast("double")).alias(f"nan{i}"), F.min(v).alias(f"min{i}"),
            F.max(v).alias(f"max{i}"), F.skewness(v).alias(f"sk{i}"),
        ]
    one = df.agg(*wide)
    moments = one.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"nan{i}").alias("nan_rate"), F.col(f"min{i}").alias("min"),
                 F.col(f"max{i}").alias("max"), F.col(f"sk{i}").alias("_sk"))
        for i, c in enumerate(cols)])).alias("_m")).select("_m.*")
    per_value = totals if totals is not None else _melt(df, cols).where(F.col("value").isNotNull()).groupBy("feature", "value").agg(
        F.count(F.lit(1)).alias("c"))
    spread = per_value.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_unique"), (F.max("c") / F.sum("c")).alias("top_share"))
    probs = {"median": 0.5, "q_lo": 0.0001, "q_hi": 0.9999}
    q = quantiles(df, cols, probs, exact=exact) if totals is None else quantiles_of_totals(totals, "value", "c", ["feature"], probs)
    n = F.col("n").cast("double")
    unbias = F.when(n > 2, F.sqrt(n * (n - 1)) / (n - 2))
    return (
        moments.join(spread, "feature", "left").join(q, "feature", "left")
        .withColumn("skew", F.col("_sk") * unbias)
        .select("feature", "n", "nan_rate", F.coalesce("n_unique", F.lit(0)).alias("n_unique"), "min", "max",
                "median", "q_lo", "q_hi", "skew", "top_share")
    )


def group_clip_bounds(
    df: DataFrame, cols: Sequence[str], group: str, lo: float = CLIP["lo"], hi: float = CLIP["hi"], exact: bool = True,
) -> DataFrame:
    """Widest quantile range over the groups, so rare classes keep their tails."""
    groups = df.select(group).distinct().count() if exact else None
    return _widest(quantiles(df, cols, {"lo": lo, "hi": hi}, keys=[group], exact=exact, groups=groups))


def _widest(per: DataFrame) -> DataFrame:
    return per.groupBy("feature").agg(F.min("lo").alias("clip_lo"), F.max("hi").alias("clip_hi"))


# distinct values of all features together whose ranks are broadcast
RANKS_BROADCAST = 400_000


def _mean_ranks(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Average rank of every distinct value per feature (its place in ``cols``), shifted so a feature's ranks have mean 0."""
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("feature"), F.col(c).alias("value")) for i, c in enumerate(cols)]))
    return _ranks_of_totals(running_totals(df.select(cells.alias("_x")).select("_x.*"), "value", {"c": F.count(F.lit(1))}, ["feature"]))


def _ranks_of_totals(totals: DataFrame) -> DataFrame:
    return totals.select("feature", "value", (F.col("c_below") + F.col("c") / 2 - F.col("c_total") / 2).alias("rank"))


def _rank_vectors(rows: DataFrame, cols: Sequence[str], ranks: DataFrame) -> tuple[DataFrame, list[int]]:
    """One row per row of ``rows``: ``_v``, its ranks in some order of the features, and that order.

    Features with few distinct values look their ranks up in broadcast tables, as counted. Of the others the one with the most is
    left out and stays a value, ``_f``, last in the order (see :func:`_folded_sums`). Only the cells of the rest are dealt by
    (feature, value) and gathered per row; what is known already travels with the first of them.
    """
    distinct = {r["feature"]: r["n"] for r in ranks.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).collect()}
    by_size, small, total = sorted(distinct, key=lambda i: (distinct[i], i)), [], 0
    for i in by_size:
        total += distinct[i]
        if total > RANKS_BROADCAST:
            break
        small.append(i)
    large = [i for i in range(len(cols)) if i not in small]
    folded = [by_size[-1]] if large else []
    large = [i for i in large if i not in folded]
    names = [f"_c{i}" for i in range(len(cols))]
    now = rows.toDF(*names)
    for i in small:
        found = ranks.where(F.col("feature") == i).select(F.col("value").alias(names[i]), F.col("rank").alias(f"_r{i}"))
        now = now.join(F.broadcast(found), names[i])
    known = F.array(*[F.col(f"_r{i}") for i in small]) if small else F.array().cast("array<double>")
    known = F.struct(known.alias("_v"), *[F.col(names[i]).alias("_f") for i in folded])
    if not large:
        return now.select(known.alias("_x")).select("_x.*"), [*small, *folded]
    now = now.select(F.monotonically_increasing_id().alias("_row"), known.alias("_known"), *[names[i] for i in large])
    cells = F.explode(F.array(*[
        F.struct(F.lit(i).alias("feature"), F.col(names[i]).alias("value"), (F.col("_known") if i == large[0] else F.lit(None)).alias("_known"))
        for i in large]))
    met = now.select("_row", cells.alias("_x")).select("_row", "_x.*").join(ranks.where(F.col("feature").isin(large)), ["feature", "value"])
    got = met.groupBy("_row").agg(
        F.max("_known").alias("_known"), *[F.max(F.when(F.col("feature") == i, F.col("rank"))).alias(f"_r{i}") for i in large])
    vectors = got.select(F.concat("_known._v", F.array(*[F.col(f"_r{i}") for i in large])).alias("_v"), F.col("_known._f").alias("_f"))
    return written(vectors, "rank_vectors"), [*small, *large, *folded]


def _folded_sums(vectors: DataFrame, width: int, ranks: DataFrame) -> np.ndarray:
    """Sums of products of the feature left out of ``_v`` with every place of it and with itself.

    Rows are added up per value first, so that a value meets its rank once and no row is joined.
    """
    per = vectors.groupBy(F.col("_f").alias("value")).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(F.col("_v")[i]).alias(f"_s{i}") for i in range(width)])
    got = per.join(ranks.select("value", "rank"), "value").agg(
        *[F.sum(F.col("rank") * F.col(f"_s{i}")) for i in range(width)], F.sum(F.col("rank") * F.col("rank") * F.col("_n"))).head()
    return np.array([x or 0.0 for x in got])


def _product_sums(vectors: DataFrame, width: int) -> np.ndarray:
    """The sums of products of every two places, added up inside tasks first."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            total = total + x.T @ x
        yield pa.RecordBatch.from_pydict({"sums": [total.ravel().tolist()]}, pa.schema([("sums", pa.list_(pa.float64()))]))

    parts = vectors.mapInArrow(add, "sums array<double>")
    got = parts.select(F.posexplode("sums").alias("at", "s")).groupBy("at").agg(F.sum("s").alias("s")).collect()
    sums = np.zeros(width * width)
    for r in got:
        sums[r["at"]] = r["s"]
    return sums.reshape(width, width)


def spearman_matrix(
    df: DataFrame, cols: Sequence[str], fill: Mapping[str, float] | None = None, ranks: DataFrame | None = None,
) -> DataFrame:
    """Absolute Spearman correlation of every ordered pair (average ranks on ties).

    Rows are imputed first (``fill``, else 0) because the correlation works on full rows. Ranks are computed once per
    distinct value (unless given, see :func:`_mean_ranks`) and have mean 0, so it is enough to add up products per pair of features.
    """
    cols = list(cols)
    rows = df.select(*[F.coalesce(finite(F.col(c)), F.lit(float((fill or {}).get(c, 0.0)))).alias(c) for c in cols])
    if len(df.take(2)) < 2:
        raise ValueError("a correlation needs two rows or more")
    ranks = written(_mean_ranks(rows, cols) if ranks is None else ranks, "ranks")
    vectors, order = _rank_vectors(rows, cols, ranks)
    folded = "_f" in vectors.columns
    width = len(order) - folded
    sums = _product_sums(vectors.select("_v"), width) if width else np.zeros((0, 0))
    if folded:
        more = _folded_sums(vectors, width, ranks.where(F.col("feature") == order[-1]))
        sums = np.block([[sums, more[:-1, None]], [more[None, :-1], more[-1:, None]]])
    place = {c: k for k, c in enumerate(order)}

    def rho(i: int, j: int) -> float:
        a, b = place[i], place[j]
        spread = math.sqrt(sums[a, a]) * math.sqrt(sums[b, b])
        return 1.0 if i == j else min(float(abs(sums[a, b])) / spread, 1.0) if spread else math.nan

    out = [(i, j, a, b, rho(i, j)) for i, a in enumerate(cols) for j, b in enumerate(cols)]
    return df.sparkSession.createDataFrame(out, "i int, j int, feature_a string, feature_b string, rho double")


def prune_correlated(rho: DataFrame, order: Sequence[str], thr: float = 0.95) -> DataFrame:
    """Walk the features in preference order; drop one that follows a kept feature too closely.

    The matrix has (number of features)^2 cells, so the walk runs on the driver.
    """
    cell = {(r["feature_a"], r["feature_b"]): r["rho"] for r in rho.collect()}
    kept: list[str] = []
    rows = []
    for name in order:
        partner = next((k for k in kept if cell[(name, k)] > thr), None)
        if partner is None:
            kept.append(name)
            rows.append((name, True, None, None))
        else:
            rows.append((name, False, partner, cell[(name, partner)]))
    return rho.sparkSession.createDataFrame(rows, "name string, kept boolean, partner string, rho double")


def corr_pairs(rho: DataFrame, minimum: float = 0.8) -> DataFrame:
    """Pairs above the minimum, each once, strongest first."""
    return rho.where((F.col("i") < F.col("j")) & (F.col("rho") > minimum)).select(
        "feature_a", "feature_b", "rho").orderBy(F.desc("rho"), "feature_a", "feature_b")


@dataclass
class FeatureSpec:
    """Kept features (spec table) and dropped features with the reason."""

    features: DataFrame
    dropped: DataFrame


def build_feature_spec(
    df: DataFrame, cols: Sequence[str], group: str, preference: Sequence[str] | None = None,
    thr: float = 0.95, skew_limit: float = 5.0,
) -> FeatureSpec:
    """Constants out, correlated copies out, then clip bounds, log flag and the unclipped median.

    Rows are counted per group, feature and value once and stored; quantiles and ranks come from these counts.
    """
    spark = df.sparkSession
    cells = _melt(df.select(F.col(group).alias("_group"), *cols), cols, ["_group"])
    counted = written(cells.groupBy("_group", "feature", "value").agg(F.count(F.lit(1)).alias("c")), "counts")
    finite_ones = counted.where(F.col("value").isNotNull())
    totals = written(running_totals(finite_ones, "value", {"c": F.sum("c")}, ["feature"]), "value_totals")
    stats = {r["feature"]: r for r in column_stats(df, cols, totals=totals).collect()}
    constant = [c for c in cols if stats[c]["n_unique"] <= 1]
    live = [c for c in (preference or cols) if c in cols and c not in constant]
    if any(stats[c]["nan_rate"] for c in live):
        fills = F.create_map(*[x for c in live for x in (F.lit(c), F.lit(float(stats[c]["median"])))])
        full = counted.where(F.col("feature").isin(live)).withColumn("value", F.coalesce("value", fills[F.col("feature")]))
        totals = running_totals(full, "value", {"c": F.sum("c")}, ["feature"])
    place = F.array_position(F.array(*[F.lit(c) for c in live]), F.col("feature")).cast("int") - 1
    ranks = _ranks_of_totals(totals).where(F.col("feature").isin(live)).withColumn("feature", place) if live else None
    rho = spearman_matrix(df, live, {c: stats[c]["median"] for c in live}, ranks)
    walked = prune_correlated(rho, live, thr).collect()
    kept = {r["name"] for r in walked if r["kept"]}
    inside = finite_ones.where(F.col("_group").isNotNull() & F.col("feature").isin(list(kept)))
    per = quantiles_of_totals(running_totals(inside, "value", {"c": F.sum("c")}, ["_group", "feature"]), "value", "c", ["_group", "feature"], CLIP)
    bounds = {r["feature"]: r for r in _widest(per).collect()}
    rows, pos = [], 0
    for c in cols:
        if c not in kept:
            continue
        lo, hi = float(bounds[c]["clip_lo"]), float(bounds[c]["clip_hi"])
        skew = stats[c]["skew"]
        rows.append((pos, c, lo, hi, bool(lo >= 0 and skew is not None and skew > skew_limit),
                     float(stats[c]["median"])))
        pos += 1
    gone = [(c, "constant", None, None) for c in constant] + [
        (r["name"], "correlated", r["partner"], r["rho"]) for r in walked if not r["kept"]]
    return FeatureSpec(
        spark.createDataFrame(rows, SPEC_COLUMNS),
        spark.createDataFrame(gone, "name string, reason string, kept_partner string, rho double"),
    )


@dataclass
class TransformParams:
    """Compiled transformer: one entry per feature in spec order."""

    rows: list

    @property
    def names(self) -> list[str]:
        return [r["name"] for r in self.rows]


def _clipped(name: str, lo: float, hi: float) -> Column:
    v = finite(F.col(name))
    return F.when(v.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), v)))


def _finished(r) -> Column:
    x = F.coalesce(_clipped(r["name"], r["clip_lo"], r["clip_hi"]), F.lit(r["median"]))
    return F.log1p(x) if r["log1p"] else x


def fit_transformer(df: DataFrame, spec: DataFrame) -> DataFrame:
    """Spec rows plus the median of clipped values and mean and deviation of the finished ones."""
    rows = [r.asDict() for r in spec.orderBy("pos").collect()]
    clipped = df.select(*[_clipped(r["name"], r["clip_lo"], r["clip_hi"]).alias(r["name"]) for r in rows])
    med = {r["feature"]: r["median"] for r in
           quantiles(clipped, [r["name"] for r in rows], {"median": 0.5}).collect()}
    for r in rows:
        r["median"] = float(med.get(r["name"], 0.0))
    sums = [x for i, r in enumerate(rows) for x in (
        F.avg(_finished(r)).alias(f"m{i}"), F.stddev_pop(_finished(r)).alias(f"s{i}"))]
    got = df.agg(*sums).head()
    out = [
        (r["pos"], r["name"], r["clip_lo"], r["clip_hi"], r["log1p"], r["median"],
         got[f"m{i}"], got[f"s{i}"] if got[f"s{i}"] else 1.0)
        for i, r in enumerate(rows)
    ]
    return df.sparkSession.createDataFrame(
        out, "pos int, name string, clip_lo double, clip_hi double, log1p boolean, median double, mean double, std double")


def transform(df: DataFrame, params: DataFrame | TransformParams, keep: Sequence[str] = (), scaled: bool = False) -> DataFrame:
    """One projection: non-finite out, clip, impute, log, optionally standardise, 32-bit float last."""
    return df.select(*keep, *[c.alias(n) for n, c in transform_columns(params, scaled).items()])


def transform_columns(params: DataFrame | TransformParams, scaled: bool = False) -> dict[str, Column]:
    """The transformer as one expression per feature, in spec order."""
    if isinstance(params, DataFrame):
        params = TransformParams([r.asDict() for r in params.orderBy("pos").collect()])
    out = {}
    for r in params.rows:
        x = _finished(r)
        if scaled:
            x = (x - F.lit(r["mean"])) / F.lit(r["std"])
        out[r["name"]] = x.cast("float")
    return out


def variant_spec(spec: DataFrame, drop: Sequence[str] = (), optional: Sequence[str] = ()) -> DataFrame:
    """The spec without some features, with optional ones appended; unknown options are an error."""
    unknown = sorted(set(optional) - set(K.OPTIONAL_FEATURES))
    if unknown:
        raise ValueError(f"not optional features: {unknown}")
    rows = [r for r in spec.orderBy("pos").collect() if r["name"] not in set(drop)]
    out = [(i, r["name"], r["clip_lo"], r["clip_hi"], r["log1p"], r["train_median"]) for i, r in enumerate(rows)]
    for name in optional:
        lo, hi, log = K.OPTIONAL_FEATURES[name]
        out.append((len(out), name, lo, hi, log, None))
    return spec.sparkSession.createDataFrame(out, SPEC_COLUMNS)


def baseline_stats(benign: DataFrame, cols: Sequence[str], exact: bool = True) -> DataFrame:
    """Per feature over finite raw values: median, p05, p95, mean, deviation, share of zeros."""
    q = quantiles(benign, cols, {"median": 0.5, "p05": 0.05, "p95": 0.95}, exact=exact)
    wide = [x for i, c in enumerate(cols) for x in (
        F.avg(finite(F.col(c))).alias(f"m{i}"), F.stddev_pop(finite(F.col(c))).alias(f"s{i}"),
        F.avg((finite(F.col(c)) == 0).cast("double")).alias(f"z{i}"))]
    moments = benign.agg(*wide).select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("pos"), F.lit(c).alias("feature"), F.col(f"m{i}").alias("mean"),
                 F.col(f"s{i}").alias("std"), F.col(f"z{i}").alias("zero_share"))
        for i, c in enumerate(cols)])).alias("_m")).select("_m.*")
    return moments.join(q, "feature").select(
        "pos", "feature", "n", "median", "p05", "p95", "mean", "std", "zero_share")


def _thousands(x: Column, decimals: int) -> Column:
    return F.format_number(x, decimals)


def significant(x: Column, digits: int, commas: bool) -> Column:
    """``digits`` significant digits, trailing zeros dropped, exponent form far from 1."""
    keep = digits - 1
    unit = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(x))) - keep)
    power = F.floor(F.log10(F.abs(F.rint(x / unit) * unit)) + F.lit(1e-12)).cast("int")
    plain = F.call_function("format_number", x, F.greatest(F.lit(keep) - power, F.lit(0)))
    if not commas:
        plain = F.replace(plain, F.lit(","), F.lit(""))
    plain = F.when(plain.contains("."), F.regexp_replace(plain, "\\.?0+$", "")).otherwise(plain)
    science = F.regexp_replace(F.format_string(f"%.{keep}e", x), "\\.?0+e", "e")
    return F.when(x == 0, "0").when((power < -4) | (power >= digits), science).otherwise(plain)


def describe_vs_normal(df: DataFrame, baseline: DataFrame, feature: str = "feature", value: str = "value") -> DataFrame:
    """Add ``ratio`` to the benign median (null near 0) and a short text comparing the two."""
    b = baseline.select(F.col("feature").alias(feature), "median", "p95")
    v, label = F.col(value), F.replace(F.col(feature), F.lit("_"), F.lit(" "))
    r = F.col("ratio")
    times = lambda x: F.concat(
        F.when(x >= 10, _thousands(F.rint(x), 0)).otherwise(_thousands(x, 1)), F.lit("x"))
    text = (
        F.when(r.isNull() & (v > F.col("p95")), F.concat(
            label, F.lit(" is "), significant(v, 4, True), F.lit(", above the benign 95th percentile ("),
            significant(F.col("p95"), 4, True), F.lit(")")))
        .when(r.isNull(), F.concat(label, F.lit(" is "), significant(v, 4, True), F.lit(" (benign traffic is usually 0)")))
        .when(r >= 2, F.concat(label, F.lit(" is "), times(r), F.lit(" the benign median")))
        .when((r > 0) & (r <= 0.5), F.concat(label, F.lit(" is "), times(1 / r), F.lit(" below the benign median")))
        .otherwise(F.concat(label, F.lit(" is close to the benign median")))
    )
    joined = df.join(b, feature, "left")
    with_ratio = joined.withColumn("ratio", F.when(F.abs("median") >= 1e-9, v / F.col("median")))
    return with_ratio.withColumn("text", text)


def format_shift(value: Column, median: Column) -> Column:
    """Detail-page wording of a value against its baseline."""
    r = F.try_divide(value, median)
    percent = F.try_divide(value - median, median) * 100.0
    return (
        F.when(median.isNull(), "No baseline")
        .when((median == 0) & (value == 0), "Matches normal (0.0)")
        .when(median == 0, F.concat(F.lit("+"), significant(value, 6, False), F.lit(" above baseline (0.0)")))
        .when(value == median, "Matches normal")
        .when(r >= 2, F.concat(_thousands(r, 1), F.lit("× higher than normal")))
        .when((r > 0) & (r <= 0.5), F.concat(_thousands(F.try_divide(median, value), 1), F.lit("× lower than normal")))
        .otherwise(F.concat(F.when(percent > 0, "+").otherwise(""), fixed(percent, 1), F.lit("% vs normal")))
    )

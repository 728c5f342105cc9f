"""A trained detector: transformer, forests, thresholds, baseline and drift reference, stored as tables."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens import constants as K
from flowlens.functions import detection as D
from flowlens.models.cell_forest import BORDER_COLUMNS, TREE_COLUMNS, CellForest
from flowlens.models.forest import FamilyForest, ForestParams, fit_binary_forest, fit_family_forest, score
from flowlens.models.isolation import (
    TREE_SCHEMA, IsolationForest, fit_isolation_forest, score_borders, score_isolation, score_percentile)
from flowlens.operators.decide import operating_points
from flowlens.operators.drift import REFERENCE_SCHEMA, refresh_reference
from flowlens.operators.features import baseline_stats, fit_transformer, transform_columns
from flowlens.sources.stores import file_manifest, read_spec, verify_manifest, write_spec

PARAMS_SCHEMA = "pos int, name string, clip_lo double, clip_hi double, log1p boolean, median double, mean double, std double"
BASELINE_SCHEMA = "pos int, feature string, n bigint, median double, p05 double, p95 double, mean double, std double, zero_share double"
RULES_SCHEMA = (
    "tau_binary double, tau_family double, tau_anomaly double, operating_fpr double, classes array<string>, "
    "anomaly_features array<string>, anomaly_sample double, anomaly_borders array<double>")
MANIFEST_SCHEMA = "name string, size bigint, sha256 string"


@dataclass
class Bundle:
    params: DataFrame
    baseline: DataFrame
    reference: DataFrame
    rules: DataFrame
    binary: CellForest
    family: FamilyForest | None
    anomaly: IsolationForest | None = None


def _prepared(df: DataFrame, params: DataFrame) -> tuple[DataFrame, list[str]]:
    """Adds the transformed features as ``x_<name>`` and keeps the raw values."""
    made = {f"x_{n}": c for n, c in transform_columns(params).items()}
    return df.withColumns(made), list(made)


def fit_bundle(
    train: DataFrame, val: DataFrame, spec: DataFrame, ids: Sequence[str], budget: float = 0.001, family: str = "family",
    binary_params: ForestParams | None = None, family_params: ForestParams | None = None, seed: int = 7,
    with_family: bool = True, tau_anomaly: float | None = None, trees: int = 200, sample: int = 8192,
) -> Bundle:
    """Fit on the training rows, set the thresholds on the validation rows.

    With ``tau_anomaly`` an isolation forest of the benign training rows comes along; a flow's anomaly percentile is its
    score's place among the benign validation scores, and from ``tau_anomaly`` on an unflagged flow is novel.
    """
    attack = F.col(family) != "BENIGN"
    params = fit_transformer(train, spec)
    x, names = _prepared(train, params)
    binary = fit_binary_forest(x, names, attack, binary_params, seed)
    heads = fit_family_forest(x.where(attack), names, family, family_params, seed) if with_family else None
    checked = _prepared(val, params)[0]
    seen = score(checked, names, binary, heads)
    seen = (seen if heads else seen.withColumn("fconf", F.lit(None).cast("double"))).select(
        "p_attack", "fconf", F.col(family).alias("family")).persist()
    cut = operating_points(seen, [budget], p="p_attack")[0]
    seen.unpersist()
    strange, borders = None, None
    if tau_anomaly is not None:
        strange = fit_isolation_forest(x.where(~attack), names, ids, trees, sample, seed)
        borders = score_borders(score_isolation(checked.where(~attack), strange))
    rules = train.sparkSession.createDataFrame([(
        math.nextafter(cut["tau_binary"], math.inf), cut["tau_family"] if heads else 0.0,
        K.ANOMALY_DISABLED if tau_anomaly is None else float(tau_anomaly), budget, heads.classes if heads else None,
        strange.features if strange else None, strange.sample if strange else None, borders)], RULES_SCHEMA)
    benign, raw = train.where(~attack), [n[2:] for n in names]
    return Bundle(params, baseline_stats(benign, raw), refresh_reference(benign, params), rules, binary, heads, strange)


def detect(df: DataFrame, bundle: Bundle) -> DataFrame:
    """Raw flows (table or stream) -> p_attack, anomaly_pct, verdict, confidence, family, severity; other columns stay."""
    rules = bundle.rules.head()
    ready, names = _prepared(df, bundle.params)
    if bundle.anomaly:
        ready = score_percentile(score_isolation(ready, bundle.anomaly), rules["anomaly_borders"]).drop("anomaly_score")
    else:
        ready = ready.withColumn("anomaly_pct", F.lit(0.0))
    out = score(ready, names, bundle.binary, bundle.family).drop(*names)
    fconf = F.col("fconf") if bundle.family else None
    pct, tau = F.col("anomaly_pct"), rules["tau_anomaly"]
    out = out.withColumn("verdict", D.verdict(F.col("p_attack"), pct, rules["tau_binary"], tau, fconf, rules["tau_family"]))
    closest = F.col("closest_family") if bundle.family else F.lit(None).cast("string")
    probs = F.col("family_probs") if bundle.family else F.lit(None).cast("map<string,double>")
    out = out.withColumns({
        "confidence": D.confidence(F.col("verdict"), F.col("p_attack"), pct, rules["tau_binary"], tau),
        "attack_family": D.reported_family(F.col("verdict"), closest)})
    return out.withColumn("severity", D.expected_severity(F.col("attack_family"), probs))


def save_bundle(bundle: Bundle, path: str) -> None:
    """Store every part below ``path`` and a manifest of the files beside it."""
    for name, forest in (("binary", bundle.binary), ("family", bundle.family and bundle.family.model)):
        if forest:
            trees, borders = forest.tables(bundle.params.sparkSession)
            trees.write.mode("overwrite").parquet(f"{path}/{name}/trees")
            write_spec(borders, f"{path}/{name}/borders")
    if bundle.anomaly:
        trees = [tuple(t[c] for c in ("tree", "feature", "threshold", "left", "right", "size")) for t in bundle.anomaly.trees]
        write_spec(bundle.params.sparkSession.createDataFrame(trees, TREE_SCHEMA), f"{path}/anomaly")
    for name, part in (("params", bundle.params), ("baseline", bundle.baseline), ("reference", bundle.reference), ("rules", bundle.rules)):
        write_spec(part, f"{path}/{name}")
    write_spec(file_manifest(bundle.params.sparkSession, path), f"{path}.manifest")


def _load_forest(spark: SparkSession, path: str, classes: int) -> CellForest:
    trees = spark.read.schema(TREE_COLUMNS).parquet(f"{path}/trees")
    return CellForest.of_tables(trees, read_spec(spark, f"{path}/borders", BORDER_COLUMNS), classes)


def load_bundle(spark: SparkSession, path: str) -> Bundle:
    """Read a stored bundle; a missing, unlisted or changed file is an error."""
    problems = verify_manifest(read_spec(spark, f"{path}.manifest", MANIFEST_SCHEMA), file_manifest(spark, path)).collect()
    if problems:
        raise ValueError(f"bundle does not match its manifest: {[(r['name'], r['problem']) for r in problems]}")
    rules = read_spec(spark, f"{path}/rules", RULES_SCHEMA)
    held = rules.head()
    classes, strange = held["classes"], None
    if held["anomaly_features"]:
        trees = read_spec(spark, f"{path}/anomaly", TREE_SCHEMA).collect()
        strange = IsolationForest(sorted(trees, key=lambda r: r["tree"]), list(held["anomaly_features"]), held["anomaly_sample"])
    family = FamilyForest(_load_forest(spark, f"{path}/family", len(classes)), list(classes)) if classes else None
    return Bundle(
        read_spec(spark, f"{path}/params", PARAMS_SCHEMA), read_spec(spark, f"{path}/baseline", BASELINE_SCHEMA),
        read_spec(spark, f"{path}/reference", REFERENCE_SCHEMA), rules,
        _load_forest(spark, f"{path}/binary", 2), family, strange)

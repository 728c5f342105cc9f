"""Attack forest and family forest on cells (see cell_forest), on MLlib where rows are weighted, and scoring with both."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.models.cell_forest import CellForest, fit_cells


@dataclass
class ForestParams:
    """Defaults of the attack forest."""

    trees: int = 100
    depth: int = 16
    min_rows: int = 100
    features: str = "0.2"
    bins: int = 64


FAMILY_PARAMS = ForestParams(depth=30, min_rows=2, features="sqrt")


@dataclass
class FamilyForest:
    model: CellForest
    classes: list[str]


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="error").transform(df)


def _weighted(p: ForestParams, seed: int, weight: str) -> RandomForestClassifier:
    return RandomForestClassifier(
        featuresCol="_x", labelCol="_y", numTrees=p.trees, maxDepth=p.depth, minInstancesPerNode=p.min_rows,
        featureSubsetStrategy=p.features, maxBins=p.bins, seed=seed, cacheNodeIds=False, weightCol=weight)


def _cells(df: DataFrame, features: Sequence[str], label: Column, classes: int, p: ForestParams, seed: int) -> CellForest:
    return fit_cells(df, features, label, classes, p.trees, p.depth, p.min_rows, p.features, p.bins, seed)


def fit_binary_forest(
    df: DataFrame, features: Sequence[str], attack: Column, params: ForestParams | None = None,
    seed: int = 7, weight: str | None = None,
) -> CellForest | RandomForestClassificationModel:
    """Attack (1) against benign (0). With ``weight`` rows count by it, and MLlib grows the trees level by level."""
    p = params or ForestParams()
    if weight is None:
        return _cells(df, features, attack, 2, p, seed)
    ready = assemble(df.withColumn("_y", attack.cast("double")), features)
    return _weighted(p, seed, weight).fit(ready.select("_x", "_y", weight))


def fit_family_forest(
    attacks: DataFrame, features: Sequence[str], family: str = "family", params: ForestParams | None = None, seed: int = 7,
) -> FamilyForest:
    """Family of an attack, trained on all attack rows and on them only; classes in alphabetical order."""
    index = StringIndexer(inputCol=family, outputCol="_y", stringOrderType="alphabetAsc").fit(attacks)
    model = _cells(index.transform(attacks), features, F.col("_y"), len(index.labels), params or FAMILY_PARAMS, seed)
    return FamilyForest(model, list(index.labels))


def _probabilities(df: DataFrame, features: Sequence[str], model: CellForest | RandomForestClassificationModel, out: str) -> DataFrame:
    if isinstance(model, CellForest):
        return df.withColumn(out, model.probabilities(df, features))
    quiet = model.copy().setPredictionCol("").setRawPredictionCol("").setProbabilityCol("_p")
    return quiet.transform(assemble(df, features)).withColumn(out, vector_to_array("_p")).drop("_p", "_x")


def score(
    df: DataFrame, features: Sequence[str], binary: CellForest | RandomForestClassificationModel, family: FamilyForest | None = None,
) -> DataFrame:
    """Add p_attack and, with a family forest, family_probs, fconf and closest_family.

    p_attack is 0 when the model never saw an attack. The first class in alphabetical
    order wins ties.
    """
    out = _probabilities(df, features, binary, "_b")
    out = out.withColumn("p_attack", F.coalesce(F.get("_b", 1), F.lit(0.0))).drop("_b")
    if family is not None:
        names = F.array(*[F.lit(c) for c in family.classes])
        out = _probabilities(out, features, family.model, "_f")
        probs = F.col("_f")
        best = F.array_max(probs)
        out = out.withColumns({
            "family_probs": F.map_from_arrays(names, probs), "fconf": best,
            "closest_family": F.element_at(names, F.array_position(probs, best).cast("int")),
        }).drop("_f")
    return out

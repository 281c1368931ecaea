"""Four classifiers on the assembled features, the linear one fitted by MLlib and those of trees from histograms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctual.plans.delay_models.boosted_stumps import StumpEnsemble, boost
from punctual.plans.delay_models.features import class_weights
from punctual.plans.delay_models.histogram_trees import TreeEnsemble, grow_boosted, grow_forest
from punctual.settings import Settings

# fixed values: model names
LOGISTIC, FOREST, BOOSTED, STUMPS = "Logistic Regression", "Random Forest", "Boosted Trees", "AdaBoost"


def logistic(train: DataFrame, s: Settings):
    weighted = class_weights(train)
    # unit inverse penalty per row, on features that are already scaled
    rows = weighted.count()
    return LogisticRegression(
        maxIter=s.logistic_iterations, regParam=1.0 / max(rows, 1), elasticNetParam=0.0,
        standardization=False, weightCol="weight",
    ).fit(weighted)


def forest(train: DataFrame, s: Settings) -> TreeEnsemble:
    return grow_forest(train, s.forest_trees, s.forest_depth, s.forest_leaf_rows, s.tree_bins, s.sample_seed)


def boosted(train: DataFrame, s: Settings) -> TreeEnsemble:
    return grow_boosted(train, s.boost_rounds, s.boost_depth, s.boost_step, s.boost_subsample, s.tree_bins, s.sample_seed)


def stumps(train: DataFrame, s: Settings) -> StumpEnsemble:
    return boost(train, s.stump_rounds, s.stump_step, s.split_bins)


FITTERS: dict[str, Callable] = {LOGISTIC: logistic, STUMPS: stumps, FOREST: forest, BOOSTED: boosted}


def scored(model, vectors: DataFrame, name: str) -> DataFrame:
    """Probability of a delay and the class at one half."""
    out = model.transform(vectors)
    if "score" not in out.columns:
        out = out.withColumn("score", vector_to_array("probability")[1])
    return out.select(
        F.lit(name).alias("model"), "fl_date", F.col("label").cast("int").alias("label"),
        "score", F.col("prediction").cast("int").alias("prediction"),
    )


def importances(model) -> list[float]:
    if isinstance(model, StumpEnsemble | TreeEnsemble):
        return model.importance
    return [abs(float(v)) for v in model.coefficients.toArray()]

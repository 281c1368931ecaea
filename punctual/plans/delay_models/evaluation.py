"""Classification measures as aggregates over scored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from punctual.functions.ratios import safe_ratio

#: halvings of a search among the quantiles of the scores, one bin more than there are quantiles
HALVINGS = 10


def confusion(scored: DataFrame, *keys: str) -> DataFrame:
    label, predicted = F.col("label"), F.col("prediction")
    return scored.groupBy(*keys).agg(
        F.count_if((label == 0) & (predicted == 0)).alias("tn"),
        F.count_if((label == 0) & (predicted == 1)).alias("fp"),
        F.count_if((label == 1) & (predicted == 0)).alias("fn"),
        F.count_if((label == 1) & (predicted == 1)).alias("tp"),
        F.count(F.lit(1)).alias("total"),
    )


def rates(table: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 of a confusion table; 0 where undefined."""
    return table.withColumns(
        {
            "accuracy": safe_ratio(F.col("tp") + F.col("tn"), "total"),
            "precision": safe_ratio("tp", F.col("tp") + F.col("fp")),
            "recall": safe_ratio("tp", F.col("tp") + F.col("fn")),
            "f1": safe_ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")),
        }
    )


def score_bins(each: DataFrame, *keys: str) -> DataFrame:
    """Distinct scores with a bin between quantiles of a key's own scores, so that bins are alike in size wherever scores lie.

    The quantiles are those of a mergeable sketch: one row per key, which the scores are searched in by halving.
    """
    count = 2**HALVINGS
    quantiles = F.percentile_approx("score", [i / count for i in range(1, count)]).alias("_edges")
    edges = each.groupBy(*keys).agg(quantiles)
    joined = each.join(edges, list(keys)) if keys else each.join(F.broadcast(edges))  # one row
    steps = F.array(*[F.lit(2**i) for i in reversed(range(HALVINGS))])
    reach = lambda at, step: F.when(F.get("_edges", at + step - 1) <= F.col("score"), at + step).otherwise(at)
    return joined.withColumn("bin", F.aggregate(steps, F.lit(0), reach)).drop("_edges")


def roc_auc(scored: DataFrame, *keys: str) -> DataFrame:
    """Exact area with tied scores counted half.

    Rows collapse to one per distinct score. Negatives below a score are those of
    lower score bins (a running sum over at most 2 ** ``HALVINGS`` rows per key) plus
    those below it inside its own bin, so no task sorts all scores. Bins are ordered
    like scores, so the area does not depend on where the sketch puts their edges.
    """
    parts = list(keys)
    each = scored.groupBy(*parts, "score").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")
    )
    each = score_bins(each, *parts)
    bins = each.groupBy(*parts, "bin").agg(F.sum("neg").alias("bin_neg"))
    lower = Window.partitionBy(*parts).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(*parts, "bin", F.coalesce(F.sum("bin_neg").over(lower), F.lit(0)).alias("lower_neg"))
    inside = Window.partitionBy(*parts, "bin").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    ranked = each.withColumn("inside_neg", F.coalesce(F.sum("neg").over(inside), F.lit(0))).join(bins, [*parts, "bin"])
    below = F.col("lower_neg") + F.col("inside_neg")
    halves = F.col("pos") * (2 * below + F.col("neg"))
    totals = ranked.groupBy(*parts).agg(
        F.sum(halves).alias("halves"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg")
    )
    return totals.select(
        *parts, F.try_divide(F.col("halves").cast("double"), 2.0 * F.col("n_pos") * F.col("n_neg")).alias("roc_auc")
    )


def measures(scored: DataFrame, *keys: str) -> DataFrame:
    keys = keys or ("model",)
    return rates(confusion(scored, *keys)).join(roc_auc(scored, *keys), list(keys))


def leaderboard(scored: DataFrame) -> DataFrame:
    """One row per model, best area first."""
    table = measures(scored, "model").select("model", "roc_auc", "accuracy", "precision", "recall", "f1")
    return table.orderBy(F.desc("roc_auc"), "model")


def best_model(table: DataFrame) -> DataFrame:
    return table.agg(F.max_by("model", F.struct("roc_auc", "model")).alias("model"))


def display(table: DataFrame) -> DataFrame:
    """Percentages to one digit with a rank; a leaderboard has one row per model."""
    rank = F.row_number().over(Window.orderBy(F.desc("roc_auc"), "model")).alias("Rank")
    # fixed values: column captions
    captions = {
        "roc_auc": "Validation ROC-AUC %",
        "accuracy": "Validation Accuracy %",
        "precision": "Validation Precision %",
        "recall": "Validation Recall %",
        "f1": "Validation F1 %",
    }
    return table.select(
        rank, F.col("model").alias("Model"), *[F.round(F.col(c) * 100, 1).alias(text) for c, text in captions.items()]
    )

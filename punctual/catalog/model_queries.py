"""Feature, model, evaluation and explanation queries."""

from __future__ import annotations

from functools import lru_cache, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctual.functions.tally import tally
from punctual.operators import sampling as S
from punctual.operators import sinks as K
from punctual.plans.delay_models import boosted_stumps as B
from punctual.plans.delay_models import evaluation as V
from punctual.plans.delay_models import explanation as X
from punctual.plans.delay_models import features as M
from punctual.plans.delay_models import models as C
from punctual.session import cut_lineage, run_folder


def modelling_rows(t) -> DataFrame:
    """Every flight: all training rows are learned, all validation and test rows scored and measured."""
    return M.labelled(M.select(S.time_split(t.operated(places=True), t.s), "split"))


def holey_rows(t) -> DataFrame:
    """Modelling rows with missing distances and carriers on two days of the month."""
    day = F.col("day_of_month")
    rows = M.select(t.operated(places=True)).withColumns(
        {
            "distance": F.when(day != 31, F.col("distance")),
            "op_unique_carrier": F.when(day != 30, F.col("op_unique_carrier")),
        }
    )
    return S.time_split(rows, t.s)


def train_of(rows: DataFrame) -> DataFrame:
    return rows.where("split = 'train'")


def balanced(df: DataFrame) -> DataFrame:
    """Even partitions: every iteration of a fit waits for its largest one.

    Rows are dealt before they become vectors, which are several times as large.
    """
    spark = df.sparkSession
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(spark.sparkContext.defaultParallelism, shuffle))


#: A scan deals out bytes. Vectors are stored as long as they are in memory, so its splits bound what a task of a fit
#: keeps and reads again in every iteration; as dictionaries about a ninth of that (47 of 435 MB on 6 x sf0.1).
PLAIN = {"compression": "none", "parquet.enable.dictionary": "false", "parquet.block.size": 32 << 20}


class Prepared:
    """Vectors of the three splits, written once; every model of a run reads them."""

    def __init__(self, t):
        self.t = t
        rows = cut_lineage(modelling_rows(t))
        ready = M.fit(train_of(rows), t.s.rare_category_rows)
        self.ready = ready
        self.train, self.valid, self.test = (
            cut_lineage(ready.vectors(balanced(rows.where(F.col("split") == part))), **options)
            for part, options in (("train", PLAIN), ("valid", {}), ("test", {}))
        )
        self.names = M.feature_names(ready.vectors(rows))
        self.fitted = {}

    def fit(self, name: str):
        if name not in self.fitted:
            self.fitted[name] = C.FITTERS[name](self.train, self.t.s)
        return self.fitted[name]

    def scores(self, name: str, split: DataFrame) -> DataFrame:
        return C.scored(self.fit(name), split, name)


@lru_cache(maxsize=2)
def prepared(t) -> Prepared:
    """One preparation per session and folder: its rows are in shared storage already."""
    return Prepared(t)


def fixture_scores(t) -> DataFrame:
    """A score with many ties and the true label, to check measures without a model."""
    score = (F.col("dep_hour") * 40 + F.col("crs_dep_time") % 100) / F.lit(1100.0)
    return t.complete().select(
        F.col("airline_name").alias("model"), score.alias("score"), F.col("is_delayed").alias("label"),
        (score >= 0.5).cast("int").alias("prediction"),
    )


def imputed(t) -> DataFrame:
    rows = holey_rows(t)
    stats = M.numeric_stats(train_of(rows))
    median = stats.where("column_name = 'distance'").select("median").scalar()
    return rows.where("split IS NOT NULL").groupBy("split").agg(
        F.count_if(F.col("distance").isNull()).alias("n_filled"),
        F.round(F.avg(F.coalesce("distance", median)), 6).alias("mean_distance"),
    )


def scaled(t) -> DataFrame:
    rows = holey_rows(t)
    out = M.standardized(rows, M.numeric_stats(train_of(rows)))
    measures = [F.round(F.avg(c), 6).alias(f"mean_{c}") for c in M.NUMERIC]
    spread = [F.round(F.stddev_pop(c), 6).alias(f"std_{c}") for c in M.NUMERIC]
    return out.where("split IS NOT NULL").groupBy("split").agg(*measures, *spread)


def pooled(t) -> DataFrame:
    rows = holey_rows(t)
    counts = M.category_counts(train_of(rows))
    mode = M.modes(counts)
    out = M.bucketed(rows, mode, M.vocabulary(counts, mode), t.s.rare_category_rows)
    long = out.where("split IS NOT NULL").unpivot(["split"], list(M.CATEGORICAL), "column_name", "bucket")
    return tally(long, "split", "column_name", "bucket")


def modes(t) -> DataFrame:
    return M.modes(M.category_counts(train_of(holey_rows(t))))


def weights(t) -> DataFrame:
    rows = train_of(holey_rows(t)).select(F.col("is_delayed").alias("label"))
    weighted = M.class_weights(rows)
    return weighted.groupBy("label").agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.max("weight"), 9).alias("class_weight")
    )


FEATURES = {
    "ml_feature_select": lambda t: tally(M.select(t.operated(places=True)), "year", "dep_hour", "origin_state_abr", "is_delayed"),
    "ml_impute_median": imputed,
    "ml_standardize": scaled,
    "ml_impute_mode": modes,
    "ml_rare_bucket": pooled,
    "ml_class_weight": weights,
    "ml_base_rate": lambda t: M.base_rate(t.operated()),
    "ml_onehot_unknown_zero": lambda t: unseen_vectors(prepared(t)),
    "ml_assemble_sparse": lambda t: vector_sizes(prepared(t)),
    "ml_feature_names": lambda t: prepared(t).names,
}


def unseen_vectors(p: Prepared) -> DataFrame:
    """Test rows whose carrier is replaced by one the training split never had."""
    rows = modelling_rows(p.t).where("split = 'test'").withColumn("op_unique_carrier", F.lit("unseen"))
    hot = p.ready.encoder.transform(p.ready.flat(rows))
    set_slots = B.set_slots(F.unwrap_udt(F.col(f"op_unique_carrier{M.HOT}")))
    return hot.groupBy(F.size(set_slots).alias("n_set")).agg(F.count(F.lit(1)).alias("n_rows"))


def vector_sizes(p: Prepared) -> DataFrame:
    """Slots of the vectors and how many are not zero, read from their sparse parts."""
    vector = F.unwrap_udt(F.col("features"))
    parts = [("train", p.train), ("valid", p.valid), ("test", p.test)]
    tagged = reduce(DataFrame.unionByName, [df.withColumn("split", F.lit(name)) for name, df in parts])
    counted = tagged.select(
        "split", F.coalesce(vector["size"], F.size(vector["values"])).alias("slots"), F.size(B.set_slots(vector)).alias("filled")
    )
    return counted.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max("slots").alias("n_slots"), F.avg("filled").alias("mean_set")
    )


def model_measures(name: str):
    def run(t) -> DataFrame:
        p = prepared(t)
        return V.measures(cut_lineage(p.scores(name, p.valid)))

    return run


def validation_scores(p: Prepared) -> tuple[dict, DataFrame]:
    fitted = {name: p.fit(name) for name in C.FITTERS}
    scores = reduce(DataFrame.unionByName, [C.scored(m, p.valid, n) for n, m in fitted.items()])
    return fitted, cut_lineage(scores)


def leaderboard(t) -> DataFrame:
    return V.leaderboard(validation_scores(prepared(t))[1])


def select_and_test(t) -> DataFrame:
    """Pick on validation, then score the test split once with the chosen model."""
    p = prepared(t)
    fitted, scores = validation_scores(p)
    chosen = V.best_model(V.leaderboard(scores)).first().model
    return V.measures(cut_lineage(C.scored(fitted[chosen], p.test, chosen)))


def both_splits(t) -> DataFrame:
    p = prepared(t)
    fitted, valid = validation_scores(p)
    test = reduce(DataFrame.unionByName, [C.scored(m, p.test, n) for n, m in fitted.items()])
    both = valid.withColumn("split", F.lit("valid")).unionByName(test.withColumn("split", F.lit("test")))
    return V.measures(cut_lineage(both), "model", "split")


def linear_contributions(t) -> DataFrame:
    """Every test row against the mean of every training row."""
    p = prepared(t)
    return X.contributions(p.fit(C.LOGISTIC), p.train, p.test, p.names, range(len(M.NUMERIC)))


def importance_of(*models: str):
    def run(t) -> DataFrame:
        p = prepared(t)
        return reduce(
            DataFrame.unionByName,
            [X.top_features(p.fit(m), p.names).withColumn("model", F.lit(m)) for m in models],
        )

    return run


def exported_metrics(t) -> DataFrame:
    path = K.replace_csv(V.measures(fixture_scores(t)).coalesce(1), run_folder(t.spark, "metrics"))
    return t.spark.read.csv(path, header=True, inferSchema=False)


MODELS = {
    "mdl_logistic": model_measures(C.LOGISTIC),
    "mdl_random_forest": model_measures(C.FOREST),
    "mdl_gbt": model_measures(C.BOOSTED),
    "mdl_adaboost": model_measures(C.STUMPS),
    "mdl_score": lambda t: score_summary(prepared(t)),
    "ev_leaderboard": leaderboard,
    "ev_select_and_test": select_and_test,
    "ev_all_models_both_splits": both_splits,
    "xai_coef_importance": importance_of(C.LOGISTIC),
    "xai_tree_importance": importance_of(C.FOREST, C.BOOSTED, C.STUMPS),
    "topk_features": importance_of(C.LOGISTIC),
    "xai_linear_shap": linear_contributions,
    "xai_top10": lambda t: X.top_contributions(linear_contributions(t)),
    "sink_metrics_csv": exported_metrics,
}


def score_summary(p: Prepared) -> DataFrame:
    scores = p.scores(C.LOGISTIC, p.test)
    return scores.groupBy("label", "prediction").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("score").alias("min_score"), F.max("score").alias("max_score")
    )


EVALUATION = {
    "ev_confusion": lambda t: V.confusion(fixture_scores(t), "model"),
    "ev_accuracy": lambda t: V.rates(V.confusion(fixture_scores(t), "model")).select("model", "accuracy"),
    "ev_precision": lambda t: V.rates(V.confusion(fixture_scores(t), "model")).select("model", "precision"),
    "ev_recall": lambda t: V.rates(V.confusion(fixture_scores(t), "model")).select("model", "recall"),
    "ev_f1": lambda t: V.rates(V.confusion(fixture_scores(t), "model")).select("model", "f1"),
    "ev_roc_auc": lambda t: V.roc_auc(fixture_scores(t), "model"),
    "ev_roc_auc_overall": lambda t: V.roc_auc(fixture_scores(t)),
    "ev_display_pct": lambda t: V.display(V.measures(fixture_scores(t), "model")),
}

QUERIES = {**FEATURES, **MODELS, **EVALUATION}

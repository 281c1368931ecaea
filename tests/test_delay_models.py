"""Measures and explanations against brute force; models on data with signal."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from punctual.catalog import model_queries as Q
from punctual.catalog.tables import Tables
from punctual.operators import sampling as S
from punctual.plans.delay_models import evaluation as V
from punctual.plans.delay_models import explanation as E
from punctual.plans.delay_models import features as M
from punctual.plans.delay_models import models as C
from punctual.settings import FIXTURE, PUBLISHED


def test_area_with_ties(spark):
    rng = np.random.default_rng(0)
    label = rng.integers(0, 2, 400)
    score = np.round(np.clip(rng.normal(0.4 + 0.1 * label, 0.2), 0, 1), 2)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(label, score)], "label int, score double")
    pos, neg = score[label == 1], score[label == 0]
    brute = np.mean((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :]))
    assert V.roc_auc(df).first().roc_auc == pytest.approx(brute, abs=1e-12)


def test_area_and_bins_of_crowded_scores(spark):
    rng = np.random.default_rng(8)
    score = np.r_[0.4 + rng.random(6000) / 1000, 0.9]
    label = (rng.random(6001) < 0.3 + 300 * (score - 0.4)).astype(int)
    rows = [("m", int(a), float(b)) for a, b in zip(label, score)] + [("n", 1, 0.5), ("n", 0, 0.5), ("n", 0, 0.1)]
    df = spark.createDataFrame(rows, "model string, label int, score double")
    pos, neg = score[label == 1], score[label == 0]
    brute = np.mean((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :]))
    got = {r.model: r.roc_auc for r in V.roc_auc(df, "model").collect()}
    assert got == {"m": pytest.approx(brute, abs=1e-12), "n": pytest.approx(0.75)}
    bins = V.score_bins(df.where("model = 'm'").select("model", "score").distinct(), "model").groupBy("bin").count().toPandas()
    assert len(bins) > 1000 and bins["count"].max() < 20


def test_rates_without_positives(spark):
    df = spark.createDataFrame([(0, 0), (1, 0)], "label int, prediction int")
    row = V.rates(V.confusion(df)).first()
    assert (row.accuracy, row.precision, row.recall, row.f1) == (0.5, 0.0, 0.0, 0.0)


def _vectors(spark, rows=600):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(rows, 3)) * (rng.random((rows, 3)) < 0.7)
    y = (x[:, 0] + 0.3 * rng.normal(size=rows) > 0.2).astype(float)
    data = [(float(b), Vectors.dense(*a), "2000-01-01") for a, b in zip(x, y)]
    return x, spark.createDataFrame(data, ["label", "features", "fl_date"])


def test_models_find_the_signal(spark):
    _, df = _vectors(spark)
    for name, fitter in C.FITTERS.items():
        scores = C.scored(fitter(df, FIXTURE), df, name)
        row = V.measures(scores).first()
        assert row.roc_auc > 0.8, name
        assert scores.where("score NOT BETWEEN 0 AND 1").count() == 0


def test_contributions_match_numpy(spark):
    x, df = _vectors(spark)
    model = C.logistic(df, FIXTURE)
    names = spark.createDataFrame([(0, "numeric__dep_hour"), (1, "day_of_week"), (2, "route_A_B")], "slot int, name string")
    got = {r.feature: r.mean_abs_contribution for r in E.contributions(model, df, df, names).collect()}
    beta = model.coefficients.toArray()
    expected = np.abs(beta * (x - x.mean(axis=0))).mean(axis=0)
    assert [got[k] for k in ("Dep Hour", "Day Of Week", "Route A B")] == pytest.approx(list(expected))


def test_unseen_and_rare_categories(spark, tables):
    rows = M.select(tables.operated(places=True))
    ready = M.fit(rows, 40)
    strange = rows.limit(1).withColumn("op_unique_carrier", F.lit("??"))
    size = len(M.feature_names(ready.vectors(rows)).collect())
    vector = ready.vectors(strange).first().features
    assert vector.size == size
    names = [r.name for r in M.feature_names(ready.vectors(rows)).orderBy("slot").collect()]
    assert not any(vector[i] for i, n in enumerate(names) if n.startswith("op_unique_carrier"))
    assert f"route_{M.RARE}" in names


def test_samples_do_not_depend_on_partitions(tables):
    rows = tables.operated().select("fl_date", "op_unique_carrier", "crs_dep_time", "air_time")
    once = S.fraction(rows, 10, 42)
    again = S.fraction(rows.repartition(7), 10, 42)
    assert once.exceptAll(again).isEmpty() and again.exceptAll(once).isEmpty()
    assert 0.05 < once.count() / rows.count() < 0.15


def test_registered_models_have_the_published_sizes(tables):
    sizes = [k for k in vars(PUBLISHED) if k.startswith(("logistic_", "forest_", "boost_", "stump_"))]
    assert len(sizes) == 10
    assert {k: getattr(tables.s, k) for k in sizes} == {k: getattr(PUBLISHED, k) for k in sizes}


def test_every_training_flight_is_learned(spark, tables):
    """With the published settings, too: their training period covers all flights here."""
    flights = tables.operated().where("is_delayed IS NOT NULL AND fl_date IS NOT NULL").count()
    learned = Q.train_of(Q.modelling_rows(Tables(spark, tables.folder, PUBLISHED)))
    assert learned.count() == flights > 0

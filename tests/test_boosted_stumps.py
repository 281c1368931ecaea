"""Boosted stumps against a plain row-by-row version."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from punctual.catalog import model_queries as Q
from punctual.plans.delay_models import boosted_stumps as B
from punctual.plans.delay_models import models as C


def plain_boost(x, y, cuts, rounds, step):
    """Stored weights, every cut of every slot tried on all rows; returns (slot, cut, left, right) a round."""
    w, found = np.ones(len(y)), []
    for _ in range(rounds):
        best = None
        for slot in range(x.shape[1]):
            for cut in cuts.get(slot, (0.0,)):
                left = x[:, slot] <= cut
                sides = [(w[m & (y == 0)].sum(), w[m & (y == 1)].sum()) for m in (left, ~left)]
                if min(sum(s) for s in sides) <= 1e-12 * w.sum():
                    continue
                loss = sum(2 * a * b / (a + b) for a, b in sides)
                if best is None or loss < best[0] - 1e-12 * w.sum():
                    best = (loss, slot, cut, *[1 if b > a else -1 for a, b in sides])
        _, slot, cut, left, right = best
        wrong = np.where(x[:, slot] <= cut, left, right) != 2 * y - 1
        error = w[wrong].sum() / w.sum()
        if error >= 0.5:
            break
        vote = step * math.log((1 - error) / max(error, 1e-12))
        found.append((slot, cut, vote * left, vote * right))
        if error <= 0:
            break
        w = w * np.exp(vote * wrong)
    return found


def mixed_rows(rows=800, seed=3):
    rng = np.random.default_rng(seed)
    x = np.column_stack([
        rng.normal(size=rows), rng.integers(-2, 3, rows), np.full(rows, 4.0), rng.integers(0, 2, rows),
        (rng.random(rows) < 0.1), rng.integers(0, 2, rows), np.zeros(rows),
    ]).astype(float)
    y = (x[:, 0] + 0.8 * x[:, 3] - 0.5 * (x[:, 1] > 0) + rng.normal(size=rows) > 0.3).astype(int)
    return x, y


def frame(spark, x, y, sparse=False):
    def vector(v):
        return Vectors.sparse(len(v), [(i, float(a)) for i, a in enumerate(v) if a]) if sparse else Vectors.dense(*v)

    return spark.createDataFrame([(float(b), vector(a)) for a, b in zip(x, y)], ["label", "features"])


@pytest.mark.parametrize("sparse", [False, True])
@pytest.mark.parametrize("seed", [3, 4])
def test_same_stumps_as_the_plain_version(spark, sparse, seed):
    x, y = mixed_rows(seed=seed)
    df = frame(spark, x, y, sparse)
    model = B.boost(df, 15, 0.5, 16)
    assert sorted(model.cells.cuts) == [0, 1, 2] and model.cells.cuts[2] == ()
    expected = plain_boost(x, y, model.cells.cuts, 15, 0.5)
    assert [s[:2] for s in model.splits] == [e[:2] for e in expected]
    assert np.allclose([s[2:] for s in model.splits], [e[2:] for e in expected])
    votes = sum(np.where(x[:, s] <= c, a, b) for s, c, a, b in expected)
    total = sum(abs(e[2]) for e in expected)
    got = np.array([r.score for r in model.transform(df.coalesce(1)).collect()])
    assert np.allclose(np.sort(got), np.sort(1 / (1 + np.exp(-votes / total))))
    assert sum(model.importance) == pytest.approx(1.0)


def test_same_stumps_on_flights(spark, tables):
    """All training rows of the smallest tables, as they are prepared for every classifier."""
    train = Q.Prepared(tables).train
    model = B.boost(train, 8, tables.s.stump_step, 16)
    rows = train.collect()
    x = np.array([r.features.toArray() for r in rows])
    expected = plain_boost(x, np.array([int(r.label) for r in rows]), model.cells.cuts, 8, tables.s.stump_step)
    assert [s[:2] for s in model.splits] == [e[:2] for e in expected]
    assert np.allclose([s[2:] for s in model.splits], [e[2:] for e in expected])


def test_rows_without_a_split(spark):
    x, y = mixed_rows(20)
    df = frame(spark, x, y)
    none = B.boost(df.limit(0), 5, 0.5, 8)
    assert none.splits == [] and none.total == 0
    same = frame(spark, np.tile([1.0, 7.0], (6, 1)), np.array([1, 1, 1, 1, 0, 0]))
    model = B.boost(same, 5, 0.5, 8)
    assert model.splits == [] and model.base > 0
    assert {r.prediction for r in model.transform(same).collect()} == {1.0}
    pure = frame(spark, np.array([[0.0], [1.0], [1.0]]), np.array([0, 1, 1]))
    assert len(B.boost(pure, 5, 0.5, 8).splits) == 1


def test_extra_columns_and_long_plans(spark):
    x, y = mixed_rows(200)
    df = frame(spark, x, y).withColumn("score", F.lit("mine").substr(1, 0)).withColumn("cells", F.lit(1)).withColumn("vote", F.lit(2))
    few, many = (B.boost(df, n, 0.5, 8) for n in (2, 12))
    out = many.transform(df.drop("score"))
    assert out.columns == ["label", "features", "cells", "vote", "score", "prediction"]
    size = [len(m.transform(df.drop("score"))._jdf.queryExecution().analyzed().toString().split("\n")) for m in (few, many)]
    assert size[0] == size[1]
    assert C.importances(many) == many.importance

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from punctual.llm import angular_negatives

SCHEMA = "vec_id bigint, embedding array<double>, label int, id bigint, v string, part int, wants string"


def plain(rows, every=50):
    """Brute force over rows (id, vector, label)."""
    best = {}
    for i, x, label, *_ in rows:
        if i is None or label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        v = [math.floor(256 * c) for c in x]
        row = ((label + 1) % 10 if i % 7 == 0 else label, v)
        if sum(c * c for c in v) < 2**62 and (i not in best or row < best[i]):
            best[i] = row
    dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=False))
    out = []
    for i, (label, v) in best.items():
        if i % every:
            continue
        scores = {j: dot(v, w) for j, (_, w) in best.items()}
        order = sorted(scores, key=lambda j: (-scores[j], j))
        for p in [j for j in order if j != i and best[j][0] == label][:5]:
            negatives = [j for j in order if best[j][0] != label and 50 * scores[p] <= 100 * scores[j] <= 95 * scores[p]][:3]
            out += [(i, p, r, j, scores[p], scores[j]) for r, j in enumerate(negatives, 1)]
    return sorted(out)


def mined(df, **more):
    return sorted(tuple(r) for r in angular_negatives.mine(df, **more).collect())


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "v", 2, "w") for r in rows], SCHEMA).repartition(3)


def test_given_table(spark):
    given = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [tuple(r) for r in given.select("vec_id", "embedding", "label").collect()]
    want = plain(rows)
    assert len(want) > 500 and mined(given) == want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_clusters_and_ties(spark, seed):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [round(c + rng.gauss(0, 0.3), 1) for c in rng.choice(centres)], rng.randrange(4)) for i in range(300)]
    assert mined(table(spark, rows), every=10) == plain(rows, every=10)


def test_odd_rows(spark):
    rng = random.Random(9)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)], i % 3) for i in range(120)]
    rows += [rows[50], (50, [9.0, 0.0, 0.0, 0.0], 2), (None, [1.0] * 4, 1), (200, None, 1), (201, [1.0, None, 0.0, 0.0], 1), (202, [1.0, math.nan, 0.0, 0.0], 1)]
    rows += [(203, [1.0, math.inf, 0.0, 0.0], 1), (204, [1.0] * 4, None), (250, [], 1), (251, [0.0] * 4, 1), (300, [0.5], 0), (301, [0.5, 0.5], 1), (350, [1e30, 0.0, 0.0, 0.0], 1)]
    rows += [(400, [3e6, 1.0, 0.0, 0.0], 0), (401, [3e6, 0.5, 0.0, 0.0], 0), (402, [2e6, 0.5, 0.0, 0.0], 1), (-100, [1.0, 1.0, 0.0, 0.0], 0)]
    got, want = mined(table(spark, rows), every=10), plain(rows, every=10)
    assert got == want and any(r[0] == 400 for r in want)


def test_one_label_and_few_rows(spark):
    assert mined(table(spark, [(i, [1.0, i / 10], 3) for i in range(1, 7)]), every=1) == plain([(i, [1.0, i / 10], 3) for i in range(1, 7)], every=1) == []
    assert mined(table(spark, [(50, [1.0], 1)])) == []
    assert mined(spark.createDataFrame([], SCHEMA)) == []


def test_many_blocks_and_copies(spark, monkeypatch):
    monkeypatch.setattr(angular_negatives, "ROWS", 16)
    monkeypatch.setattr(angular_negatives, "ANCHORS", 4)
    rng = random.Random(4)
    same = [0.3, 0.4, -0.2]
    rows = [(i, same if i % 3 == 0 else [rng.gauss(0, 1) for _ in range(3)], 1 if i % 2 else i % 5) for i in range(400)]
    assert mined(table(spark, rows), every=20) == plain(rows, every=20)


@pytest.mark.parametrize("same_label", [True, False])
def test_copies_of_anchors_are_not_sent_through_the_driver(spark, same_label):
    """The copies for all lanes are many times what their table's size tells."""
    rows = [(1, 0, 0, 1, b"i", b"n", b"a", b"v", b""), (2, 0, 0, 1, b"i", b"n", b"a", b"v", b"")]
    blocks = angular_negatives.cut_lineage(spark.createDataFrame(rows, angular_negatives.BLOCK))
    pairs = angular_negatives.paired(blocks, blocks, 64, same_label)
    assert pairs.count() == 2 and "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_bounds_hold_every_score():
    rng = np.random.default_rng(3)
    m = np.floor(256 * rng.normal(size=(60, 8)) * rng.choice([1e-3, 1.0, 1e3], size=(60, 1))).astype(np.int64)
    m[5], m[6], m[7] = m[4], -m[4], 0
    norms = np.sqrt((m.astype(float) ** 2).sum(axis=1))
    directions = m[:6] / np.maximum(norms[:6, None], 1)
    block = angular_negatives.Block(np.arange(60), norms, angular_negatives.angles(m, norms, directions), m, np.zeros((60, 0), np.int64))
    low, high = angular_negatives.score_bounds(block, block)
    exact = angular_negatives.scores(block, block, np.arange(60))
    assert (exact == m @ m.T).all() and (low <= exact).all() and (exact <= high).all()
    # rows near a direction are told apart without a score
    assert (high[4][m @ m[4] < 0] < norms[4] * norms[m @ m[4] < 0]).all()

"""Forests and boosted trees from histograms against plain versions on all rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_boosted_stumps import frame, mixed_rows

from punctual.plans.delay_models import boosted_stumps as B
from punctual.plans.delay_models import evaluation as V
from punctual.plans.delay_models import histogram_trees as H
from punctual.plans.delay_models import models as C


def plain_tree(x, t, cuts, depth):
    """Mean of ``t`` per leaf, every cut of every slot tried on all rows by squared error."""
    out = np.full(len(t), t.mean())
    best = None
    for slot in range(x.shape[1] if depth else 0):
        for cut in cuts.get(slot, (0.0,)):
            left = x[:, slot] <= cut
            if not 0 < left.sum() < len(t):
                continue
            gain = sum(t[m].sum() ** 2 / m.sum() for m in (left, ~left)) - t.sum() ** 2 / len(t)
            if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                best = (gain, left)
    if best:
        for m in (best[1], ~best[1]):
            out[m] = plain_tree(x[m], t[m], cuts, depth - 1)
    return out


@pytest.mark.parametrize("sparse", [False, True])
def test_boosted_trees_equal_plain_ones(spark, monkeypatch, sparse):
    monkeypatch.setattr(H, "REFRESH", 2)
    x, y = mixed_rows()
    df = frame(spark, x, y, sparse).repartition(3)
    model = H.grow_boosted(df, 5, 3, 0.3, 1.0, 32, 42)
    margin = np.zeros(len(y))
    for i in range(5):
        sign = 2.0 * y - 1
        target = 4 * sign / (1 + np.exp(2 * sign * margin)) if i else sign
        margin += (0.3 if i else 1.0) * plain_tree(x, target, model.cells.cuts, 3)
    got = np.sort([r.score for r in model.transform(df).select("score").collect()])
    assert got == pytest.approx(np.sort(1 / (1 + np.exp(-2 * margin))), abs=1e-9)
    assert sum(model.importance) == pytest.approx(1)


def test_forest_leaves_are_large_and_find_the_signal(spark):
    x, y = mixed_rows(3000)
    df = frame(spark, x, y).repartition(3)
    model = H.grow_forest(df, 12, 14, 50, 32, 42)
    rows = H.blocks(df, model.cells).toArrow().to_pylist()
    kind = H.Kind(42, 3, None, 50, False)
    for number, tree in enumerate(model.trees):
        seen = np.zeros(len(tree.slot))
        for r in rows:
            bins, hot = np.frombuffer(r["bins"], np.uint8).reshape(-1, r["n"]), np.frombuffer(r["hot"], "<i4").reshape(r["width"], r["n"])
            seen += np.bincount(tree.leaves(model.cells, bins, hot, r["n"]), H.row_weights(kind, number, r["block"], r["n"]), len(seen))
        leaves = tree.slot < 0
        assert tree.steps > 2 and seen[leaves].min() >= 50 and seen[~leaves].sum() == 0
    scored = C.scored(model, df.withColumn("fl_date", F.lit("d")), "forest")
    assert V.measures(scored).first().roc_auc > 0.8
    assert np.argmax(model.importance) == 0 and model.importance[2] == model.importance[6] == 0


def test_trees_without_rows_or_split(spark):
    x, y = mixed_rows(50)
    df = frame(spark, x, y)
    for rows, score in ((df.where("label = 7"), 0.0), (frame(spark, np.ones((4, 2)), np.array([1, 1, 1, 0])), None)):
        model = H.grow_forest(rows, 3, 4, 1, 32, 1)
        assert all(len(t.slot) == 1 for t in model.trees)
        got = {r.score for r in model.transform(df if score is not None else rows).select("score").collect()}
        assert len(got) == 1 and (score is None or got == {score})
    assert H.grow_boosted(df.where("label = 7"), 2, 2, 0.1, 0.8, 32, 1).transform(df).count() == 50


CELLS = B.Cells(9, {0: (0.0, 1.5, 4.0), 3: (), 4: tuple(float(i) for i in range(40))})


def test_dense_and_sparse_vectors_become_the_same_cells():
    nan = float("nan")
    dense = np.zeros((5, 9))
    dense[0, [0, 1, 4]] = 1.5, 1, 7
    dense[1, [0, 2, 3, 4, 8]] = nan, 1, 5, 39.5, 1
    dense[2, [0, 4]] = -0.0, -3
    dense[3, [1, 2, 5, 6]] = 1
    sparse = [[int(i) for i in np.flatnonzero(row)] for row in dense]
    shapes = [[None] * 5, sparse, [None, *sparse[1:3], None, sparse[4]]]
    for indices in shapes:
        values = [list(map(float, row if i is None else row[i])) for row, i in zip(dense, indices, strict=True)]
        bins, hot = B.matrices(CELLS, pa.array(indices, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64())))
        assert bins.tolist() == [[1, 3, 0, 0, 0], [0] * 5, [7, 40, 0, 0, 0]]
        assert [[int(s) for s in column if s >= 0] for column in hot.T] == [[1], [2, 8], [], [1, 2, 5, 6], []]
    bins, hot = B.matrices(CELLS, pa.array([], pa.list_(pa.int32())), pa.array([], pa.list_(pa.float64())))
    assert bins.shape == (3, 0) and hot.shape == (0, 0)


@pytest.mark.parametrize("add_of", [H.few_slots, H.many_slots])
def test_sums_of_chosen_slots(add_of, monkeypatch):
    """Only rows of few nodes, rows with fewer set slots, columns counted together and alone."""
    rng = np.random.default_rng(2)
    for joint in (1, 200, 1024):
        monkeypatch.setattr(H, "JOINT", joint)
        n, nodes = 500, 5
        bins = np.stack([rng.integers(0, size, n) for size in (4, 1, 41)]).astype(np.uint8)
        hot = np.stack([rng.choice([-1, 1, 2], n), rng.choice([-1, 5, 6, 7, 8], n)]).astype(np.int32)
        chosen = np.sort(np.stack([rng.choice(9, 6, replace=False) for _ in range(nodes)]), axis=1).astype(np.int32)
        rows = np.sort(rng.choice(n, 300, replace=False))
        node, pair = rng.integers(0, nodes, 300), rng.random((2, 300))
        first, size = H.layout(CELLS, chosen)
        want = np.zeros((2, size))
        for i, row in enumerate(rows):
            want[:, node[i]] += pair[:, i]
            for slot, at in zip(chosen[node[i]], first[node[i]], strict=True):
                if slot in CELLS.cuts:
                    want[:, at + bins[list(CELLS.cuts).index(slot), row]] += pair[:, i]
                elif slot in hot[:, row]:
                    want[:, at] += pair[:, i]
        lines = [line[rows] for line in hot]
        assert np.allclose(add_of(CELLS, chosen)(node, rows, bins, lines, tuple(pair)), want)
        counts = add_of(CELLS, chosen)(node, rows, bins, lines, (None, pair[1]))
        assert np.allclose(counts[1], want[1]) and np.array_equal(counts[0, :nodes], np.bincount(node, minlength=nodes))


@pytest.mark.parametrize("whole", [0, 2, 9])
def test_rows_end_where_their_splits_lead(monkeypatch, whole):
    """Splits by whole columns, by row, and both."""
    monkeypatch.setattr(H, "WHOLE", whole)
    rng = np.random.default_rng(6)
    n, tree = 400, H.Tree()
    bins = np.stack([rng.integers(0, size, n) for size in (4, 1, 41)]).astype(np.uint8)
    hot = np.stack([rng.choice([-1, 1, 2], n), rng.choice([-1, 5, 6, 7, 8], n)]).astype(np.int32)
    for _ in range(5):
        nodes = len(tree.slot) - tree.frontier
        slot = np.where(rng.random(nodes) < 0.8, rng.choice([0, 1, 2, 4, 6, 8], nodes), -1).astype(np.int32)
        slot[0] = 4
        tree = tree.grow(slot, rng.integers(0, 3, nodes) * np.where(slot == 4, 10, 1), np.zeros((nodes, 2)))
    want = []
    for row in range(n):
        node = 0
        while (slot := tree.slot[node]) >= 0:
            right = bins[list(CELLS.cuts).index(slot), row] > tree.bin[node] if slot in CELLS.cuts else slot in hot[:, row]
            node = tree.left[node] + right
        want.append(node)
    assert tree.leaves(CELLS, bins, hot, n).tolist() == want
    rows = np.flatnonzero(rng.random(n) < 0.5)
    assert tree.leaves(CELLS, bins, hot, n, rows).tolist() == [want[i] for i in rows]


def test_models_with_as_many_bins_share_their_blocks(spark, monkeypatch):
    x, y = mixed_rows(200)
    df, seen = frame(spark, x, y), []
    monkeypatch.setattr(B, "binning", lambda *given, f=B.binning: seen.append(given[1]) or f(*given))
    H.grow_forest(df, 2, 2, 5, 32, 1)
    H.grow_boosted(df, 2, 2, 0.3, 1.0, 32, 1)
    B.boost(df, 2, 0.5, 16)
    assert seen == [32, 16]

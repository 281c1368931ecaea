"""Quality classifier: histogram gradient-boosted trees over document statistics.

Labelled documents are described by ``FEATURES``, binned at quantiles, and trees of fixed
depth are grown level by level on gradient histograms. A fitted model is three arrays in
heap order (feature and cutoff per inner node, value per leaf), so whole batches walk the
trees together. The model is fitted on at most ``FIT_ROWS`` labelled documents, those with
the least hash of their id; every whole text is scored.

A null or empty text has all counts zero and gets the score of such a text; labels without
a document and null labels are ignored; without labels every score is 0.5, with labels of
one class only their rate, smoothed. Equal rows get equal scores, a null id stays null and
is never held out, other columns are not touched.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctual.llm.words import LOWER, fold, map_batches, mix, per_text, runs, span_hashes, span_sums, split, table

FIT_ROWS, TREES, DEPTH, BINS, RATE, RIDGE, LEAST = 20_000, 80, 4, 64, 0.15, 1.0, 8.0
FOLDS, HELD_OUT, CUTOFF = 4, 2, 0.7

CLASSES = {
    "upper": table(bytes(range(65, 91))), "lower": table(bytes(range(97, 123))), "digit": table(b"0123456789"), "mark": table(b"#*$%&<>@^~=_\\+"),
    "bar": table(b"|"), "shout": table(b"!?"), "stop": table(b".,;:"), "line": table(b"\n"), "wide": table(bytes(range(0xC0, 0x100))), "bracket": table(b"()[]{}\"'/-"),
}
KIND = np.zeros(256, np.int64)
for _i, _t in enumerate(CLASSES.values()):
    KIND[_t] = _i + 1
NEWLINE = table(b"\n")
FEATURES = (
    "log_bytes", "log_words", *(f"{c}_share" for c in CLASSES), "word_length", "word_length_spread", "long_words", "distinct_words", "top_word", "same_as_before", "repeated_triples", "distinct_lines",
    "words_per_line", "title_words", "single_marks",
)


def shares_within(keys: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: number of distinct keys, count of the most frequent, and keys that occur twice or more."""
    order = np.lexsort((keys, owner))
    k, o = keys[order], owner[order]
    at = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (o[1:] != o[:-1])]) if len(k) else np.zeros(0, np.int64)
    size, whose = np.diff(np.r_[at, len(k)]), o[at]
    most = np.zeros(texts)
    firsts = runs(whose)
    if len(whose):
        most[whose[firsts]] = np.maximum.reduceat(size, firsts)
    return np.bincount(whose, minlength=texts).astype(float), most, np.bincount(whose, np.where(size > 1, size, 0), minlength=texts)


def statistics(data: np.ndarray, edges: np.ndarray) -> dict[str, np.ndarray]:
    w = split(data, edges)
    texts, size, owner = w.texts, np.diff(edges).astype(float), w.owner()
    n = w.counts.astype(float)
    some, longest = np.maximum(n, 1), np.maximum(size, 1)
    out = {"log_bytes": np.log1p(size), "log_words": np.log1p(n)}
    whose = np.repeat(np.arange(texts) * (len(CLASSES) + 1), np.diff(edges))
    by_class = np.bincount(whose + KIND[data], minlength=texts * (len(CLASSES) + 1)).reshape(texts, -1)
    for i, name in enumerate(CLASSES):
        out[f"{name}_share"] = by_class[:, i + 1] / longest
    length = (w.end - w.start).astype(float)
    mean = np.bincount(owner, length, minlength=texts) / some
    out["word_length"] = mean
    out["word_length_spread"] = np.sqrt(np.maximum(np.bincount(owner, length**2, minlength=texts) / some - mean**2, 0))
    out["long_words"] = np.bincount(owner, length >= 12, minlength=texts) / some
    h = w.hashes(lower=True)
    distinct, most, _ = shares_within(h, owner, texts)
    out["distinct_words"], out["top_word"] = distinct / some, most / some
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    out["same_as_before"] = np.bincount(owner, same, minlength=texts) / some
    inside = owner[2:] == owner[:-2]
    triples = mix(h[:-2] * np.uint64(3) + mix(h[1:-1], 1) + mix(h[2:], 2), 3)[inside] if len(h) > 2 else h[:0]
    _, _, repeated = shares_within(triples, owner[: len(inside)][inside] if len(h) > 2 else owner[:0], texts)
    out["repeated_triples"] = repeated / some
    lines = split(data, edges, NEWLINE)
    line_owner = lines.owner()
    distinct_lines, _, _ = shares_within(span_hashes(LOWER[data], lines.start, lines.end), line_owner, texts)
    n_lines = np.maximum(lines.counts, 1)
    out["distinct_lines"], out["words_per_line"] = distinct_lines / n_lines, np.log1p(n / n_lines)
    first = data[w.start]
    out["title_words"] = np.bincount(owner, (first >= 65) & (first <= 90), minlength=texts) / some
    out["single_marks"] = np.bincount(owner, (length == 1) & ~CLASSES["lower"][first] & ~CLASSES["upper"][first], minlength=texts) / some
    assert tuple(out) == FEATURES
    return out


def matrix(texts: pa.Array) -> np.ndarray:
    columns = per_text(texts, statistics)
    return np.column_stack([columns[name] for name in FEATURES]).astype(np.float32)


@dataclass(frozen=True)
class Trees:
    """``feature``/``cutoff``: trees x inner nodes; ``value``: trees x leaves; all in heap order."""

    start: float
    feature: np.ndarray
    cutoff: np.ndarray
    value: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, cutoff, value in zip(self.feature, self.cutoff, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > cutoff[node])
            total += value[node - len(feature)]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted trees for the log odds of label 1; a few hundredths of a second per tree."""
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    rate = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
    start = float(np.log(rate / (1 - rate)))
    none = Trees(start, np.zeros((0, inner), np.int64), np.zeros((0, inner), np.float32), np.zeros((0, leaves)))
    if len(y) < 2 or y.min() == y.max():
        return none
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1]).astype(np.float32)) for column in x.T]
    bins = np.column_stack([np.searchsorted(c, column, "left") for c, column in zip(cuts, x.T, strict=True)])
    last = np.array([len(c) for c in cuts])
    width, features = BINS, x.shape[1]
    flat = bins + np.arange(features) * width
    total = np.full(len(y), start)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        feature, cutoff = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32)
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            nodes, at = 2**level, 2**level - 1
            key = ((node - at) * (features * width))[:, None] + flat
            sums = [np.bincount(key.ravel(), np.repeat(v, features), minlength=nodes * features * width).reshape(nodes, features, width).cumsum(2) for v in (g, h)]
            left, whole = sums, [s[:, :1, -1:] for s in sums]
            right = [w - s for w, s in zip(whole, left, strict=True)]
            gain = left[0] ** 2 / (left[1] + RIDGE) + right[0] ** 2 / (right[1] + RIDGE) - whole[0] ** 2 / (whole[1] + RIDGE)
            gain[(left[1] < LEAST / 4) | (right[1] < LEAST / 4) | (np.arange(width) >= last[:, None])[None]] = 0
            best = gain.reshape(nodes, -1).argmax(1)
            split_here = gain.reshape(nodes, -1)[np.arange(nodes), best] > 1e-6
            f, b = np.divmod(best, width)
            feature[at : at + nodes] = np.where(split_here, f, 0)
            cutoff[at : at + nodes] = [cuts[i][j] if ok else np.inf for i, j, ok in zip(f, b, split_here, strict=True)]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cutoff[node])
        leaf = node - inner
        value = RATE * np.bincount(leaf, g, minlength=leaves) / (np.bincount(leaf, h, minlength=leaves) + RIDGE)
        total += value[leaf]
        trees.append((feature, cutoff, value))
    return Trees(start, *(np.array(part) for part in zip(*trees, strict=True)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Trees:
    """Learn from labelled documents outside the held-out fold."""
    learned = F.crc32(F.col(id_col).cast("string")) % FOLDS != HELD_OUT
    chosen = (
        labels.where(F.col(label_col).isNotNull() & learned).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("double")).alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(FIT_ROWS)
    )
    # at most FIT_ROWS narrow rows
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "_id").select("_id", "_y", "text")

    def columns(batch: pa.RecordBatch) -> dict:
        x = matrix(batch.column(2))
        return {"id": batch.column(0).cast(pa.string()), "y": batch.column(1), "x": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel().astype(float)), x.shape[1]).cast(pa.list_(pa.float64()))}

    # rows that share an id may be more than the labels: the bound holds for them too
    got = map_batches(rows, "id string, y double, x array<double>", columns).orderBy(F.xxhash64("id"), "x").limit(FIT_ROWS).collect()
    return grow(np.array([r["x"] for r in got], np.float32).reshape(-1, len(FEATURES)), np.array([r["y"] for r in got]))


def score(docs: DataFrame, labels: DataFrame, trees: Trees | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its id, whether it was held out, its score, and 1 from ``CUTOFF`` on."""
    trees = trees or fit(docs, labels, id_col, text_col)

    def columns(batch: pa.RecordBatch) -> dict:
        s = trees.scores(matrix(batch.column(1)))
        return {id_col: batch.column(0), "held_out": fold(batch.column(0), FOLDS, HELD_OUT), "score": s, "predicted": (s >= CUTOFF).astype(np.int32)}

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(id_col), F.col(text_col)), f"`{id_col}` {kind}, held_out boolean, score double, predicted int", columns)

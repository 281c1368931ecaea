"""Adaptive boosting of one-split trees from histograms of weighted classes.

Features are binned once. A row becomes its *cells*: one per numeric slot
(the bin of its value) and one per slot of ones and zeros that is set, stored as blocks
of rows in packed columns. A round is one aggregate: the weight of both classes in every cell, from which the driver reads the best
split and its error. It sees one row per cell, as many as the model has parameters.

A vote for or against a delay only depends on a row's cells, so the votes of all rounds
add up to one number per cell and a constant (``base``). The weight of a row after any
number of rounds follows from that sum, ``exp(-y * sum / 2)`` up to a factor, with ``y``
1 for a delay and -1 otherwise: no weights are stored, plans do not grow with the rounds
and a lost executor costs one scan of its part of the cells.

Empty tables and tables without a slot that varies give a constant vote; a value that is
not a number counts as larger than every cut.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctual.session import cut_lineage

BLOCK_ROWS, TASK_ROWS = 1 << 15, 1 << 22
BLOCKS = "block bigint, n int, width int, label binary, bins binary, hot binary, margin binary"


def value_at(vector: Column, slot: int) -> Column:
    """One number of an unwrapped vector, dense or sparse, without making it dense."""
    place = F.array_position(vector["indices"], F.lit(slot).cast("int")).cast("int") - 1
    sparse = F.when(place >= 0, F.get(vector["values"], place)).otherwise(0.0)
    return F.when(vector["indices"].isNull(), F.get(vector["values"], F.lit(slot))).otherwise(sparse)


def set_slots(vector: Column) -> Column:
    """Slots of an unwrapped vector that are not zero, in order."""
    everywhere = F.sequence(F.lit(0), F.size(vector["values"]) - 1)
    slots = F.coalesce(vector["indices"], F.when(F.size(vector["values"]) > 0, everywhere), F.lit([]).cast("array<int>"))
    pairs = F.filter(F.arrays_zip(slots.alias("slot"), vector["values"].alias("value")), lambda p: p["value"] != 0)
    return F.transform(pairs, lambda p: p["slot"])


@dataclass(frozen=True)
class Cells:
    """How slots become cells: a 0/1 slot keeps its number, bins of numeric slots follow.

    ``cuts`` has the sorted cut values of each numeric slot; a value is in bin ``k`` if it
    is above exactly ``k`` of them.
    """

    size: int
    cuts: dict[int, tuple[float, ...]] = field(default_factory=dict)

    @property
    def starts(self) -> dict[int, int]:
        starts, at = {}, self.size
        for slot, cuts in self.cuts.items():
            starts[slot] = at
            at += len(cuts) + 1
        return starts

    @property
    def count(self) -> int:
        return self.size + sum(len(c) + 1 for c in self.cuts.values())


def binning(train: DataFrame, bins: int) -> Cells:
    """Cells from all training rows: which slots hold only ones and zeros, and quantiles of the others."""
    if train.isEmpty():
        return Cells(0)
    parts = ("min", "max", "normL1", "numNonZeros")
    seen = train.select(Summarizer.metrics(*parts).summary(F.col("features")).alias("s")).select("s.*").first()
    low, high, total, some = (seen[p].toArray() for p in parts)
    # values within 0 and 1 add up to the number of those above 0 only if they are all 1
    numeric = [int(i) for i in np.flatnonzero((low < 0) | (high > 1) | (total != some))]
    if not numeric:
        return Cells(len(low))
    vector = F.unwrap_udt(F.col("features"))
    columns = train.select(*[value_at(vector, i).alias(f"x{i}") for i in numeric])
    marks = columns.approxQuantile(columns.columns, [k / bins for k in range(1, bins)], 0.1 / bins)
    cuts = {i: tuple(sorted({m for m in found if m < high[i]})) for i, found in zip(numeric, marks)}
    return Cells(len(low), cuts)


def parts_of(features: str) -> tuple[Column, Column]:
    """Slots and values of a vector as it is stored; a dense one has no slots."""
    vector = F.unwrap_udt(F.col(features))
    return vector["indices"], vector["values"]


def matrices(cells: Cells, indices: pa.Array, values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the numeric slots and the slots of ones and zeros that are set, as columns; rows with fewer set slots are filled with -1."""
    n = len(values)
    lengths = values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    value = values.flatten().to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(n), lengths)
    slot = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    sparse = indices.is_valid().to_numpy(zero_copy_only=False)[owner]
    slot[sparse] = indices.flatten().to_numpy(zero_copy_only=False)
    # a model of an empty table knows no slots
    column = np.full(max(cells.size, int(slot.max(initial=-1)) + 1), -1)
    column[list(cells.cuts)] = np.arange(len(cells.cuts))
    column = column[slot]
    numbers = np.zeros((len(cells.cuts), n))
    some = np.flatnonzero(column >= 0)
    numbers[column[some], owner[some]] = value[some]
    bins = np.zeros(numbers.shape, np.uint8)
    for k, cuts in enumerate(cells.cuts.values()):
        bins[k] = np.searchsorted(np.array(cuts, float), numbers[k], "left")
    some = np.flatnonzero((column < 0) & (value != 0))
    owner, slot = owner[some], slot[some]
    counts = np.bincount(owner, minlength=n)
    hot = np.full((int(counts.max(initial=0)), n), -1, np.int32)
    hot[np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts), owner] = slot
    return bins, hot


def blocks(train: DataFrame, cells: Cells) -> DataFrame:
    """Rows as packed columns, about ``BLOCK_ROWS`` a block, written once."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            label, indices, values, number = batch.columns
            held.append((number[0].as_py() if batch.num_rows else 0, label.fill_null(0).to_numpy(zero_copy_only=False) == 1, *matrices(cells, indices, values)))
            rows += batch.num_rows
            if rows >= BLOCK_ROWS:
                yield together(held)
                held, rows = [], 0
        if rows:
            yield together(held)

    def together(held: list[tuple]) -> pa.RecordBatch:
        width = max(len(hot) for *_, hot in held)
        wide = [np.pad(hot, ((0, width - len(hot)), (0, 0)), constant_values=-1) for *_, hot in held]
        label, bins, hot = np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held], 1), np.concatenate(wide, 1)
        n = len(label)
        values = [held[0][0], n, width, label.astype(np.uint8).tobytes(), bins.tobytes(), hot.astype("<i4").tobytes(), np.zeros(n, "<f8").tobytes()]
        return pa.RecordBatch.from_arrays(
            [pa.array([v], t) for v, t in zip(values, (pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4), strict=True)],
            names=["block", "n", "width", "label", "bins", "hot", "margin"],
        )

    indices, values = parts_of("features")
    rows = train.select(F.col("label").cast("int").alias("label"), indices.alias("indices"), values.alias("values"), F.monotonically_increasing_id().alias("block"))
    return cut_lineage(rows.mapInArrow(pack, BLOCKS), compression="zstd")


@lru_cache(maxsize=2)
def binned(train: DataFrame, bins: int) -> tuple[Cells, DataFrame]:
    """Cells and blocks of training rows; models with as many bins share them."""
    cells = binning(train, bins)
    return cells, blocks(train, cells)


def per_task(rows: DataFrame, total: int) -> DataFrame:
    """As many tasks as cores, more once a task would hold more than ``TASK_ROWS`` rows."""
    return rows.coalesce(max(rows.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_ROWS)))


@dataclass
class StumpEnsemble:
    """Votes of all rounds per cell, their sum of sizes and each slot's part in it."""

    cells: Cells
    base: float = 0.0
    table: np.ndarray = None
    total: float = 0.0
    importance: list[float] = None
    splits: list[tuple[int, float, float, float]] = field(default_factory=list)

    def __post_init__(self):
        self.table = np.zeros(self.cells.count)
        self.importance = [0.0] * self.cells.size

    def votes(self, bins: np.ndarray, hot: np.ndarray) -> np.ndarray:
        """The sum of all votes on each row."""
        votes = np.full((hot if len(hot) else bins).shape[1], self.base)
        # slot -1, no slot, reads the last one
        of_hot = np.r_[self.table[: self.cells.size], 0.0]
        for line in hot:
            votes += of_hot.take(line, mode="wrap")
        for k, start in enumerate(self.cells.starts.values()):
            votes += self.table[start:].take(bins[k], mode="wrap")
        return votes

    def add(self, split: Split, vote: float) -> None:
        left, right = vote * split.left, vote * split.right
        if split.slot is None:
            self.base += left
        elif split.slot in self.cells.cuts:
            start, width = self.cells.starts[split.slot], len(self.cells.cuts[split.slot]) + 1
            self.table[start : start + split.bin + 1] += left
            self.table[start + split.bin + 1 : start + width] += right
        else:  # not set is the left side
            self.base += left
            self.table[split.slot] += right - left
        if split.slot is not None:
            cut = self.cells.cuts[split.slot][split.bin] if split.slot in self.cells.cuts else 0.0
            self.splits.append((split.slot, cut, left, right))
            self.importance[split.slot] += vote
        self.total += vote

    def transform(self, df: DataFrame) -> DataFrame:
        model = self

        @F.arrow_udf("double")
        def votes(indices: pa.Array, values: pa.Array) -> pa.Array:
            return pa.array(model.votes(*matrices(model.cells, indices, values)))

        share = (votes(*parts_of("features")) if self.table.any() else F.lit(self.base)) / F.lit(self.total or 1.0)
        keep = [F.col(c) for c in df.columns]
        voted = df.select(*keep, share.alias("_share"))
        return voted.select(
            *keep, (1 / (1 + F.exp(-F.col("_share")))).alias("score"), (F.col("_share") > 0).cast("double").alias("prediction")
        )


@dataclass(frozen=True)
class Split:
    """A slot and the last bin of its left side, both sides' votes (1 or -1), the share of weight voted wrong."""

    slot: int | None
    bin: int
    left: int
    right: int
    error: float


def side(off: float, on: float) -> int:
    return 1 if on > off else -1


def best_split(cells: Cells, weights: np.ndarray, whole: np.ndarray) -> Split:
    """The split with the least Gini impurity; the lower slot, then the lower cut on a tie.

    ``weights`` has a row per cell and a column per class, ``whole`` the sums over all rows.
    """

    def impurity(part: np.ndarray) -> np.ndarray:
        size = part.sum(axis=-1)
        return np.where(size > 0, 2 * part[..., 0] * part[..., 1] / np.where(size > 0, size, 1), 0.0)

    slack = 1e-12 * max(whole.sum(), 1e-300)
    slots, bins, lefts = [], [], []
    for slot in range(cells.size):
        if slot in cells.cuts:
            start = cells.starts[slot]
            sums = weights[start : start + len(cells.cuts[slot])].cumsum(axis=0)
            slots += [slot] * len(sums)
            bins += range(len(sums))
            lefts += list(sums)
        else:
            slots.append(slot)
            bins.append(0)
            lefts.append(whole - weights[slot])
    left = np.maximum(np.array(lefts).reshape(-1, 2), 0.0)
    right = np.maximum(whole - left, 0.0)
    real = (left.sum(axis=1) > slack) & (right.sum(axis=1) > slack)
    if not real.any():
        return Split(None, 0, side(*whole), side(*whole), float(whole.min() / (whole.sum() or 1.0)))
    loss = np.where(real, impurity(left) + impurity(right), np.inf)
    at = int(np.flatnonzero(loss <= loss.min() + slack)[0])
    wrong = left[at].min() + right[at].min()
    return Split(slots[at], bins[at], side(*left[at]), side(*right[at]), float(wrong / whole.sum()))


def class_weights_by_cell(rows: DataFrame, model: StumpEnsemble) -> tuple[np.ndarray, np.ndarray]:
    """Weight of both classes in every cell and over all rows, in one pass: a task adds up its blocks and sends a row per cell."""
    cells, count = model.cells, model.cells.count

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # every row also counts in one cell more, for the sums over all rows
        weights = np.zeros((count + 1, 2))
        for batch in batches:
            for r in batch.to_pylist():
                n = r["n"]
                bins, hot = np.frombuffer(r["bins"], np.uint8).reshape(-1, n), np.frombuffer(r["hot"], "<i4").reshape(r["width"], n)
                on = np.frombuffer(r["label"], np.uint8).astype(np.intp)
                votes = model.votes(bins, hot)
                w = np.exp(np.where(on, -votes, votes) / 2)
                # slot -1 is counted first
                for line in hot:
                    weights[: cells.size] += np.bincount((line + 1) * 2 + on, w, 2 * cells.size + 2).reshape(-1, 2)[1:]
                for k, (slot, start) in enumerate(cells.starts.items()):
                    size = len(cells.cuts[slot]) + 1
                    weights[start : start + size] += np.bincount(bins[k] * np.intp(2) + on, w, 2 * size).reshape(-1, 2)
                weights[count] += np.bincount(on, w, 2)
        some = np.flatnonzero(weights.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), *map(pa.array, weights[some].T)], names=["cell", "off", "on"])

    parts = rows.select("n", "width", "label", "bins", "hot").mapInArrow(sums, "cell bigint, off double, on double").groupBy("cell").agg(
        F.sum("off").alias("off"), F.sum("on").alias("on")
    )
    weights = np.zeros((count + 1, 2))
    for r in parts.collect():
        weights[r.cell] = r.off, r.on
    return weights[:-1], weights[-1]


def boost(train: DataFrame, rounds: int, step: float, bins: int) -> StumpEnsemble:
    """``rounds`` one-split trees on ``label`` (0 or 1) and ``features``; fewer once one errs never, or half of the time."""
    cells, rows = binned(train, bins)
    model = StumpEnsemble(cells)
    for _ in range(rounds):
        weights, whole = class_weights_by_cell(rows, model)
        if whole.sum() <= 0:
            break
        split = best_split(cells, weights, whole)
        if split.error >= 0.5:
            break
        model.add(split, step * math.log((1 - split.error) / max(split.error, 1e-12)))
        if split.error <= 0 or split.slot is None:
            break
    scale = model.total or 1.0
    model.importance = [v / scale for v in model.importance]
    return model

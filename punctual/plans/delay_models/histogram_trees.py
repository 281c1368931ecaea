"""Forests and boosted trees grown level by level from histograms over binned rows.

Rows become *cells* once (see :mod:`.boosted_stumps`): the bin of each numeric slot and the
slots of ones and zeros that are set, a few bytes a row where MLlib keeps a number for each of
the hundreds of slots. They are stored as blocks of rows in packed columns. A level of all
trees is one pass: a task adds up both statistics of its rows in the cells that the nodes may
split on, a row per tree goes to the shuffle, sums of all tasks meet there and choose the
splits; the driver sees the splits, which are the model. Which slots a node may split on and
how often a row counts in a tree come from seeds, so nothing but the trees is kept between
passes.

* ``grow_forest``: Gini impurity on class counts, a Poisson(1) weight per row and tree, the root of
  the number of slots tried per node.
* ``grow_boosted``: logistic loss on labels -1 and 1; the first tree takes the labels, later
  ones the loss's gradient, by squared error; a share of rows per tree and of slots per node.
  Margins are added to the blocks every ``REFRESH`` rounds, trees since then are walked.

A null label counts as 0, a value that is not a number as larger than every cut; an empty
table or one without a slot that varies gives trees of one leaf.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctual.plans.delay_models.boosted_stumps import BLOCKS, Cells, binned, blocks, matrices, parts_of, per_task  # noqa: F401
from punctual.session import cut_lineage

REFRESH, WHOLE = 10, 5
SUMS = "tree int, sums binary"
SPLITS = "tree int, slot binary, bin binary, gain binary, sides binary"


def taken(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``values[at]``, also of negative places, without numpy's slow check of each."""
    return values.take(at, mode="wrap")


@dataclass
class Tree:
    """Nodes in order of their levels: the slot and last left bin of a split, its left child (the right one follows) or itself."""

    slot: np.ndarray = field(default_factory=lambda: np.full(1, -1, np.int32))
    bin: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int32))
    left: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int32))
    value: np.ndarray = field(default_factory=lambda: np.zeros(1))
    frontier: int = 0  # first node of the last level
    steps: int = 0

    def leaves(self, cells: Cells, bins: np.ndarray, hot: np.ndarray, n: int, rows: np.ndarray | None = None) -> np.ndarray:
        """The node in which each row ends, or each of some rows."""
        column = np.full(cells.size + 1, -1, np.intp)
        column[list(cells.cuts)] = np.arange(len(cells.cuts))
        k = column[self.slot]
        node = self.first_levels(k, bins, hot, n)
        if rows is not None:
            node, hot = taken(node, rows), [taken(line, rows) for line in hot] if self.steps > WHOLE else ()
        node = node.astype(np.intp)
        if self.steps <= WHOLE:
            return node
        rows = np.arange(n) if rows is None else rows
        # no bin is above 255 and no row has slot -2: a leaf goes left, and is its own left child
        start, most = np.where(k >= 0, k * n, 0), np.where(k >= 0, self.bin, 255).astype(np.uint8)
        set_slot = np.where((k >= 0) | (self.slot < 0), -2, self.slot).astype(np.int32)
        left, flat, has_numeric = self.left.astype(np.intp), bins.reshape(-1), bool((k >= 0).any())
        for _ in range(self.steps - WHOLE):
            if has_numeric:
                at = taken(start, node)
                at += rows
                right = taken(flat, at) > taken(most, node)
            else:
                right = np.zeros(len(rows), bool)
            slot = taken(set_slot, node)
            for line in hot:
                right |= line == slot
            node = taken(left, node)
            node += right
        return node

    def first_levels(self, column: np.ndarray, bins: np.ndarray, hot: np.ndarray, n: int) -> np.ndarray:
        """Each row's node after at most ``WHOLE`` splits: a few whole-column comparisons a node are faster than a lookup a row."""
        # most lines hold the slots of one category: only those that may hold a slot are searched for it
        reach = [(int(line.min()), int(line.max())) for line in hot] if n else []

        def below(i: int, splits: int) -> np.ndarray | np.uint8:
            if self.slot[i] < 0 or not splits:
                return np.uint8(i)
            if column[i] >= 0:
                right = bins[column[i]] > np.uint8(self.bin[i])
            else:
                slot, right = int(self.slot[i]), np.zeros(n, bool)
                for line, (low, high) in zip(hot, reach, strict=False):
                    if low <= slot <= high:
                        right |= line == slot
            one, other = below(self.left[i], splits - 1), below(self.left[i] + 1, splits - 1)
            # numpy chooses slowly: bits of the other side where the mask is all ones
            return one ^ (np.negative(right.view(np.uint8)) & (one ^ other))

        return np.broadcast_to(below(0, WHOLE), n)

    def grow(self, slot: np.ndarray, cut: np.ndarray, values: np.ndarray) -> Tree:
        """Splits (slot -1: none) of the last level; ``values`` of both children of each."""
        at, n = np.flatnonzero(slot >= 0), len(self.slot)
        new_slot, new_bin, new_left = self.slot.copy(), self.bin.copy(), self.left.copy()
        nodes = self.frontier + at
        new_slot[nodes], new_bin[nodes] = slot[at], cut[at]
        new_left[nodes] = n + 2 * np.arange(len(at))
        more = 2 * len(at)
        return Tree(
            np.r_[new_slot, np.full(more, -1, np.int32)].astype(np.int32), np.r_[new_bin, np.zeros(more, np.int32)].astype(np.int32),
            np.r_[new_left, n + np.arange(more)].astype(np.int32), np.r_[self.value, values[at].reshape(-1)], n, self.steps + (more > 0),
        )


@dataclass(frozen=True)
class Kind:
    """What a tree adds up: ``statistics`` gives both numbers of a row, ``choose`` finds splits from sums; see below."""

    seed: int
    tried: int
    share: float | None  # of rows a tree is grown on; None: Poisson(1) weights
    least: int
    boosting: bool
    class_weight: tuple[float, float] = (1.0, 1.0)


POISSON = np.searchsorted(np.cumsum([math.exp(-1) / math.factorial(k) for k in range(9)])[:-1], np.arange(1 << 16) / (1 << 16), side="right").astype(np.uint8)


def row_weights(kind: Kind, tree: int, block: int, n: int) -> np.ndarray:
    drawn = np.random.Generator(np.random.PCG64([kind.seed, tree, block])).integers(0, 1 << 16, n, dtype=np.uint16)
    return POISSON[drawn] if kind.share is None else (drawn < kind.share * (1 << 16)).astype(np.uint8)


def chosen_slots(kind: Kind, cells: Cells, tree: Tree, number: int) -> np.ndarray:
    """Slots that each node of the last level may split on, drawn without replacement."""
    nodes = len(tree.slot) - tree.frontier
    draw = np.random.Generator(np.random.PCG64([kind.seed, number, tree.steps, 7]))
    slots = np.tile(np.arange(cells.size, dtype=np.int32), (nodes, 1))
    tried, rows = min(kind.tried, cells.size), np.arange(nodes)
    for k in range(tried if tried < cells.size else 0):
        other = draw.integers(k, cells.size, nodes)
        slots[rows, k], slots[rows, other] = slots[rows, other], slots[rows, k]
    return np.sort(slots[:, :tried], axis=1)


def layout(cells: Cells, chosen: np.ndarray) -> tuple[np.ndarray, int]:
    """First entry of each chosen slot (one per bin, one for a 0/1 slot) after one entry per node, and the number of entries."""
    width = np.ones(cells.size, np.int64)
    for slot, cuts in cells.cuts.items():
        width[slot] = len(cuts) + 1
    sizes = width[chosen].reshape(-1)
    return (len(chosen) + np.cumsum(sizes) - sizes).reshape(chosen.shape), len(chosen) + int(sizes.sum())


def level_sums(kind: Kind, cells: Cells, forest: list[tuple[int, Tree]], steps: list[tuple[float, Tree]]) -> Callable:
    """A task's sums: for each tree, both statistics of its last level's nodes and of the cells they may split on."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for r in batch.to_pylist():
                n = r["n"]
                bins = np.frombuffer(r["bins"], np.uint8).reshape(-1, n)
                hot = np.frombuffer(r["hot"], "<i4").reshape(r["width"], n)
                label = np.frombuffer(r["label"], np.uint8)
                target = None
                if kind.boosting:
                    margin = margins(cells, steps, bins, hot, np.frombuffer(r["margin"], "<f8"))
                    y = 2.0 * label - 1
                    target = 4 * y / (1 + np.exp(2 * y * margin)) if forest[0][0] else y
                held.append((r["block"], n, bins, hot, label, target))
        for number, tree in forest if held else ():
            chosen = chosen_slots(kind, cells, tree, number)
            add = few_slots(cells, chosen) if 4 * chosen.shape[1] < cells.size else many_slots(cells, chosen)
            sums = None
            for block, n, bins, hot, label, target in held:
                weight = row_weights(kind, number, block, n)
                rows = np.flatnonzero(weight)
                node = tree.leaves(cells, bins, hot, n, rows) - tree.frontier
                if tree.frontier and not (node >= 0).all():
                    some = np.flatnonzero(node >= 0)
                    node, rows = taken(node, some), taken(rows, some)
                if kind.boosting:
                    # a row of the share counts once
                    pair = (None, taken(target, rows))
                else:
                    weight = taken(weight, rows).astype(float)
                    late = weight * taken(label, rows)
                    pair = (weight - late, late)
                part = add(node, rows, bins, [taken(line, rows) for line in hot], pair)
                sums = part if sums is None else sums + part
            # counts are whole and small, and deflate well
            packed = sums.astype("<f8" if kind.boosting else "<u4").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([pa.compress(packed, "zstd", asbytes=True)], pa.binary())], names=["tree", "sums"])

    return work


def few_slots(cells: Cells, chosen: np.ndarray) -> Callable:
    """Sums of both statistics in the layout of the chosen slots, where a node may split on few: only rows in their cells are added."""
    first, size = layout(cells, chosen)
    nodes, width, numeric = len(chosen), cells.size + 1, list(cells.cuts)
    entry = np.full((nodes, width), -1, np.int32)  # the last column is for -1, no slot
    entry[np.arange(nodes)[:, None], chosen] = first
    of_numeric = np.ascontiguousarray(entry[:, numeric].T)
    entry[:, numeric] = -1
    entry[:, -1] = -1
    entry = entry.reshape(-1)
    is_chosen, any_numeric = entry >= 0, (of_numeric >= 0).any(axis=0)

    def add(node: np.ndarray, rows: np.ndarray, bins: np.ndarray, lines: list[np.ndarray], pair: tuple) -> np.ndarray:
        places, owners = [node], [None]
        begin = node * width
        # slot -1 is the column before a node's first, the last one of the node before
        for line in lines:
            key = begin + line
            some = np.flatnonzero(taken(is_chosen, key))
            places.append(taken(entry, taken(key, some)))
            owners.append(some)
        with_numeric = np.flatnonzero(taken(any_numeric, node))
        at_node, at_row = taken(node, with_numeric), taken(rows, with_numeric)
        for k in range(len(numeric)):
            at = taken(of_numeric[k], at_node)
            some = np.flatnonzero(at >= 0)
            places.append(taken(at, some) + taken(bins[k], taken(at_row, some)))
            owners.append(taken(with_numeric, some))
        place = np.concatenate(places)
        return np.stack([np.bincount(place, np.concatenate([p if o is None else taken(p, o) for o in owners]) if p is not None else None, size) for p in pair])

    return add


JOINT = 1024


def together(cells: Cells) -> list[list[tuple[int, int, int]]]:
    """Numeric slots (column, slot, bins) in groups of at most ``JOINT`` combinations of bins, which are counted in one go."""
    groups, combinations = [], JOINT + 1
    for column, (slot, cuts) in enumerate(cells.cuts.items()):
        if combinations * (len(cuts) + 1) > JOINT:
            groups, combinations = [*groups, []], 1
        groups[-1].append((column, slot, len(cuts) + 1))
        combinations *= len(cuts) + 1
    return groups


def many_slots(cells: Cells, chosen: np.ndarray) -> Callable:
    """The same where a node may split on many: all cells are added up, those of the chosen slots are read."""
    first, size = layout(cells, chosen)
    nodes, width, groups = len(chosen), cells.size + 1, together(cells)
    at_node = np.repeat(np.arange(nodes), chosen.shape[1])
    slots, entries = chosen.reshape(-1), first.reshape(-1)
    of_slot = {slot: np.flatnonzero(slots == slot) for slot in cells.cuts}

    def add(node: np.ndarray, rows: np.ndarray, bins: np.ndarray, lines: list[np.ndarray], pair: tuple) -> np.ndarray:
        sums = np.zeros((2, size))
        # slot -1 comes first
        begin, hot = node * width + 1, np.zeros((2, nodes * width))
        for line in lines:
            key = begin + line
            for s in range(2):
                hot[s] += np.bincount(key, pair[s], nodes * width)
        sums[:, entries] = hot[:, at_node * width + 1 + slots]
        for group in groups:
            key, shape = node, [nodes, *(bins_of for _, _, bins_of in group)]
            for column, _, bins_of in group:
                key = key * bins_of
                key += taken(bins[column], rows)
            tables = [np.bincount(key, p, math.prod(shape)).reshape(shape) for p in pair]
            for axis, (_, slot, bins_of) in enumerate(group, 1):
                others, mine = tuple(a for a in range(1, len(shape)) if a != axis), of_slot[slot]
                for s in range(2):
                    sums[s, entries[mine][:, None] + np.arange(bins_of)] = tables[s].sum(axis=others)[at_node[mine]]
        for s in range(2):
            sums[s, :nodes] = np.bincount(node, pair[s], nodes)
        return sums

    return add


def margins(cells: Cells, steps: list[tuple[float, Tree]], bins: np.ndarray, hot: np.ndarray, start: np.ndarray) -> np.ndarray:
    for weight, tree in steps:
        start = start + weight * taken(tree.value, tree.leaves(cells, bins, hot, len(start)))
    return start


def impurity(kind: Kind, pair: np.ndarray) -> np.ndarray:
    """Weight times impurity of sums over nodes, up to what both sides of a split share."""
    if kind.boosting:
        return -np.divide(pair[1] ** 2, pair[0], out=np.zeros_like(pair[0]), where=pair[0] > 0)
    weighted = pair * np.array(kind.class_weight).reshape(2, *[1] * (pair.ndim - 1))
    total = weighted.sum(axis=0)
    return np.divide(2 * weighted[0] * weighted[1], total, out=np.zeros_like(total), where=total > 0)


def choose(kind: Kind, cells: Cells, tree: Tree, number: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per node of the last level the split that gains most (the lower slot, then cut, on a tie): slot or -1, bin, gain, sums of both sides."""
    chosen = chosen_slots(kind, cells, tree, number)
    first, _ = layout(cells, chosen)
    nodes, rows = len(chosen), np.arange(len(chosen))
    whole = sums[:, :nodes]
    if not chosen.shape[1]:
        return np.full(nodes, -1, np.int32), np.zeros(nodes, np.int32), np.zeros(nodes), np.zeros((nodes, 2, 2))
    before = impurity(kind, whole)
    # rounding of sums is no gain
    slack = 1e-12 * np.maximum(np.abs(before), 1e-300)
    count = (lambda p: p[0]) if kind.boosting else (lambda p: p[0] + p[1])

    def gains(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        right = np.maximum(whole[:, at] - left, 0.0) if not kind.boosting else whole[:, at] - left
        fits = (count(left) >= kind.least) & (count(right) >= kind.least)
        return np.where(fits, before[at] - impurity(kind, left) - impurity(kind, right), -np.inf)

    def first_best(table: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.argmax(table >= (table.max(axis=1) - slack[at])[:, None], axis=1)

    # not set is the left side
    left = whole[:, :, None] - sums[:, first]
    gain = gains(rows[:, None], left)
    cut = np.zeros(chosen.shape, np.int32)
    for slot, cuts in cells.cuts.items():
        at, k = np.nonzero(chosen == slot)
        if not cuts:
            gain[at, k] = -np.inf
            continue
        if not len(at):
            continue
        sides = np.cumsum(sums[:, first[at, k][:, None] + np.arange(len(cuts))], axis=2)
        found = gains(at[:, None], sides)
        best = first_best(found, at)
        here = np.arange(len(at))
        gain[at, k], cut[at, k], left[:, at, k] = found[here, best], best, sides[:, here, best]
    best = first_best(gain, rows)
    most = gain[rows, best]
    splits = most > slack
    to_left = left[:, rows, best]
    sides = np.stack([to_left, whole - to_left]).transpose(2, 0, 1)
    return np.where(splits, chosen[rows, best], -1).astype(np.int32), cut[rows, best], np.where(splits, most, 0.0), sides


def merged(kind: Kind, cells: Cells, forest: list[tuple[int, Tree]]) -> Callable:
    trees = dict(forest)

    def work(part: pa.Table) -> pa.Table:
        number = part.column("tree")[0].as_py()
        _, size = layout(cells, chosen_slots(kind, cells, trees[number], number))
        form = np.dtype("<f8" if kind.boosting else "<u4")
        sums = np.zeros((2, size))
        for packed in part.column("sums"):
            sums += np.frombuffer(pa.decompress(packed.as_py(), 2 * size * form.itemsize, "zstd", asbytes=True), form).reshape(2, size)
        slot, cut, gain, sides = choose(kind, cells, trees[number], number, sums)
        values = [number, slot.astype("<i4").tobytes(), cut.astype("<i4").tobytes(), gain.astype("<f8").tobytes(),
                  np.concatenate([sums[:, : len(slot)].T.reshape(-1), sides.reshape(-1)]).astype("<f8").tobytes()]
        return pa.table([pa.array([v], t) for v, t in zip(values, (pa.int32(), *[pa.binary()] * 4), strict=True)], names=["tree", "slot", "bin", "gain", "sides"])

    return work


def next_level(rows: DataFrame, kind: Kind, cells: Cells, forest: list[tuple[int, Tree]], steps: list[tuple[float, Tree]]) -> dict:
    """Splits of the last level of every tree, from one pass over the rows."""
    sums = rows.mapInArrow(level_sums(kind, cells, forest, steps), SUMS)
    work = merged(kind, cells, forest)
    if len(forest) == 1:  # one small histogram a task
        got = sums.toArrow()
        found = work(got).to_pylist() if got.num_rows else []
    else:
        # a number of partitions of its own: deep levels are little data but much to search
        found = sums.repartition(rows.sparkSession.sparkContext.defaultParallelism, "tree").groupBy("tree").applyInArrow(work, SPLITS).toArrow().to_pylist()
    out = {}
    for r in found:
        slot, cut = (np.frombuffer(r[c], "<i4") for c in ("slot", "bin"))
        numbers = np.frombuffer(r["sides"], "<f8")
        out[r["tree"]] = slot, cut, np.frombuffer(r["gain"], "<f8"), numbers[: 2 * len(slot)].reshape(-1, 2), numbers[2 * len(slot) :].reshape(-1, 2, 2)
    return out


def grown(rows: DataFrame, kind: Kind, cells: Cells, numbers: list[int], depth: int, steps: list[tuple[float, Tree]]) -> tuple[list[Tree], np.ndarray]:
    """Trees of at most ``depth`` splits to a leaf, and the gains of their slots."""
    trees, gains = {i: Tree() for i in numbers}, np.zeros((len(numbers), cells.size))

    def value(pair: np.ndarray) -> np.ndarray:
        if kind.boosting:
            return np.divide(pair[..., 1], pair[..., 0], out=np.zeros(pair.shape[:-1]), where=pair[..., 0] > 0)
        weighted = pair * np.array(kind.class_weight)
        total = weighted.sum(axis=-1)
        return np.divide(weighted[..., 1], total, out=np.zeros_like(total), where=total > 0)

    open_trees = list(numbers)
    for level in range(depth):
        found = next_level(rows, kind, cells, [(i, trees[i]) for i in open_trees], steps)
        for i, (slot, cut, gain, whole, sides) in found.items():
            if level == 0:
                trees[i].value = value(whole)
            some = slot >= 0
            np.add.at(gains[numbers.index(i)], slot[some], gain[some])
            trees[i] = trees[i].grow(slot, cut, value(sides))
        open_trees = [i for i in open_trees if i in found and (found[i][0] >= 0).any()]
        if not open_trees:
            break
    return [trees[i] for i in numbers], gains


@dataclass
class TreeEnsemble:
    """Weighted trees; the score is their mean share of delays, or the logistic of twice the margin."""

    cells: Cells
    weights: list[float]
    trees: list[Tree]
    importance: list[float]
    boosting: bool

    def transform(self, df: DataFrame) -> DataFrame:
        cells, steps, boosting = self.cells, list(zip(self.weights, self.trees, strict=True)), self.boosting

        @F.arrow_udf("double")
        def score(indices: pa.Array, values: pa.Array) -> pa.Array:
            total = margins(cells, steps, *matrices(cells, indices, values), np.zeros(len(values)))
            return pa.array(1 / (1 + np.exp(-2 * total)) if boosting else total)

        out = df.withColumn("score", score(*parts_of("features")))
        return out.withColumn("prediction", (F.col("score") > 0.5).cast("double"))


def shares(gains: np.ndarray) -> np.ndarray:
    total = gains.sum()
    return gains / total if total > 0 else gains


def class_counts(rows: DataFrame) -> np.ndarray:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ones = [int(np.frombuffer(b.as_py(), np.uint8).sum()) for b in batch.column("label")]
            yield pa.RecordBatch.from_arrays([batch.column("n").cast(pa.int64()), pa.array(ones, pa.int64())], names=["n", "late"])

    n, late = rows.select("n", "label").mapInArrow(work, "n bigint, late bigint").agg(F.sum("n"), F.sum("late")).first()
    return np.array([(n or 0) - (late or 0), late or 0], float)


def grow_forest(train: DataFrame, trees: int, depth: int, least: int, bins: int, seed: int) -> TreeEnsemble:
    """``trees`` trees on resampled rows; both classes weigh the same in total."""
    cells, rows = binned(train, bins)
    counts = class_counts(rows)
    some = counts > 0
    weight = np.divide(counts.sum(), some.sum() * counts, out=np.ones(2), where=some)
    kind = Kind(seed, math.ceil(math.sqrt(cells.size)), None, least, False, tuple(weight.tolist()))
    found, gains = grown(per_task(rows, int(counts.sum())), kind, cells, list(range(trees)), depth, [])
    importance = shares(sum((shares(g) for g in gains), np.zeros(cells.size)))
    return TreeEnsemble(cells, [1.0 / trees] * trees, found, importance.tolist(), False)


def grow_boosted(train: DataFrame, rounds: int, depth: int, step: float, share: float, bins: int, seed: int) -> TreeEnsemble:
    """``rounds`` regression trees on the gradient of the logistic loss; ``share`` of the rows a tree and of the slots a node."""
    cells, rows = binned(train, bins)
    total = int(class_counts(rows).sum())
    kind = Kind(seed, math.ceil(share * cells.size), share, 1, True)
    weights, trees, gains, since = [], [], np.zeros(cells.size), 0
    for i in range(rounds):
        if i - since == REFRESH:
            rows, since = with_margins(rows, cells, list(zip(weights, trees, strict=True))[since:]), i
        (tree,), gain = grown(per_task(rows, total), kind, cells, [i], depth, list(zip(weights, trees, strict=True))[since:])
        weights.append(step if i else 1.0)
        trees.append(tree)
        gains += gain[0]
    return TreeEnsemble(cells, weights, trees, shares(gains).tolist(), True)


def with_margins(rows: DataFrame, cells: Cells, steps: list[tuple[float, Tree]]) -> DataFrame:
    """The blocks with the trees' values added to their margins, written once more."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                bins, hot = np.frombuffer(r["bins"], np.uint8).reshape(-1, r["n"]), np.frombuffer(r["hot"], "<i4").reshape(r["width"], r["n"])
                out.append(margins(cells, steps, bins, hot, np.frombuffer(r["margin"], "<f8")).astype("<f8").tobytes())
            yield batch.set_column(batch.schema.get_field_index("margin"), "margin", pa.array(out, pa.binary()))

    return cut_lineage(rows.mapInArrow(add, BLOCKS), compression="zstd")

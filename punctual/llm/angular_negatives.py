"""Hard negatives of query rows, with scores bounded by angles to reference directions.

Components become whole numbers, floor(256 x), and a score is the exact inner product of
two rows. Each row is stored with its norm and its angles to a few reference directions
(rows with the least hashes). For an anchor at angle a and a row at angle b to the same
direction, the angle between them lies between |a - b| and min(a + b, 2 pi - a - b); over
all directions that gives an interval of cosines, and times both norms an interval of
scores, widened by more than all rounding can do.

Two passes compare blocks of anchors with blocks of rows, each pair of blocks once. The
first looks for an anchor's positives, its best rows of the same label: only blocks of that
label meet, and a row is scored only if its upper bound reaches the least of the best lower
bounds or of the best scores so far. The second looks, among the other labels, for rows in
the score window of each positive: a row is scored only if its interval overlaps a window.
Row blocks are dealt to lanes and anchor blocks are copied to each lane, so the work spreads
over lanes however large a label is; of a block pair only the best few rows per anchor (and
positive) go on, and a ranked window keeps the first of them.

Rows with a null id, a null label, a null vector, or a null or non-finite component take no
part, nor do rows whose squared norm reaches 2^62, as their scores would not fit a long. Of
several rows with one id the least by label, then vector counts. Shorter vectors are filled
up with zeros; an empty or zero vector scores 0 with everything. Equal scores are ordered
by id. An anchor without rows of its label, or without a row in a window, gives no row; an
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from punctual.session import cut_lineage

SCALE = 256
#: Reference directions, rows and anchors of a block, lanes (at least, and blocks of a lane beyond).
DIRECTIONS, ROWS, ANCHORS, LANES, LANE_BLOCKS = 12, 1024, 256, 64, 16
#: Angles are stored in 32 bits; bounds are widened by this angle (far above their rounding), a share of the norms and a constant.
ANGLE_SLACK, SHARE_SLACK, SLACK = 1e-5, 1e-9, 1.0
POSITIVES, NEGATIVES = 5, 3
NONE = np.iinfo(np.int64).min


def whole_numbers(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, v): one row per id of the rows that take part."""
    x = F.col(f"`{vector_col}`")
    number = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))
    rows = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{label_col}`").cast("bigint").alias("label"), x.alias("x"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull()).where(F.coalesce(F.forall("x", number), F.lit(False)))
    scaled = F.transform("x", lambda c: F.floor(c.cast("double") * SCALE))
    size = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    some = rows.select("id", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"), scaled.alias("v")).where(size < 2.0**62)
    return some.groupBy("id").agg(F.min(F.struct("label", "v")).alias("_row")).select("id", "_row.label", "_row.v")


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Vectors of different lengths as rows of one matrix."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(vectors), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = vectors.flatten().to_numpy()
    return out


def angles(m: np.ndarray, norms: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Angles of rows to unit directions; a zero row counts as perpendicular."""
    cosines = m.astype(np.float64) @ directions.T / np.where(norms > 0, norms, 1.0)[:, None]
    return np.arccos(np.clip(cosines, -1.0, 1.0)).astype(np.float32)


DESCRIBED = "id bigint, label bigint, part int, norm double, angles binary, v binary"


def described(rows: DataFrame, width: int, directions: np.ndarray) -> DataFrame:
    """Rows with norm, angles and the direction they are nearest to; numbers as bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = matrix(batch.column(2), width)
            norms = np.sqrt((m.astype(np.float64) ** 2).sum(axis=1))
            to = angles(m, norms, directions)
            near = to.argmin(axis=1) if to.shape[1] else np.zeros(len(m))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(near.astype(np.int32)), pa.array(norms), pa.array([a.tobytes() for a in to], pa.binary()), pa.array([x.tobytes() for x in m], pa.binary())],
                names=["id", "label", "part", "norm", "angles", "v"],
            )

    return rows.mapInArrow(work, DESCRIBED)


BLOCK = "label bigint, part int, salt int, n int, ids binary, norms binary, angles binary, vs binary, wants binary"


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows of a label and nearest direction in blocks of about ``size``, ordered by id; ``wants`` carries numbers per row."""
    counts = rows.groupBy("label", "part").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("_salts"))
    salted = rows.join(counts, ["label", "part"]).withColumn("salt", F.pmod(F.xxhash64("id"), "_salts").cast("int")).drop("_salts")

    def gather(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        join = lambda name: b"".join(group.column(name).to_pylist())
        number = lambda name: group.column(name).to_numpy().tobytes()
        wants = join("wants") if "wants" in group.column_names else b""
        key = [group.column(c)[:1].combine_chunks() for c in ("label", "part", "salt")]
        return pa.table([*key, pa.array([group.num_rows], pa.int32()), *(pa.array([x], pa.binary()) for x in (number("id"), number("norm"), join("angles"), join("v"), wants))], names=BLOCK_NAMES)

    return cut_lineage(salted.groupBy("label", "part", "salt").applyInArrow(gather, BLOCK))


BLOCK_NAMES = ["label", "part", "salt", "n", "ids", "norms", "angles", "vs", "wants"]


@dataclass
class Block:
    ids: np.ndarray
    norms: np.ndarray
    angles: np.ndarray
    rows: np.ndarray
    wants: np.ndarray

    @classmethod
    def read(cls, cell: dict, side: str) -> Block:
        get = lambda name, kind: np.frombuffer(cell[f"{side}_{name}"], kind)
        n = cell[f"{side}_n"]
        return cls(get("ids", "<i8"), get("norms", "<f8"), get("angles", "<f4").reshape(n, -1), get("vs", "<i8").reshape(n, -1), get("wants", "<i8").reshape(n, -1) if cell[f"{side}_wants"] else np.zeros((n, 0), np.int64))


def score_bounds(a: Block, b: Block) -> tuple[np.ndarray, np.ndarray]:
    """What the score of each anchor with each row is at least and at most."""
    apart = np.zeros((len(a.ids), len(b.ids)), np.float32)
    reach = np.full(apart.shape, np.pi, np.float32)
    for j in range(a.angles.shape[1]):
        x, y = a.angles[:, j, None], b.angles[None, :, j]
        np.maximum(apart, np.abs(x - y), out=apart)
        both = x + y
        np.minimum(reach, np.minimum(both, np.float32(2 * np.pi) - both), out=reach)
    norms = a.norms[:, None] * b.norms[None, :]
    slack = SLACK + SHARE_SLACK * norms
    low = norms * np.cos(np.minimum(reach.astype(np.float64) + ANGLE_SLACK, np.pi)) - slack
    return low, norms * np.cos(np.maximum(apart.astype(np.float64) - ANGLE_SLACK, 0.0)) + slack


def scores(a: Block, b: Block, columns: np.ndarray) -> np.ndarray:
    """Exact inner products of all anchors with some rows."""
    x, y = a.rows, b.rows[columns]
    if len(x) and len(y) and a.norms.max() * b.norms.max() < 2.0**52:
        # every partial sum is a whole number below 2^53, so floating point is exact
        return (x.astype(np.float64) @ y.T.astype(np.float64)).astype(np.int64)
    return x @ y.T


def first_of(anchor: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of each anchor's first ``k`` by score descending, then id."""
    order = np.lexsort((ids, -score, anchor))
    begins = np.r_[True, anchor[order][1:] != anchor[order][:-1]]
    nr = np.arange(len(order)) - np.maximum.accumulate(np.where(begins, np.arange(len(order)), 0))
    return order[nr < k]


def keep_best(best: np.ndarray, anchor: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Best scores per anchor (ascending) with further ones."""
    k = best.shape[1]
    rows = np.r_[np.repeat(np.arange(len(best)), k), anchor]
    values = np.r_[best.ravel(), score]
    at = first_of(rows, np.maximum(values, NONE + 1), np.zeros(len(rows), np.int64), k)
    return values[at].reshape(len(best), k)[:, ::-1]


def compare(pairs: DataFrame, schema: str, one: Callable[[Block, Block, dict], dict[str, np.ndarray]]) -> DataFrame:
    """Run ``one(anchors, rows, memory of these anchors)`` for each pair of blocks; it returns columns."""
    names = [c.split()[0] for c in schema.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[tuple, dict] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                cell = {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}
                a, b = Block.read(cell, "a"), Block.read(cell, "b")
                key = tuple(cell[f"a_{c}"] for c in ("label", "part", "salt"))
                got = one(a, b, memory.setdefault(key, {}))
                yield pa.RecordBatch.from_arrays([pa.array(got[c], pa.int64()) for c in names], names=names)

    return pairs.mapInArrow(work, schema)


def paired(anchors: DataFrame, rows: DataFrame, lanes: int, same_label: bool) -> DataFrame:
    """Each anchor block beside each row block of its label, or of the other labels.

    Both sides are shuffled: a plan's estimate knows nothing of the copies, so they would be broadcast through the driver.
    """
    side = lambda df, s: df.select(*[F.col(c).alias(f"{s}_{c}") for c in df.columns])
    a = side(anchors, "a").withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    b = side(rows, "b").withColumn("lane", F.pmod(F.xxhash64("b_label", "b_part", "b_salt"), F.lit(lanes)).cast("int"))
    label = F.col("a_label") == F.col("b_label") if same_label else F.col("a_label") != F.col("b_label")
    return a.alias("l").join(b.alias("r").hint("merge"), (F.col("l.lane") == F.col("r.lane")) & label).drop("lane", "b_wants", "b_part", "b_salt").withColumn("b_wants", F.lit(b"").cast("binary"))


def best_rows(a: Block, b: Block, memory: dict) -> dict[str, np.ndarray]:
    """The rows of a block that may be among an anchor's positives."""
    best = memory.get("best")
    if best is None:
        best = np.full((len(a.ids), POSITIVES), NONE)
    low, high = score_bounds(a, b)
    own = a.ids[:, None] == b.ids[None, :]
    low[own], high[own] = -np.inf, -np.inf
    least = best[:, 0].astype(np.float64)
    if len(b.ids) > POSITIVES:
        # so many rows of this block score at least that much
        least = np.maximum(least, np.partition(low, len(b.ids) - POSITIVES, axis=1)[:, len(b.ids) - POSITIVES])
    wanted = (high >= least[:, None]) & ~own
    columns = np.flatnonzero(wanted.any(axis=0))
    exact = scores(a, b, columns)
    anchor, column = np.nonzero(wanted[:, columns] & (exact >= best[:, :1]))
    score, ids = exact[anchor, column], b.ids[columns[column]]
    at = first_of(anchor, score, ids, POSITIVES)
    memory["best"] = keep_best(best, anchor[at], score[at])
    return {"anchor_id": a.ids[anchor[at]], "positive_id": ids[at], "positive_score": score[at]}


def rows_in_windows(a: Block, b: Block, memory: dict) -> dict[str, np.ndarray]:
    """The rows of a block that may be among the negatives of an anchor's positives (``wants``: ids, then scores)."""
    ids, score = a.wants[:, :POSITIVES], a.wants[:, POSITIVES:]
    there = ids != NONE
    # p <= 2 n and 100 n <= 95 p, without products that could overflow
    lowest, highest = -(-score // 2), score // 20 * 19 + score % 20 * 19 // 20
    there &= lowest <= highest
    low, high = score_bounds(a, b)
    wanted = np.zeros(low.shape, bool)
    for k in range(POSITIVES):
        wanted |= there[:, k, None] & (high >= lowest[:, k, None]) & (low <= highest[:, k, None])
    columns = np.flatnonzero(wanted.any(axis=0))
    exact = scores(a, b, columns)
    wanted = wanted[:, columns]
    out = {c: [np.zeros(0, np.int64)] for c in ("anchor_id", "positive_id", "negative_id", "positive_score", "negative_score")}
    for k in range(POSITIVES):
        best = memory.get(k)
        if best is None:
            best = np.full((len(a.ids), NEGATIVES), NONE)
        hit = wanted & there[:, k, None] & (exact >= np.maximum(lowest[:, k], best[:, 0])[:, None]) & (exact <= highest[:, k, None])
        anchor, column = np.nonzero(hit)
        value, names = exact[anchor, column], b.ids[columns[column]]
        at = first_of(anchor, value, names, NEGATIVES)
        memory[k] = keep_best(best, anchor[at], value[at])
        for c, x in (("anchor_id", a.ids[anchor[at]]), ("positive_id", ids[anchor[at], k]), ("negative_id", names[at]), ("positive_score", score[anchor[at], k]), ("negative_score", value[at])):
            out[c].append(x)
    return {c: np.concatenate(x) for c, x in out.items()}


def mine(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", every: int = 50) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of the anchors, rows whose id is divisible by ``every``."""
    rows = cut_lineage(whole_numbers(vectors, id_col, vector_col, label_col))
    width = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0]
    # so many rows at most reach the driver
    chosen = [r["v"] for r in rows.orderBy(F.xxhash64("id", "v"), "id").limit(DIRECTIONS).collect()]
    directions = np.array([x + [0] * (width - len(x)) for x in chosen], np.float64).reshape(len(chosen), width)
    lengths = np.sqrt((directions**2).sum(axis=1))
    directions = directions[lengths > 0] / lengths[lengths > 0, None]
    stored = cut_lineage(described(rows, width, directions))
    row_blocks = blocks(stored, ROWS)
    lanes = max(LANES, -(-row_blocks.count() // LANE_BLOCKS))
    anchors = stored.where(F.col("id") % every == 0)
    together = paired(blocks(anchors, ANCHORS), row_blocks, lanes, True)
    found = compare(together, "anchor_id bigint, positive_id bigint, positive_score bigint", best_rows)
    by_anchor = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    positives = found.withColumn("rank", F.row_number().over(by_anchor)).where(F.col("rank") <= POSITIVES)
    # at most POSITIVES rows of an anchor
    wants = positives.groupBy(F.col("anchor_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("rank", "positive_id", "positive_score"))).alias("_p"))
    padded = lambda name: F.transform(F.sequence(F.lit(0), F.lit(POSITIVES - 1)), lambda i: F.coalesce(F.get(F.col("_p"), i)[name], F.lit(int(NONE))))
    anchors = with_numbers(anchors.join(wants.select("id", F.concat(padded("positive_id"), padded("positive_score")).alias("_wants")), "id"))
    found = compare(paired(blocks(anchors, ANCHORS), row_blocks, lanes, False), "anchor_id bigint, positive_id bigint, negative_id bigint, positive_score bigint, negative_score bigint", rows_in_windows)
    by_positive = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(by_positive)).where(F.col("rank") <= NEGATIVES)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def with_numbers(anchors: DataFrame) -> DataFrame:
    """``_wants`` as bytes in ``wants``."""
    schema = f"{DESCRIBED}, wants binary"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [np.array(x, np.int64).tobytes() for x in batch.column(6).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(cells, pa.binary())], names=[*batch.schema.names[:6], "wants"])

    return anchors.select("id", "label", "part", "norm", "angles", "v", "_wants").mapInArrow(work, schema)

"""N-gram Jaccard join: PartEnum signatures, exact links, connected components.

A document's set holds the hashes of its distinct word n-grams. Sets of one size band
that link differ in at most k elements; the element domain is split by hash into
partitions, and the contents of subsets of partitions are signatures: k differences leave
enough partitions untouched that linked sets share a signature. There are some partitions
more than a set of its size needs, so each set leaves out its emptiest ones. A set also
takes part in the next bands if it is large enough to link there. Signatures are made
twice instead of stored: once to count them, once to keep those that occur again.

Equal sets are folded into their least id first. In each bucket (sets with one signature)
every set is compared with the bucket's least id, and a link is decided exactly. Then
components are computed; only buckets that still hold more than one component compare
their sets further, across components, round by round: the least sets not yet compared
against all others, ``SPREAD`` times as many in each round, until nothing is left to compare. A pair
that meets in many buckets is left to the least of them, as far as the ``FIRST`` signatures of both tell. No
bucket is gathered in one task and pairs within a component are never formed (nor those whose
parities differ too often), yet no link
between components is missed.

Sets are compared by 64-bit hashes of their n-grams. A null or blank text has an empty
set, links with nothing and is its own component; with fewer words than n the whole
sequence is the only element. Rows that share an id are in one component, linked through any of their
texts; a row with a null id keeps a null component. Other columns are not touched; an empty table gives an empty
result.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctual.llm.words import map_batches, mix, pieces, runs, split
from punctual.session import cut_lineage

BAND, PARITY, SPREAD, FIRST = 1.3, 8, 16, 8
U64 = np.uint64


def differences(size: int, percent: int) -> int:
    """The most elements in which two linked sets of at most this size differ."""
    return (100 - percent) * 2 * size // (100 + percent)


def plan(k: int) -> tuple[int, int, int]:
    """(partitions, chosen, slack): a signature is the content of ``chosen`` partitions, and ``slack`` more of them than one are clean.

    For few differences pairs of partitions are enumerated, otherwise single ones."""
    if k == 0:
        return 1, 1, 0
    if k <= 3:
        return k + 2, 2, 0
    slack = 2 + k // 8
    return k + 1 + slack, 1, slack


def band_of(sizes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.searchsorted(bounds, sizes, "left")


def band_bounds(most: int) -> np.ndarray:
    """The largest size of each band: every size up to 3 alone, then wider by ``BAND``."""
    out = [1, 2, 3]
    while out[-1] < most:
        out.append(max(out[-1] + 1, int(out[-1] * BAND)))
    return np.array(out)


def ngram_sets(data: np.ndarray, edges: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Element hashes of all texts, sorted within each text, and where each text's begin."""
    w = split(data, edges)
    h, counts = w.hashes(lower=True), w.counts
    size = np.repeat(counts, counts)
    place = np.arange(len(h)) - np.repeat(w.first[:-1], counts)
    keys = np.zeros(len(h), U64)
    for j in range(n):
        ahead = np.zeros_like(h)
        ahead[: max(0, len(h) - j)] = h[j:]
        keys = np.where(place + j < size, mix(keys * U64(31) + ahead, j + 1), keys)
    real = place <= np.maximum(size - n, 0)
    owner, keys = w.owner()[real], keys[real]
    first = np.searchsorted(owner, np.arange(w.texts + 1))
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        keys[lo:hi].sort()
    new = np.r_[True, (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])] if len(keys) else np.zeros(0, bool)
    return keys[new], np.searchsorted(owner[new], np.arange(w.texts + 1))


def signatures(keys: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """PartEnum signatures of many sets (laid end to end), set by set, and how many each has."""
    bounds = band_bounds(int(sizes.max(initial=1)) * 200 // percent + 8)
    band = band_of(sizes, bounds)
    owners, out = [], []
    begins = np.cumsum(sizes) - sizes
    joins, ahead = sizes > 0, 0
    while joins.any():
        for b in np.unique(band[joins]):
            rows = np.flatnonzero(joins & (band == b))
            at = b + ahead
            k = differences(int(bounds[at]), percent)
            partitions, chosen, slack = plan(k)
            size = sizes[rows]
            elements = keys[np.repeat(begins[rows] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            cell = ((mix(elements, 101) >> U64(11)) % U64(partitions)).astype(np.int64)
            flat = np.repeat(np.arange(len(rows)) * partitions, size) + cell
            # a partition's content: sum of mixed elements, which does not depend on their order
            content = np.zeros(len(rows) * partitions, U64)
            order = np.argsort(flat, kind="stable")
            firsts = runs(flat[order])
            if len(firsts):
                content[flat[order][firsts]] = np.add.reduceat(mix(elements, 202)[order], firsts)
            content = content.reshape(len(rows), partitions)
            filled = np.bincount(flat, minlength=content.size).reshape(content.shape)
            # a set differs from those it links with in at most ``most`` elements, so all but that many partitions are
            # equal. The last of the equal ones by (elements, content, number) has ``spare`` of them before it, in both
            # sets; so it is offered in both if each leaves out no more than its first ``spare``
            most = (100 - percent) * (size + np.minimum(bounds[at], 100 * size // percent)) // (100 + percent)
            spare = partitions - 1 - most
            place = np.empty(content.shape, np.int64)
            np.put_along_axis(place, np.lexsort((content, filled), axis=-1), np.arange(partitions)[None, :], 1)
            offered = place >= spare[:, None]
            for number, subset in enumerate(combinations(range(partitions), chosen)) if chosen > 1 else [(0, None)]:
                s = np.full(content.shape if subset is None else len(rows), (int(at) << 8) + number + 1, U64)
                if subset is None:
                    s = mix(s * U64(0x9E3779B97F4A7C15) + content, 7) + np.arange(partitions, dtype=U64)
                    out.append(mix(s, 9)[offered])
                    owners.append(np.repeat(rows, partitions).reshape(content.shape)[offered])
                    continue
                for c in subset:
                    s = mix(s * U64(0x9E3779B97F4A7C15) + content[:, c], 7)
                out.append(mix(s, 9))
                owners.append(rows)
        # in later bands only sets that can link with the smallest there
        joins = joins & (100 * sizes >= percent * (bounds[band + ahead] + 1))
        ahead += 1
    owner, sig = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (owners, out))
    order = np.argsort(owner, kind="stable")
    return sig[order], np.bincount(owner, minlength=len(sizes))


def lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(values.view(np.int64)))


def shaped(docs: DataFrame, n: int) -> DataFrame:
    """Per row its id, set size, a 128-bit key of the set, and for each of 64 * PARITY groups of elements whether an odd number is there."""

    def columns(batch: pa.RecordBatch) -> dict:
        sizes, keys, parity = [np.zeros(0, np.int64)], [np.zeros((2, 0), U64)], [np.zeros((0, PARITY), np.int64)]
        for _, _, data, edges in pieces(batch.column(1)):
            elements, first = ngram_sets(data, edges, n)
            size = np.diff(first)
            some = size > 0
            key = np.zeros((2, len(size)), U64)
            if len(elements):
                for i, salt in enumerate((11, 12)):
                    key[i, some] = np.add.reduceat(mix(elements, salt), first[:-1][some])
            odd = np.bincount(np.repeat(np.arange(len(size)), size) * 64 * PARITY + ((mix(elements, 13) >> U64(33)) % U64(64 * PARITY)).astype(np.int64), minlength=len(size) * 64 * PARITY) & 1
            parity.append(np.packbits(odd.astype(bool)).view(np.int64).reshape(-1, PARITY))
            sizes.append(size)
            keys.append(key)
        key, odd = np.concatenate(keys, 1).view(np.int64), np.concatenate(parity)
        return {"id": batch.column(0), "size": np.concatenate(sizes).astype(np.int64), "k1": key[0], "k2": key[1], **{f"p{i}": np.ascontiguousarray(odd[:, i]) for i in range(PARITY)}}

    return map_batches(docs.select("id", "text"), "id bigint, size bigint, k1 bigint, k2 bigint, " + ", ".join(f"p{i} bigint" for i in range(PARITY)), columns)


def signed(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(rep, sig): the signatures of each row's set."""

    def columns(batch: pa.RecordBatch) -> dict:
        sigs, counts = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
        for _, _, data, edges in pieces(batch.column(1)):
            elements, first = ngram_sets(data, edges, n)
            s, c = signatures(elements, np.diff(first), percent)
            sigs.append(s)
            counts.append(c)
        return {"rep": batch.column(0), "sigs": lists(np.concatenate(sigs), np.concatenate(counts))}

    return map_batches(docs.select("id", "text"), "rep bigint, sigs array<bigint>", columns).select("rep", F.explode("sigs").alias("sig"))


def sets_of(docs: DataFrame, n: int) -> DataFrame:
    """Per row its id and its set as a sorted array."""

    def columns(batch: pa.RecordBatch) -> dict:
        parts = [ngram_sets(data, edges, n) for _, _, data, edges in pieces(batch.column(1))] or [(np.zeros(0, U64), np.zeros(1, np.int64))]
        return {"id": batch.column(0), "elements": lists(np.concatenate([p[0] for p in parts]), np.concatenate([np.diff(p[1]) for p in parts]))}

    return map_batches(docs.select("id", "text"), "id bigint, elements array<bigint>", columns)


def least_labels(edges: DataFrame) -> DataFrame:
    """(id, component) of every id on an edge, the component being its least id, by alternating large and small stars."""

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        # every neighbour above (large) or below (small) is hung on the least one
        hung = both.where("b > a") if large else both
        out = hung.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return (out if large else out.unionByName(least.select("a", F.col("m").alias("b")))).where("a <> b").distinct()

    now, before = cut_lineage(edges.select("a", "b").where("a <> b").distinct()), None
    while True:
        now = cut_lineage(star(star(now, True), False))
        state = tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())
        if state == before:
            break
        before = state
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) pairs whose sets link, decided exactly."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("elements").alias("_x")), "a").join(sets.select(F.col("id").alias("b"), F.col("elements").alias("_y")), "b")
    common = F.size(F.array_intersect("_x", "_y"))
    return both.where(100 * common >= percent * (F.size("_x") + F.size("_y") - common)).select("a", "b")


def alike(x: str, y: str, percent: int) -> Column:
    """Sizes and parities that allow a link: each element in which two sets differ changes one parity."""
    flips = sum((F.bit_count(F.col(f"{x}.p{i}").bitwiseXOR(F.col(f"{y}.p{i}"))) for i in range(PARITY)), F.lit(0))
    a, b = F.col(f"{x}.size"), F.col(f"{y}.size")
    return (100 * F.least(a, b) >= percent * F.greatest(a, b)) & ((100 + percent) * flips <= (100 - percent) * (a + b))


def least_shared(sig: Column) -> Column:
    """No lesser signature is among the first ones of both sets: in the bucket of the least such, the pair is compared or ends in one component."""
    return F.coalesce(F.array_min(F.array_intersect("x.firsts", "y.firsts")), sig) >= sig


def met(rows: DataFrame, asked: int, percent: int) -> DataFrame:
    """Pairs of a bucket to compare: its sets numbered ``asked`` and up, below ``SPREAD`` times that, with all after them."""
    asking = rows.where(f"nr < {SPREAD * asked}").select("sig", F.col("rep").alias("a"), F.col("shape").alias("x"), F.col("component").alias("_ca"), F.col("nr").alias("_na"))
    answering = rows.select("sig", F.col("rep").alias("b"), F.col("shape").alias("y"), F.col("component").alias("_cb"), "nr")
    apart = (asking["sig"] == answering["sig"]) & (F.col("nr") > F.col("_na")) & (F.col("_ca") != F.col("_cb"))
    return asking.join(answering, apart & alike("x", "y", percent) & least_shared(asking["sig"]))


def components(docs: DataFrame, n: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row its id, set size and component: the least id reachable by links, its own included."""
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    rows = cut_lineage(shaped(texts, n))
    known = rows.where("id is not null and size > 0")
    # equal sets are one node from here on, named by its least id
    least = known.groupBy("size", "k1", "k2").agg(F.min("id").alias("rep"))
    copies = cut_lineage(known.select("id").join(least.select(F.col("rep").alias("id")), "id", "left_anti").distinct())
    signs = signed(texts.where("id is not null").join(copies, "id", "left_anti"), n, percent)
    # counts travel without ids; only signatures that occur again are joined with theirs
    again = signs.groupBy("sig").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("sig")
    shared = cut_lineage(signs.join(again, "sig", "left_semi"))
    hubs = shared.groupBy("sig").agg(F.min("rep").alias("hub"), F.max("rep").alias("_hi")).where("hub < _hi").drop("_hi")
    buckets = cut_lineage(shared.join(hubs, "sig").distinct())
    wanted = buckets.select(F.col("rep").alias("id")).distinct()
    sets = cut_lineage(sets_of(texts.join(wanted, "id", "left_semi"), n).dropDuplicates())
    stars = buckets.where("hub <> rep").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    twins = known.select("id", "size", "k1", "k2").join(least, ["size", "k1", "k2"]).where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b")).distinct()
    labels = least_labels(links(stars, sets, percent).unionByName(twins))
    asked = 1
    firsts = buckets.groupBy("rep").agg(F.slice(F.array_sort(F.collect_set("sig")), 1, FIRST).alias("firsts"))
    shapes = known.select(F.col("id").alias("rep"), "size", *[f"p{i}" for i in range(PARITY)]).distinct().join(firsts, "rep").select("rep", F.struct("size", *[f"p{i}" for i in range(PARITY)], "firsts").alias("shape"))
    # sets of buckets that hold several components, numbered within their bucket; the hub is number 0
    while True:
        held = buckets.select("sig", "rep", (F.col("hub") == F.col("rep")).alias("is_hub")).join(labels.select(F.col("id").alias("rep"), F.col("component")), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        mixed = held.groupBy("sig").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi"), F.count(F.lit(1)).alias("_n")).where(f"_lo < _hi and _n > {asked + 1}").select("sig")
        open_rows = cut_lineage(numbered(held.join(mixed, "sig", "left_semi")).where(f"nr >= {asked}").join(shapes, "rep"))
        if open_rows.isEmpty():
            break
        near = met(open_rows, asked, percent)
        more = cut_lineage(links(near.select("a", "b").distinct(), sets, percent))
        asked *= SPREAD
        if not more.isEmpty():
            labels = least_labels(labels.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more))
    done = labels.select("id", "component")
    return (
        rows.select("id", "size").join(done, "id", "left").select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), F.col("size").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
    )


def numbered(held: DataFrame) -> DataFrame:
    """The sets of each bucket with a number, the hub's being 0, counted in two levels so that no bucket is ranked in one task."""
    from pyspark.sql import Window

    parts = held.withColumn("_part", F.when(F.col("is_hub"), -1).otherwise(F.col("rep").bitwiseAND(F.lit(63)).cast("int"))).drop("is_hub")
    inside = parts.withColumn("_inside", F.row_number().over(Window.partitionBy("sig", "_part").orderBy("rep")) - 1)
    sizes = parts.groupBy("sig", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("sig").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return inside.join(before, ["sig", "_part"]).withColumn("nr", F.col("_inside") + F.col("_before")).drop("_part", "_inside", "_before")


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group: the one with the least id, once for each text under it; rows without an id or a word are all kept."""
    taken = {c.lower() for c in docs.columns}
    gone_col, alone_col = (next(c for i in range(len(taken) + 1) if (c := f"_{name}{i}") not in taken) for name in ("gone", "alone"))
    groups = components(docs, n, percent, id_col, text_col)
    gone = groups.where(f"n_shingles > 0 and component_id <> `{id_col}`").select(F.col(id_col).alias(gone_col)).distinct()
    kept = docs.join(gone, docs[id_col] == gone[gone_col], "left_anti")
    # a row that is not compared is a key of its own
    compared = F.col(id_col).isNotNull() & F.coalesce(F.col(text_col).rlike(r"[^ \t\n\x0B\f\r]"), F.lit(False))
    numbered_rows = kept.withColumn(alone_col, F.when(~compared, F.monotonically_increasing_id()))
    return numbered_rows.dropDuplicates([id_col, text_col, alone_col]).select(docs.columns)

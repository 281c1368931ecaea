"""Benchmark decontamination by latent semantic retrieval.

Words are hashed features; their document frequencies are counted over all passages of all
documents and give TF-IDF weights. A randomised singular value decomposition of TF-IDF
passages gives latent directions: all half passages of all documents and of the benchmark
are multiplied with random vectors and orthonormalised, twice over, as Spark sums of
per-task products. Every passage of every whole text
(``PASSAGE`` words, every half passage) is projected and compared with all benchmark
passages by cosine; those of at least ``NEAR`` are candidates. So is, whatever its cosine,
every place around which enough of an item's rarer words stand for the check below to
accept it: a lookup by exact word, which leaves nothing out. For each candidate the
longest common subsequence between the benchmark item and the text around the passage
decides: ``SAME`` of the item's words, or ``ALIKE`` of them and also ``ANSWER`` of the
item's answer, its last sentence. This finds copies and paraphrases that keep the order.

The benchmark is taken to the driver and to every task; it must have at most
``BENCHMARK_WORDS`` words. A null or blank text has no passage; a null or blank item, or a
null item id, is never found. An item shorter than ``SHORT`` words must be contained
whole. Equal rows give equal results, a null id stays null, an empty table gives an empty
result; other columns are not touched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctual.llm.words import LOWER, keep_batches, map_batches, pieces, raw, runs, span_hashes, split, table
from punctual.session import cut_lineage

FEATURES, RANK, LEAD, EXTRA, PASSES = 1 << 14, 128, 8, 8, 2
PASSAGE, HALF = 32, 16
NEAR, SAME, ALIKE, ANSWER, SHORT, COMMON, FREQUENT, LEADS = 0.6, 0.8, 0.6, 0.8, 8, 2.0, 0.01, 4
BENCHMARK_WORDS = 1 << 22
BLOCK = 1 << 11
PART = 1 << 14
#: Products of half passages that are summed in one row.
SUMMED = 64
#: Bytes of text hashed at once: the arrays beside them stay in a core's cache.
CACHED = 1 << 18
U64 = np.uint64


def slots_of(h: np.ndarray) -> np.ndarray:
    return (h & U64(FEATURES - 1)).astype(np.int64)


def halves(first: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features laid out by half passages (rows of ``HALF``, filled up with -1), and each text's first row."""
    counts = np.diff(first)
    rows = np.r_[0, np.cumsum(-(-counts // HALF))]
    grid = np.full((rows[-1] + 1) * HALF, -1, np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    grid[rows[owner] * HALF + np.arange(len(slots)) - first[:-1][owner]] = slots
    return grid.reshape(-1, HALF), rows


def follows(rows: np.ndarray) -> np.ndarray:
    """Rows whose next row belongs to the same text."""
    out = np.ones(rows[-1], bool)
    out[rows[1:][np.diff(rows) > 0] - 1] = False
    return out


@dataclass(frozen=True)
class Items:
    """The benchmark: item ids, words, where the answer begins, and passages by item."""

    ids: list[int]
    words: list[list[str]]
    answer: list[int]


def words_of(text: str) -> list[str]:
    """Lower-cased words without marks at their ends."""
    return [w for w in (x.strip(MARKS) for x in text.lower().split()) if w]


def items_of(benchmark: DataFrame, item_col: str, text_col: str) -> tuple[Items, list[str]]:
    rows = benchmark.where(F.col(item_col).isNotNull() & F.col(text_col).isNotNull())
    size = rows.agg(F.sum(F.size(F.split(F.col(text_col), r"\s+")))).first()[0] or 0
    if size > BENCHMARK_WORDS:
        raise ValueError(f"the benchmark has {size} words, more than {BENCHMARK_WORDS}; pass it in parts")
    got = [(r[0], r[1]) for r in rows.select(item_col, text_col).dropDuplicates().orderBy(item_col, text_col).collect()]
    ids, words, answer, texts = [], [], [], []
    for item, text in got:
        tokens = words_of(text)
        if not tokens:
            continue
        sentences = [s for s in re.split(r"(?<=[.!?])\s+", text.strip()) if words_of(s)]
        ids.append(item)
        words.append(tokens)
        answer.append(len(tokens) - len(words_of(sentences[-1])))
        texts.append(text)
    return Items(ids, words, answer), texts


MARKS = ".,;:!?()[]{}\"'*#$%&|<>"
MARKS_AT_ONCE = 16
#: What ``str.split`` takes for blanks of ASCII besides ``BLANK``.
RARE_BLANKS = "\x1c\x1d\x1e\x1f"
MARK = table(MARKS.encode())
#: Bytes of which a text is lowered by Python: all but ASCII and what begins with ``LATIN``, whose letters lie 32 apart.
LATIN = 0xC3
HARD = table(RARE_BLANKS.encode() + bytes(b for b in range(0xC0, 0x100) if b != LATIN))
UPPER = table(bytes(b for b in range(0x80, 0x9F) if b != 0x97))


def folded(texts: pa.Array) -> pa.Array:
    """The texts in lower case, only ``BLANK`` bytes between words: the words of ``words_of`` with the marks at their ends."""
    data, edges = raw(texts)
    low = LOWER[data]
    after = np.flatnonzero(data[:-1] == LATIN) + 1
    low[after[UPPER[data[after]]]] += 32
    hard = np.unique(np.searchsorted(edges, np.flatnonzero(HARD[data]), "right") - 1).tolist()
    if hard:
        parts, done = [], 0
        sizes = np.diff(edges)
        for d in hard:
            line = " ".join(data[edges[d] : edges[d + 1]].tobytes().decode().lower().split()).encode()
            parts += [low[done : edges[d]].tobytes(), line]
            sizes[d], done = len(line), edges[d + 1]
        low, edges = np.frombuffer(b"".join([*parts, low[done:].tobytes()]), np.uint8), np.r_[0, np.cumsum(sizes)]
    out = pa.Array.from_buffers(pa.large_string(), len(edges) - 1, [None, pa.py_buffer(np.ascontiguousarray(edges, np.int64)), pa.py_buffer(low)])
    return pc.if_else(texts.is_valid(), out, pa.scalar(None, pa.large_string())) if texts.null_count else out


def stripped(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words without the marks at their ends; those of marks alone are empty."""
    start, end = start.copy(), end.copy()
    for side, step in ((start, 1), (end, -1)):
        at = np.flatnonzero(MARK[data[side - (step < 0)]])
        for _ in range(MARKS_AT_ONCE):
            side[at] += step
            at = at[start[at] < end[at]]
            at = at[MARK[data[side[at] - (step < 0)]]]
            if not len(at):
                break
        for i in at.tolist():
            # long lines of marks
            bare = np.flatnonzero(~MARK[data[start[i] : end[i]]])
            side[i] = (end[i] if step > 0 else start[i]) if not len(bare) else start[i] + bare[0] if step > 0 else start[i] + bare[-1] + 1
    return start, end


def texts_hashes(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each text, word hashes, byte positions of words) of folded texts; words are those of ``words_of``."""
    w = split(data, edges)
    start, end = stripped(data, w.start, w.end)
    keep = start < end
    if keep.all():
        return w.first, span_hashes(data, start, end), start
    start, end = start[keep], end[keep]
    return np.r_[0, np.cumsum(keep)][w.first], span_hashes(data, start, end), start


def texts_slots(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word of each text, features)."""
    first, h, _ = texts_hashes(data, edges)
    return first, slots_of(h)


def item_hashes(words: list[str]) -> np.ndarray:
    line = np.frombuffer(" ".join(words).encode("utf-8", "replace"), np.uint8)
    return texts_hashes(line, np.array([0, len(line)]))[1]


def laid_out(docs: DataFrame, text_col: str) -> DataFrame:
    """The half passages of each text as packed features, written once for all passes over them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, edges in pieces(folded(batch.column(0)), CACHED):
                first, slots = texts_slots(data, edges)
                grid, rows = halves(first, slots)
                packed = pa.Array.from_buffers(pa.binary(), len(rows) - 1, [None, pa.py_buffer((rows * HALF * 2).astype(np.int32)), pa.py_buffer(grid[: rows[-1]].astype("<i2"))])
                yield pa.RecordBatch.from_arrays([packed], names=["packed"])

    return cut_lineage(docs.select(text_col).mapInArrow(work, "packed binary"))


def unpacked(packed: pa.Array) -> Iterator[np.ndarray]:
    """Half passages in bounded parts."""
    _, offsets, data = packed.buffers()
    if not len(packed) or data is None:
        return
    edges = np.frombuffer(offsets, np.int32)[packed.offset : packed.offset + len(packed) + 1]
    grid = np.frombuffer(data, "<i2", (edges[-1] - edges[0]) // 2, edges[0]).reshape(-1, HALF)
    for lo in range(0, len(grid), PART):
        yield grid[lo : lo + PART].astype(np.int64)


def document_frequencies(packed: DataFrame) -> tuple[np.ndarray, int]:
    """In how many half passages of all documents each feature stands; tasks send blocks of sums."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            for grid in unpacked(batch.column(0)):
                ordered = np.sort(grid, axis=1)
                new = ordered >= 0
                new[:, 1:] &= ordered[:, 1:] != ordered[:, :-1]
                total += np.bincount(ordered[new], minlength=FEATURES)
                n += len(grid)
        blocks = total.reshape(-1, BLOCK)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(blocks) + 1, dtype=np.int32)), pa.array([*(b.tobytes() for b in blocks), np.array([n]).tobytes()], pa.binary())], names=["block", "packed"])

    rows = packed.mapInArrow(work, "block int, packed binary").groupBy("block").applyInArrow(lambda part: add_up(part, "<i8"), "block int, packed binary").collect()
    got = {r["block"]: np.frombuffer(r["packed"], "<i8") for r in rows}
    blocks = FEATURES // BLOCK
    return np.concatenate([got.get(b, np.zeros(BLOCK, np.int64)) for b in range(blocks)]), int(got.get(blocks, [0])[0])


def add_up(part: pa.Table, kind: str) -> pa.Table:
    total = None
    for packed in part.column("packed").to_pylist():
        values = np.frombuffer(packed, kind)
        total = values.copy() if total is None else total + values
    return pa.table({"block": part.column("block")[:1], "packed": pa.array([total.tobytes()], pa.binary())})


def products(grid: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Sums of the rows of a basis that each row of a grid names; half passages: -1 is the last of features + 1 rows, zero, and a repeated word counts each time."""
    out = np.empty((len(grid), basis.shape[1]), np.float32)
    for lo in range(0, len(grid), 512):
        part = grid[lo : lo + 512]
        total = np.take(basis, part[:, 0], axis=0, mode="wrap")
        more = np.empty_like(total)
        for j in range(1, part.shape[1]):
            np.take(basis, part[:, j], axis=0, out=more, mode="wrap")
            total += more
        out[lo : lo + 512] = total
    return out


def passages(grid: np.ndarray, rows: np.ndarray, weighted: np.ndarray) -> np.ndarray:
    """Latent vectors of all passages: each half with the next one of its text, the last one alone."""
    half = products(grid[: rows[-1]], weighted)
    at = np.flatnonzero(follows(rows))
    half[at] += half[at + 1]
    return half


def random_basis(columns: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(7)).standard_normal((FEATURES, columns)).astype(np.float32)


def add_products(total: np.ndarray, grid: np.ndarray, weighted: np.ndarray) -> None:
    """Add (A^T A) basis of half passages to ``total``, before the weights of its rows."""
    used = (weighted != 0).any(axis=1)
    y = products(grid, weighted)
    flat = grid.ravel()
    at = np.flatnonzero(used[flat])
    feature = flat[at].astype(np.uint16)
    order = np.argsort(feature, kind="stable")
    half, begin = at[order] // HALF, runs(feature[order])
    if not len(begin):
        return
    feature, count = feature[order][begin], np.diff(np.r_[begin, len(order)])
    # each half's product goes to all of its features: ``SUMMED`` of a feature are summed in one row, then what is over by powers of two
    sums = np.zeros((len(feature), y.shape[1]), np.float32)
    some = np.flatnonzero(count >= SUMMED)
    many = count[some] // SUMMED
    if len(some):
        full = products(half[np.repeat(begin[some], many * SUMMED) + spread(many * SUMMED)].reshape(-1, SUMMED), y)
        sums[some] = np.add.reduceat(full, np.cumsum(many) - many, axis=0)
    begin = begin + count // SUMMED * SUMMED
    size = SUMMED // 2
    while size:
        some = np.flatnonzero(count & size)
        sums[some] += products(half[begin[some, None] + np.arange(size)], y)
        begin[some] += size
        size //= 2
    total[feature] += sums


def add_squares(total: np.ndarray, grid: np.ndarray, weighted: np.ndarray) -> None:
    """Add basis^T (A^T A) basis of half passages to ``total``."""
    for lo in range(0, len(grid), BLOCK):
        y = products(grid[lo : lo + BLOCK], weighted)
        total += y.T @ y


def latent_space(packed: DataFrame, grid: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Right singular vectors without the ``LEAD`` first, which tell languages apart, scaled by inverse singular values; by power iteration on sums over tasks."""
    # each task sends one dense block of sums, so there are as many as keep the cores busy
    rows = packed.coalesce(2 * packed.sparkSession.sparkContext.defaultParallelism)
    columns = LEAD + RANK + EXTRA

    def gram(basis: np.ndarray) -> np.ndarray:
        """(A^T A) basis: each task multiplies its passages and adds into features, blocks are summed over tasks."""
        weighted = np.vstack([basis * idf[:, None], np.zeros((1, columns))]).astype(np.float32)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((FEATURES, columns))
            for batch in batches:
                for part in unpacked(batch.column(0)):
                    add_products(total, part, weighted)
            blocks = (total * idf[:, None]).reshape(-1, BLOCK * columns)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(blocks), dtype=np.int32)), pa.array([b.astype("<f4").tobytes() for b in blocks], pa.binary())], names=["block", "packed"])

        got = rows.mapInArrow(work, "block int, packed binary").groupBy("block").applyInArrow(lambda part: add_up(part, "<f4"), "block int, packed binary").collect()
        own = np.zeros((FEATURES, columns))
        for lo in range(0, len(grid), PART):
            add_products(own, grid[lo : lo + PART], weighted)
        out = (own * idf[:, None]).astype(np.float32).reshape(FEATURES // BLOCK, BLOCK * columns)
        for r in got:
            out[r["block"]] += np.frombuffer(r["packed"], "<f4")
        return out.reshape(FEATURES, columns)

    def squares(basis: np.ndarray) -> np.ndarray:
        """basis^T (A^T A) basis, as the products of the half passages with themselves."""
        weighted = np.vstack([basis * idf[:, None], np.zeros((1, columns))]).astype(np.float32)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((columns, columns))
            for batch in batches:
                for part in unpacked(batch.column(0)):
                    add_squares(total, part, weighted)
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.astype("<f8").tobytes()], pa.binary())], names=["block", "packed"])

        got = rows.mapInArrow(work, "block int, packed binary").groupBy("block").applyInArrow(lambda part: add_up(part, "<f8"), "block int, packed binary").collect()
        out = np.zeros((columns, columns))
        add_squares(out, grid, weighted)
        for r in got:
            out += np.frombuffer(r["packed"], "<f8").reshape(columns, columns)
        return out

    q = np.linalg.qr(random_basis(columns))[0]
    for _ in range(PASSES):
        q = np.linalg.qr(gram(q))[0]
    small = squares(q)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-values)
    order = order[values[order] > 1e-6 * max(values.max(), 1e-12)]
    # a few passages have no directions to spare
    order = order[min(LEAD, max(0, len(order) - RANK)) :][:RANK]
    out = np.zeros((FEATURES, RANK), np.float32)
    out[:, : len(order)] = q @ vectors[:, order] / np.sqrt(values[order])
    return out


def common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a row of bits at a time."""
    where: dict[str, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for w in b:
        hit = row & where.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


class Sought:
    """An item's words by hash, with a bit for each place where one stands."""

    def __init__(self, h: np.ndarray):
        self.size = len(h)
        self.keys, of_word, self.times = np.unique(h, return_inverse=True, return_counts=True)
        self.bits = [0] * len(self.keys)
        for i, key in enumerate(of_word.tolist()):
            self.bits[key] |= 1 << i

    def common(self, near: np.ndarray, least: float = 0) -> int:
        """Length of the longest subsequence in common with a text's words, 0 where their numbers tell that it is below ``least``."""
        at = np.minimum(np.searchsorted(self.keys, near), len(self.keys) - 1)
        # words that the item does not have leave the row of bits as it is
        at = at[self.keys[at] == near]
        if len(at) < least or np.minimum(np.bincount(at, minlength=len(self.keys)), self.times).sum() < least:
            return 0
        row = full = (1 << self.size) - 1
        for key in at.tolist():
            hit = row & self.bits[key]
            row = ((row + hit) | (row - hit)) & full
        return self.size - row.bit_count()


@dataclass(frozen=True)
class Lookup:
    """Which items each of their lead words stands in, and how many hits a window must have.

    An accepted place matches at least ``ALIKE`` of the item's words (all, if it is short), so
    it misses at most ``spare`` of them: of any ``spare + k`` words of the item it matches ``k``.
    Lead words are the item's words that are not frequent, or at least its ``spare + LEADS`` rarest.
    """

    maybe: np.ndarray
    keys: np.ndarray
    begin: np.ndarray
    item: np.ndarray
    times: np.ndarray
    length: np.ndarray
    least: np.ndarray


def lookup_of(items: Items, counts: np.ndarray, n: int) -> Lookup:
    pairs, least = [], []
    for i, words in enumerate(items.words):
        h = item_hashes(words)
        spare = len(words) - (int(np.ceil(ALIKE * len(words))) if len(words) >= SHORT else len(words))
        often = counts[slots_of(h)]
        order = np.lexsort((h, often))
        lead = h[order[: max(spare + LEADS, int((often <= FREQUENT * n).sum()))]]
        least.append(len(lead) - spare)
        keys, times = np.unique(lead, return_counts=True)
        pairs.append(np.stack([keys, np.full(len(keys), i, U64), times.astype(U64)]))
    flat = np.concatenate(pairs, axis=1)
    flat = flat[:, np.argsort(flat[0], kind="stable")]
    keys, begin = np.unique(flat[0], return_index=True)
    maybe = np.zeros(1 << 20, bool)
    maybe[(keys >> U64(44)).astype(np.int64)] = True
    return Lookup(maybe, keys, np.r_[begin, flat.shape[1]], flat[1].astype(np.int64), flat[2].astype(np.int64), np.array([len(w) for w in items.words]), np.array(least))


def looked_up(h: np.ndarray, first: np.ndarray, rows: np.ndarray, find: Lookup) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, item, row) of every half passage whose surrounding words hold enough lead words of the item."""
    none = np.zeros(0, np.int64)
    word = np.flatnonzero(find.maybe[(h >> U64(44)).astype(np.int64)])
    key = np.minimum(np.searchsorted(find.keys, h[word]), len(find.keys) - 1)
    word, key = word[find.keys[key] == h[word]], key[find.keys[key] == h[word]]
    many = find.begin[key + 1] - find.begin[key]
    entry = np.repeat(find.begin[key], many) + spread(many)
    item, word = find.item[entry], np.repeat(word, many)
    if not len(word):
        return none, none, none
    text = np.searchsorted(first, word, "right") - 1
    order = np.lexsort((word, item, text))
    word, item, text, entry = word[order], item[order], text[order], entry[order]
    # as many hits of the same item in the same text as it needs, within the width of one window
    last = np.arange(len(word)) + find.least[item] - 1
    ok = last < len(word)
    to = np.minimum(last, len(word) - 1)
    ok &= (item[to] == item) & (text[to] == text) & (word[to] - word < PASSAGE + 2 * (HALF + find.length[item]))
    at = np.flatnonzero(ok)
    if not len(at):
        return none, none, none
    reach, d = find.length[item[at]] + HALF, text[at]
    low = np.maximum(0, -((PASSAGE + reach - 1 - (word[to[at]] - first[d])) // HALF))
    high = np.minimum(rows[d + 1] - rows[d] - 1, (word[at] - first[d] + reach) // HALF)
    many = np.maximum(0, high - low + 1)
    i, r = np.divmod(np.unique(np.repeat(item[at], many) * rows[-1] + np.repeat(low + rows[d], many) + spread(many)), rows[-1])
    d = np.searchsorted(rows, r, "right") - 1
    # of these words each counts as often as the item has it
    group = np.cumsum(np.r_[False, (item[1:] != item[:-1]) | (text[1:] != text[:-1])])
    place, width = group * (len(h) + 1) + word, len(h) + 1
    at = group[np.searchsorted(text * len(find.length) + item, d * len(find.length) + i)]
    begin, reach = first[d] + (r - rows[d]) * HALF, find.length[i] + HALF
    low = np.searchsorted(place, at * width + np.maximum(first[d], begin - reach))
    high = np.searchsorted(place, at * width + np.minimum(first[d + 1], begin + PASSAGE + reach))
    enough = np.zeros(len(d), bool)
    for lo in range(0, len(d), 1 << 14):
        many = (high - low)[lo : lo + (1 << 14)]
        of, hit = np.repeat(np.arange(len(many)), many), entry[np.repeat(low[lo : lo + (1 << 14)], many) + spread(many)]
        pair, times = np.unique(of * len(find.item) + hit, return_counts=True)
        total = np.bincount(pair // len(find.item), np.minimum(times, find.times[pair % len(find.item)]), len(many))
        enough[lo : lo + (1 << 14)] = total >= find.least[i[lo : lo + (1 << 14)]]
    return d[enough], i[enough], r[enough]


def spread(many: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of the given counts."""
    return np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)


@dataclass(frozen=True)
class Index:
    items: Items
    weighted: np.ndarray
    vectors: np.ndarray
    item_of: np.ndarray
    rare: np.ndarray
    needed: np.ndarray
    reach: int
    lookup: Lookup
    hashes: list[np.ndarray]
    sought: list[Sought]
    answers: list[Sought]


def index(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str) -> Index | None:
    items, texts = items_of(benchmark, item_col, item_text)
    if not texts:
        return None
    packed = laid_out(docs, text_col)
    counts, n = document_frequencies(packed)
    idf = np.maximum(0, np.log((n + 1) / (counts + 1)) - COMMON).astype(np.float32)
    grids = [halves(*texts_slots(data, edges)) for _, _, data, edges in pieces(folded(pa.array(texts, pa.large_string())))]
    space = latent_space(packed, np.concatenate([grid[: rows[-1]] for grid, rows in grids]), idf)
    weighted = np.vstack([space * idf[:, None], np.zeros((1, RANK), np.float32)]).astype(np.float32)
    vectors, owner = [], []
    for lo, _, data, edges in pieces(folded(pa.array(texts, pa.large_string()))):
        first, slots = texts_slots(data, edges)
        grid, rows = halves(first, slots)
        # passages that do not overlap, and the item as a whole
        whose, nr = np.repeat(np.arange(len(rows) - 1), np.diff(rows)), np.arange(rows[-1]) - np.repeat(rows[:-1], np.diff(rows))
        apart = nr % 2 == 0
        vectors.append(passages(grid, rows, weighted)[apart])
        owner.append(lo + whose[apart])
        whole = np.add.reduceat(products(grid[: rows[-1]], weighted), rows[:-1], axis=0)
        vectors.append(whole)
        owner.append(lo + np.arange(len(rows) - 1))
    v = np.concatenate(vectors)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    # of an item's words that count for similarity, so many must stand around a leak whatever its common words do
    rare, needed = np.zeros((len(texts), FEATURES + 1), bool), np.zeros(len(texts), np.int64)
    for i, words in enumerate(items.words):
        slots = slots_of(item_hashes(words))
        rare[i, slots[idf[slots] > 0]] = True
        needed[i] = np.ceil(ALIKE * len(words)) - (len(words) - (idf[slots] > 0).sum())
    hashes = [item_hashes(words) for words in items.words]
    return Index(
        items, weighted, v.T.copy(), np.concatenate(owner), rare, needed, max(len(w) for w in items.words) // HALF + 2, lookup_of(items, counts, n),
        hashes, [Sought(h) for h in hashes], [Sought(h[at:]) for h, at in zip(hashes, items.answer, strict=True)],
    )


def hits(texts: pa.Array, ix: Index | None) -> Iterator[tuple[int, int, float, int, int]]:
    """(row, item, cosine, words in common, first word) of every leak, the best place of each item in each text."""
    if ix is None:
        return
    for lo, _, data, edges in pieces(folded(texts), CACHED):
        first, h, _ = texts_hashes(data, edges)
        grid, rows = halves(first, slots_of(h))
        latent = passages(grid, rows, ix.weighted)
        latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
        found: dict[tuple[int, int], list[tuple[int, float]]] = {}
        for at in range(0, len(latent), 2048):
            cosine = latent[at : at + 2048] @ ix.vectors
            # over a flat view, an order of magnitude faster where few are true
            r, c = np.divmod(np.flatnonzero(cosine >= NEAR), cosine.shape[1])
            near, r, item = cosine[r, c], r + at, ix.item_of[c]
            d = np.searchsorted(rows, r, "right") - 1
            ok = possible(grid, rows, r, d, item, ix)
            for place in zip(d[ok].tolist(), item[ok].tolist(), r[ok].tolist(), near[ok].tolist(), strict=True):
                found.setdefault(place[:2], []).append(place[2:])
        d, item, r = looked_up(h, first, rows, ix.lookup)
        near = cosines(latent, r, item, ix)
        for place in zip(d.tolist(), item.tolist(), r.tolist(), near.tolist(), strict=True):
            found.setdefault(place[:2], []).append(place[2:])
        for (d, item), places in sorted(found.items()):
            size, sought, best = len(ix.hashes[item]), ix.sought[item], (-1, 0, h[:0])
            reach, order = size + HALF, sorted({p for p, _ in places})

            def around(low: int, high: int) -> tuple[int, np.ndarray]:
                # the words around the passages, wide enough for the whole item on either side
                a, b = max(first[d], first[d] + (low - rows[d]) * HALF - reach), min(first[d + 1], first[d] + (high - rows[d]) * HALF + PASSAGE + reach)
                return a, h[a:b]

            # windows that overlap have no more in common with the item than what they cover together
            near_by = np.split(order, 1 + np.flatnonzero(np.diff(order) * HALF > 2 * reach + PASSAGE))
            least = size if size < SHORT else ALIKE * size
            order = [row for run in near_by if len(run) < 2 or sought.common(around(run[0], run[-1])[1], least) >= least for row in run.tolist()]
            for row in order:
                a, near = around(row, row)
                best = max(best, (sought.common(near, least), -int(a - first[d]), near), key=lambda x: x[:2])
            n, at_word, near = best
            if size < SHORT:
                leak = n >= least and any(np.array_equal(near[i : i + size], ix.hashes[item]) for i in range(len(near) - size + 1))
            else:
                answer = ix.answers[item]
                leak = n >= SAME * size or n >= least and answer.common(near) >= ANSWER * answer.size
            if leak:
                yield lo + d, item, max(c for _, c in places), n, -at_word


def cosines(latent: np.ndarray, row: np.ndarray, item: np.ndarray, ix: Index) -> np.ndarray:
    """The best cosine of each row with the passages of its item."""
    out = np.zeros(len(row), np.float32)
    for i in np.unique(item):
        at = np.flatnonzero(item == i)
        out[at] = (latent[row[at]] @ ix.vectors[:, ix.item_of == i]).max(1)
    return out


def possible(grid: np.ndarray, rows: np.ndarray, row: np.ndarray, text: np.ndarray, item: np.ndarray, ix: Index) -> np.ndarray:
    """Candidates around which enough of the item's rarer words stand; rejects none that the exact check would accept."""
    out = np.zeros(len(row), bool)
    for lo in range(0, len(row), 4096):
        part = slice(lo, lo + 4096)
        total = np.zeros(len(row[part]), np.int64)
        for step in range(-ix.reach, ix.reach + 2):
            there = row[part] + step
            inside = (there >= rows[text[part]]) & (there < rows[text[part] + 1])
            total += (ix.rare[item[part][:, None], grid[np.where(inside, there, 0)]] & inside[:, None]).sum(1)
        out[part] = total >= ix.needed[item[part]]
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(document id, item id, cosine, lcs_words, item_words, near_word) of each document that holds a benchmark item."""
    ix = index(docs, benchmark, id_col, text_col, item_col, item_text)
    def columns(batch: pa.RecordBatch) -> dict:
        got = list(hits(batch.column(1), ix))
        return {
            id_col: batch.column(0).take(pa.array([g[0] for g in got], pa.int64())), item_col: pa.array([ix.items.ids[g[1]] for g in got]) if got else [],
            "cosine": [g[2] for g in got], "lcs_words": [g[3] for g in got], "item_words": [len(ix.items.words[g[1]]) for g in got], "near_word": [g[4] for g in got],
        }

    kinds = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    return map_batches(docs.select(F.col(id_col), F.col(text_col)), f"`{id_col}` {kinds[0]}, `{item_col}` {kinds[1]}, cosine double, lcs_words bigint, item_words bigint, near_word bigint", columns)


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows, with all their columns, that hold no benchmark item."""
    ix = index(docs, benchmark, id_col, text_col, item_col, item_text)

    def wanted(batch: pa.RecordBatch) -> np.ndarray:
        keep = np.ones(batch.num_rows, bool)
        keep[[g[0] for g in hits(batch.column(batch.schema.get_field_index(text_col)), ix)]] = False
        return keep

    return keep_batches(docs, wanted)

"""Language-model scoring: Katz backoff with Good-Turing discounts, in partitioned tables.

Tokens are a text's lower-cased words and one end; bigrams also see a start. A bigram of
count r has probability d(r) r / c(history), d being Good-Turing's ratio up to ``TRUST``
and 1 above; what a history leaves is spread over the words it was not seen with, in
proportion to their unigram probabilities, so each history sums to one exactly. Unigrams
are discounted the same way and leave their rest to the unknown word.

Counts live in tables that are partitioned by hash. The unigram table is written first.
Documents are dealt into chunks by id and text, so that rows which share an id or have none
need not share a chunk; a chunk asks the unigram table for its vocabulary, then
sends its distinct bigrams to the blocks of their histories, where counts of all chunks
are added and every history's statistics are made; each chunk gets both back and evaluates
the recursion token by token. A frequent history is split into as many parts as its count
asks for and its parts are added up by the chunk, so no table block grows with it. What is
gathered grows with the corpus; the driver sees ``TRUST + 3`` sums.

A null text counts as empty and has the end as its only token; rows with a null id are
never held out and are learned from; equal rows get equal scores and each counts. Other
columns are not touched; an empty table gives an empty result, and without learned
documents every token has probability one half at each level of the unknown word.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctual.llm.packing import planes, unplanes
from punctual.llm.words import fold, map_batches, mix, pieces, runs, split
from punctual.session import cut_lineage

FOLDS, HELD_OUT = 7, 2
TRUST = 5
CHUNK_BYTES, BLOCK_BYTES, PART = 12 << 20, 16 << 20, 1 << 18
U64 = np.uint64
START, END = U64(0x5851F42D4C957F2D), U64(0x14057B7EF767814F)
W_BITS = 48
SENT = pa.schema([("chunk", pa.int32()), ("row", pa.int32()), ("block", pa.int32()), ("packed", pa.binary())])
SENT_DDL = "chunk int, row int, block int, packed binary"


def good_turing(n: list[float]) -> list[float] | None:
    """Katz's discount ratios for counts 1 to ``TRUST`` from n(1) to n(TRUST + 1), where all lie in (0, 1]."""
    k = TRUST
    if min(n) <= 0 or (common := (k + 1) * n[k] / n[0]) >= 1:
        return None
    d = [((r + 1) * n[r] / n[r - 1] / r - common) / (1 - common) for r in range(1, k + 1)]
    return d if all(0 < x <= 1 for x in d) else None


def ratios(n: list[int]) -> list[float]:
    """Good-Turing ratios; from a line through log n(r) over log r where the plain ones leave (0, 1]; from one absolute discount where that fails."""
    d = good_turing(n)
    seen = [r for r in range(1, TRUST + 2) if n[r - 1] > 0]
    if d is None and len(seen) > 1:
        slope, at_one = np.polyfit(np.log(seen), np.log([n[r - 1] for r in seen]), 1)
        d = good_turing([float(np.exp(at_one + slope * np.log(r))) for r in range(1, TRUST + 2)])
    if d is None:
        step = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        d = [(r - min(step, 0.9)) / r for r in range(1, TRUST + 1)]
    return d


@dataclass(frozen=True)
class Unigrams:
    tokens: int
    words: int
    counts: tuple[int, ...]
    ends: int

    @property
    def unknown(self) -> float:
        """Probability of the unknown word: what the discounts leave, and never nothing."""
        if not self.tokens:
            return 0.5
        left = sum(r * (1 - d) * n for r, d, n in zip(range(1, TRUST + 1), ratios(list(self.counts)), self.counts, strict=False))
        return max(left, 0.5) / (self.tokens + max(0.0, 0.5 - left))

    def probability(self, count: np.ndarray) -> np.ndarray:
        if not self.tokens:
            return np.full(len(count), self.unknown)
        d = np.r_[1.0, ratios(list(self.counts)), 1.0]
        left = sum(r * (1 - x) * n for r, x, n in zip(range(1, TRUST + 1), d[1:-1], self.counts, strict=False))
        seen = d[np.minimum(count, TRUST + 1)] * count / (self.tokens - left) * (1 - self.unknown)
        return np.where(count > 0, seen, self.unknown)

    def base(self, count: np.ndarray) -> np.ndarray:
        """log10 of the add-one probability."""
        return np.log10((count + 1.0) / (self.tokens + self.words + 1.0))


def token_hashes(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all texts in order, ends included, and the bounds of texts."""
    w = split(data, edges)
    bounds = w.first + np.arange(len(w.first))
    out = np.empty(bounds[-1], U64)
    out[bounds[1:] - 1] = END
    owner = w.owner()
    out[np.arange(len(owner)) + owner] = w.hashes(lower=True)
    return out, bounds


def blocks_of(size: int) -> int:
    """Bits of the number of table blocks for so many bytes of text."""
    return max(0, (size // BLOCK_BYTES).bit_length())


def bounds_by_block(ordered: np.ndarray, bits: int) -> np.ndarray:
    top = np.arange(1 << bits, dtype=U64) << U64(64 - bits) if bits else np.zeros(1, U64)
    return np.r_[np.searchsorted(ordered, top), len(ordered)]


def unigram_table(docs: DataFrame, bits: int) -> DataFrame:
    """(block, words, counts, tallies): distinct learned tokens by hash, written by block."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            learned = ~fold(batch.column(0), FOLDS, HELD_OUT)
            texts = pc.filter(batch.column(1), pa.array(learned))
            parts = [np.unique(token_hashes(data, edges)[0], return_counts=True) for _, _, data, edges in pieces(texts)]
            if not parts:
                continue
            h, c = added(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            at = bounds_by_block(h, bits)
            full = np.flatnonzero(np.diff(at))
            yield pa.RecordBatch.from_arrays(
                [pa.array(full.astype(np.int32)), pa.array([planes(h[at[b] : at[b + 1]], "<u8") for b in full], pa.binary()), pa.array([planes(c[at[b] : at[b + 1]], "<u8") for b in full], pa.binary())],
                names=["block", "words", "counts"],
            )

    def merge(part: pa.Table) -> pa.Table:
        h, c = added(*(np.concatenate([unplanes(x, "<u8") for x in part.column(name).to_pylist()]) for name in ("words", "counts")))
        c = c.astype(np.int64)
        tallies = [*np.bincount(np.minimum(c, TRUST + 2), minlength=TRUST + 3)[1 : TRUST + 2].tolist(), len(c), int(c.sum()), int(c[h == END].sum())]
        return pa.table({"block": part.column("block")[:1], "words": pa.array([planes(h, "<u8")], pa.binary()), "counts": pa.array([planes(c, "<u8")], pa.binary()), "tallies": pa.array([tallies], pa.list_(pa.int64()))})

    sent = docs.select("id", "text").mapInArrow(work, "block int, words binary, counts binary")
    return cut_lineage(sent.groupBy("block").applyInArrow(merge, "block int, words binary, counts binary, tallies array<bigint>"))


def added(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(h)
    at = runs(h[order])
    return h[order][at], np.add.reduceat(c[order], at) if len(at) else c


def summary(table: DataFrame) -> Unigrams:
    sums = table.agg(*[F.sum(F.get("tallies", F.lit(i))).alias(f"t{i}") for i in range(TRUST + 4)]).first()
    got = [int(x or 0) for x in sums]
    return Unigrams(got[TRUST + 2], got[TRUST + 1], tuple(got[: TRUST + 1]), got[TRUST + 3])


def deflated(texts: DataFrame) -> DataFrame:
    """Texts deflated, a third smaller in the shuffle than with its own compression."""

    def columns(batch: pa.RecordBatch) -> dict:
        packed = [None if t is None else zlib.compress(t.encode(), 4) for t in batch.column(2).to_pylist()]
        return {"chunk": batch.column(0), "id": batch.column(1), "text": pa.array(packed, pa.binary())}

    return map_batches(texts, "chunk int, id bigint, text binary", columns)


class Chunk:
    """Tokens of a chunk's documents, its vocabulary (ordered by hash) and which documents are learned."""

    def __init__(self, table: pa.Table):
        order = np.argsort(np.array([(-1 << 62) if i is None else i for i in table.column("id").to_pylist()], np.int64), kind="stable")
        table = table.take(pa.array(order))
        self.ids = table.column("id")
        self.held_out = fold(self.ids, FOLDS, HELD_OUT)
        texts = pa.array([None if t is None else zlib.decompress(t) for t in table.column("text").to_pylist()], pa.large_binary())
        parts = [token_hashes(data, edges) for _, _, data, edges in pieces(texts.cast(pa.large_string()))]
        tokens = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, U64)
        self.sizes = np.concatenate([np.diff(p[1]) for p in parts]) if parts else np.zeros(0, np.int64)
        self.words, self.token = np.unique(tokens, return_inverse=True)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.learned = np.repeat(~self.held_out, self.sizes)

    def ask(self, number: int, bits: int) -> pa.Table:
        at = bounds_by_block(self.words, bits)
        full = np.flatnonzero(np.diff(at))
        return sent(number, 0, full, [planes(self.words[at[b] : at[b + 1]], "<u8") for b in full])

    def counts(self, answers: dict[int, bytes], bits: int) -> np.ndarray:
        at = bounds_by_block(self.words, bits)
        return np.concatenate([unplanes(answers[int(b)], "<u8").astype(np.int64) for b in np.flatnonzero(np.diff(at))] or [np.zeros(0, np.int64)])


def sent(number: int, row: int, blocks: np.ndarray, packed: list[bytes]) -> pa.Table:
    n = len(packed)
    return pa.table([pa.array([number] * n, pa.int32()), pa.array([row] * n, pa.int32()), pa.array(np.asarray(blocks, np.int32)), pa.array(packed, pa.binary())], schema=SENT)


def answer_counts(asked: pa.Table, table: pa.Table) -> pa.Table:
    """The unigram counts of each chunk's words of one block."""
    h, c = np.zeros(0, U64), np.zeros(0, U64)
    if table.num_rows:
        h, c = (unplanes(table.column(name)[0].as_py(), "<u8") for name in ("words", "counts"))
    out = []
    for packed in asked.column("packed").to_pylist():
        words = unplanes(packed, "<u8")
        at = np.minimum(np.searchsorted(h, words), max(0, len(h) - 1))
        out.append(planes(np.where(h[at] == words, c[at], U64(0)) if len(h) else np.zeros(len(words), U64), "<u8"))
    return asked.set_column(3, SENT.field(3), pa.array(out, pa.binary()))


class Bigrams:
    """A chunk's distinct bigrams by history part, in the order in which they are sent."""

    def __init__(self, chunk: Chunk, counts: np.ndarray, unigrams: Unigrams, bits: int):
        n = len(chunk.words)
        # the history of a text's first token is the start, number n
        before = np.empty(len(chunk.token), np.int64)
        before[1:] = chunk.token[:-1]
        before[chunk.first[chunk.sizes > 0]] = n
        keys, self.of_token = np.unique(before * (n + 1) + chunk.token, return_inverse=True)
        history, word = np.divmod(keys, n + 1)
        learned = np.bincount(self.of_token[chunk.learned], minlength=len(keys))
        hashes, seen = np.r_[chunk.words, START], np.r_[counts, unigrams.ends]
        parts = 1 + seen // PART
        used = np.unique(history)
        # every part of every history is asked for, also those that get no bigram from here
        owner = np.repeat(used, parts[used])
        nr = np.arange(len(owner)) - np.repeat(np.cumsum(parts[used]) - parts[used], parts[used])
        group = mix(hashes[owner] + nr.astype(U64) * U64(0x9E3779B97F4A7C15), 41)
        order = np.argsort(group)
        self.group, self.owner = group[order], owner[order]
        part = (mix(chunk.words[word], 43) % parts[history].astype(U64)).astype(U64)
        own = np.searchsorted(self.group, mix(hashes[history] + part * U64(0x9E3779B97F4A7C15), 41))
        short = mix(chunk.words[word], 44) >> U64(64 - W_BITS)
        self.order = np.lexsort((short, own))
        self.own, self.short = own[self.order], short[self.order]
        self.learned, self.count_of_word = learned[self.order], counts[word][self.order]
        self.history, self.word = history[self.order], word[self.order]
        self.groups_at = bounds_by_block(self.group, bits)
        self.sizes = np.bincount(self.own, minlength=len(self.group))
        self.split = parts[self.owner] > 1
        self.rows_at = np.r_[0, np.cumsum(self.sizes)][self.groups_at]

    def send(self, number: int) -> pa.Table:
        out = []
        for b in range(len(self.groups_at) - 1):
            g, r = slice(self.groups_at[b], self.groups_at[b + 1]), slice(self.rows_at[b], self.rows_at[b + 1])
            short = planes(self.short[r] << U64(64 - W_BITS), "<u8")[2 * (r.stop - r.start) :]
            out.append(np.array([g.stop - g.start, r.stop - r.start], "<i8").tobytes() + planes(self.group[g], "<u8") + planes(2 * self.sizes[g] + self.split[g], "<u4") + short + planes(self.learned[r], "<u4") + planes(np.where(self.learned[r] > 0, self.count_of_word[r], 0), "<u8"))
        return sent(number, 1, np.arange(len(out)), out)


def merge_bigrams(part: pa.Table, unigrams: Unigrams) -> pa.Table:
    """Add up a block of all chunks; every chunk gets its bigrams' counts and its histories' statistics."""
    groups, sizes, split, shorts, learned, of_word, shapes = [], [], [], [], [], [], []
    for packed in part.column("packed").to_pylist():
        g, r = np.frombuffer(packed[:16], "<i8").tolist()
        at = 16
        fields = []
        for n, width in ((g, 8), (g, 4), (r, W_BITS // 8), (r, 4), (r, 8)):
            fields.append(packed[at : at + n * width])
            at += n * width
        shapes.append((g, r))
        groups.append(unplanes(fields[0], "<u8"))
        size = unplanes(fields[1], "<u4")
        sizes.append(size >> 1)
        split.append((size & 1).astype(bool))
        shorts.append(unplanes(bytes(2 * r) + fields[2], "<u8"))
        learned.append(unplanes(fields[3], "<u4"))
        of_word.append(unplanes(fields[4], "<u8"))
    known, place = np.unique(np.concatenate(groups), return_inverse=True)
    own = np.repeat(place, np.concatenate(sizes).astype(np.int64))
    short, weight, count_of_word = np.concatenate(shorts), np.concatenate(learned).astype(np.int64), np.concatenate(of_word).astype(np.int64)
    # a bigram's word count comes from the chunks that learn it, and stands first
    order = np.lexsort((-count_of_word, short, own))
    o, s = own[order], short[order]
    new = np.r_[True, (o[1:] != o[:-1]) | (s[1:] != s[:-1])] if len(o) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    total = np.add.reduceat(weight[order], at) if len(at) else weight
    owner, seen = o[at], total > 0
    tallies = [np.bincount(owner[total == r], minlength=len(known)) for r in range(1, TRUST + 1)]
    mass = np.bincount(owner[seen], unigrams.probability(count_of_word[order][at])[seen], minlength=len(known))
    counted = np.zeros(len(o), np.int64)
    counted[order] = total[np.cumsum(new) - 1]
    of_block = np.bincount(np.minimum(total, TRUST + 2), minlength=TRUST + 3)[1 : TRUST + 2].astype("<i8").tobytes()
    out, row, group = [], 0, 0
    for part_split, part_sizes, (g, r) in zip(split, sizes, shapes, strict=True):
        mine = place[group : group + g]
        # the probability of a history's own words matters where it is asked for another one
        asked = part_split | (np.bincount(np.repeat(np.arange(g), part_sizes.astype(np.int64)), counted[row : row + r] == 0, minlength=g) > 0)
        out.append(of_block + planes(np.where(asked, mass[mine], 0.0), "<f8") + b"".join(planes(t[mine], "<u4") for t in tallies) + planes(counted[row : row + r], "<u4"))
        group, row = group + g, row + r
    return part.set_column(3, SENT.field(3), pa.array(out, pa.binary()))


def probabilities(bigrams: Bigrams, answers: dict[int, bytes], unigrams: Unigrams, history: np.ndarray) -> np.ndarray:
    """log10 P(word | history) of each bigram, in the order sent; every learned history has one word after it."""
    of_all, n_histories = np.zeros(TRUST + 1, np.int64), len(history)
    mass, tallies = np.zeros(n_histories), np.zeros((TRUST, n_histories))
    counted = np.zeros(len(bigrams.own), np.int64)
    for b in range(len(bigrams.groups_at) - 1):
        g, r = slice(bigrams.groups_at[b], bigrams.groups_at[b + 1]), slice(bigrams.rows_at[b], bigrams.rows_at[b + 1])
        n, m, packed, at = g.stop - g.start, r.stop - r.start, answers[b], 8 * (TRUST + 1)
        of_all += np.frombuffer(packed[:at], "<i8")
        owner = bigrams.owner[g]
        for values, kind in ((mass, "<f8"), *((t, "<u4") for t in tallies)):
            size = n * np.dtype(kind).itemsize
            # a history's parts add up
            values += np.bincount(owner, unplanes(packed[at : at + size], kind), minlength=n_histories)
            at += size
        counted[r] = unplanes(packed[at : at + 4 * m], "<u4")
    d = ratios(of_all.tolist())
    left = sum(r * (1 - x) * t for r, x, t in zip(range(1, TRUST + 1), d, tallies, strict=True))
    # a history without small counts keeps one count for what it was not seen with
    extra = np.where(left > 0, 0.0, 1.0)
    whole = np.maximum(history + extra, 1e-300)
    backoff = np.where(history > 0, (left + extra) / whole / (1 - mass), 1.0)
    h = bigrams.history
    seen = np.r_[1.0, d, 1.0][np.minimum(counted, TRUST + 1)] * counted / whole[h]
    p = np.where(counted > 0, seen, backoff[h] * unigrams.probability(bigrams.count_of_word))
    return np.log10(p)


def parts_of(answers: pa.Table) -> tuple[dict[int, bytes], dict[int, bytes]]:
    out: tuple[dict[int, bytes], dict[int, bytes]] = ({}, {})
    for row, block, packed in zip(*(answers.column(c).to_pylist() for c in ("row", "block", "packed")), strict=True):
        out[row][block] = packed
    return out


def dealt(docs: DataFrame, chunks: int, id_col: str, text_col: str) -> DataFrame:
    chunk = F.pmod(F.xxhash64(id_col, text_col), F.lit(chunks)).cast("int")
    return docs.select(chunk.alias("chunk"), F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row its id, held_out, n_tokens, n_known, train_tokens, base_score and score, all log10."""
    size = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    bits, chunks = blocks_of(size), max(1, -(-size // CHUNK_BYTES))
    texts = dealt(docs, chunks, id_col, text_col)
    table = unigram_table(texts, bits)
    unigrams = summary(table)
    texts = deflated(texts)

    def ask(key: tuple, part: pa.Table) -> pa.Table:
        return Chunk(part).ask(key[0].as_py(), bits)

    def send(key: tuple, part: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = Chunk(part)
        return Bigrams(chunk, chunk.counts(parts_of(answers)[0], bits), unigrams, bits).send(key[0].as_py())

    def evaluate(key: tuple, part: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = Chunk(part)
        words, pairs = parts_of(answers)
        counts = chunk.counts(words, bits)
        bigrams = Bigrams(chunk, counts, unigrams, bits)
        log_p = np.empty(len(bigrams.own))
        log_p[bigrams.order] = probabilities(bigrams, pairs, unigrams, np.r_[counts, unigrams.ends].astype(float))
        base, known = unigrams.base(counts)[chunk.token], (counts > 0)[chunk.token]
        sums = lambda x: np.add.reduceat(x, chunk.first) if len(chunk.first) else np.zeros(0)  # noqa: E731  every text has its end
        return pa.table({
            "id": chunk.ids, "held_out": pa.array(chunk.held_out), "n_tokens": pa.array(chunk.sizes.astype(np.int64)), "n_known": pa.array(sums(known.astype(np.int64)).astype(np.int64)),
            "train_tokens": pa.array(np.full(len(chunk.sizes), unigrams.tokens, np.int64)), "base_score": pa.array(sums(base)), "score": pa.array(sums(log_p[bigrams.of_token])),
        })

    asked = texts.groupBy("chunk").applyInArrow(ask, SENT_DDL)
    counted = asked.groupBy("block").cogroup(table.select("block", "words", "counts").groupBy("block")).applyInArrow(answer_counts, SENT_DDL)
    paired = texts.groupBy("chunk").cogroup(counted.groupBy("chunk")).applyInArrow(send, SENT_DDL).groupBy("block").applyInArrow(lambda part: merge_bigrams(part, unigrams), SENT_DDL)
    out = texts.groupBy("chunk").cogroup(counted.unionByName(paired).groupBy("chunk")).applyInArrow(
        evaluate, "id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    )
    return out.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")

"""Packing documents into sequences by the histogram of their lengths, shortest pack first.

A document is its token ids followed by ``END``. It is cut into full sequences and a rest,
so that each id lies in exactly one piece, and the lengths of all pieces are counted. The
histogram, one count per possible length, is all that the driver packs: lengths are placed
longest first, each into the pack that is shortest so far, and equal packs are one pattern
with a count, so the work depends on the number of lengths and patterns, not of documents.
A length that no pack has room for opens as many packs as it fills by itself.

Patterns come back to documents by rank. Pieces of one length are numbered from 0 (number
within the writing task plus the counts of the tasks before it, so no length meets in one
task), the places of a length are numbered in the same way, and both join on (length, rank),
a key that occurs once on either side.

A null or empty text is the id ``END`` alone. Equal rows are packed one by one, null ids
are documents like others, other columns are not read, an empty table gives an empty
result. Texts of any length are tokenized whole; words are told apart by a 64-bit hash
within a process and each distinct one is tokenized once.
"""

from __future__ import annotations

import heapq
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from punctual.llm.words import BLANK, LOWER, Words, pieces, runs, split
from punctual.session import cut_lineage

CAPACITY, END = 4096, 2
#: Distinct snippets that a worker process remembers; beyond it starts anew.
REMEMBERED = 1_000_000
#: Places that one row of a run is spread into at most.
SPAN = 1 << 16


#: Letters, digits and other marks of ASCII; 0 for what is never cut off: blanks, "|" (special tokens hold it) and other bytes.
KINDS = np.zeros(256, np.uint8)
KINDS[33:127], KINDS[48:58], KINDS[65:91], KINDS[97:123], KINDS[ord("|")] = 3, 2, 1, 1, 0


def snippets(data: np.ndarray, edges: np.ndarray) -> Words:
    """Words cut where letters, digits and marks meet: the vocabulary never joins these, except an apostrophe to the letters after it."""
    if not len(data):
        return split(data, edges)
    inside, kind = ~BLANK[data], KINDS[data]
    change = (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0) & ~((data[:-1] == 39) & (kind[1:] == 1))
    start = inside.copy()
    start[1:] &= ~inside[:-1] | change
    begins = edges[:-1][edges[:-1] < edges[1:]]
    start[begins] = inside[begins]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | start[1:]
    at = np.flatnonzero(start)
    return Words(data, edges, at, np.flatnonzero(last) + 1, np.searchsorted(at, edges))


class Tokens:
    """Ids of many texts at once; each distinct snippet is encoded once."""

    def __init__(self, path: str | None):
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        self.slot: dict[int, int] = {}
        self.first, self.size, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def learn(self, hashes: list[int], words: list[str]) -> None:
        got = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        self.slot.update(zip(hashes, range(len(self.size), len(self.size) + len(got)), strict=True))
        self.first = np.r_[self.first, len(self.pool) + np.cumsum(sizes) - sizes]
        self.size = np.r_[self.size, sizes]
        self.pool = np.r_[self.pool, np.fromiter(chain.from_iterable(got), np.uint32, sizes.sum())]

    def encode(self, data: np.ndarray, edges: np.ndarray) -> dict[str, np.ndarray]:
        """The ids of all texts in a row, each closed by ``END``, and how many each text has."""
        raw = data.tobytes()
        # the vocabulary is in lower case, but special tokens are not looked for in capitals
        w = snippets(data if b"<|" in raw else LOWER[data], edges)
        distinct, where, inverse = np.unique(w.hashes(), return_index=True, return_inverse=True)
        if len(self.slot) > REMEMBERED:
            self.forget()
        names = distinct.tolist()
        new = [i for i, h in enumerate(names) if h not in self.slot]
        if new:
            spans = zip(w.start[where[new]].tolist(), w.end[where[new]].tolist(), strict=True)
            self.learn([names[i] for i in new], [raw[a:b].decode() for a, b in spans])
        slots = np.array([self.slot[h] for h in names], np.int64)[inverse] if names else np.zeros(0, np.int64)
        size, first = self.size[slots], self.first[slots]
        before = np.r_[0, np.cumsum(size)]
        owner = w.owner()
        n = before[w.first[1:]] - before[w.first[:-1]] + 1
        at = np.repeat(first - before[:-1], size) + np.arange(before[-1])
        ids = np.full(n.sum(), END, np.uint32)
        ids[np.arange(before[-1]) + np.repeat(owner, size)] = self.pool[at]
        return {"ids": ids, "n": n}


def tokens_of(path: str | None) -> Tokens:
    """The process's own: functions are shipped by value, so what outlives a task hangs on the installed library."""
    import tokenizers

    known = tokenizers.__dict__.setdefault("_punctual_tokens", {})
    if path not in known:
        known[path] = Tokens(path)
    return known[path]


def cut_documents(docs: DataFrame, id_col: str, text_col: str, tokenizer: str | None, capacity: int, with_ids: bool) -> DataFrame:
    """Pieces of all documents, the writing task and their number among its pieces of that length."""
    kind = docs.schema[id_col].dataType
    schema = T.StructType([
        T.StructField("id", kind), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("ids_crc32", T.LongType()),
        T.StructField("doc_tokens", T.LongType()), T.StructField("task", T.IntegerType()), T.StructField("nr", T.LongType()),
    ])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, seen = tokens_of(tokenizer), np.zeros(capacity + 1, np.int64)
        task = TaskContext.get().partitionId()
        for batch in batches:
            for lo, hi, data, edges in pieces(batch.column(1)):
                got = tokens.encode(data, edges)
                n, ids = got["n"], got["ids"].astype("<u4", copy=False)
                count = -(-n // capacity)
                owner = np.repeat(np.arange(hi - lo), count)
                start = (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)) * capacity
                length = np.minimum(n[owner] - start, capacity)
                at = (np.cumsum(n) - n)[owner] + start
                parts = [ids[a : a + k].tobytes() for a, k in zip(at.tolist(), length.tolist(), strict=True)]
                # number within the length, in order of the batch
                order = np.argsort(length, kind="stable")
                begins = runs(length[order])
                nr = np.empty(len(length), np.int64)
                nr[order] = np.arange(len(length)) - np.repeat(begins, np.diff(np.r_[begins, len(length)])) + seen[length[order]]
                seen += np.bincount(length, minlength=capacity + 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo).take(pa.array(owner)), pa.array(start), pa.array(length), pa.array(parts if with_ids else [None] * len(parts), pa.binary()), pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                     pa.array(n[owner]), pa.array(np.full(len(owner), task, np.int32)), pa.array(nr)],
                    names=schema.names,
                )

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")).mapInArrow(work, schema)


@dataclass
class Pattern:
    """``count`` packs that hold pieces of the same lengths."""

    count: int
    lengths: tuple[int, ...] = field(default=())

    @property
    def total(self) -> int:
        return sum(self.lengths)


def shortest_pack_first(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Packs for the counted lengths, as patterns with counts, fullest first."""
    # packs by their total: (count, linked lengths)
    open_packs: dict[int, list[tuple[int, tuple]]] = {}
    totals: list[int] = []

    def put(total: int, count: int, lengths: tuple) -> None:
        if total not in open_packs:
            open_packs[total] = []
            heapq.heappush(totals, total)
        open_packs[total].append((count, lengths))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if totals and totals[0] + length <= capacity:
                total = totals[0]
                count, lengths = open_packs[total].pop()
                take = min(count, left)
                if take < count:
                    open_packs[total].append((count - take, lengths))
                if not open_packs[total]:
                    del open_packs[total]
                    heapq.heappop(totals)
                put(total + length, take, (length, lengths))
            else:
                # as many packs as pieces of this length fill by themselves
                take = -(-left // (capacity // length))
                put(length, take, (length, None))
            left -= take
    out = []
    for total in sorted(open_packs, reverse=True):
        for count, linked in open_packs[total]:
            lengths = []
            while linked is not None:
                lengths.append(linked[0])
                linked = linked[1]
            out.append(Pattern(count, tuple(reversed(lengths))))
    return out


def runs_of(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int]]:
    """(length, rank, n, sequence_id, offset): n pieces of a length, from a rank on, go to consecutive sequences."""
    used: dict[int, int] = {}
    out, base = [], 0
    for p in patterns:
        at = 0
        for length in p.lengths:
            out.append((length, used.get(length, 0), p.count, base, at))
            used[length] = used.get(length, 0) + p.count
            at += length
        base += p.count
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """One row per piece: its document's id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``, and ``ids``.

    ``ids`` are little-endian unsigned 32-bit numbers; without ``with_ids`` they are left out
    and do not cross a shuffle. ``tokenizer`` is the path of a vocabulary file, by default the
    public one that is installed. Pieces are written once, so places are given to what was read.
    """
    spark = docs.sparkSession
    found = cut_lineage(cut_documents(docs, id_col, text_col, tokenizer, capacity, with_ids))
    per_task = found.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    # at most one row per possible length
    histogram = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    known = runs_of(shortest_pack_first(histogram, capacity))
    columns = list(zip(*known, strict=True)) or [[]] * 5
    run = spark.createDataFrame(pa.table({name: pa.array(c, pa.int64()) for name, c in zip(("length", "rank", "n", "sequence_id", "offset"), columns, strict=True)}))
    spread = run.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(SPAN))).alias("_from")).repartition("length", "rank", "_from")
    places = spread.withColumn("_i", F.explode(F.sequence("_from", F.least(F.col("_from") + SPAN, "n") - 1))).select(
        "length", (F.col("rank") + F.col("_i")).alias("rank"), (F.col("sequence_id") + F.col("_i")).alias("sequence_id"), "offset"
    )
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = per_task.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_first"))
    ranked = found.join(first, ["task", "length"]).withColumn("rank", F.col("_first") + F.col("nr"))
    ids = ["ids"] if with_ids else []
    return ranked.join(places, ["length", "rank"]).select(F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *ids)


def padded_to(length: Column, capacity: int = CAPACITY) -> Column:
    """What a sequence is filled up to: nothing is added at a power of two."""
    return F.when(F.bit_count(length) == 1, length).otherwise(F.lit(capacity))


def sequences(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The sequences of :func:`pack`: ids of their pieces one after the other, length, number of pieces and what they are padded to.

    A sequence holds at most ``capacity`` ids, so its group is bounded.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    whole = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.count(F.lit(1)).alias("n_pieces"), parts.alias("_parts"))
    return whole.select("sequence_id", "length", "n_pieces", padded_to(F.col("length"), capacity).alias("padded_to"), F.unhex(F.array_join("_parts.ids", "")).alias("ids"))

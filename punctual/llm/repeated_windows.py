"""Substring dedup: windows of words that stood earlier, found behind a count-min prefilter.

A window is ``width`` consecutive words of one document. Documents are dealt into chunks;
every chunk adds its windows to a count-min sketch of ``DEPTH`` rows whose cells are dealt
into blocks. Blocks of all chunks are merged, and each chunk learns which of its cells
count two or more; a window is suspected when all its rows say so, which loses none that
repeats. Only suspected windows are then grouped exactly, by 128 bits of their word
sequence; of each, one row per chunk is sent and the earliest (least id, then position) of
all is found. Words covered by any other window are removed.

Number and width of sketch cells follow the bytes of the input; a window that is repeated
everywhere is one entry per chunk. Everything is one plan, whose text exchange is shared
by its three passes, so lost executors only cost the lost tasks.

A null or blank text has no words; a null id counts as later than any other; rows that
share an id are ordered by their text, and of equal rows one counts as first. Other
columns are not touched; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctual.llm.packing import planes, unplanes
from punctual.llm.words import BACK, STEP, mix, pieces, powers, split

WIDTH, DEPTH = 20, 2
CHUNK_BYTES, BLOCK_CELLS = 8 << 20, 1 << 26
U64, LAST = np.uint64, np.iinfo(np.int64).max


class Chunk:
    """The documents of a chunk in order, and the two hashes of each of their windows."""

    def __init__(self, table: pa.Table, width: int):
        ids, texts = table.column("id").to_pylist(), table.column("text").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i] or ""))
        self.ids = [ids[i] for i in order]
        texts = [(texts[i] or "") for i in order]
        first, second, whose, place, self.words, counted = [], [], [], [], [], 0
        for lo, hi, data, edges in pieces(pa.array(texts, pa.large_string())):
            w = split(data, edges)
            h = w.hashes()
            steps, back = powers(STEP, len(h) + 1), powers(BACK, len(h) + 1)
            size = np.repeat(w.counts, w.counts)
            at = np.arange(len(h)) - np.repeat(w.first[:-1], w.counts)
            starts = np.flatnonzero(at + width <= size)
            for salt, out in ((21, first), (22, second)):
                sums = np.zeros(len(h) + 1, U64)
                np.cumsum(mix(h, salt) * steps[:-1], out=sums[1:])
                out.append(mix((sums[starts + width] - sums[starts]) * back[starts], salt))
            whose.append(w.owner()[starts] + lo)
            place.append(starts + counted)
            counted += len(h)
            self.words += [data[edges[d] : edges[d + 1]].tobytes() for d in range(hi - lo)]
        none = np.zeros(0, np.int64)
        self.h1, self.h2 = (np.concatenate(x) if x else np.zeros(0, U64) for x in (first, second))
        self.doc, self.at = (np.concatenate(x) if x else none for x in (whose, place))
        self.n_words = counted

    def keys(self) -> np.ndarray:
        return np.array([LAST if i is None else i for i in self.ids], np.int64)


class Sketch:
    """Cells of one count-min row, dealt into blocks."""

    def __init__(self, total_bytes: int):
        self.bits = max(16, int(2 * total_bytes).bit_length())
        self.block_bits = max(0, self.bits - BLOCK_CELLS.bit_length() + 1)

    def cells(self, h: np.ndarray, row: int) -> np.ndarray:
        return mix(h, 31 + row) >> U64(64 - self.bits)

    def by_block(self, ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the blocks in sorted cells, and each block's first cell."""
        begins = np.arange((1 << self.block_bits) + 1, dtype=U64) << U64(self.bits - self.block_bits)
        return np.searchsorted(ordered, begins), begins


def send_cells(chunk: Chunk, number: int, sketch: Sketch) -> pa.Table:
    """A chunk's part of the sketch: per row and block its cells, twice where they count twice or more."""
    rows = []
    for row in range(DEPTH):
        cells = np.sort(sketch.cells(chunk.h1, row))
        if len(cells) > 2:
            cells = cells[np.r_[True, True, cells[2:] != cells[:-2]]]
        at, begins = sketch.by_block(cells)
        for b in np.flatnonzero(np.diff(at)):
            part = cells[at[b] : at[b + 1]] - begins[b]
            rows.append((number, row, int(b), planes(np.diff(part, prepend=U64(0)), "<u4")))
    return pa.table(dict(zip(("chunk", "row", "block", "packed"), zip(*rows, strict=True) if rows else ([],) * 4, strict=True)), schema=SENT)


SENT = pa.schema([("chunk", pa.int32()), ("row", pa.int32()), ("block", pa.int32()), ("packed", pa.binary())])
SENT_DDL = "chunk int, row int, block int, packed binary"


def merge_cells(part: pa.Table, sketch: Sketch) -> pa.Table:
    """Add up a block over all chunks; each gets back which of its cells count two or more."""
    counts = np.zeros(1 << (sketch.bits - sketch.block_bits), np.uint8)
    sent = []
    for packed in part.column("packed").to_pylist():
        cells = np.cumsum(unplanes(packed, "<u4").astype(np.int64))
        new = np.r_[True, cells[1:] != cells[:-1]]
        cells = cells[new]
        counts[cells] = np.minimum(counts[cells] + np.diff(np.r_[np.flatnonzero(new), len(new)]), 2)
        sent.append(cells)
    bits = [np.packbits(counts[cells] >= 2).tobytes() for cells in sent]
    return part.set_column(3, SENT.field(3), pa.array(bits, pa.binary()))


def by_order(table: pa.Table, row: int) -> dict[int, bytes]:
    return {b: p for r, b, p in zip(*(table.column(c).to_pylist() for c in ("row", "block", "packed")), strict=True) if r == row}


def unpack(bounds: np.ndarray, answers: dict[int, bytes], n: int) -> np.ndarray:
    out = np.zeros(n, bool)
    for b in np.flatnonzero(np.diff(bounds)):
        size = int(bounds[b + 1] - bounds[b])
        out[bounds[b] : bounds[b + 1]] = np.unpackbits(np.frombuffer(answers[int(b)], np.uint8), count=size).astype(bool)
    return out


def suspected(chunk: Chunk, answers: pa.Table, sketch: Sketch) -> np.ndarray:
    """Windows whose estimated count is two or more."""
    out = np.ones(len(chunk.h1), bool)
    for row in range(DEPTH):
        cells = sketch.cells(chunk.h1, row)
        order = np.argsort(cells)
        new = np.r_[True, cells[order][1:] != cells[order][:-1]] if len(cells) else np.zeros(0, bool)
        distinct = cells[order][new]
        twice = unpack(sketch.by_block(distinct)[0], by_order(answers, row), len(distinct))
        out[order] &= twice[np.cumsum(new) - 1]
    return out


def firsts(chunk: Chunk, rows: np.ndarray) -> np.ndarray:
    """Of the given windows the earliest of each word sequence, ordered by hash."""
    order = rows[np.lexsort((rows, chunk.h2[rows], chunk.h1[rows]))]
    a, b = chunk.h1[order], chunk.h2[order]
    return order[np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]] if len(order) else order


def block_bounds(h1: np.ndarray, sketch: Sketch) -> np.ndarray:
    top = np.arange(1 << sketch.block_bits, dtype=U64) << U64(64 - sketch.block_bits) if sketch.block_bits else np.zeros(1, U64)
    return np.r_[np.searchsorted(h1, top), len(h1)]


def send_windows(chunk: Chunk, number: int, answers: pa.Table, sketch: Sketch) -> pa.Table:
    first = firsts(chunk, np.flatnonzero(suspected(chunk, answers, sketch)))
    ids = chunk.keys()[chunk.doc[first]] if len(first) else np.zeros(0, np.int64)
    at, rows = block_bounds(chunk.h1[first], sketch), []
    for b in np.flatnonzero(np.diff(at)):
        part = slice(at[b], at[b + 1])
        packed = [planes(chunk.h1[first[part]], "<u8"), planes(chunk.h2[first[part]], "<u8"), planes(ids[part], "<i8"), planes(first[part], "<u4")]
        rows.append((number, DEPTH, int(b), b"".join(packed)))
    return pa.table(dict(zip(("chunk", "row", "block", "packed"), zip(*rows, strict=True) if rows else ([],) * 4, strict=True)), schema=SENT)


def merge_windows(part: pa.Table) -> pa.Table:
    """Per entry of each chunk whether it is the earliest of its word sequence."""
    columns: list[list[np.ndarray]] = [[], [], [], []]
    sizes = []
    for packed in part.column("packed").to_pylist():
        n, at = len(packed) // 28, 0
        sizes.append(n)
        for column, kind in zip(columns, ("<u8", "<u8", "<i8", "<u4"), strict=True):
            column.append(unplanes(packed[at : at + n * np.dtype(kind).itemsize], kind))
            at += n * np.dtype(kind).itemsize
    h1, h2, ids, at = (np.concatenate(c) for c in columns)
    order = np.lexsort((at, ids, h2, h1))
    new = np.r_[True, (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])]
    first = np.zeros(len(order), bool)
    first[order[new]] = True
    bits = [np.packbits(x).tobytes() for x in np.split(first, np.cumsum(sizes)[:-1])]
    return part.set_column(3, SENT.field(3), pa.array(bits, pa.binary()))


def cover(chunk: Chunk, answers: pa.Table, sketch: Sketch, width: int) -> np.ndarray:
    """Per word of the chunk whether a window that stood earlier covers it."""
    rows = np.flatnonzero(suspected(chunk, answers, sketch))
    first = firsts(chunk, rows)
    earliest = first[unpack(block_bounds(chunk.h1[first], sketch), by_order(answers, DEPTH), len(first))]
    repeated = np.zeros(len(chunk.h1), bool)
    repeated[rows] = True
    repeated[earliest] = False
    change = np.zeros(chunk.n_words + 1, np.int64)
    starts = chunk.at[repeated]
    change[starts] += 1
    np.subtract.at(change, starts + width, 1)
    return np.cumsum(change[:-1]) > 0


def remove(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """Per row its id, words, removed words, the words that are left joined by blanks (if wanted), and their hash."""
    size = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    sketch, chunks = Sketch(size), max(1, -(-size // CHUNK_BYTES))
    texts = docs.select(F.pmod(F.xxhash64(id_col), F.lit(chunks)).cast("int").alias("chunk"), F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))

    def cells(key: tuple, part: pa.Table) -> pa.Table:
        return send_cells(Chunk(part, width), key[0].as_py(), sketch)

    def windows(key: tuple, part: pa.Table, answers: pa.Table) -> pa.Table:
        return send_windows(Chunk(part, width), key[0].as_py(), answers, sketch)

    def kept(key: tuple, part: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = Chunk(part, width)
        gone = cover(chunk, answers, sketch, width)
        n, removed, left, at = [], [], [], 0
        for text in chunk.words:
            words = text.split()
            mask = gone[at : at + len(words)]
            at += len(words)
            n.append(len(words))
            removed.append(int(mask.sum()))
            left.append(b" ".join([w for w, m in zip(words, mask.tolist(), strict=True) if not m] if removed[-1] else words))
        return pa.table({
            "id": pa.array(chunk.ids, pa.int64()), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
            "kept": pa.array(left, pa.binary()).cast(pa.string()) if with_text else pa.nulls(len(left), pa.string()), "kept_sha256": [hashlib.sha256(x).hexdigest() for x in left],
        })

    counted = texts.groupBy("chunk").applyInArrow(cells, SENT_DDL).groupBy("row", "block").applyInArrow(lambda part: merge_cells(part, sketch), SENT_DDL)
    exact = texts.groupBy("chunk").cogroup(counted.groupBy("chunk")).applyInArrow(windows, SENT_DDL).groupBy("block").applyInArrow(merge_windows, SENT_DDL)
    out = texts.groupBy("chunk").cogroup(counted.unionByName(exact).groupBy("chunk")).applyInArrow(kept, "id bigint, n_words bigint, n_removed bigint, kept string, kept_sha256 string")
    return out.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "n_words", "n_removed", *["kept"][: int(with_text)], "kept_sha256")

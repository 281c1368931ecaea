"""Words of many texts at once: numpy kernels over the UTF-8 bytes of an Arrow batch.

A word is a maximal run of bytes outside a separator table, by default the six ASCII
blanks. All kernels work on *pieces*, consecutive texts of a batch of about ``PIECE``
bytes (one longer text is a piece of its own), so memory does not grow with the batch.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

PIECE = 1 << 21


def table(characters: bytes) -> np.ndarray:
    flags = np.zeros(256, bool)
    flags[np.frombuffer(characters, np.uint8)] = True
    return flags


BLANK = table(b"\x20\x09\x0a\x0b\x0c\x0d")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
BACK = np.uint64(pow(int(STEP), -1, 1 << 64))
CODES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64)


class Local(dict):
    """What a process has worked out; tasks that are sent elsewhere leave it behind."""

    def __reduce__(self):
        return Local, ()


_powers: dict[int, np.ndarray] = Local()


def powers(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if len(have) <= 4 * PIECE:
            _powers[int(base)] = have
    return have[:n]


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit values (splitmix64), another one per salt."""
    h = h + np.uint64((salt * 0xD1342543DE82EF95 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """Words of the texts of one piece; ``first[d]:first[d + 1]`` are those of text ``d``."""

    data: np.ndarray
    edges: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def texts(self) -> int:
        return len(self.edges) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(self.texts), self.counts)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word, equal for equal words wherever they stand."""
        return span_hashes(LOWER[self.data] if lower else self.data, self.start, self.end)

    def text(self, d: int) -> str:
        return self.data[self.edges[d] : self.edges[d + 1]].tobytes().decode("utf-8", "replace")


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(CODES[data] * powers(STEP, len(data)), out=sums[1:])
    return mix((sums[end] - sums[start]) * powers(BACK, len(data) + 1)[start])


def span_sums(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[end] - sums[start]


def split(data: np.ndarray, edges: np.ndarray, separator: np.ndarray = BLANK) -> Words:
    inside = ~separator[data]
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, edges, none, none, np.zeros(len(edges), np.int64))
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    begins = edges[:-1][edges[:-1] < edges[1:]]
    start[begins] = inside[begins]
    closes = edges[1:][edges[:-1] < edges[1:]] - 1
    end[closes] = inside[closes]
    at = np.flatnonzero(start)
    return Words(data, edges, at, np.flatnonzero(end) + 1, np.searchsorted(at, edges))


def raw(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (null: none) and the offsets between them."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.large_string())
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    edges = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, edges - edges[0]


def pieces(texts: pa.Array | pa.ChunkedArray, size: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, one past the last, bytes, offsets) of each piece."""
    data, edges = raw(texts)
    lo, n = 0, len(edges) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + size, "right")) - 1)
        yield lo, hi, data[edges[lo] : edges[hi]], edges[lo : hi + 1] - edges[lo]
        lo = hi


def per_text(texts: pa.Array, kernel: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """The columns that ``kernel`` gives for each piece, put together."""
    parts = [kernel(data, edges) for _, _, data, edges in pieces(texts)] or [kernel(np.zeros(0, np.uint8), np.zeros(1, np.int64))]
    return {name: np.concatenate([p[name] for p in parts]) for name in parts[0]}


def fold(ids: pa.Array, modulus: int, remainder: int) -> np.ndarray:
    """Rows whose crc32 of the id as text leaves ``remainder``; a null id never does."""
    return np.array([i is not None and zlib.crc32(str(i).encode()) % modulus == remainder for i in ids.to_pylist()], bool)


def runs(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal neighbours begins."""
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)


def map_batches(df: DataFrame, schema: str, columns: Callable[[pa.RecordBatch], dict]) -> DataFrame:
    """One output batch per input batch, from the columns that the function returns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = to_arrow_schema(StructType.fromDDL(schema))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = columns(batch)
            yield pa.RecordBatch.from_arrays(
                [a if isinstance(a := got[f.name], pa.Array) and a.type == f.type else pa.array(a, f.type) if not isinstance(a, pa.Array) else a.cast(f.type) for f in kind], schema=kind
            )

    return df.mapInArrow(work, schema)


def keep_batches(df: DataFrame, wanted: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """The rows, with all their columns, for which the function gives true."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(wanted(batch), pa.bool_()))

    return df.mapInArrow(work, df.schema)

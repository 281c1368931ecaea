"""Collocations of two to five words, found as SETM finds itemsets: by relations of occurrences.

Texts are cut at punctuation and line ends into pieces and at blanks into words; counts are
per language. The words stand in chunks of whole pieces, and a chunk's relation R1 has one
entry per word, sorted by place (places of different pieces are not adjacent). Step k reads
R(k), semi-joins it with the groups that are frequent, merge-joins the sorted rest with
itself on the next place, and stores what comes out as R(k + 1). A group of R(k + 1) is a
pair of groups of R(k), all but the last and all but the first word, so names are exact:
words are counted by their text and longer phrases by such pairs. Relations are stored as
packed columns per chunk; chunks send one row per distinct group to be counted, and frequent
groups, named by the first chunk and number that has them, go back to the chunks that have
them. A group's counts, parts and words are put together from its pair.

A candidate's cut after k words compares its count a with the counts l and r of both parts;
score = floor(1000 a n / (l r)) for n words of the language, in decimals of 38 digits
(exact for up to 10^14 words a language). The lowest-scoring cut counts, the first one at
a tie. Candidates that lie inside a longer one that occurs at least ``ABSORBED`` percent as
often go; one word more is enough to look at, since what holds for a longer one holds for
the phrases between.

Null texts are empty, a null language is ``und``, repeated rows and ids count each time,
other columns are not read, an empty table gives an empty result. A chunk is cut between
pieces; only a single piece can be larger than ``CHUNK_BYTES``, and it is read whole.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from punctual.llm.packing import planes, unplanes
from punctual.llm.words import LOWER, pieces, span_hashes, split, table
from punctual.session import run_folder

LONGEST, FREQUENT, ABSORBED, TOP = 5, 100, 100, 2000
#: Bytes of text of a chunk, of all chunks that a task has open, and rows that it looks at together.
CHUNK_BYTES, OPEN_BYTES, ROWS = 6 << 20, 24 << 20, 256
#: What ends a piece, and what parts words within one.
STOPS, SPACES = table(b".,;:!?\x0a\x0b\x0c\x0d"), table(b"\x20\x09")
#: A group's name is its chunk and its number there; a chunk's is its task and its number there.
NUMBER_BITS, CHUNK_BITS = 26, 17
COUNT = "decimal(14,0)"
#: Shuffle files go when the job that wrote them has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: ``at``: gaps between places; ``of``: numbers of the groups there; one entry of the arrays per distinct group.
WORDS = "chunk bigint, lang string, at binary, of binary, words array<binary>, counts array<bigint>"
PHRASES = "chunk bigint, lang string, at binary, of binary, heads array<bigint>, tails array<bigint>, counts array<bigint>"


class Store:
    """Relations as tables in the shared folder; those that no later step reads are removed."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, str] = {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = run_folder(self.spark, name)
        # what a stored relation was shuffled through is not read again
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(CLEANUP)
            else:
                self.spark.conf.set(CLEANUP, before)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(table)] = path
        return table

    def remove(self, *tables: DataFrame) -> None:
        for table in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(table)))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def places(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and place of each word; the words of a piece have consecutive places, pieces lie apart."""
    w = split(data, edges, STOPS | SPACES)
    stops = np.cumsum(STOPS[data])
    before = np.r_[0, stops][w.start]
    owner = w.owner()
    apart = np.r_[False, (before[1:] != before[:-1]) | (owner[1:] != owner[:-1])] if len(before) else np.zeros(0, bool)
    return w.start, w.end, np.arange(len(before)) + np.cumsum(apart)


class Collected:
    """Words of one language until they are a chunk."""

    def __init__(self):
        self.hashes, self.at, self.end, self.size = [], [], 0, 0
        self.texts: dict[int, bytes] = {}

    def add(self, data: np.ndarray, edges: np.ndarray) -> None:
        start, end, at = places(data, edges)
        self.size += len(data)
        if not len(at):
            return
        h = span_hashes(data, start, end)
        distinct, first = np.unique(h, return_index=True)
        raw = data.tobytes()
        for x, a, b in zip(distinct.tolist(), start[first].tolist(), end[first].tolist(), strict=True):
            if x not in self.texts:
                self.texts[x] = raw[a:b]
        self.hashes.append(h)
        self.at.append(at + self.end)
        self.end += int(at[-1]) + 2

    def relation(self, chunk: int, lang: str) -> pa.RecordBatch:
        h, at = np.concatenate(self.hashes), np.concatenate(self.at)
        distinct, of, counts = np.unique(h, return_inverse=True, return_counts=True)
        words = [self.texts[x] for x in distinct.tolist()]
        columns = [pa.array([chunk]), pa.array([lang]), pa.array([packed_gaps(at)], pa.binary()), pa.array([planes(of, "<u4")], pa.binary()), listed(words, pa.binary()), listed(counts, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["chunk", "lang", "at", "of", "words", "counts"])


def listed(values, kind: pa.DataType) -> pa.Array:
    """All values as the one cell of an array column."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


def packed_gaps(at: np.ndarray) -> bytes:
    return planes(np.diff(at, prepend=0), "<u4")


def unpacked_gaps(packed: bytes) -> np.ndarray:
    return np.cumsum(unplanes(packed, "<u4").astype(np.int64))


def word_relations(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """R1: chunks of each task's texts by language."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        open_chunks: dict[str, Collected] = defaultdict(Collected)

        def close(lang: str) -> Iterator[pa.RecordBatch]:
            nonlocal number
            words = open_chunks.pop(lang)
            if words.hashes:
                if number >> CHUNK_BITS:
                    raise ValueError("a task has too many chunks: read the table in more partitions")
                yield words.relation(task << CHUNK_BITS | number, lang)
                number += 1
                pa.default_memory_pool().release_unused()

        for whole in batches:
            for batch in (whole.slice(lo, ROWS) for lo in range(0, whole.num_rows, ROWS)):
                langs = np.array([x if x is not None else "und" for x in batch.column(1).to_pylist()], object)
                for lang in dict.fromkeys(langs.tolist()):
                    for _, _, data, edges in pieces(batch.column(0).filter(pa.array(langs == lang))):
                        for part, bounds in cut_long(LOWER[data], edges):
                            open_chunks[lang].add(part, bounds)
                            if open_chunks[lang].size >= CHUNK_BYTES:
                                yield from close(lang)
                # a table of very many languages closes its largest chunks early
                while sum(c.size for c in open_chunks.values()) > OPEN_BYTES:
                    yield from close(max(open_chunks, key=lambda x: open_chunks[x].size))
        for lang in list(open_chunks):
            yield from close(lang)

    return docs.select(F.col(f"`{text_col}`").cast("string"), F.col(f"`{lang_col}`").cast("string")).mapInArrow(work, WORDS)


def cut_long(data: np.ndarray, edges: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A text above the chunk size in parts that end where a piece ends."""
    if len(data) <= CHUNK_BYTES:
        yield data, edges
        return
    lo, stops = 0, np.flatnonzero(STOPS[data])
    while lo < len(data):
        at = np.searchsorted(stops, lo + CHUNK_BYTES)
        hi = int(stops[at]) + 1 if at < len(stops) else len(data)
        inner = edges[(edges > lo) & (edges < hi)] - lo
        yield data[lo:hi], np.r_[0, inner, hi - lo]
        lo = hi


def frequent(relation: DataFrame, keys: dict[str, str], least: int) -> DataFrame:
    """The semi-join's other side: (chunk, name, ``keys``, a) of the groups that are frequent, a row per chunk that has the group.

    ``name`` is the group's own in that chunk; ``gid``, the least name of all chunks, is the same everywhere.
    """
    cells = F.posexplode(F.arrays_zip(*keys, "counts"))
    # the parts of a phrase are of one language already
    lang = ["lang"] if "words" in keys else []
    rows = relation.select("chunk", *lang, cells.alias("_nr", "_cell")).select(
        *lang, (F.shiftleft("chunk", NUMBER_BITS) + F.col("_nr")).alias("name"), *[F.col("_cell")[many].alias(one) for many, one in keys.items()], F.col("_cell")["counts"].alias("_n")
    )
    group = Window.partitionBy(*lang, *keys.values())
    counted = rows.withColumns({"a": F.sum("_n").over(group), "gid": F.min("name").over(group)}).where(F.col("a") >= least)
    return counted.select(*lang, "name", "gid", "a", *keys.values())


def extended(relation: DataFrame, known: DataFrame) -> DataFrame:
    """R(k + 1): what is frequent in R(k), joined with what stands at the next place."""
    names = ["chunk", "lang", "at", "of", "heads", "tails", "counts"]

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = [pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64())]
        none = pa.table([pa.array([], k) for k in kinds], names=names)
        if not left.num_rows or not right.num_rows:
            return none
        at, of = unpacked_gaps(left.column("at")[0].as_py()), unplanes(left.column("of")[0].as_py(), "<u4")
        number = right.column("name").to_numpy() & ((1 << NUMBER_BITS) - 1)
        name = np.full(max(int(number.max()), int(of.max())) + 1, -1, np.int64)
        name[number] = right.column("gid").to_numpy()
        gid = name[of]
        at, gid = at[gid >= 0], gid[gid >= 0]
        first = np.flatnonzero(at[1:] == at[:-1] + 1)
        if not len(first):
            return none
        distinct, short = np.unique(gid, return_inverse=True)
        pairs, of, counts = np.unique(short[first] * np.int64(len(distinct)) + short[first + 1], return_inverse=True, return_counts=True)
        if len(pairs) >> NUMBER_BITS:
            raise ValueError("a piece has too many phrases")
        heads, tails = np.divmod(pairs, len(distinct))
        columns = [left.column("chunk")[:1].combine_chunks(), left.column("lang")[:1].combine_chunks(), pa.array([packed_gaps(at[first])], pa.binary()), pa.array([planes(of, "<u4")], pa.binary())]
        return pa.table([*columns, *(listed(x, pa.int64()) for x in (distinct[heads], distinct[tails], counts))], names=names)

    groups = known.select(F.shiftright("name", NUMBER_BITS).alias("chunk"), "name", "gid")
    occurrences = relation.select("chunk", "lang", "at", "of")
    return occurrences.groupBy("chunk").cogroup(groups.groupBy("chunk")).applyInArrow(work, PHRASES)


def spelled(groups: DataFrame, shorter: DataFrame) -> DataFrame:
    """(gid, lang, a, words, lefts, rights): counts of the first 1, 2, ... and of the last ..., 2, 1 words, from both parts."""
    head = shorter.select(F.col("gid").alias("head"), "lang", F.col("words").alias("_h"), F.concat("lefts", F.array("a")).alias("lefts"))
    tail = shorter.select(F.col("gid").alias("tail"), F.col("words").alias("_t"), F.concat(F.array("a"), "rights").alias("rights"))
    both = groups.join(head, "head").join(tail, "tail")
    return both.select("gid", "lang", "a", "head", "tail", F.concat("_h", F.slice("_t", -1, 1)).alias("words"), "lefts", "rights")


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = FREQUENT, longest: int = LONGEST, absorbed: int = ABSORBED, top: int = TOP
) -> DataFrame:
    """Each language's first ``top`` phrases: lang, rank, phrase, a, l, r, n, score."""
    store = Store(docs.sparkSession)
    relation = store.keep(word_relations(docs, text_col, lang_col), "setm-words")
    sums = relation.select("lang", F.aggregate("counts", F.lit(0).cast("bigint"), lambda s, c: s + c).alias("n")).groupBy("lang").agg(F.sum("n").alias("n"))
    totals = store.keep(sums, "setm-totals")
    known = store.keep(frequent(relation, {"words": "word"}, least), "setm-frequent")
    none = F.array().cast("array<bigint>")
    first = known.where("name = gid").select("gid", "lang", "a", F.array(F.col("word").cast("string")).alias("words"), none.alias("lefts"), none.alias("rights"))
    levels = [store.keep(first, "setm-phrases")]
    for _ in range(longest - 1):
        longer = store.keep(extended(relation, known), "setm-pairs")
        store.remove(relation, known)
        relation = longer
        known = store.keep(frequent(relation, {"heads": "head", "tails": "tail"}, least), "setm-frequent")
        levels.append(store.keep(spelled(known.where("name = gid").select("gid", "a", "head", "tail"), levels[-1]), "setm-phrases"))
    store.remove(relation, known)
    levels = levels[1:]
    kept = []
    for phrases, longer in zip(levels, [*levels[1:], None], strict=True):
        if longer is not None:
            # what a longer phrase takes in, by either end
            over = longer.select(F.explode(F.array("head", "tail")).alias("gid"), F.col("a").alias("_b")).groupBy("gid").agg(F.max("_b").alias("_b"))
            phrases = phrases.join(over, "gid", "left").where(F.col("_b").isNull() | (F.lit(100) * F.col("_b") < F.lit(absorbed) * F.col("a"))).drop("_b")
        kept.append(phrases)
    whole = kept[0]
    for more in kept[1:]:
        whole = whole.unionByName(more)
    one = whole.join(totals, "lang").withColumn("_top", F.lit(1000).cast("decimal(4,0)") * F.col("a").cast(COUNT) * F.col("n").cast(COUNT))
    scored = one.withColumn("_cuts", F.expr(f"transform(arrays_zip(lefts, rights), (c, i) -> struct(_top div (cast(c.lefts AS {COUNT}) * cast(c.rights AS {COUNT})) AS score, i AS k, c.lefts AS l, c.rights AS r))"))
    best = F.array_min("_cuts")
    phrase = F.array_join("words", " ")
    lowest = scored.select("lang", phrase.alias("phrase"), "a", best["l"].alias("l"), best["r"].alias("r"), "n", best["score"].alias("score"))
    by_lang = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = lowest.withColumn("rank", F.row_number().over(by_lang)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")

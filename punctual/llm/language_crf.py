"""Language identification of code-switched text by a linear-chain conditional random field.

Every word gets a label: weights of its affixes, of its byte trigrams and of its lexicon
entry, and learned transitions between neighbouring labels; forward-backward gives each
word's label distribution, and a document's language is the one with the largest share of
its words, which is the score. The lexicon counts words by language over *all* learned
documents in hashed slots; the other weights are learned from at most ``FIT_DOCS``
documents (an equal quota per language, those with the least id hash, up to
``FIT_CHARS`` characters long), whose words are all labelled with their document's
language. Whole texts of every document are predicted.

Forward-backward runs in segments: products of transition matrices within segments, then
vectors along the segments of a document, then within segments again. This is exact, and
texts of any length step together.

A null text, or one without a letter, is ``und`` with score 0, as is every text when there
is nothing to learn from. A null language is not learned; ties go to the first language in
code point order; equal rows get equal results; a null id stays null and is never held
out; other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from punctual.llm.words import LOWER, Words, fold, keep_batches, map_batches, pieces, split, table

FOLDS, HELD_OUT = 5, 0
FIT_DOCS, FIT_CHARS, EPOCHS, BATCH, STEP, RIDGE = 1200, 20_000, 4, 40, 0.3, 1e-6
GRAMS, AFFIXES, SLOTS, BLOCK = 1 << 15, 1 << 13, 1 << 21, 1 << 12
SEGMENT, KEEP = 32, 0.3
#: What a field learns besides its lexicon.
LEARNED = ("grams", "affixes", "trust", "moves")
LETTER = table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" + bytes(range(0xC3, 0x100)))
ASCII_LETTER = table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")


@dataclass
class Features:
    """Slots of a piece's words: trigrams by byte, four affixes and a lexicon slot by word."""

    words: Words
    grams: np.ndarray
    begins: np.ndarray
    affixes: np.ndarray
    slots: np.ndarray


def slots_for(languages: int) -> int:
    """Lexicon slots: a power of two, at most ``SLOTS`` numbers over all languages."""
    return 1 << max(10, int(np.log2(SLOTS / max(1, languages))) if languages else 10)


def features(data: np.ndarray, edges: np.ndarray, slots: int) -> Features:
    w = split(data, edges)
    low = LOWER[data].astype(np.int64)
    before, after = np.full(len(low), 32), np.full(len(low), 32)
    before[1:], after[:-1] = low[:-1], low[1:]
    full = edges[:-1] < edges[1:]
    before[edges[:-1][full]] = 32
    after[edges[1:][full] - 1] = 32
    inside = np.zeros(len(low) + 1, np.int64)
    inside[w.start] += 1
    inside[w.end] -= 1
    at = np.flatnonzero(np.cumsum(inside[:-1]))
    grams = (before[at] * 7919 + low[at] * 104729 + after[at] * 15485863) % 32749 & (GRAMS - 1)
    length = w.end - w.start
    begins = np.cumsum(length) - length

    def byte(offset: int, back: bool) -> np.ndarray:
        place = w.end - 1 - offset if back else w.start + offset
        return np.where(offset < length, low[np.where(offset < length, place, w.start)], 0)

    affixes = []
    for kind, (back, size) in enumerate(((False, 2), (False, 3), (True, 2), (True, 3))):
        h = np.full(len(length), kind * 977 + 1)
        for offset in range(size):
            h = h * 263 + byte(offset, back) + 1
        affixes.append(h % 8191 & (AFFIXES - 1))
    slot = (w.hashes(lower=True) & np.uint64(slots - 1)).astype(np.int64)
    return Features(w, grams, begins, np.array(affixes).reshape(4, -1), slot)


@dataclass
class Field:
    languages: tuple[str, ...]
    lexicon: np.ndarray
    grams: np.ndarray
    affixes: np.ndarray
    trust: np.ndarray
    moves: np.ndarray

    def emissions(self, f: Features) -> np.ndarray:
        out = np.empty((len(f.slots), len(self.languages)), np.float32)
        for k in range(len(self.languages)):
            by_gram = np.add.reduceat(self.grams[k][f.grams], f.begins) if len(f.slots) else np.zeros(0)
            out[:, k] = by_gram + self.affixes[k][np.arange(4)[:, None], f.affixes].sum(0) + self.trust[0] * self.lexicon[f.slots, k]
        return out


def marginals(emission: np.ndarray, first: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label distribution of each word, and the expected number of moves between labels; documents are ``first[d]:first[d + 1]``."""
    n, k = emission.shape
    if not n:
        return np.zeros((0, k), np.float32), np.zeros((k, k))
    counts = np.diff(first)
    a = np.exp(moves).astype(np.float32)
    per_doc = -(-counts // SEGMENT)
    seg_first = np.r_[0, np.cumsum(per_doc)]
    word = np.arange(n)
    doc = np.repeat(np.arange(len(counts)), counts)
    place = seg_first[doc] * SEGMENT + (word - first[doc])
    b = np.ones((seg_first[-1] * SEGMENT, k), np.float32)
    real = np.zeros(len(b), bool)
    b[place] = np.exp(emission - emission.max(1, keepdims=True)) + np.float32(1e-12)
    real[place] = True
    b, real = b.reshape(-1, SEGMENT, k), real.reshape(-1, SEGMENT)
    segs = len(b)

    def level(x: np.ndarray) -> np.ndarray:
        return x / x.max(axis=tuple(range(1, x.ndim)), keepdims=True)

    product = np.broadcast_to(np.eye(k, dtype=np.float32), (segs, k, k)).copy()
    for t in range(SEGMENT):
        rows = np.flatnonzero(real[:, t])
        if not len(rows):
            break
        product[rows] = level((product[rows].reshape(-1, k) @ a).reshape(-1, k, k) * b[rows, t][:, None, :])
    enter, leave = np.full((segs, k), 1 / k, np.float32), np.ones((segs, k), np.float32)
    for step in range(1, int(per_doc.max())):
        rows = seg_first[:-1][per_doc > step] + step
        enter[rows] = level(np.einsum("si,sij->sj", enter[rows - 1], product[rows - 1]))
        rows = seg_first[1:][per_doc > step] - 1 - step
        leave[rows] = level(np.einsum("sij,sj->si", product[rows + 1], leave[rows + 1]))
    alpha = np.empty((segs, SEGMENT, k), np.float32)
    beta = np.empty_like(alpha)
    now = enter
    for t in range(SEGMENT):
        now = np.where(real[:, t, None], level((now @ a) * b[:, t]), now)
        alpha[:, t] = now
    now = leave
    for t in range(SEGMENT - 1, -1, -1):
        beta[:, t] = now
        now = np.where(real[:, t, None], level((b[:, t] * now) @ a.T), now)
    m = (alpha * beta).reshape(-1, k)[place]
    m /= m.sum(1, keepdims=True)
    # pairs of neighbours within a document
    head = np.flatnonzero(doc[1:] == doc[:-1])
    flat_a, flat_b, flat_e = alpha.reshape(-1, k), beta.reshape(-1, k), b.reshape(-1, k)
    left, right = flat_a[place[head]], (flat_b * flat_e)[place[head + 1]]
    z = np.maximum(((left @ a) * right).sum(1, keepdims=True), 1e-30)
    return m, a * ((left / z).T @ right)


def learn(texts: list[str], labels: np.ndarray, languages: tuple[str, ...], lexicon: np.ndarray) -> Field:
    """Adagrad on the conditional likelihood; each document's words carry its language."""
    k = len(languages)
    field = Field(languages, lexicon, np.zeros((k, GRAMS), np.float32), np.zeros((k, 4, AFFIXES), np.float32), np.full(1, 0.5, np.float32), np.eye(k, dtype=np.float32))
    past = {name: np.full(getattr(field, name).shape, 1e-2, np.float32) for name in LEARNED}
    batches = []
    for lo in range(0, len(texts), BATCH):
        _, _, data, edges = next(pieces(pa.array(texts[lo : lo + BATCH], pa.large_string()), 1 << 62))
        batches.append((features(data, edges, len(lexicon)), labels[lo : lo + BATCH]))
    for _ in range(EPOCHS):
        for f, y in batches:
            if not len(f.slots):
                continue
            m, pairs = marginals(field.emissions(f), f.words.first, field.moves)
            truth = np.repeat(y, f.words.counts)
            error = -m
            error[np.arange(len(m)), truth] += 1
            size, n = f.words.end - f.words.start, len(m)
            slope = {
                "grams": np.array([np.bincount(f.grams, np.repeat(error[:, j], size), minlength=GRAMS) for j in range(k)]) / n,
                "affixes": np.array([[np.bincount(f.affixes[i], error[:, j], minlength=AFFIXES) for i in range(4)] for j in range(k)]) / n,
                "trust": np.array([(error * lexicon[f.slots]).sum() / n]),
            }
            seen = np.zeros((k, k))
            np.add.at(seen, (y, y), np.maximum(f.words.counts - 1, 0))
            slope["moves"] = (seen - pairs) / n
            for name, g in slope.items():
                value = getattr(field, name)
                g = (g - RIDGE * value).astype(np.float32)
                past[name] += g * g
                value += STEP * g / np.sqrt(past[name])
    return field


def count_words(docs: DataFrame, languages: tuple[str, ...], slots: int, text_col: str, lang_col: str) -> np.ndarray:
    """Words by slot and language over all given documents; a task sums up before it sends blocks of slots."""
    place = {name: i for i, name in enumerate(languages)}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), slots), np.int64)
        for batch in batches:
            names = np.array([place.get(x, -1) for x in batch.column(1).to_pylist()])
            for lo, hi, data, edges in pieces(batch.column(0)):
                w = split(data, edges)
                slot = (w.hashes(lower=True) & np.uint64(slots - 1)).astype(np.int64)
                label = np.repeat(names[lo:hi], w.counts)
                for i in np.unique(label[label >= 0]):
                    total[i] += np.bincount(slot[label == i], minlength=slots)
        blocks = total.reshape(len(languages), -1, min(BLOCK, slots))
        i, j = np.nonzero(blocks.any(2))
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array([blocks[x, y].astype("<i8").tobytes() for x, y in zip(i, j, strict=True)], pa.binary())], names=["language", "block", "counts"])

    def add(part: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c, "<i8") for c in part.column("counts").to_pylist())
        return pa.table({"language": part.column("language")[:1], "block": part.column("block")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    kind = "language int, block int, counts binary"
    rows = docs.select(F.col(text_col), F.col(lang_col)).mapInArrow(work, kind).groupBy("language", "block").applyInArrow(add, kind).collect()
    counts = np.zeros((len(languages), slots // min(BLOCK, slots), min(BLOCK, slots)), np.float32)
    for r in rows:
        counts[r["language"], r["block"]] = np.frombuffer(r["counts"], "<i8")
    return counts.reshape(len(languages), slots).T


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Field | None:
    learned = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS != HELD_OUT, F.lit(False)))
    languages = tuple(sorted(r[0] for r in learned.select(F.col(lang_col).alias("lang")).distinct().collect()))
    if not languages:
        return None
    counts = count_words(learned, languages, slots_for(len(languages)), text_col, lang_col)
    rate = (counts + 0.5) / (counts.sum(0) + 0.5 * len(counts))
    lexicon = np.log(rate / rate.mean(1, keepdims=True)).clip(-4, 4).astype(np.float32)
    lexicon[counts.sum(1) == 0] = 0
    by_hash = Window.partitionBy("_lang").orderBy("_h", "_id")
    ids = (
        learned.where(F.length(F.col(text_col)) <= FIT_CHARS)
        .select(F.col(lang_col).alias("_lang"), F.col(id_col).alias("_id"), F.xxhash64(id_col).alias("_h"))
        .withColumn("_rank", F.row_number().over(by_hash)).where(F.col("_rank") <= max(1, FIT_DOCS // len(languages))).select("_id").distinct()
    )
    # at most FIT_DOCS ids; documents that share an id are bounded again
    rows = (
        learned.where(F.length(F.col(text_col)) <= FIT_CHARS).select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).join(F.broadcast(ids), "_id")
        .orderBy(F.xxhash64("_id"), "lang", F.xxhash64("text")).limit(2 * FIT_DOCS).select("text", "lang")
    )
    return learn_in_task(rows, languages, lexicon)


def learn_in_task(rows: DataFrame, languages: tuple[str, ...], lexicon: np.ndarray) -> Field:
    """The field learned from a bounded sample (text, lang) in its order; a task holds the sample and its features, the driver gets the weights."""
    place = {name: i for i, name in enumerate(languages)}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, names = [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            names += batch.column(1).to_pylist()
        field = learn(texts, np.array([place[x] for x in names], np.int64), languages, lexicon)
        yield pa.RecordBatch.from_arrays([pa.array([getattr(field, name).tobytes()], pa.binary()) for name in LEARNED], names=list(LEARNED))

    field = learn([], np.zeros(0, np.int64), languages, lexicon)
    # one partition, in order; a plan that Spark finds empty has none
    got = rows.coalesce(1).mapInArrow(work, ", ".join(f"{name} binary" for name in LEARNED)).first()
    for name in LEARNED if got else ():
        value = getattr(field, name)
        value[:] = np.frombuffer(got[name], value.dtype).reshape(value.shape)
    return field


def predictions(texts: pa.Array, field: Field | None) -> tuple[list[str], np.ndarray]:
    names, scores = [], [np.zeros(0)]
    for lo, hi, data, edges in pieces(texts, 1 << 19):
        if field is None:
            names += ["und"] * (hi - lo)
            scores.append(np.zeros(hi - lo))
            continue
        f = features(data, edges, len(field.lexicon))
        m, _ = marginals(field.emissions(f), f.words.first, field.moves)
        owner, texts_here = f.words.owner(), hi - lo
        sums = np.zeros(len(data) + 1, np.int64)
        np.cumsum(LETTER[data], out=sums[1:])
        worded = sums[f.words.end] > sums[f.words.start]
        shares = np.column_stack([np.bincount(owner[worded], m[worded, j], minlength=texts_here) for j in range(m.shape[1])])
        lettered = np.zeros(len(data) + 1, np.int64)
        np.cumsum(ASCII_LETTER[data], out=lettered[1:])
        known = lettered[edges[1:]] > lettered[edges[:-1]]
        for d in np.flatnonzero(~known & (edges[1:] > edges[:-1])):
            known[d] = any(c.isalpha() for c in f.words.text(d))
        total = shares.sum(1)
        # a letter outside LETTER's bytes alone: all words count
        for d in np.flatnonzero(known & (total == 0)):
            shares[d] = m[f.words.first[d] : f.words.first[d + 1]].sum(0)
        best = shares.argmax(1)
        names += [field.languages[best[d]] if known[d] else "und" for d in range(texts_here)]
        scores.append(np.where(known, np.minimum(1.0, shares.max(1) / np.maximum(shares.sum(1), 1e-12)), 0.0))
    return names, np.concatenate(scores)


def predict(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per document its id, whether it was held out, its language and score."""
    field = field or fit(docs, id_col, text_col, lang_col)

    def columns(batch: pa.RecordBatch) -> dict:
        names, scores = predictions(batch.column(1), field)
        return {id_col: batch.column(0), "held_out": fold(batch.column(0), FOLDS, HELD_OUT), "lang_pred": names, "score": scores}

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(id_col), F.col(text_col)), f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double", columns)


def keep_identified(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = KEEP) -> DataFrame:
    """The rows whose text has a language that holds at least the given share of its words."""
    field = field or fit(docs, id_col, text_col, lang_col)

    def wanted(batch: pa.RecordBatch) -> np.ndarray:
        names, scores = predictions(batch.column(batch.schema.get_field_index(text_col)), field)
        return np.array([n != "und" and s >= least for n, s in zip(names, scores, strict=True)], bool)

    return keep_batches(docs, wanted)

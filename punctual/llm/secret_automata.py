"""Secret scans: patterns for known credentials, and probabilistic automata for their formats.

The patterns find credentials that say what they are (``assign``, ``access``, ``hex``).
Their values are labelled examples. For each kind a prefix tree of example values, written
in character classes, is generalised by merging states whose outgoing statistics agree
within a Hoeffding bound (ALERGIA); two more automata are inferred from ordinary words
and from plain numbers. Every run of at least ``MIN_RUN`` credential characters is then scored by the log
likelihood ratio of the best credential format against the best ordinary one, and those above ``MARGIN``
become ``format`` spans. Base spans are never changed.

Automata are fitted on at most ``EXAMPLES`` distinct values per kind (those with the least
hash) and on their first ``FIT_SYMBOLS`` symbols; statistics of the scan, candidates and
scores cover every whole text. A null text counts as empty, equal rows give equal rows, a
null id stays null, other columns are not touched, an empty table gives an empty result.
Without labelled values no ``format`` span is found.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from punctual.llm.spans import joined, sha256
from punctual.llm.words import map_batches, pieces, runs, span_hashes, span_sums, split, table

KINDS = ("assign", "access", "hex", "format")
MIN_RUN, EXAMPLES, FIT_SYMBOLS, ALPHA, MARGIN = 16, 300, 64, 0.05, 12.0

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
RUN = re.compile(r"[A-Za-z0-9+/_=.-]+")

LETTER = table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
OUTSIDE = ~table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.-")
CLASSES = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+/", "_-", ".", "=")
SYMBOL = np.zeros(128, np.int8)
for _i, _characters in enumerate(CLASSES):
    SYMBOL[[ord(c) for c in _characters]] = _i


@dataclass(frozen=True)
class Automaton:
    """Next state and log probability by state and symbol; the last symbol ends the string."""

    following: np.ndarray
    log_p: np.ndarray


def symbols(value: str) -> np.ndarray:
    return SYMBOL[np.frombuffer(value.encode("ascii"), np.uint8)]


def infer(values: Iterable[str], alpha: float = ALPHA) -> Automaton:
    """Merge compatible states of the values' prefix tree, the most visited first."""
    kinds = len(CLASSES)
    seen, ends, children = [0], [0], [{}]
    for value in values:
        node = 0
        seen[0] += 1
        for s in symbols(value[:FIT_SYMBOLS]).tolist():
            if s not in children[node]:
                children[node][s] = len(seen)
                seen.append(0)
                ends.append(0)
                children.append({})
            node = children[node][s]
            seen[node] += 1
        ends[node] += 1
    # passes over an edge are kept by state, as they add up when states are merged
    passes = [{s: seen[c] for s, c in kids.items()} for kids in children]
    slack = math.sqrt(0.5 * math.log(2 / alpha))

    def close(f: int, n: int, g: int, m: int) -> bool:
        return not n or not m or abs(f / n - g / m) <= slack * (n**-0.5 + m**-0.5)

    def compatible(a: int, b: int) -> bool:
        todo, met = [(a, b)], set()
        while todo:
            a, b = todo.pop()
            if a == b or (a, b) in met:
                continue
            met.add((a, b))
            if not close(ends[a], seen[a], ends[b], seen[b]):
                return False
            for s in passes[a].keys() | passes[b].keys():
                if not close(passes[a].get(s, 0), seen[a], passes[b].get(s, 0), seen[b]):
                    return False
                if s in children[a] and s in children[b]:
                    todo.append((children[a][s], children[b][s]))
        return True

    def fold(a: int, b: int) -> None:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if a == b:
                continue
            seen[a] += seen[b]
            ends[a] += ends[b]
            for s, n in passes[b].items():
                passes[a][s] = passes[a].get(s, 0) + n
                if s in children[a]:
                    todo.append((children[a][s], children[b][s]))
                else:
                    children[a][s] = children[b][s]

    red = [0]
    while True:
        fringe = [(seen[c], r, s, c) for r in red for s, c in children[r].items() if c not in red]
        if not fringe:
            break
        _, r, s, blue = max(fringe, key=lambda x: (x[0], -x[1], -x[2]))
        match = next((a for a in red if compatible(a, blue)), None)
        if match is None:
            red.append(blue)
        else:
            children[r][s] = match
            fold(match, blue)

    place = {node: i for i, node in enumerate(red)}
    following = np.zeros((len(red) + 1, kinds + 1), np.int64)
    counts = np.zeros((len(red) + 1, kinds + 1))
    lost = len(red)
    following[:] = lost
    for node, i in place.items():
        counts[i, kinds] = ends[node]
        for s, c in children[node].items():
            counts[i, s], following[i, s] = passes[node][s], place[c]
    counts += 0.05
    counts[lost] = 1
    return Automaton(following, np.log(counts / counts.sum(1, keepdims=True)))


def likelihoods(automaton: Automaton, values: list[str]) -> np.ndarray:
    """Log probability of each value; all values step through their symbols together."""
    size = np.array([len(v) for v in values], np.int64)
    flat = symbols("".join(values)).astype(np.int64)
    begins = np.cumsum(size) - size
    state, total = np.zeros(len(values), np.int64), np.zeros(len(values))
    order = np.argsort(-size, kind="stable")
    left = len(values)
    for t in range(int(size.max(initial=0))):
        while left and size[order[left - 1]] <= t:
            left -= 1
        rows = order[:left]
        s = flat[begins[rows] + t]
        total[rows] += automaton.log_p[state[rows], s]
        state[rows] = automaton.following[state[rows], s]
    return total + automaton.log_p[state, len(CLASSES)]


@dataclass(frozen=True)
class Formats:
    credentials: tuple[Automaton, ...]
    ordinary: tuple[Automaton, ...]

    def scores(self, values: list[str]) -> np.ndarray:
        if not self.credentials or not self.ordinary or not values:
            return np.full(len(values), -np.inf)
        best = [np.max([likelihoods(a, values) for a in side], 0) for side in (self.credentials, self.ordinary)]
        return best[0] - best[1]


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, credential) of the three patterns, in order of the text by kind."""
    spans = [(m.start(), m.end(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return spans + [(m.start(), m.end(), "hex", m[0]) for m in HEX.finditer(text) if m.end() - m.start() >= 32]


def candidates(text: str, taken: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str]]:
    """Long runs of credential characters that touch no base span."""
    busy = sorted((s, e) for s, e, _, _ in taken)
    out, k, reach = [], 0, 0
    for m in RUN.finditer(text):
        if m.end() - m.start() < MIN_RUN:
            continue
        while k < len(busy) and busy[k][0] < m.end():
            reach = max(reach, busy[k][1])
            k += 1
        if reach <= m.start():
            out.append((m.start(), m.end(), m[0]))
    return out


def suspects(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, object]:
    """Texts that can hold a base span or a candidate, and the runs of all texts."""
    found = split(data, edges, OUTSIDE)
    many = np.zeros(found.texts, bool)
    many[found.owner()[found.end - found.start >= MIN_RUN]] = True
    signs = np.flatnonzero((data == ord(":")) | (data == ord("=")))
    many[np.searchsorted(edges, signs, "right") - 1] = True
    return many, found


def examples(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(kind, value): credentials of base spans, and one ordinary run of each text."""

    def columns(batch: pa.RecordBatch) -> dict:
        kinds, values = [], []
        for _, _, data, edges in pieces(batch.column(0)):
            many, found = suspects(data, edges)
            covered = {}
            for d in np.flatnonzero(many):
                text = found.text(d)
                spans = base_spans(text)
                kinds += [k for _, _, k, _ in spans]
                values += [v[:FIT_SYMBOLS] for _, _, _, v in spans]
                if spans:
                    covered[int(d)] = True
            # of each text without credentials: the least-hash run of 8 or more characters with, and without, letters
            wordy = span_sums(LETTER[data], found.start, found.end) > 0
            for kind, wanted in (("ordinary", wordy), ("number", ~wordy)):
                rows = np.flatnonzero(wanted & (found.end - found.start >= 8))
                owner = found.owner()[rows]
                order = np.lexsort((span_hashes(data, found.start[rows], found.end[rows]), owner))
                for i in order[runs(owner[order])]:
                    if int(owner[i]) not in covered:
                        s, e = found.start[rows[i]], found.end[rows[i]]
                        kinds.append(kind)
                        values.append(data[s : min(e, s + FIT_SYMBOLS)].tobytes().decode())
        return {"kind": kinds, "value": values}

    return map_batches(docs.select(F.col(text_col).alias("text")), "kind string, value string", columns)


def fit(docs: DataFrame, text_col: str = "text") -> Formats:
    by_hash = Window.partitionBy("kind").orderBy(F.xxhash64("value"), "value")
    rows = (
        examples(docs, text_col).distinct().withColumn("rank", F.row_number().over(by_hash)).where(f"rank <= {EXAMPLES}").orderBy("kind", "rank").collect()
    )
    values: dict[str, list[str]] = {}
    for r in rows:
        values.setdefault(r["kind"], []).append(r["value"])
    known, others = ([k for k in values if (k in KINDS) == side] for side in (True, False))
    return Formats(tuple(infer(values[k]) for k in known), tuple(infer(values[k]) for k in others))


def found_spans(texts: pa.Array, formats: Formats) -> list[list[tuple[int, int, str]]]:
    """All spans of each text, base spans first."""
    out: list[list[tuple[int, int, str]]] = []
    for lo, hi, data, edges in pieces(texts):
        many, found = suspects(data, edges)
        out += [[] for _ in range(lo, hi)]
        open_runs = []
        for d in np.flatnonzero(many):
            text = found.text(d)
            spans = base_spans(text)
            out[lo + d] = [(s, e, k) for s, e, k, _ in spans]
            open_runs += [(lo + d, s, e, v) for s, e, v in candidates(text, spans)]
        for (d, s, e, _), score in zip(open_runs, formats.scores([r[3] for r in open_runs]), strict=True):
            if score > MARGIN:
                out[d].append((s, e, "format"))
    return out


def scan(docs: DataFrame, formats: Formats | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its id and its spans, base spans first; ends are exclusive code points."""
    formats = formats or fit(docs, text_col)

    def columns(batch: pa.RecordBatch) -> dict:
        spans = found_spans(batch.column(1), formats)
        return {
            id_col: batch.column(0),
            "spans": pa.array([[{"kind": k, "start": s, "end": e} for s, e, k in x] for x in spans], pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))),
        }

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(id_col), F.col(text_col)), f"`{id_col}` {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>", columns)


def digest(scanned: DataFrame) -> DataFrame:
    """Counts, the hash of the base spans, and all spans as text."""

    def columns(batch: pa.RecordBatch) -> dict:
        rows = [[(s["start"], s["end"], s["kind"]) for s in x] for x in batch.column(1).to_pylist()]
        base = [[s for s in x if s[2] != "format"] for x in rows]
        counts = {f"n_{k}": [sum(s[2] == k for s in x) for x in rows] for k in KINDS}
        return {"doc_id": batch.column(0), **counts, "base_sha256": [sha256(joined(x, KINDS)) for x in base], "spans": [joined(x, KINDS) for x in rows]}

    return map_batches(scanned.select("doc_id", "spans"), "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, n_format bigint, base_sha256 string, spans string", columns)


def redacted(text: str, spans: list[tuple[int, int, str]], mark: str = "[secret]") -> str:
    """The text with each stretch covered by spans replaced once."""
    out, at = [], 0
    for s, e, _ in sorted(spans):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, formats: Formats | None = None, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """All rows and columns; found secrets are replaced in the text, and its length follows where there is a column for it."""
    formats = formats or fit(docs, text_col)

    def work(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = batch.column(at).to_pylist()
            changed = {d: redacted(texts[d], spans) for d, spans in enumerate(found_spans(batch.column(at), formats)) if spans}
            if changed:
                arrays = list(batch.columns)
                arrays[at] = pa.array([changed.get(d, t) for d, t in enumerate(texts)], batch.schema.field(at).type)
                if (n := batch.schema.get_field_index(length_col)) >= 0:
                    old = batch.column(n).to_pylist()
                    arrays[n] = pa.array([len(changed[d]) if d in changed else x for d, x in enumerate(old)], batch.schema.field(n).type)
                batch = pa.RecordBatch.from_arrays(arrays, schema=batch.schema)
            yield batch

    return docs.mapInArrow(work, docs.schema)

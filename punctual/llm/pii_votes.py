"""Personal data: base patterns, and a span classifier trained on aggregated weak labels.

Base spans (``email``, ``ip``, ``card``, ``phone``) are exact patterns. Wider candidates
(written-out addresses, groups of digits) are judged without hand labels: regex, gazetteer
and context labelers vote yes, no or nothing on every candidate, base spans included;
expectation-maximisation over the counts of all vote patterns estimates how often each
labeler votes yes for personal and for other spans; the resulting posteriors train a
logistic classifier on votes and on the span's shape. Other candidates it gives at least
``ACCEPT`` become ``personal`` spans. Base spans are never changed.

Every candidate of every whole text is counted; what reaches the driver is one row per
distinct vote pattern and shape, at most ``3 ** len(LABELERS)`` times the shapes. A null
text counts as empty, equal rows give equal rows, a null id stays null, other columns are
not touched, an empty table gives an empty result; without candidates none is accepted.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctual.llm.spans import joined, sha256
from punctual.llm.words import map_batches, pieces, table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "personal")
ACCEPT, ROUNDS, NEAR = 0.9, 60, 40

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
QUAD = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PLUS = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

GROUPED = re.compile(r"\+?\(?[0-9](?:[\x20()./-]{0,2}[0-9]){6,}")
WRITTEN = re.compile(r"[A-Za-z0-9._-]{1,64}\x20?[\[(]\x20?(?:at|AT)\x20?[\])]\x20?[A-Za-z0-9-]{1,64}(?:(?:\.|\x20?[\[(]\x20?(?:dot|DOT)\x20?[\])]\x20?)[A-Za-z0-9-]{1,64})+")

# fixed values: issuer prefixes of payment cards, mail domains, words near personal data and near other numbers
ISSUERS = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "65")
DOMAINS = ("mail", "example", "yahoo", "outlook", ".com", ".org", ".net")
PERSONAL_WORDS = re.compile(r"\b(?:phone|tel|call|mobile|fax|card|credit|e-?mail|contact|ssn|account|iban|passport|address)\b", re.I)
OTHER_WORDS = re.compile(r"\b(?:isbn|issn|page|pages|version|order|invoice|item|build|revision|doi|chapter|lot|part)\b", re.I)

MARKS = table(b"@0123456789")
AT = table(b"@")


def luhn(digits: str) -> bool:
    values = [int(c) for c in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost addresses; each sign looks back no further than the sign or match before it."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = [(s, e, "email") for s, e in emails(text)]
    out += [(m.start(), m.end(), "ip") for m in QUAD.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    for m in DIGITS.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    for m in PLUS.finditer(text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), m.end(), "phone"))
    return out


def wider(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Candidates that touch no base span, in order."""
    found = sorted({(m.start(), m.end()) for pattern in (GROUPED, WRITTEN) for m in pattern.finditer(text)})
    busy, out, k, reach = sorted(base), [], 0, 0
    for s, e in found:
        while k < len(busy) and busy[k][0] < e:
            reach = max(reach, busy[k][1])
            k += 1
        if reach <= s:
            out.append((s, e))
            reach = e
    return out


def digits_of(value: str) -> str:
    return "".join(c for c in value if "0" <= c <= "9")


# Labelers see a candidate's text and what stands before and after it; None is no vote.


def says_mail(value: str, before: str, after: str) -> int | None:
    return 1 if "@" in value or WRITTEN.fullmatch(value) else None


def says_phone(value: str, before: str, after: str) -> int | None:
    if value[:1] not in "+(":
        return None
    return int(10 <= len(digits_of(value)) <= 15)


def says_checksum(value: str, before: str, after: str) -> int | None:
    digits = digits_of(value)
    return int(luhn(digits)) if 14 <= len(digits) <= 19 else None


def says_quad(value: str, before: str, after: str) -> int | None:
    parts = value.split(".")
    if len(parts) != 4 or not all(p.isdigit() for p in parts):
        return None
    return int(all(len(p) <= 3 and int(p) <= 255 for p in parts))


def says_issuer(value: str, before: str, after: str) -> int | None:
    digits = digits_of(value)
    return int(digits.startswith(ISSUERS)) if 14 <= len(digits) <= 19 else None


def says_domain(value: str, before: str, after: str) -> int | None:
    return 1 if any(d in value.lower() for d in DOMAINS) else None


def says_near(value: str, before: str, after: str) -> int | None:
    return 1 if PERSONAL_WORDS.search(before) else None


def says_other(value: str, before: str, after: str) -> int | None:
    return 0 if OTHER_WORDS.search(before) or after.lstrip()[:1] in ("%", "€") else None


def says_glued(value: str, before: str, after: str) -> int | None:
    return 0 if (before[-1:].isalnum() or after[:1].isalnum()) and "@" not in value else None


def says_short(value: str, before: str, after: str) -> int | None:
    return 0 if "@" not in value and "." not in value and len(digits_of(value)) < 10 else None


LABELERS = (says_mail, says_phone, says_checksum, says_quad, says_issuer, says_domain, says_near, says_other, says_glued, says_short)


def votes(text: str, start: int, end: int) -> str:
    """One sign per labeler: yes (+), no (-) or nothing (0)."""
    value, before, after = text[start:end], text[max(0, start - NEAR) : start], text[end : end + NEAR]
    return "".join({None: "0", 0: "-", 1: "+"}[f(value, before, after)] for f in LABELERS)


def shape(value: str) -> str:
    """Number of digits up to 20, and which marks stand in the span."""
    return f"{min(20, len(digits_of(value)))}:" + "".join(c if c in value else "_" for c in "+(.-@ ") + ("w" if re.search("[A-Za-z]", value) else "_")


def numbers(pattern: str, form: str) -> np.ndarray:
    """Inputs of the classifier: yes and no votes, marks, and bands of the number of digits."""
    n, marks = form.split(":")
    bands = [int(n) >= least for least in (1, 7, 10, 13, 14, 16, 17, 20)]
    return np.array([*(c == "+" for c in pattern), *(c == "-" for c in pattern), *(c != "_" for c in marks), *bands, True], float)


@dataclass(frozen=True)
class SpanModel:
    reliability: np.ndarray
    weights: np.ndarray | None

    def probability(self, pattern: str, form: str) -> float:
        return 0.0 if self.weights is None else float(1 / (1 + np.exp(-numbers(pattern, form) @ self.weights)))


#: What a labeler says of personal and of other spans before anything is seen: yes, no, nothing.
BELIEF = np.array([[0.4, 0.1, 0.5], [0.1, 0.4, 0.5]])


def aggregate(patterns: list[str], counts: np.ndarray, personal: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each pattern, and per labeler P(yes | personal) and P(yes | other), by EM.

    A labeler says yes, no or nothing, each with its own probability per class, so that
    silence counts as evidence too. Patterns marked ``personal`` (base spans) are known;
    ``BELIEF`` keeps a fifth of every class, so no labeler turns against what it stands for.
    """
    said = np.array([[c == x for c in p] for x in "+-0" for p in patterns], float).reshape(3, len(patterns), -1)
    known = np.zeros(len(patterns), bool) if personal is None else np.asarray(personal, bool)
    rate, prior = np.repeat(BELIEF[:, :, None], said.shape[2], axis=2), 0.5
    for _ in range(ROUNDS):
        log_odds = np.log(prior / (1 - prior)) + np.einsum("vpl,vl->p", said, np.log(rate[0] / rate[1]))
        posterior = np.where(known, 1.0, 1 / (1 + np.exp(-np.clip(log_odds, -30, 30))))
        for side, share in enumerate((posterior * counts, (1 - posterior) * counts)):
            weight = 10 + 0.2 * share.sum()
            rate[side] = (np.einsum("p,vpl->vl", share, said) + weight * BELIEF[side][:, None]) / (share.sum() + weight)
        # base spans are certain, so the share among the others is what has to be learned
        open_counts = np.where(known, 0.0, counts)
        prior = float(np.clip((posterior @ open_counts + 1) / (open_counts.sum() + 2), 0.05, 0.95))
    return posterior, rate[:, 0]


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weighted soft-label logistic regression by damped Newton steps."""
    beta = np.zeros(x.shape[1])
    w = w * min(1.0, 1e4 / w.sum())
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (w * (y - p)) - ridge * beta
        beta = beta + np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1]), slope)
    return beta


def texts_with_marks(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    at = np.flatnonzero(MARKS[data])
    return np.unique(np.searchsorted(edges, at, "right") - 1)


def each_text(texts: pa.Array):
    """(index, text) of the texts that can hold a candidate."""
    for lo, _, data, edges in pieces(texts):
        for d in texts_with_marks(data, edges):
            yield lo + int(d), data[edges[d] : edges[d + 1]].tobytes().decode("utf-8", "replace")
        if b"[" in (b := data.tobytes()) or b"(" in b:
            marked = set(texts_with_marks(data, edges).tolist())
            for d in range(len(edges) - 1):
                part = b[edges[d] : edges[d + 1]]
                # each text by itself: what a text's neighbours hold does not matter
                if d not in marked and (b"[" in part or b"(" in part) and (b"at" in part or b"AT" in part):
                    yield lo + d, part.decode("utf-8", "replace")


def fit(docs: DataFrame, text_col: str = "text") -> SpanModel:
    def columns(batch: pa.RecordBatch) -> dict:
        rows: dict[tuple[str, str, bool], int] = {}
        for _, text in each_text(batch.column(0)):
            base = base_spans(text)
            for spans, sure in (({(s, e) for s, e, _ in base}, True), (wider(text, base), False)):
                for s, e in spans:
                    key = (votes(text, s, e), shape(text[s:e]), sure)
                    rows[key] = rows.get(key, 0) + 1
        return {"pattern": [k[0] for k in rows], "form": [k[1] for k in rows], "base": [k[2] for k in rows], "n": list(rows.values())}

    counted = map_batches(docs.select(F.col(text_col).alias("text")), "pattern string, form string, base boolean, n bigint", columns)
    rows = counted.groupBy("pattern", "form", "base").agg(F.sum("n").alias("n")).orderBy("pattern", "form", "base").collect()
    if not rows:
        return SpanModel(np.zeros((2, len(LABELERS))), None)
    counts = np.array([r["n"] for r in rows], float)
    posterior, rate = aggregate([r["pattern"] for r in rows], counts, np.array([r["base"] for r in rows]))
    return SpanModel(rate, logistic(np.array([numbers(r["pattern"], r["form"]) for r in rows]), posterior, counts))


def found_spans(texts: pa.Array, model: SpanModel) -> list[list[tuple[int, int, str]]]:
    out: list[list[tuple[int, int, str]]] = [[] for _ in range(len(texts))]
    known: dict[tuple[str, str], bool] = {}
    for d, text in each_text(texts):
        out[d] = base_spans(text)
        for s, e in wider(text, out[d]):
            key = (votes(text, s, e), shape(text[s:e]))
            if key not in known:
                known[key] = model.probability(*key) >= ACCEPT
            if known[key]:
                out[d].append((s, e, "personal"))
    return out


def scan(docs: DataFrame, model: SpanModel | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its id and its spans; ends are exclusive code points."""
    model = model or fit(docs, text_col)

    def columns(batch: pa.RecordBatch) -> dict:
        rows = [[{"kind": k, "start": s, "end": e} for s, e, k in x] for x in found_spans(batch.column(1), model)]
        return {id_col: batch.column(0), "spans": pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))}

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(id_col), F.col(text_col)), f"`{id_col}` {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>", columns)


def digest(scanned: DataFrame) -> DataFrame:
    """Counts, the hash of the base spans, and all spans as text."""

    def columns(batch: pa.RecordBatch) -> dict:
        rows = [[(s["start"], s["end"], s["kind"]) for s in x] for x in batch.column(1).to_pylist()]
        base = [[s for s in x if s[2] in BASE] for x in rows]
        counts = {f"n_{k}": [sum(s[2] == k for s in x) for x in rows] for k in KINDS}
        return {"doc_id": batch.column(0), **counts, "base_sha256": [sha256(joined(x, KINDS)) for x in base], "spans": [joined(x, KINDS) for x in rows]}

    return map_batches(
        scanned.select("doc_id", "spans"), "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, n_personal bigint, base_sha256 string, spans string", columns
    )

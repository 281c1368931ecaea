from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from plain import LOWER, SCHEMA

from punctual.llm import setm_phrases
from punctual.llm.words import raw


def pieces_of(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER))]


def plain(rows, least=100, top=2000, longest=5, absorbed=100):
    """Brute force over (text, lang)."""
    counts, totals = {}, Counter()
    for text, lang in rows:
        f = counts.setdefault(lang if lang is not None else "und", Counter())
        for w in pieces_of(text):
            totals[lang if lang is not None else "und"] += len(w)
            f.update(tuple(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        n, found = totals[lang], {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = {q for p, b in found.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if (q := p[i:j]) != p and 100 * b >= absorbed * found[q]}
        rows = []
        for p, a in found.items():
            if p not in inside:
                score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, r, p.decode(), -a, left, right, n, -s) for r, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def found(df, **more):
    return sorted(tuple(r) for r in setm_phrases.collocations(df, **more).collect())


def test_given_table(spark, documents):
    rows = [tuple(r) for r in documents.select("text", "lang").collect()]
    want = plain(rows, least=20, top=50)
    assert len(want) > 50 and found(documents, least=20, top=50) == want


def test_odd_rows(odd):
    rows = [tuple(r) for r in odd.select("text", "lang").collect()]
    for least in (1, 2):
        assert found(odd, least=least) == plain(rows, least=least)


def test_empty_table(none):
    assert found(none) == []


@pytest.mark.parametrize(("absorbed", "longest", "top"), [(100, 5, 2000), (60, 4, 5), (100, 2, 3)])
def test_made_up_texts(spark, absorbed, longest, top):
    rng = random.Random(absorbed + longest)
    words = ["a", "B", "c", "Dé", "日本", "e,", ".", "f\n", "g", " ", "\t"]
    rows = [(" ".join(rng.choices(words, weights=[9, 8, 7, 3, 2, 1, 1, 1, 1, 1, 1], k=rng.randrange(40))), rng.choice(["x", "x", "y", None, ""])) for _ in range(120)]
    df = spark.createDataFrame([(1, t, lang, "s", 0, 0, 0, "r", "s", "i", "c") for t, lang in rows], SCHEMA).repartition(4)
    assert found(df, least=4, absorbed=absorbed, longest=longest, top=top) == plain(rows, least=4, absorbed=absorbed, longest=longest, top=top)


def test_small_chunks_give_the_same(documents, monkeypatch):
    want = found(documents, least=20)
    monkeypatch.setattr(setm_phrases, "CHUNK_BYTES", 5_000)
    assert found(documents, least=20) == want


def test_scores_above_64_bits(spark):
    from pyspark.sql import functions as F

    cases = [(10**12, 3 * 10**12, 7 * 10**12, 10**14 - 1), (100, 100, 100, 10**14 - 1), (99_999_999_999_999, 99_999_999_999_999, 99_999_999_999_999, 99_999_999_999_999)]
    kind = setm_phrases.COUNT
    df = spark.createDataFrame(cases, "a bigint, l bigint, r bigint, n bigint")
    got = df.select(((F.lit(1000).cast("decimal(4,0)") * F.col("a").cast(kind) * F.col("n").cast(kind)).alias("x")), "l", "r").selectExpr(f"x div (cast(l as {kind}) * cast(r as {kind})) as s").collect()
    assert [r["s"] for r in got] == [1000 * a * n // (left * right) for a, left, right, n in cases]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aB .,\n\t!é", max_size=30), max_size=5))
def test_places(texts):
    data, edges = raw(pa.array(texts, pa.string()))
    start, end, at = setm_phrases.places(setm_phrases.LOWER[data], edges)
    got = [setm_phrases.LOWER[data][a:b].tobytes().decode() for a, b in zip(start, end)]
    runs = [w for t in texts for w in pieces_of(t) if w]
    assert got == [x for w in runs for x in w]
    together = np.diff(at) == 1
    assert together.tolist() == [k < len(w) - 1 for w in runs for k in range(len(w))][:-1]

from __future__ import annotations

import random

import numpy as np
import pytest
from plain import SCHEMA, components, odd_rows, removed, rows, sha

from punctual.llm import jaccard_partenum, repeated_windows


def as_dict(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_components_of_odd_rows(odd):
    got = jaccard_partenum.components(odd).collect()
    assert len(got) == len(odd_rows())
    plain = components({r[0]: r[1] for r in odd_rows() if r[0] is not None}.items())
    for r in got:
        assert (r["n_shingles"], r["component_id"]) == (plain[r["doc_id"]] if r["doc_id"] is not None else (20, None))


def chained(n_groups=6, seed=3):
    """Groups of texts that differ from their neighbours in a few words: links form chains, hubs do not reach all."""
    rng, texts = random.Random(seed), []
    for g in range(n_groups):
        words = [f"g{g}w{rng.randrange(4000)}" for _ in range(rng.choice([8, 30, 75, 150]))]
        for _ in range(14):
            texts.append(" ".join(words))
            for _ in range(rng.choice([0, 1, 1, 2])):
                words = list(words)
                words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    rng.shuffle(texts)
    return rows([(t, "en", "a") for t in texts])


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_components_of_chains(spark, n, percent):
    data = chained()
    got = as_dict(jaccard_partenum.components(spark.createDataFrame(data, SCHEMA), n, percent))
    assert got == components([(r[0], r[1]) for r in data], n, percent)


def test_sets_that_only_meet_beside_another_hub_are_linked(spark):
    """Of three texts the first links with the second, the second with the third; numbers within a bucket do not begin at its least id."""
    rng, data = random.Random(11), []
    for g in range(24):
        words = [f"g{g}w{i}" for i in range(14)]
        texts = [[*words, f"x{rng.randrange(10**6)}"], words, [*words, f"y{rng.randrange(10**6)}"], [*words[:11], *(f"z{rng.randrange(10**6)}" for _ in range(3))]]
        data += [(1000 * 64 * g + i, " ".join(t)) for i, t in zip((63, 64, 130, 5), texts, strict=True)]
    got = as_dict(jaccard_partenum.components(spark.createDataFrame(data, "doc_id bigint, text string")))
    assert got == components(data)


def test_pairs_of_many_shared_buckets_are_met_about_once(spark, monkeypatch):
    """Long texts too far from each other to link share many buckets; a few link."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(1500)]
    texts = []
    for i in range(24):
        copy = list(base)
        for at in rng.choice(1500, 30 if i % 6 else 10, replace=False):
            copy[at] = f"x{i}y{at}"
        texts.append((" ".join(copy), "en", "a"))
    counts, met = [], jaccard_partenum.met

    def counted(*given):
        pairs = met(*given)
        counts.append((pairs.count(), pairs.select("a", "b").distinct().count()))
        return pairs

    monkeypatch.setattr(jaccard_partenum, "met", counted)
    data = rows(texts)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_partenum.components(spark.createDataFrame(data, SCHEMA), 5, 80).collect()}
    expected = components([(r[0], r[1]) for r in data], 5, 80)
    assert got == {i: c for i, (_, c) in expected.items()} and 2 < len(set(got.values())) < 24
    met_rows, pairs = (sum(c[k] for c in counts) for k in (0, 1))
    assert pairs > 50 and met_rows < 3 * pairs


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_share_a_signature(percent):
    rng = np.random.default_rng(1)
    for size in (1, 2, 3, 5, 9, 12, 20, 40, 61, 130, 700):
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
            most = jaccard_partenum.differences(2 * size, percent) // 2
            b = np.unique(np.r_[a[: len(a) - rng.integers(0, most + 1)], rng.integers(0, 2**63, rng.integers(0, most + 1), dtype=np.uint64)])
            both = len(np.intersect1d(a, b))
            if not len(b) or 100 * both < percent * (len(a) + len(b) - both):
                continue
            sig, counts = jaccard_partenum.signatures(np.r_[a, b], np.array([len(a), len(b)]), percent)
            assert set(sig[: counts[0]].tolist()) & set(sig[counts[0] :].tolist())


def test_keep_one_keeps_columns_and_rows_without_words(odd):
    kept = jaccard_partenum.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert {3, 4, 5}.issubset(ids) and 1 not in ids and None in ids


def test_empty_tables(none):
    assert jaccard_partenum.components(none).collect() == []
    assert repeated_windows.remove(none).collect() == []


def test_removed_words_of_odd_rows(odd):
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"], r["kept_sha256"]) for r in repeated_windows.remove(odd).collect()), key=repr)
    assert got == sorted(((i, n, k, t, sha(t)) for i, n, k, t in removed([(r[0], r[1]) for r in odd_rows()])), key=repr)


def test_removed_words_of_documents(documents, spark, monkeypatch):
    # small chunks and blocks: many of both
    monkeypatch.setattr(repeated_windows, "CHUNK_BYTES", 20_000)
    monkeypatch.setattr(repeated_windows, "BLOCK_CELLS", 1 << 17)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in repeated_windows.remove(documents).collect()}
    assert got == {i: (n, k, t) for i, n, k, t in removed([(r["doc_id"], r["text"]) for r in documents.collect()])}
    assert sum(k for _, k, _ in got.values())


def test_repeated_rows_of_a_kept_id_leave_one(spark):
    text = "the very same text appended once more under its own id"
    docs = spark.createDataFrame([(5, text), (5, text), (5, text), (9, text), (6, " "), (6, " "), (None, text), (None, text), (7, None), (7, None)], "doc_id bigint, text string")
    got = sorted((str(r["doc_id"]), str(r["text"])) for r in jaccard_partenum.keep_one(docs).collect())
    assert got == sorted([("5", text), ("6", " "), ("6", " "), ("None", text), ("None", text), ("7", "None"), ("7", "None")])


def test_keep_one_beside_clashing_columns(spark):
    text = "a text of some words that is there twice"
    docs = spark.createDataFrame([(1, text, "x", 1), (2, text, "y", 2), (3, "another text", "z", 3)], "doc_id bigint, text string, _gone0 string, _alone0 int")
    kept = jaccard_partenum.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]

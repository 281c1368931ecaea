from __future__ import annotations

import math
import os
import zlib
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from plain import SCHEMA, WORD, katz, odd_rows, quality_counts, rows
from pyspark.sql import functions as F

from punctual.llm import curriculum, katz_backoff, language_crf, latent_leaks, quality_trees, rule_limits


def test_trees_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs, marks = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = quality_trees.score(docs, marks).join(marks, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in got) >= 0.9 * len(got)
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) == r["held_out"] for r in got)


def test_trees_of_odd_rows(odd, none, labels, spark):
    got = quality_trees.score(odd, labels).collect()
    assert len(got) == len(odd_rows()) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    assert quality_trees.score(none, labels).collect() == []
    no_labels = spark.createDataFrame([(1, None)], "doc_id bigint, quality int")
    assert {r["score"] for r in quality_trees.score(odd, no_labels).collect()} == {0.5}


def test_flat_trees_walk_like_nested_ones():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 5)).astype(np.float32)
    y = ((x[:, 1] > 0.3) ^ (x[:, 3] < -0.2)).astype(float)
    trees = quality_trees.grow(x, y)
    assert ((trees.scores(x) > 0.5) == (y == 1)).mean() > 0.97

    def walk(row):
        total = trees.start
        for feature, cutoff, value in zip(trees.feature, trees.cutoff, trees.value):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > cutoff[node] else 1)
            total += value[node - len(feature)]
        return 1 / (1 + math.exp(-total))

    assert np.allclose(trees.scores(x[:20]), [walk(r) for r in x[:20]])


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(3)
    k, sizes = 3, [4, 0, 1, 5]
    moves, emission = rng.normal(size=(k, k)), rng.normal(size=(sum(sizes), k)).astype(np.float32)
    first = np.r_[0, np.cumsum(sizes)]
    m, pairs = language_crf.marginals(emission, first, moves)
    expected, moved = np.zeros_like(m, float), np.zeros((k, k))
    for lo, hi in zip(first[:-1], first[1:]):
        if lo == hi:
            continue
        part, paths = np.zeros((hi - lo, k)), np.zeros((k, k))
        z = 0.0
        for path in product(range(k), repeat=hi - lo):
            weight = math.exp(sum(emission[lo + t, s] for t, s in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:]))) * sum(math.exp(moves[a, path[0]]) for a in range(k))
            z += weight
            for t, s in enumerate(path):
                part[t, s] += weight
            for a, b in zip(path, path[1:]):
                paths[a, b] += weight
        expected[lo:hi], moved = part / z, moved + paths / z
    assert np.allclose(m, expected, atol=1e-5) and np.allclose(pairs, moved, atol=1e-4)


def test_forward_backward_across_segments():
    rng = np.random.default_rng(4)
    emission, moves = rng.normal(size=(150, 2)).astype(np.float32), np.array([[1.0, -1], [-0.5, 0.7]])
    m, _ = language_crf.marginals(emission, np.array([0, 150]), moves)
    a, alpha, beta = np.exp(moves), np.zeros((150, 2)), np.ones((150, 2))
    now = np.ones(2)
    for t in range(150):
        now = (now @ a) * np.exp(emission[t])
        alpha[t] = now = now / now.sum()
    for t in range(148, -1, -1):
        beta[t] = a @ (np.exp(emission[t + 1]) * beta[t + 1])
        beta[t] /= beta[t].sum()
    assert np.allclose(m, alpha * beta / (alpha * beta).sum(1, keepdims=True), atol=1e-4)


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_crf.predict(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) >= 0.95 * len(got)


def test_languages_of_odd_rows(odd, none, documents):
    field = language_crf.fit(documents)
    got = {r["doc_id"]: r for r in language_crf.predict(odd, field).collect()}
    assert {i for i, r in got.items() if r["lang_pred"] == "und"} == {3, 4, 5, 12}
    assert all(0 <= r["score"] <= 1 for r in got.values())
    kept = language_crf.keep_identified(odd, field)
    assert kept.columns == odd.columns and {3, 4, 5, 12}.isdisjoint(r["doc_id"] for r in kept.collect())
    assert language_crf.predict(none).collect() == []


def test_counts_and_base_of_rules(odd, documents, labels, none):
    for table in (odd, documents):
        texts = {}
        for r in table.select("doc_id", "text").collect():
            texts.setdefault(r["doc_id"], r["text"])
        got = rule_limits.judge(table, labels).collect()
        assert len(got) == table.count()
        for r in got:
            plain = quality_counts(texts[r["doc_id"]])
            assert plain == (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
            assert r["base_failed"] == (plain[0] < 50 or 100 * plain[4] > 50 * plain[0])
            assert not (r["base_failed"] and r["kept"])
    assert rule_limits.judge(none, labels).collect() == []


def test_binomial_tail(spark):
    cases = [(0, 10, 0.1), (3, 100, 0.05), (40, 20_000, 0.005), (7, 20, 0.1)]
    for k, n, p in cases:
        exact = 1.0 if k >= n * p else sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) if n < 1000 else None
        got = spark.createDataFrame([(k, n)], "k bigint, n bigint").select(rule_limits.at_most(F.col("k"), F.col("n"), p)).first()[0]
        if exact is None:
            logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
            exact = sum(map(math.exp, logs))
        assert math.isclose(got, exact, rel_tol=1e-9)


def test_certified_cutoffs_reject_few_good_texts(spark):
    good = [(i, " ".join(f"w{(i * 37 + j * 11) % 9973}" for j in range(60)), "en") for i in range(3000)]
    bad = [(5000 + i, " ".join(f"w{j}###$$$%%%" for j in range(60)), "en") for i in range(300)]
    docs = spark.createDataFrame(good + bad, "doc_id bigint, text string, lang string")
    marks = spark.createDataFrame([(r[0], int(r[0] < 5000)) for r in good + bad], "doc_id bigint, quality int")
    got = {r["doc_id"]: r["kept"] for r in rule_limits.judge(docs, marks).collect()}
    assert all(got[r[0]] for r in good) and not any(got[r[0]] for r in bad)


def levels(sizes):
    """Targets by sharing the excess again and again."""
    weight = [curriculum.WEIGHTS[i % 3] for i in range(len(sizes))]
    target, rest, open_ = [0.0] * len(sizes), 1.5 * sum(sizes), set(range(len(sizes)))
    while rest > 1e-9 and open_:
        share = rest / sum(weight[i] for i in open_)
        rest = 0.0
        for i in sorted(open_):
            target[i] += share * weight[i]
        for i in sorted(open_):
            if target[i] > 2 * sizes[i]:
                rest += target[i] - 2 * sizes[i]
                target[i] = 2.0 * sizes[i]
                open_.discard(i)
    return target


def test_mix_of_odd_rows(odd, none):
    out = curriculum.mix(odd)
    assert out.columns == [c for c in odd.columns if c not in curriculum.ADDED] + list(curriculum.ADDED)
    got = out.collect()
    assert len(got) == len(odd_rows())
    by_source = {}
    for r in got:
        assert r["size"] == len(WORD.findall(r["text"] or "")) and 0 <= r["taken"] <= 2 * r["size"]
        by_source.setdefault(r["source"], []).append(r)
    names = sorted((s for s in by_source if s is not None), key=lambda s: s.encode()) + [None]
    sizes = [sum(r["size"] for r in by_source[s]) for s in names]
    for name, size, target in zip(names, sizes, levels(sizes)):
        rows_here = by_source[name]
        assert {r["source_size"] for r in rows_here} == {size}
        assert all(math.isclose(r["target"], target, rel_tol=1e-9, abs_tol=1e-9) for r in rows_here)
        assert sum(r["taken"] for r in rows_here) == math.floor(rows_here[0]["target"])
    times = [r["position"] for r in got if r["position"] is not None]
    assert times == sorted(times) and all(0 <= t <= 1 for t in times)
    assert sorted(map(repr, curriculum.mix(odd.repartition(5)).collect())) == sorted(map(repr, got))
    assert curriculum.mix(none).collect() == []


@pytest.mark.parametrize("knots", [*curriculum.SCHEDULES, (0.0, 2.0, 1.0), (1.0, 3.0)])
def test_times_invert_the_integrated_schedule(spark, knots):
    step = 1 / (len(knots) - 1)

    def demand(t):
        total = 0.0
        for k, (a, b) in enumerate(zip(knots, knots[1:])):
            s = min(step, max(0.0, t - k * step))
            total += a * s + (b - a) / step * s * s / 2
        return total

    shares = [i / 50 for i in range(51)]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in shares], "s double").select(curriculum.time_of(F.col("s"), knots)).collect()]
    assert np.allclose([demand(t) / demand(1) for t in got], shares, atol=1e-9)


def test_crf_is_learned_outside_the_driver(documents, monkeypatch):
    plain, driver, here = language_crf.learn, os.getpid(), []

    def watched(texts, labels, languages, lexicon):
        if os.getpid() == driver:
            here.append(len(texts))
        return plain(texts, labels, languages, lexicon)

    monkeypatch.setattr(language_crf, "learn", watched)
    field = language_crf.fit(documents)
    assert not any(here)
    assert field.grams.any() and field.affixes.any() and field.trust[0] != 0.5 and not np.array_equal(field.moves, np.eye(len(field.languages)))


def test_crf_learns_from_rows_in_their_order(spark):
    rows = [(f"the house number {i} stands", "en") if i % 2 else (f"das haus nummer {i} steht", "de") for i in range(60)]
    lexicon = np.random.default_rng(5).standard_normal((1 << 10, 2)).astype(np.float32)
    expected = language_crf.learn([t for t, _ in rows], np.array([int(x == "en") for _, x in rows]), ("de", "en"), lexicon)
    got = language_crf.learn_in_task(spark.createDataFrame(rows, "text string, lang string").coalesce(1), ("de", "en"), lexicon)
    for name in ("grams", "affixes", "trust", "moves"):
        assert np.allclose(getattr(got, name), getattr(expected, name), rtol=1e-4, atol=1e-6)
    untrained = language_crf.learn_in_task(spark.createDataFrame([], "text string, lang string"), ("de", "en"), lexicon)
    assert not untrained.grams.any() and untrained.lexicon is lexicon


def test_scores_against_dictionaries(documents, spark, monkeypatch):
    monkeypatch.setattr(katz_backoff, "CHUNK_BYTES", 60_000)
    monkeypatch.setattr(katz_backoff, "BLOCK_BYTES", 100_000)
    monkeypatch.setattr(katz_backoff, "PART", 500)
    expected, whole = katz([(r["doc_id"], r["text"]) for r in documents.collect()])
    for r in katz_backoff.score(documents).collect():
        n, known, total, base, score = expected[r["doc_id"]]
        assert (n, known, total) == (r["n_tokens"], r["n_known"], r["train_tokens"])
        assert math.isclose(base, r["base_score"], rel_tol=1e-9) and math.isclose(score, r["score"], rel_tol=1e-9)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
    for v in ("\r", "the", "of", "never seen"):
        assert math.isclose(whole(v), 1.0, rel_tol=1e-9)


def test_scores_with_a_third_of_the_ids_missing(documents, monkeypatch):
    monkeypatch.setattr(katz_backoff, "CHUNK_BYTES", 60_000)
    holey = documents.withColumn("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("doc_id")))
    sizes = katz_backoff.dealt(holey, 12, "doc_id", "text").groupBy("chunk").agg(F.sum(F.octet_length("text")).alias("n"), F.count("*").alias("rows")).collect()
    longest = documents.agg(F.max(F.octet_length("text"))).first()[0]
    assert len(sizes) == 12 and max(r["rows"] for r in sizes) < documents.count() / 6
    assert max(r["n"] for r in sizes) < longest + sum(r["n"] for r in sizes) / 6
    learned = (-i for i in range(1, 1 << 20) if zlib.crc32(str(-i).encode()) % 7 != 2)
    plain_rows = [(next(learned) if r["doc_id"] is None else r["doc_id"], r["text"]) for r in holey.collect()]
    expected, _ = katz(plain_rows)
    wanted = sorted((t or "", *expected[i]) for i, t in plain_rows)
    got = katz_backoff.score(holey.withColumn("text_too", F.col("text"))).collect()
    assert sum(r["doc_id"] is None for r in got) == sum(i < 0 for i, _ in plain_rows)
    numbers = sorted((r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got)
    assert np.allclose(numbers, sorted(w[1:] for w in wanted), rtol=1e-9)


def test_scores_of_odd_rows(odd, none):
    got = katz_backoff.score(odd).collect()
    assert len(got) == len(odd_rows()) and all(r["n_tokens"] >= 1 and math.isfinite(r["score"]) for r in got)
    assert katz_backoff.score(none).collect() == []


def test_leaks_are_found_and_others_are_not(spark):
    folder = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    items = {r["item_id"]: " " + " ".join(latent_leaks.words_of(r["text"])) + " " for r in bench.collect()}
    inside = {(r["doc_id"], i) for r in docs.collect() for i, t in items.items() if t in f" {' '.join(latent_leaks.words_of(r['text'] or ''))} "}
    got = {(r["doc_id"], r["item_id"]) for r in latent_leaks.leaks(docs, bench).collect()}
    assert inside and len(inside & got) >= 0.95 * len(inside)
    assert len(got - inside) <= 2


def test_leaks_of_odd_rows_and_paraphrases(spark, none):
    item = "Which river flows through the old capital city of the northern kingdom before reaching the wide grey sea? It is the silver Arden river."
    near = "Note: which great river flows through the old capital of the northern kingdom before it is reaching the grey sea? it is the silver Arden river! end"
    filler = " ".join(f"word{i}" for i in range(300))
    docs = spark.createDataFrame(odd_rows() + rows([(f"A short introduction. {near} And so it ends.", "en", "a"), (filler, "en", "a"), (item.upper(), "en", "a")], 100), SCHEMA)
    bench = spark.createDataFrame([(7, item), (8, None), (None, item), (9, " "), (10, "tiny item")], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in latent_leaks.leaks(docs, bench).collect()}
    assert got == {(100, 7), (102, 7)}
    clean = latent_leaks.keep_clean(docs, bench)
    assert clean.columns == docs.columns and clean.count() == docs.count() - 2
    assert latent_leaks.leaks(none, bench).collect() == []
    assert latent_leaks.keep_clean(docs, bench.where("false")).count() == docs.count()


def test_folded_texts_keep_their_words_and_single_blanks_only_where_needed():
    texts = ["A  b\tC", "x\x1cy \x1fZ", "É\xa0ß\u2003q", None, "", " (A.) "]
    got = latent_leaks.folded(pa.array(texts, pa.large_string())).to_pylist()
    assert got[0] == "a  b\tc" and got[3] is None
    for t, f in zip(texts, got):
        data = np.frombuffer((f or "").encode(), np.uint8)
        first, _, start = latent_leaks.texts_hashes(data, np.array([0, len(data)]))
        assert first[-1] == len(start) == len(latent_leaks.words_of(t or ""))
        assert (latent_leaks.texts_hashes(data, np.array([0, len(data)]))[1] == latent_leaks.item_hashes(latent_leaks.words_of(t or ""))).all()


def test_common_subsequence():
    def slow(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rng = np.random.default_rng(6)
    for _ in range(50):
        a, b = ([str(x) for x in rng.integers(0, 5, rng.integers(1, 12))] for _ in range(2))
        assert latent_leaks.common(a, b) == slow(a, b)


def test_digests_are_the_whole_table(spark):
    """Every registered query returns its table's rows."""
    from punctual.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{folder}/documents.parquet").count()
    for name in ("op5_quality_trees", "op7_rule_limits", "op8_curriculum", "op9_katz_backoff"):
        assert QUERIES[name](spark, folder).count() == n
    assert pa.__version__


def test_leaks_of_short_items_inside_long_documents(spark):
    """Every copy is found whatever the item's length, and as many altered ones as the exact check accepts anywhere."""
    rng = np.random.default_rng(11)
    words = np.array([f"w{i}x" for i in range(3000)])
    p = 1 / np.arange(1, 3001)
    draw = lambda n: list(rng.choice(words, n, p=p / p.sum()))
    lengths = [3, 6, 8, 9, 10, 12, 14, 16, 20, 24, 32, 50]
    items = {i: draw(lengths[i % len(lengths)]) for i in range(36)}
    texts, altered = [], {}
    for i, item in items.items():
        for copy in (item, [w if rng.random() > 0.15 else "other" for w in item] if len(item) >= 8 else item):
            text, at = draw(150), int(rng.integers(0, 150))
            altered[len(texts)] = (i, copy)
            texts.append(text[:at] + copy + text[at:])
    docs = spark.createDataFrame(rows([(" ".join(t), "en", "a") for t in texts], 0), SCHEMA)
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in items.items()], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in latent_leaks.leaks(docs, bench).collect()}
    expected = set()
    for d, text in enumerate(texts):
        for i, item in items.items():
            for at in range(0, len(text), 16):
                near = text[max(0, at - len(item) - 16) : at + 48 + len(item)]
                same = latent_leaks.common(item, near)
                # one sentence: the answer is the whole item
                if f" {' '.join(item)} " in f" {' '.join(near)} " if len(item) < 8 else same >= 0.8 * len(item):
                    expected.add((d, i))
    assert {(d, i) for d, (i, copy) in altered.items() if copy == items[i]} <= expected
    assert got == expected


def test_sums_over_half_passages_against_dense_products():
    rng = np.random.default_rng(8)
    grid = np.where(rng.random((5000, 16)) < 0.1, -1, rng.integers(0, 70, (5000, 16)) ** 2)
    basis = np.vstack([latent_leaks.random_basis(6), np.zeros((1, 6), np.float32)])
    dense = np.zeros((5000, latent_leaks.FEATURES), np.float32)
    np.add.at(dense, (np.repeat(np.arange(5000), 16)[grid.ravel() >= 0], grid[grid >= 0]), 1)
    y = dense.astype(float) @ basis[:-1]
    total, square = np.zeros((latent_leaks.FEATURES, 6)), np.zeros((6, 6))
    latent_leaks.add_products(total, grid, basis)
    latent_leaks.add_squares(square, grid, basis)
    assert np.allclose(total, dense.T @ y, rtol=1e-4, atol=1e-1) and np.allclose(square, y.T @ y, rtol=1e-4, atol=1e-1)
    assert np.allclose(square, basis[:-1].T @ total, rtol=1e-4, atol=1)


def test_words_by_hash_have_the_subsequences_of_words():
    rng = np.random.default_rng(9)
    for _ in range(60):
        a, b = ([f"w{x}" for x in rng.integers(0, top, rng.integers(1, most))] for top, most in ((6, 14), (9, 40)))
        sought, near, exact = latent_leaks.Sought(latent_leaks.item_hashes(a)), latent_leaks.item_hashes(b), latent_leaks.common(a, b)
        assert sought.common(near) == exact
        for least in (1, 0.6 * len(a), len(a)):
            assert sought.common(near, least) == exact if exact >= least else sought.common(near, least) < least


def test_folded_letters_and_stripped_marks():
    texts = ["ÀÖ×ØÞß÷ Ÿx", "AÉ Z", "Σας ΟΔΟΣ\u00a0B", None, "İ\u2003Q", "É", "", "a" + "#" * 100 + " " + "#" * 90 + " " + "!" * 70 + "b?" + "." * 80, "*"]
    got = latent_leaks.folded(pa.array(texts, pa.large_string())).to_pylist()
    for t, f in zip(texts, got):
        assert (f is None) == (t is None) and (f or "").split() == (t or "").lower().split()
        data = np.frombuffer((f or "").encode(), np.uint8)
        first, h, start = latent_leaks.texts_hashes(data, np.array([0, len(data)]))
        words = latent_leaks.words_of(t or "")
        assert first[-1] == len(h) == len(words) and (h == latent_leaks.item_hashes(words)).all()
        assert all(data[i:].tobytes().decode().startswith(w) for i, w in zip(start.tolist(), words))


def test_latent_space_is_fitted_on_all_documents(spark):
    """The sums over tasks are (A^T A) basis of every half passage, and words of each document get directions."""
    rng = np.random.default_rng(5)
    grid = np.where(rng.random((700, 16)) < 0.1, -1, rng.integers(0, 60, (700, 16)) ** 2)
    basis = np.vstack([latent_leaks.random_basis(5), np.zeros((1, 5), np.float32)])
    total, dense = np.zeros((latent_leaks.FEATURES, 5)), np.zeros((700, latent_leaks.FEATURES))
    latent_leaks.add_products(total, grid, basis)
    np.add.at(dense, (np.repeat(np.arange(700), 16)[grid.ravel() >= 0], grid[grid >= 0]), 1)
    assert np.allclose(total, dense.T @ (dense @ basis[:-1]), rtol=1e-4, atol=1e-2)
    # 900 documents of nine subjects, of which each has its own words: more than the former sample of 300
    texts = [" ".join(f"s{i // 100}n{j}" for j in rng.integers(0, 40, 32)) for i in range(900)]
    texts += [" ".join(f"rare{i}n{j}" for j in range(16)) for i in range(40)]
    docs = spark.createDataFrame(rows([(t, "en", "a") for t in texts], 0), SCHEMA).repartition(3)
    bench = spark.createDataFrame([(0, "one item of the benchmark with words of its own for this test")], "item_id bigint, text string")
    ix = latent_leaks.index(docs, bench, "doc_id", "text", "item_id", "text")
    slots = latent_leaks.slots_of(latent_leaks.item_hashes([f"rare{i}n{j}" for i in range(40) for j in range(16)]))
    assert (np.abs(ix.weighted[slots]).max(axis=1) > 1e-6).all()

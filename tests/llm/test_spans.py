from __future__ import annotations

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from plain import base_pii, base_secrets, odd_rows, sha

from punctual.llm import pii_votes, secret_automata
from punctual.llm.spans import joined


def texts():
    return sorted((r[1] or "" for r in odd_rows()), key=repr)


@pytest.mark.parametrize(("module", "plain"), [(secret_automata, base_secrets), (pii_votes, base_pii)])
def test_base_spans(odd, documents, module, plain):
    for table in (odd, documents):
        by_id = {}
        for r in table.select("doc_id", "text").collect():
            by_id.setdefault(r["doc_id"], r["text"] or "")
        got = module.digest(module.scan(table)).collect()
        assert len(got) == table.count()
        for r in got:
            base = plain(by_id[r["doc_id"]])
            assert r["base_sha256"] == sha(base)
            assert set(base.split(",")) - {""} <= set(r["spans"].split(","))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="a1.@-+ ()%", max_size=40))
def test_pii_patterns(text):
    assert joined(pii_votes.base_spans(text), pii_votes.BASE) == base_pii(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["token", "Secret", "ſecret", "api_key", "=", ": ", '"', "abcdefgh", "AKIA", "Z9", "0123456789abcdef", " ", "é", "-"]), max_size=14).map("".join))
def test_secret_patterns(text):
    assert joined([s[:3] for s in secret_automata.base_spans(text)], secret_automata.KINDS) == base_secrets(text)


def test_empty_tables(none):
    for module in (secret_automata, pii_votes):
        assert module.digest(module.scan(none)).collect() == []
    assert secret_automata.redact(none).collect() == []


def test_automata_tell_formats_from_words():
    import random

    rng = random.Random(5)
    keys = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(200)]
    words = ["".join(rng.choice(["the", "tion", "an", "ere", "ing", "able"]) for _ in range(rng.randrange(3, 9))) for _ in range(200)]
    formats = secret_automata.Formats((secret_automata.infer(keys[:150]),), (secret_automata.infer(words[:150]), secret_automata.infer(["".join(rng.choice("0123456789") for _ in range(16)) for _ in range(90)])))
    assert (formats.scores(keys[150:]) > secret_automata.MARGIN).all()
    assert (formats.scores(words[150:]) < 0).all()
    assert (formats.scores(["4111111111111111"]) < 0).all()
    assert len(formats.credentials[0].following) < 60  # merged, not the prefix tree


def test_format_spans_do_not_touch_base_spans():
    text = "token = abcdef0123456789abcdef0123456789 other_0123456789abcdef012345"
    base = secret_automata.base_spans(text)
    assert [text[s:e] for s, e, _ in secret_automata.candidates(text, base)] == ["other_0123456789abcdef012345"]


def test_redact_keeps_rows_and_columns(odd):
    out = secret_automata.redact(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    row = out.where("doc_id = 14").first()
    assert "hunter2" not in row["text"] and "deadbeef" not in row["text"] and row["n_chars"] == len(row["text"])
    assert out.where("doc_id = 3").first()["text"] is None


def test_votes_add_unlabelled_spans():
    counts = __import__("numpy").array([50.0, 40.0, 200.0])
    posterior, rate = pii_votes.aggregate(["+0+0++000-"[:10], "0+000+0000", "00-0-00--0"], counts)
    assert posterior[0] > 0.9 and posterior[1] > 0.9 and posterior[2] < 0.1
    assert (rate[0] >= rate[1]).all()


def test_written_address_is_found(spark):
    lines = [(i, f"mail me at name{i}@mail.example.com or phone +1 (212) 555-01{i:02d} today") for i in range(60)]
    lines += [(100 + i, f"contact john{i} [at] mail{i} [dot] com for more") for i in range(20)] + [(200 + i, f"page 12345678{i:02d} of order 99887766{i:02d}") for i in range(40)]
    docs = spark.createDataFrame(lines, "doc_id bigint, text string")
    got = {r["doc_id"]: r["n_personal"] for r in pii_votes.digest(pii_votes.scan(docs)).collect()}
    assert all(got[100 + i] == 1 for i in range(20)) and not any(got[200 + i] for i in range(40))


def test_written_addresses_in_capitals_and_among_neighbours(spark):
    """A text's spans are its own: the same alone and beside others, in small letters and in capitals."""
    lines = [(i, f"mail me at name{i}@mail.example.com or phone +1 (212) 555-01{i:02d} today") for i in range(60)]
    lines += [(100, "contact JOHN [AT] MIX [DOT] COM"), (101, "contact john (at) mail (dot) org"), (102, "nothing [here] to see")]
    docs = spark.createDataFrame(lines, "doc_id bigint, text string")
    model = pii_votes.fit(docs)
    alone = {i: pii_votes.found_spans(pa.array([t]), model)[0] for i, t in lines}
    together = pii_votes.found_spans(pa.array([t for _, t in lines]), model)
    assert [alone[i] for i, _ in lines] == together
    assert [len(alone[i]) for i in (100, 101, 102)] == [1, 1, 0]


@pytest.mark.parametrize("seed", range(4))
def test_planted_spans(spark, seed):
    """Of planted unlabelled spans at least nine tenths are found; of other numbers at most a tenth."""
    import random

    rng = random.Random(seed)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randrange(4, 9)))
    lines = [f"write to {word()}@{word()}.com or call +49 {digits(3)} {digits(7)}" for _ in range(80)]
    planted = [f"contact {word()} [at] mail{word()} [dot] com please" for _ in range(40)]
    others = [f"invoice {digits(10)} for item {digits(9)} on page {digits(8)}" for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(lines + planted + others)), "doc_id bigint, text string")
    got = [r["n_personal"] for r in pii_votes.digest(pii_votes.scan(docs)).orderBy("doc_id").collect()]
    assert sum(n > 0 for n in got[80:120]) >= 36 and sum(got[120:]) <= 18


def test_long_texts_take_linear_time():
    for text in ("a" * 200_000 + "@", "1" * 200_000, "+1" + " " * 200_000, "1." * 100_000, "token " * 40_000):
        pii_votes.base_spans(text)
        secret_automata.base_spans(text)
    assert secret_automata.found_spans(pa.array(["x" * 200_000]), secret_automata.Formats((), ())) == [[]]

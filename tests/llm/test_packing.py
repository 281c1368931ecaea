from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from punctual.llm import length_packing
from punctual.llm.words import raw

PLAIN = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids_of(text):
    return [*PLAIN.encode(text or "", add_special_tokens=False).ids, length_packing.END]


def check_whole(docs, packed):
    """Each id of each document lies in one piece, sequences are gapless and not above the capacity."""
    texts, rows = defaultdict(list), packed.collect()
    for r in docs.select("doc_id", "text").collect():
        texts[r["doc_id"]].append(ids_of(r["text"]))
    of_doc, of_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        of_doc[r["doc_id"]].append((r["start"], r["doc_tokens"], ids))
        of_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    assert of_doc.keys() == texts.keys()
    for i, parts in of_doc.items():
        if len(texts[i]) == 1:
            ordered = sorted(parts)
            assert [x for _, _, ids in ordered for x in ids] == texts[i][0]
            assert [s for s, _, _ in ordered] == [sum(len(p[2]) for p in ordered[:k]) for k in range(len(ordered))]
        assert sorted(x for _, _, ids in parts for x in ids) == sorted(x for t in texts[i] for x in t)
        assert {n for _, n, _ in parts} == {len(t) for t in texts[i]}
    for parts in of_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= length_packing.CAPACITY
    return rows


def test_every_id_lies_in_one_piece(odd, documents):
    check_whole(odd, length_packing.pack(odd))
    rows = check_whole(documents, length_packing.pack(documents))
    assert len({r["sequence_id"] for r in rows}) == max(r["sequence_id"] for r in rows) + 1


def test_query_has_the_same_places_without_ids(odd):
    whole, narrow = length_packing.pack(odd), length_packing.pack(odd, with_ids=False)
    assert narrow.columns == [c for c in whole.columns if c != "ids"]
    assert sorted(map(repr, whole.drop("ids").collect())) == sorted(map(repr, narrow.collect()))


def test_little_padding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sums = length_packing.sequences(length_packing.pack(docs)).agg({"length": "sum", "padded_to": "sum"}).first()
    assert sums["sum(length)"] > 0.995 * sums["sum(padded_to)"]


def test_sequences_hold_their_pieces(odd):
    packed = length_packing.pack(odd)
    parts = defaultdict(list)
    for r in packed.collect():
        parts[r["sequence_id"]].append((r["offset"], r["ids"]))
    for r in length_packing.sequences(packed).collect():
        assert bytes(r["ids"]) == b"".join(bytes(ids) for _, ids in sorted(parts[r["sequence_id"]]))
        assert r["length"] == len(r["ids"]) // 4 and r["padded_to"] == (r["length"] if r["length"] & (r["length"] - 1) == 0 else length_packing.CAPACITY)


def test_empty_table(none):
    assert length_packing.pack(none).collect() == []
    assert length_packing.sequences(length_packing.pack(none)).collect() == []


def test_other_key_types(spark):
    docs = spark.createDataFrame([("a", "one two"), ("b", None), (None, "x" * 50)], "name string, body string")
    got = length_packing.pack(docs, id_col="name", text_col="body").collect()
    assert {r["name"] for r in got} == {"a", "b", None} and {r["sequence_id"] for r in got} == {0}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(
    ["don't", "'s", "'", "it's", "word,next", "(foo)", "x1y22", "<|endoftext|>", "<|EndOfText|>", "|", "é", "é", "ΣΑΣ", " ", "\n", "\t", " ", "　", "日本", "ß", "A.B", "--", "3.14", "́", "\x1f", "ſ"]
), max_size=12).map("".join), max_size=4))
def test_snippets_give_the_ids_of_whole_texts(texts):
    data, edges = raw(pa.array(texts, pa.string()))
    got = length_packing.tokens_of(None).encode(data, edges)
    assert got["ids"].tolist() == [i for t in texts for i in ids_of(t)]
    assert got["n"].tolist() == [len(ids_of(t)) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=12))
def test_patterns_hold_every_length(histogram):
    patterns = length_packing.shortest_pack_first(histogram, 64)
    assert all(p.total <= 64 and p.count > 0 for p in patterns)
    held = defaultdict(int)
    for p in patterns:
        for length in p.lengths:
            held[length] += p.count
    assert dict(held) == histogram
    places = [(length, rank + i, sequence + i) for length, rank, n, sequence, _ in length_packing.runs_of(patterns) for i in range(n)]
    assert sorted((length, rank) for length, rank, _ in places) == [(length, r) for length in sorted(histogram) for r in range(histogram[length])]


def test_packing_by_hand():
    # 60 opens packs, 30 goes to the shortest, 4 to what is left
    patterns = length_packing.shortest_pack_first({60: 2, 30: 2, 4: 2}, 64)
    assert sorted((p.lengths, p.count) for p in patterns) == [((30, 30, 4), 1), ((60,), 1), ((60, 4), 1)]


def test_work_does_not_grow_with_documents():
    few = length_packing.shortest_pack_first(dict.fromkeys(range(1, 4097), 7))
    many = length_packing.shortest_pack_first(dict.fromkeys(range(1, 4097), 7 * 10**9))
    assert len(many) < 3 * len(few) + 100
    held = sum(p.count * p.total for p in many)
    assert held == 7 * 10**9 * 4096 * 4097 // 2 and held > 0.99 * 4096 * sum(p.count for p in many)


@pytest.mark.parametrize("text", ["a" * 200_000, "1" * 50_000, "a,b " * 60_000])
def test_long_texts(text):
    data, edges = raw(pa.array([text]))
    assert length_packing.tokens_of(None).encode(data, edges)["ids"].tolist() == ids_of(text)

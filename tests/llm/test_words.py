from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from plain import WORD
from pyspark import cloudpickle

from punctual.llm import words
from punctual.llm.packing import planes, unplanes
from punctual.llm.words import pieces, split

TEXT = st.text(alphabet=st.sampled_from("ab é\t\n\x0b\x1f 日A"), max_size=30)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8), st.integers(1, 40))
def test_words_of_pieces_are_those_of_the_pattern(texts, size):
    got, hashes = [], {}
    for lo, hi, data, edges in pieces(pa.array(texts, pa.string()), size):
        w = split(data, edges)
        words = [data[s:e].tobytes().decode() for s, e in zip(w.start, w.end)]
        for word, h in zip(words, w.hashes().tolist()):
            assert hashes.setdefault(word, h) == h
        got += [words[w.first[d] : w.first[d + 1]] for d in range(hi - lo)]
    assert got == [WORD.findall(t or "") for t in texts]
    assert len(set(hashes.values())) == len(hashes)


def test_pieces_of_a_slice():
    texts = pa.array(["no", "a b", None, "c"])[1:]
    assert [(lo, hi) for lo, hi, _, _ in pieces(texts, 1)] == [(0, 1), (1, 3)]


def test_lower_case_touches_ascii_letters_only():
    _, _, data, edges = next(pieces(pa.array(["É é AB ab"])))
    a, b, c, d = split(data, edges).hashes(lower=True).tolist()
    assert a != b and c == d


@given(st.lists(st.integers(0, 2**64 - 1), max_size=20))
def test_planes_round_trip(values):
    assert unplanes(planes(np.array(values, np.uint64), "<u8"), "<u8").tolist() == values


def test_separator_table():
    _, _, data, edges = next(pieces(pa.array(["ab-c!d"])))
    from punctual.llm.words import table

    w = split(data, edges, table(b"-!"))
    assert [data[s:e].tobytes().decode() for s, e in zip(w.start, w.end)] == re.split("[-!]", "ab-c!d")


def test_tasks_do_not_carry_what_the_driver_worked_out():
    words.powers(words.STEP, 1 << 20)
    assert len(cloudpickle.dumps(words.span_hashes)) < 100_000
    assert len(words.powers(words.STEP, 1 << 20)) == 1 << 20

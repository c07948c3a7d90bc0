import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from talusgrid.llm import kernels as K

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbZ \t\n\x0b\r.éß\u2003\x85", max_size=40)), max_size=8)


def words(text):
    return WORD.findall((text or "").translate(LOWER))


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_word_hashes_are_those_of_the_words(texts):
    h, offsets = K.word_hashes(*K.text_bytes(pa.array(texts, pa.string())))
    assert np.diff(offsets).tolist() == [len(words(t)) for t in texts]
    flat = [w for t in texts for w in words(t)]
    by_word = {}
    for w, v in zip(flat, h.tolist(), strict=True):
        assert by_word.setdefault(w, v) == v
    assert len(set(by_word.values())) == len(by_word)


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(1, 5))
def test_shingles(texts, width):
    s, offsets = K.shingle_hashes(*K.word_hashes(*K.text_bytes(pa.array(texts, pa.string()))), width)
    s, offsets = K.distinct_by_row(s, offsets)
    want = []
    for t in texts:
        w = words(t)
        want.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    assert np.diff(offsets).tolist() == [len(x) for x in want]
    rows = [set(s[a:b].tolist()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    for i in range(len(texts)):
        for j in range(i):
            assert len(rows[i] & rows[j]) == len(want[i] & want[j])


def test_sliced_columns_and_empty_ones():
    column = pa.array(["x y", None, "", "y x x"], pa.string()).slice(1)
    h, offsets = K.word_hashes(*K.text_bytes(column))
    assert offsets.tolist() == [0, 0, 0, 3] and h[1] == h[2]
    assert K.word_hashes(*K.text_bytes(pa.array([], pa.string())))[1].tolist() == [0]

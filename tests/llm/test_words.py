from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from brute import spaced_words
from hypothesis import given, settings
from hypothesis import strategies as st

from heirline.llm import words as W

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB é\t\n.7\x00日", max_size=30)), max_size=8)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words_of_any_texts(texts):
    found = W.find_words(pa.array(texts, pa.string()), W.SPACED)
    for i, text in enumerate(texts):
        assert [found.text(j) for j in range(found.first[i], found.first[i + 1])] == spaced_words(text)


@settings(max_examples=60, deadline=None)
@given(TEXTS, st.integers(1, 4))
def test_shingles_are_equal_exactly_for_equal_words(texts, n):
    first, hashes = W.shingles(W.find_words(pa.array(texts, pa.string()), W.SPACED), n)
    seen: dict[int, tuple] = {}
    for i, text in enumerate(texts):
        words = spaced_words(text)
        want = [tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))] if words else []
        got = hashes[first[i] : first[i + 1]].tolist()
        assert len(got) == len(want)
        for h, w in zip(got, want, strict=True):
            assert seen.setdefault(h, w) == w
    assert len(set(seen.values())) == len(seen)


def test_distinct_sorts_within_texts():
    first, values = W.distinct(np.array([0, 3, 3, 5]), np.array([9, 2, 9, 1, 1], np.uint64))
    assert first.tolist() == [0, 2, 2, 3] and values.tolist() == [2, 9, 1]


def test_slices_cover_all_rows():
    rng = random.Random(3)
    column = pa.array(["x" * rng.randrange(50) for _ in range(40)] + [None, "y" * 500])
    parts = list(W.slices(column, 100))
    assert parts[0][0] == 0 and parts[-1][1] == len(column)
    assert all(a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False))
    assert list(W.slices(pa.array([], pa.string()), 100)) == []

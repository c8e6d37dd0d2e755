"""Vectorised words and shingles against plain Python."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm.text import Types, shingle_sets, slices, utf8, windows, word_hashes, words

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbé🙂 \t\n\x0b\x0c\r\x85\u2003", max_size=40)), max_size=8)


def plain(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_words(texts):
    raw, at = utf8(pa.array(texts, pa.string()))
    starts, ends, first = words(raw, at)
    got = [raw[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)]
    assert [got[first[i] : first[i + 1]] for i in range(len(texts))] == [plain(t) for t in texts]
    h = word_hashes(raw, starts, ends, True)
    low = [w.translate({c: c + 32 for c in range(65, 91)}) for w in got]
    assert all((h[i] == h[j]) == (low[i] == low[j]) for i in range(len(h)) for j in range(len(h)))


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_shingles(texts):
    raw, at = utf8(pa.array(texts, pa.string()))
    grams, to = shingle_sets(raw, at, 3)
    sets = []
    for t in texts:
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in plain(t)]
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set())
    own = [set(grams[to[i] : to[i + 1]].tolist()) for i in range(len(texts))]
    assert [len(x) for x in own] == [len(x) for x in sets]
    for a, x in zip(own, sets, strict=True):
        for b, y in zip(own, sets, strict=True):
            assert len(a & b) == len(x & y)


def test_slices_cover_rows():
    at = np.array([0, 5, 5, 100, 101, 130])
    got = list(slices(at, 20))
    assert [i for a, b in got for i in range(a, b)] == list(range(5))
    assert list(slices(np.array([0]))) == []


def test_windows_stay_in_rows():
    h = np.arange(6, dtype=np.uint64)
    _, at = windows(h, np.array([0, 2, 2, 6]), 3)
    assert at.tolist() == [2, 3]


def test_types():
    t = Types()
    n, new = t.numbers(np.array([2, 5], np.uint64))
    assert n.tolist() == [0, 1] and new.all()
    n, new = t.numbers(np.array([1, 5, 9], np.uint64))
    assert n.tolist() == [2, 1, 3] and new.tolist() == [True, False, True]

from __future__ import annotations

import numpy as np
import odd
import pyarrow as pa
from brute import grams, words
from hypothesis import given, settings
from hypothesis import strategies as st

from emberline.llm import textkit as K

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab AB09_.!\n\t éÉ×÷ÀÿĀ東", max_size=40)), max_size=8)


def spans(texts):
    buf, off = K.string_buffers(pa.array(texts, pa.string()))
    tk = K.tokens(buf, off)
    return tk, [buf[a:b].tobytes().decode() for a, b in zip(tk.start.tolist(), tk.end.tolist())]


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_words_are_those_of_the_pattern(texts):
    tk, raw = spans(texts)
    want = [(i, w) for i, t in enumerate(texts) for w in words(t or "")]
    assert [(d, words(r)[0]) for d, r in zip(tk.doc.tolist(), raw)] == want
    by = {}
    for h, (_, w) in zip(tk.hash.tolist(), want):
        assert by.setdefault(w, h) == h
    assert len(set(by.values())) == len(by)


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_grams_are_sets_of_words(texts):
    tk, _ = spans(texts)
    h, d = K.grams(tk.hash, tk.doc, 3)
    for i, t in enumerate(texts):
        assert len(set(h[d == i].tolist())) == len(grams(t or "", 3))


def test_slices_cover_all_documents_once():
    off = np.array([0, 5, 5, 400, 401, 1000, 1000])
    parts = list(K.slices(off, 100))
    assert parts[0][0] == 0 and parts[-1][1] == 6 and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))


def test_a_slice_of_a_column_and_very_long_words():
    column = pa.array(["zz", "a b", None, "x" * 10_000 + " y"]).slice(1)
    buf, off = K.string_buffers(column)
    tk = K.tokens(buf, off)
    assert tk.doc.tolist() == [0, 0, 2, 2]
    assert K.tokens(*K.string_buffers(pa.array([odd.prose(1, 10)]))).hash.dtype == np.uint64

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.llm import words

TEXT = st.lists(st.one_of(st.none(), st.text(alphabet="ab Zé\t\n\r\x0b\x0c.9中", max_size=40)), max_size=12)


def by_text(texts, **how):
    out = {}
    for first, h, at in words.hashed(pa.array(texts, pa.string()), **how):
        for k in range(len(at) - 1):
            out[first + k] = h[at[k] : at[k + 1]].tolist()
    return out


def check(texts, lower, split, **how):
    got = by_text(texts, lower=lower, **how)
    assert sorted(got) == list(range(len(texts)))
    known, back = {}, {}
    for k, t in enumerate(texts):
        own = split(t or "")
        assert len(got[k]) == len(own), (t, own)
        for h, w in zip(got[k], own, strict=True):
            assert known.setdefault(w, h) == h and back.setdefault(h, w) == w


@settings(max_examples=60, deadline=None)
@given(TEXT, st.sampled_from([7, 64, 1 << 20]))
def test_words_like_split(texts, piece):
    old, words._PIECE = words._PIECE, piece
    try:
        check(texts, False, lambda t: t.encode().split())
        import re

        check(texts, True, lambda t: re.findall(rb"(?:[a-z0-9]|[\x80-\xff])+", t.encode().lower()), marks=True)
        check(texts, True, lambda t: [w[:2] for w in t.encode().lower().split()], stem=2)
    finally:
        words._PIECE = old


@settings(max_examples=60, deadline=None)
@given(TEXT, st.sampled_from([5, 64, 1 << 20]))
def test_located_words(texts, piece):
    old, words._PIECE = words._PIECE, piece
    try:
        got = {k: [] for k in range(len(texts))}
        for first, h, begin, stop, at, data in words.located(pa.array(texts, pa.string())):
            raw = data.tobytes()
            for k in range(len(at) - 1):
                got[first + k] += [raw[a:b] for a, b in zip(begin[at[k] : at[k + 1]], stop[at[k] : at[k + 1]], strict=True)]
        assert [got[k] for k in range(len(texts))] == [(t or "").encode().split() for t in texts]
    finally:
        words._PIECE = old


def test_slices_and_long_words():
    column = pa.array(["a b", "c", None, "x" * 3_000_000 + " y", "a b"])
    assert len(by_text(column.slice(1, 3).to_pylist())[2]) == 2
    assert [len(h) for _, h, _ in words.hashed(column.slice(3, 1))] == [2]
    got = by_text(column.to_pylist())
    assert got[0] == got[4] and len(got[3]) == 2


def test_spans_and_shingles_depend_on_words_alone():
    h = np.concatenate([next(iter(words.hashed(pa.array([t]))))[1] for t in ("q a b c d", "a\nb  c d")])
    one = words.spans(*words.prefix(h), np.array([1, 5]), np.array([5, 9]))
    assert one[0] == one[1]
    grams = words.shingles(h, 3)
    assert grams[1] == grams[5] and len(set(grams.tolist())) == len(grams) - 2
    assert len(words.shingles(h[:2], 3)) == 0


@pytest.mark.parametrize("n", [0, 1, 5])
def test_empty(n):
    assert by_text([""] * n) == {k: [] for k in range(n)}

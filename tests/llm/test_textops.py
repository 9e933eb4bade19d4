"""Vectorised text primitives against plain Python."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from wayfare.llm import exchange, textops as X

TEXT = st.lists(st.one_of(st.none(), st.text(alphabet="aB é\t\n\x0b1.\U0001F600", max_size=30)), min_size=1, max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXT, st.integers(1, 40))
def test_words_and_hashes(texts, limit):
    seen, rows = {}, 0
    for c in X.chunks(pa.array(texts, pa.string()), limit=limit):
        h = c.word_hash()
        for r in range(c.n):
            want = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", texts[rows + r] or "")]
            assert c.words(r) == want
            for w, x in zip(want, h[c.first[r]:c.first[r + 1]].tolist()):
                assert seen.setdefault(w, x) == x
        rows += c.n
    assert rows == len(texts)
    assert len(set(seen.values())) == len(seen)


def test_sliced_and_long_arrays():
    a = pa.array(["zero", "one two", None, "x" * 100_000 + " y"], pa.large_string()).slice(1)
    got = [c.words(r) for c in X.chunks(a, limit=16) for r in range(c.n)]
    assert got == [[b"one", b"two"], [], [b"x" * 100_000, b"y"]]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2 ** 64 - 1), max_size=50, unique=True), st.integers(1, 9))
def test_exchange_round_trip(keys, buckets):
    k = np.array(sorted(keys), np.uint64)
    p = np.arange(len(k), dtype=np.uint32) * 3
    back, q = exchange.unpack(exchange.pack(k, p), np.uint32)
    assert back.tolist() == k.tolist() and q.tolist() == p.tolist()
    cuts = exchange.bucket_cuts(k, buckets)
    assert cuts[0] == 0 and cuts[-1] == len(k) and len(cuts) == buckets + 1
    for b in range(buckets):
        assert all(int(x) * buckets >> 64 == b for x in k[cuts[b]:cuts[b + 1]])

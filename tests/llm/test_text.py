"""The hashing kernel against plain Python."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import text as tx


def lowered(t: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=" \t\nabAB.é|\x00", max_size=30)), max_size=8), st.integers(1, 5))
def test_words_and_shingles(texts, k):
    seen: dict[int, str] = {}
    for lo, hi, data, offsets in tx.chunks(pa.array(texts, pa.string()), 16):
        h, first = tx.hash_words(data, offsets)
        g, at = tx.shingles(h, first, k)
        for i, t in enumerate(texts[lo:hi]):
            words = re.findall(r"[^\x20\x09-\x0D]+", lowered(t or ""))
            own = h[first[i] : first[i + 1]]
            assert len(own) == len(words)
            for x, w in zip(own.tolist(), words, strict=True):
                assert seen.setdefault(x, w) == w
            want = [tuple(words[j : j + k]) for j in range(max(1, len(words) - k + 1))] if words else []
            got = g[at[i] : at[i + 1]].tolist()
            assert len(got) == len(want)
            assert len(set(got)) == len(set(want))


def test_equal_words_hash_alike_anywhere():
    data = np.frombuffer(b"one two one  two", np.uint8)
    h, _ = tx.hash_words(data, np.array([0, len(data)]))
    assert h[0] == h[2]
    assert h[1] == h[3]
    assert h[0] != h[1]

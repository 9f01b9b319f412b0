"""Pieces against the tokenizer, and sequences without slack."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from tessera.llm import packing
from tessera.llm.queries import tokenizer_path

TEXTS = [None, "", "a", " a  b\n\nc <|endoftext|> d e", "it's x\ty\r\nz ", "<|endoftext|>", "word " * 900, "Ünï cödé x y \U0001f600", "x\ny z\n q", "\n", "same", "same"]


def test_ids_and_sequences(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(TEXTS)], "doc_id long, text string, start int").repartition(3)
    rows = packing.pack(df, tokenizer_path(), 64).collect()
    want = {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in enumerate(TEXTS)}
    by_doc: dict[int, list] = {}
    by_seq: dict[int, list] = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(want)
    for i, own in by_doc.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(want[i]))
            assert r.ids_crc32 == zlib.crc32(want[i][at : at + r.length].tobytes())
            at += r.length
        assert at == len(want[i])
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
        assert at & (at - 1) == 0


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_fill_is_closest(seed):
    r = random.Random(seed)
    counts = {r.randint(2, 30): r.randint(1, 3) for _ in range(6)}
    for room in range(1, 60):
        sums = {0}
        for length, n in counts.items():
            sums = {s + i * length for s in sums for i in range(n + 1)}
        got = packing.fill(counts, room)
        assert all(got[k] <= counts[k] for k in got)
        assert sum(k * v for k, v in got.items()) == max(s for s in sums if s <= room)


def test_hot_length_is_cut():
    place = packing.placement({600: 10}, 1024)
    spots = [s for rank in range(10) for s in place(600, rank)]
    assert sum(s[1] for s in spots) == 6000
    full = {}
    for _, size, seq, _ in spots:
        full[seq] = full.get(seq, 0) + size
    assert all(v & (v - 1) == 0 and v <= 1024 for v in full.values())


def test_ids_of_made_up_texts(monkeypatch):
    """The gathered ids are the tokenizer's, with odd white space, long words, and a cache that overflows."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    r = random.Random(5)
    alphabet = ["a", "b", "'", "s", "'s", "'ll", "1", "22", ".", "-", "ü", "日", "\U0001f600", "<|", "endoftext", "|>", "<|endoftext|>", "x" * 70, "́", "é"]
    gaps = [" "] * 12 + ["\n"] * 4 + ["  ", "\t", " ", "\r\n", " ", "\x1c", "\x85", "\n\n", ""]
    texts = ["".join(r.choice(gaps if i % 2 else alphabet) for i in range(r.randint(0, 30))) for _ in range(3000)]
    texts += [" ".join("".join(r.choices("abcdeü", k=r.randint(1, 8))) for _ in range(200)) for _ in range(100)] + [None]
    monkeypatch.setattr(packing, "CACHE", 2000)
    enc = packing.Encoder(tokenizer_path())
    got = [x for lo in range(0, len(texts), 500) for x in enc.encode(pa.array(texts[lo : lo + 500], pa.string()))]
    want = [np.array(e.ids, "<u4").tobytes() for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [i for i, (x, y) in enumerate(zip(got, want, strict=True)) if x != y] == []
